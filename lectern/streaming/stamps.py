"""Directory trees as a stream of file stamps: every micro-batch is one scan.

A row is (path, size, mtime, scan, before): ``scan`` numbers the scan and ``before`` the one this query processed last, so that a
consumer knows two scans in a row from two with a gap.  A changed file is seen again, hidden entries are not, and neither are
unreadable ones.  The directories have to be mounted at the same place on all executors; each first-level directory is one task.
A replayed batch lists anew: stamps are observations, and their consumers are idempotent.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship

STAMPS = "path string, size long, mtime long, scan long, before long"


class Tree(InputPartition):
    def __init__(self, top: str, deep: bool, scan: int, before: int):
        self.top, self.deep, self.scan, self.before = top, deep, scan, before


def entries(top: str) -> list[os.DirEntry]:
    """Entries of a directory that are not hidden; none if it is gone or closed to us."""
    try:
        with os.scandir(top) as d:
            return [e for e in d if not e.name.startswith(".")]
    except OSError:
        return []


def walked(top: str, deep: bool = True) -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime in nanoseconds) of the files of a directory, and of those below it."""
    todo = [top]
    while todo:
        for e in entries(todo.pop()):
            try:
                if e.is_dir(follow_symlinks=False):
                    if deep:
                        todo.append(e.path)
                elif e.is_file():
                    s = e.stat()
                    yield e.path, s.st_size, s.st_mtime_ns
            except OSError:
                continue


class Scans(DataSourceStreamReader):
    def __init__(self, directories: list[str]):
        self.directories, self.last = directories, 0

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        self.last = max(self.last + 1, time.time_ns() // 1_000_000)
        return {"scan": self.last}

    def partitions(self, start: dict, end: dict) -> list[Tree]:
        if start == end:
            return []
        at = end["scan"], start["scan"]
        out = []
        for d in self.directories:
            out.append(Tree(d, False, *at))
            out += [Tree(e.path, True, *at) for e in entries(d) if e.is_dir(follow_symlinks=False)]
        return out

    def read(self, partition: Tree) -> Iterator[tuple]:
        for path, size, mtime in walked(partition.top, partition.deep):
            yield path, size, mtime, partition.scan, partition.before

    def commit(self, end: dict) -> None:
        pass


class StampSource(DataSource):
    """``spark.readStream.format("stamps").option("directories", json list)``."""

    @classmethod
    def name(cls) -> str:
        return "stamps"

    def schema(self) -> str:
        return STAMPS

    def streamReader(self, schema) -> Scans:
        return Scans([os.path.normpath(d) for d in json.loads(self.options["directories"])])


def scans(spark: SparkSession, directories: list[str]) -> DataFrame:
    """Stamps of all files below the directories, as a stream; later directories may appear later."""
    if not directories:
        raise ValueError("no directory to watch")
    ship(spark)
    spark.dataSource.register(StampSource)
    return spark.readStream.format("stamps").option("directories", json.dumps(list(directories))).load()
