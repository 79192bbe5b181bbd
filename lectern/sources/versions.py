"""A log of numbered JSON entries on any Hadoop file system, committed optimistically.

An entry is written under a name of its own and then renamed to its number, which fails if that number is taken: of two writers that
started from one version, one wins and the other gets a ``Conflict``.  Readers see whole entries only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from ..operators.changes import Conflict

DIGITS = 12


class Files:
    """What the library needs of a Hadoop file system, through the session's own configuration."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = self.path(root)
        self.fs = at.getFileSystem(self._conf)

    def path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def stamp(self, p: str) -> list[list]:
        """[name, size, time] of all data files below a path, in order."""
        out, todo = [], [self.fs.getFileStatus(self.path(p))]
        while todo:
            s = todo.pop()
            name = s.getPath().getName()
            if s.isDirectory():
                todo += list(self.fs.listStatus(s.getPath()))
            elif not name.startswith(("_", ".")):
                out.append([name, s.getLen(), s.getModificationTime()])
        return sorted(out)

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, p: str, text: str) -> None:
        stream = self.fs.create(self.path(p), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename_new(self, old: str, new: str) -> bool:
        """Whether ``old`` now has the name ``new``; never in place of a file that is there."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.path(old), self.path(new), none)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


class VersionLog:
    def __init__(self, spark: SparkSession, root: str):
        self.root, self.files = root.rstrip("/"), Files(spark, root)

    def versions(self) -> list[int]:
        return [int(n[:DIGITS]) for n in self.files.names(self.root) if n.endswith(".json") and n[:DIGITS].isdigit()]

    def latest(self) -> tuple[int, dict]:
        """(number, entry); (0, {}) before the first commit."""
        known = self.versions()
        return (known[-1], self.entry(known[-1])) if known else (0, {})

    def entry(self, n: int) -> dict:
        return json.loads(self.files.read(f"{self.root}/{n:0{DIGITS}d}.json"))

    def commit(self, after: int, entry: dict) -> int:
        """Adds the entry that follows number ``after``; a ``Conflict`` if another one did."""
        mine = f"{self.root}/.{uuid.uuid4().hex}"
        self.files.write(mine, json.dumps(entry))
        if not self.files.rename_new(mine, f"{self.root}/{after + 1:0{DIGITS}d}.json"):
            self.files.delete(mine)
            raise Conflict(f"version {after + 1} of {self.root} is taken")
        return after + 1
