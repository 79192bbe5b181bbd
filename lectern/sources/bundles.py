"""Bundles of collections as a data source: zip files of documents and their descriptions, read and written in parallel.

A bundle is a folder of zips (or one zip).  Each holds ``files/<entry>`` and ``manifest.jsonl``, a line for every document with its entry, metadata
and the collections it is in, so a document is there once however many collections hold it.  Writing is a job with a commit: tasks
write under a temporary name, and the parts appear, with ``_SUCCESS``, only when all are done.  A zip with one ``manifest.json``, as made
for a single collection, is read too.  The folder has to be mounted at the same place on all executors.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.text import basename
from ..operators.changes import Conflict
from ..session import checkpointed, ship

BUNDLE = "entry string, document string, content binary"
#: Metadata that travels, where documents have it.
CARRIED = ("path", "title", "authors", "year", "summary", "summary_source", "kind", "category")
TAGS = "array<struct<tag:string,source:string>>"


def unique_entries(docs: DataFrame) -> DataFrame:
    """(id, entry): the last part of the path; of documents with one name, the lowest id keeps it and the others put their id in front."""
    named = docs.select("id", basename(F.col("path")).alias("entry"))
    while True:
        named = checkpointed(named)
        first = named.groupBy("entry").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        if first.where("n > 1").isEmpty():
            return named
        new = F.concat(F.col("id").cast("string"), F.lit("-"), "entry")
        named = named.join(first, "entry").select("id", F.when(F.col("id") == F.col("first"), F.col("entry")).otherwise(new).alias("entry"))


def bundled(collections: DataFrame, members: DataFrame, docs: DataFrame, tags: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a bundle.  ``files``: (path, content); a document whose file is gone is described without content."""
    held = members.dropDuplicates(["collection_id", "doc_id"]).join(collections.select(F.col("id").alias("collection_id"), "name"), "collection_id")
    held = held.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("collections"))
    t = tags.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("tag", "source"))).alias("tags"))
    d = docs.join(held, "id")
    d = d.join(unique_entries(d), "id").join(t, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast(TAGS)))
    described = F.to_json(F.struct("id", "entry", "collections", "tags", *(c for c in CARRIED if c in docs.columns)))
    return d.withColumn("document", described).select("path", "entry", "document").join(files.select("path", "content"), "path", "left").drop("path")


def documents_of(rows: DataFrame) -> DataFrame:
    """(entry, id, tags and metadata) of a bundle's rows; ids are those of the library that wrote it."""
    schema = f"id long, tags {TAGS}, " + ", ".join(f"{c} string" for c in CARRIED)
    return rows.select("entry", F.from_json("document", schema).alias("d")).select("entry", "d.*")


def memberships_of(rows: DataFrame) -> DataFrame:
    """(name, entry): a row for each collection of each document."""
    d = rows.select("entry", F.from_json("document", "collections array<string>").alias("d"))
    return d.select(F.explode("d.collections").alias("name"), "entry")


def local(path: str) -> str:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} is no mounted folder")
    return path


def _read_zip(path: str, contents: bool) -> Iterator[tuple]:
    with zipfile.ZipFile(path) as z:
        there = set(z.namelist())
        if "manifest.jsonl" in there:
            with z.open("manifest.jsonl") as lines:
                described = [json.loads(line) for line in lines]
        else:
            m = json.loads(z.read("manifest.json"))
            name = (m.get("collection") or {}).get("name") or m.get("name") or "collection"
            described = [d | {"entry": d["file"], "collections": [name]} for d in m["documents"]]
        for d in described:
            entry = os.path.basename(d["entry"].replace("\\", "/"))  # never a path of the writer's choice
            inside = f"files/{entry}"
            yield entry, json.dumps(d, ensure_ascii=False), z.read(inside) if contents and inside in there else None


@dataclass
class Part(InputPartition):
    path: str


class BundleReader(DataSourceReader):
    def __init__(self, path: str, contents: bool):
        self.path, self.contents = path, contents

    def partitions(self) -> list[Part]:
        if os.path.isfile(self.path):
            return [Part(self.path)]
        if not os.path.exists(os.path.join(self.path, "_SUCCESS")):
            raise ValueError(f"{self.path} is no finished bundle")
        return [Part(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if n.endswith(".zip")]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _read_zip(partition.path, self.contents)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class BundleWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.work = path, os.path.join(path, f"_temporary-{uuid.uuid4().hex}")

    def write(self, iterator) -> Written:
        os.makedirs(self.work, exist_ok=True)
        target, lines = os.path.join(self.work, f"{uuid.uuid4().hex}.zip"), []
        z = None
        for row in iterator:
            z = z or zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED)
            if row.content is not None:
                z.writestr(f"files/{row.entry}", bytes(row.content))
            lines.append(row.document)
        if z is None:
            return Written(None)
        z.writestr("manifest.jsonl", "\n".join(lines) + "\n")
        z.close()
        return Written(target)

    def commit(self, messages) -> None:
        """Attempts that Spark did not count stay behind in the temporary folder and go with it."""
        os.makedirs(self.path, exist_ok=True)
        for k, m in enumerate(m for m in messages if m is not None and m.path):
            os.rename(m.path, os.path.join(self.path, f"part-{k:05d}.zip"))
        shutil.rmtree(self.work, ignore_errors=True)
        open(os.path.join(self.path, "_SUCCESS"), "w").close()

    def abort(self, messages) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


class BundleSource(DataSource):
    """``format("bundle")`` with ``path``; reading with option ``contents`` false leaves the payload out."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return BUNDLE

    def reader(self, schema) -> BundleReader:
        return BundleReader(local(self.options["path"]), self.options.get("contents", "true") != "false")

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        path = local(self.options["path"])
        if os.path.exists(path):
            raise Conflict(f"{path} exists")
        return BundleWriter(path)


def write(rows: DataFrame, path: str) -> None:
    """Writes rows of ``bundled`` as a bundle, a zip for each task; a folder that exists is refused."""
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(BundleSource)
    if os.path.exists(local(path)):
        raise Conflict(f"{path} exists")
    rows.select("entry", "document", "content").write.format("bundle").mode("append").save(path)


def read(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """Rows (entry, document, content) of a bundle."""
    ship(spark)
    spark.dataSource.register(BundleSource)
    return spark.read.format("bundle").option("contents", str(contents).lower()).load(path)
