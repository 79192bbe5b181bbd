"""Snapshots of a library on any Hadoop file system: immutable tables, and a log that names those of each version."""

from __future__ import annotations

import json
import os
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import basename, slugified
from ..operators.changes import Conflict
from .versions import Files, VersionLog

REQUIRED = "documents"


def checked(tables: dict[str, DataFrame]) -> int:
    """Number of documents; a ``ValueError`` where the tables are no library."""
    if REQUIRED not in tables:
        raise ValueError(f"no library: it has no {REQUIRED}")
    df = tables[REQUIRED]
    if "id" not in df.columns or "path" not in df.columns:
        raise ValueError("documents lack id or path")
    return df.count()


class Store:
    """Tables below ``root/tables``, versions in ``root/log``.

    A commit writes new tables beside the old ones, checks them as written, and adds one entry to the log.  Whoever started from
    a version that is no longer the last gets a ``Conflict`` and changes nothing, as does a commit whose check fails.  Tables that a commit
    does not mention stay as they are.  A stream's sink names itself and its epoch: an epoch that is replayed changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log, self.files = VersionLog(spark, f"{self.root}/log"), Files(spark, root)

    def version(self) -> int:
        return self.log.latest()[0]

    def _tables(self, version: int | None) -> dict[str, str]:
        n = self.version() if version is None else version
        return self.log.entry(n)["tables"] if n else {}

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """Tables of the last or an earlier version; later commits do not touch them."""
        return {name: self.spark.read.parquet(f"{self.root}/tables/{at}") for name, at in self._tables(version).items()}

    def commit(
        self,
        tables: dict[str, DataFrame],
        after: int | None = None,
        sink: str | None = None,
        epoch: int | None = None,
        check: Callable[[dict[str, DataFrame]], object] | None = None,
        replace: bool = False,
    ) -> int:
        """The new version.  ``after``: the version that the tables were made from; ``replace``: other tables go."""
        last, entry = self.log.latest()
        after = last if after is None else after
        epochs = entry.get("epochs", {})
        if sink is not None and epochs.get(sink, -1) >= epoch:
            return last
        if after != last:
            raise Conflict(f"version {after} is no longer the last one")
        made = {name: f"{name}-{uuid.uuid4().hex}" for name in tables}
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.root}/tables/{made[name]}")
            if check is not None:
                check({name: self.spark.read.parquet(f"{self.root}/tables/{at}") for name, at in made.items()})
            kept = {} if replace else entry.get("tables", {})
            return self.log.commit(after, {"tables": kept | made, "epochs": epochs | ({sink: epoch} if sink is not None else {})})
        except Exception:
            for at in made.values():
                self.files.delete(f"{self.root}/tables/{at}")
            raise

    def sink(self, name: str, change: Callable[[dict[str, DataFrame], DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` sink: ``change(library, batch)`` gives the tables that the batch changes, committed once an epoch."""

        def run(batch: DataFrame, epoch: int) -> None:
            last, entry = self.log.latest()
            if entry.get("epochs", {}).get(name, -1) < epoch:
                self.commit(change(self.read(last), batch), last, name, epoch)

        return run

    def restore(self, version: int) -> int:
        """Makes the tables of an earlier version the last ones again."""
        last, entry = self.log.latest()
        return self.log.commit(last, entry | {"tables": self._tables(version)})

    def vacuum(self, keep: int = 5) -> list[str]:
        """Deletes tables that none of the last ``keep`` versions names."""
        used = {at for n in self.log.versions()[-keep:] for at in self._tables(n).values()}
        gone = [at for at in self.files.names(f"{self.root}/tables") if at not in used]
        for at in gone:
            self.files.delete(f"{self.root}/tables/{at}")
        return gone

    def export(self, target: str) -> None:
        """A consistent copy of the last version; an existing target is refused."""
        if Files(self.spark, target).exists(target):
            raise Conflict(f"{target} exists")
        for name, df in self.read().items():
            df.write.mode("errorifexists").parquet(f"{target}/{name}")

    def _exported(self, source: str) -> dict[str, DataFrame]:
        names = [n for n in Files(self.spark, source).names(source) if not n.startswith((".", "_"))]
        return {n: self.spark.read.parquet(f"{source}/{n}") for n in names if Files(self.spark, source).names(f"{source}/{n}")}

    def validate(self, source: str) -> int:
        """Number of documents of an exported library."""
        if REQUIRED not in Files(self.spark, source).names(source):
            raise ValueError(f"{source} is no library: it has no {REQUIRED}")
        return checked({REQUIRED: self.spark.read.parquet(f"{source}/{REQUIRED}")})

    def load(self, source: str) -> int:
        """Makes an exported library the last version.  It is checked before and as it was written here; a library that fails leaves this one as it was,
        and the version before can be restored."""
        self.validate(source)
        return self.commit(self._exported(source), check=checked, replace=True)


# ---------------------------------------------------------------- bundles of one collection


def manifest(collection: DataFrame, members: DataFrame, docs: DataFrame, tags: DataFrame) -> DataFrame:
    """(name, manifest): one JSON document; names that collide get the document's id in front."""
    t = tags.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tag", "source"))).alias("tags"))
    d = members.join(docs.withColumnRenamed("id", "doc_id"), "doc_id").join(t, "doc_id", "left")
    nth = F.row_number().over(Window.partitionBy("collection_id", "file").orderBy("doc_id"))
    d = d.withColumn("file", basename(F.col("path"))).withColumn(
        "file", F.when(nth > 1, F.concat(F.col("doc_id").cast("string"), F.lit("-"), "file")).otherwise(F.col("file"))
    )
    entry = F.struct("doc_id", "file", "title", "category", "kind", F.coalesce("tags", F.array().cast("array<struct<tag:string,source:string>>")).alias("tags"))
    rows = d.groupBy("collection_id").agg(F.array_sort(F.collect_list(entry)).alias("documents"))
    out = collection.join(rows, F.col("id") == F.col("collection_id"), "left")
    return out.select("id", "name", slugified(F.col("name")).alias("slug"), F.to_json(F.struct("name", "documents")).alias("manifest"))


ENTRY = "struct<name:string,documents:array<struct<doc_id:long,file:string,title:string,category:string,kind:string,tags:array<struct<tag:string,source:string>>>>>"


def parsed(manifests: DataFrame) -> DataFrame:
    """(name, doc_id, file, title, category, kind, tags): files by their last path part only."""
    m = manifests.select(F.from_json("manifest", ENTRY).alias("m")).select("m.name", F.explode("m.documents").alias("d"))
    return m.select("name", "d.*").withColumn("file", basename(F.regexp_replace("file", r"\\", "/")))


def write_bundle(path: str, name: str, manifest_json: str, files: dict[str, str]) -> list[str]:
    """Zip of a manifest and its files (entry -> source path); vanished files are listed without payload."""
    if Path(path).exists():
        raise Conflict(f"{path} exists")
    gone = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps({"name": name} | json.loads(manifest_json)))
        for entry, source in files.items():
            if os.path.exists(source):
                z.write(source, f"files/{os.path.basename(entry)}")
            else:
                gone.append(entry)
    return gone


def read_bundle(path: str, target: str) -> dict:
    """Extracts the files of a bundle by their last path part and returns its manifest."""
    os.makedirs(target, exist_ok=True)
    with zipfile.ZipFile(path) as z:
        for n in z.namelist():
            if n.startswith("files/") and (base := os.path.basename(n)):
                (Path(target) / base).write_bytes(z.read(n))
        return json.loads(z.read("manifest.json"))


def unique_dir(base: str) -> str:
    """``base``, or the first of ``base-2`` to ``base-999`` that does not exist."""
    for n in range(1, 1000):
        if not os.path.exists(p := base if n == 1 else f"{base}-{n}"):
            return p
    raise Conflict(f"no free name for {base}")


def extracted(entries: DataFrame, target: str) -> DataFrame:
    """``entries`` with ``path``: where a bundle's files are put, a folder for each collection."""
    return entries.withColumn("path", F.concat(F.lit(target.rstrip("/") + "/"), slugified(F.col("name")), F.lit("/"), F.col("file")))


def imported(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Documents after an import: title, kind and category of the bundle, the last two as pins.

    ``entries``: those of ``extracted``; a document takes the entry of its own path, so that equal file names elsewhere stay as they are.
    """
    e = entries.groupBy(F.col("path").alias("_path")).agg(*(F.max_by(c, "doc_id").alias(f"_{c}") for c in ("title", "kind", "category")))
    d = docs.join(e, docs["path"] == e["_path"], "left")
    return d.withColumns(
        {
            "title": F.coalesce(F.nullif("_title", F.lit("")), "title"),
            "kind": F.coalesce(F.nullif("_kind", F.lit("")), "kind"),
            "category": F.coalesce(F.nullif("_category", F.lit("")), "category"),
            "kind_user": F.coalesce(F.nullif("_kind", F.lit("")), F.lit("")) != "",
            "category_user": F.coalesce(F.nullif("_category", F.lit("")), F.lit("")) != "",
        }
    ).drop("_path", "_title", "_kind", "_category")


def imported_members(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, doc_id) of the collections that an import makes, each document once."""
    return entries.select("name", "path").join(docs.select(F.col("id").alias("doc_id"), "path"), "path").select("name", "doc_id").distinct()
