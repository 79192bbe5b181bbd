"""A keyword index that follows its table: immutable segments, tombstones and a versioned manifest.

A segment holds the postings of some chunks and a row for each chunk (digest of its text, number of tokens).
Nothing is shuffled for it: each task makes the postings of its own chunks and writes them in runs in order of (term, chunk_id), so every file is
an index of some chunks, and a word is a few pages of each run.  A run is sorted in a Python worker's memory and a file holds as many as its task
needs, so a task of any size spills nothing.  A chunk that is edited or deleted gets a tombstone in its segment, and its new
text goes to a new segment.  The manifest lists segments with their counts, so
statistics of all living chunks need no scan, and every change is one commit: readers stay on the version they
opened, and of two writers one is refused.  Merging rewrites postings, without texts, when segments are many or half dead.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import VersionLog
from .search import INDEX_ROW_GROUP, POSTINGS, grouped, in_runs, tokens

#: More segments than this are merged, the smallest first; so is a segment with a larger share of dead chunks than DEAD.
MOST_SEGMENTS, DEAD = 8, 0.3
#: Up to so many dead chunks of a segment are sent to all tasks (about 40 bytes each), so that its postings stay where they are; more are joined by a shuffle.
DEAD_SENT = 2_000_000
CHUNKS = "chunk_id long, digest long, n_tokens int"
TOMBSTONES = "segment string, chunk_id long"


class KeywordIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = VersionLog(spark, f"{self.root}/manifest")

    # ------------------------------------------------------------ reading

    def manifest(self) -> tuple[int, dict]:
        n, m = self.log.latest()
        return n, m or {"segments": [], "stamp": None}

    def _segment(self, name: str, part: str) -> DataFrame:
        d = self.spark.read.schema(CHUNKS if part == "chunks" else POSTINGS).parquet(f"{self.root}/segments/{name}/{part}")
        return d.withColumn("segment", F.lit(name))

    def _living(self, segments: list[dict], part: str) -> DataFrame:
        """Rows of the segments that no tombstone names; conditions on ``term`` reach the files."""
        clean = []
        for s in segments:
            rows = self._segment(s["name"], part)
            if s["tombstones"]:
                dead = self.spark.read.schema(TOMBSTONES).parquet(*(f"{self.root}/tombstones/{t}" for t in s["tombstones"]))
                dead = dead.where(F.col("segment") == s["name"]).select("chunk_id")
                rows = rows.join(F.broadcast(dead) if s["dead_chunks"] <= DEAD_SENT else dead, "chunk_id", "left_anti").select(*rows.columns)
            clean.append(rows)
        if not clean:
            return self.spark.createDataFrame([], f"{CHUNKS if part == 'chunks' else POSTINGS}, segment string")
        return reduce(DataFrame.unionByName, clean)

    def read(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(postings, statistics) as ``search.ranked`` takes them, of the latest or an earlier version."""
        m = self.log.entry(version) if version else self.manifest()[1]
        n = sum(s["n_chunks"] - s["dead_chunks"] for s in m["segments"])
        total = sum(s["n_tokens"] - s["dead_tokens"] for s in m["segments"])
        stats = self.spark.createDataFrame([(n, total / n if n else None)], "n_chunks long, mean double")
        return self._living(m["segments"], "postings").drop("segment"), stats

    # ------------------------------------------------------------ writing

    def _write(self, name: str, chunks: DataFrame, postings: DataFrame) -> dict | None:
        """``postings``: in runs in order."""
        at = f"{self.root}/segments/{name}"
        chunks.select("chunk_id", "digest", "n_tokens").write.parquet(f"{at}/chunks")
        n, total = self._segment(name, "chunks").agg(F.count("*"), F.sum("n_tokens")).first()
        if not n:
            self.log.files.delete(at)
            return None
        postings.write.option("parquet.block.size", INDEX_ROW_GROUP).option("compression", "zstd").parquet(f"{at}/postings")
        return {"name": name, "n_chunks": n, "n_tokens": total, "dead_chunks": 0, "dead_tokens": 0, "tombstones": []}

    def _new_segment(self, chunks: DataFrame) -> dict | None:
        t = chunks.select(F.col("id").cast("long").alias("chunk_id"), F.xxhash64("text").alias("digest"), tokens(F.coalesce("text", F.lit(""))).alias("t"))
        t = t.withColumn("n_tokens", F.size("t"))
        return self._write(uuid.uuid4().hex, t, grouped(t))

    def _bury(self, segments: list[dict], ids: DataFrame) -> list[dict]:
        """The segments with tombstones for the living chunks among ``ids``."""
        name = uuid.uuid4().hex
        gone = self._living(segments, "chunks").join(ids, "chunk_id", "left_semi")
        gone.select("segment", "chunk_id", "n_tokens").write.parquet(f"{self.root}/tombstones/{name}")
        counts = self.spark.read.parquet(f"{self.root}/tombstones/{name}").groupBy("segment").agg(F.count("*"), F.sum("n_tokens")).collect()
        dead = {r[0]: (r[1], r[2]) for r in counts}  # a row for each segment
        if not dead:
            self.log.files.delete(f"{self.root}/tombstones/{name}")
        return [
            s | {"dead_chunks": s["dead_chunks"] + dead[s["name"]][0], "dead_tokens": s["dead_tokens"] + dead[s["name"]][1], "tombstones": [*s["tombstones"], name]}
            if s["name"] in dead else s
            for s in segments
        ]

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, stamp=None) -> int:
        """Inserts and edits (id, text; one row an id) and deletes (id) as one commit; returns the version."""
        version, m = self.manifest()
        ids = [d.select(F.col("id").cast("long").alias("chunk_id")) for d in (upserts, deletes) if d is not None]
        segments = m["segments"]
        if ids and segments:
            both = ids[0] if len(ids) == 1 else ids[0].union(ids[1])
            segments = self._bury(segments, both.distinct())
        if upserts is not None and (new := self._new_segment(upserts)):
            segments = [*segments, new]
        segments = [s for s in segments if s["dead_chunks"] < s["n_chunks"]]
        return self.log.commit(version, {"segments": segments, "stamp": stamp if stamp is not None else m["stamp"]})

    def changes(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(upserts, deletes) that bring the index to the table: chunks are compared by digest, texts move for changed ones only."""
        now = chunks.select(F.col("id").cast("long").alias("chunk_id"), F.xxhash64("text").alias("digest"))
        known = self._living(self.manifest()[1]["segments"], "chunks").select("chunk_id", "digest")
        fresh = now.join(known, ["chunk_id", "digest"], "left_anti").select(F.col("chunk_id").alias("id"))
        gone = known.join(now, "chunk_id", "left_anti").select(F.col("chunk_id").alias("id"))
        return chunks.select("id", "text").join(fresh, "id", "left_semi"), gone

    def refresh(self, chunks: DataFrame, stamp=None) -> int:
        """Follows the table.  With the stamp of the last refresh nothing is read; a table without changes makes no version."""
        version, m = self.manifest()
        if version and stamp is not None and m["stamp"] == stamp:
            return version
        if not version:
            return self.apply(chunks.select("id", "text"), stamp=stamp)
        upserts, deletes = self.changes(chunks)
        if stamp is None and upserts.isEmpty() and deletes.isEmpty():
            return version
        return self.apply(upserts, deletes, stamp)

    def merge(self, most: int = MOST_SEGMENTS, dead: float = DEAD) -> int:
        """Rewrites the smallest segments as one while there are more than ``most``, and those with many dead chunks."""
        version, m = self.manifest()
        living = lambda s: s["n_chunks"] - s["dead_chunks"]
        by_size = sorted(m["segments"], key=living)
        old = by_size[: len(by_size) - most + 1] if len(by_size) > most else []
        old += [s for s in by_size if s not in old and s["dead_chunks"] > dead * s["n_chunks"]]
        if not old:
            return version
        new = self._write(uuid.uuid4().hex, self._living(old, "chunks"), in_runs(self._living(old, "postings")))
        return self.log.commit(version, m | {"segments": [s for s in m["segments"] if s not in old] + ([new] if new else [])})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes what none of the last ``keep`` versions names; returns what went."""
        last = [self.log.entry(n) for n in self.log.versions()[-keep:]]
        used = {s["name"] for m in last for s in m["segments"]}, {t for m in last for s in m["segments"] for t in s["tombstones"]}
        gone = []
        for folder, names in zip(("segments", "tombstones"), used):
            for name in self.log.files.names(f"{self.root}/{folder}"):
                if name not in names:
                    self.log.files.delete(f"{self.root}/{folder}/{name}")
                    gone.append(name)
        return gone
