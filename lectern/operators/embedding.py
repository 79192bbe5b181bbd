"""Vectors of chunks, made in committed rounds that a stopped run resumes after.

What is pending - no vector of this vector space for the chunk's present text - is cut into rounds by id.  A round is embedded in
parallel, in calls of a bounded number of texts, written, and committed to a log; cancelling or a failing backend
leaves all finished rounds in place, and the next run asks for the rest only.  Another vector space starts an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed, within_budget
from ..session import ship
from ..sources.versions import VersionLog

#: Texts in one call of the backend, tokens that a text may have, and chunks of a round.
BATCH, MAX_TOKENS, ROUND_ROWS = 32, 1500, 100_000
VECTORS = "id long, digest long, embedding array<float>"

Embedder = Callable[[list[str]], list[list[float]]]


def identity(provider: str, url: str, model: str, prefix: str = "") -> str:
    """What a vector space depends on."""
    return f"{provider}@{url}/{model}" + ("|pfx" if prefix else "")


def called(embedder: Embedder, batch: int):
    """Rows (id, digest, text) to (id, digest, embedding), ``batch`` texts a call whatever the size of Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def embedded(rows: pd.DataFrame) -> pd.DataFrame:
            vectors = embedder(rows["text"].tolist())
            if len(vectors) != len(rows):
                raise ValueError(f"{len(vectors)} vectors for {len(rows)} texts")
            return pd.DataFrame({"id": rows["id"], "digest": rows["digest"], "embedding": [list(map(float, v)) for v in vectors]})

        for b in batches:
            held = b if held is None or not len(held) else pd.concat([held, b], ignore_index=True)
            whole = len(held) // batch * batch
            for at in range(0, whole, batch):
                yield embedded(held.iloc[at : at + batch])
            held = held.iloc[whole:]
        if held is not None and len(held):
            yield embedded(held)

    return run


class Vectors:
    """A table of vectors below ``root``, for one vector space at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = VersionLog(spark, f"{self.root}/log")

    def _rounds(self, rounds: list[str]) -> DataFrame:
        if not rounds:
            return self.spark.createDataFrame([], VECTORS)
        return self.spark.read.schema(VECTORS).parquet(*(f"{self.root}/rounds/{r}" for r in rounds))

    def read(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` with ``embedding``, null where the present text has none yet."""
        v = self._rounds(self.log.latest()[1].get("rounds", [])).withColumnsRenamed({"id": "_id", "digest": "_digest"})
        d = chunks.drop("embedding").withColumn("_now", F.xxhash64("text"))
        d = d.join(v, (F.col("id") == F.col("_id")) & (F.col("_now") == F.col("_digest")), "left")
        return d.drop("_id", "_digest", "_now")

    def pending(self, chunks: DataFrame) -> DataFrame:
        """(id, digest, text) of chunks without a vector; one row an id and text."""
        have = self._rounds(self.log.latest()[1].get("rounds", [])).select("id", "digest")
        now = chunks.select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("digest"), "text")
        return now.join(have, ["id", "digest"], "left_anti").dropDuplicates(["id", "digest"])

    def embed(
        self,
        chunks: DataFrame,
        embedder: Embedder,
        space: str,
        prefix: str = "",
        cancelled: Callable[[], bool] = lambda: False,
        batch: int = BATCH,
        max_tokens: int = MAX_TOKENS,
        round_rows: int = ROUND_ROWS,
    ) -> int:
        """Makes vectors for what is pending, lowest ids first; returns how many chunks were embedded before it was done or cancelled.

        The pending texts are laid out once by round, so that a round reads its own rows only.
        """
        ship(self.spark)
        version, entry = self.log.latest()
        if entry.get("space") != space:
            entry = {"space": space, "rounds": []}
            version = self.log.commit(version, entry)
        todo = self.pending(chunks)
        n, low = todo.agg(F.count("*"), F.min("id")).first()
        if not n or cancelled():
            return 0
        rounds = -(-n // round_rows)
        bounds = todo.agg(F.percentile_approx("id", [k / rounds for k in range(1, rounds)], 10_000)).first()[0] if rounds > 1 else []
        nth = sum((F.when(F.col("id") > b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
        text = F.when(trimmed(F.coalesce("text", F.lit(""))) == "", " ").otherwise(F.concat(F.lit(prefix), within_budget(F.col("text"), max_tokens)))
        laid = f"{self.root}/pending-{uuid.uuid4().hex}"
        todo.select("id", "digest", text.alias("text"), nth.alias("round")).repartition("round").write.partitionBy("round").parquet(laid)
        done = 0
        try:
            for k in range(len(set(bounds)) + 1):
                if cancelled():
                    break
                name = uuid.uuid4().hex
                rows = self.spark.read.parquet(laid).where(F.col("round") == k).select("id", "digest", "text")
                rows.mapInPandas(called(embedder, batch), VECTORS).write.parquet(f"{self.root}/rounds/{name}")
                entry = entry | {"rounds": [*entry["rounds"], name]}
                version = self.log.commit(version, entry)
                done += self._rounds([name]).count()
        finally:
            self.log.files.delete(laid)
        return done
