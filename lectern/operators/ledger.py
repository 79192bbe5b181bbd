"""Enrichment in stages with a ledger: a row for each document and stage says what went in, what came out, or what went wrong.

A stage runs for documents whose input - the text, the results that the stage needs, and its version - is not in the ledger, or failed
there.  A document whose stage fails stops at it and stays pending; the others go on, and the next run tries it again.  A run over
unchanged documents asks no backend.  Each stage is written and committed before the next one starts, so a run that breaks off
keeps what it has.  Texts move for documents with work only; what goes from stage to stage are digests and results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kinds as K
from ..session import checkpointed
from ..sources.versions import VersionLog
from .enrich import Summarizer, Tagger, fast_summary, first_sentences, mapped, overlapping_tags, summarized, tagged

LEDGER = "id long, input long, result string, error string, run long"


@dataclass(frozen=True)
class Stage:
    """``work`` gets rows (id, text, one column for each of ``needs``) and gives (id, result, error)."""

    name: str
    work: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()
    version: str = "1"


def kind_stage() -> Stage:
    work = lambda d: d.select("id", K.best_kind(K.scores(F.col("text"), F.lit(0), F.lit(0))).alias("result"), F.lit(None).cast("string").alias("error"))
    return Stage("kind", work)


def tag_stage(tag: Tagger = overlapping_tags, vocabulary: tuple[str, ...] = (), most: int = 6, version: str = "1") -> Stage:
    """Tags, category and metadata as one JSON object: one call of the backend for all of them."""

    def work(d: DataFrame) -> DataFrame:
        t = tagged(d, tag, list(vocabulary), most)
        result = F.to_json(F.struct("tags", "other", "title", "authors", "year", "category"))
        return t.select("id", F.when(F.col("error").isNull(), result).alias("result"), "error")

    return Stage("tags", work, version=version)


def summary_stage(summarize: Summarizer = first_sentences, version: str = "1", **sizes) -> Stage:
    """A summary by the rule for the document's kind; the result is a JSON object with its source."""

    def work(d: DataFrame) -> DataFrame:
        made = summarized(d.select("id", "text"), summarize, **sizes).withColumnRenamed("summary", "generated")
        s = fast_summary(F.col("kind"), F.col("text"), F.col("generated"))
        return d.join(made, "id").select("id", F.when(F.col("error").isNull(), F.to_json(s)).alias("result"), "error")

    return Stage("summary", work, ("kind",), version)


def mapped_stage(name: str, work: Callable[[str], str], version: str = "1") -> Stage:
    """A function of the text."""
    return Stage(name, lambda d: mapped(d.select("id", "text"), work).select("id", F.col("summary").alias("result"), "error"), version=version)


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = VersionLog(spark, f"{self.root}/log")

    def rows(self, stage: str) -> DataFrame:
        """All that was ever noted for a stage."""
        parts = self.log.latest()[1].get("stages", {}).get(stage, [])
        if not parts:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*(f"{self.root}/rows/{p}" for p in parts))

    def last(self, stage: str) -> DataFrame:
        """(id, input, result, error): the newest row of each document."""
        row = F.struct("input", "result", "error")
        return self.rows(stage).groupBy("id").agg(F.max_by(row, "run").alias("r")).select("id", "r.*")

    def _note(self, stage: str, made: DataFrame) -> int:
        """Writes and commits the rows of one stage; returns how many there are."""
        version, entry = self.log.latest()
        name = f"{stage}-{uuid.uuid4().hex}"
        made.select("id", "input", "result", "error", F.lit(version).cast("long").alias("run")).write.parquet(f"{self.root}/rows/{name}")
        n = self.spark.read.schema(LEDGER).parquet(f"{self.root}/rows/{name}").count()
        if not n:
            self.log.files.delete(f"{self.root}/rows/{name}")
            return 0
        stages = entry.get("stages", {})
        self.log.commit(version, entry | {"stages": stages | {stage: [*stages.get(stage, []), name]}})
        return n

    def run(self, docs: DataFrame, stages: list[Stage], cancelled: Callable[[], bool] = lambda: False) -> dict[str, int]:
        """Brings all documents (id, text) through the stages; returns for how many each one did any work."""
        did = {}
        state = docs.select("id", F.xxhash64("text").alias("_text"))
        for stage in stages:
            if cancelled():
                break
            needs = list(stage.needs)
            now = state.withColumn("input", F.xxhash64("_text", F.lit(f"{stage.name}@{stage.version}"), *needs))
            known = self.last(stage.name).where("error IS NULL").select("id", "input", F.lit(True).alias("_known"))
            todo = checkpointed(now.join(known, ["id", "input"], "left").where("_known IS NULL").select("id", "input", *needs))
            work = stage.work(docs.select("id", "text").join(todo.select("id", *needs), "id"))
            did[stage.name] = self._note(stage.name, work.select("id", "result", "error").join(todo.select("id", "input"), "id"))
            good = self.last(stage.name).where("error IS NULL").select("id", "input", F.col("result").alias(stage.name))
            state = now.join(good, ["id", "input"]).drop("input")
        return did

    def results(self, docs: DataFrame, stages: list[Stage]) -> DataFrame:
        """(id, one column for each stage, status, failed, error): ``done`` if every stage has a result for the present text."""
        d = docs.select("id", F.xxhash64("text").alias("_text"))
        stopped, error = F.lit(None).cast("string"), F.lit(None).cast("string")
        for s in stages:
            d = d.withColumn("_input", F.xxhash64("_text", F.lit(f"{s.name}@{s.version}"), *s.needs))
            row = self.last(s.name).select("id", F.col("input").alias("_input"), F.col("result").alias(s.name), F.col("error").alias(f"_e_{s.name}"), F.lit(True).alias(f"_k_{s.name}"))
            d = d.join(row, ["id", "_input"], "left").drop("_input")
            open_ = F.col(f"_k_{s.name}").isNull() | F.col(f"_e_{s.name}").isNotNull()
            stopped, error = F.coalesce(stopped, F.when(open_, F.lit(s.name))), F.coalesce(error, F.col(f"_e_{s.name}"))
        status = F.when(stopped.isNull(), "done").otherwise("ingested")
        return d.select("id", *(s.name for s in stages), status.alias("status"), stopped.alias("failed"), error.alias("error"))
