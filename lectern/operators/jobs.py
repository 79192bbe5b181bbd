"""Jobs, repairs and small row operators around the library."""

from __future__ import annotations

import itertools
import threading
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FINISHED_KEPT = 40


class Jobs:
    """First-in-first-out jobs on one session: one at a time, cancellable, with a bounded history."""

    def __init__(self, spark: SparkSession):
        self.spark, self.history, self.turn = spark, deque(), threading.Lock()
        self.numbers = itertools.count(1)

    def run(self, name: str, work: Callable[[], object]) -> dict:
        job = {"id": next(self.numbers), "name": name, "status": "queued", "error": None}
        self.history.append(job)
        with self.turn:
            if job["status"] == "cancelled":
                return job
            job["status"] = "running"
            self.spark.sparkContext.setJobGroup(f"job-{job['id']}", name, interruptOnCancel=True)
            try:
                job["result"] = work()
                job["status"] = "done"
            except Exception as e:  # the queue goes on with the next job
                job["status"] = "cancelled" if job["status"] == "cancelling" else "failed"
                job["error"] = str(e)
        done = [j for j in self.history if j["status"] in ("done", "failed", "cancelled")]
        for old in done[: max(0, len(done) - FINISHED_KEPT)]:
            self.history.remove(old)
        return job

    def cancel(self, number: int) -> bool:
        """A queued job never starts; a running one is interrupted between its Spark tasks."""
        for job in self.history:
            if job["id"] == number and job["status"] == "queued":
                job["status"] = "cancelled"
                return True
            if job["id"] == number and job["status"] == "running":
                job["status"] = "cancelling"
                self.spark.sparkContext.cancelJobGroup(f"job-{number}")
                return True
        return False


def between(df: DataFrame, order: list[Column], first: int, last: int) -> DataFrame:
    """Rows from one id to another in list order, both included, whichever comes first."""
    ends = df.where(F.col("id").isin(first, last)).agg(F.min(F.struct(*order)).alias("a"), F.max(F.struct(*order)).alias("b")).first()
    if ends["a"] is None:
        return df.limit(0)
    key = F.struct(*order)
    lit = lambda r: F.struct(*(F.lit(v).alias(k) for k, v in r.asDict().items()))
    return df.where((key >= lit(ends["a"])) & (key <= lit(ends["b"])))


def containing(df: DataFrame, label: Column, part: str, most: int = 40) -> DataFrame:
    """Rows whose label holds the part, whatever its case."""
    return df.where(F.lower(label).contains(part.lower())).orderBy(label, "id").limit(most)


def reextracted(docs: DataFrame, chunks: DataFrame, repaired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired pages (doc_id, page_no, text) replace those of the same number; their documents are pending again."""
    r = repaired.select("doc_id", "page_no", F.col("text").alias("_new"))
    c = chunks.join(r, ["doc_id", "page_no"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")
    if "embedding" in c.columns:
        touched = repaired.select("doc_id", "page_no", F.lit(True).alias("_t"))
        c = c.join(touched, ["doc_id", "page_no"], "left").withColumn("embedding", F.when(F.col("_t").isNull(), F.col("embedding"))).drop("_t")
    ids = repaired.select(F.col("doc_id").alias("id")).distinct().withColumn("_again", F.lit(True))
    d = docs.join(ids, "id", "left").withColumn("status", F.when(F.col("_again"), "ingested").otherwise(F.col("status"))).drop("_again")
    return d, c


def regenerated(docs: DataFrame, results: DataFrame, fields: list[str]) -> DataFrame:
    """New values for the asked fields only; metadata fill gaps, a new category lifts its pin."""
    cols = [c for f, c in (("meta", "title"), ("meta", "authors"), ("meta", "year"), ("summary", "summary"), ("category", "category")) if f in fields and c in results.columns]
    r = results.select("id", *(F.col(c).alias(f"_{c}") for c in cols))
    d = docs.join(r, "id", "left")
    for c in cols:
        old, new = F.col(c), F.col(f"_{c}")
        gap = c in ("title", "authors", "year")
        d = d.withColumn(c, F.coalesce(F.nullif(old, F.lit("")), new) if gap else F.coalesce(F.nullif(new, F.lit("")), old))
        if c == "category" and "category_user" in docs.columns:
            d = d.withColumn("category_user", F.col("category_user") & (F.coalesce(new, F.lit("")) == ""))
    return d.drop(*(f"_{c}" for c in cols))


def to_blob():
    """UDF: float array to little-endian 32-bit bytes."""

    @F.pandas_udf("binary")
    def f(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())

    return f


def from_blob():
    """UDF: little-endian 32-bit bytes to float array; a broken blob is null."""

    @F.pandas_udf("array<float>")
    def f(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(bytes(x), dtype="<f4"))

    return f


def ranked_groups(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, numbered from 1 as ``nth``."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= most)
