"""Training corpus from ``documents`` in five stages, each calling one operator of ``lectern.llm``.

A stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again
as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, language_id, mixing, secret_scan, simhash
from lectern.llm.common import prepare
from lectern.session import shared_folder

#: A document stays if its best language has at least this posterior.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no language more likely than the others together, go."""
    prepare(spark)
    model = language_id.train(docs.where(~language_id.held_out()))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    judged = language_id.identified(docs.select(whole.alias("doc"), "text"), model)
    sure = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return judged.where(sure).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8) the document with the smallest id stays."""
    prepare(spark)
    return simhash.without_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans that look like secrets are masked, and n_chars follows the text."""
    prepare(spark)
    table = secret_scan.train(secret_scan.samples(spark))
    out = secret_scan.redacted(docs, table)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    prepare(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the ids and of the decoded text, one row per row of ``docs``."""
    prepare(spark)
    return bpe.digested(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL expresses neither the language model nor the encoder; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the session's shared folder."""
    prepare(spark)
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
