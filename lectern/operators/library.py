"""The library: named tables derived from the supplied ones, and the vocabulary.

A library is a dict of DataFrames; operators are functions from tables to tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

CHUNK_CHARS = 6000
#: Chunk ids of a document: no text has more slices of at least 2048 characters (Spark's strings end at 2 GB).
IDS_PER_DOCUMENT = 1 << 20
#: Default controlled vocabulary: tag names.
VOCABULARY = (
    "artificial-intelligence philosophy epistemology logic mathematics computer-science cryptography history biography "
    "literary-criticism fiction poetry economics politics sociology psychology cognitive-science linguistics natural-science "
    "engineering reference high-quality"
).split()

DOCUMENT_COLUMNS = ("id", "path", "sha256", "title", "category", "status", "kind", "text")


def sliced(text, size: int = CHUNK_CHARS):
    """Array of consecutive slices of a text; one empty slice for an empty text."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "error").otherwise("ingested")
    kind = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, "").when(F.col("doc_id") % 5 == 2, "paper").otherwise("book")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/lib/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.sha2("text", 256).alias("sha256"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.concat_ws("/", "lang", "source").alias("category"),
        status.alias("status"), kind.alias("kind"), "text",
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    a = lab.where("quality = 1").select("doc_id", F.lit("high-quality").alias("tag"), F.lit("vocab").alias("source"))
    b = lab.where("toxic = 1").select("doc_id", F.lit("toxic").alias("tag"), F.lit("suggested").alias("source"))
    c = d.select("doc_id", F.concat(F.lit("lang-"), "lang").alias("tag"), F.lit("manual").alias("source"))
    return a.unionByName(b).unionByName(c)


def chunks(spark: SparkSession, sf_dir: str, size: int = CHUNK_CHARS) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(sliced(F.col("text"), size)).alias("seq", "text")).select(
        (F.col("doc_id") * IDS_PER_DOCUMENT + F.col("seq")).alias("id"), "doc_id", "seq", "text"
    )


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source").distinct()
    return d.select(F.substring("source", 4, 9).cast("long").alias("id"), F.col("source").alias("name"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 3 = 0 AND source <> 'src1'")
    return d.select(F.substring("source", 4, 9).cast("long").alias("collection_id"), "doc_id")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content")
    )


def library(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {f.__name__: f(spark, sf_dir) for f in (documents, tags, chunks, collections, members, messages)}


#: The same derivations for DuckDB, to put before an oracle's SELECT.
SQL = """
WITH docs AS (
  SELECT doc_id AS id, '/lib/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, sha256(text) AS sha256,
         split_part(text, chr(10), 1) AS title, lang || '/' || source AS category,
         CASE quality WHEN 1 THEN 'done' WHEN 0 THEN 'error' ELSE 'ingested' END AS status,
         CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'paper' ELSE 'book' END AS kind, text
  FROM documents LEFT JOIN labels USING (doc_id)),
tags AS (
  SELECT doc_id, 'high-quality' AS tag, 'vocab' AS source FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 'toxic', 'suggested' FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, 'lang-' || lang, 'manual' FROM documents),
chunks AS (
  SELECT doc_id * 1048576 + seq AS id, doc_id, seq::INT AS seq, substr(text, (seq * 6000 + 1)::INT, 6000) AS text
  FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 6000.0)::BIGINT))) AS seq FROM documents)),
collections AS (SELECT DISTINCT substr(source, 4)::BIGINT AS id, source AS name FROM documents),
members AS (SELECT substr(source, 4)::BIGINT AS collection_id, doc_id FROM documents WHERE doc_id % 3 = 0 AND source <> 'src1'),
messages AS (SELECT conv_id AS session_id, turn AS id, role, text AS content FROM conversations)
"""
