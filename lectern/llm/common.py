"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship

#: White space between words: the six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Rows of a few columns that fill a file of a checkpoint.
ROWS_PER_FILE = 1_000_000
_holder: list = []


def hold(owner: str, release) -> None:
    """A Python worker keeps the tables of one operator: when another one starts, ``release`` of the last is called."""
    if _holder and _holder[0][0] != owner:
        _holder.pop()[1]()
    if not _holder:
        _holder.append((owner, release))


#: Rows read or sent to Python at once where rows hold whole texts: (setting, Spark's default for short rows, rows).
WIDE_ROWS = (
    ("spark.sql.parquet.columnarReaderBatchSize", "4096", "256"),
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "3000"),
)


def prepare(spark: SparkSession) -> None:
    """Ships the package, and bounds batches of whole texts unless the session has its own bounds."""
    ship(spark)
    for name, default, rows in WIDE_ROWS:
        if spark.conf.get(name) == default:
            spark.conf.set(name, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage in the shared folder.

    ``rows``: there are as many at most, so that a small table is not written as one tiny file per shuffle partition.
    """
    shared_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(-(-max(1, rows) // ROWS_PER_FILE))
    return df.checkpoint(eager=True)


def wrapped(docs: DataFrame, text: str, keep: bool = True) -> DataFrame:
    """Each row as one struct ``_doc`` beside ``_text``, so that no column of theirs meets one of ours; ``keep``: with the text in it."""
    inside = [c for c in docs.columns if keep or c != text] or docs.columns
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in inside)).alias("_doc"), F.col(f"`{text}`").alias("_text"))


def unwrapped(d: DataFrame, docs: DataFrame, results, without=()) -> DataFrame:
    """The columns that ``docs`` had, except those called like a result or listed in ``without``, then the results."""
    kept = [c for c in docs.columns if c not in {*results, *without}]
    return d.select(*(F.col("_doc").getField(c).alias(c) for c in kept), *results)


def words_of(text: Column) -> Column:
    """The maximal runs of non-blank characters, in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))
