"""Mixing sources to target weights with hash-threshold histograms.

Every document has a uniform 36-bit hash of its key and text.  Sizes are summed by (source, top 12 bits);
the running sum over the 4096 buckets of a source finds the one bucket in which its budget runs
out; only that bucket is cut again by the next 12 bits, and its boundary once more by the last 12.
The nested boundaries form one threshold per source, and taking documents is the row filter
``hash < threshold``: nothing is sorted but histograms of at most 4096 rows per source, and a hot
source is summed before it is shuffled.  A larger budget gives a larger threshold, so the documents
taken at one budget are also taken at every larger one.

A target above a source's size takes the whole source as often as it fits, then the threshold
decides about one more repeat.

Main path: DataFrame expressions only.

Defined results: null text has size 0; null sources are one source, ordered last; documents of size
0 take 0 words; only rows alike in key (also a null one) and text share a hash and so a decision; extra columns
pass through ``mixed``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
LEVELS, BITS = 3, 12
#: One row per source is broadcast up to this many sources (under 2 MB); beyond, AQE joins shuffle.
BROADCAST_SOURCES = 10_000


def key_hash(key: str, text: str) -> Column:
    """36 uniform bits from the key's decimal text and the text, so that rows of one key are decided apart."""
    both = F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def n_words(text: str) -> Column:
    return F.size(words_of(F.col(text))).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share=SHARE, most=MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to (source, source_size): water-filling in closed form.

    With sources in ascending order of cap/weight, the water level is the largest of
    (words to share - caps before) / (weights from here on); a target is the smaller of the cap
    and level * weight.  One row per source, so the two unpartitioned windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*(F.lit(x) for x in weights)), (F.row_number().over(order) - 1) % len(weights))
    d = totals.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    d = d.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "from_here": F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)),
            "share": F.sum("source_size").over(every) * F.lit(float(share)),
        }
    )
    level = F.max((F.col("share") - F.col("before")) / F.col("from_here")).over(every)
    return d.withColumn("level", level).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target")
    )


def plan(slim: DataFrame, weights=WEIGHTS, share=SHARE, most=MAX_REPEATS) -> tuple[DataFrame, bool]:
    """(source, source_size, target, epochs, threshold) for rows (source, h, size), and whether it is small."""
    goal = checkpointed(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    small = (sources := goal.count()) <= BROADCAST_SOURCES
    fit = F.broadcast if small else (lambda x: x)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    at = goal.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    edge = at.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        low = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("h", low)
        inside = slim.where(F.col("size") > 0).join(
            fit(edge), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", low + BITS) == F.col("prefix"))
        )
        bars = inside.groupBy("s", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("s").orderBy("bucket")
        bars = bars.withColumn("upto", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        bars = bars.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
        edge = bars.select("s", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"), F.col("bucket").alias("prefix"), "n")
        edge = checkpointed(edge, rows=sources)
    cut = edge.select("s", (F.col("prefix") + F.when(F.col("rest") * 2 >= F.col("n"), 1).otherwise(0)).alias("threshold"))
    out = at.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "epochs", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold")
    )
    return checkpointed(out, rows=sources), small


def repeats(rows: DataFrame, plan_: DataFrame, small: bool) -> DataFrame:
    """``rows`` (with source and h) plus source_size, target and ``times`` (0 to the most repeats)."""
    p = plan_.select(F.struct(F.col("source").alias("s"), "source_size", "target", "epochs", "threshold").alias("_plan"))
    p = F.broadcast(p) if small else p
    times = F.col("_plan.epochs") + F.when(F.col("h") < F.col("_plan.threshold"), 1).otherwise(0)
    d = rows.join(p, F.col("source").eqNullSafe(F.col("_plan.s")))
    return d.select(*(F.col(c) for c in rows.columns), "_plan.source_size", "_plan.target", times.alias("times"))


def mixed(docs: DataFrame, key="doc_id", text="text", source="source", weights=WEIGHTS, share=SHARE, most=MAX_REPEATS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the columns stay as they were."""
    slim = docs.select(F.col(source).alias("source"), key_hash(key, text).alias("h"), n_words(text).alias("size"))
    plan_, small = plan(checkpointed(slim), weights, share, most)
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source).alias("source"), key_hash(key, text).alias("h"))
    taken = repeats(kept, plan_, small).where(F.col("times") > 0)
    return taken.select("row", F.explode(F.array_repeat(F.lit(True), F.col("times").cast("int"))).alias("_")).select("row.*")


def op5(docs: DataFrame) -> DataFrame:
    slim = checkpointed(docs.select("doc_id", "source", key_hash("doc_id", "text").alias("h"), n_words("text").alias("size")))
    plan_, small = plan(slim)
    return repeats(slim, plan_, small).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times"
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 9))::BIGINT AS h,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM t),
f AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
         - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM w),
g AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, max(lv) OVER () * w) AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
b AS (SELECT source, h, sum(size) AS n FROM d WHERE size > 0 GROUP BY source, h),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM b),
x AS (
  SELECT e.source, c.h + CASE WHEN (e.target - e.epochs * e.source_size - (upto - n)) * 2 >= n THEN 1 ELSE 0 END AS threshold
  FROM e JOIN c ON e.source IS NOT DISTINCT FROM c.source
  WHERE upto > e.target - e.epochs * e.source_size AND upto - n <= e.target - e.epochs * e.source_size)
SELECT doc_id, size, e.source_size, e.target, (size * (epochs + CASE WHEN d.h < coalesce(threshold, 0) THEN 1 ELSE 0 END))::BIGINT AS taken,
       (epochs + CASE WHEN d.h < coalesce(threshold, 0) THEN 1 ELSE 0 END)::BIGINT AS times
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN x ON x.source IS NOT DISTINCT FROM d.source
"""
