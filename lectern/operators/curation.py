"""Aggregates, joins and filters over a library's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overview(lib: dict[str, DataFrame], embedded: DataFrame, vocabulary: list[str]) -> DataFrame:
    """One row of counts; each table is counted in one pass."""
    d = lib["documents"].agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "ingested").alias("pending"), F.count_if(F.col("status") == "error").alias("errors"),
    )
    parts = [
        d, lib["chunks"].agg(F.count("*").alias("chunks")), embedded.agg(F.count_if(F.col("embedding").isNotNull()).alias("embedded")),
        lib["collections"].agg(F.count("*").alias("collections")), lib["messages"].agg(F.count_distinct("session_id").alias("chats")),
    ]
    one = [p.withColumn("_k", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "_k"), one).drop("_k").withColumn("vocab", F.lit(len(vocabulary)).cast("long"))


def or_none(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("(none)"))


def counted(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def top_tags(tags: DataFrame, k: int = 60) -> DataFrame:
    return counted(tags, F.col("tag"), "tag").orderBy(F.col("n").desc(), "tag").limit(k)


def tag_cloud(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Vocabulary, applied and suggested tags: documents, flags, and weight 0.85 + 1.5 * sqrt(n / max)."""
    used = tags.groupBy("tag").agg(F.count_distinct("doc_id").alias("docs"), F.bool_or(F.col("source") == "suggested").alias("s"))
    d = vocabulary.select("tag", F.lit(True).alias("v")).join(used, "tag", "full").select(
        "tag", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("v", F.lit(False)).alias("in_vocab"),
        (F.coalesce("s", F.lit(False)) & F.col("v").isNull()).alias("suggested"),
    )
    d = d.join(F.broadcast(d.agg(F.max("docs").alias("top"))))  # one row
    return d.withColumn("weight", F.round(0.85 + 1.5 * F.sqrt(F.col("docs") / F.greatest(F.lit(1), "top")), 2)).drop("top")


def suggestions(tags: DataFrame, docs: DataFrame) -> DataFrame:
    s = tags.where("source = 'suggested'").join(docs.select(F.col("id").alias("doc_id"), "title"), "doc_id")
    return s.groupBy("tag").agg(F.count("*").alias("n"), F.min("title").alias("example"))


def category_tree(docs: DataFrame) -> DataFrame:
    """Every node of the shelf tree: documents of its own and of its subtree."""
    own = docs.groupBy("category").agg(F.count("*").alias("n"))
    parts = F.filter(F.split("category", "/"), lambda p: p != "")
    nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    d = own.where(F.size(parts) > 0).select("n", F.array_join(parts, "/").alias("full"), F.explode(nodes).alias("node"))
    return d.groupBy("node").agg(F.sum(F.when(F.col("node") == F.col("full"), F.col("n")).otherwise(0)).alias("own"), F.sum("n").alias("total"))


def bar_percent(counts: DataFrame) -> DataFrame:
    top = counts.agg(F.max("n").alias("_top"))  # one row
    return counts.join(F.broadcast(top)).withColumn("pct", F.round(100 * F.col("n") / F.col("_top"), 1)).drop("_top")


def collection_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    n = members.groupBy("collection_id").agg(F.count("*").alias("n"))
    return collections.join(n, collections["id"] == n["collection_id"], "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n_docs"))


def with_all_tags(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """(doc_id) of documents that carry every wanted tag (relational division; repeated tags count once)."""
    want = sorted(set(wanted))
    d = tags.where(F.col("tag").isin(want)).groupBy("doc_id").agg(F.count_distinct("tag").alias("n"))
    return d.where(F.col("n") == len(want)).select("doc_id")


def tag_lists(docs: DataFrame, tags: DataFrame) -> DataFrame:
    t = tags.groupBy("doc_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return docs.join(t.withColumnRenamed("doc_id", "id"), "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def matches(kind: str | None = None, category: str | None = None, tags: list[str] = ()) -> Column:
    """Filter on kind and category (whatever their case) and all tags, for rows with a ``tags`` array."""
    out = F.lit(True)
    if kind:
        out = out & (F.lower("kind") == kind.lower())
    if category:
        out = out & (F.lower("category") == category.lower())
    low = F.transform("tags", lambda t: F.lower(t))
    for t in tags:
        out = out & F.array_contains(low, t.lower())
    return out


def in_subtree(category: Column, root: str) -> Column:
    return (category == root) | category.startswith(root + "/")


def under(path: Column, directory: Column) -> Column:
    return (path == directory) | path.startswith(F.concat(directory, F.lit("/")))


def folder_stats(docs: DataFrame, dirs: DataFrame) -> DataFrame:
    """Documents and pending ones below each directory: ancestors of a path are exploded, then an equi-join."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    d = docs.select("status", F.explode(above).alias("dir")).groupBy("dir").agg(
        F.count("*").alias("docs"), F.count_if(F.col("status") == "ingested").alias("pending")
    )
    return dirs.join(d, "dir", "left").select("dir", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("pending", F.lit(0)).alias("pending"))


def reassembled(chunks: DataFrame, skip: DataFrame | None = None, pages_of=None) -> DataFrame:
    """(doc_id, text): chunks in order, joined by paragraph breaks, without skipped pages."""
    c = chunks
    if skip is not None:
        c = c.join(skip, "doc_id", "left").where(~F.coalesce(F.array_contains("skip", F.col("page_no")), F.lit(False)))
    rows = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return c.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n").alias("text"))


def newest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def islands(df: DataFrame, part: str, order: str, same: str) -> DataFrame:
    """Runs of equal ``same`` along ``order``: numbered from 0 as ``island``."""
    w = Window.partitionBy(part).orderBy(order)
    new = F.when(F.lag(same).over(w) == F.col(same), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w) - 1).drop("_new")


#: Stretches of the order in which a name's rows are numbered apart, so that a hot name is not one window.
STRETCHES = 64


def numbered_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Later rows of a name get `` (2)``, `` (3)`` and so on; the first column of ``order`` is a number.

    Rows are numbered within a stretch of the order, after the counts of the stretches before: where the stretches end
    (approximate quantiles) decides about speed only.
    """
    cuts = sorted(set(df.approxQuantile(order[0], [i / STRETCHES for i in range(1, STRETCHES)], 0.01)))
    cuts = F.array(*(F.lit(c) for c in cuts)).cast("array<double>")
    d = df.withColumn("_stretch", F.size(F.filter(cuts, lambda c: c <= F.col(order[0]))))
    before = Window.partitionBy("_name").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(F.col(name).alias("_name"), F.col("_stretch").alias("_s")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    d = d.withColumn("_nth", F.row_number().over(Window.partitionBy(name, "_stretch").orderBy(*order)))
    d = d.join(counts, F.col(name).eqNullSafe(F.col("_name")) & (F.col("_stretch") == F.col("_s")))
    n = F.col("_nth") + F.col("_before")
    unique = F.when(n == 1, F.col(name)).otherwise(F.format_string("%s (%d)", F.col(name), n))
    return d.withColumn("unique_name", unique).drop("_name", "_s", "_stretch", "_nth", "_before")


def packed(text: Column, size: int, separator: str = "\n\n") -> Column:
    """Greedy packing of paragraphs: a new pack starts when the next one would overflow a non-empty pack."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(a, p):
        full = (a["n"] > 0) & (a["n"] + F.length(p) > size)
        return F.struct(
            F.when(full, F.array_append(a["out"], a["now"])).otherwise(a["out"]).alias("out"),
            F.when(full | (a["n"] == 0), p).otherwise(F.concat(a["now"], F.lit(separator), p)).alias("now"),
            (F.when(full, 0).otherwise(a["n"]) + F.length(p) + len(separator)).alias("n"),
        )

    end = lambda a: F.when(a["n"] > 0, F.array_append(a["out"], a["now"])).otherwise(a["out"])
    paragraphs = F.split(text, separator)
    return F.filter(F.aggregate(paragraphs, start, step, end), lambda x: F.regexp_replace(x, r"\s+", "") != "")
