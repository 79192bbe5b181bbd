"""Mutations: functions from tables to tables (update as join, insert-or-ignore as anti-join, cascades)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Conflict(ValueError):
    """A name is taken, or a change is not allowed."""


def duplicates(docs: DataFrame, hashes: tuple[str, ...] = ("sha256",)) -> DataFrame:
    """(hashes, canonical, duplicate): one row per document whose content a lower id has too.

    Rows rather than lists, so a group may hold any share of all documents.
    """
    g = docs.groupBy(*hashes).agg(F.min("id").alias("canonical"), F.count("*").alias("n")).where("n > 1").drop("n")
    return docs.select("id", *hashes).join(g, list(hashes)).where("id <> canonical").select(*hashes, "canonical", F.col("id").alias("duplicate"))


def sha3_256():
    """SHA3-256 (hex) as an Arrow UDF: Spark has no such function."""
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else hashlib.sha3_256(t.encode() if isinstance(t, str) else bytes(t)).hexdigest())

    return f


def verified_duplicates(docs: DataFrame) -> DataFrame:
    """Bucket by SHA-256, hash again by SHA3-256 only where a bucket has two rows, group by both."""
    often = docs.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1").select("sha256")
    d = docs.join(often, "sha256", "left_semi").withColumn("sha3", sha3_256()(F.col("text")))
    return duplicates(d, ("sha256", "sha3"))


def canonical_ids(docs: DataFrame) -> DataFrame:
    """(id, canonical): a grouped minimum that is combined before the shuffle, so a hot hash is no window."""
    low = docs.groupBy("sha256").agg(F.min("id").alias("canonical"))
    return docs.select("id", "sha256").join(low, "sha256").select("id", "canonical")


def merged_tags(tags: DataFrame, to: DataFrame) -> DataFrame:
    """Tags of duplicates move to the canonical document; on a conflict its own tag stays."""
    m = tags.join(to, tags["doc_id"] == to["id"]).select(F.col("canonical").alias("doc_id"), "tag", "source", (F.col("id") != F.col("canonical")).alias("moved"), "id")
    best = F.min(F.struct("moved", "id", "source"))
    return m.groupBy("doc_id", "tag").agg(best.alias("b")).select("doc_id", "tag", F.col("b.source").alias("source"))


def merged_members(members: DataFrame, to: DataFrame) -> DataFrame:
    return members.join(to, members["doc_id"] == to["id"]).select("collection_id", F.col("canonical").alias("doc_id")).distinct()


def merged_chats(chats: DataFrame, to: DataFrame) -> DataFrame:
    """Chats about a duplicate become chats about the canonical document; other scopes stay."""
    m = to.where("id <> canonical").select(F.col("id").cast("string").alias("_from"), F.col("canonical").cast("string").alias("_to"))
    d = chats.join(m, (F.col("scope_kind") == "document") & (F.col("scope_value") == F.col("_from")), "left")
    return d.withColumn("scope_value", F.coalesce("_to", "scope_value")).drop("_from", "_to")


def merged(lib: dict[str, DataFrame], to: DataFrame) -> dict[str, DataFrame]:
    """A library whose duplicates (id, canonical) are gone: tags, memberships and chats move, everything else that hangs on them goes."""
    out = deleted(lib, to.where("id <> canonical").select("id"))
    moved = {"tags": merged_tags, "members": merged_members, "chats": merged_chats}
    return out | {k: f(lib[k], to) for k, f in moved.items() if k in lib}


def first_wins(files: DataFrame) -> DataFrame:
    """Of files with equal content the first path is ingested, the others are duplicates."""
    first = files.groupBy("sha256").agg(F.min("path").alias("first"))
    return files.join(first, "sha256").select("path", F.when(F.col("path") == F.col("first"), "added").otherwise("duplicate").alias("action"))


def ingest_actions(files: DataFrame, docs: DataFrame, reprocess: bool = False) -> DataFrame:
    """(path, action) for scanned files (path, sha256, text) against stored documents."""
    known = docs.select("path", F.col("sha256").alias("old"))
    content = docs.select("sha256").distinct().withColumn("stored", F.lit(True))
    first = files.groupBy("sha256").agg(F.min("path").alias("first"))
    f = files.join(known, "path", "left").join(content, "sha256", "left").join(first, "sha256")
    unchanged = (F.col("old") == F.col("sha256")) & F.lit(not reprocess)
    action = (
        F.when(unchanged, "skipped")
        .when(F.col("old").isNull() & (F.col("stored") | (F.col("path") != F.col("first"))), "duplicate")
        .when(F.regexp_replace("text", r"\s+", "") == "", "failed")
        .when(F.col("old").isNotNull(), "updated")
        .otherwise("added")
    )
    return f.select("path", action.alias("action"))


def renamed_category(category: Column, old: str, new: str) -> Column:
    """A shelf and everything below it under another name."""
    a, b = old.strip("/"), new.strip("/")
    if not a or not b or a == b or b.startswith(a + "/"):
        raise Conflict("a shelf cannot be renamed to nothing, to itself or into itself")
    return F.when(category == a, b).when(category.startswith(a + "/"), F.concat(F.lit(b), F.substr(category, F.lit(len(a) + 1)))).otherwise(category)


def promoted(tags: DataFrame, tag: str) -> DataFrame:
    """Rows of a tag that has entered the vocabulary."""
    return tags.withColumn("source", F.when(F.col("tag") == tag.strip().lower(), "vocab").otherwise(F.col("source")))


def without_tag(tags: DataFrame, tag: str) -> DataFrame:
    return tags.where(F.col("tag") != tag)


def deleted(lib: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """A library without the documents (id) and what hangs on them."""
    child = ids.withColumnRenamed("id", "doc_id")
    out = {k: v.join(child, "doc_id", "left_anti") for k, v in lib.items() if "doc_id" in v.columns}
    return lib | out | {"documents": lib["documents"].join(ids, "id", "left_anti")}


def inserted_or_ignored(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replaced_children(old: DataFrame, new: DataFrame, parent: str = "doc_id") -> DataFrame:
    """New rows instead of all old rows of the parents that they mention."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def patched(docs: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null values of ``changes`` (id, columns) replace those of ``docs``; kind and category become pins."""
    c = changes.select("id", *(F.col(x).alias(f"_{x}") for x in columns))
    d = docs.join(c, "id", "left")
    new = {x: F.coalesce(f"_{x}", x) for x in columns}
    for x in ("kind", "category"):
        if x in columns and f"{x}_user" in docs.columns:
            new[f"{x}_user"] = F.coalesce(F.when(F.col(f"_{x}").isNotNull(), True), F.col(f"{x}_user"))
    return d.withColumns(new).drop(*(f"_{x}" for x in columns))


def stored_results(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Merge of enrichment: existing non-empty title, authors and year stay; an open category is filled."""
    from ..functions.text import clean_meta, valid_year

    r = results.select("id", *(F.col(x).alias(f"_{x}") for x in ("title", "authors", "year", "category", "summary")))
    keep = lambda x, new: F.coalesce(F.nullif(F.col(x), F.lit("")), new)
    d = docs.join(r, "id", "left")
    return d.withColumns(
        {
            "title": keep("title", clean_meta(F.col("_title"))),
            "authors": keep("authors", clean_meta(F.col("_authors"))),
            "year": keep("year", valid_year(F.col("_year"))),
            "category": F.when(F.col("category_user"), F.col("category")).otherwise(keep("category", F.coalesce("_category", F.lit("")))),
            "summary": F.coalesce("_summary", "summary"),
            "status": F.when(F.col("_summary").isNotNull(), "done").otherwise(F.col("status")),
        }
    ).drop("_title", "_authors", "_year", "_category", "_summary")


def filtered_tags(tags: Column, category: Column) -> Column:
    """Tags that do not repeat a part of the category; all of them if none would be left."""
    parts = F.transform(F.split(F.lower(category), "/"), lambda p: p)
    left = F.filter(tags, lambda t: ~F.array_contains(parts, F.lower(t)))
    return F.when(F.size(left) == 0, tags).otherwise(left)


def respelled(results: DataFrame, docs: DataFrame) -> DataFrame:
    """Results whose category equals an existing shelf but for its case take the shelf's spelling."""
    shelves = docs.where("category <> ''").groupBy(F.lower("category").alias("_low")).agg(F.min("category").alias("_shelf"))
    r = results.join(shelves, F.lower("category") == F.col("_low"), "left")
    return r.withColumn("category", F.coalesce("_shelf", "category")).drop("_low", "_shelf")


def constrained_tags(proposed: Column, vocabulary: list[str], category: Column, most: int = 6) -> Column:
    """Struct of accepted tags (in the vocabulary) and at most two others."""
    known = F.array(*(F.lit(v) for v in vocabulary))
    low = F.array_distinct(F.filter(F.transform(proposed, lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    return F.struct(
        F.slice(filtered_tags(F.array_intersect(low, known), category), 1, most).alias("tags"),
        F.slice(F.array_except(low, known), 1, 2).alias("other"),
    )


def added_members(members: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships after adding, and the rows that were new."""
    fresh = new.distinct().join(members, ["collection_id", "doc_id"], "left_anti")
    return members.unionByName(fresh), fresh


def with_new_ids(new: DataFrame, old: DataFrame, order: str) -> DataFrame:
    """Ids after the largest old one, in the order of a column (single writer; new rows are few)."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return new.withColumn("id", F.row_number().over(Window.orderBy(order)) + F.lit(top))


def meta_value(meta: DataFrame, key: str) -> DataFrame:
    """One row: a setting's value, empty where it was never set."""
    return meta.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))


def meta_set(meta: DataFrame, key: str, value: str) -> DataFrame:
    new = meta.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return upserted(meta.select("key", "value"), new, ["key"])


def note_added(notes: DataFrame, doc_id: int, body: str, now: Column | None = None) -> DataFrame:
    """Notes (id, doc_id, body, created, updated) with one more; a blank one is refused."""
    if not body.strip():
        raise Conflict("a note needs a text")
    at = F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    new = notes.sparkSession.range(1).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit(body).alias("body"), at.alias("created"), at.alias("updated"))
    return notes.unionByName(with_new_ids(new, notes, "body").withColumn("id", F.col("id").cast("long")))


def note_edited(notes: DataFrame, note: int, body: str, now: Column | None = None) -> DataFrame:
    at = F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    mine = F.col("id") == note
    return notes.withColumns({"body": F.when(mine, body).otherwise(F.col("body")), "updated": F.when(mine, at).otherwise(F.col("updated"))})


def notes_removed(notes: DataFrame, ids: list[int]) -> DataFrame:
    return notes.where(~F.col("id").isin(ids))


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same elements, in whatever order (settings that did not really change)."""
    return F.array_sort(F.array_distinct(F.coalesce(a, F.array().cast("array<string>")))) == F.array_sort(F.array_distinct(F.coalesce(b, F.array().cast("array<string>"))))
