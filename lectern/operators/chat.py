"""Chats over a library: scopes, context lines, event logs and message history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed, doc_name
from .curation import in_subtree

EVENTS = "array<struct<t:string,text:string,name:string,args:string>>"
FIELDS = ("meta", "summary", "tags", "category")


class NotFound(LookupError):
    """A scope names something that does not exist."""


def scope(lib: dict[str, DataFrame], kind: str, value: str = "") -> DataFrame:
    """(id) of the documents in a scope; a tag or category without documents is an empty scope."""
    docs = lib["documents"].select("id", "category")
    if kind == "library":
        return docs.select("id")
    if kind == "document":
        out = docs.where(F.col("id") == int(value)).select("id")
        if out.isEmpty():
            raise NotFound(f"document {value}")
        return out
    if kind == "tag":
        return lib["tags"].where(F.lower("tag") == value.lower()).select(F.col("doc_id").alias("id")).distinct()
    if kind == "category":
        return docs.where(in_subtree(F.col("category"), value.strip("/"))).select("id")
    if kind == "collection":
        if lib["collections"].where(F.col("id") == int(value)).isEmpty():
            raise NotFound(f"collection {value}")
        return lib["members"].where(F.col("collection_id") == int(value)).select(F.col("doc_id").alias("id"))
    raise NotFound(f"scope {kind}")


def doc_line(tags: Column) -> Column:
    """``#id title — category — tags — summary``; what is missing leaves no gap."""
    some = lambda c: F.nullif(c, F.lit(""))
    head = F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" "), doc_name(F.col("title"), F.col("path")))
    return F.concat_ws(" — ", head, some(F.col("category")), some(F.array_join(tags, ", ")), some(F.left(collapsed(F.col("summary")), F.lit(240))))


def context(docs: DataFrame, ids: DataFrame, most: int = 80) -> DataFrame:
    """Lines of the first ``most`` documents of a scope (docs have tags and summary)."""
    d = docs.join(ids, "id", "left_semi").orderBy("id").limit(most)
    return d.select("id", doc_line(F.col("tags")).alias("line"))


def opened(docs: DataFrame, ids: DataFrame, doc_id: int, view: str = "preview") -> DataFrame:
    """The action of opening a document that is in scope."""
    d = docs.join(ids, "id", "left_semi").where(F.col("id") == doc_id)
    known = view if view in ("preview", "summary", "text") else "preview"
    return d.select(F.struct(F.lit("open").alias("action"), "id", F.lit(known).alias("view")).alias("action"))


def regenerable(fields: list[str] | None) -> list[str]:
    """Known fields of a request, in order; all by default."""
    if fields is None:
        return list(FIELDS)
    out = [f for f in fields if f in FIELDS]
    if not out:
        raise ValueError("no such fields")
    return out


def events(messages: DataFrame) -> DataFrame:
    """Messages with ``events``: the parsed log, or the content as one text event where it is missing or broken."""
    log = F.from_json("tool_log", EVENTS)
    plain = F.array(F.struct(F.lit("text").alias("t"), F.col("content").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("args")))
    return messages.withColumn("events", F.when(F.size(F.coalesce(log, F.array().cast(EVENTS))) > 0, log).otherwise(plain))


def reverted(messages: DataFrame, session: int, first: int) -> DataFrame:
    """Without a message of a session and everything after it."""
    return messages.where(~((F.col("session_id") == session) & (F.col("id") >= first)))


def title_of(question: Column) -> Column:
    """A session's title from its first question."""
    t = collapsed(question)
    return F.when(F.length(t) > 60, F.concat(F.left(t, F.lit(60)), F.lit("…"))).otherwise(t)


def tool_arguments(log: DataFrame) -> DataFrame:
    """(call, name, args) from a log of streamed pieces (call, seq, name, piece): pieces are joined in order."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    return log.groupBy("call").agg(F.max("name").alias("name"), F.array_join(F.transform(rows, lambda x: x["piece"]), "").alias("args"))


def model_id(reply: Column) -> Column:
    """First model name in a server's list, whichever of the common shapes it has."""
    one = lambda p: F.nullif(F.get_json_object(reply, p), F.lit(""))
    return F.coalesce(one("$.data[0].id"), one("$.models[0].name"), one("$.models[0].model"), F.lit(""))
