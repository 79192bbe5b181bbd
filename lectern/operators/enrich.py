"""Enrichment: summaries, tags and metadata by pluggable backends, with failures as rows.

Backends are plain Python protocols run per Arrow batch; the default ones work offline and are deterministic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinds as K
from ..functions.text import trimmed
from ..session import checkpointed
from .changes import constrained_tags
from .curation import packed

SEPARATOR = "\n---\n"
SHORT = 400


class Summarizer(Protocol):
    def __call__(self, text: str) -> str: ...


class Tagger(Protocol):
    def __call__(self, text: str, vocabulary: list[str]) -> dict: ...


class Extractor(Protocol):
    def __call__(self, content: bytes) -> str: ...


def first_sentences(text: str, most: int = 400) -> str:
    """Extractive default: whole sentences from the start, up to ``most`` characters."""
    out = ""
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        if out and len(out) + 1 + len(s) > most:
            break
        out = f"{out} {s}".strip()
    return out[:most]


def overlapping_tags(text: str, vocabulary: list[str]) -> dict:
    """Keyword default: vocabulary entries all of whose parts occur in the text."""
    words = set(re.findall(r"[a-z0-9]+", text.lower()))
    return {"tags": [v for v in sorted(vocabulary) if set(v.split("-")) <= words], "category": "", "title": "", "authors": "", "year": ""}


def budget_chars(context_tokens: int) -> int:
    return int((context_tokens - 1400) * 3.5)


def mapped(rows: DataFrame, summarize: Summarizer, text: str = "text") -> DataFrame:
    """``rows`` with ``summary`` and ``error``; one bad row leaves the others alone."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b[text]:
                try:
                    out.append((summarize(t or ""), None))
                except Exception as e:  # recorded with the row
                    out.append((None, f"{type(e).__name__}: {e}"))
            b = b[names].copy()
            b["summary"], b["error"] = [x for x, _ in out], [e for _, e in out]
            yield b

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, summary string, error string")


def summarized(docs: DataFrame, summarize: Summarizer, chunk_chars: int = 6000, context_tokens: int = 8192) -> DataFrame:
    """(id, summary, error) by map and hierarchical reduce.

    Texts are packed by paragraphs; each pack is summarised; summaries are packed again until one batch is
    left. Every level shrinks a document's parts at least by half, so the number of levels is logarithmic.
    """
    most = max(budget_chars(context_tokens), 2)
    parts = docs.select("id", F.posexplode_outer(packed(F.col("text"), chunk_chars)).alias("seq", "text"))
    level = mapped(parts, summarize).select("id", "seq", F.col("summary").alias("text"), "error")
    while True:
        level = checkpointed(level)  # a backend is asked once for each part, also when an executor is lost
        if level.groupBy("id").count().where("count > 1").isEmpty():
            return level.select("id", F.col("text").alias("summary"), "error")
        rows = F.array_sort(F.collect_list(F.struct("seq", "text")))
        g = level.groupBy("id").agg(F.transform(rows, lambda x: x["text"]).alias("parts"), F.max("error").alias("error"))
        joined = g.select("id", "error", F.posexplode(batches_of(F.col("parts"), most)).alias("seq", "text"))
        level = mapped(joined.select("id", "seq", "text", F.col("error").alias("before")), summarize)
        level = level.select("id", "seq", F.col("summary").alias("text"), F.coalesce("before", "error").alias("error"))


def batches_of(parts: Column, most: int) -> Column:
    """Parts joined greedily into batches of at most ``most`` characters, two parts at least in each but the last."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"), F.lit(0).alias("k"))

    def step(a, p):
        p = F.coalesce(p, F.lit(""))
        full = (a["k"] >= 2) & (F.length(a["now"]) + len(SEPARATOR) + F.length(p) > most)
        return F.struct(
            F.when(full, F.array_append(a["out"], a["now"])).otherwise(a["out"]).alias("out"),
            F.when(full | (a["k"] == 0), p).otherwise(F.concat(a["now"], F.lit(SEPARATOR), p)).alias("now"),
            (F.when(full, 0).otherwise(a["k"]) + 1).alias("k"),
        )

    return F.aggregate(parts, start, step, lambda a: F.when(a["k"] > 0, F.array_append(a["out"], a["now"])).otherwise(a["out"]))


def fast_summary(kind: Column, text: Column, generated: Column) -> Column:
    """Struct (summary, source): the abstract of a paper, the front matter of a book, else a generated one."""
    paper, book = F.nullif(K.abstract(text), F.lit("")), F.nullif(K.front_matter(text), F.lit(""))
    short = F.octet_length(trimmed(text)) < SHORT
    return (
        F.when(short, F.struct(F.lit("").alias("summary"), F.lit("").alias("source")))
        .when((kind == "paper") & paper.isNotNull(), F.struct(paper.alias("summary"), F.lit("abstract").alias("source")))
        .when((kind == "book") & book.isNotNull(), F.struct(book.alias("summary"), F.lit("front-matter").alias("source")))
        .otherwise(F.struct(generated.alias("summary"), F.lit("generated").alias("source")))
    )


def tagged(docs: DataFrame, tag: Tagger, vocabulary: list[str], most: int = 6) -> DataFrame:
    """(id, tags, other, title, authors, year, category, error): a backend's answer, held to the vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["text"]):
                try:
                    r = tag(t or "", vocabulary)
                    texts = [x if isinstance(x := r.get(k, ""), str) else "" for k in ("title", "authors", "year", "category")]
                    out.append((i, [x for x in r.get("tags", []) if isinstance(x, str) and x], *texts, None))
                except Exception as e:  # recorded with the row
                    out.append((i, [], "", "", "", "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", "proposed", "title", "authors", "year", "category", "error"])

    d = docs.select("id", "text").mapInPandas(run, "id long, proposed array<string>, title string, authors string, year string, category string, error string")
    from ..functions.text import clean_meta, normal_category, valid_year

    c = normal_category(F.col("category"))
    return d.select(
        "id", constrained_tags(F.col("proposed"), vocabulary, c, most).alias("t"), clean_meta(F.col("title")).alias("title"),
        clean_meta(F.col("authors")).alias("authors"), valid_year(F.col("year")).alias("year"), c.alias("category"), "error",
    ).select("id", "t.tags", "t.other", "title", "authors", "year", "category", "error")


def processed(docs: DataFrame, summarize: Summarizer = first_sentences, limit: int = 0, **sizes) -> DataFrame:
    """(id, kind, summary, source, status, error) of pending documents, lowest ids first if limited."""
    todo = docs.where("status = 'ingested'")
    todo = todo.orderBy("id").limit(limit) if limit else todo
    todo = todo.withColumn("kind", K.best_kind(K.scores(F.col("text"), F.lit(0), F.lit(0))))
    made = summarized(todo.select("id", "text"), summarize, **sizes).withColumnRenamed("summary", "generated")
    d = todo.join(made, "id").withColumn("s", fast_summary(F.col("kind"), F.col("text"), F.col("generated")))
    return d.select("id", "kind", "s.summary", "s.source", F.when(F.col("error").isNull(), "done").otherwise("ingested").alias("status"), "error")


def vocabulary_block(vocabulary: DataFrame) -> DataFrame:
    """One row: sorted ``- name: description`` lines for a prompt."""
    line = F.format_string("- %s: %s", "tag", F.coalesce("description", F.lit("")))
    return vocabulary.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("block"))
