"""Document kinds: weighted structural signals, section extraction and learning from pinned examples."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trimmed

KINDS = ("paper", "book", "gallery", "course", "reference")
#: A kind needs this score.
CONFIDENT = 3.5

# Patterns and weights of the signals.
LINE = r"(?dim)^[\s]*"
ABSTRACT = LINE + r"abstract\b"
ARXIV = r"(?i)arxiv[:\s]"
REFERENCES = LINE + r"(references|bibliography)\b"
CITATION = r"\[\d+\]"
DOI = r"(?i)\bdoi:|\bhttps?://doi\.org/"
KEYWORDS = LINE + r"keywords?[:.]"
CHAPTER = LINE + r"chapter\s+(one|two|three|\d+)"
CHAPTERS = r"(?dm)^\s*(chapter\s+(one|two|three|\d+)|[0-9]{1,2}\.\s+\S.{4,80}$)"
PUBLISHER = r"(?i)all rights reserved|published by|isbn[\s:]?\d|\blibrary of congress|printed in [a-z]|copyright ©?|©\s*(19|20)\d\d"
CONTENTS = LINE + r"(table of )?contents\b"
TOC_LINE = r"(?dm)^\s*\S.{2,90}[.·]{2,}\s*\d+\s*$"
FRONT = LINE + r"(preface|foreword|acknowledge?ments?|introduction|prologue)\b"
ISBN = r"(?i)isbn[\s:]*97[89][0-9-]{9,}"
FIGURE = r"(?i)figure\s+\d+"
COURSE = r"(?i)\b(lecture|syllabus|homework|problem set|instructor|office hours|semester|midterm|final exam)\b"
DUE = r"(?i)\bdue[:\s]"
HANDBOOK = r"(?i)\b(handbook|encyclopedia|dictionary|manual|companion)\b"
APPENDIX = LINE + r"appendix\b"

#: Substrings of the lower-case text without which a pattern has no match, looked for first: a pattern that ignores case tries all its
#: branches at each place.  Patterns that begin with a line are quick enough.
NEEDS = {
    ARXIV: ("arxiv",), DOI: ("doi:", "doi.org"), DUE: ("due",), ISBN: ("isbn",), FIGURE: ("figure",), CITATION: ("[",), TOC_LINE: ("..", "·"),
    PUBLISHER: ("all rights reserved", "published by", "isbn", "library of congress", "printed in ", "copyright ", "©"),
    COURSE: ("lecture", "syllabus", "homework", "problem set", "instructor", "office hours", "semester", "midterm", "final exam"),
    HANDBOOK: ("handbook", "encyclopedia", "dictionary", "manual", "companion"),
}

ABSTRACT_ENDS = (
    LINE + r"(introduction|1[\s.]+introduction|i\.?\s+introduction|keywords?|index terms|acm reference format|ccs concepts|"
    r"references|related work|background|1[\s.]+(related|preliminaries)|acknowledge?ments?|resumen|résumé)\b"
)
PREFACE, FOREWORD, INTRO = LINE + r"preface\b", LINE + r"(foreword|acknowledge?ments?)\b", LINE + r"(introduction|prologue|about this (book|work))\b"
CHAPTER_START = r"(?dim)^[\s]*(chapter|part|appendix)\b|^[\s]*1\s+[\w(]"
# Words that no example is judged by.
STOPWORDS = (
    "the and for with from that this are was were into about their which how what why can its one two new study using paper "
    "document introduction abstract chapter section"
).split()
KIND_STOPWORDS = [*STOPWORDS, *"figure table page pages volume journal".split()]


@dataclass(frozen=True)
class Cuts:
    """What is looked at: texts of more than ``long`` bytes by ``head`` and ``tail`` characters for most signals, and up to ``full`` characters
    for chapters, contents, front sections and ISBN.  The defaults are fixed values; None looks at whole texts."""

    long: int | None = 60_000
    head: int = 40_000
    tail: int = 20_000
    full: int | None = 2_000_000


def scores(text: Column, ocr_pages: Column, n_pages: Column, cuts: Cuts = Cuts()) -> Column:
    """Struct of five scores."""
    size = F.octet_length(text)
    head, tail = F.left(text, F.lit(cuts.head)), F.right(text, F.lit(cuts.tail))
    t = text if cuts.long is None else F.when(size > cuts.long, F.concat(head, F.lit("\n"), tail)).otherwise(head)
    full = text if cuts.full is None else F.left(text, F.lit(cuts.full))
    low = {id(c): F.lower(c) for c in (t, full)}
    may = lambda c, p: reduce(or_, (low[id(c)].contains(x) for x in NEEDS[p])) if p in NEEDS else c.isNotNull()
    n = lambda c, p: F.when(may(c, p), F.regexp_count(c, F.lit(p))).otherwise(F.when(c.isNotNull(), 0))
    has = lambda c, p: may(c, p) & c.rlike(p)
    w = lambda cond, v: F.when(cond, F.lit(float(v))).otherwise(0.0)
    upto = lambda most, x: F.least(F.lit(float(most)), x)
    per_page = F.when(n_pages > 0, size / n_pages)
    scanned = F.when(n_pages > 0, ocr_pages / n_pages).otherwise(0.0) > 0.6
    cites, chapters, figures, course, handbook = n(t, CITATION), n(full, CHAPTERS), n(t, FIGURE), n(t, COURSE), n(t, HANDBOOK)
    paper = (
        w(has(t, ABSTRACT), 4) + w(has(t, ARXIV), 3) + w(has(t, REFERENCES), 2) + F.when(cites >= 4, upto(3, cites / 4)).otherwise(0.0)
        + w(has(t, DOI), 1.5) + w(has(t, KEYWORDS), 1)
    )
    book = (
        F.when(chapters >= 2, upto(4, 1.5 + chapters / 3)).when(has(t, CHAPTER), 3.0).otherwise(0.0)
        + w(n(full, TOC_LINE) >= 6, 2) + w(n(full, FRONT) >= 2, 1.5) + w(has(full, ISBN), 2) + w(has(t, PUBLISHER), 2)
        + w(has(t, CONTENTS), 1) + F.when(n_pages >= 120, 3.0).when(n_pages >= 60, 1.5).otherwise(0.0)
        + w(scanned & (per_page >= 600), 1) + w(has(t, APPENDIX), 0.5)
    )
    gallery = w(scanned & (per_page < 600), 5) + F.when((figures >= 6) & (per_page < 1200), upto(3, figures / 6)).otherwise(0.0)
    courses = F.when(course >= 3, upto(4, course.cast("double"))).otherwise(0.0) + w(has(t, DUE), 1) + w(has(t, CONTENTS), 0.2)
    reference = F.when(handbook >= 1, upto(3, handbook.cast("double"))).otherwise(0.0) + w(has(t, APPENDIX), 1) + w(has(t, REFERENCES), 0.5)
    return F.struct(*(F.round(x, 6).alias(k) for k, x in zip(KINDS, (paper, book, gallery, courses, reference))))


def best_kind(score: Column) -> Column:
    """The first kind with the highest score, or empty below CONFIDENT."""
    top = F.greatest(*(score[k] for k in KINDS))
    out = F.when(top < CONFIDENT, "")
    for k in KINDS:
        out = out.when(score[k] == top, k)
    return out


def tokens(c: Column, stopwords=KIND_STOPWORDS) -> Column:
    """Distinct lower-case tokens of more than two bytes that are not stopwords."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_except(F.filter(parts, lambda t: F.octet_length(t) > 2), F.array(*(F.lit(s) for s in stopwords)))


def match_weight(shared: Column) -> Column:
    """How strongly an example that shares so many tokens speaks for its kind."""
    return F.when(shared < 2, 0.0).otherwise(F.least(F.lit(4.0), 3.0 + 0.25 * (shared - 2)))


def overlap(docs: DataFrame, examples: DataFrame) -> DataFrame:
    """(id, example, shared) from (id, tokens) and (example, tokens): an equi-join on tokens.

    Examples are few and their bound is the caller's, so neither side is broadcast by force; token pairs are counted
    before they meet again.
    """
    d = docs.select("id", F.explode("tokens").alias("t"))
    e = examples.select("example", F.explode("tokens").alias("t"))
    return d.join(e, "t").groupBy("id", "example").agg(F.count("*").alias("shared"))


def with_examples(scored: DataFrame, examples: DataFrame) -> DataFrame:
    """(id, kind) from (id, tokens, score) and (example, kind, tokens): pins add their weight to their kind."""
    w = overlap(scored, examples).join(examples.select("example", "kind"), "example")
    w = w.groupBy("id").agg(*(F.sum(F.when(F.col("kind") == k, match_weight(F.col("shared"))).otherwise(0.0)).alias(f"_{k}") for k in KINDS))
    d = scored.join(w, "id", "left")
    total = F.struct(*(F.round(F.col("score")[k] + F.coalesce(F.col(f"_{k}"), F.lit(0.0)), 6).alias(k) for k in KINDS))
    return d.select("id", best_kind(total).alias("kind"))


def _after(text: Column, pattern: str) -> Column:
    """What follows the first match; null without one."""
    return F.when(text.rlike(pattern), F.get(F.split(text, pattern, 2), F.lit(1)))


def _before(text: Column, pattern: str) -> Column:
    return F.get(F.split(text, pattern, 2), F.lit(0))


def abstract(text: Column, most: int = 3000, least: int = 150) -> Column:
    """The section under the first abstract heading, up to the next heading (or ``most`` characters); empty below ``least`` bytes."""
    rest = _after(text, ABSTRACT)
    cut = F.when(rest.rlike(ABSTRACT_ENDS), _before(rest, ABSTRACT_ENDS)).otherwise(F.left(rest, F.lit(most)))
    out = F.regexp_replace(trimmed(cut), r"^[—\-– \n\t]+", "")
    return F.when(F.octet_length(out) >= least, out).otherwise("")


def front_matter(text: Column, most: int = 7000, least: int = 400) -> Column:
    """Preface, else foreword, else introduction, up to the first chapter (``most`` characters); one below ``least`` bytes is passed over."""
    each = []
    for p in (PREFACE, FOREWORD, INTRO):
        out = trimmed(F.left(_before(_after(text, p), CHAPTER_START), F.lit(most)))
        each.append(F.when(F.octet_length(out) >= least, out))
    return F.coalesce(*each, F.lit(""))


def contents(text: Column, most: int = 4000, lines_most: int = 60) -> Column:
    """Titles of the contents listing (``most`` characters of it), one a line, without leaders and page numbers."""
    rest = _after(text, CONTENTS)
    for p in (PREFACE, FOREWORD, INTRO):
        rest = _before(rest, p)
    lines = F.transform(
        F.split(F.left(rest, F.lit(most)), "\n"),
        lambda x: trimmed(F.regexp_replace(F.regexp_replace(x, r"[.·—-]{2,}\s*\d+\s*$", ""), r"\s+\d+$", "")),
    )
    return F.coalesce(F.array_join(F.slice(F.filter(lines, lambda x: F.octet_length(x) >= 3), 1, lines_most), "\n"), F.lit(""))
