"""Scalar text functions as Column expressions (no Python workers).

White space is matched by explicit classes, and ``(?d)`` keeps line ends to ``\\n`` only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = r"^\s+|\s+$"
# Placeholders that stand for nothing.
JUNK = ("unknown", "untitled", "unspecified", "anonymous", "none", "n/a", "na", "null")
JUNK_CATEGORY = (
    "unknown", "untitled", "unspecified", "none", "n/a", "na", "null", "other", "misc", "miscellaneous", "general", "documents", "library", "uncategorized",
)
JUNK_INGEST = (*JUNK, "not specified", "not available")
HTML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def trimmed(c: Column) -> Column:
    """Without white space at the ends (tabs and line ends too)."""
    return F.regexp_replace(c, EDGES, "")


def cleaned(c: Column) -> Column:
    """Blanks before a line end, or three or more line ends, become a paragraph break; trimmed."""
    return trimmed(F.regexp_replace(c, r"[ \t]+\n|\n{3,}", "\n\n"))


def cleaned_text(s: str) -> str:
    """``cleaned`` for a Python string."""
    if " \n" in s or "\t\n" in s or "\n\n\n" in s:
        s = re.sub(r"[ \t]+\n|\n{3,}", "\n\n", s)
    return s.strip(" \t\n\x0b\f\r")


def collapsed(c: Column) -> Column:
    """Words joined by single blanks."""
    return F.regexp_replace(trimmed(c), r"\s+", " ")


def slugified(c: Column, default: str = "collection") -> Column:
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(s, F.lit("-")), F.lit("")), F.lit(default))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def extension(c: Column) -> Column:
    """Lower-case, with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(basename(c), r"(\.[^.]*)$", 1))


def doc_name(title: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(trimmed(title), F.lit("")), basename(path))


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*(F.nullif(trimmed(c), F.lit("")) for c in cols), F.lit(""))


def note_title(body: Column, note_id: Column) -> Column:
    """First line that says something without its list and heading marks, cut to 60 characters."""
    lines = F.transform(F.split(body, "\n"), lambda x: trimmed(F.regexp_replace(x, r"^[#*\-> ]+", "")))
    t = F.get(F.filter(lines, lambda x: x != ""), F.lit(0))
    cut = F.when(F.length(t) > 60, F.concat(F.substring(t, 1, 60), F.lit("…"))).otherwise(t)
    return F.coalesce(cut, F.concat(F.lit("Note #"), note_id.cast("string")))


def clean_meta(c: Column, junk=JUNK_INGEST) -> Column:
    t = trimmed(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t).isin(*junk), "").otherwise(t)


def valid_year(c: Column) -> Column:
    """The year, or empty if it is not YYYY or YYYY-YYYY."""
    t = F.coalesce(c, F.lit(""))
    return F.when(t.rlike(r"^\d{4}(-\d{4})?$"), t).otherwise("")


def vocabulary_key(c: Column) -> Column:
    return F.lower(trimmed(c))


def normal_category(c: Column, junk=JUNK_CATEGORY) -> Column:
    """Lower-case, blanks as hyphens, at most 40 characters, junk as empty."""
    t = F.regexp_replace(F.lower(trimmed(F.coalesce(c, F.lit("")))), r"\s+", "-")
    return F.when(t.isin(*junk), "").otherwise(F.substring(t, 1, 40))


def clamped_interval(c: Column) -> Column:
    """Seconds between scans: 5 if not positive, otherwise within 2 and 86400."""
    return F.when(c <= 0, 5).otherwise(F.least(F.greatest(c, F.lit(2)), F.lit(86400)))


def page_list(c: Column, most: int = 9999) -> Column:
    """``"3,7-12"`` as a sorted array of distinct ints; parts that are no page or range are left out."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: trimmed(p)), lambda p: p.rlike(r"^\d{1,6}(\s*-\s*\d{1,6})?$"))
    lo = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int")
    hi = lambda p: F.regexp_extract(p, r"(\d+)$", 1).cast("int")
    ranges = F.transform(F.filter(parts, lambda p: (lo(p) <= hi(p)) & (lo(p) <= most)), lambda p: F.sequence(lo(p), F.least(hi(p), F.lit(most))))
    return F.array_sort(F.array_distinct(F.flatten(ranges)))


def page_csv(pages: Column) -> Column:
    """Distinct page numbers (as numbers or digits) in numeric order."""
    shown = F.transform(F.array_distinct(pages.cast("array<string>")), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    return F.array_join(F.transform(F.array_sort(shown), lambda x: x["p"]), ",")


def html_to_text(c: Column) -> Column:
    """Text of a page: scripts and styles gone, block ends as line ends, other tags as blanks, common entities."""
    h = F.coalesce(c, F.lit(""))
    for tag in ("script", "style"):
        h = F.regexp_replace(h, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    h = F.regexp_replace(h, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/section|/article|/pre)\b[^>]*>", "\n")
    h = F.regexp_replace(h, r"(?s)<[^>]+>", " ")
    for name, char in HTML_ENTITIES:
        h = F.replace(h, F.lit(name), F.lit(char))
    h = F.regexp_replace(h, r"[ \t\r\f\x0b]+", " ")
    h = F.regexp_replace(h, r" *\n *", "\n")
    return trimmed(F.regexp_replace(h, r"\n{3,}", "\n\n"))


def within_budget(text: Column, budget: int, overhead: int = 0) -> Column:
    """Cut to 3 characters per token of the budget that is left (512 at least), at the last paragraph end."""
    n = 3 * max(512, budget - overhead)
    head = F.left(text, F.lit(n))
    at = F.length(head) - F.instr(F.reverse(head), "\n\n") - 1
    return F.when(F.length(text) <= n, text).otherwise(F.when(F.instr(head, "\n\n") > 0, F.substring(head, F.lit(1), at)).otherwise(head))


def without_think(c: Column) -> Column:
    """A model's answer without its first think block."""
    return trimmed(F.regexp_replace(c, r"(?s)^(.*?)<think>.*?</think>", "$1"))


def json_object(c: Column) -> Column:
    """From the first opening to the last closing brace; empty without both."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def doc_refs(c: Column) -> Column:
    """Numbers of ``#123`` references in a text."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"#(\d{1,9})\b"), F.lit(1)), lambda x: x.cast("long"))


def highlighted(text: Column, terms: list[str]) -> Column:
    """Terms (whatever their case) between mark tags."""
    import re

    if not terms:
        return text
    return F.regexp_replace(text, "(?i)(" + "|".join(re.escape(t) for t in terms) + ")", "<mark>$1</mark>")


def page_label(page: Column) -> Column:
    return F.when(F.coalesce(page, F.lit(0)) > 0, F.concat(F.lit("p."), page.cast("string"))).otherwise("chunk")


def missing_languages(asked: Column, installed: Column) -> Column:
    return F.array_except(F.split(asked, r"\+"), installed)


def wrapped(text: Column, width: int, indent: str = "") -> Column:
    """Word wrap; a longer word has a line of its own."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(a, w):
        fits = (a["n"] > 0) & (a["n"] + 1 + F.length(w) <= width)
        out = F.when(fits, F.concat(a["out"], F.lit(" "), w)).otherwise(
            F.concat(a["out"], F.when(a["n"] > 0, F.lit("\n")).otherwise(F.lit("")), F.lit(indent), w)
        )
        return F.struct(out.alias("out"), F.when(fits, a["n"] + 1 + F.length(w)).otherwise(F.length(w)).alias("n"))

    return F.aggregate(F.filter(F.split(collapsed(text), " "), lambda w: w != ""), start, step, lambda a: a["out"])
