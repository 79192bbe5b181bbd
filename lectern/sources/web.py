"""Web pages as a source: address rules, reduction to text and a size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_to_text, trimmed

#: Hosts that hand out credentials inside clouds.
BLOCKED = ("169.254.169.254", "metadata.google.internal")
MAX_BYTES, MAX_CHARS, MARK = 500_000, 8000, "\n…[truncated]"


def allowed(url: Column) -> Column:
    """http or https, and not a metadata host."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.lower(url).rlike("^https?://") & ~host.isin(*BLOCKED)


def is_html(body: Column, content_type: Column | None = None) -> Column:
    """By the server's word, or by how the body begins."""
    head = F.lower(F.left(body, F.lit(512)))
    looks = head.contains("<html") | head.contains("<!doctype html")
    return looks if content_type is None else looks | F.coalesce(F.lower(content_type).contains("html"), F.lit(False))


def fetched(pages: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """Pages (url, html) that may be fetched, with ``text`` cut to ``most`` characters and a mark, and ``error`` where there is none.

    Other bodies than HTML are text already and stay as they are; a column ``content_type`` is used if there is one.
    """
    body = F.left(F.coalesce("html", F.lit("")), F.lit(MAX_BYTES))
    kind = F.col("content_type") if "content_type" in pages.columns else None
    d = pages.where(allowed(F.col("url"))).withColumn("_b", body)
    d = d.withColumn("_t", F.when(is_html(F.col("_b"), kind), html_to_text(F.col("_b"))).otherwise(trimmed(F.col("_b"))))
    cut = F.when(F.length("_t") > most, F.concat(F.left("_t", F.lit(most)), F.lit(MARK))).otherwise(F.col("_t"))
    error = F.when(F.col("_t") == "", F.concat(F.lit("no readable text at "), "url"))
    return d.withColumns({"text": cut, "error": error}).drop("_b", "_t")
