"""Quality rules as a ledger of bits.

Every rule is evaluated once per document; the outcome is one bit of ``failed_bits`` beside the
measurements it came from.  A policy is a versioned mask over those bits, so changing a policy or
asking "what would rule r alone cost" never reads a text again: it is bitwise work on the ledger.

Main path: DataFrame expressions only (no Python workers), one pass and no shuffle.

Defined results: a null or empty text has no words and fails ``few_words``; a null key is kept as
it is; repeated rows give repeated ledger rows; extra columns pass through ``ledger`` untouched
unless they carry the name of a ledger column, which then holds the ledger's value; an empty table
gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, unwrapped, words_of, wrapped

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaims", "n_stutters")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


#: Bits are never reused: a rule that changes its meaning gets a new one.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbol_heavy", "100 * n_symbols > 15 * n_words"),
    Rule(3, "shouting", "100 * n_upper > 40 * word_chars"),
    Rule(4, "exclaiming", "100 * n_exclaims > 30 * n_words"),
    Rule(5, "copied_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(6, "short_or_long_words", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    Rule(7, "stuttering", "100 * n_stutters > 30 * n_words"),
)
BIT = {r.name: 1 << r.bit for r in RULES}
#: Versioned policies: a document is kept where ``failed_bits & mask`` is zero.
POLICIES = {
    "base@1": BIT["few_words"] | BIT["repeated_windows"],
    "web@1": sum(BIT.values()) & ~BIT["short_or_long_words"] & ~BIT["stuttering"],
    "web@2": sum(BIT.values()) & ~BIT["stuttering"],
    "web@3": sum(BIT.values()),
}


def _count_of(characters: str, text: Column) -> Column:
    """Characters of a class: what lies between them goes in long strides, which is cheaper than looking each one up."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _covered(starts: Column) -> Column:
    """Words under windows that begin at the (sorted, distinct) starts."""
    steps = F.transform(
        F.sequence(F.lit(0), F.size(starts) - 1),
        lambda k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - F.get(starts, k), F.lit(WINDOW))),
    )
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of MEASURES (long).

    Repeats are found inside a row: windows are 64-bit hashes of word hashes; only where some hash
    occurs twice are they sorted with their places, so ordinary rows cost a hash set at most.
    """
    t = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    d = wrapped(docs, text).withColumns({"_words": words_of(F.col("_text")), "_lines": lines})
    d = d.withColumns(
        {
            "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(t, BLANK_RUN, "")).cast("long"),
            "n_symbols": _count_of(SYMBOLS, t),
            "n_upper": _count_of("A-Z", t),
            "n_exclaims": (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_words", "_lines", "_text")
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_hash") - WINDOW),
        lambda i: F.xxhash64(*(F.get(F.col("_hash"), i + j) for j in range(WINDOW))),
    )
    again = F.filter("_hash", lambda h, i: h == F.get(F.col("_hash"), F.greatest(i - 1, F.lit(0))))  # the first word is its own
    d = d.withColumns(
        {"_win": F.when(F.size("_hash") > WINDOW, windows), "n_stutters": F.greatest(F.size(again) - 1, F.lit(0)).cast("long")}
    ).drop("_hash")
    some = F.size(F.array_distinct("_win")) < F.size("_win")
    d = d.withColumn("_at", F.when(some, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.col("_at")
    twice = F.transform(
        F.sequence(F.lit(0), F.size(at) - 1),
        lambda j: F.when(
            (F.get(at, j)["h"] == F.get(at, j + 1)["h"])
            | ((j > 0) & (F.get(at, j)["h"] == F.get(at, F.greatest(j - 1, F.lit(0)))["h"])),
            F.get(at, j)["i"],
        ),
    )
    d = d.withColumn("_starts", F.when(at.isNotNull(), F.sort_array(F.filter(twice, lambda i: i.isNotNull())))).drop("_win", "_at")
    starts = F.col("_starts")
    d = d.withColumn("n_repeat_words", F.when(starts.isNotNull(), _covered(starts)).otherwise(0).cast("long"))
    return unwrapped(d, docs, MEASURES)


def failed_bits() -> Column:
    """The mask of failed rules, from the measurement columns."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``failed_bits`` for every row of ``docs``."""
    return measured(docs, text).withColumn("failed_bits", failed_bits())


def passes(policy: str, bits: str = "failed_bits") -> Column:
    """Whether the versioned policy keeps a ledger row."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents it fails, and those that only it fails.

    One aggregation of the ledger to at most 2**len(RULES) bit patterns, then bitwise work on those.
    """
    mask = POLICIES[policy]
    seen = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    inside = [r for r in RULES if mask >> r.bit & 1]
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in inside)))
    each = seen.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op10(docs: DataFrame) -> DataFrame:
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(POLICIES["base@1"]).cast("long")) != 0).alias("base_failed"),
        passes("web@3").alias("kept"),
        "failed_bits",
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lns
  FROM documents),
g AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) > 8),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(list_slice(w, i, i + 7), ' ')) AS n FROM g),
c AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS s FROM k WHERE n > 1),
r AS (SELECT rid, sum(s)::BIGINT AS n_repeat_words FROM c GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaims,
         len(lns)::BIGINT AS n_lines, (len(lns) - len(list_distinct(lns)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutters
  FROM d LEFT JOIN r USING (rid)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 15 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_upper > 40 * word_chars THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_exclaims > 30 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 64 ELSE 0 END
    + CASE WHEN 100 * n_stutters > 30 * n_words THEN 128 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b
"""
