"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Three base kinds come from patterns.  The method adds kind ``random``: runs of 20 or more key
characters outside the base spans whose first-order character transitions are better explained by a
model of random strings than by one of ordinary identifiers.  Both models are counted in SQL from a
labelled sample of fixed size (``samples``), smoothed, and turned into one table of 63 x 63 log
ratios; scoring a run is a sum of table entries.

Main path: DataFrame expressions only.  Spans come from pairing a pattern's matches with the
pieces that the same pattern splits the text into, so positions are code points without any UDF.

Defined results: null and empty texts have no spans; every row is returned, repeated rows
alike; extra columns pass through ``redacted`` whatever their names, and through ``scanned`` unless they
are named like its results; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unwrapped, wrapped

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 or more characters in all
HEX = r"[0-9a-f]{24,}"
#: Maximal runs of key characters; possessive and anchored, so a failing run costs one step a character.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
MIN_SECRET = 6
MASK = "[SECRET]"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-"
OTHERS = "+/_="  # counted as "-"
N = len(ALPHABET)
#: Labelled sample: so many random strings and so many identifiers.
SAMPLES = 4096
MIN_TOTAL, MIN_MEAN = 12.0, 0.45

#: Ordinary words from which the labelled identifiers are put together.
WORDS = (
    "account action active address after alias amount array author base batch before block body buffer build button "
    "cache call category change channel check child class client clone close code column command comment config "
    "connection content context control convert copy count create current data date debug default delete depth device "
    "document domain download element email enable entry error event example export field file filter first flag folder "
    "format function group handle header height history image import index input insert instance item iterator join key "
    "language last layer length level library limit line link list load local location manager master match member memory "
    "message method model module name network node number object offset open option order output package page parent "
    "password path pattern "
    "nicht werden freiheit freundlich wissenschaft verein gesetz stellung ordnung zeit arbeit meinung "
    "commentaire quelque nouvelle travail ensemble toujours entre question "
    "canciones siempre donde mundo trabajo gobierno estado quien "
    "nation thing engineering attention balance movement capable accordingly there other which through"
).split()


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(text, random): ``n`` random strings and ``n`` identifiers, the same on every call."""
    i = F.col("id").cast("string")
    digest = F.sha2(F.concat(F.lit("sample "), i), 512)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), r"[\n=]", "")
    rand = spark.range(n).select(
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).otherwise(F.substring(coded, 1, 40)).alias("text"), F.lit(True).alias("random")
    )
    words = F.array(*(F.lit(w) for w in WORDS))
    pick = lambda k: F.get(words, F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(WORDS))).cast("int"))
    four = [pick(k) for k in range(4)]
    joined = (
        F.when(F.col("id") % 5 == 0, F.concat_ws("_", *four))
        .when(F.col("id") % 5 == 1, F.concat(*(F.initcap(w) for w in four)))
        .when(F.col("id") % 5 == 2, F.concat_ws("-", *four, (F.col("id") % 2030).cast("string")))
        .when(F.col("id") % 5 == 3, F.concat(*four))
        .otherwise(F.upper(F.concat_ws("_", *four)))
    )
    return rand.unionByName(spark.range(n).select(joined.alias("text"), F.lit(False).alias("random")))


def _letters(token: Column) -> Column:
    return F.split(F.translate(token, OTHERS, "-" * len(OTHERS)), "")


def train(labelled: DataFrame) -> list[float]:
    """Row-major 63 x 63 table of log P(b|a, random) - log P(b|a, ordinary), add-one smoothed.

    Transitions are counted in Spark; what reaches the driver is at most 2 * 63 * 63 counts.
    """
    c = labelled.select("random", _letters(F.col("text")).alias("c")).where(F.size("c") > 1)
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.concat(F.get(F.col("c"), i), F.get(F.col("c"), i + 1))))
    counts = {True: [[1] * N for _ in range(N)], False: [[1] * N for _ in range(N)]}
    for r in c.select("random", pairs.alias("p")).where(F.col("p").rlike(r"^[A-Za-z0-9-]{2}$")).groupBy("random", "p").count().collect():
        counts[r["random"]][ALPHABET.index(r["p"][0])][ALPHABET.index(r["p"][1])] += r["count"]
    share = {k: [[math.log(x / sum(row)) for x in row] for row in t] for k, t in counts.items()}
    return [round(share[True][a][b] - share[False][a][b], 4) for a in range(N) for b in range(N)]


def log_ratio(token: Column, table: list[float]) -> Column:
    """Sum of the table's entries over a token's transitions."""
    weights = F.transform(F.split(F.lit(",".join(map(str, table))), ","), lambda x: x.cast("double"))
    at = F.transform(_letters(token), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = F.transform(
        F.sequence(F.lit(0), F.size(at) - 2),
        lambda i: F.get(weights, (F.get(at, i) - 1) * N + F.get(at, i + 1) - 1),
    )
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def _placed(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) in code points, of the pattern's leftmost matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    return F.aggregate(
        both,
        zero,
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["m"]).alias("at"),
            F.array_append(a["out"], F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["m"]).alias("e"))).alias("out"),
        ),
        lambda a: a["out"],
    )


SPAN = "array<struct<s:int,k:int,e:int>>"


def _spans(text: Column, kind: int, pattern: str, value: Column | None = None, good=None) -> Column:
    """Spans of a kind; ``value`` holds what ``good`` judges, one for each match."""
    as_span = lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"))
    if value is None:
        out = F.transform(_placed(text, pattern), as_span)
    else:
        pairs = F.zip_with(_placed(text, pattern), value, lambda p, v: F.struct(p["s"].alias("s"), p["e"].alias("e"), v.alias("v")))
        out = F.transform(F.filter(pairs, lambda x: good(x["v"])), as_span)
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(SPAN)).cast(SPAN)


def scanned(docs: DataFrame, table: list[float], text: str = "text") -> DataFrame:
    """``docs`` plus ``base`` and ``spans``: sorted arrays of (s, k, e), k counting KINDS from 0."""
    t = F.coalesce(F.col("_text"), F.lit(""))
    d = wrapped(docs, text).withColumns(
        {
            "_a": _spans(t, 0, ASSIGN, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= MIN_SECRET),
            "_b": _spans(t, 1, ACCESS),
            "_c": _spans(t, 2, HEX),
            "_r": _spans(
                t, 3, RUN, F.regexp_extract_all(t, F.lit(RUN), F.lit(0)),
                lambda v: (log_ratio(v, table) >= MIN_TOTAL) & (log_ratio(v, table) >= MIN_MEAN * (F.length(v) - 1)),
            ),
        }
    )
    d = d.withColumn("base", F.sort_array(F.concat("_a", "_b", "_c")))
    fresh = F.filter("_r", lambda x: ~F.exists("base", lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
    return unwrapped(d.withColumn("spans", F.sort_array(F.concat("base", fresh))), docs, ["base", "spans"])


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(docs: DataFrame, table: list[float], text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by MASK (overlapping spans by one); null texts stay null."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # so that no column of theirs meets one of ours
    d = scanned(docs.select(whole.alias("_doc"), F.col(text).alias("_text")), table, "_text")
    t = F.col("_text")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(
        "spans",
        zero,
        lambda a, x: F.when(
            x["s"] >= a["at"],
            F.struct(x["e"].alias("at"), F.array_append(a["out"], F.concat(F.substring(t, a["at"] + 1, x["s"] - a["at"]), F.lit(MASK))).alias("out")),
        ).otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))),
    )
    masked = F.when(F.size("spans") > 0, cut).otherwise(t)
    return d.select(*((masked if c == text else F.col("_doc").getField(c)).alias(c) for c in docs.columns))


def op8(docs: DataFrame) -> DataFrame:
    table = train(samples(docs.sparkSession))
    d = scanned(docs.select("doc_id", "text"), table)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return d.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )
