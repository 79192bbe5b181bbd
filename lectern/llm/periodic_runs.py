"""Periodic runs of words by heavy/light lag counting.

A run with period q of a text's words holds at least ``3 q`` consecutive places whose word equals that q words later, so
a lag can only be a period if it has as many matches.  Matches of all lags are counted exactly: frequent words by
autocorrelation (their power spectra are added, one inverse transform gives the sum), rare words by differences of
their places; the words are parted where a cost estimate is least.  Only lags with enough matches are scanned for
islands of consecutive matches; an island is a run unless a proper divisor of q is a period of it as well.
A stride over long texts spares lags whose matches stand alone.

Work is n ** 1.5 for n words at most, with arrays in proportion to n, one text at a time.

Defined results: null and empty texts have no words and no runs, and collapse to the empty text; repeated rows give
equal rows; extra columns pass through unless named like a result, which then replaces them; an empty table gives an empty
result.  In ``op11`` a null doc_id has no digest, so its text stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unwrapped, words_of, wrapped

#: A run is REPEATS periods long at least, and LEAST words.
REPEATS, LEAST = 4, 6
#: Cost estimates in nanoseconds: a transform (and per value of it), a step over differences, one difference.
TRANSFORM, PER_VALUE, STEP, DIFFERENCE = 12_000, 12, 9_000, 5
#: From so many words on a stride is tried before a lag is scanned.
LONG = 4096
RUNS = ["n_runs", "runs", "collapsed"]


def need(q: int) -> int:
    """Consecutive matches at lag q in the shortest run with that period."""
    return max(LEAST, REPEATS * q) - q


@lru_cache(maxsize=4096)
def _divisors(q: int) -> tuple[int, ...]:
    """q divided by each of its primes: a smaller period of a run divides one of these."""
    out, rest, p = [], q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return tuple(out)


def _length(n: int) -> int:
    """The least length from n on that has no prime factor above 5."""
    best = 1 << (n - 1).bit_length()
    five = 1
    while five < best:
        three = five
        while three < best:
            best = min(best, three << max(0, (-(-n // three) - 1).bit_length()))
            three *= 3
        five *= 5
    return best


def lag_matches(ids: np.ndarray, most: int) -> np.ndarray:
    """How many places hold the same word as the place q further on, for q up to ``most`` (index 0 means nothing)."""
    out = np.zeros(most + 1, dtype=np.int64)
    uses = np.bincount(ids)
    order = np.argsort(-uses, kind="stable")
    f = uses[order]
    f = f[f > 1]
    if not len(f):
        return out
    size = _length(len(ids) + most)
    one = TRANSFORM + PER_VALUE * size
    pairs = np.cumsum((f[::-1].astype(np.float64) ** 2))[::-1]
    light = np.r_[f * STEP + pairs * DIFFERENCE, 0]  # cost of all words from the h-th on, if those before are transformed
    heavy = int(np.argmin(light + np.arange(len(light)) * one + (np.arange(len(light)) > 0) * one))
    rank = np.empty(len(uses), dtype=np.int64)
    rank[order] = np.arange(len(uses))
    word = rank[ids]
    if heavy:
        power = np.zeros(size // 2 + 1)
        for w in range(heavy):
            x = np.fft.rfft(word == w, size)
            power += x.real**2 + x.imag**2
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    at = np.flatnonzero((word >= heavy) & (word < len(f)))
    at = at[np.argsort(word[at], kind="stable")]
    word = word[at]
    left = np.cumsum(f[heavy:])  # places of the light words up to each, most frequent first
    k = 1
    while (words := int(np.searchsorted(-f[heavy:], -k))) > 0:
        end = int(left[words - 1])
        d = (at[k:end] - at[: end - k])[word[k:end] == word[: end - k]]
        d = d[d <= most]
        if len(d):
            most_here = int(d.max())
            out[: most_here + 1] += np.bincount(d)
        k += 1
    return out


def _stands_alone(ids: np.ndarray, q: int) -> bool:
    """No three matches in a row at a stride that every long enough island holds three times."""
    stride = need(q) // 3
    a, b = ids[:-q:stride], ids[q::stride]
    hit = a == b
    return len(hit) < 3 or not (hit[:-2] & hit[1:-1] & hit[2:]).any()


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, out = len(ids), []
    most = n // REPEATS
    if n < LEAST:
        return out
    matches = lag_matches(ids, most)
    lags = np.arange(most + 1)
    enough = np.maximum(LEAST, REPEATS * lags) - lags
    for q in np.flatnonzero((matches >= enough) & (lags > 0)).tolist():
        if n >= LONG and _stands_alone(ids, q):
            continue
        same = np.zeros(n - q + 2, dtype=np.int8)
        same[1:-1] = ids[q:] == ids[:-q]
        edge = np.flatnonzero(np.diff(same))
        starts, ends = edge[::2], edge[1::2]
        whole = ends - starts >= need(q)
        for s, e in zip(starts[whole].tolist(), ends[whole].tolist()):
            e += q
            if not any((ids[s : e - d] == ids[s + d : e]).all() for d in _divisors(q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _one(text: str | None) -> tuple:
    words = (text or "").encode("utf-8").split()
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    runs = find_runs(ids)
    if runs:
        stays = np.ones(len(words), dtype=bool)
        for s, length, q in runs:
            stays[s + q : s + length] = False
        words = [w for w, k in zip(words, stays.tolist()) if k]
    return [r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs], b" ".join(words).decode("utf-8")


def collapsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, plus n_runs, ``runs`` (array of start, length, period) and the ``collapsed`` text.

    A word is left out of the collapsed text if a run holds it after that run's first period.
    """

    @F.pandas_udf("struct<start:array<long>,length:array<long>,period:array<long>,collapsed:string>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([_one(t) for t in s], columns=["start", "length", "period", "collapsed"])

    d = wrapped(docs, text, keep=False).select("_doc", f("_text").alias("_runs")).select("_doc", "_runs.*")
    d = d.select("_doc", F.size("start").cast("long").alias("n_runs"), F.arrays_zip("start", "length", "period").alias("runs"), "collapsed")
    return unwrapped(d, docs, RUNS, [text])


def rewritten(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by a digest of its doc_id, made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("dealt"))
    d = d.withColumn("w", F.when(F.col("dealt"), words_of(F.col("text"))))
    n = F.size("w").cast("long")
    d = d.withColumn("a", F.when(n > 0, F.col("g") % n))
    d = d.withColumn("p", F.floor((n - F.col("a")) / (F.col("g") % 8 + 3)).cast("long") + 1)
    tail = F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op11(docs: DataFrame) -> DataFrame:
    d = collapsed(rewritten(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    d = d.withColumn("best", best)
    return d.select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
