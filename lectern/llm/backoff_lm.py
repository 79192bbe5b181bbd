"""Stupid-backoff language model scores, computed relationally over columnar blocks.

Counts of the n-grams up to an order over all documents are tables partitioned by hash.  A text's score is the sum over
its words of ln S(w | history): c(history w) / c(history) if that n-gram was counted at least ``MIN_COUNT`` times,
0.4 * S(w | history without its first word) otherwise, and c(w) / N without any history.  A document's own
n-grams are among those counted, so what was counted once is seen nowhere else and backs off.

A row per word and pair would be 30 bytes each on its way through two shuffles, several times the
input.  So rows are blocks: a task turns some millions of words into one row that holds the distinct word hashes and
the texts as indices into them.  A block's exploded n-grams are sorted, counted inside the block, and cut
by hash into buckets; a bucket meets the same bucket of all other blocks, the counts are added up (that
is one partition of the count table), and every block gets back the totals of exactly its n-grams.
Joined with its texts again, a block sums the scores of its documents.

A frequent n-gram is one entry per block, so no bucket is hot; the number of buckets follows the number of
words, so a bucket stays near ``BUCKET_WORDS`` words.

Defined results: documents without words have score null and 0 words; every row is a document of
its own, also with a repeated or null doc_id; pairs never cross rows; extra columns are not returned; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed

BACKOFF, MIN_COUNT, ORDER = 0.4, 2, 2
#: Words in a block, and words of all documents for each bucket.
BLOCK_WORDS, BUCKET_WORDS = 2_000_000, 1_500_000
PAIR = np.uint64(0x9E3779B97F4A7C15)
BLOCK = "block long, docs array<long>, sizes array<int>, words binary, places binary"
PIECE = "tab int, bucket long, block long, n int, keys binary, counts binary"
ANSWER = "block long, tab int, bucket long, n int, counts binary"


def _packed(x: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpacked(b: bytes, n: int, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(b)), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, n).T).view(dtype).ravel()


def _steps(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


def _block(number: int, docs: list, texts: list[list[bytes]]) -> tuple:
    index: dict[bytes, int] = {}
    seen = np.fromiter((index.setdefault(w, len(index)) for t in texts for w in t), dtype=np.int64)
    hashes = np.fromiter(map(xxh64_intdigest, index), dtype=np.uint64, count=len(index))
    often = np.argsort(-np.bincount(seen, minlength=len(index)), kind="stable")  # small numbers for frequent words
    rank = np.empty(len(index), dtype=np.uint32)
    rank[often] = np.arange(len(index), dtype=np.uint32)
    return number, docs, [len(t) for t in texts], hashes[often].tobytes(), _packed(rank[seen]) if len(seen) else b""


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    docs, texts, n = [], [], 0

    def row():
        return pd.DataFrame([_block(number, docs, texts)], columns=["block", "docs", "sizes", "words", "places"])

    for b in batches:
        for d, t in zip(b["doc_id"], b["t"]):
            docs.append(None if pd.isna(d) else int(d))
            texts.append((t or "").encode("utf-8", "surrogatepass").split())
            n += len(texts[-1])
            if n >= BLOCK_WORDS:
                yield row()
                docs, texts, n = [], [], 0
                number += 1
    if docs:
        yield row()


class _Grams:
    """Words, n-grams and documents of a block row."""

    def __init__(self, row):
        self.sizes = np.asarray(row.sizes, dtype=np.int64)
        total = int(self.sizes.sum())
        self.words = np.frombuffer(bytes(row.words), dtype=np.uint64)
        self.places = _unpacked(row.places, total, np.uint32).astype(np.int64) if total else np.zeros(0, dtype=np.int64)
        self.nth = np.arange(total, dtype=np.int32) - np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)

    def keys(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, where, keys): for n from 2, which words end an n-gram of their document, and the keys of those."""
        x = h = self.words[self.places]
        for n in range(2, order + 1):
            x = np.roll(x, 1) * PAIR + h
            x ^= x >> np.uint64(29)
            x *= PAIR
            whole = self.nth >= n - 1
            yield n, whole, x[whole]


def _cut(tab: int, block: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple]:
    """Slices of sorted keys by their upper bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else []
    for a, b in zip(at, [*at[1:], len(keys)]):
        yield tab, int(bucket[a]), block, int(b - a), _packed(_steps(keys[a:b])), _packed(counts[a:b].astype(np.uint32))


def _exploded(bits: int, order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                g = _Grams(row)
                by_hash = np.argsort(g.words)
                counts = np.bincount(g.places, minlength=len(g.words))
                out = list(_cut(1, row.block, g.words[by_hash], counts[by_hash], bits))
                for n, _, keys in g.keys(order):
                    out += _cut(n, row.block, *np.unique(keys, return_counts=True), bits)
                yield pd.DataFrame(out, columns=["tab", "bucket", "block", "n", "keys", "counts"])

    return run


def _totals(pieces: pd.DataFrame) -> pd.DataFrame:
    """One partition of a count table, and for every block the totals of its keys."""
    keys = [np.cumsum(_unpacked(k, n, np.uint64), dtype=np.uint64) for k, n in zip(pieces["keys"], pieces["n"])]
    counts = [_unpacked(c, n, np.uint32) for c, n in zip(pieces["counts"], pieces["n"])]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)
    ends = np.cumsum(pieces["n"].to_numpy())
    answers = [_packed(total[at[e - n : e]]) for e, n in zip(ends, pieces["n"])]
    return pieces[["block", "tab", "bucket", "n"]].assign(counts=answers)


def _scores(total: int, order: int):
    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in block.itertuples():
            g = _Grams(row)
            known = {
                t: np.concatenate([_unpacked(c, n, np.uint64) for c, n in zip(a["counts"], a["n"])]).astype(np.float64)
                for t, a in answers.sort_values("bucket").groupby("tab")
            }
            scores = np.zeros(len(g.sizes))
            if len(g.places):
                word = np.empty(len(g.words))
                word[np.argsort(g.words)] = known[1]
                history = word[g.places]
                value = np.log(history / total)
                for n, whole, keys in g.keys(order):
                    c = np.zeros(len(value))
                    if len(keys):
                        c[whole] = known[n][np.unique(keys, return_inverse=True)[1]]
                    value[whole] += math.log(BACKOFF)
                    met = c >= MIN_COUNT
                    value[met] = np.log(c[met] / np.roll(history, 1)[met])
                    history = c
                some = g.sizes > 0
                starts = (np.cumsum(g.sizes) - g.sizes)[some]
                scores[some] = np.add.reduceat(value, starts)
            out.append(pd.DataFrame({"doc_id": pd.array(list(row.docs), dtype="Int64"), "n_words": g.sizes, "s": scores}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": pd.array([], dtype="Int64"), "n_words": [], "s": []})

    return run


def scored(docs: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, score, per_word): sum and mean of ln S over the words of each row, with n-grams up to ``order``."""
    blocks = checkpointed(docs.select("doc_id", F.col(text).alias("t")).mapInPandas(_blocks, BLOCK))
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / BUCKET_WORDS))))
    pieces = blocks.mapInPandas(_exploded(bits, order), PIECE)
    answers = pieces.groupBy("tab", "bucket").applyInPandas(_totals, ANSWER)
    d = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_scores(total, order), "doc_id long, n_words long, s double")
    score = F.when(F.col("n_words") > 0, F.col("s"))
    return d.select("doc_id", "n_words", F.round(score, 4).alias("score"), F.round(score / F.col("n_words"), 6).alias("per_word"))


def op9(docs: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
g AS (SELECT rid, x, lag(x) OVER (PARTITION BY rid ORDER BY i) AS u FROM t),
one AS (SELECT x, count(*)::DOUBLE AS n FROM t GROUP BY x),
two AS (SELECT u, x, count(*)::DOUBLE AS n FROM g WHERE u IS NOT NULL GROUP BY u, x),
n AS (SELECT count(*)::DOUBLE AS total FROM t),
s AS (
  SELECT rid, sum(CASE WHEN g.u IS NULL THEN ln(a.n / total) WHEN two.n >= 2 THEN ln(two.n / b.n) ELSE ln(0.4::DOUBLE * a.n / total) END) AS s
  FROM g JOIN one a ON a.x = g.x CROSS JOIN n LEFT JOIN one b ON b.x = g.u LEFT JOIN two ON two.u = g.u AND two.x = g.x GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, round(s, 4) AS score, round(s / len(w), 6) AS per_word FROM d LEFT JOIN s USING (rid)
"""
