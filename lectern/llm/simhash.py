"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is read as a ring of four 16-bit segments.  If two fingerprints differ in at
most 3 bits, then some segment starts a chain whose first j segments differ in at most
floor(3 * j / 4) bits in all, for every j: 0, 1, 2 and 3.  The first three budgets make equality keys:
the first segment is the same, one half of the second is (one difference spoils one half), and one
third of the third is (two differences spoil two).  Every distinct fingerprint lies under its 4 x 2 x 3
keys of 29 or 30 bits; candidates share one, and the whole chain prunes them before the full Hamming distance
is counted.

Copies collapse first: only distinct fingerprints are compared, each with its smallest document.
A key under which many distinct fingerprints lie (a swarm of near copies) is not joined pair by pair:
its members are dealt into blocks, each pair of blocks is compared with bit counts in one bounded
task, and only as many edges as connect the same nodes are returned.  Either way no link is lost.

``near_copies`` is for looser similarities, where three of 64 bits find next to nothing (two texts with
0.8 of their shingles in common differ in about ten).  It reads a ring of four 64-bit segments over
shingles of five words; fingerprints link if at least 0.8 of the 256 bits agree.  No equality key on so
many flipped bits is selective, so candidates share a sampled key instead: one of BANDS digests of the
ROWS least shingle hashes under a multiplier (texts with a Jaccard similarity j share one with probability
near 1 - (1 - j ** ROWS) ** BANDS).  The ring's chain of cumulative budgets then prunes them, as above.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; texts of
fewer words than a shingle are one shingle; component ids are smallest non-null keys (null where a
group has none); repeated rows keep their own output rows; extra columns of ``docs`` pass through
``clustered`` unless they are called ``fingerprint`` or ``component_id``; an empty table gives an
empty result.  ``near_copies`` returns whole rows of ``docs``, extra columns of any name included; texts
without words are copies of each other; of rows alike in key and text one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, hold
from .components import components

SHINGLE, SEED = 3, 42
SEGMENTS, WIDTH, DISTANCE = 4, 16, 3
#: First bit and width of the thirds of a segment.
THIRDS = ((0, 5), (5, 5), (10, 6))
#: Keys with more distinct fingerprints than this are compared in blocks.
DENSE, BLOCK = 64, 2048
CHUNK = 255 * 256
HOT_SHARE = 1000
#: Near copies: words of a shingle, share of equal bits, 64-bit segments, and sampled keys (each of ROWS hashes).
NEAR_SHINGLE, SIMILARITY, LANES, BANDS, ROWS = 5, 0.8, 4, 16, 4
#: Odd multipliers that order the shingle hashes anew for each band, and the step from lane to lane.
ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(BANDS)], dtype=np.uint64)
STEP = 0xD1B54A32D192ED03
#: Distinct fingerprints whose keys one task deals out or compares.
NODES_PER_TASK = 100_000
#: Column that holds a row's fingerprint on the way.
PRINT = "_simhash64"


def _hashed(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, in chunks; nothing for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) > words else iter((b" ".join(w),))
    while len(h := np.fromiter((xxh64_intdigest(s, SEED) for s in islice(shingles, CHUNK)), dtype=np.uint64)):
        yield h


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64)
    whole = len(h) // 255 * 255
    ones = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return ones + bits[whole:].sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, total: int) -> int:
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint: bit b is set if over half of the shingle hashes have it."""
    total, ones = 0, np.zeros(64, dtype=np.int64)
    for h in _hashed(text, words):
        total += len(h)
        ones += _ones(h)
    return _majority(ones, total)


def _lane(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes themselves, or well mixed further ones of them."""
    if not k:
        return h
    x = h + np.uint64(STEP * k % (1 << 64))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sketch(text: str | None, words: int = NEAR_SHINGLE) -> tuple[list[int], list[int]]:
    """LANES fingerprints of 64 bits of the distinct shingles, and the keys that near copies are likely to share.

    The first key is of the fingerprints themselves, so equal ones always meet.
    """
    h = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *map(np.unique, _hashed(text, words))]))
    ones = np.zeros((LANES, 64), dtype=np.int64)
    for at in range(0, len(h), CHUNK):
        for k in range(LANES):
            ones[k] += _ones(_lane(h[at : at + CHUNK], k))
    prints = [_majority(x, len(h)) for x in ones]
    keys = [xxh64_intdigest(np.array(prints, dtype=np.int64).tobytes(), SEED)]
    for band, odd in enumerate(ODD[:BANDS] if len(h) else (), 1):
        x = h * odd  # odd multipliers keep distinct hashes distinct
        least = np.sort(np.partition(x, ROWS - 1)[:ROWS] if len(x) > ROWS else x)
        keys.append(xxh64_intdigest(least.tobytes(), band))
    return prints, [k - (1 << 64) if k >> 63 else k for k in keys]


def fingerprints(words: int = SHINGLE):
    """Arrow-batched UDF: text to fingerprint."""

    @F.pandas_udf("long")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold("simhash", lambda: None)
        for s in batches:
            yield pd.Series([fingerprint(t, words) for t in s], dtype="int64")

    return f


def _bits(fp: Column, at: int, width: int) -> Column:
    """``width`` bits of a fingerprint, ``at`` places after the highest one."""
    return F.shiftrightunsigned(fp, 64 - at - width).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column) -> Column:
    """Array of the keys of a fingerprint: which parts it names, then their bits."""
    out = []
    for i in range(SEGMENTS):
        first, second, third = (WIDTH * ((i + j) % SEGMENTS) for j in range(3))
        for half in range(2):
            for at, width in THIRDS:
                key = F.lit(len(out)).cast("long")
                for start, n in ((first, WIDTH), (second + half * WIDTH // 2, WIDTH // 2), (third + at, width)):
                    key = F.shiftleft(key, n).bitwiseOR(_bits(fp, start, n))
                out.append(key)
    return F.array(*out)


def ring_holds(differences: list[Column], budget: int) -> Column:
    """Whether some chain round the ring of segments keeps its budgets: j segments, floor(budget * j / segments) bits."""
    m = len(differences)
    chains = []
    for i in range(m):
        total, ok = F.lit(0), F.lit(True)
        for j in range(m):
            total = total + differences[(i + j) % m]
            ok = ok & (total <= budget * (j + 1) // m)
        chains.append(ok)
    out = chains[0]
    for c in chains[1:]:
        out = out | c
    return out


def chain_holds(a: Column, b: Column) -> Column:
    """``ring_holds`` for two fingerprints of 64 bits."""
    d = a.bitwiseXOR(b)
    return ring_holds([F.bit_count(_bits(d, WIDTH * i, WIDTH)) for i in range(SEGMENTS)], DISTANCE)


def _stars(left: pd.DataFrame, right: pd.DataFrame, lanes: list[str], most: int) -> pd.DataFrame:
    """Edges that connect what the links between two sets of nodes connect: each node to the least one of its component.

    The same least node tends to come out of many keys, so these edges repeat where those of a spanning forest would differ.
    """
    nodes = np.unique(np.concatenate([left["id"], right["id"]]).astype(np.int64))
    label = np.arange(len(nodes))
    if len(left) and len(right):
        bits = lambda x: x[lanes].to_numpy(np.int64).astype(np.uint64)  # noqa: E731  of negative numbers, numpy counts the bits of the absolute value
        others, there = bits(right), np.searchsorted(nodes, right["id"].to_numpy(np.int64))
        for here, mine in zip(np.searchsorted(nodes, left["id"].to_numpy(np.int64)), bits(left)):
            near = there[np.bitwise_count(others ^ mine).sum(axis=1, dtype=np.int64) <= most]
            met = np.unique(np.append(label[near], label[here]))
            for x in met[1:]:  # at most one merge for each node
                label[label == x] = met[0]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[label[moved]]})


def _linked(nodes: DataFrame, keys: Column, lanes: list[str], holds, most: int) -> DataFrame:
    """(a, b): ids of ``nodes`` that share a key and hold; all such links, or where a key is dense as many edges as connect the same nodes.

    One shuffle deals the keys out; counting them and both sides of the join use it as it lies.
    """
    conf = nodes.sparkSession.conf
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), nodes.count() // NODES_PER_TASK)
    keyed = nodes.select("id", *lanes, F.explode(keys).alias("key")).repartition(parts, "key")
    n = keyed.groupBy("key").agg(F.count("*").alias("n"))
    some = keyed.join(n.where(F.col("n").between(2, DENSE)).drop("n"), "key")
    side = lambda x: some.select("key", F.col("id").alias(x), *(F.col(c).alias(x + c) for c in lanes))
    pairs = side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & holds([F.col("a" + c) for c in lanes], [F.col("b" + c) for c in lanes]))
    # A member of a dense key lies in one block and meets every block from its own on.
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
    dense = keyed.join(n.where(F.col("n") > DENSE).withColumn("nb", blocks).drop("n"), "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")))
    columns = [F.col(c).alias(c) for c in ("key", "id", *lanes)]  # new columns, so that both sides can be told apart
    left = dense.select(*columns, F.col("block").alias("i"), F.explode(F.sequence("block", F.col("nb") - 1)).alias("j"))
    right = dense.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"))
    stars = lambda x, y: _stars(x, y, lanes, most)
    return pairs.select("a", "b").unionByName(
        left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInPandas(stars, "a long, b long")
    )


def links(prints: DataFrame) -> DataFrame:
    """(a, b) pairs of the distinct fingerprints ``fp``, at most DISTANCE bits apart, or edges that connect the same ones."""

    def holds(a: list[Column], b: list[Column]) -> Column:
        return chain_holds(a[0], b[0]) & (F.bit_count(a[0].bitwiseXOR(b[0])) <= DISTANCE)

    return _linked(prints.select(F.col("fp").alias("id"), "fp"), _keys(F.col("fp")), ["fp"], holds, DISTANCE)


def clustered(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, plus ``fingerprint`` (hex) and ``component_id``."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "fingerprint", "component_id")]
    rows = docs.select(F.struct(*keep).alias("_doc"), F.col(f"`{key}`").alias("_key"), fingerprints(words)(F.col(f"`{text}`")).alias(PRINT))
    rows = checkpointed(rows)
    prints = rows.groupBy(F.col(PRINT).alias("fp")).agg(F.min("_key").alias("least"), F.count("*").alias("n"))
    found = components(links(prints))
    with_root = prints.join(found.withColumnRenamed("node", "fp"), "fp")
    least = with_root.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = with_root.join(least, "root").select("fp", "component_id")
    classes = prints.join(joined, "fp", "left").select(F.col("fp").alias(PRINT), F.coalesce("component_id", "least").alias("component_id"), "n")
    # Fingerprints that hold more than one row in HOT_SHARE are fewer than HOT_SHARE: those are broadcast.
    is_hot = F.col("n") * HOT_SHARE > rows.count()
    hot = F.broadcast(classes.where(is_hot).drop("n"))
    known = F.broadcast(prints.where(is_hot).select(F.col("fp").alias(PRINT)))
    rest = rows.join(known, PRINT, "left_anti").join(classes.where(~is_hot).drop("n"), PRINT)
    out = rows.join(hot, PRINT).unionByName(rest)
    return out.select("_doc.*", F.lower(F.lpad(F.hex(PRINT), 16, "0")).alias("fingerprint"), "component_id")


def sketches(words: int = NEAR_SHINGLE):
    """Arrow-batched UDF: text to fingerprints p0, p1 ... and sampled keys."""
    lanes = [f"p{k}" for k in range(LANES)]

    @F.pandas_udf(f"struct<{','.join(f'{c}:long' for c in lanes)},keys:array<long>>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hold("simhash", lambda: None)
        for s in batches:
            yield pd.DataFrame([(*p, k) for p, k in (sketch(t, words) for t in s)], columns=[*lanes, "keys"]).astype(dict.fromkeys(lanes, "int64"))

    return f


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, digest) of the one document that stays of each group: the smallest key, then the smallest digest of a text.

    Texts link if they share a sampled key and at least ``similarity`` of their bits; groups are the connected components.
    """
    lanes = [f"p{k}" for k in range(LANES)]
    most = int((1 - similarity) * 64 * LANES + 1e-9)
    me = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("digest"))
    s = docs.select(me.alias("me"), sketches(words)(F.col(f"`{text}`")).alias("s")).select("me", "s.*")
    nodes = s.groupBy(*lanes, "keys").agg(F.min("me").alias("least"))
    nodes = checkpointed(nodes.withColumn("id", F.monotonically_increasing_id()))

    def holds(a: list[Column], b: list[Column]) -> Column:
        return ring_holds([F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)], most)

    found = components(_linked(nodes, F.col("keys"), lanes, holds, most))
    groups = nodes.select("id", "least").join(found.withColumnRenamed("node", "id"), "id", "left")
    out = groups.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("least").alias("least"))
    return out.select(F.col("least.key").alias(key), F.col("least.digest").alias("digest"))


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near copies."""
    stays = near_copies(docs, key, text, words, similarity).select(F.col(key).alias("_key"), F.col("digest").alias("_digest"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    rows = docs.select(whole, F.col(f"`{key}`").alias("_k"), F.xxhash64(F.col(f"`{text}`")).alias("_d"))
    kept = rows.join(stays, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_d") == F.col("_digest")), "left_semi")
    return kept.groupBy("_k", "_d").agg(F.first("_doc").alias("_doc")).select("_doc.*")  # rows alike in key and text


def op7(docs: DataFrame) -> DataFrame:
    return clustered(docs.select("doc_id", "text"))
