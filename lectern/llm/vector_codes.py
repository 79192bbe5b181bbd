"""Vector codes with codebooks kept up by differences (Lloyd's rounds on parts of vectors).

Every vector is cut into parts, and a part's code is the nearest entry of that position's codebook.  Rows carry their
last codes from round to round in a persisted table whose lineage is one narrow step a round, so a lost executor costs its own
partitions only.  Sums and counts of all entries are kept as well: a round assigns anew, and only parts whose
code changed send their components, once less for the old entry and once more for the new one.  Those are added up before
the shuffle, so a task sends as many rows as there are components in the codebooks, and less work each round.

Codebooks and sums are ``entries`` x dimension integers; nothing else passes the driver.

Arithmetic is exact: components are integers, distances are taken in doubles where all of them stay below 2**53 and in
Python's integers otherwise, and sums in decimals where longs might not do.

Defined results: null vectors and vectors with null or non-finite components are dropped, as are empty ones and those of
another length than the first kept row in order of the key (null keys last, equal keys by vector).  Components of 2**63 and more
in size are taken as that, and so are errors.  Parts are as equal as the length allows (an empty part has code 0).
With fewer rows than entries, there are as many entries as rows.  Repeated rows count each; extra columns pass through unless
named like a result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import checkpointed

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = (1 << 63) - 1
#: Totals of so many labels are broadcast (under 4 MB); of more, only those that hold over a thousandth of the rows.
BROADCAST_LABELS = 50_000

#: A codebook: its entries, each a list of integers.  ``Books`` has one for every part.
Books = list[list[list[int]]]


def whole_numbers(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of all components; null where the vector does not count."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    return F.when(finite & (F.size(v) > 0), F.transform(v, lambda x: F.floor(x * scale)))


def cuts(dimension: int, parts: int) -> list[int]:
    return [k * dimension // parts for k in range(parts + 1)]


def _nearest(x: np.ndarray, book: list[list[int]], exact_doubles: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equals) and its squared distance."""
    kind = np.float64 if exact_doubles else object
    x, c = x.astype(kind), np.array(book, dtype=kind).reshape(len(book), x.shape[1])
    if exact_doubles:
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    else:
        d = np.array([[sum((a - b) ** 2 for a, b in zip(r, e)) for e in c.tolist()] for r in x.tolist()], dtype=object).reshape(len(x), len(book))
    at = np.argmin(d, axis=1) if len(d) else np.zeros(0, dtype=np.int64)
    return at.astype(np.uint8), d[np.arange(len(d)), at]


def _assign(books: Books, bounds: list[int], exact_doubles: bool):
    """(_doc, v, code) to (_doc, v, old, code, error), batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, bounds[-1])
            found = [_nearest(x[:, s:e], book, exact_doubles) for book, s, e in zip(books, bounds, bounds[1:])]
            codes = np.stack([f[0] for f in found], axis=1)
            error = sum(f[1] for f in found)
            error = error.astype(np.int64) if exact_doubles else [min(int(e), LARGEST) for e in error]
            code = pa.array([c.tobytes() for c in codes], type=pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("_doc"), b.column("v"), b.column("code"), code, pa.array(error, type=pa.int64())], names=["_doc", "v", "old", "code", "error"]
            )

    return run


def moved(state: DataFrame, bounds: list[int], sum_type: str) -> DataFrame:
    """(part, entry, place, n, total): what changed parts take from their old entry and bring to the new one."""
    parts = len(bounds) - 1
    byte = lambda c: F.substring(F.col(c), F.col("part") + 1, F.lit(1))
    d = state.where(~F.col("old").eqNullSafe(F.col("code"))).select("v", "old", "code", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    edge = F.array(*map(F.lit, bounds))
    first, end = F.get(edge, F.col("part")), F.get(edge, F.col("part") + 1)
    d = d.select("part", byte("old").alias("old"), byte("code").alias("new"), F.slice("v", first + 1, end - first).alias("x")).where(~F.col("old").eqNullSafe(F.col("new")))
    signs = F.array(F.struct(F.col("new").alias("entry"), F.lit(1).alias("n")), F.struct(F.col("old").alias("entry"), F.lit(-1).alias("n")))
    d = d.select("part", "x", F.explode(F.filter(signs, lambda s: s["entry"].isNotNull())).alias("s"))
    d = d.select("part", "s.entry", "s.n", F.posexplode("x").alias("place", "value"))
    value = F.col("value").cast(sum_type)
    return d.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 0, value).otherwise(-value)).alias("total"))


def compressed(df: DataFrame, vector: str, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """The kept rows without their vector, plus ``code`` (a byte for each part) and ``error`` (squared, over all parts), and the codebooks."""
    assert entries <= 256, "a code is one byte"
    columns = [c for c in df.columns if c not in (vector, "code", "error")]
    kept = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != vector)).alias("_doc"), whole_numbers(vector).alias("v")).where("v is not null")
    order = (F.col("_doc").getField(key).asc_nulls_last(), F.col("v").asc())
    first = kept.orderBy(*order).limit(entries).select("v").collect()
    dimension = len(first[0]["v"]) if first else parts
    kept = kept.where(F.size("v") == dimension)
    if len({len(r["v"]) for r in first}) > 1:
        first = kept.orderBy(*order).limit(entries).select("v").collect()
    bounds = cuts(dimension, parts)
    books: Books = [[list(r["v"][s:e]) for r in first] for s, e in zip(bounds, bounds[1:])]

    state = kept.select("_doc", "v", F.lit(None).cast("binary").alias("code"))
    size, rows = state.agg(F.max(F.greatest(F.array_max("v"), -(F.array_min("v") + 1))), F.count("*")).first()
    size = (size or 0) + 1
    exact_doubles = (2 * size) ** 2 * max(e - s for s, e in zip(bounds, bounds[1:])) * 4 <= 1 << 53
    sum_type = "long" if size * max(1, rows) < 1 << 62 else "decimal(38,0)"
    if size < 1 << 31:
        state = state.withColumn("v", F.col("v").cast("array<int>"))
    fields = state.schema
    schema = StructType([fields["_doc"], fields["v"], StructField("old", BinaryType()), StructField("code", BinaryType()), StructField("error", LongType())])
    counts: dict[tuple[int, int], int] = {}
    sums: dict[tuple[int, int], list[int]] = {}
    last = None
    for k in range(rounds + 1):
        state = state.select("_doc", "v", "code").mapInArrow(_assign([list(b) for b in books], bounds, exact_doubles), schema)
        if k < rounds:
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
            for r in moved(state, bounds, sum_type).collect():
                part, entry = r["part"], r["entry"][0]
                sums.setdefault((part, entry), [0] * (bounds[part + 1] - bounds[part]))[r["place"]] += int(r["total"])
                if r["place"] == 0:  # every place has the same count
                    counts[part, entry] = counts.get((part, entry), 0) + r["n"]
            for (part, entry), n in counts.items():
                if n:
                    books[part][entry] = [t // n for t in sums[part, entry]]
            if last is not None:
                last.unpersist()
            last = state
    out = checkpointed(state.select(*(F.col("_doc").getField(c).alias(c) for c in columns), "code", "error"))
    if last is not None:
        last.unpersist()
    return out, books


def decoded(coded: DataFrame, books: Books, into: str = "vector", scale: int = SCALE) -> DataFrame:
    """``coded`` plus the vectors that its codes stand for."""
    place = lambda k: F.conv(F.hex(F.substring("code", k + 1, 1)), 16, 10).cast("int")
    table = [F.array(*(F.array(*(F.lit(c / scale) for c in entry)).cast("array<double>") for entry in book)) for book in books]
    return coded.withColumn(into, F.concat(*(F.get(t, place(k)) for k, t in enumerate(table))))


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def with_totals(rows: DataFrame, label: str, value: str, into: str, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """``rows`` plus the sum of ``value`` over all rows of the same label (nulls are one label), as a long at most LARGEST.

    Totals are few, or else only those of labels with over a thousandth of the rows are broadcast (so under a thousand); the rows of
    these are dealt evenly in the join with the others.
    """
    totals = checkpointed(rows.groupBy(F.col(label).alias("_label")).agg(F.sum(F.col(value).cast("decimal(38,0)")).alias("_total"), F.count("*").alias("_n")))
    n, labels = totals.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    totals = totals.select("_label", F.least(F.col("_total"), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias(into), "_n")
    same = lambda a, b: a[label].eqNullSafe(b["_label"])
    if labels <= broadcast_labels:
        few = totals.drop("_n")
        return rows.join(F.broadcast(few), same(rows, few), "left").drop("_label")
    hot = totals.where(F.col("_n") * 1000 > n).select("_label", F.col(into).alias("_hot"))
    d = rows.join(F.broadcast(hot), same(rows, hot), "left").drop("_label")
    d = d.withColumn("_deal", F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns)))
    cold = totals.where(F.col("_n") * 1000 <= n).select("_label", F.col(into).alias("_cold"), F.lit(None).cast("long").alias("_none"))
    d = d.join(cold, same(d, cold) & d["_deal"].eqNullSafe(cold["_none"]), "left")
    return d.select(*rows.columns, F.coalesce("_hot", "_cold").alias(into))


def op12(embeddings: DataFrame) -> DataFrame:
    d, books = compressed(embeddings.select("vec_id", "label", "embedding"), "embedding", "vec_id")
    d = with_totals(d, "label", "error", "label_error")
    return d.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(dimension: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """SQL for vectors of one known length with unique keys; a common table expression for each round."""
    width = dimension // parts
    first = f"""
k AS (SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT i, (j - 1) // {width} AS p, (j - 1) % {width} AS q, floor({SCALE} * e[j]::DOUBLE)::BIGINT AS v FROM k, range(1, {dimension + 1}) r(j)),
c0 AS MATERIALIZED (SELECT i AS c, p, q, v FROM x WHERE i < {entries})"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT x.i, x.p, c.c, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c USING (p, q) GROUP BY x.i, x.p, c.c),
a{r} AS MATERIALIZED (SELECT i, p, arg_min(c, d * 256 + c) AS c, min(d) AS d FROM d{r} GROUP BY i, p)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT p, q, c, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM x JOIN a{r} USING (i, p) GROUP BY p, q, c),
c{r + 1} AS MATERIALIZED (SELECT c.c, p, q, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (c, p, q))""")
    last = f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, c, q)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN (SELECT i, string_agg(printf('%02x', c), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY i) USING (i)"""
    return "WITH" + ",".join([first, *steps]) + last
