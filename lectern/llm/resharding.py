"""Minimum-cost-flow resharding.

From the bytes in each old shard and the capacities of the new ones, a minimum-cost flow says how many
bytes go from which old shard to which new one; keeping a byte in its place is free and moving one costs
1 (or what a cost matrix says), so the flow moves the fewest bytes.  The flow problem has one node per
shard, whatever the size of the data.

Rows follow the flow through blocks: each old shard is laid out by hash in a fixed number of blocks
whose bytes are summed in Spark (a table of shards x blocks rows); a row's place is its block's offset
plus the running bytes before it inside its block, and the flow cuts each old shard's places into one
interval per destination.  Windows are inside blocks only, so a hot old shard is spread over its blocks; where
the caller can name a row (``row``: its file and its number there), rows of one key are spread too.

Texts do not follow those windows.  ``rewrite_affected`` gets from them the first row of each interval in each
block, a table of bounded size, finds every row's new shard by it while it reads, and moves a text once.

Law: ``bytes``.  A row goes where its middle byte falls, so a new shard differs from its
capacity by at most half a row at each end of its few intervals.

Defined results: a null text counts 8 bytes and its crc32 is 0; repeated rows each get a slot (rows alike in
all that names them take neighbouring places, and are written together); extra columns of ``docs`` are
not returned by ``assign`` and are written by ``rewrite_affected``; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, shared_folder

OLD_SHARDS, NEW_SHARDS, BLOCKS = 16, 24, 1024
ROW_BYTES = 8


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Flow i -> j that ships every supply within the capacities at least cost.

    Successive shortest paths with potentials; costs are not negative, capacities suffice.
    """
    n, m = len(supply), len(capacity)
    assert sum(supply) <= sum(capacity), "the new shards are too small"
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    pot = [0] * (n + m)
    while any(left):
        dist: list[float] = [0 if v < n and left[v] else float("inf") for v in range(n + m)]
        back: list[int] = [-1] * (n + m)
        heap = [(0, v) for v in range(n) if left[v]]
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            if v < n:
                steps = ((n + j, cost[v][j]) for j in range(m))
            else:
                steps = ((i, -cost[i][v - n]) for i in range(n) if flow.get((i, v - n)))
            for u, c in steps:
                if (e := d + c + pot[v] - pot[u]) < dist[u]:
                    dist[u], back[u] = e, v
                    heapq.heappush(heap, (e, u))
        end = min((v for v in range(n, n + m) if room[v - n]), key=lambda v: dist[v] + pot[v])
        far = max(d for d in dist if d < float("inf"))
        pot = [p + min(d, far) for p, d in zip(pot, dist)]
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        most = min(left[path[0]], room[end - n], *(flow[u, v - n] for v, u in zip(path, path[1:]) if v >= n))
        for v, u in zip(path, path[1:]):
            if v < n:
                flow[v, u - n] = flow.get((v, u - n), 0) + most
            else:
                flow[u, v - n] -= most
        left[path[0]] -= most
        room[end - n] -= most
    return {k: f for k, f in sorted(flow.items()) if f}


def fewest_moves(old: list[int], new: list[int]) -> dict[tuple[int, int], int]:
    return min_cost_flow(old, new, [[int(i != j) for j in range(len(new))] for i in range(len(old))])


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def sized(docs: DataFrame, old: Column, text: str = "text", key: str = "doc_id", row=()) -> DataFrame:
    """(doc_id, size, text_crc32, old, block, at): what deciding about a row needs.

    ``at`` is the row's place in the order of its block: two hashes of what names the row, or of its key and text.
    """
    return _placed(docs, old, text, key, row).select("doc_id", "size", "text_crc32", "old", "block", "at")


def _placed(docs: DataFrame, old: Column, text: str, key: str, row) -> DataFrame:
    """The columns of ``sized`` beside the whole row ``_doc``."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (key, *row)] + ([] if row else [t])
    h, g = F.xxhash64(*names, F.lit("block")), F.xxhash64(F.lit("place"), *names)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in row))
    return docs.select(
        whole.alias("_doc"), F.col(f"`{key}`").alias("doc_id"), (F.octet_length(t) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
        old.cast("int").alias("old"), F.pmod(h, F.lit(BLOCKS)).cast("int").alias("block"),
        F.struct(h.alias("h"), g.alias("g")).alias("at"),
    )


def _tables(spark: SparkSession, rows: DataFrame, capacities) -> tuple[DataFrame, DataFrame, dict]:
    """Offsets of blocks and cuts of old shards, from the summed blocks; both are of fixed size."""
    sums = rows.groupBy("old", "block").agg(F.sum("size").alias("n")).collect()
    n_old = max((r["old"] for r in sums), default=-1) + 1
    sizes = [[0] * BLOCKS for _ in range(n_old)]
    for r in sums:
        sizes[r["old"]][r["block"]] = r["n"]
    totals = [sum(x) for x in sizes]
    flow = fewest_moves(totals, capacities(sum(totals)))
    offsets = [(i, b, at - x) for i, row in enumerate(sizes) for b, (x, at) in enumerate(zip(row, accumulate(row))) if x]
    cuts = []
    for i in range(n_old):
        mine = sorted(((j != i, j, f) for (k, j), f in flow.items() if k == i))  # what stays comes first
        ends = list(accumulate(f for _, _, f in mine))
        cuts.append((i, ends[:-1], [j for _, j, _ in mine]))
    return (
        spark.createDataFrame(offsets, "old int, block int, offset long"),
        spark.createDataFrame(cuts, "old int, ends array<long>, dests array<int>"),
        flow,
    )


def assign(rows: DataFrame, shards: int = NEW_SHARDS) -> DataFrame:
    """``rows`` of ``sized`` plus ``shard`` and ``slot`` (gapless from 0 in each new shard)."""
    spark = rows.sparkSession
    rows = checkpointed(rows)
    offsets, cuts, _ = _tables(spark, rows, lambda total: equal_capacities(total, shards))
    run = Window.partitionBy("old", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("upto", F.sum("size").over(run))
    d = d.join(F.broadcast(offsets), ["old", "block"]).join(F.broadcast(cuts), "old")
    middle = 2 * (F.col("offset") + F.col("upto")) - F.col("size")
    d = d.withColumn("shard", F.get("dests", F.size(F.filter("ends", lambda e: middle >= 2 * e))))
    within = Window.partitionBy("old", "block", "shard").orderBy("at")
    d = checkpointed(d.withColumn("nth", F.row_number().over(within)).drop("upto", "offset", "ends", "dests"))
    pieces = d.groupBy("shard", "old", "block").agg(F.count("*").alias("n")).collect()
    starts, at = [], {}
    for r in sorted(pieces):
        starts.append((r["shard"], r["old"], r["block"], at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["n"]
    starts = spark.createDataFrame(starts, "shard int, old int, block int, start long")
    return d.join(F.broadcast(starts), ["shard", "old", "block"]).withColumn("slot", F.col("start") + F.col("nth") - 1).drop("start", "nth")


def rewrite_affected(docs: DataFrame, old: Column, assigned: DataFrame, out: str, text: str = "text", key: str = "doc_id", row=(), places: bool = False) -> DataFrame:
    """Writes what the transfers change, by new shard: rows received and the rest of shards that lost rows.

    Every row of a shard that loses rows is written once, with the column ``shard`` (a folder name) beside its own,
    and with ``_at`` if ``places`` are asked for.
    Files of shards that neither lose nor receive a row stay as they are, and so do those of a shard that only
    receives.  Returns (shard, action), one row per shard: ``untouched``, ``received`` (files beside
    the old ones) or ``rewritten`` (instead of them).
    """
    moved = assigned.where("shard != old")
    losing = moved.select(F.col("old").alias("shard")).distinct()
    gaining = moved.select("shard").distinct()
    # At most one row per block, and one more for each cut: shards x blocks and shards x shards at most.
    firsts = assigned.groupBy("old", "block", "shard").agg(F.min("at").alias("first")).groupBy("old", "block")
    firsts = firsts.agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("firsts"))
    d = _placed(docs, old, text, key, row).join(F.broadcast(losing.withColumnRenamed("shard", "old")), "old", "left_semi")
    d = d.join(F.broadcast(firsts), ["old", "block"])
    here = F.array_max(F.transform(F.filter("firsts", lambda x: x["first"] <= F.col("at")), lambda x: x["first"]))
    shard = F.get(F.filter("firsts", lambda x: x["first"] == F.col("_here")), F.lit(0))["shard"]
    d = d.withColumn("_here", here).select("_doc", "at", shard.alias("shard"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(parts, "shard", F.pmod(F.col("at.h"), F.lit(-(-parts // NEW_SHARDS))))  # few tasks for a shard, and few shards in a task
    d.select("_doc.*", *([F.col("at").alias("_at")] if places else []), "shard").write.partitionBy("shard").parquet(out)
    every = assigned.select("shard").union(assigned.select("old")).distinct()
    return every.join(losing.withColumn("l", F.lit(True)), "shard", "left").join(gaining.withColumn("g", F.lit(True)), "shard", "left").select(
        "shard", F.when(F.col("l"), "rewritten").when(F.col("g"), "received").otherwise("untouched").alias("action")
    )


def op2(docs: DataFrame, row=None) -> DataFrame:
    """All documents, stored by source in 16 old shards, in 24 new ones; sizes and digests of rewritten rows are of the files read back.

    ``row``: columns that name a row; without them rows are numbered in a written copy.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "source", *(row or ()))
    if not row:
        row = ["_row"]
        docs = checkpointed(docs.withColumn("_row", F.monotonically_increasing_id()))
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(OLD_SHARDS))
    plan = assign(sized(docs, old, row=row))
    out = f"{shared_folder(spark)}/reshard-{uuid.uuid4().hex}"
    actions = rewrite_affected(docs, old, plan, out, row=row, places=True)
    rewritten = F.broadcast(actions.where("action = 'rewritten'").select(F.col("shard").alias("old")))
    kept = plan.join(rewritten, "old", "left_anti").select("doc_id", "size", "text_crc32", "shard", "slot", "old")
    kind = docs.schema["doc_id"].dataType.simpleString()
    t = F.coalesce(F.col("text"), F.lit(""))
    back = spark.read.schema(f"doc_id {kind}, text string, _at struct<h:bigint,g:bigint>, shard int").parquet(out).select(
        "doc_id", (F.octet_length(t) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), "shard", F.col("_at").alias("at")
    )
    back = back.join(plan.select("at", "slot", "old"), "at").select("doc_id", "size", "text_crc32", "shard", "slot", "old")
    return kept.unionByName(back).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"),
    )
