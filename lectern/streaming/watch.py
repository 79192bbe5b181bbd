"""The watcher as a stream: file stamps, the settle rule, and scans that ingest and then enrich.

Stamps (path, size, mtime, scan, before) come as rows of ``stamps.scans``, because a file source does not see a path again whose content
changed.  A stamp has settled when two scans in a row saw it, and is let through once; a file that one scan did not see has
vanished and starts anew.  Spark keeps the state of each path, from scan to scan and over restarts, and a timer of some scan
intervals drops what has not been seen since, so vanished files leave nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from .stamps import scans

SETTLED = "path string, size long, mtime long, scan long"
STATE = "size long, mtime long, scan long, done_size long, done_mtime long"
#: Scan intervals without a stamp after which a path is forgotten.
FORGET = 3


def files(spark: SparkSession, directory: str, per_batch: int = 100) -> DataFrame:
    """New files below a directory, as a stream (path, size, modified, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    d = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(directory)
    return d.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


class Settle(StatefulProcessor):
    """Lets each stamp of a path through once, at the second scan in a row that saw it (or at the first, without ``settle``)."""

    def __init__(self, interval: int, settle: bool = True):
        self.forget_ms, self.settle = FORGET * interval * 1000, settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stamp", STATE)

    def _alive(self, timers) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = scan = done = None
        if self.state.exists():
            size, mtime, scan, done_size, done_mtime = self.state.get()
            seen = None if scan is None else (size, mtime)
            done = None if done_size is None else (done_size, done_mtime)
        out = []
        for r in pd.concat(list(rows)).sort_values("scan").itertuples():
            stamp, before = (int(r.size), int(r.mtime)), int(r.before)
            if scan is not None and scan < before:  # a scan in between did not see the file
                seen = done = None
            if (seen == stamp or not self.settle) and done != stamp:
                out.append((key[0], *stamp, int(r.scan)))
                done = stamp
            seen, scan = stamp, int(r.scan)
        self.state.update((*seen, scan, *(done or (None, None))))
        self._alive(timerValues)
        yield pd.DataFrame(out, columns=["path", "size", "mtime", "scan"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["path", "size", "mtime", "scan"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update((None, None, None, int(r["size"]), int(r["mtime"])))
        self._alive(timerValues)

    def close(self) -> None:
        pass


#: Settings of a query: state in RocksDB, which the operator needs, and no batches without stamps, of which timers would ask for one after another.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside have SETTINGS; the session's own come back."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def settled(stamps: DataFrame, interval: int = 5, settle: bool = True, done: DataFrame | None = None) -> DataFrame:
    """(path, size, mtime, scan): each stamp once, at the scan that saw it the second time in a row.

    ``interval``: seconds between scans, from which the time to forget follows.  ``done``: (path, size, mtime), one row a path, of what a
    library holds already; a query that starts without a checkpoint takes it as its first state.
    """
    ship(stamps.sparkSession)
    first = None if done is None else done.select("path", "size", "mtime").groupBy("path")
    return stamps.groupBy("path").transformWithStateInPandas(
        statefulProcessor=Settle(interval, settle), outputStructType=SETTLED, outputMode="Append", timeMode="ProcessingTime", initialState=first
    )


def settled_batch(stamps: DataFrame, settle: bool = True) -> DataFrame:
    """The same for a finished set of stamps."""
    w = Window.partitionBy("path").orderBy("scan")
    follows = F.coalesce(F.lag("scan").over(w) >= F.col("before"), F.lit(False))
    d = stamps.withColumns({"follows": follows, "stay": F.sum(F.when(follows, 0).otherwise(1)).over(w)})
    stamp = lambda c: F.struct(*(F.col(x) if c is None else F.lag(x).over(c) for x in ("size", "mtime")))
    if settle:
        d = d.withColumn("ready", F.col("follows") & stamp(w).eqNullSafe(stamp(None))).where("ready")
    done = Window.partitionBy("path", "stay").orderBy("scan")
    first: Column = F.lag("scan").over(done).isNull() | ~stamp(done).eqNullSafe(stamp(None))
    return d.withColumn("first", first).where("first").select("path", "size", "mtime", "scan")


def due(stamps: DataFrame, done: DataFrame, settle: bool = True) -> tuple[DataFrame, DataFrame]:
    """(path, size, mtime) to ingest now, and ``done`` without the files that are gone.

    ``stamps``: (path, size, mtime, scan) of the last two scans; ``done``: (path, size, mtime) as ingested before.  A path of the
    last scan is due if the scan before saw the same stamp (unless ``settle`` is off) and that stamp is not done.
    """
    last = stamps.join(F.broadcast(stamps.agg(F.max("scan").alias("scan"))), "scan", "left_semi").select("path", "size", "mtime")
    stamp = ["path", "size", "mtime"]
    if settle:
        last_but = stamps.groupBy(*stamp).agg(F.countDistinct("scan").alias("n")).where("n > 1").select(*stamp)
        ready = last.join(last_but, stamp, "left_semi")
    else:
        ready = last
    return ready.join(done, stamp, "left_anti"), done.join(last.select("path"), "path", "left_semi")


def scan(
    ingest: Callable[[DataFrame], None], pending: Callable[[], DataFrame], enrich: Callable[[DataFrame], None], most: int = 8
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: ingest what arrived, then enrich up to ``most`` pending documents.

    ``ingest`` upserts by path and content hash, so a batch that is replayed changes nothing.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        ingest(batch)
        enrich(pending().orderBy("id").limit(most))

    return run


def watch(
    spark: SparkSession, directories: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, interval: int = 5, settle: bool = True, done: DataFrame | None = None, **trigger
):
    """Starts the watcher: a scan each ``interval`` seconds hands the settled files that the library reads to ``sink``.

    A burst of changes within an interval is one scan.  ``trigger``: another trigger than the interval, such as ``availableNow=True`` for one scan.
    """
    from ..functions.text import clamped_interval
    from ..sources.files import supported

    seconds = spark.range(1).select(clamped_interval(F.lit(interval))).first()[0]
    d = settled(scans(spark, directories).where(supported(F.col("path"))), seconds, settle, done)
    with state_store(spark):
        w = d.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        return w.trigger(**(trigger or {"processingTime": f"{seconds} seconds"})).start()


def transitions(jobs: DataFrame) -> DataFrame:
    """(job, at) where a job's status changed to done or failed."""
    w = Window.partitionBy("job").orderBy("at")
    return jobs.withColumn("before", F.lag("status").over(w)).where(
        F.col("status").isin("done", "failed") & ~F.col("status").eqNullSafe(F.col("before"))
    ).select("job", "at", "status")
