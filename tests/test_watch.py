"""The watcher: stamps of directory trees, the settle rule as a stream and as a batch, scans and restarts."""

import os
import random
import time

import pytest

from lectern.streaming import stamps as T
from lectern.streaming import watch as W


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """State of two partitions instead of eight."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


STAMPS = "path string, size long, mtime long, scan long, before long"


def plain(rows, settle=True):
    """The rule, one path and scan at a time."""
    out, seen, done, scans = [], {}, {}, sorted({r[3] for r in rows})
    for n in scans:
        now = {p: (size, mtime) for p, size, mtime, scan, _ in rows if scan == n}
        before = {b for *_, scan, b in rows if scan == n}
        if n - 1 not in scans and before != {0}:
            seen = done = {}
        for p, stamp in now.items():
            if (seen.get(p) == stamp or not settle) and done.get(p) != stamp:
                out.append((p, *stamp, n))
                done = done | {p: stamp}
        seen, done = now, {p: s for p, s in done.items() if p in now}
    return sorted(out)


def history(seed):
    rng, rows = random.Random(seed), []
    for p in "abcdef":
        size = 1
        for n in range(1, 15):
            size += rng.random() < 0.4
            if rng.random() < 0.8:
                rows.append((p, size % 3, size % 3, n, n - 1))
    return rows


@pytest.mark.parametrize("seed,settle", [(1, True), (2, True), (3, False)])
def test_batch_rule(spark, seed, settle):
    rows = history(seed)
    assert sorted(map(tuple, W.settled_batch(spark.createDataFrame(rows, STAMPS), settle).collect())) == plain(rows, settle)


def streamed(spark, tmp_path, parts, **more):
    """Rows of each run of one query that takes the parts one after the other."""
    out, schema = [], spark.createDataFrame([], STAMPS).schema
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    for rows in parts:
        spark.createDataFrame(rows, STAMPS).coalesce(1).write.mode("append").parquet(src)
        got = []
        with W.state_store(spark):
            q = W.settled(spark.readStream.schema(schema).parquet(src), **more).writeStream.foreachBatch(lambda b, e: got.extend(map(tuple, b.collect())))  # noqa: B023
            q.option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination(120)
        out.append(sorted(got))
    return out


def test_stream_is_the_batch(spark, tmp_path):
    rows = history(7)
    got = streamed(spark, tmp_path, [[r for r in rows if r[3] <= 5], [r for r in rows if 5 < r[3] <= 6], [r for r in rows if r[3] > 6]], interval=86_400)
    assert sorted(sum(got, [])) == plain(rows)


def test_what_the_library_holds_is_not_let_through(spark, tmp_path):
    rows = [("a", 1, 1, n, n - 1) for n in (1, 2)] + [("b", 5, 5, n, n - 1) for n in (1, 2)]
    done = spark.createDataFrame([("a", 1, 1), ("gone", 1, 1), ("b", 4, 4)], "path string, size long, mtime long")
    assert streamed(spark, tmp_path, [rows], done=done) == [[("b", 5, 5, 2)]]


def test_a_short_interval_forgets(spark, tmp_path):
    """With an interval of a second; that one of a day does not forget is seen in test_stream_is_the_batch."""
    rows = [("a", 1, 1, n, n - 1) for n in (1, 2)]
    assert streamed(spark, tmp_path, [rows], interval=1) == [[("a", 1, 1, 2)]]
    time.sleep(W.FORGET + 1)
    streamed(spark, tmp_path, [[("other", 1, 1, 2, 1)]], interval=1)  # timers are looked at when a batch runs
    assert streamed(spark, tmp_path, [[("a", 1, 1, n, n - 1) for n in (3, 4)]], interval=1) == [[("a", 1, 1, 4)]]


def test_time_to_forget_follows_the_interval():
    assert W.Settle(86_400).forget_ms == W.FORGET * 86_400_000


# ---------------------------------------------------------------- directories


@pytest.fixture
def inbox(tmp_path):
    box = tmp_path / "in"
    (box / "sub" / "deep").mkdir(parents=True)
    (box / ".obsidian").mkdir()
    for name in ("a.md", "sub/b.md", "sub/deep/c.txt", ".obsidian/d.md", ".e.md", "junk.bin"):
        (box / name).write_text("x")
    return box


def test_walk(inbox):
    found = {os.path.relpath(p, inbox) for p, _, _ in T.walked(str(inbox))}
    assert found == {"a.md", "sub/b.md", "sub/deep/c.txt", "junk.bin"}
    assert {os.path.relpath(p, inbox) for p, _, _ in T.walked(str(inbox), deep=False)} == {"a.md", "junk.bin"}
    assert list(T.walked(str(inbox / "none"))) == []


def test_offsets_grow_and_parts_cover_the_tree(inbox):
    reader = T.Scans([str(inbox), str(inbox / "none")])
    a, b = reader.latestOffset(), reader.latestOffset()
    assert b["scan"] > a["scan"] > reader.initialOffset()["scan"] and reader.partitions(a, a) == []
    rows = [r for p in reader.partitions(a, b) for r in reader.read(p)]
    assert sorted(os.path.basename(r[0]) for r in rows) == ["a.md", "b.md", "c.txt", "junk.bin"]
    assert {r[3:] for r in rows} == {(b["scan"], a["scan"])}


class Library:
    """A sink with what reached it, by name."""

    def __init__(self, box):
        self.box, self.batches = box, []

    def __call__(self, batch, epoch):
        self.batches.append(sorted(os.path.relpath(r["path"], self.box) for r in batch.collect()))

    def scan(self, spark, tmp_path, **more):
        W.watch(spark, [str(self.box)], self, str(tmp_path / "cp"), availableNow=True, **more).awaitTermination(120)
        return self.batches[-1]


def test_polling_scans(spark, inbox, tmp_path):
    lib = Library(inbox)
    assert lib.scan(spark, tmp_path) == []  # seen once
    assert lib.scan(spark, tmp_path) == ["a.md", "sub/b.md", "sub/deep/c.txt"]
    (inbox / "a.md").write_text("changed")
    (inbox / "later").mkdir()
    (inbox / "later" / "new.md").write_text("x")
    assert lib.scan(spark, tmp_path) == []  # not settled, and the others are done, also after a restart
    assert lib.scan(spark, tmp_path) == ["a.md", "later/new.md"]
    (inbox / "a.md").unlink()
    assert lib.scan(spark, tmp_path) == []


def test_events_act_at_once(spark, inbox, tmp_path):
    lib = Library(inbox)
    assert lib.scan(spark, tmp_path, settle=False) == ["a.md", "sub/b.md", "sub/deep/c.txt"]
    assert lib.scan(spark, tmp_path, settle=False) == []


def test_watching_nothing_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        W.watch(spark, [], print, str(tmp_path))


def test_running_watcher_keeps_its_interval(spark, inbox, tmp_path):
    lib = Library(inbox)
    q = W.watch(spark, [str(inbox)], lib, str(tmp_path / "cp"), interval=2)
    try:
        until = time.time() + 90
        while sum(map(len, lib.batches)) < 3 and time.time() < until:
            time.sleep(0.25)
        assert sorted(sum(lib.batches, [])) == ["a.md", "sub/b.md", "sub/deep/c.txt"]
        starts = [p["timestamp"] for p in q.recentProgress]
        assert len(set(starts)) == len(starts) and len(starts) < 50
    finally:
        q.stop()


def test_scan_sink(spark, inbox):
    seen = []
    sink = W.scan(lambda b: seen.append(b.count()), lambda: spark.range(20), lambda d: seen.append(d.count()))
    sink(spark.range(3), 0)
    assert seen == [3, 8]
