"""The maintained keyword index, the version log and resumable embedding."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import embedding as V
from lectern.operators import search as S
from lectern.operators.changes import Conflict
from lectern.operators.keyword_index import KeywordIndex
from lectern.sources.versions import VersionLog

ROWS = [(i, f"common words of chunk {i} and w{i % 5} " + "filler " * (i % 4)) for i in range(30)] + [(30, ""), (31, None)]
QUERY = "common OR w3 OR w4 OR fresh"


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def ranking(index, stats, query=QUERY):
    return [(r["chunk_id"], r["score"]) for r in S.ranked(index, stats, query, 100).orderBy(F.col("score").desc(), "chunk_id").collect()]


def rebuilt(spark, rows, query=QUERY):
    d = table(spark, [(i, t or "") for i, t in rows])
    return ranking(S.postings(d), S.statistics(d), query)


def test_index_follows_its_table(spark, tmp_path):
    index, rows = KeywordIndex(spark, str(tmp_path)), dict(ROWS)
    assert index.refresh(table(spark, ROWS)) == 1 and ranking(*index.read()) == rebuilt(spark, ROWS)
    assert index.refresh(table(spark, ROWS)) == 1  # nothing changed: no version
    first = ranking(*index.read())
    index.apply(table(spark, [(3, "fresh words w4"), (50, "another fresh chunk")]))
    rows |= {3: "fresh words w4", 50: "another fresh chunk"}
    assert ranking(*index.read()) == rebuilt(spark, rows.items())
    index.apply(deletes=spark.createDataFrame([(7,), (50,), (999,)], "id long"))
    del rows[7], rows[50]
    assert ranking(*index.read()) == rebuilt(spark, rows.items())
    rows |= {8: "common w4 again", 60: "fresh"}
    del rows[9]
    version = index.refresh(table(spark, list(rows.items())))  # an edit, an insert and a delete at once
    assert version == 4 and ranking(*index.read()) == rebuilt(spark, rows.items())
    assert ranking(*index.read(1)) == first  # earlier versions stay readable
    assert len(index.manifest()[1]["segments"]) > 1
    index.merge(most=1)
    assert len(index.manifest()[1]["segments"]) == 1 and not index.manifest()[1]["segments"][0]["tombstones"]
    assert ranking(*index.read()) == rebuilt(spark, rows.items())
    gone = index.vacuum(keep=1)
    assert gone and ranking(*index.read()) == rebuilt(spark, rows.items())
    assert index.merge(most=1) == index.manifest()[0]  # nothing to merge


def test_postings_take_no_shuffle(spark):
    """A chunk's postings come from its own row: terms in order, their places in order, once each; texts without a token give none."""
    rows = [(1, "b a B c a b"), (2, ""), (3, None), (4, " . "), (5, "x")]
    d = S.postings(table(spark, rows))
    got = [(r["chunk_id"], r["term"], r["tf"], r["n_tokens"], r["positions"]) for r in d.collect()]
    assert sorted(got) == [(1, "a", 2, 6, [1, 4]), (1, "b", 3, 6, [0, 2, 5]), (1, "c", 1, 6, [3]), (5, "x", 1, 1, [0])]
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_segments_stay_with_their_chunks(spark, tmp_path, monkeypatch):
    """No posting moves to another task when a segment is written or merged: a file has all of a chunk's postings, in order."""

    def files():
        at = f"{tmp_path}/i/segments/{index.manifest()[1]['segments'][0]['name']}/postings"
        d = spark.read.parquet(at).withColumn("file", F.input_file_name()).withColumn("n", F.monotonically_increasing_id()).orderBy("file", "n")
        out = {}
        for r in d.collect():
            out.setdefault(r["file"], []).append((r["term"], r["chunk_id"]))
        return list(out.values())

    index = KeywordIndex(spark, str(tmp_path / "i"))
    index.refresh(table(spark, ROWS).repartition(3))
    assert len(files()) == 3 and all(f == sorted(f) for f in files())
    assert sum(len({c for _, c in f}) for f in files()) == len(ROWS) - 2  # two chunks have no token
    gone = [1, 2, 3]
    index.apply(deletes=spark.createDataFrame([(i,) for i in gone], "id long"))
    want = rebuilt(spark, [r for r in ROWS if r[0] not in gone])
    assert ranking(*index.read()) == want
    monkeypatch.setattr("lectern.operators.keyword_index.DEAD_SENT", 0)  # too many to be sent: joined instead
    assert ranking(*index.read()) == want
    monkeypatch.undo()
    index.merge(most=1, dead=0)
    assert ranking(*index.read()) == want and all(f == sorted(f) for f in files())
    assert sum(len({c for _, c in f}) for f in files()) == len(ROWS) - 2 - len(gone)


@pytest.fixture
def spilled(spark):
    """Bytes that tasks have spilled so far, in a session where a sort spills after 500 rows."""
    conf, sc = spark.sparkContext._jsc.sc().conf(), spark.sparkContext
    name = "spark.shuffle.spill.numElementsForceSpillThreshold"

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, *none)
        return sum(stages.apply(i).diskBytesSpilled() for i in range(stages.size()))

    conf.set(name, "500")
    yield total
    conf.remove(name)


LONG = [(i, f"w{i % 7} x w{i % 7} y{i} z common end") for i in range(400)]


def runs(spark, index, tmp_path):
    """By file, the lengths of the stretches in which postings are in order."""
    out = []
    for s in index.manifest()[1]["segments"]:
        for f in (tmp_path / "segments" / s["name"] / "postings").glob("*.parquet"):
            rows = [(r["term"], r["chunk_id"]) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
            cuts = [0, *(k for k in range(1, len(rows)) if rows[k] < rows[k - 1]), len(rows)]
            out.append([b - a for a, b in zip(cuts, cuts[1:])])
    return out


def test_building_spills_nothing(spark, tmp_path, monkeypatch, spilled):
    """A task with many chunks writes its postings in ordered runs of a bounded size instead of sorting them all, which spilled."""
    monkeypatch.setattr(S, "GROUPED_CHUNKS", 10)
    monkeypatch.setattr(S, "RUN_TOKENS", 700)
    index, before = KeywordIndex(spark, str(tmp_path)), spilled()
    index.refresh(table(spark, LONG).coalesce(1))
    assert spilled() == before
    assert runs(spark, index, tmp_path) == [[600, 600, 600, 600]]
    assert ranking(*index.read(), "w3 OR y77 OR end") == rebuilt(spark, LONG, "w3 OR y77 OR end")


def test_merging_spills_nothing(spark, tmp_path, spilled):
    """Runs are put in order in memory when segments are merged too; short ones of a task become one."""
    index = KeywordIndex(spark, str(tmp_path))
    index.refresh(table(spark, LONG).coalesce(1))
    index.apply(table(spark, [(i, f"fresh w3 of {i}") for i in range(300, 500)]).coalesce(1))
    index.apply(deletes=table(spark, LONG[::3]))
    want, before = ranking(*index.read()), spilled()
    index.merge(most=1)
    assert spilled() == before and ranking(*index.read()) == want
    assert len(index.manifest()[1]["segments"]) == 1 and all(len(r) == 1 for r in runs(spark, index, tmp_path))


def test_many_chunks_are_grouped_in_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUPED_CHUNKS", 3)
    rows = [(i, f"w{i % 4} x w{i % 4} ü") for i in range(40)]
    got = sorted((r["chunk_id"], r["term"], r["tf"], r["n_tokens"], r["positions"]) for r in S.postings(table(spark, rows).coalesce(1)).collect())
    assert got == sorted(g for i, _ in rows for g in ((i, f"w{i % 4}", 2, 4, [0, 2]), (i, "x", 1, 4, [1]), (i, "ü", 1, 4, [3])))


def test_stamp_and_emptied_index(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path))
    assert index.refresh(table(spark, ROWS), [["a", 1, 2]]) == 1
    assert index.refresh(table(spark, []), [["a", 1, 2]]) == 1  # the same stamp: the table is not read
    assert index.refresh(table(spark, []), [["a", 1, 3]]) == 2
    assert index.manifest()[1]["segments"] == [] and ranking(*index.read()) == []
    index.apply(table(spark, [(1, "common")]))
    assert len(ranking(*index.read())) == 1


def test_one_of_two_writers_wins(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "log"))
    assert log.latest() == (0, {}) and log.commit(0, {"by": "a"}) == 1
    with pytest.raises(Conflict):
        log.commit(0, {"by": "b"})
    assert log.latest() == (1, {"by": "a"}) and [p.name for p in (tmp_path / "log").iterdir() if "crc" not in p.name] == ["000000000001.json"]
    a, b = KeywordIndex(spark, str(tmp_path / "i")), KeywordIndex(spark, str(tmp_path / "i"))
    a.refresh(table(spark, ROWS))
    seen = b.manifest()
    b.manifest = lambda: seen  # b opened the index before a's next commit
    a.apply(deletes=spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(Conflict):
        b.apply(deletes=spark.createDataFrame([(2,)], "id long"))
    assert ranking(*a.read()) == rebuilt(spark, [r for r in ROWS if r[0] != 1])


# ---------------------------------------------------------------- vectors


def logged(path, fail_at=None):
    """An embedder that writes down each text it is asked for, a line per call."""

    def embed(texts):
        if fail_at is not None and any(fail_at in t for t in texts):
            raise OSError("the backend is gone")
        with open(path, "a") as f:
            f.write("\x1e".join(texts) + "\n")
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def calls(path):
    return [line.rstrip("\n").split("\x1e") for line in path.open()] if path.exists() else []


def test_stopped_and_resumed(spark, tmp_path):
    """Every chunk is embedded once, in calls of a bounded size, though the first run is cancelled between rounds."""
    chunks, log = table(spark, [(i, f"chunk {i}") for i in range(100)]), tmp_path / "log"
    v, stops = V.Vectors(spark, str(tmp_path / "v")), iter([False, False, False, True])
    run = lambda **more: v.embed(chunks, logged(str(log)), "m", batch=8, round_rows=20, **more)
    first = run(cancelled=lambda: next(stops))
    assert 30 <= first <= 50 and len([t for c in calls(log) for t in c]) == first
    ids = sorted(r["id"] for r in v.read(chunks).where("embedding is not null").collect())
    assert ids == list(range(first))  # lowest ids first
    assert run() == 100 - first and run() == 0
    asked = [t for c in calls(log) for t in c]
    assert sorted(asked) == sorted(f"chunk {i}" for i in range(100)) and max(map(len, calls(log))) <= 8
    got = {r["id"]: r["embedding"] for r in v.read(chunks).collect()}
    assert all(got[i] == [float(len(f"chunk {i}")), 1.0] for i in range(100))


def test_failing_backend_keeps_finished_rounds(spark, tmp_path):
    chunks, v = table(spark, [(i, f"chunk {i}.") for i in range(60)]), V.Vectors(spark, str(tmp_path / "v"))
    with pytest.raises(Exception, match="the backend is gone"):
        v.embed(chunks, logged(str(tmp_path / "a"), "chunk 45."), "m", round_rows=20)
    have = v.read(chunks).where("embedding is not null").count()
    assert 30 <= have <= 45
    assert v.embed(chunks, logged(str(tmp_path / "b")), "m", round_rows=20) == 60 - have
    assert not [p for p in (tmp_path / "v").iterdir() if p.name.startswith("pending")]


def test_edits_and_other_spaces(spark, tmp_path):
    v, log = V.Vectors(spark, str(tmp_path / "v")), tmp_path / "log"
    old, new = table(spark, [(1, "one"), (2, "two"), (3, "  "), (4, None)]), table(spark, [(1, "one"), (2, "two edited"), (3, "  "), (4, None)])
    assert v.embed(old, logged(str(log)), "m", prefix="doc: ") == 4
    assert sorted(t for c in calls(log) for t in c) == [" ", " ", "doc: one", "doc: two"]
    assert [r["id"] for r in v.pending(new).collect()] == [2] and v.read(new).where("embedding is null").count() == 1
    assert v.embed(new, logged(str(log)), "m", prefix="doc: ") == 1
    assert v.embed(new, logged(str(log)), "another") == 4  # a change of the vector space clears all vectors
    assert v.embed(new, logged(str(log)), "another", max_tokens=600) == 0


def test_long_texts_are_cut(spark, tmp_path):
    log = tmp_path / "log"
    V.Vectors(spark, str(tmp_path / "v")).embed(table(spark, [(1, "x" * 10_000)]), logged(str(log)), "m")
    assert len(calls(log)[0][0]) == 3 * V.MAX_TOKENS


def test_embed_pending_asks_for_missing_vectors_only(spark, tmp_path):
    log = str(tmp_path / "log")

    @F.pandas_udf("array<float>")
    def embed(s):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in s)
        return s.map(lambda t: [1.0])

    d = spark.createDataFrame([(1, "have", [2.0]), (2, "want", None)], "id long, text string, embedding array<float>")
    got = {r["id"]: r["embedding"] for r in S.embed_pending(d, embed, "m", "m").collect()}
    assert got == {1: [2.0], 2: [1.0]} and set(open(log).read().split()) == {"want"}


def plain_near(tokens, terms, distance):
    """How often each word or phrase takes part in a group: every place within the reach of one that sees all terms."""
    at = [[i for i in range(len(tokens)) if tokens[i : i + len(t)] == list(t)] for t in terms]
    reach = [(p, p + len(terms[k]) + distance) for k, places in enumerate(at) for p in places]
    groups = [(p, e) for p, e in reach if all(any(p <= x <= e for x in places) for places in at)]
    return [sum(any(p <= x <= e for p, e in groups) for x in places) for places in at]


def test_near_groups(spark):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    c = spark.createDataFrame(rows, "id long, text string")
    index, stats = S.postings(c).cache(), S.statistics(c)
    for query, terms, distance in (("NEAR(a b, 2)", [("a",), ("b",)], 2), ('NEAR(a "b c" d)', [("a",), ("b", "c"), ("d",)], 10), ("NEAR(e f, 0)", [("e",), ("f",)], 0)):
        node = S.parse(query)
        assert node == S.Near(tuple(S.Term(t) for t in terms), distance)
        want = {i: tfs for i, t in rows if all(tfs := plain_near(t.split(), terms, distance))}
        got = {r["chunk_id"]: list(r["tfs"]) for r in S._near_hits(index, node).collect()}
        assert got == want and 0 < len(want) < 60
        assert sorted(r["chunk_id"] for r in S.ranked(index, stats, query, None).collect()) == sorted(want)
    both = {r["chunk_id"] for r in S.ranked(index, stats, "NEAR(a b, 2) NOT c", None).collect()}
    assert both == {i for i, t in rows if all(plain_near(t.split(), [("a",), ("b",)], 2)) and "c" not in t.split()}
    assert S.parse("NEAR(a)") == S.Term(("a",)) and S.parse("NEAR a") == S.parse("near AND a")
    for broken in ("NEAR(a b", "NEAR(a b, x)", "NEAR()", "NEAR(a (b))"):
        assert isinstance(S.parse(broken), S.Term)
