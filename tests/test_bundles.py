"""Bundles as a data source."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators.changes import Conflict
from lectern.sources import bundles


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(1, "/a/x.md", "One", "cs", "book"), (2, "/b/x.md", "Two", "cs", ""), (3, "/c/2-x.md", "Three", "art", None), (4, "/d/y.md", "Four", "art", ""), (5, "/e/z.md", "Out", "", "")]
    docs = spark.createDataFrame(docs, "id long, path string, title string, category string, kind string")
    collections = spark.createDataFrame([(1, "reading"), (2, "later"), (3, "empty")], "id long, name string")
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (1, 4), (1, 4)], "collection_id long, doc_id long")
    tags = spark.createDataFrame([(1, "b", "manual"), (1, "a", "vocab")], "doc_id long, tag string, source string")
    files = spark.createDataFrame([("/a/x.md", b"1"), ("/b/x.md", b"22"), ("/c/2-x.md", b"")], "path string, content binary")
    return bundles.bundled(collections, members, docs, tags, files)


def test_names_never_clash(spark):
    paths = ["/a/x", "/b/x", "/c/2-x", "/d/2-2-x", "/e/x"]
    got = bundles.unique_entries(spark.createDataFrame(list(enumerate(paths, 1)), "id long, path string")).collect()
    names = {r["id"]: r["entry"] for r in got}
    assert len(set(names.values())) == 5 and names[1] == "x" and all(n.split("-")[-1] == "x" for n in names.values())


def test_round_trip(spark, rows, tmp_path):
    at = str(tmp_path / "bundle")
    bundles.write(rows.repartition(3), at)
    with pytest.raises(Conflict):
        bundles.write(rows, at)
    back = bundles.read(spark, at)
    assert not [p.name for p in (tmp_path / "bundle").iterdir() if p.name.startswith("_temporary")]
    assert {r["entry"]: r["content"] and bytes(r["content"]) for r in back.collect()}["y.md"] is None  # listed, its file is gone
    docs = {r["id"]: r for r in bundles.documents_of(back).collect()}
    assert sorted(docs) == [1, 2, 3, 4] and docs[1]["title"] == "One" and [tuple(t) for t in docs[1]["tags"]] == [("a", "vocab"), ("b", "manual")]
    content = {r["entry"]: bytes(r["content"]) for r in back.where("content is not null").collect()}
    assert [content[docs[k]["entry"]] for k in (1, 2, 3)] == [b"1", b"22", b""] and docs[1]["entry"] == "x.md"
    held = {(r["name"], r["entry"]) for r in bundles.memberships_of(back).collect()}
    assert held == {("reading", docs[k]["entry"]) for k in (1, 2, 4)} | {("later", docs[k]["entry"]) for k in (2, 3)}
    assert bundles.read(spark, at, contents=False).where("content is not null").isEmpty()


def test_a_failed_task_leaves_nothing(spark, rows, tmp_path):
    at = tmp_path / "bundle"
    broken = rows.withColumn("document", F.when(F.col("entry") == "y.md", F.raise_error(F.lit("broken"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="broken"):
        bundles.write(broken, str(at))
    assert not at.exists() or not list(at.iterdir())
    with pytest.raises(Exception, match="no finished bundle"):
        at.mkdir(exist_ok=True)
        bundles.read(spark, str(at)).count()


def test_single_zip_with_hostile_names(spark, tmp_path):
    path = tmp_path / "one.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("files/a.md", b"text")
        z.writestr("manifest.json", json.dumps({"collection": {"name": "old"}, "documents": [{"file": "files/a.md", "title": "A"}, {"file": "..\\..\\etc/b.md", "title": "B"}]}))
    back = bundles.read(spark, str(path))
    assert {r["entry"]: r["content"] and bytes(r["content"]) for r in back.collect()} == {"a.md": b"text", "b.md": None}
    assert {(r["name"], r["entry"]) for r in bundles.memberships_of(back).collect()} == {("old", "a.md"), ("old", "b.md")}
    with pytest.raises(ValueError):
        bundles.local("hdfs://x/y")
