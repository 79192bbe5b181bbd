"""Staged enrichment with a ledger."""

import json

import pytest

from lectern.operators import ledger as G

TEXTS = {1: "one text about logic", 2: "bad text", 3: "another text", 4: ""}


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


def backend(path, bad=None):
    """Notes what it is asked, in a file that all workers share."""
    path = str(path)

    def work(text):
        with open(path, "a") as f:
            f.write(text + "\n")
        if bad is not None and bad in text:
            raise OSError("no answer")
        return text.upper()

    return work


def asked(path):
    return sorted(path.read_text().splitlines()) if path.exists() else []


def test_a_failure_stops_its_document_only(spark, tmp_path):
    ledger, docs, a, b = G.Ledger(spark, str(tmp_path / "l")), table(spark, TEXTS), tmp_path / "a", tmp_path / "b"
    stages = lambda bad: [G.mapped_stage("first", backend(a, bad)), G.Stage("second", lambda d: G.mapped(d.select("id", "text"), backend(b)).selectExpr("id", "summary AS result", "error"), ("first",))]
    assert ledger.run(docs, stages("bad")) == {"first": 4, "second": 3}
    got = {r["id"]: r for r in ledger.results(docs, stages("bad")).collect()}
    assert got[1]["status"] == "done" and got[1]["first"] == "ONE TEXT ABOUT LOGIC" and got[1]["failed"] is None
    assert (got[2]["status"], got[2]["failed"], got[2]["error"]) == ("ingested", "first", "OSError: no answer")
    assert asked(b) == sorted(t for t in TEXTS.values() if t != "bad text")
    assert ledger.run(docs, stages("bad")) == {"first": 1, "second": 0}  # only the failed one is tried again
    assert ledger.run(docs, stages(None)) == {"first": 1, "second": 1}
    assert ledger.run(docs, stages(None)) == {"first": 0, "second": 0}
    assert {r["status"] for r in ledger.results(docs, stages(None)).collect()} == {"done"}
    edited = table(spark, TEXTS | {3: "an edited text", 5: "a new one"})
    assert ledger.run(edited, stages(None)) == {"first": 2, "second": 2}
    assert asked(a).count("bad text") == 3 and asked(a).count("another text") == 1 and asked(b).count("an edited text") == 1
    pending = {r["id"]: r["status"] for r in ledger.results(table(spark, TEXTS | {1: "changed since"}), stages(None)).collect()}
    assert pending == {1: "ingested", 2: "done", 3: "ingested", 4: "done"}


def test_another_version_runs_again(spark, tmp_path):
    ledger, docs, log = G.Ledger(spark, str(tmp_path / "l")), table(spark, TEXTS), tmp_path / "log"
    assert ledger.run(docs, [G.mapped_stage("s", backend(log))]) == {"s": 4}
    assert ledger.run(docs, [G.mapped_stage("s", backend(log), version="2")]) == {"s": 4}
    assert ledger.run(docs, [G.mapped_stage("s", backend(log), version="2")], cancelled=lambda: True) == {}


def test_default_stages(spark, tmp_path):
    long = "The logic of this text is plain. " * 30
    docs = table(spark, {1: long, 2: "Abstract\n" + long + "\nKeywords: x\n[1] [2] [3] [4] arXiv:1 doi:10\nReferences\n", 3: "short"})
    ledger, stages = G.Ledger(spark, str(tmp_path)), [G.kind_stage(), G.tag_stage(vocabulary=("logic", "art")), G.summary_stage()]
    assert ledger.run(docs, stages) == {"kind": 3, "tags": 3, "summary": 3}
    got = {r["id"]: r for r in ledger.results(docs, stages).collect()}
    assert got[2]["kind"] == "paper" and json.loads(got[2]["summary"])["source"] == "abstract" and json.loads(got[1]["summary"])["source"] == "generated"
    assert json.loads(got[1]["tags"])["tags"] == ["logic"] and json.loads(got[3]["summary"]) == {"summary": "", "source": ""}
    assert ledger.run(docs, stages) == {"kind": 0, "tags": 0, "summary": 0}


def test_empty_library(spark, tmp_path):
    ledger, none = G.Ledger(spark, str(tmp_path)), spark.createDataFrame([], "id long, text string")
    stages = [G.kind_stage(), G.mapped_stage("s", str.upper)]
    assert ledger.run(none, stages) == {"kind": 0, "s": 0} and ledger.results(none, stages).isEmpty()
    with pytest.raises(Exception, match="id"):
        ledger.run(none.drop("id"), stages)
