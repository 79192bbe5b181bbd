"""The tool loop over a table against the loop for one question."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import conversations as V
from lectern.operators import search as S
from lectern.operators import tools as U

DOCS = [(1, "One", "cs", "the cat sat"), (2, "Two", "art", "a dog and a cat"), (3, "Three", "art", "words of a dog")]
QUESTIONS = [(10, "1"), (11, "2"), (12, "9"), (13, "many"), (14, "unknown"), (15, "endless"), (16, ""), (17, None), (18, "no id"), (19, "broken"), (20, 'quo"te \\ 漢')]


def backend():
    def answer(messages, tools):
        q, asked = messages[0]["content"], [m["content"] for m in messages if m["role"] == "tool"]
        if q == "broken":
            raise OSError("no answer")
        if q == "endless":
            return "again", ([("get_document", {"doc_id": 1})] if tools else [])
        if asked:
            return f"{len(asked)} answers, last: {asked[-1][:30]}", []
        calls = {"many": [("get_document", {"doc_id": 2}), ("get_document", {"doc_id": 1})], "unknown": [("nothing", {"a": 'x"y'})], "no id": [("get_document", {})]}
        if q.isdigit():
            return "looking", [("get_document", {"doc_id": int(q)})]
        return ("", calls[q]) if q in calls else (f"you said {q}", [])

    return answer


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, title string, category string, text string")


def registry(scope):
    """The same tool for the loop of one question."""
    found = {i: json.dumps({"id": i, "title": t, "category": c, "opening": x}, separators=(",", ":")) for i, t, c, x in DOCS if i in scope}

    def get(a):
        if int(a["doc_id"]) not in found:
            raise LookupError("nothing for " + json.dumps(a))
        return found[int(a["doc_id"])]

    out = U.Registry()
    out.add(U.Tool("get_document", "", {}, get, ("doc_id",)))
    return out


def test_every_conversation_is_its_own_loop(spark, docs):
    table = spark.createDataFrame(QUESTIONS, "session_id long, question string").repartition(3)
    got = {r["session_id"]: r for r in V.conversed(table, backend(), [V.document_tool(docs, docs.where("id < 3").select("id"))]).collect()}
    assert len(got) == len(QUESTIONS) and got[19]["error"] == "OSError: no answer" and got[19]["events"] == "[]"
    for key, question in QUESTIONS:
        if question != "broken":
            events = U.converse(backend(), registry({1, 2}), question or "")
            mine = json.loads(got[key]["events"])
            assert mine == events and got[key]["n_events"] == len(events) and got[key]["error"] is None, question
            assert got[key]["answer"] == next((e["text"] for e in reversed(events) if e["t"] == "text"), "")
    assert got[15]["rounds"] == V.ROUNDS + 1
    assert V.conversed(table.where("false"), backend(), []).count() == 0


def test_search_of_many_calls_is_that_of_each(spark, docs):
    chunks = docs.select("id", F.col("id").alias("doc_id"), "text")
    index, stats = S.postings(chunks), S.statistics(chunks)
    calls = [(1, 0, '{"query":"cat dog"}'), (1, 1, '{"query":"words","limit":1}'), (2, 0, '{"query":"absent"}'), (3, 0, '{"query":"dog","limit":99}')]
    tool = V.search_tool(index, stats, chunks, docs.where("id <> 3").select("id"))
    got = {(r["session_id"], r["nth"]): json.loads(r["result"]) for r in tool.answer(spark.createDataFrame(calls, "session_id long, nth int, args string")).collect()}
    for key, nth, args in calls:
        words = " OR ".join(json.loads(args)["query"].split())
        want = [(r["chunk_id"], r["score"]) for r in S.ranked(index, stats, words, 20).orderBy(F.col("score").desc(), "chunk_id").collect() if r["chunk_id"] != 3]
        assert [(h["doc_id"], h["score"]) for h in got[key, nth]] == want
