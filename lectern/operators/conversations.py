"""The tool loop over a table of conversations.

Each round asks the backend for all open conversations at once, in Arrow batches; the calls it makes become rows that tools answer by
joins, a tool for all its calls together.  Answers go back to their conversations in order, conversations without calls
leave, and after the last round the backend is asked once more without tools.  Rounds are written to the shared folder, so no
conversation is asked twice for the same turn.  One conversation gives what ``tools.converse`` gives for its question.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, ship
from .search import B, IDF_FLOOR, K1, tokens
from .tools import ROUNDS

#: (messages, tool definitions) to (text, [(name, arguments)]).
Backend = Callable[[list[dict], list[dict]], "tuple[str, list]"]
ASKED = "session_id long, messages string, events string, text string, calls array<struct<name:string,args:string>>, error string"
CALL = ["session_id", "nth"]


@dataclass(frozen=True)
class TableTool:
    """``answer`` gets calls (session_id, nth, args as JSON) and gives (session_id, nth, result); calls it leaves out get an error."""

    name: str
    description: str
    properties: dict
    answer: Callable[[DataFrame], DataFrame]
    required: tuple[str, ...] = field(default=())

    def definition(self) -> dict:
        schema = {"type": "object", "properties": self.properties}
        return {"name": self.name, "description": self.description, "parameters": schema | ({"required": list(self.required)} if self.required else {})}


def _ask(backend: Backend, definitions: list[dict]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, messages, events in zip(b["session_id"], b["messages"], b["events"]):
                try:
                    text, calls = backend(json.loads(messages), definitions)
                    calls = [{"name": n, "args": json.dumps(a, ensure_ascii=False)} for n, a in calls]
                    out.append((key, messages, events, text or "", calls, None))
                except Exception as e:  # the other conversations go on
                    out.append((key, messages, events, "", [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["session_id", "messages", "events", "text", "calls", "error"])

    return run


def _appended(array: str, *items: str) -> str:
    """SQL: a JSON array, as text, with JSON values behind the others (nulls add nothing)."""
    return f"concat('[', concat_ws(',', nullif(substring({array}, 2, length({array}) - 2), ''), {', '.join(items)}), ']')"


def _answered(calls: DataFrame, tools: list[TableTool]) -> DataFrame:
    """(session_id, nth, name, args, result) of every call."""
    known = []
    for t in tools:
        mine = calls.where(F.col("name") == t.name)
        for r in t.required:
            mine = mine.where(F.coalesce(F.get_json_object("args", f"$.{r}"), F.lit("")) != "")
        known.append(t.answer(mine.select(*CALL, "args")).select(*CALL, "result"))
    named = F.col("name").isin([t.name for t in tools])
    missing = F.lit(None).cast("string")
    for t in tools:
        for r in t.required:
            gone = (F.col("name") == t.name) & (F.coalesce(F.get_json_object("args", f"$.{r}"), F.lit("")) == "")
            missing = F.coalesce(missing, F.when(gone, F.lit(f"error: {r} is missing")))
    error = F.when(~named, F.concat(F.lit("error: unknown tool "), "name")).otherwise(F.coalesce(missing, F.concat(F.lit("error: nothing for "), "args")))
    results = reduce(DataFrame.unionByName, known) if known else calls.select(*CALL, F.lit("").alias("result")).where("false")
    return calls.join(results, CALL, "left").withColumn("result", F.coalesce("result", error))


def conversed(questions: DataFrame, backend: Backend, tools: list[TableTool], rounds: int = ROUNDS) -> DataFrame:
    """(session_id, answer, n_events, rounds, events, error) for (session_id, question), one row a session.

    ``events``: a JSON array of texts and tool calls with their results, in order; ``answer``: the last text.
    """
    ship(questions.sparkSession)
    first = F.concat(F.lit("["), F.to_json(F.struct(F.lit("user").alias("role"), F.coalesce("question", F.lit("")).alias("content"))), F.lit("]"))
    state = questions.select("session_id", first.alias("messages"), F.lit("[]").alias("events"))
    definitions, done = [t.definition() for t in tools], []
    said = "CASE WHEN text <> '' THEN to_json(named_struct('t', 'text', 'text', text)) END"
    for turn in range(rounds + 1):
        asked = checkpointed(state.mapInPandas(_ask(backend, definitions if turn < rounds else []), ASKED))
        last = F.lit(turn == rounds) | (F.size("calls") == 0)
        done.append(asked.where(last).select("session_id", F.expr(_appended("events", said)).alias("events"), F.lit(turn + 1).alias("rounds"), F.col("text").alias("answer"), "error"))
        on = asked.where(~last)
        if turn == rounds or on.isEmpty():
            break
        calls = on.select("session_id", F.posexplode("calls").alias("nth", "c")).select(*CALL, "c.name", "c.args")
        answered = _answered(checkpointed(calls), tools)
        message = F.to_json(F.struct(F.lit("tool").alias("role"), "name", F.col("result").alias("content")))
        event = F.concat(F.lit('{"t":"tool","name":'), F.to_json(F.col("name").cast("variant")), F.lit(',"args":'), "args", F.lit(',"result":'), F.to_json(F.col("result").cast("variant")), F.lit("}"))
        rows = F.array_sort(F.collect_list(F.struct("nth", message.alias("m"), event.alias("e"))))  # the calls of one turn
        back = answered.groupBy("session_id").agg(rows.alias("r")).select(
            "session_id", F.array_join(F.transform("r", lambda x: x["m"]), ",").alias("m"), F.array_join(F.transform("r", lambda x: x["e"]), ",").alias("e")
        )
        assistant = "to_json(named_struct('role', 'assistant', 'content', text, 'calls', calls))"
        state = on.join(back, "session_id").select("session_id", F.expr(_appended("messages", assistant, "m")).alias("messages"), F.expr(_appended("events", said, "e")).alias("events"))
    out = reduce(DataFrame.unionByName, done)
    return out.select("session_id", "answer", F.json_array_length("events").cast("long").alias("n_events"), "rounds", "events", "error")


def document_tool(docs: DataFrame, scope: DataFrame, most: int = 2000) -> TableTool:
    """``get_document``: metadata and opening text of documents in scope (id)."""

    def answer(calls: DataFrame) -> DataFrame:
        wanted = calls.select(*CALL, F.get_json_object("args", "$.doc_id").try_cast("long").alias("id"))
        there = docs.join(scope.select("id"), "id", "left_semi")
        result = F.to_json(F.struct("id", "title", "category", F.left("text", F.lit(most)).alias("opening")))
        return wanted.join(there, "id").select(*CALL, result.alias("result"))

    return TableTool("get_document", "Metadata and opening text of a document.", {"doc_id": {"type": "integer"}}, answer, ("doc_id",))


def search_tool(index: DataFrame, stats: DataFrame, chunks: DataFrame, scope: DataFrame, most: int = 8) -> TableTool:
    """``search_library``: for every call the best documents in scope, by BM25 over the words of its query; a row of the postings meets the calls that ask for its term."""

    def answer(calls: DataFrame) -> DataFrame:
        limit = F.coalesce(F.get_json_object("args", "$.limit").try_cast("int"), F.lit(most))
        q = calls.select(*CALL, F.when(limit.between(1, 20), limit).otherwise(most).alias("k"), F.explode(F.array_distinct(tokens(F.get_json_object("args", "$.query")))).alias("term"))
        hit = index.select("term", "chunk_id", "tf", "n_tokens").join(q.select("term").distinct(), "term", "left_semi")
        n = hit.groupBy("term").agg(F.count("*").alias("n"))
        idf = F.log((F.col("n_chunks") - F.col("n") + 0.5) / (F.col("n") + 0.5))
        part = F.when(idf <= 0, IDF_FLOOR).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))
        scored = hit.join(n, "term").join(F.broadcast(stats)).select("term", "chunk_id", part.alias("part"))
        inside = chunks.select(F.col("id").alias("chunk_id"), "doc_id").join(scope.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        best = q.join(scored, "term").groupBy(*CALL, "k", "chunk_id").agg(F.sum("part").alias("s")).join(inside, "chunk_id")
        best = best.groupBy(*CALL, "k", "doc_id").agg(F.round(F.max("s"), 6).alias("score"))
        rank = F.row_number().over(Window.partitionBy(*CALL).orderBy(F.col("score").desc(), "doc_id"))
        best = best.withColumn("rank", rank).where("rank <= 20 AND rank <= k")
        rows = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score")))  # twenty at most
        found = best.groupBy(*CALL).agg(F.to_json(F.transform(rows, lambda r: F.struct(r["doc_id"].alias("doc_id"), r["score"].alias("score")))).alias("result"))
        return calls.select(*CALL).join(found, CALL, "left").select(*CALL, F.coalesce("result", F.lit("[]")).alias("result"))

    text = {"type": "string"}
    return TableTool("search_library", "Find documents by words.", {"query": text, "limit": {"type": "integer"}}, answer, ("query",))
