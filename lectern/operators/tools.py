"""Tools that a chat model may call over a library, the bounded loop that runs them, and replayed provider streams.

A backend is any function from (messages, tool definitions) to (text, calls); nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chat

ROUNDS = 4
VIEWS = ("preview", "summary", "text")


@dataclass
class Tool:
    name: str
    description: str
    properties: dict
    run: Callable[[dict], object]
    required: tuple[str, ...] = ()

    def definition(self) -> dict:
        schema = {"type": "object", "properties": self.properties}
        return {"name": self.name, "description": self.description, "parameters": schema | ({"required": list(self.required)} if self.required else {})}


@dataclass
class Registry:
    """Tools by name; whatever goes wrong in a call becomes its answer, so that the model can react."""

    tools: dict[str, Tool] = field(default_factory=dict)

    def add(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def definitions(self) -> list[dict]:
        return [t.definition() for t in self.tools.values()]

    def call(self, name: str, args: dict) -> object:
        if name not in self.tools:
            return f"error: unknown tool {name}"
        if gone := [r for r in self.tools[name].required if args.get(r) in (None, "")]:
            return f"error: {gone[0]} is missing"
        try:
            return self.tools[name].run(args)
        except (LookupError, ValueError, TypeError) as e:
            return f"error: {e}"


def library_tools(lib: dict[str, DataFrame], scope: DataFrame, search: Callable[[str, str, int], DataFrame], fetch: Callable[[str], str] | None = None) -> Registry:
    """The tools of a chat: search, read, open, rebuild, and fetch where a fetcher is given; all but the last stay in ``scope`` (id)."""
    docs = lib["documents"]

    def inside(doc_id) -> DataFrame:
        d = docs.where(F.col("id") == int(doc_id)).join(scope, "id", "left_semi")
        if d.isEmpty():
            raise chat.NotFound(f"document {doc_id}")
        return d

    def find(a: dict) -> list[dict]:
        hits = search(a["query"], a.get("mode") or "keyword", 3 * int(a.get("limit") or 8))
        hits = hits.join(scope.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").orderBy(F.col("score").desc(), "doc_id")
        return [r.asDict() for r in hits.limit(int(a.get("limit") or 8)).collect()]

    def read(a: dict) -> dict:
        return inside(a["doc_id"]).select("id", "title", "category", F.left("text", F.lit(2000)).alias("opening")).first().asDict()

    def show(a: dict) -> dict:
        return chat.opened(docs, inside(a["doc_id"]).select("id"), int(a["doc_id"]), a.get("view") or "preview").first()["action"].asDict()

    def rebuild(a: dict) -> dict:
        inside(a["doc_id"])
        return {"action": "regenerate", "id": int(a["doc_id"]), "fields": chat.regenerable(a.get("fields"))}

    number, text = {"type": "integer"}, {"type": "string"}
    out = Registry()
    out.add(Tool("search_library", "Find documents by words or by meaning.", {"query": text, "mode": text | {"enum": ["keyword", "semantic"]}, "limit": number}, find, ("query",)))
    out.add(Tool("get_document", "Metadata and opening text of a document.", {"doc_id": number}, read, ("doc_id",)))
    out.add(Tool("open_document", "Show a document to the user.", {"doc_id": number, "view": text | {"enum": list(VIEWS)}}, show, ("doc_id",)))
    out.add(Tool("regenerate_metadata", "Rebuild fields of a document.", {"doc_id": number, "fields": {"type": "array", "items": text}}, rebuild, ("doc_id",)))
    if fetch is not None:
        out.add(Tool("fetch_url", "Text of a web page.", {"url": text}, lambda a: fetch(a["url"]), ("url",)))
    return out


def converse(backend, registry: Registry, question: str, rounds: int = ROUNDS) -> list[dict]:
    """The events of an answer, in order: texts and tool calls with their results.

    After ``rounds`` rounds with calls the model is asked once more without tools, so the loop always ends.
    """
    messages, events = [{"role": "user", "content": question}], []
    for turn in range(rounds + 1):
        text, calls = backend(messages, registry.definitions() if turn < rounds else [])
        if text:
            events.append({"t": "text", "text": text})
        if not calls or turn == rounds:
            break
        messages.append({"role": "assistant", "content": text, "calls": calls})
        for name, args in calls:
            result = registry.call(name, args)
            events.append({"t": "tool", "name": name, "args": args, "result": result})
            messages.append({"role": "tool", "name": name, "content": result})
    return events


# ---------------------------------------------------------------- replayed streams

#: Where a streamed line of each provider keeps a piece of text, and a piece of a tool call (index, name, arguments).
SHAPES = {
    "openai": ("$.choices[0].delta.content", "$.choices[0].delta.tool_calls[0].index", "$.choices[0].delta.tool_calls[0].function.name", "$.choices[0].delta.tool_calls[0].function.arguments"),
    "anthropic": ("$.delta.text", "$.index", "$.content_block.name", "$.delta.partial_json"),
    "ollama": ("$.message.content", None, "$.message.tool_calls[0].function.name", "$.message.tool_calls[0].function.arguments"),
}


def streamed(log: DataFrame, provider: str) -> DataFrame:
    """(answer, text, calls) from lines (answer, seq, line) of a recorded stream, up to its end mark.

    Server-sent ``data:`` lines and plain JSON lines alike; lines that are no JSON are skipped; pieces of a call are
    joined by its index, in order, and a call is a struct (name, args).
    """
    text, index, name, args = SHAPES[provider]
    data = F.trim(F.regexp_replace("line", r"^data:", ""))
    ended = F.max(F.when(data == "[DONE]", 1).otherwise(0)).over(Window.partitionBy("answer").orderBy("seq"))
    d = log.select("answer", "seq", data.alias("d"), ended.alias("ended")).where("ended = 0")
    get = lambda p: F.get_json_object("d", p)
    at = get(index).cast("int") if index else F.when(get(name).isNotNull(), F.col("seq").cast("int"))
    d = d.select("answer", "seq", get(text).alias("text"), at.alias("call"), get(name).alias("name"), get(args).alias("piece"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", c)))), lambda x: x[c]), "")
    texts = d.groupBy("answer").agg(joined("text").alias("text"))
    calls = d.where(F.col("call").isNotNull() & (F.col("name").isNotNull() | F.col("piece").isNotNull())).groupBy("answer", "call")
    calls = calls.agg(F.max("name").alias("name"), joined("piece").alias("args")).where("name IS NOT NULL")
    calls = calls.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("call", "name", "args"))).alias("c"))
    empty = F.array().cast("array<struct<name:string,args:string>>")
    named = F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["args"].alias("args")))
    return texts.join(calls, "answer", "left").select("answer", "text", F.coalesce(named, empty).alias("calls"))


def duration(ms: Column) -> Column:
    """``7s`` or ``2m05s``; empty for what is no duration."""
    s = F.round(ms / 1000).cast("long")
    long = F.concat(F.floor(s / 60).cast("string"), F.lit("m"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s"))
    return F.when(ms.isNull() | (ms < 0), "").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(long)
