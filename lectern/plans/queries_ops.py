"""Merges, chats, notes, bundles, enrichment rules and watcher scans over the supplied tables, each with its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes as M
from ..operators import chat as H
from ..operators import enrich as E
from ..operators import library as L
from ..operators import search as S
from ..operators import tools as U
from ..operators.conversations import conversed, document_tool
from ..operators.ledger import Ledger, Stage, kind_stage, mapped_stage
from ..session import shared_folder, table
from ..sources import files, store
from ..streaming import watch
from .queries_text import _ABSTRACT, _FRONT_MATTER, _JUNK, _WHOLE, _best, _kind_scores
from .registry import ORACLES, query

Q = L.SQL


def _chats(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    kind = F.when(F.col("session_id") % 3 == 0, "tag").when(F.col("session_id") % 7 == 0, "library").otherwise("document")
    return c.select("session_id", kind.alias("scope_kind"), F.col("session_id").cast("string").alias("scope_value"))


@query("merge_chats", Q + """, m AS (SELECT id, min(id) OVER (PARTITION BY sha256) AS canonical FROM docs),
c AS (SELECT DISTINCT conv_id AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'tag' WHEN conv_id % 7 = 0 THEN 'library' ELSE 'document' END AS scope_kind FROM conversations)
SELECT session_id, scope_kind, coalesce(CASE WHEN scope_kind = 'document' THEN canonical END, session_id)::VARCHAR AS scope_value FROM c LEFT JOIN m ON m.id = session_id""")
def merge_chats(spark, sf_dir):
    return M.merged_chats(_chats(spark, sf_dir), M.canonical_ids(L.documents(spark, sf_dir)))


@query("merge_library", Q + """, m AS (SELECT id, min(id) OVER (PARTITION BY sha256) AS canonical FROM docs)
SELECT (SELECT count(*) FROM m WHERE id = canonical) AS documents, (SELECT count(*) FROM chunks JOIN m ON m.id = doc_id WHERE m.id = canonical) AS chunks,
  (SELECT count(*) FROM (SELECT DISTINCT canonical, tag FROM tags JOIN m ON m.id = doc_id)) AS tags,
  (SELECT count(*) FROM (SELECT DISTINCT collection_id, canonical FROM members JOIN m ON m.id = doc_id)) AS members""")
def merge_library(spark, sf_dir):
    lib = L.library(spark, sf_dir)
    out = M.merged({k: lib[k] for k in ("documents", "chunks", "tags", "members")}, M.canonical_ids(lib["documents"]))
    one = None
    for k in ("documents", "chunks", "tags", "members"):
        n = out[k].agg(F.count("*").alias(k))
        one = n if one is None else one.join(F.broadcast(n))
    return one


@query("open_document", "SELECT 'open' AS action, doc_id AS id, 'preview' AS view FROM documents WHERE doc_id = 3")
def open_document(spark, sf_dir):
    d = L.documents(spark, sf_dir)
    return H.opened(d, H.scope({"documents": d}, "library"), 3, "nonsense").select("action.*")


@query("chat_events", """SELECT conv_id AS session_id, turn AS id, CASE WHEN turn % 3 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN turn % 3 = 0 THEN 'found' ELSE text END AS first,
  CASE WHEN turn % 3 = 0 THEN 'search_library' END AS tool FROM conversations""")
def chat_events(spark, sf_dir):
    log = F.when(F.col("id") % 3 == 0, '[{"t":"text","text":"found"},{"t":"tool","name":"search_library","args":"{}"}]').when(F.col("id") % 3 == 1, "{broken")
    e = H.events(L.messages(spark, sf_dir).withColumn("tool_log", log))
    return e.select("session_id", "id", F.size("events").alias("n"), F.col("events")[0]["text"].alias("first"), F.get("events", F.lit(1))["name"].alias("tool"))


def _stream(spark, sf_dir, wrap):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer"), F.col("turn").alias("seq"), "text")
    end = c.groupBy("answer").agg((F.max("seq") + 1).alias("seq")).select("answer", "seq", F.lit("data: [DONE]").alias("line"))
    late = end.select("answer", F.col("seq") + 1, F.lit('data: {"choices":[{"delta":{"content":"late"}}]}'))
    noise = end.select("answer", F.lit(-1).cast("long"), F.lit(": keep-alive"))
    return c.select("answer", "seq", wrap(F.col("text")).alias("line")).union(end).union(late).union(noise)


def _json(*fields):
    return F.to_json(F.struct(*fields))


@query("streamed_text", "SELECT conv_id AS answer, string_agg(text, '' ORDER BY turn) AS text, 0 AS n_calls FROM conversations GROUP BY 1")
def streamed_text(spark, sf_dir):
    """Texts put together again from the pieces of a recorded stream."""
    delta = lambda t: F.concat(F.lit("data: "), _json(F.array(F.struct(F.struct(t.alias("content")).alias("delta"))).alias("choices")))
    return U.streamed(_stream(spark, sf_dir, delta), "openai").select("answer", "text", F.size("calls").alias("n_calls"))


@query("streamed_calls", "SELECT conv_id AS answer, '' AS text, 'search_library' AS name, string_agg(text, '' ORDER BY turn) AS args FROM conversations GROUP BY 1")
def streamed_calls(spark, sf_dir):
    """Arguments of a tool call that came in pieces."""

    def piece(t):
        call = F.struct(F.lit(0).alias("index"), F.struct(F.lit("search_library").alias("name"), t.alias("arguments")).alias("function"))
        return F.concat(F.lit("data: "), _json(F.array(F.struct(F.struct(F.array(call).alias("tool_calls")).alias("delta"))).alias("choices")))

    d = U.streamed(_stream(spark, sf_dir, piece), "openai")
    return d.select("answer", "text", F.col("calls")[0]["name"].alias("name"), F.col("calls")[0]["args"].alias("args"))


@query("notes_lifecycle", """WITH n AS (SELECT conv_id AS id, conv_id % 50 AS doc_id, text AS body, '2024-01-01 00:00:00' AS created, '2024-01-01 00:00:00' AS updated FROM conversations WHERE turn = 0)
SELECT * FROM (SELECT id, doc_id, CASE WHEN id = 2 THEN 'edited' ELSE body END AS body, created, CASE WHEN id = 2 THEN '2024-02-01 12:00:00' ELSE updated END AS updated FROM n
UNION ALL SELECT max(id) + 1, 7, 'added', '2024-02-01 12:00:00', '2024-02-01 12:00:00' FROM n) WHERE id NOT IN (3, 4)""")
def notes_lifecycle(spark, sf_dir):
    day, now = F.lit("2024-01-01 00:00:00"), F.lit("2024-02-01 12:00:00").cast("timestamp")
    n = table(spark, sf_dir, "conversations").where("turn = 0").select(
        F.col("conv_id").alias("id"), (F.col("conv_id") % 50).alias("doc_id"), F.col("text").alias("body"), day.alias("created"), day.alias("updated")
    )
    return M.notes_removed(M.note_edited(M.note_added(n, 7, "added", now), 2, "edited", now), [3, 4])


@query("setting_values", """SELECT key, value FROM (SELECT source AS key, count(*)::VARCHAR AS value FROM documents WHERE source <> 'src1' GROUP BY 1)
UNION ALL VALUES ('src1', 'b'), ('new', 'x'), ('asked: absent', ''), ('asked: src1', 'b')""")
def setting_values(spark, sf_dir):
    """A count for each source as a setting; one is set twice, one is new, and one that is absent reads as empty."""
    meta = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("key")).agg(F.count("*").cast("string").alias("value"))
    meta = M.meta_set(M.meta_set(M.meta_set(meta, "src1", "a"), "src1", "b"), "new", "x")
    asked = [M.meta_value(meta, k).select(F.lit(f"asked: {k}").alias("key"), "value") for k in ("absent", "src1")]
    return meta.unionByName(asked[0]).unionByName(asked[1])


@query("bundle_entries", Q + """SELECT name, m.doc_id, d.id || '.txt' AS file, title, category, kind, (SELECT count(*) FROM tags t WHERE t.doc_id = m.doc_id) AS n_tags
FROM members m JOIN collections c ON c.id = collection_id JOIN docs d ON d.id = m.doc_id""")
def bundle_entries(spark, sf_dir):
    """Manifests written as JSON and read again."""
    m = store.manifest(L.collections(spark, sf_dir), L.members(spark, sf_dir), L.documents(spark, sf_dir), L.tags(spark, sf_dir))
    return store.parsed(m).select("name", "doc_id", "file", "title", "category", "kind", F.size("tags").cast("long").alias("n_tags"))


@query("bundle_import", Q + """, e AS (SELECT doc_id, kind, category FROM members JOIN docs ON id = doc_id)
SELECT id, coalesce(nullif(e.kind, ''), '') AS kind, coalesce(e.category, 'unsorted') AS category, coalesce(e.kind, '') <> '' AS kind_user, e.category IS NOT NULL AS category_user
FROM docs LEFT JOIN e ON e.doc_id = id""")
def bundle_import(spark, sf_dir):
    """A bundle over documents that have lost their kinds and shelves; many of them share a file name."""
    d = L.documents(spark, sf_dir).withColumn("path", F.concat(F.lit("/lib/"), (F.col("id") % 50).cast("string"), F.lit(".txt")))
    m = store.extracted(store.parsed(store.manifest(L.collections(spark, sf_dir), L.members(spark, sf_dir), d, L.tags(spark, sf_dir))), "/import")
    there = d.join(m.select(F.col("doc_id").alias("id"), F.col("path").alias("_new")), "id", "left").withColumn("path", F.coalesce("_new", "path")).drop("_new")
    bare = there.withColumns({"kind": F.lit(""), "category": F.lit("unsorted")})
    return store.imported(bare, m).select("id", "kind", "category", "kind_user", "category_user")


@query("fast_summaries", f"""WITH fx AS (SELECT doc_id AS id, text, doc_id % 3 AS k FROM documents), a AS ({_WHOLE + _ABSTRACT}), f AS ({_WHOLE + _FRONT_MATTER}),
j AS (SELECT id, k, text, nullif(abstract, '') AS p, nullif(front, '') AS b, strlen(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 400 AS short FROM fx JOIN a USING (id) JOIN f USING (id))
SELECT id, CASE WHEN short THEN '' WHEN k = 0 AND p IS NOT NULL THEN p WHEN k = 1 AND b IS NOT NULL THEN b ELSE left(text, 200) END AS summary,
  CASE WHEN short THEN '' WHEN k = 0 AND p IS NOT NULL THEN 'abstract' WHEN k = 1 AND b IS NOT NULL THEN 'front-matter' ELSE 'generated' END AS source FROM j""")
def fast_summaries(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "paper").when(F.col("doc_id") % 3 == 1, "book").otherwise("")
    return d.select(F.col("doc_id").alias("id"), E.fast_summary(kind, F.col("text"), F.left("text", F.lit(200))).alias("s")).select("id", "s.*")


@query("stored_results", Q + f"""SELECT id, CASE WHEN id % 2 = 1 AND title <> '' THEN title WHEN id % 4 = 0 THEN '' ELSE 'T' || id END AS title,
  CASE WHEN id % 3 = 0 THEN 'old' WHEN lower(CASE id % 5 WHEN 0 THEN 'Unknown' ELSE 'A. Writer' END) IN ({_JUNK}) THEN '' ELSE 'A. Writer' END AS authors,
  CASE WHEN id % 2 = 0 THEN '2020' ELSE '' END AS year, CASE WHEN id % 3 = 0 THEN category ELSE 'new/shelf' END AS category,
  CASE WHEN id % 7 = 0 THEN 'before' ELSE 's' || id END AS summary, CASE WHEN id % 7 = 0 THEN status ELSE 'done' END AS status FROM docs""")
def stored_results(spark, sf_dir):
    i = F.col("id")
    d = L.documents(spark, sf_dir).withColumns(
        {
            "title": F.when(i % 2 == 1, F.col("title")).otherwise(""), "authors": F.when(i % 3 == 0, "old").otherwise(""), "year": F.lit(""),
            "category_user": i % 3 == 0, "category": F.when(i % 3 == 0, F.col("category")).otherwise(""), "summary": F.lit("before"),
        }
    )
    r = d.select(
        "id", F.when(i % 4 == 0, "N/A").otherwise(F.concat(F.lit("T"), i)).alias("title"), F.when(i % 5 == 0, "Unknown").otherwise("A. Writer").alias("authors"),
        F.when(i % 2 == 0, "2020").otherwise("c. 2020").alias("year"), F.lit("new/shelf").alias("category"), F.when(i % 7 != 0, F.concat(F.lit("s"), i)).alias("summary"),
    )
    return M.stored_results(d, r).select("id", "title", "authors", "year", "category", "summary", "status")


_PROPOSED = "list_distinct(list_filter([lower(trim(x)) FOR x IN [lang, ' Logic', 'HISTORY ', source, '', 'logic', 'extra', 'poetry']], lambda x: x <> ''))"
_VOCAB = "['logic', 'history', 'poetry', 'en', 'fr']"


@query("constrained_tags", f"""WITH p AS (SELECT doc_id, {_PROPOSED} AS x, [lang, source] AS parts FROM documents),
k AS (SELECT doc_id, list_filter(x, lambda t: list_contains({_VOCAB}, t)) AS known, list_filter(x, lambda t: NOT list_contains({_VOCAB}, t)) AS rest, parts FROM p),
f AS (SELECT doc_id, known, rest, list_filter(known, lambda t: NOT list_contains(parts, t)) AS kept FROM k)
SELECT doc_id, array_to_string(list_sort(CASE WHEN len(kept) = 0 THEN known ELSE kept END), ',') AS tags, least(2, len(rest))::INT AS n_other FROM f""")
def constrained_tags(spark, sf_dir):
    """Proposed tags held to a vocabulary; those that repeat a part of the shelf go."""
    d = table(spark, sf_dir, "documents")
    proposed = F.array("lang", F.lit(" Logic"), F.lit("HISTORY "), "source", F.lit(""), F.lit("logic"), F.lit("extra"), F.lit("poetry"))
    t = M.constrained_tags(proposed, ["logic", "history", "poetry", "en", "fr"], F.concat_ws("/", "lang", "source"))
    return d.select("doc_id", t.alias("t")).select("doc_id", F.array_join(F.array_sort("t.tags"), ",").alias("tags"), F.size("t.other").alias("n_other"))


@query("vocabulary_block", "SELECT string_agg('- ' || source || ': from ' || lang, chr(10) ORDER BY '- ' || source || ': from ' || lang) AS block FROM (SELECT source, min(lang) AS lang FROM documents GROUP BY 1)")
def vocabulary_block(spark, sf_dir):
    v = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("tag")).agg(F.concat(F.lit("from "), F.min("lang")).alias("description"))
    return E.vocabulary_block(v)


@query("watch_due", """WITH s AS (SELECT user_id::VARCHAR AS path, min(event_id % 3) AS size, 0::BIGINT AS mtime, event_id % 2 AS scan FROM events WHERE user_id % 11 <> 0 OR event_id % 2 = 0 GROUP BY 1, 4),
b AS (SELECT a.path, a.size, a.mtime FROM s a JOIN s c USING (path, size, mtime) WHERE a.scan = 1 AND c.scan = 0),
d AS (SELECT DISTINCT user_id::VARCHAR AS path, 0::BIGINT AS size, 0::BIGINT AS mtime FROM events WHERE user_id % 5 = 0)
SELECT 'due' AS list, path, size FROM b WHERE (path, size) NOT IN (SELECT (path, size) FROM d)
UNION ALL SELECT 'done', path, size FROM d WHERE path IN (SELECT path FROM s WHERE scan = 1)""")
def watch_due(spark, sf_dir):
    """Files that have settled and are not ingested yet, and what is remembered of files that still exist."""
    e = table(spark, sf_dir, "events")
    s = e.where("user_id % 11 <> 0 OR event_id % 2 = 0").groupBy(F.col("user_id").cast("string").alias("path"), (F.col("event_id") % 2).alias("scan"))
    s = s.agg(F.min(F.col("event_id") % 3).alias("size")).withColumn("mtime", F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    done = e.where("user_id % 5 = 0").select(F.col("user_id").cast("string").alias("path"), zero.alias("size"), zero.alias("mtime")).distinct()
    now, left = watch.due(s, done)
    named = lambda d, n: d.select(F.lit(n).alias("list"), "path", "size")
    return named(now, "due").unionByName(named(left, "done"))


@query("durations", "SELECT event_id, CASE WHEN value < 0 THEN '' WHEN round(value)::BIGINT < 60 THEN round(value)::BIGINT || 's' ELSE (round(value)::BIGINT // 60) || 'm' || lpad((round(value)::BIGINT % 60)::VARCHAR, 2, '0') || 's' END AS took FROM events")
def durations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", U.duration(F.col("value") * 1000).alias("took"))


@query("same_settings", "SELECT o_orderkey, list_sort(list_distinct([o_orderstatus, o_orderpriority])) = list_sort(list_distinct([o_orderpriority, left(o_orderpriority, 1), o_orderstatus])) AS same FROM orders")
def same_settings(spark, sf_dir):
    a = F.array("o_orderstatus", "o_orderpriority")
    b = F.array("o_orderpriority", F.left("o_orderpriority", F.lit(1)), "o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", M.same_set(a, b).alias("same"))


@query("embed_prefixes", """SELECT source, CASE WHEN source LIKE '%1%' THEN 'task: search result | query: ' WHEN source LIKE '%2%' THEN 'search_query: ' ELSE '' END AS query,
  CASE WHEN source LIKE '%1%' THEN 'title: none | text: ' WHEN source LIKE '%2%' THEN 'search_document: ' ELSE '' END AS document FROM (SELECT DISTINCT source FROM documents)""")
def embed_prefixes(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("source").distinct()
    model = F.when(F.col("source").contains("1"), F.concat(F.lit("org/EmbeddingGemma-"), "source")).when(F.col("source").contains("2"), F.concat("source", F.lit("-nomic-v1"))).otherwise("bge")
    return s.select("source", S.embed_prefixes(model).alias("p")).select("source", "p.*")


@query("normal_shelves", Q + "SELECT id, left(lower(regexp_replace(trim(category || ' New Shelf'), '\\s+', '-', 'g')), 40) AS shelf FROM docs")
def normal_shelves(spark, sf_dir):
    return L.documents(spark, sf_dir).select("id", T.normal_category(F.concat("category", F.lit(" New Shelf"))).alias("shelf"))


_SANE = ORACLES["text_sane"].replace("FROM documents)", "FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents))")


@query("ocr_targets", f"""WITH s AS ({_SANE}) SELECT source AS path, doc_id::INT AS page_no FROM documents JOIN s USING (doc_id)
WHERE strlen(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 400 OR (NOT sane AND doc_id % 2 = 0)""")
def ocr_targets(spark, sf_dir):
    """Documents as the pages of their sources: thin ones, and implausible ones with an image."""
    d = table(spark, sf_dir, "documents")
    p = d.select(F.col("source").alias("path"), F.col("doc_id").cast("int").alias("page_no"), "text", (F.col("doc_id") % 2 == 0).alias("has_image"))
    return files.ocr_targets(p, least=400)


def _heading(bad: int):
    """The first 40 characters; texts of some lengths fail until the backend is mended."""

    def work(text: str) -> str:
        if len(text) % 7 == bad:
            raise ValueError("no answer")
        return text[:40]

    return work


_EDITED = "CASE WHEN doc_id % 5 = 1 THEN text || ' (second edition)' ELSE text END"


@query("enrich_ledger", f"""WITH fx AS (SELECT doc_id AS id, {_EDITED} AS text, 0::BIGINT AS ocr, 0::BIGINT AS pages FROM documents){_kind_scores('fx')},
k AS (SELECT id, {_best()} AS kind FROM s), o AS (SELECT doc_id AS id, text AS old FROM documents),
d AS (SELECT id, kind, text, old, text <> old AND length(text) % 7 = 3 AS bad FROM fx JOIN k USING (id) JOIN o USING (id))
SELECT id, kind, CASE WHEN NOT bad THEN left(text, 40) END AS head, CASE WHEN NOT bad THEN left(text, 40) || ' / ' || kind END AS line, CASE WHEN bad THEN 'ingested' ELSE 'done' END AS status,
  CASE WHEN bad THEN 'head' END AS failed, (1 + (text <> old OR length(old) % 7 = 2)::INT)::BIGINT AS tries FROM d""")
def enrich_ledger(spark, sf_dir):
    """Three stages over all documents, with a backend that fails for some, then again with edited documents and another fault: only what failed or changed is tried again."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    edited = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(_EDITED).alias("text"))
    line = Stage("line", lambda d: d.select("id", F.concat_ws(" / ", "head", "kind").alias("result"), F.lit(None).cast("string").alias("error")), ("head", "kind"))
    ledger = Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    for d, bad in ((docs, 2), (edited, 3)):
        stages = [kind_stage(), mapped_stage("head", _heading(bad)), line]
        ledger.run(d, stages)
    tries = ledger.rows("head").groupBy("id").agg(F.count("*").alias("tries"))
    return ledger.results(edited, stages).drop("error").join(tries, "id")


def _assistant():
    """A backend without chance: it asks for a document, then for another one if that is not there."""

    def answer(messages: list, tools: list) -> tuple:
        import json

        asked, n = [m for m in messages if m["role"] == "tool"], len(messages[0]["content"])
        if not asked:
            return "looking", [("get_document", {"doc_id": n % 1500}), *([("nothing", {})] if n % 2 == 0 else [])]
        titles = [json.loads(m["content"])["title"] for m in asked if m["content"].startswith("{")]
        return (f"found {titles[0]}", []) if titles else ("", [("get_document", {"doc_id": 7})])

    return answer


@query("answered_conversations", Q + """, q AS (SELECT conv_id AS session_id, length(arg_min(text, turn)) AS n FROM conversations GROUP BY 1),
t AS (SELECT session_id, n, a.title AS one, b.title AS two FROM q LEFT JOIN docs a ON a.id = n % 1500 LEFT JOIN docs b ON b.id = 7)
SELECT session_id, 'found ' || coalesce(one, two) AS answer, (3 + (n % 2 = 0)::INT + (one IS NULL)::INT)::BIGINT AS n_events, (2 + (one IS NULL)::INT)::INT AS rounds FROM t""")
def answered_conversations(spark, sf_dir):
    """The tool loop for every conversation, starting from its first message."""
    q = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.min_by("text", "turn").alias("question"))
    docs = L.documents(spark, sf_dir)
    return conversed(q, _assistant(), [document_tool(docs, docs.select("id"))]).select("session_id", "answer", "n_events", "rounds")
