"""Aggregates, filters, joins and mutations over the library, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as M
from ..operators import curation as C
from ..operators import library as L
from ..session import table
from .registry import query

Q = L.SQL


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query("stats_overview", Q + f"""
SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM docs WHERE status = 'done') AS done,
  (SELECT count(*) FROM docs WHERE status = 'ingested') AS pending, (SELECT count(*) FROM docs WHERE status = 'error') AS errors,
  (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS embedded,
  (SELECT count(*) FROM collections) AS collections, (SELECT count(DISTINCT session_id) FROM messages) AS chats, {len(L.VOCABULARY)}::BIGINT AS vocab""")
def stats_overview(spark, sf_dir):
    return C.overview(L.library(spark, sf_dir), _vectors(spark, sf_dir), L.VOCABULARY)


@query("docs_by_kind", Q + "SELECT coalesce(nullif(kind, ''), '(none)') AS kind, count(*) AS n FROM docs GROUP BY 1")
def docs_by_kind(spark, sf_dir):
    return C.counted(L.documents(spark, sf_dir), C.or_none(F.col("kind")), "kind")


@query("docs_by_category", Q + "SELECT coalesce(nullif(category, ''), '(none)') AS category, count(*) AS n FROM docs GROUP BY 1")
def docs_by_category(spark, sf_dir):
    return C.counted(L.documents(spark, sf_dir), C.or_none(F.col("category")), "category")


@query("top_tags", Q + "SELECT tag, count(*) AS n FROM tags GROUP BY tag ORDER BY n DESC, tag LIMIT 60")
def top_tags(spark, sf_dir):
    return C.top_tags(L.tags(spark, sf_dir))


_VOCAB = ", ".join(f"('{v}')" for v in L.VOCABULARY)


@query("tag_cloud", Q + f""", v(tag) AS (VALUES {_VOCAB}),
u AS (SELECT tag, count(DISTINCT doc_id) AS docs, bool_or(source = 'suggested') AS s FROM tags GROUP BY tag),
j AS (SELECT coalesce(v.tag, u.tag) AS tag, coalesce(docs, 0) AS docs, v.tag IS NOT NULL AS in_vocab, coalesce(s, false) AND v.tag IS NULL AS suggested FROM v FULL JOIN u ON v.tag = u.tag)
SELECT *, round(0.85 + 1.5 * sqrt(docs / greatest(1, max(docs) OVER ())), 2) AS weight FROM j""")
def tag_cloud(spark, sf_dir):
    v = spark.createDataFrame([(t,) for t in L.VOCABULARY], "tag string")
    return C.tag_cloud(L.tags(spark, sf_dir), v)


@query("tag_suggestions", Q + "SELECT tag, count(*) AS n, min(title) AS example FROM tags JOIN docs ON docs.id = doc_id WHERE source = 'suggested' GROUP BY tag")
def tag_suggestions(spark, sf_dir):
    return C.suggestions(L.tags(spark, sf_dir), L.documents(spark, sf_dir))


@query("category_tree", Q + """, o AS (SELECT category, count(*) AS n FROM docs GROUP BY 1),
e AS (SELECT n, category, unnest([split_part(category, '/', 1), category]) AS node FROM o)
SELECT node, sum(CASE WHEN node = category THEN n ELSE 0 END)::BIGINT AS own, sum(n)::BIGINT AS total FROM e GROUP BY node""")
def category_tree(spark, sf_dir):
    return C.category_tree(L.documents(spark, sf_dir))


@query("bar_percent", Q + ", c AS (SELECT category, count(*) AS n FROM docs GROUP BY 1) SELECT *, round(100 * n / max(n) OVER (), 1) AS pct FROM c")
def bar_percent(spark, sf_dir):
    return C.bar_percent(C.counted(L.documents(spark, sf_dir), F.col("category"), "category"))


@query("collections_with_counts", Q + "SELECT id, name, count(doc_id) AS n_docs FROM collections LEFT JOIN members ON collection_id = id GROUP BY id, name")
def collections_with_counts(spark, sf_dir):
    return C.collection_counts(L.collections(spark, sf_dir), L.members(spark, sf_dir))


@query("collection_members", Q + "SELECT c.name, d.id, d.path FROM collections c JOIN members m ON m.collection_id = c.id JOIN docs d ON d.id = m.doc_id")
def collection_members(spark, sf_dir):
    m = L.members(spark, sf_dir).join(L.collections(spark, sf_dir), F.col("collection_id") == F.col("id")).select("name", "doc_id")
    return m.join(L.documents(spark, sf_dir), F.col("doc_id") == F.col("id")).select("name", "id", "path")


@query("tag_division", Q + "SELECT doc_id FROM tags WHERE tag IN ('high-quality', 'lang-en') GROUP BY doc_id HAVING count(DISTINCT tag) = 2")
def tag_division(spark, sf_dir):
    return C.with_all_tags(L.tags(spark, sf_dir), ["high-quality", "lang-en", "lang-en"])


@query("doc_filter_all_tags", Q + """, t AS (SELECT doc_id, list_sort(list(DISTINCT tag)) AS tags FROM tags GROUP BY 1)
SELECT id, array_to_string(tags, ', ') AS tags FROM docs JOIN t ON doc_id = id
WHERE lower(kind) = 'book' AND list_contains(tags, 'lang-en') AND list_contains(tags, 'high-quality')""")
def doc_filter_all_tags(spark, sf_dir):
    d = C.tag_lists(L.documents(spark, sf_dir).select("id", "kind", "category"), L.tags(spark, sf_dir))
    return d.where(C.matches("Book", tags=["Lang-EN", "high-quality"])).select("id", F.array_join("tags", ", ").alias("tags"))


@query("all_documents", Q + """, t AS (SELECT doc_id, list_sort(list(DISTINCT tag)) AS tags FROM tags GROUP BY 1)
SELECT id, title, coalesce(kind, '') AS kind, array_to_string(coalesce(tags, []), ', ') AS tags FROM docs LEFT JOIN t ON doc_id = id""")
def all_documents(spark, sf_dir):
    d = C.tag_lists(L.documents(spark, sf_dir).select("id", "title", "kind"), L.tags(spark, sf_dir))
    return d.select("id", "title", F.coalesce("kind", F.lit("")).alias("kind"), F.array_join("tags", ", ").alias("tags"))


@query("subtree_filter", Q + "SELECT id FROM docs WHERE category = 'en' OR starts_with(category, 'en/')")
def subtree_filter(spark, sf_dir):
    return L.documents(spark, sf_dir).where(C.in_subtree(F.col("category"), "en")).select("id")


_DIRS = ("/lib/en", "/lib/de/src3", "/lib", "/nowhere")
_DIRS_SQL = ", ".join(f"('{d}')" for d in _DIRS)


@query("pending_under_dirs", Q + """SELECT id, path FROM docs WHERE status = 'ingested'
AND (starts_with(path, '/lib/en/') OR starts_with(path, '/lib/de/src3/'))""")
def pending_under_dirs(spark, sf_dir):
    cond = C.under(F.col("path"), F.lit("/lib/en")) | C.under(F.col("path"), F.lit("/lib/de/src3"))
    return L.documents(spark, sf_dir).where((F.col("status") == "ingested") & cond).select("id", "path")


@query("folder_stats", Q + f""", dirs(dir) AS (VALUES {_DIRS_SQL})
SELECT dir, count(id) AS docs, count(id) FILTER (status = 'ingested') AS pending
FROM dirs LEFT JOIN docs ON path = dir OR starts_with(path, dir || '/') GROUP BY dir""")
def folder_stats(spark, sf_dir):
    return C.folder_stats(L.documents(spark, sf_dir), spark.createDataFrame([(d,) for d in _DIRS], "dir string"))


@query("dup_groups", Q + """, g AS (SELECT id, sha256, min(id) OVER (PARTITION BY sha256) AS canonical FROM docs)
SELECT sha256, canonical, id AS duplicate FROM g WHERE id <> canonical""")
def dup_groups(spark, sf_dir):
    return M.duplicates(L.documents(spark, sf_dir))


@query("sha3_groups", Q + """, c AS (SELECT sha256, id AS duplicate, min(id) OVER (PARTITION BY text) AS canonical FROM docs)
SELECT sha256, canonical, duplicate FROM c WHERE duplicate <> canonical""")
def sha3_groups(spark, sf_dir):
    from ..session import ship

    ship(spark)
    return M.verified_duplicates(L.documents(spark, sf_dir)).drop("sha3")  # the twin groups by the texts themselves


@query("first_path_wins", Q + "SELECT path, CASE WHEN path = min(path) OVER (PARTITION BY sha256) THEN 'added' ELSE 'duplicate' END AS action FROM docs")
def first_path_wins(spark, sf_dir):
    return M.first_wins(L.documents(spark, sf_dir))


@query("merge_tags", Q + """, m AS (SELECT id, min(id) OVER (PARTITION BY sha256) AS canonical FROM docs),
r AS (SELECT canonical AS doc_id, tag, source, row_number() OVER (PARTITION BY canonical, tag ORDER BY id <> canonical, id, source) AS n FROM tags JOIN m ON m.id = doc_id)
SELECT doc_id, tag, source FROM r WHERE n = 1""")
def merge_tags(spark, sf_dir):
    return M.merged_tags(L.tags(spark, sf_dir), M.canonical_ids(L.documents(spark, sf_dir)))


@query("merge_members", Q + """, m AS (SELECT id, min(id) OVER (PARTITION BY sha256) AS canonical FROM docs)
SELECT DISTINCT collection_id, canonical AS doc_id FROM members JOIN m ON m.id = doc_id""")
def merge_members(spark, sf_dir):
    return M.merged_members(L.members(spark, sf_dir), M.canonical_ids(L.documents(spark, sf_dir)))


def _scan(spark, sf_dir):
    """Files as they lie in the folder now: some stored, some changed, some new, some empty."""
    d = L.documents(spark, sf_dir)
    text = F.when(F.col("id") % 7 == 1, F.concat("text", F.lit(" changed"))).when(F.col("id") % 7 == 2, "").otherwise(F.col("text"))
    path = F.when(F.col("id") % 7 == 3, F.concat("path", F.lit(".md"))).otherwise(F.col("path"))
    return d.select(path.alias("path"), text.alias("text")).withColumn("sha256", F.sha2("text", 256)), d.where("id % 7 <> 4")


_SCAN = Q + """, files AS (SELECT path, text, sha256(text) AS sha256 FROM (
  SELECT CASE WHEN id % 7 = 3 THEN path || '.md' ELSE path END AS path, CASE WHEN id % 7 = 1 THEN text || ' changed' WHEN id % 7 = 2 THEN '' ELSE text END AS text FROM docs)),
stored AS (SELECT * FROM docs WHERE id % 7 <> 4),
a AS (SELECT f.path, CASE WHEN s.sha256 = f.sha256 THEN 'skipped'
  WHEN s.sha256 IS NULL AND (f.sha256 IN (SELECT sha256 FROM stored) OR f.path <> min(f.path) OVER (PARTITION BY f.sha256)) THEN 'duplicate'
  WHEN regexp_replace(f.text, '\\s+', '', 'g') = '' THEN 'failed' WHEN s.sha256 IS NOT NULL THEN 'updated' ELSE 'added' END AS action
  FROM files f LEFT JOIN stored s ON s.path = f.path)
"""


@query("ingest_actions", _SCAN + "SELECT path, action FROM a")
def ingest_actions(spark, sf_dir):
    return M.ingest_actions(*_scan(spark, sf_dir))


@query("ingest_run_stats", _SCAN + "SELECT action, count(*) AS n FROM a GROUP BY action")
def ingest_run_stats(spark, sf_dir):
    return M.ingest_actions(*_scan(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


@query("plain_text_chunks", Q + "SELECT id, doc_id, seq, length(text) AS n FROM chunks")
def plain_text_chunks(spark, sf_dir):
    return L.chunks(spark, sf_dir).select("id", "doc_id", "seq", F.length("text").cast("long").alias("n"))


@query("doc_text_reassembly", Q + "SELECT doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY seq)) AS sha FROM chunks GROUP BY doc_id")
def doc_text_reassembly(spark, sf_dir):
    return C.reassembled(L.chunks(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("sha"))


@query("skip_pages_text", Q + """, p AS (SELECT *, CASE WHEN seq = 3 THEN NULL ELSE seq + 1 END AS page_no FROM chunks)
SELECT doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY seq)) AS sha FROM p
WHERE page_no IS NULL OR NOT ((doc_id % 2 = 0 AND page_no IN (1, 3, 4)) OR (doc_id % 2 = 1 AND page_no = 2)) GROUP BY doc_id""")
def skip_pages_text(spark, sf_dir):
    from ..functions.text import page_list

    c = L.chunks(spark, sf_dir).withColumn("page_no", F.when(F.col("seq") != 3, F.col("seq") + 1))
    pages = F.when(F.col("id") % 2 == 0, "1,3-4").otherwise("2, x")
    skip = L.documents(spark, sf_dir).select(F.col("id").alias("doc_id"), page_list(pages).alias("skip"))
    return C.reassembled(c, skip).select("doc_id", F.sha2("text", 256).alias("sha"))


@query("rename_category", Q + """SELECT id, CASE WHEN category = 'en' THEN 'english/all' WHEN starts_with(category, 'en/') THEN 'english/all' || substr(category, 3) ELSE category END AS category FROM docs""")
def rename_category(spark, sf_dir):
    return L.documents(spark, sf_dir).select("id", M.renamed_category(F.col("category"), "/en/", "english/all").alias("category"))


@query("vocab_promote", Q + "SELECT doc_id, tag, CASE WHEN tag = 'toxic' THEN 'vocab' ELSE source END AS source FROM tags")
def vocab_promote(spark, sf_dir):
    return M.promoted(L.tags(spark, sf_dir), " Toxic")


@query("vocab_remove", Q + "SELECT * FROM tags WHERE tag <> 'toxic'")
def vocab_remove(spark, sf_dir):
    return M.without_tag(L.tags(spark, sf_dir), "toxic")


@query("cascade_delete", Q + """, gone AS (SELECT id FROM docs WHERE id % 10 = 3)
SELECT 'documents' AS t, count(*) AS n FROM docs WHERE id NOT IN (FROM gone) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE doc_id NOT IN (FROM gone)
UNION ALL SELECT 'tags', count(*) FROM tags WHERE doc_id NOT IN (FROM gone) UNION ALL SELECT 'members', count(*) FROM members WHERE doc_id NOT IN (FROM gone)""")
def cascade_delete(spark, sf_dir):
    lib = L.library(spark, sf_dir)
    left = M.deleted(lib, lib["documents"].where("id % 10 = 3").select("id"))
    out = [left[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in ("documents", "chunks", "tags", "members")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("recent_session", Q + """, s AS (SELECT session_id, max(id) AS updated, session_id % 7 AS scope FROM messages GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY updated DESC, session_id DESC) AS n FROM s) SELECT scope, session_id, updated FROM r WHERE n = 1""")
def recent_session(spark, sf_dir):
    s = L.messages(spark, sf_dir).groupBy("session_id").agg(F.max("id").alias("updated")).withColumn("scope", F.col("session_id") % 7)
    return C.newest_per(s, ["scope"], [F.col("updated").desc(), F.col("session_id").desc()]).select("scope", "session_id", "updated")


@query("messages_per_session", Q + "SELECT session_id, count(*) AS n FROM messages GROUP BY session_id")
def messages_per_session(spark, sf_dir):
    return L.messages(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n"))


_ISLANDS = """, f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY session_id ORDER BY id) = role THEN 0 ELSE 1 END AS new FROM messages),
i AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY id) - 1 AS island FROM f)
SELECT session_id, island::BIGINT AS island, role, string_agg(content, chr(10) ORDER BY id) AS content FROM i GROUP BY session_id, island, role"""


@query("event_islands", Q + _ISLANDS)
def event_islands(spark, sf_dir):
    d = C.islands(L.messages(spark, sf_dir), "session_id", "id", "role")
    rows = F.array_sort(F.collect_list(F.struct("id", "content")))
    return d.groupBy("session_id", "island", "role").agg(F.array_join(F.transform(rows, lambda x: x["content"]), "\n").alias("content"))


@query("revert_tail", Q + ", u AS (SELECT session_id, max(id) AS last FROM messages WHERE role = 'user' GROUP BY 1) SELECT m.session_id, m.id FROM messages m LEFT JOIN u USING (session_id) WHERE last IS NULL OR id < last")
def revert_tail(spark, sf_dir):
    """Sessions without their last question and everything after it."""
    m = L.messages(spark, sf_dir)
    last = m.where("role = 'user'").groupBy("session_id").agg(F.max("id").alias("last"))
    return m.join(last, "session_id", "left").where("last IS NULL OR id < last").select("session_id", "id")


@query("chat_export", Q + """SELECT session_id, sha256(string_agg('## ' || role || chr(10) || content, chr(10) || chr(10) ORDER BY id)) AS sha FROM messages GROUP BY 1""")
def chat_export(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("id", F.concat(F.lit("## "), "role", F.lit("\n"), "content").alias("t"))))
    return L.messages(spark, sf_dir).groupBy("session_id").agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n"), 256).alias("sha"))


@query("opening_chunks", Q + "SELECT doc_id, arg_min(text, seq) AS opening FROM chunks GROUP BY doc_id")
def opening_chunks(spark, sf_dir):
    return L.chunks(spark, sf_dir).groupBy("doc_id").agg(F.min_by("text", "seq").alias("opening"))


@query("unique_names", Q + """, r AS (SELECT id, title, row_number() OVER (PARTITION BY title ORDER BY id) AS n FROM docs)
SELECT id, CASE WHEN n = 1 THEN title ELSE title || ' (' || n || ')' END AS unique_name FROM r""")
def unique_names(spark, sf_dir):
    return C.numbered_names(L.documents(spark, sf_dir).select("id", "title"), "title", ["id"]).select("id", "unique_name")


@query("not_in_collection", Q + "SELECT id FROM docs WHERE id NOT IN (SELECT doc_id FROM members)")
def not_in_collection(spark, sf_dir):
    m = L.members(spark, sf_dir).select(F.col("doc_id").alias("id"))
    return L.documents(spark, sf_dir).select("id").join(m, "id", "left_anti")


@query("newest_pins", Q + "SELECT id, title FROM docs WHERE kind IN ('paper', 'book') ORDER BY id DESC LIMIT 300")
def newest_pins(spark, sf_dir):
    return L.documents(spark, sf_dir).where(F.col("kind").isin("paper", "book")).select("id", "title").orderBy(F.col("id").desc()).limit(300)


@query("add_members", Q + """, n AS (SELECT 3::BIGINT AS collection_id, doc_id FROM documents WHERE doc_id % 4 = 0)
SELECT * FROM members UNION SELECT * FROM n""")
def add_members(spark, sf_dir):
    m = L.members(spark, sf_dir)
    new = table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(F.lit(3).cast("long").alias("collection_id"), "doc_id")
    return M.added_members(m, new)[0]


@query("chunk_packing", Q.replace("WITH", "WITH RECURSIVE", 1) + """, j AS (SELECT session_id, string_split(string_agg(content, chr(10) || chr(10) ORDER BY id), chr(10) || chr(10)) AS ps FROM messages GROUP BY 1),
p AS (SELECT session_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM j),
r AS (SELECT session_id, i, p, 0 AS pack, length(p) + 2 AS n FROM p WHERE i = 0 UNION ALL
  SELECT p.session_id, p.i, p.p, CASE WHEN r.n + length(p.p) > 2000 THEN r.pack + 1 ELSE r.pack END, CASE WHEN r.n + length(p.p) > 2000 THEN 0 ELSE r.n END + length(p.p) + 2
  FROM r JOIN p ON p.session_id = r.session_id AND p.i = r.i + 1),
k AS (SELECT session_id, pack, string_agg(p, chr(10) || chr(10) ORDER BY i) AS t FROM r GROUP BY ALL)
SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY pack) - 1)::INT AS seq, t AS pack FROM k WHERE regexp_replace(t, '\\s+', '', 'g') <> ''""")
def chunk_packing(spark, sf_dir):
    """Greedy packing of a session's messages into packs of 2000 characters."""
    rows = F.array_sort(F.collect_list(F.struct("id", "content")))
    d = L.messages(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.transform(rows, lambda x: x["content"]), "\n\n").alias("text"))
    return d.select("session_id", F.posexplode(C.packed(F.col("text"), 2000)).alias("seq", "pack"))
