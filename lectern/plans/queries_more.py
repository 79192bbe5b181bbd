"""More listings, set operations and JSON sinks, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes as M
from ..operators import curation as C
from ..operators import jobs as J
from ..operators import library as L
from ..operators import search as S
from ..session import table
from ..streaming import watch
from .registry import query

Q = L.SQL


@query("palette_filter", Q + "SELECT id, title FROM docs WHERE contains(lower(title), 'the') ORDER BY title, id LIMIT 40")
def palette_filter(spark, sf_dir):
    return J.containing(L.documents(spark, sf_dir).select("id", "title"), F.col("title"), "The")


@query("range_selection", Q + """, o AS (SELECT id, category, row_number() OVER (ORDER BY category, id) AS n FROM docs)
SELECT id, category FROM o WHERE n BETWEEN (SELECT min(n) FROM o WHERE id IN (17, 90)) AND (SELECT max(n) FROM o WHERE id IN (17, 90))""")
def range_selection(spark, sf_dir):
    return J.between(L.documents(spark, sf_dir).select("id", "category"), [F.col("category"), F.col("id")], 90, 17)


@query("documents_json", Q + """SELECT id, path || '|' || title || '|' || status AS line FROM docs""")
def documents_json(spark, sf_dir):
    """Rows through a JSON text and back."""
    d = L.documents(spark, sf_dir).select("id", F.to_json(F.struct("path", "title", "status")).alias("j"))
    p = F.from_json("j", "path string, title string, status string")
    return d.select("id", F.concat_ws("|", p["path"], p["title"], p["status"]).alias("line"))


@query("collections_of_document", Q + "SELECT m.doc_id, c.name FROM members m JOIN collections c ON c.id = m.collection_id WHERE doc_id < 50")
def collections_of_document(spark, sf_dir):
    m = L.members(spark, sf_dir).where("doc_id < 50")
    return m.join(L.collections(spark, sf_dir), F.col("collection_id") == F.col("id")).select("doc_id", "name")


@query("collections_of_all_documents", Q + "SELECT m.doc_id, c.name FROM members m JOIN collections c ON c.id = m.collection_id")
def collections_of_all_documents(spark, sf_dir):
    m = L.members(spark, sf_dir)
    return m.join(L.collections(spark, sf_dir), F.col("collection_id") == F.col("id")).select("doc_id", "name")


@query("collection_tags", Q + "SELECT collection_id, tag, count(*) AS n FROM members JOIN tags USING (doc_id) GROUP BY ALL")
def collection_tags(spark, sf_dir):
    return L.members(spark, sf_dir).join(L.tags(spark, sf_dir), "doc_id").groupBy("collection_id", "tag").agg(F.count("*").alias("n"))


@query("sessions_with_counts", Q + ", s AS (SELECT DISTINCT conv_id AS id FROM conversations) SELECT id, (SELECT count(*) FROM messages WHERE session_id = s.id AND role = 'system') AS n FROM s")
def sessions_with_counts(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    n = L.messages(spark, sf_dir).where("role = 'system'").groupBy("session_id").agg(F.count("*").alias("n"))
    return s.join(n, s["id"] == n["session_id"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("tag_sets", Q + f"""SELECT tag, 'only applied' AS side FROM (SELECT DISTINCT tag FROM tags) WHERE tag NOT IN ({", ".join(f"'{v}'" for v in L.VOCABULARY)})
UNION ALL SELECT tag, 'both' FROM (SELECT DISTINCT tag FROM tags) WHERE tag IN ({", ".join(f"'{v}'" for v in L.VOCABULARY)})""")
def tag_sets(spark, sf_dir):
    """Difference and intersection of applied tags and the vocabulary."""
    used = L.tags(spark, sf_dir).select("tag").distinct()
    v = spark.createDataFrame([(t,) for t in L.VOCABULARY], "tag string")
    return used.exceptAll(v).withColumn("side", F.lit("only applied")).unionByName(used.intersect(v).withColumn("side", F.lit("both")))


@query("upsert_tags", Q + """, n AS (SELECT id AS doc_id, 'toxic' AS tag, 'manual' AS source FROM docs WHERE id % 6 = 0)
SELECT * FROM tags WHERE NOT (tag = 'toxic' AND doc_id IN (SELECT doc_id FROM n)) UNION ALL SELECT * FROM n""")
def upsert_tags(spark, sf_dir):
    new = L.documents(spark, sf_dir).where("id % 6 = 0").select(F.col("id").alias("doc_id"), F.lit("toxic").alias("tag"), F.lit("manual").alias("source"))
    return M.upserted(L.tags(spark, sf_dir), new, ["doc_id", "tag"])


@query("replace_chunks", Q + """, n AS (SELECT id * 1048576 AS id, id AS doc_id, 0 AS seq, left(text, 10) AS text FROM docs WHERE id % 9 = 0)
SELECT id, doc_id, seq, length(text) AS n FROM (SELECT * FROM chunks WHERE doc_id % 9 <> 0 UNION ALL SELECT * FROM n)""")
def replace_chunks(spark, sf_dir):
    d = L.documents(spark, sf_dir).where("id % 9 = 0")
    new = d.select((F.col("id") * L.IDS_PER_DOCUMENT).alias("id"), F.col("id").alias("doc_id"), F.lit(0).alias("seq"), F.left("text", F.lit(10)).alias("text"))
    out = M.replaced_children(L.chunks(spark, sf_dir), new)
    return out.select("id", "doc_id", "seq", F.length("text").cast("long").alias("n"))


@query("patch_documents", Q + "SELECT id, CASE WHEN id % 4 = 0 THEN 'course' ELSE kind END AS kind, CASE WHEN id % 8 = 0 THEN 'new' ELSE title END AS title, id % 4 = 0 AS kind_user FROM docs")
def patch_documents(spark, sf_dir):
    d = L.documents(spark, sf_dir).select("id", "kind", "title").withColumn("kind_user", F.lit(False))
    c = d.where("id % 4 = 0").select("id", F.lit("course").alias("kind"), F.when(F.col("id") % 8 == 0, "new").alias("title"))
    return M.patched(d, c, ["kind", "title"]).select("id", "kind", "title", "kind_user")


@query("regenerate_fields", Q + "SELECT id, CASE WHEN id % 5 <> 0 THEN 'shelf' ELSE category END AS category, title FROM docs")
def regenerate_fields(spark, sf_dir):
    d = L.documents(spark, sf_dir).select("id", "category", "title")
    r = d.where("id % 5 <> 0").select("id", F.lit("shelf").alias("category"), F.lit("other").alias("title"))
    return J.regenerated(d, r, ["category"])


@query("reextract_pages", Q + """, p AS (SELECT doc_id, seq + 1 AS page_no, CASE WHEN doc_id % 3 = 0 AND seq = 0 THEN 'repaired' ELSE text END AS text FROM chunks)
SELECT doc_id, page_no, length(text) AS n FROM p""")
def reextract_pages(spark, sf_dir):
    c = L.chunks(spark, sf_dir).withColumn("page_no", F.col("seq") + 1)
    fix = c.where("doc_id % 3 = 0 AND seq = 0").select("doc_id", "page_no", F.lit("repaired").alias("text"))
    _, out = J.reextracted(L.documents(spark, sf_dir), c, fix)
    return out.select("doc_id", "page_no", F.length("text").cast("long").alias("n"))


@query("sem_prefiltered", """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7)
SELECT vec_id AS id, label::BIGINT AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score
FROM embeddings CROSS JOIN q WHERE label % 2 = 0 ORDER BY score DESC, id LIMIT 8""")
def sem_prefiltered(spark, sf_dir):
    """The scope filters before the top k, so the limit is filled."""
    e = table(spark, sf_dir, "embeddings")
    v = e.where("label % 2 = 0").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("doc_id"), "embedding")
    return S.nearest_chunks(v, e.where("vec_id = 7").first()["embedding"], 8)


@query("snippets_per_document", Q + """, r AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, id) AS nth FROM chunks) SELECT * FROM r WHERE nth <= 3""")
def snippets_per_document(spark, sf_dir):
    return J.ranked_groups(L.chunks(spark, sf_dir), "doc_id", [F.length("text").desc(), F.col("id")], 3).select("doc_id", "id", "nth")


@query("tags_per_document", Q + "SELECT doc_id, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS tags FROM tags GROUP BY doc_id")
def tags_per_document(spark, sf_dir):
    return L.tags(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))


@query("chat_titles", r"""SELECT conv_id, turn, CASE WHEN length(t) > 60 THEN left(t, 60) || '…' ELSE t END AS title
FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS t FROM conversations WHERE turn = 0)""")
def chat_titles(spark, sf_dir):
    from ..operators.chat import title_of

    return table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", "turn", title_of(F.col("text")).alias("title"))


@query("vector_blobs", "SELECT vec_id, len(embedding)::BIGINT AS n FROM embeddings")
def vector_blobs(spark, sf_dir):
    """Vectors through their byte form and back; rows that come back changed would be missing."""
    from ..session import ship

    ship(spark)
    e = table(spark, sf_dir, "embeddings").withColumn("back", J.from_blob()(J.to_blob()("embedding")))
    return e.where("back = embedding").select("vec_id", F.size("back").cast("long").alias("n"))


@query("scope_context", Q + """, t AS (SELECT doc_id, list_sort(list(DISTINCT tag)) AS tags FROM tags GROUP BY 1)
SELECT id, '#' || id || ' ' || title || ' — ' || category || ' — ' || array_to_string(tags, ', ') || ' — ' || left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 240) AS line
FROM docs JOIN t ON doc_id = id WHERE category = 'de' OR starts_with(category, 'de/') ORDER BY id LIMIT 80""")
def scope_context(spark, sf_dir):
    from ..operators import chat as H

    lib = L.library(spark, sf_dir)
    d = C.tag_lists(lib["documents"], lib["tags"]).withColumn("summary", F.col("text"))
    return H.context(d, H.scope(lib, "category", "de"))


@query("scan_intervals", """WITH v AS (SELECT event_id, (floor(value * value) - 20)::INT AS v FROM events)
SELECT event_id, CASE WHEN v <= 0 THEN 5 WHEN v < 2 THEN 2 WHEN v > 86400 THEN 86400 ELSE v END::INT AS seconds FROM v""")
def scan_intervals(spark, sf_dir):
    """Every event's value as an interval that a user asks for."""
    asked = (F.floor(F.col("value") * F.col("value")) - 20).cast("int")
    return table(spark, sf_dir, "events").select("event_id", T.clamped_interval(asked).alias("seconds"))


@query("vocabulary_keys", """SELECT DISTINCT lower(regexp_replace(chr(9) || ' ' || upper(lang) || '-' || source || chr(10), '^\\s+|\\s+$', '', 'g')) AS key FROM documents""")
def vocabulary_keys(spark, sf_dir):
    raw = F.concat(F.lit("\t "), F.upper("lang"), F.lit("-"), "source", F.lit("\n"))
    return table(spark, sf_dir, "documents").select(T.vocabulary_key(raw).alias("key")).distinct()


@query("page_labels", Q + "SELECT id, CASE WHEN doc_id % 7 <> 0 AND seq + doc_id % 3 > 0 THEN 'p.' || (seq + doc_id % 3) ELSE 'chunk' END AS label FROM chunks")
def page_labels(spark, sf_dir):
    """Chunks of paged documents, of which some pages have no number, and of others."""
    page = F.when(F.col("doc_id") % 7 != 0, F.col("seq") + F.col("doc_id") % 3)
    return L.chunks(spark, sf_dir).select("id", T.page_label(page).alias("label"))


@query("missing_languages", """SELECT doc_id, array_to_string(list_filter([lang, 'fi', source, 'en'], lambda x: NOT list_contains(['en', 'de', 'src3'], x)), '+') AS missing FROM documents""")
def missing_languages(spark, sf_dir):
    asked = F.concat_ws("+", "lang", F.lit("fi"), "source", F.lit("en"))
    have = F.array(F.lit("en"), F.lit("de"), F.lit("src3"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.missing_languages(asked, have), "+").alias("missing"))


_STATUS = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END"


@query("job_transitions", f"""WITH j AS (SELECT user_id AS job, event_id AS \"at\", {_STATUS} AS status FROM events),
b AS (SELECT *, lag(status) OVER (PARTITION BY job ORDER BY \"at\") AS before FROM j) SELECT job, \"at\", status FROM b WHERE status IN ('done', 'failed') AND status IS DISTINCT FROM before""")
def job_transitions(spark, sf_dir):
    """Events as reports of a user's job: when it changed to done or failed."""
    jobs = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), F.expr(_STATUS).alias("status"))
    return watch.transitions(jobs)
