"""Search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import library as L
from ..operators import search as S
from ..operators.embedding import Vectors
from ..operators.keyword_index import KeywordIndex
from ..session import shared_folder, table
from ..sources.versions import Files
from .registry import query

QUERY = "the nation ering leaux"
_roots: dict[tuple[str, str], str] = {}


def stored_index(spark, sf_dir):
    """(postings, statistics) of a library's chunks: an index in the shared folder, made by a session's first query and brought to the table by later ones."""
    root = _roots.setdefault((spark.sparkContext.applicationId, sf_dir), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index, path = KeywordIndex(spark, root), f"{sf_dir}/documents.parquet"
    index.refresh(L.chunks(spark, sf_dir), Files(spark, path).stamp(path))
    return index.read()


def _bm25_sql(match: str, terms: str, k: int, extra: str = "", more: str = "", source: str = "chunks") -> str:
    """``terms``: SQL list of terms; ``match``: condition on chunk ids; ``more``: tables before, of which ``source`` is indexed."""
    return f"""{L.SQL},{more}
tok AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM {source}),
e AS (SELECT id, unnest(w) AS term FROM tok),
p AS (SELECT term, id, count(*) AS tf FROM e GROUP BY ALL),
st AS (SELECT count(*) AS n_chunks, avg(len(w)) AS mean FROM tok),
q AS (SELECT {terms}),
h AS (SELECT q.term AS term, p.id, sum(tf) AS tf FROM p JOIN q ON {"starts_with(p.term, q.term)" if extra == "prefix" else "p.term = q.term"} GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM h GROUP BY term),
s AS (
  SELECT h.id, round(sum((CASE WHEN ln((n_chunks - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_chunks - n + 0.5) / (n + 0.5)) END)
         * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))), 6) AS score
  FROM h JOIN df USING (term) JOIN tok USING (id) CROSS JOIN st WHERE {match} GROUP BY h.id),
top AS (SELECT * FROM s ORDER BY score DESC, id LIMIT {k})
"""


_OR = _bm25_sql("true", "unnest(['the', 'nation', 'ering', 'leaux']) AS term", 20)
_SNIPPET = """
, x AS (SELECT top.id, score, w, ['the', 'nation', 'ering', 'leaux'] AS k,
          list_transform(range(1, greatest(1, len(w) - 11) + 1), lambda i: {'n': len(list_intersect(list_slice(w, i, i + 11), ['the', 'nation', 'ering', 'leaux'])), 'at': -i}) AS c
        FROM top JOIN tok USING (id)),
y AS (SELECT *, -(list_max(c)).at AS s FROM x)
SELECT y.id AS chunk_id, chunks.doc_id, docs.path, score,
       CASE WHEN s > 1 THEN '…' ELSE '' END
       || array_to_string(list_transform(list_slice(w, s, s + 11), lambda t: CASE WHEN list_contains(k, t) THEN '[' || t || ']' ELSE t END), ' ')
       || CASE WHEN s + 12 <= len(w) THEN '…' ELSE '' END AS snippet
FROM y JOIN chunks ON chunks.id = y.id JOIN docs ON docs.id = chunks.doc_id
"""


@query("kw_bm25_topk", _OR + _SNIPPET)
def kw_bm25_topk(spark, sf_dir):
    return S.keyword(L.chunks(spark, sf_dir), L.documents(spark, sf_dir), " OR ".join(QUERY.split()), 20, stored_index(spark, sf_dir))


def _top(spark, sf_dir, q, k):
    return S.ranked(*stored_index(spark, sf_dir), q, k)


_HAS = "h.id IN (SELECT id FROM p WHERE term = '{}')"


@query("kw_and_not", _bm25_sql(f"{_HAS.format('the')} AND {_HAS.format('tion')} AND NOT {_HAS.format('this')}", "unnest(['the', 'tion']) AS term", 15) + "SELECT id AS chunk_id, score FROM top")
def kw_and_not(spark, sf_dir):
    return _top(spark, sf_dir, "the tion NOT this", 15)


@query("kw_prefix", _bm25_sql("true", "'erin' AS term", 15, "prefix") + "SELECT id AS chunk_id, score FROM top")
def kw_prefix(spark, sf_dir):
    return _top(spark, sf_dir, "erin*", 15)


@query("kw_phrase", f"""{L.SQL},
tok AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM chunks),
c AS (SELECT id, len(w) AS n_tokens, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS tf FROM tok),
st AS (SELECT count(*) AS n_chunks, avg(n_tokens) AS mean, count(*) FILTER (tf > 0) AS n FROM c)
SELECT id AS chunk_id, round((CASE WHEN ln((n_chunks - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_chunks - n + 0.5) / (n + 0.5)) END)
       * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / mean)), 6) AS score
FROM c CROSS JOIN st WHERE tf > 0 ORDER BY score DESC, id LIMIT 15""")
def kw_phrase(spark, sf_dir):
    return _top(spark, sf_dir, '"of the"', 15)


@query("kw_near", f"""{L.SQL},
tok AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM chunks),
st AS (SELECT count(*) AS n_chunks, avg(len(w)) AS mean FROM tok),
e AS (SELECT id, unnest(w) AS term, unnest(range(len(w))) AS p FROM tok),
f AS (SELECT id, p, term, p + 1 + 3 AS reach FROM e WHERE term IN ('of', 'the')),
b AS (SELECT f.id, f.p, f.reach FROM f JOIN f x ON x.id = f.id AND x.p BETWEEN f.p AND f.reach GROUP BY ALL HAVING count(DISTINCT x.term) = 2),
part AS (SELECT DISTINCT x.id, x.p, x.term FROM f x JOIN b ON b.id = x.id AND x.p BETWEEN b.p AND b.reach),
tf AS (SELECT id, term, count(*) AS tf FROM part GROUP BY ALL),
df AS (SELECT term, count(DISTINCT id) AS n FROM f GROUP BY term)
SELECT id AS chunk_id, round(sum((CASE WHEN ln((n_chunks - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_chunks - n + 0.5) / (n + 0.5)) END)
       * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))), 6) AS score
FROM tf JOIN df USING (term) JOIN tok USING (id) CROSS JOIN st GROUP BY id ORDER BY score DESC, id LIMIT 50""")
def kw_near(spark, sf_dir):
    return _top(spark, sf_dir, "NEAR(of the, 3)", 50)


@query("kw_postfilter", _OR + "SELECT top.id AS chunk_id, score FROM top JOIN chunks USING (id) JOIN docs ON docs.id = chunks.doc_id WHERE status = 'done'")
def kw_postfilter(spark, sf_dir):
    """Filters after the top k, so fewer may be left."""
    c = L.chunks(spark, sf_dir)
    top = S.ranked(*stored_index(spark, sf_dir), " OR ".join(QUERY.split()), 20)
    ok = L.documents(spark, sf_dir).where("status = 'done'").select(F.col("id").alias("doc_id"))
    return c.select(F.col("id").alias("chunk_id"), "doc_id").join(F.broadcast(top), "chunk_id").join(ok, "doc_id", "left_semi").select("chunk_id", "score")


@query("kw_scoped_tool", _bm25_sql("true", "unnest(['the', 'nation', 'ering', 'leaux']) AS term", 24) + """
SELECT top.id AS chunk_id, score FROM top JOIN chunks USING (id) JOIN docs ON docs.id = chunks.doc_id
WHERE category LIKE 'en/%' ORDER BY score DESC, top.id LIMIT 8""")
def kw_scoped_tool(spark, sf_dir):
    """Three times the limit is ranked, then the scope filters, then the limit cuts."""
    c = L.chunks(spark, sf_dir)
    top = S.ranked(*stored_index(spark, sf_dir), " OR ".join(QUERY.split()), 24)
    scope = L.documents(spark, sf_dir).where(F.col("category").startswith("en/")).select(F.col("id").alias("doc_id"))
    hits = c.select(F.col("id").alias("chunk_id"), "doc_id").join(F.broadcast(top), "chunk_id").join(scope, "doc_id", "left_semi")
    return hits.orderBy(F.col("score").desc(), "chunk_id").limit(8).select("chunk_id", "score")


_CHANGED = """
changed AS (
  SELECT id, CASE WHEN doc_id % 5 = 1 THEN text || ' revised ering edition' ELSE text END AS text FROM chunks WHERE doc_id % 7 <> 0
  UNION ALL SELECT id + 1000000000000, 'a fresh start ' || text FROM chunks WHERE doc_id % 11 = 3),"""


@query("kw_after_changes", _bm25_sql("true", "unnest(['the', 'revised', 'fresh', 'ering']) AS term", 40, more=_CHANGED, source="changed") + "SELECT id AS chunk_id, score FROM top")
def kw_after_changes(spark, sf_dir):
    """An index after inserts, edits, deletes and a merge ranks as one of the final table would."""
    index, c = KeywordIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"), L.chunks(spark, sf_dir)
    index.refresh(c)
    index.apply(c.where("doc_id % 11 = 3").select((F.col("id") + 1_000_000_000_000).alias("id"), F.concat(F.lit("a fresh start "), "text").alias("text")))
    index.apply(c.where("doc_id % 5 = 1").select("id", F.concat("text", F.lit(" revised ering edition")).alias("text")))
    index.apply(deletes=c.where("doc_id % 7 = 0").select("id"))
    index.merge(most=2)
    index.vacuum(keep=1)
    return S.ranked(*index.read(), "the OR revised OR fresh OR ering", 40)


def letter_counts(texts: list[str]) -> list[list[float]]:
    """An embedder that SQL can follow."""
    return [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]


@query("embed_resumed", f"""{L.SQL}, t AS (SELECT id, CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN ' ' ELSE 'doc: ' || text END AS t FROM chunks)
SELECT id, length(t)::BIGINT AS n, (length(t) - length(replace(t, 'e', '')))::BIGINT AS e, (length(t) - length(replace(t, ' ', '')))::BIGINT AS blanks FROM t""")
def embed_resumed(spark, sf_dir):
    """Vectors of all chunks, made in committed rounds by a run that was stopped and another one that went on."""
    chunks = L.chunks(spark, sf_dir)
    vectors = Vectors(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    asked = []
    work = dict(embedder=letter_counts, space="letters", prefix="doc: ", max_tokens=10_000, round_rows=chunks.count() // 4 + 1)
    vectors.embed(chunks, cancelled=lambda: asked.append(1) or len(asked) > 3, **work)
    vectors.embed(chunks, **work)
    part = lambda k: F.get("embedding", F.lit(k)).cast("long")
    return vectors.read(chunks).select("id", part(0).alias("n"), part(1).alias("e"), part(2).alias("blanks"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("doc_id"), "embedding")


def _query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]


_SCORED = """
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7),
s AS (SELECT vec_id AS id, label::BIGINT AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings CROSS JOIN q)
"""
_GROUPED = """,
b AS (SELECT doc_id, row_number() OVER (ORDER BY ms DESC, mi) AS doc_rank
      FROM (SELECT doc_id, max(score) AS ms, arg_min(id, (-score, id)) AS mi FROM s GROUP BY doc_id)),
r AS (SELECT doc_rank, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, id) AS nth, id, score FROM s JOIN b USING (doc_id))
"""


@query("sem_topk_chunks", _SCORED + "SELECT id, doc_id, score FROM s ORDER BY score DESC, id LIMIT 25")
def sem_topk_chunks(spark, sf_dir):
    return S.nearest_chunks(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 25)


@query("sem_grouped_docs", _SCORED + _GROUPED + "SELECT * FROM r WHERE nth <= 3 AND doc_rank <= 5")
def sem_grouped_docs(spark, sf_dir):
    return S.semantic(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 5)


@query("sem_scoped", _SCORED + ", t AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 24) SELECT id, doc_id, score FROM t WHERE doc_id % 2 = 0 ORDER BY score DESC, id LIMIT 8")
def sem_scoped(spark, sf_dir):
    top = S.nearest_chunks(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 24)
    return top.where("doc_id % 2 = 0").orderBy(F.col("score").desc(), "id").limit(8)


@query("hit_highlight", f"""{L.SQL}
SELECT id, regexp_replace(text, '(?i)(the|ering)', '<mark>\\1</mark>', 'g') AS shown FROM docs WHERE regexp_matches(text, '(?i)ering')""")
def hit_highlight(spark, sf_dir):
    from ..functions.text import highlighted

    d = L.documents(spark, sf_dir).where(F.col("text").rlike("(?i)ering"))
    return d.select("id", highlighted(F.col("text"), ["the", "ering"]).alias("shown"))
