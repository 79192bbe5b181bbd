"""Text functions, kinds and quality over real rows and literal fixtures, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinds as K
from ..functions import quality as Y
from ..functions import text as T
from ..operators import changes as M
from ..operators import library as L
from ..session import table
from .registry import query

Q = L.SQL


def _values(rows) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

_BODY = r"""CASE conv_id % 6 WHEN 0 THEN chr(10) || '# ' || text WHEN 1 THEN '   ' || chr(10) WHEN 2 THEN '- ' || text || text WHEN 3 THEN '> * ' || text WHEN 4 THEN '---' || chr(10) || '## ' || text ELSE '-- #' END"""


@query("note_titles", rf"""WITH n AS (SELECT conv_id * 1000 + turn AS id, {_BODY} AS body FROM conversations),
t AS (SELECT id, list_filter(list_transform(string_split(body, chr(10)), lambda x: {_TRIM.format(r"regexp_replace(x, '^[#*\-> ]+', '')")}), lambda x: x <> '')[1] AS t FROM n)
SELECT id, CASE WHEN t IS NULL OR t = '' THEN 'Note #' || id WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS title FROM t""")
def note_titles(spark, sf_dir):
    """Every message as a note, with marks in front, blank, or nothing but marks."""
    n = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.expr(_BODY).alias("body"))
    return n.select("id", T.note_title(F.col("body"), F.col("id")).alias("title"))


@query("slugify", Q + "SELECT id, coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'collection') AS slug FROM docs")
def slugify(spark, sf_dir):
    return L.documents(spark, sf_dir).select("id", T.slugified(F.col("title")).alias("slug"))


_BREAK = r"(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/section|/article|/pre)\b[^>]*>"
_HTML = "html"
for _tag in ("script", "style"):
    _HTML = rf"regexp_replace({_HTML}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_HTML = rf"regexp_replace(regexp_replace({_HTML}, '{_BREAK}', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g')"
for _name, _char in T.HTML_ENTITIES:
    _HTML = f"replace({_HTML}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"
_HTML = rf"regexp_replace(regexp_replace({_HTML}, '[ \t\r\f\x0b]+', ' ', 'g'), ' *\n *', chr(10), 'g')"
_HTML = _TRIM.format(rf"regexp_replace({_HTML}, '\n{{3,}}', chr(10) || chr(10), 'g')")


@query("html_to_text", f"SELECT page_id, sha256({_HTML}) AS sha FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.html_to_text(F.col("html")), 256).alias("sha"))


@query("web_fetch", f"""WITH t AS (SELECT page_id, CASE WHEN regexp_matches(lower(left(html, 512)), '<html|<!doctype html') THEN {_HTML} ELSE {_TRIM.format('html')} END AS t FROM pages
WHERE regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '^https?://(169\\.254\\.169\\.254|metadata\\.google\\.internal)(/|:|$)'))
SELECT page_id, CASE WHEN length(t) > 300 THEN left(t, 300) || chr(10) || '…[truncated]' ELSE t END AS text FROM t""")
def web_fetch(spark, sf_dir):
    from ..sources.web import fetched

    return fetched(table(spark, sf_dir, "pages"), most=300).select("page_id", "text")


@query("text_sane", r"""WITH d AS (SELECT doc_id, text AS s, strlen(text) AS size,
  length(regexp_replace(text, '[\p{L}\p{Nd}\p{P}\p{S}\s\x{0085}\x{00a0}\p{Z}]', '', 'g')) AS odd,
  coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-zÀ-ž]{3,}'), lambda x: strlen(x))), 0) AS wordish,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, coalesce(size >= 40 AND odd / size <= 0.04 AND letters > 0 AND (CASE WHEN letters > 0 THEN wordish / letters ELSE 0 END) >= 0.55 AND len(p) > 0
  AND (CASE WHEN len(p) > 0 THEN floor(list_sum(list_transform(p, lambda x: strlen(x))) / len(p)) ELSE 99 END) <= 14, false) AS sane FROM d""")
def text_sane(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(Y.sane(F.col("text")), F.lit(False)).alias("sane"))


_KNOWN = "[" + ", ".join(f"'{w}'" for w in Y.COMMON) + "]"


@query("ocr_quality", rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS p FROM documents),
e AS (SELECT doc_id, unnest(list_transform(p, lambda x: regexp_replace(x, '^[.,;:!?"''()\[\]{{}}*—–-]+|[.,;:!?"''()\[\]{{}}*—–-]+$', '', 'g'))) AS x FROM d),
w AS (SELECT doc_id, CASE WHEN x = '' THEN 0 WHEN list_contains({_KNOWN}, lower(x)) THEN 10
  WHEN strlen(x) BETWEEN 2 AND 14 AND regexp_matches(x, '^[A-Za-zÀ-ž0-9][A-Za-zÀ-ž0-9''’\-]*$')
   AND (length(x) - length(regexp_replace(x, '[aeiouyäöåAEIOUYÄÖÅ]', '', 'g'))) / strlen(x) BETWEEN 0.15 AND 0.70 THEN 3 ELSE 0 END AS pt FROM e)
SELECT d.doc_id, coalesce(round(sum(pt)::DOUBLE / (10 * any_value(len(p))), 6), 0) AS quality FROM d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id""")
def ocr_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Y.ocr_quality(F.col("text")).alias("quality"))


#: What stands before and after a document's text (by its id), so that headings, lists and marks occur; pages by recognition, and all pages.
TEMPLATES = [
    (0, "A study\nAbstract\n", "\nKeywords: a\nIntroduction\nSee [1] [2] [3] [4] arXiv:1 doi:10\nReferences\n[5]", 0, 8),
    (1, "Contents\nOne thing .... 3\nAnother thing ..... 9\nPreface\n", "\nChapter One\nChapter Two\nISBN 9781234567890\nForeword\nAll rights reserved", 0, 140),
    (2, "figure 1\nfigure 2\nfigure 3\nfigure 4\nfigure 5\nfigure 6\n", "", 10, 10),
    (3, "Syllabus: lecture 1, lecture 2, homework 1. Due: Monday. Office hours at noon.\n", "", 0, 6),
    (4, "Handbook and dictionary, manual\n", "\nAppendix\nBibliography", 0, 3),
    (5, "", "", 0, 2),
    (6, "Foreword\n", "\n1 The start", 9, 12),
    (7, "Abstract—", "\nBackground\nMore", 0, 4),
]
_FX = f"""WITH template(k, before, after, ocr, pages) AS {_values(TEMPLATES)},
fx AS (SELECT doc_id AS id, before || text || after AS text, ocr, pages FROM documents JOIN template ON k = doc_id % 8)"""


def _fixtures(spark, sf_dir):
    """All documents between headings."""
    t = spark.createDataFrame(TEMPLATES, "k long, before string, after string, ocr long, pages long")
    d = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 8).join(F.broadcast(t), "k")
    return d.select(F.col("doc_id").alias("id"), F.concat("before", "text", "after").alias("text"), "ocr", "pages")


def _sql(p: str) -> str:
    """A pattern for DuckDB: its lines end at \\n only, so the flag that says so goes."""
    return p.replace("(?dim)", "(?im)").replace("(?dm)", "(?m)").replace("'", "''")


def _kind_scores(src: str) -> str:
    m = lambda p, x="t": f"regexp_matches({x}, '{_sql(p)}')"
    n = lambda p, x="t": f"len(regexp_extract_all({x}, '{_sql(p)}'))"
    w = lambda c, v: f"CASE WHEN {c} THEN {float(v)}::DOUBLE ELSE 0 END"
    head = "CASE WHEN strlen(text) > 60000 THEN left(text, 40000) || chr(10) || right(text, 20000) ELSE left(text, 40000) END"
    return f""", v AS (SELECT id, ocr, pages, {head} AS t, left(text, 2000000) AS f, CASE WHEN pages > 0 THEN strlen(text) / pages END AS pp, CASE WHEN pages > 0 THEN ocr / pages ELSE 0 END AS sc FROM {src}),
c AS (SELECT *, {n(K.CITATION)} AS cites, {n(K.CHAPTERS, 'f')} AS ch, {n(K.FIGURE)} AS fi, {n(K.COURSE)} AS co, {n(K.HANDBOOK)} AS hb FROM v),
s AS (SELECT id,
  round({w(m(K.ABSTRACT), 4)} + {w(m(K.ARXIV), 3)} + {w(m(K.REFERENCES), 2)} + CASE WHEN cites >= 4 THEN least(3, cites / 4) ELSE 0 END + {w(m(K.DOI), 1.5)} + {w(m(K.KEYWORDS), 1)}, 6) AS paper,
  round(CASE WHEN ch >= 2 THEN least(4, 1.5::DOUBLE + ch / 3) WHEN {m(K.CHAPTER)} THEN 3 ELSE 0 END + {w(n(K.TOC_LINE, 'f') + ' >= 6', 2)} + {w(n(K.FRONT, 'f') + ' >= 2', 1.5)}
    + {w(m(K.ISBN, 'f'), 2)} + {w(m(K.PUBLISHER), 2)} + {w(m(K.CONTENTS), 1)} + CASE WHEN pages >= 120 THEN 3 WHEN pages >= 60 THEN 1.5 ELSE 0 END::DOUBLE
    + {w('sc > 0.6 AND pp >= 600', 1)} + {w(m(K.APPENDIX), 0.5)}, 6) AS book,
  round({w('sc > 0.6 AND pp < 600', 5)} + CASE WHEN fi >= 6 AND pp < 1200 THEN least(3, fi / 6) ELSE 0 END, 6) AS gallery,
  round(CASE WHEN co >= 3 THEN least(4, co::DOUBLE) ELSE 0 END + {w(m(K.DUE), 1)} + {w(m(K.CONTENTS), 0.2)}, 6) AS course,
  round(CASE WHEN hb >= 1 THEN least(3, hb::DOUBLE) ELSE 0 END + {w(m(K.APPENDIX), 1)} + {w(m(K.REFERENCES), 0.5)}, 6) AS reference FROM c)"""


def _best(a: str = "") -> str:
    top = f"greatest({a}paper, {a}book, {a}gallery, {a}course, {a}reference)"
    return f"CASE WHEN {top} < {K.CONFIDENT} THEN '' " + " ".join(f"WHEN {a}{k} = {top} THEN '{k}'" for k in K.KINDS) + " END"


@query("kind_scores", _FX + _kind_scores("fx") + f"SELECT id::BIGINT AS id, paper, book, gallery, course, reference, {_best()} AS kind FROM s")
def kind_scores(spark, sf_dir):
    d = _fixtures(spark, sf_dir).select("id", K.scores(F.col("text"), F.col("ocr"), F.col("pages")).alias("score"))
    return d.select("id", "score.*", K.best_kind(F.col("score")).alias("kind"))


_WHOLE = "WITH fx AS (SELECT doc_id AS id, text, 0::BIGINT AS ocr, doc_id % 150 AS pages FROM documents)"


def _whole(spark, sf_dir):
    """All documents in the shape of the fixtures."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(0).cast("long").alias("ocr"), (F.col("doc_id") % 150).alias("pages"))


@query("kind_documents", _WHOLE + _kind_scores("fx") + f"SELECT id, {_best()} AS kind FROM s")
def kind_documents(spark, sf_dir):
    return _whole(spark, sf_dir).select("id", K.best_kind(K.scores(F.col("text"), F.col("ocr"), F.col("pages"))).alias("kind"))


_LONG = "SELECT doc_id AS id, repeat(text || chr(10), 1 + (70000 // greatest(1, strlen(text)))::INT) AS text, 0::BIGINT AS ocr, 10::BIGINT AS pages FROM documents"


@query("kind_scores_long", f"WITH fx AS ({_LONG})" + _kind_scores("fx") + f"SELECT id, paper, book, gallery, course, reference, {_best()} AS kind FROM s")
def kind_scores_long(spark, sf_dir):
    """Every document repeated to over 60,000 bytes, so that head, tail and whole text are told apart."""
    size = F.greatest(F.lit(1), F.octet_length("text"))
    long = F.repeat(F.concat("text", F.lit("\n")), (1 + F.floor(70000 / size)).cast("int"))
    d = _whole(spark, sf_dir).select("id", long.alias("text"))
    d = d.select("id", K.scores(F.col("text"), F.lit(0), F.lit(10)).alias("score"))
    return d.select("id", "score.*", K.best_kind(F.col("score")).alias("kind"))


PINS = [(101, "course", "methods results measurements detail"), (102, "course", "section describes methods results"), (103, "reference", "lecture homework monday syllabus office hours noon")]
_TOK = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda t: strlen(t) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in K.KIND_STOPWORDS) + "], t)))"
_TOK_SHELF = _TOK.replace(", ".join(f"'{w}'" for w in K.KIND_STOPWORDS), ", ".join(f"'{w}'" for w in K.STOPWORDS))
_OVER = f""", pins(example, kind, text) AS {_values(PINS)},
o AS (SELECT fx.id, example, kind, len(list_intersect({_TOK.format('fx.text')}, {_TOK.format('pins.text')})) AS shared FROM fx CROSS JOIN pins)"""
_NEWEST = 300


_PINNED = _kind_scores("fx") + _OVER + """, w AS (SELECT id, kind, CASE WHEN shared < 2 THEN 0 ELSE least(4, 3 + 0.25::DOUBLE * (shared - 2)) END AS w FROM o),
x AS (SELECT s.id, """ + ", ".join(f"round({k} + coalesce((SELECT sum(w) FROM w WHERE w.id = s.id AND w.kind = '{k}'), 0), 6) AS {k}" for k in K.KINDS) + f" FROM s) SELECT id::BIGINT AS id, {_best()} AS kind FROM x"


@query("kind_with_pins", _FX + _PINNED)
def kind_with_pins(spark, sf_dir):
    d = _fixtures(spark, sf_dir).select("id", K.tokens(F.col("text")).alias("tokens"), K.scores(F.col("text"), F.col("ocr"), F.col("pages")).alias("score"))
    pins = spark.createDataFrame(PINS, "example long, kind string, text string").select("example", "kind", K.tokens(F.col("text")).alias("tokens"))
    return K.with_examples(d, pins)


@query("best_examples", _FX + f""", pins AS (SELECT doc_id AS example, left(split_part(text, chr(10), 1), 200) AS title FROM documents JOIN labels USING (doc_id) WHERE quality = 1 ORDER BY doc_id DESC LIMIT {_NEWEST}),
a AS (SELECT id, unnest({_TOK_SHELF.format('text')}) AS t FROM fx), b AS (SELECT example, title, unnest({_TOK_SHELF.format('title')}) AS t FROM pins),
o AS (SELECT id, example, title, count(*) AS shared FROM a JOIN b USING (t) WHERE id <> example GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, title, example) AS n FROM o WHERE shared >= 2) SELECT id, example, shared FROM r WHERE n <= 3""")
def best_examples(spark, sf_dir):
    """The three examples, of the newest pins, whose titles share most words with a document; not a document itself."""
    from pyspark.sql import Window

    d = _fixtures(spark, sf_dir).select("id", K.tokens(F.col("text"), K.STOPWORDS).alias("tokens"))
    pins = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    title = F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(200))
    pins = pins.select(F.col("doc_id").alias("example"), title.alias("title")).orderBy(F.col("example").desc()).limit(_NEWEST)
    shared = K.overlap(d, pins.select("example", K.tokens(F.col("title"), K.STOPWORDS).alias("tokens"))).where("shared >= 2 AND id <> example")
    w = Window.partitionBy("id").orderBy(F.col("shared").desc(), "title", "example")
    o = shared.join(F.broadcast(pins), "example").withColumn("n", F.row_number().over(w))
    return o.where("n <= 3").select("id", "example", "shared")


def _after(x: str, p: str) -> str:
    """Text after the first match (null without one)."""
    return f"CASE WHEN regexp_matches({x}, '{_sql(p)}') THEN substr({x}, length(regexp_extract({x}, '{_lazy(p)}')) + 1) END"


def _lazy(p: str) -> str:
    p = _sql(p)
    flags = p[: p.index(")") + 1].replace("(?im)", "(?ims)").replace("(?m)", "(?ms)")
    return flags.replace("s)", ")") + r"\A(?s:.*?)(?:" + p[p.index(")") + 1 :] + ")"


def _before(x: str, p: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_sql(p)}') THEN left({x}, (length(regexp_extract({x}, '{_lazy(p)}')) - length(regexp_extract({x}, '{_sql(p)}')))::BIGINT) ELSE {x} END"


_ABSTRACT = f""", a AS (SELECT id, {_after('text', K.ABSTRACT)} AS r FROM fx),
b AS (SELECT id, CASE WHEN regexp_matches(r, '{_sql(K.ABSTRACT_ENDS)}') THEN {_before('r', K.ABSTRACT_ENDS)} ELSE left(r, 3000) END AS c FROM a),
c AS (SELECT id, regexp_replace({_TRIM.format('c')}, '^[—\\-– \\n\\t]+', '') AS o FROM b) SELECT id::BIGINT AS id, CASE WHEN strlen(o) >= 150 THEN o ELSE '' END AS abstract FROM c"""


@query("abstract", _FX + _ABSTRACT)
def abstract(spark, sf_dir):
    return _fixtures(spark, sf_dir).select("id", K.abstract(F.col("text")).alias("abstract"))


_FM = ", ".join(f"{_TRIM.format('left(' + _before('r' + str(i), K.CHAPTER_START) + ', 7000)')} AS f{i}" for i in range(3))


_FRONT_MATTER = ", a AS (SELECT id, " + ", ".join(f"{_after('text', p)} AS r{i}" for i, p in enumerate((K.PREFACE, K.FOREWORD, K.INTRO))) + f""" FROM fx), b AS (SELECT id, {_FM} FROM a)
SELECT id::BIGINT AS id, CASE WHEN strlen(f0) >= 400 THEN f0 WHEN strlen(f1) >= 400 THEN f1 WHEN strlen(f2) >= 400 THEN f2 ELSE '' END AS front FROM b"""


@query("front_matter", _FX + _FRONT_MATTER)
def front_matter(spark, sf_dir):
    return _fixtures(spark, sf_dir).select("id", K.front_matter(F.col("text")).alias("front"))


_TOC = f""", a AS (SELECT id, {_after('text', K.CONTENTS)} AS r FROM fx), b AS (SELECT id, {_before('r', K.PREFACE)} AS r FROM a),
c AS (SELECT id, {_before('r', K.FOREWORD)} AS r FROM b), d AS (SELECT id, {_before('r', K.INTRO)} AS r FROM c)
SELECT id::BIGINT AS id, coalesce(array_to_string(list_filter(list_transform(string_split(left(r, 4000), chr(10)),
  lambda x: {_TRIM.format("regexp_replace(regexp_replace(x, '[.·—-]{2,}" + chr(92) + "s*" + chr(92) + "d+" + chr(92) + "s*$', ''), '" + chr(92) + "s+" + chr(92) + "d+$', '')")}), lambda x: strlen(x) >= 3)[1:60], chr(10)), '') AS toc FROM d"""


@query("toc", _FX + _TOC)
def toc(spark, sf_dir):
    return _fixtures(spark, sf_dir).select("id", K.contents(F.col("text")).alias("toc"))


_JUNK = ", ".join(f"'{j}'" for j in T.JUNK_INGEST)
_META = """CASE doc_id % 5 WHEN 0 THEN ' Unknown ' WHEN 1 THEN ' ' || left(text, 30) || ' ' WHEN 2 THEN 'N/A' WHEN 4 THEN chr(9) || 'Not specified' END AS title,
  CASE doc_id % 6 WHEN 0 THEN '2020' WHEN 1 THEN '2020-2021' WHEN 2 THEN 'c. 1999' WHEN 3 THEN '20201' WHEN 4 THEN '' END AS year"""


@query("clean_meta", f"""WITH m AS (SELECT doc_id AS id, {_META} FROM documents)
SELECT id, CASE WHEN lower({_TRIM.format("coalesce(title, '')")}) IN ({_JUNK}) THEN '' ELSE {_TRIM.format("coalesce(title, '')")} END AS title,
  CASE WHEN regexp_matches(coalesce(year, ''), '^\\d{{4}}(-\\d{{4}})?$') THEN year ELSE '' END AS year FROM m""")
def clean_meta(spark, sf_dir):
    """Titles and years as a backend may give them, for all documents."""
    title, year = _META.split(",\n  ")
    m = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(title), F.expr(year))
    return m.select("id", T.clean_meta(F.col("title")).alias("title"), T.valid_year(F.col("year")).alias("year"))


@query("category_tag_filter", Q + """, t AS (SELECT doc_id, list_sort(list(DISTINCT replace(tag, 'lang-', ''))) AS tags FROM tags GROUP BY 1),
f AS (SELECT id, tags, list_filter(tags, lambda t: NOT list_contains(string_split(lower(category), '/'), lower(t))) AS keep FROM docs JOIN t ON doc_id = id)
SELECT id, array_to_string(CASE WHEN len(keep) = 0 THEN tags ELSE keep END, ',') AS tags FROM f""")
def category_tag_filter(spark, sf_dir):
    t = L.tags(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.replace("tag", F.lit("lang-"), F.lit("")))).alias("tags"))
    d = L.documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "category").join(t, "doc_id")
    return d.select(F.col("doc_id").alias("id"), F.array_join(M.filtered_tags(F.col("tags"), F.col("category")), ",").alias("tags"))


@query("token_budget_trim", Q + """, s AS (SELECT session_id, string_agg(content, chr(10) || chr(10) ORDER BY id) AS t FROM messages GROUP BY 1), h AS (SELECT *, left(t, 1536) AS h FROM s)
SELECT session_id, sha256(CASE WHEN length(t) <= 1536 THEN t WHEN instr(h, chr(10) || chr(10)) > 0 THEN regexp_extract(h, '(?s)^(.*)\\n\\n', 1) ELSE h END) AS sha FROM h""")
def token_budget_trim(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("id", "content")))
    s = L.messages(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.transform(rows, lambda x: x["content"]), "\n\n").alias("t"))
    return s.select("session_id", F.sha2(T.within_budget(F.col("t"), 600, 200), 256).alias("sha"))


_ANSWER = """CASE turn % 4 WHEN 0 THEN '<think>a { b</think> {"title": "' || regexp_replace(text, '[^A-Za-z0-9 ]+', ''{g}) || '", "tags": ["x"]} end' WHEN 1 THEN text
  WHEN 2 THEN '```{"title": "' || regexp_replace(text, '[^A-Za-z0-9 ]+', ''{g}) || '"}```' ELSE '<think>open {"title": "' || role || '"}' END"""


@query("llm_json_hygiene", rf"""WITH a AS (SELECT conv_id, turn, {_ANSWER.replace('{g}', ", 'g'")} AS s FROM conversations),
o AS (SELECT conv_id, turn, regexp_extract(regexp_replace(s, '(?s)^(.*?)<think>.*?</think>', '\1'), '(?s)(\{{.*\}})', 1) AS o FROM a)
SELECT conv_id, turn, o AS object, CASE WHEN turn % 4 <> 1 THEN json_extract_string(o, '$.title') END AS title FROM o""")
def llm_json_hygiene(spark, sf_dir):
    """Every message inside an answer with a think block, a fence, an open think block, or as it is."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ANSWER.replace("{g}", "")).alias("s"))
    a = a.select("conv_id", "turn", T.json_object(T.without_think(F.col("s"))).alias("object"))
    return a.withColumn("title", F.when(F.col("turn") % 4 != 1, F.get_json_object("object", "$.title")))


@query("doc_refs", r"""WITH m AS (SELECT conv_id, turn, text || ' see #' || conv_id || ' and #' || (turn + 5) || '.' AS t FROM conversations)
SELECT conv_id, turn, unnest(list_transform(regexp_extract_all(t, '#(\d{1,9})\b', 1), lambda x: x::BIGINT)) AS ref FROM m""")
def doc_refs(spark, sf_dir):
    t = F.concat("text", F.lit(" see #"), "conv_id", F.lit(" and #"), F.col("turn") + 5, F.lit("."))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.doc_refs(t)).alias("ref"))


@query("page_lists", """SELECT doc_id, array_to_string(list_sort(list_distinct([doc_id % 30 + 5, doc_id % 30 + 6, doc_id % 30 + 7, doc_id % 9 + 1])), ',') AS pages FROM documents""")
def page_lists(spark, sf_dir):
    """Lists with a range, a page twice, and parts that are none."""
    a = F.col("doc_id") % 30
    s = F.concat_ws("", a + 5, F.lit("-"), a + 7, F.lit(", "), F.col("doc_id") % 9 + 1, F.lit(",x,9-4, "), a + 6)
    return table(spark, sf_dir, "documents").select("doc_id", T.page_csv(T.page_list(s).cast("array<string>")).alias("pages"))


@query("clean_text", rf"SELECT doc_id, sha256({_TRIM.format(chr(114) + 'egexp_replace(text, ' + chr(39) + '[ ' + chr(92) + 't]+' + chr(92) + 'n|' + chr(92) + 'n{3,}' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + ')')}) AS sha FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.cleaned(F.col("text")), 256).alias("sha"))


@query("settle_check", """WITH s AS (SELECT user_id, ts, value, event_id, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, before IS NOT NULL AND before = value AS settled FROM s""")
def settle_check(spark, sf_dir):
    """Batch twin of the watcher's rule: a stamp equal to the one of the scan before has settled."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("value").over(w))
    return e.select("user_id", "event_id", F.coalesce(F.col("before") == F.col("value"), F.lit(False)).alias("settled"))


# The operators above over whole tables and whole texts.


@query("kind_scores_documents", _WHOLE + _kind_scores("fx") + f"SELECT id, paper, book, gallery, course, reference, {_best()} AS kind FROM s")
def kind_scores_documents(spark, sf_dir):
    d = _whole(spark, sf_dir).select("id", K.scores(F.col("text"), F.col("ocr"), F.col("pages")).alias("score"))
    return d.select("id", "score.*", K.best_kind(F.col("score")).alias("kind"))


@query("kind_with_pins_documents", _WHOLE + _PINNED)
def kind_with_pins_documents(spark, sf_dir):
    d = _whole(spark, sf_dir).select("id", K.tokens(F.col("text")).alias("tokens"), K.scores(F.col("text"), F.col("ocr"), F.col("pages")).alias("score"))
    pins = spark.createDataFrame(PINS, "example long, kind string, text string").select("example", "kind", K.tokens(F.col("text")).alias("tokens"))
    return K.with_examples(d, pins)


@query("abstract_documents", _WHOLE + _ABSTRACT)
def abstract_documents(spark, sf_dir):
    return _whole(spark, sf_dir).select("id", K.abstract(F.col("text")).alias("abstract"))


@query("front_matter_documents", _WHOLE + _FRONT_MATTER)
def front_matter_documents(spark, sf_dir):
    return _whole(spark, sf_dir).select("id", K.front_matter(F.col("text")).alias("front"))


@query("toc_documents", _WHOLE + _TOC)
def toc_documents(spark, sf_dir):
    return _whole(spark, sf_dir).select("id", K.contents(F.col("text")).alias("toc"))
