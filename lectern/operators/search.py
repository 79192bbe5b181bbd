"""Keyword search (BM25 over postings) and vector search.

The postings table (term, chunk_id, tf, n_tokens, positions) is an inverted index, kept by ``keyword_index`` in files of some chunks each, in
runs in order of (term, chunk_id): a word or a prefix is a few pages of each run, and a word of half the corpus is no single task.
A row carries its chunk's length, so a query reads the rows of its terms and one row of statistics, and no text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
SNIPPET_TOKENS = 12
#: Fixed value: the distance of a NEAR group that names none.
NEAR_DISTANCE = 10
#: Bytes of a row group: small ones, so that a term's range is cut close.
INDEX_ROW_GROUP = 4 << 20
#: Chunks that are taken up at once in a Python worker, and postings that it hands back at once.
GROUPED_CHUNKS, SENT_POSTINGS = 512, 50_000
#: Postings are put in order in runs of about so many tokens, in a Python worker's memory: a task's size decides how many runs a file has, and nothing spills.
RUN_TOKENS = 1 << 20
POSTINGS = "term string, chunk_id long, tf long, n_tokens int, positions array<int>"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def _gathered(batches, places: str, most: int):
    """Arrow batches put together until they have ``most`` elements in the arrays of column ``places``."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b.column(places).flatten())
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _ranks(words):
    """Each entry's place in the order of a dictionary-encoded array's dictionary."""
    import numpy as np
    import pyarrow.compute as pc

    out = np.empty(len(words.dictionary), np.int64)
    out[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(out))
    return out


def grouped(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, n_tokens, positions) from (chunk_id, t, n_tokens), ``t`` being a chunk's tokens.

    All tokens of a chunk are in its row, so they are sorted by term and chunk and cut where either changes, in Arrow batches: nothing is shuffled.
    Rows come in runs in order of (term, chunk_id).
    """
    ship(chunks.sparkSession)
    size, most, sent = GROUPED_CHUNKS, RUN_TOKENS, SENT_POSTINGS

    def batches(rows):
        import numpy as np
        import pyarrow as pa

        for b in _gathered((r.slice(k, size) for r in rows for k in range(0, r.num_rows, size)), "t", most):
            t = b.column("t")
            lengths = t.value_lengths().to_numpy()
            words = t.flatten().dictionary_encode()
            chunk, code = np.repeat(np.arange(len(t), dtype=np.int32), lengths), words.indices.to_numpy()
            place = (np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            by_id = np.argsort(np.argsort(b.column("chunk_id").to_numpy(), kind="stable"))
            key = _ranks(words)[code] * len(t) + by_id[chunk]
            order = np.argsort(key, kind="stable")
            at = np.flatnonzero(np.diff(key[order], prepend=-1))
            first, ends = order[at], np.append(at, len(order))
            own = [b.column(c).take(pa.array(chunk[first])) for c in ("chunk_id", "n_tokens")]
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order]))
            columns = [words.dictionary.take(pa.array(code[first])), own[0], pa.array(np.diff(ends), pa.int64()), own[1], positions]
            run = pa.RecordBatch.from_arrays(columns, ["term", "chunk_id", "tf", "n_tokens", "positions"])
            yield from (run.slice(k, sent) for k in range(0, run.num_rows, sent))

    d = chunks.where(F.size("t") > 0).select(F.col("chunk_id").cast("long"), F.col("n_tokens").cast("int"), "t")
    return d.mapInArrow(batches, POSTINGS)


def in_runs(postings: DataFrame) -> DataFrame:
    """Postings, each partition's in runs in order of (term, chunk_id)."""
    ship(postings.sparkSession)
    most, sent = RUN_TOKENS, SENT_POSTINGS

    def batches(rows):
        import numpy as np
        import pyarrow as pa

        for b in _gathered(rows, "positions", most):
            words = b.column("term").dictionary_encode()
            order = np.lexsort((b.column("chunk_id").to_numpy(), _ranks(words)[words.indices.to_numpy()]))
            yield from (b.take(pa.array(order[k : k + sent])) for k in range(0, len(order), sent))

    return postings.select("term", "chunk_id", "tf", "n_tokens", "positions").mapInArrow(batches, POSTINGS)


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, n_tokens, positions) from (id, text)."""
    t = chunks.select(F.col("id").alias("chunk_id"), tokens(F.col("text")).alias("t"))
    return grouped(t.withColumn("n_tokens", F.size("t")))


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length."""
    return chunks.select(F.size(tokens(F.col("text"))).alias("n")).agg(F.count("*").alias("n_chunks"), F.avg("n").alias("mean"))


# ---------------------------------------------------------------- query language


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]  # more than one: a phrase
    prefix: bool = False


@dataclass(frozen=True)
class Near:
    """Words and phrases of which one each lies so close that at most ``distance`` tokens are between the first one's end and the last one's start."""

    terms: tuple[Term, ...]
    distance: int = NEAR_DISTANCE


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    left: object
    right: object


def parse(query: str):
    """Implicit AND, OR, NOT, "phrases", prefix*, NEAR(a "b c", n) and brackets; an ill-formed query is one phrase."""
    marks = re.findall(r'"[^"]*"|\(|\)|,|[^\s(),"]+', query)
    at = 0

    def words(s: str) -> tuple[str, ...]:
        return tuple(w for w in re.split(r"[\W_]+", s.lower()) if w)

    def peek():
        return marks[at] if at < len(marks) else None

    def primary():
        nonlocal at
        m = peek()
        if m is None or m in (")", "AND", "OR", "NOT"):
            raise ValueError(query)
        at += 1
        if m == "NEAR" and peek() == "(":
            return near()
        if m == "(":
            out = either()
            if peek() != ")":
                raise ValueError(query)
            at += 1
            return out
        return term(m)

    def term(m):
        w = words(m)
        if not w or (not m.startswith('"') and re.search(r"[^\w*'-]", m)):
            raise ValueError(query)
        return Term(w, m.endswith("*"))

    def near():
        nonlocal at
        at, inside, distance = at + 1, [], NEAR_DISTANCE
        while (m := peek()) not in (None, ")", ",", "("):
            inside.append(term(m))
            at += 1
        if peek() == ",":
            if not re.fullmatch(r"[0-9]{1,6}", (marks[at + 1 : at + 2] or [""])[0]):
                raise ValueError(query)
            distance, at = int(marks[at + 1]), at + 2
        if peek() != ")" or not inside:
            raise ValueError(query)
        at += 1
        return Near(tuple(inside), distance) if len(inside) > 1 else inside[0]

    def negated():
        nonlocal at
        out = primary()
        while peek() == "NOT":
            at += 1
            out = Op("not", out, primary())
        return out

    def both():
        nonlocal at
        out = negated()
        while peek() not in (None, ")", "OR"):
            at += peek() == "AND"
            out = Op("and", out, negated())
        return out

    def either():
        nonlocal at
        out = both()
        while peek() == "OR":
            at += 1
            out = Op("or", out, both())
        return out

    try:
        out = either()
        if at != len(marks):
            raise ValueError(query)
        return out
    except ValueError:
        return Term(words(query))


def terms_of(node) -> list[Term]:
    """Terms that add to the score (those under NOT's right side do not)."""
    if isinstance(node, Term):
        return [node]
    if isinstance(node, Near):
        return list(node.terms)
    return terms_of(node.left) + (terms_of(node.right) if node.kind != "not" else [])


def _scoring(node) -> list:
    """Leaves that add to the score."""
    if isinstance(node, (Term, Near)):
        return [node]
    return _scoring(node.left) + (_scoring(node.right) if node.kind != "not" else [])


def _rows(index: DataFrame, word: str, prefix: bool) -> DataFrame:
    return index.where(F.col("term").startswith(word) if prefix else F.col("term") == word)


def _places(index: DataFrame, term: Term) -> DataFrame:
    """(chunk_id, at, n_tokens): where a word, a prefix or a phrase begins."""
    out = None
    for k, w in enumerate(term.words):
        rows = _rows(index, w, term.prefix and k == len(term.words) - 1).groupBy("chunk_id")
        at = F.flatten(F.collect_list(F.transform("positions", lambda p: p - k))).alias(f"p{k}")  # noqa: B023
        if out is None:
            out = rows.agg(at, F.max("n_tokens").alias("n_tokens")).withColumnRenamed("p0", "at")
        else:
            out = out.join(rows.agg(at), "chunk_id").select("chunk_id", "n_tokens", F.array_intersect("at", f"p{k}").alias("at"))
    return out.where(F.size("at") > 0).select("chunk_id", "at", "n_tokens")


def _hits(index: DataFrame, term: Term) -> DataFrame:
    """(chunk_id, tf, n_tokens) of a word, a prefix or a phrase."""
    if len(term.words) == 1:
        return _rows(index, term.words[0], term.prefix).groupBy("chunk_id").agg(F.sum("tf").alias("tf"), F.max("n_tokens").alias("n_tokens"))
    return _places(index, term).select("chunk_id", F.size("at").cast("long").alias("tf"), "n_tokens")


def _near_hits(index: DataFrame, near: Near) -> DataFrame:
    """(chunk_id, tfs): chunks in which the terms lie close together, and how often each term takes part in that.

    The places of all terms are merged in order.  A place begins a group if every term has a place from there on to ``distance`` tokens
    behind its end: the next place of each term is a minimum over what follows.  All places within that reach take part: the furthest
    reach so far is a maximum over what came before.  Both are windows over the places of one chunk.
    """
    terms = range(len(near.terms))
    length = F.get(F.array(*(F.lit(len(t.words)) for t in near.terms)), F.col("k"))
    places = reduce(DataFrame.unionByName, (_places(index, t).select("chunk_id", F.lit(k).alias("k"), F.explode("at").alias("p")) for k, t in enumerate(near.terms)))
    chunk = Window.partitionBy("chunk_id").orderBy("p")
    ahead, so_far = chunk.rangeBetween(0, Window.unboundedFollowing), chunk.rangeBetween(Window.unboundedPreceding, 0)
    d = places.withColumn("reach", F.col("p") + length + near.distance)
    furthest = F.greatest(*(F.coalesce(F.min(F.when(F.col("k") == k, F.col("p"))).over(ahead), F.lit(1 << 30)) for k in terms))
    d = d.withColumn("next", furthest)
    d = d.withColumn("covered", F.max(F.when(F.col("next") <= F.col("reach"), F.col("reach"))).over(so_far) >= F.col("p")).where("covered")
    return d.groupBy("chunk_id").agg(F.array(*(F.count_if(F.col("k") == k) for k in terms)).alias("tfs"))


def matching(index: DataFrame, node) -> DataFrame:
    """(chunk_id) of the chunks that satisfy a query."""
    if isinstance(node, Term):
        return _hits(index, node).select("chunk_id")
    if isinstance(node, Near):
        return _near_hits(index, node).select("chunk_id")
    a, b = matching(index, node.left), matching(index, node.right)
    if node.kind == "or":
        return a.union(b).distinct()
    return a.join(b, "chunk_id", "left_semi" if node.kind == "and" else "left_anti")


def _leaves(node) -> list:
    return [node] if isinstance(node, (Term, Near)) else _leaves(node.left) + _leaves(node.right)


def _holds(node, leaves: list[Term]) -> Column:
    """A query as a condition on ``seen``, the array of leaves found in a chunk."""
    if isinstance(node, Term):
        return F.array_contains("seen", leaves.index(node))
    a, b = _holds(node.left, leaves), _holds(node.right, leaves)
    return a | b if node.kind == "or" else a & b if node.kind == "and" else a & ~b


def _word_hits(index: DataFrame, leaves: list[Term]) -> DataFrame:
    """(chunk_id, q, tf, n_tokens) of words and prefixes, in one pass over the index; q numbers the leaves."""
    is_ = [F.col("term").startswith(t.words[0]) if t.prefix else F.col("term") == t.words[0] for t in leaves]
    any_ = is_[0]
    for c in is_[1:]:
        any_ = any_ | c
    which = F.filter(F.array(*(F.when(c, F.lit(i)) for i, c in enumerate(is_))), lambda x: x.isNotNull())
    rows = index.where(any_).select("chunk_id", "tf", "n_tokens", F.explode(which).alias("q"))
    return rows.groupBy("chunk_id", "q").agg(F.sum("tf").alias("tf"), F.max("n_tokens").alias("n_tokens"))


def _candidates(index: DataFrame, node) -> DataFrame:
    """(chunk_id, q, tf, n_tokens) of the scoring leaves, and whether the chunk matches."""
    leaves = list(dict.fromkeys(_leaves(node)))
    if not all(w.words for t in leaves for w in (t.terms if isinstance(t, Near) else [t])):  # a query without a word finds nothing
        return index.where(F.lit(False)).select("chunk_id", F.lit(0).alias("q"), "tf", "n_tokens", F.lit(False).alias("match"))
    scoring = [leaves.index(t) for t in dict.fromkeys(_scoring(node))]
    if all(isinstance(t, Term) and len(t.words) == 1 for t in leaves):
        hits = _word_hits(index, leaves)
        found = hits.groupBy("chunk_id").agg(
            F.collect_set("q").alias("seen"), F.collect_list(F.struct("q", "tf")).alias("hits"), F.max("n_tokens").alias("n_tokens")
        )
        found = found.select("chunk_id", "n_tokens", _holds(node, leaves).alias("match"), F.explode("hits").alias("h"))
        return found.select("chunk_id", "n_tokens", "match", "h.q", "h.tf").where(F.col("q").isin(scoring))
    parts = []
    for i in scoring:
        leaf = leaves[i]
        if isinstance(leaf, Term):
            parts.append(_hits(index, leaf))
            continue
        near = _near_hits(index, leaf)  # a term counts wherever it occurs, and scores where it takes part
        for k, t in enumerate(leaf.terms):
            own = _hits(index, t).drop("tf").join(near.select("chunk_id", F.get("tfs", F.lit(k)).alias("tf")), "chunk_id", "left")
            parts.append(own.select("chunk_id", F.coalesce("tf", F.lit(0)).alias("tf"), "n_tokens"))
    hits = reduce(DataFrame.unionByName, (p.withColumn("q", F.lit(q)) for q, p in enumerate(parts)))
    wanted = matching(index, node).withColumn("match", F.lit(True))
    return hits.join(wanted, "chunk_id", "left").withColumn("match", F.coalesce("match", F.lit(False)))


def ranked(index: DataFrame, stats: DataFrame, query: str, k: int | None) -> DataFrame:
    """(chunk_id, score): the k best matching chunks by BM25, ties by id."""
    d = _candidates(index, parse(query))
    seen = d.groupBy("q").agg(F.count("*").alias("n"))  # in how many chunks a leaf occurs, matching or not
    d = d.where("match").join(F.broadcast(seen), "q").join(F.broadcast(stats))
    idf = F.log((F.col("n_chunks") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
    tf = F.col("tf")
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))
    out = d.groupBy("chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
    return out if k is None else out.orderBy(F.col("score").desc(), "chunk_id").limit(k)


def with_snippet(hits: DataFrame, terms: list[str], size: int = SNIPPET_TOKENS) -> DataFrame:
    """``hits`` plus ``snippet``: the first window of ``size`` tokens with the most distinct terms, matches in brackets.

    Tokens and the best window are columns of their own, so they are made once per hit.
    """
    known = F.array(*(F.lit(x) for x in terms))
    t, best = F.col("_tokens"), F.col("_best")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - size + 1))
    windows = F.transform(starts, lambda i: F.struct(F.size(F.array_intersect(F.slice(t, i, size), known)).alias("n"), (-i).alias("at")))
    d = hits.withColumn("_tokens", tokens(F.col("text"))).withColumn("_best", F.array_max(windows))
    shown = F.transform(F.slice(t, -best["at"], size), lambda w: F.when(F.array_contains(known, w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    cut = F.concat(
        F.when(best["at"] < -1, "…").otherwise(""), F.array_join(shown, " "), F.when(-best["at"] + size <= F.size(t), "…").otherwise("")
    )
    return d.withColumn("snippet", cut).drop("_tokens", "_best")


def keyword(chunks: DataFrame, docs: DataFrame, query: str, k: int = 20, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Chunk-level hits with their document and a snippet; texts are read for the hits only.

    ``index``: (postings, statistics) as ``KeywordIndex.read`` gives them; without one the chunks are gone through.
    """
    terms = sorted({w for t in terms_of(parse(query)) for w in t.words})
    top = ranked(*(index or (postings(chunks), statistics(chunks))), query, k)
    hit = chunks.join(F.broadcast(top), F.col("id") == F.col("chunk_id"))
    hit = hit.join(docs.select(F.col("id").alias("doc_id"), "path"), "doc_id")
    return with_snippet(hit, terms).select("chunk_id", "doc_id", "path", "score", "snippet")


# ---------------------------------------------------------------- vectors


def cosine(a: Column, b: Column) -> Column:
    """Over the common dimensions; 0 if a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.slice(v, F.lit(1), n) for v in (a, b))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, 0.0).otherwise(dot(x, y) / norm)


def nearest_chunks(vectors: DataFrame, query: list[float], k: int | None) -> DataFrame:
    """(id, doc_id, score), best first: the query vector is a literal, so this is one pass and a bounded top-k."""
    q = F.array(*(F.lit(float(v)) for v in query))
    d = vectors.select("id", "doc_id", F.round(cosine(F.col("embedding"), q), 6).alias("score"))
    return d if k is None else d.orderBy(F.col("score").desc(), "id").limit(k)


def semantic(vectors: DataFrame, query: list[float], k: int, snippets: int = 3) -> DataFrame:
    """Up to ``snippets`` chunks of each of the k documents with the best chunks."""
    d = nearest_chunks(vectors, query, None)
    best = d.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("best")).orderBy("best").limit(k)
    by_rank = Window.orderBy("best")
    best = best.withColumn("doc_rank", F.row_number().over(by_rank)).select("doc_id", "doc_rank")
    mine = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "id")
    d = d.join(F.broadcast(best), "doc_id").withColumn("nth", F.row_number().over(mine)).where(F.col("nth") <= snippets)
    return d.select("doc_rank", "doc_id", "nth", "id", "score")


def embed_prefixes(model: Column) -> Column:
    """Prefixes (query, document) that a model wants."""
    m = F.lower(model)
    return F.when(m.contains("embeddinggemma"), F.struct(F.lit("task: search result | query: ").alias("query"), F.lit("title: none | text: ").alias("document"))).when(
        m.contains("nomic"), F.struct(F.lit("search_query: ").alias("query"), F.lit("search_document: ").alias("document"))
    ).otherwise(F.struct(F.lit("").alias("query"), F.lit("").alias("document")))


def hashing_embedder(dims: int = 64):
    """Offline embedder: signed hashing of tokens, unit length; Arrow batches."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        from zlib import crc32

        def one(t):
            v = [0.0] * dims
            for w in re.findall(r"\w+", (t or " ").lower()):
                h = crc32(w.encode())
                v[h % dims] += 1 if h >> 16 & 1 else -1
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            return [x / n for x in v]

        return texts.map(one)

    return embed


def embed_pending(chunks: DataFrame, embedder, identity: str, stored: str | None, prefix: str = "") -> DataFrame:
    """Fills missing vectors; those of another vector space (``stored`` identity) are recomputed.

    Chunks that have a vector never reach the embedder.  ``embedding.Vectors`` does the same in committed rounds.
    """
    old = F.col("embedding") if stored == identity else F.lit(None).cast("array<float>")
    text = F.concat(F.lit(prefix), F.when(F.trim("text") == "", " ").otherwise(F.col("text")))
    d = chunks.withColumn("embedding", old)
    made = d.where("embedding IS NULL").withColumn("embedding", embedder(text))
    return d.where("embedding IS NOT NULL").unionByName(made)
