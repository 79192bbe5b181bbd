"""Periodic runs, vector codes and token counts against plain versions, and on odd and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import periodic_runs, token_counts, vector_codes

CLASHES = "_doc _text _runs v old code error part entry n total place start length period best g w a p t w2 _label _total _n _hot _deal a.b runs collapsed n_bytes".split()


def same_rows(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


# ---------------------------------------------------------------- 11


def plain_runs(words):
    """By the definition: every period of every stretch that cannot grow."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            stretch = words[start : start + length]
            if length >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    stays = [not any(s + q <= i < s + length for s, length, q in runs) for i in range(len(words))] if runs else [True] * len(words)
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines, text = "".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(w for w, k in zip(words, stays) if k)
    return doc_id, len(runs), s, length, q, runs and 1000 * length // q or None, sha(lines), sha(text)


RUN_COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 7)), max_size=6))
def test_runs_by_definition(parts):
    words = [w for part, times in parts for w in part * times]
    assert periodic_runs.find_runs(np.array(words, dtype=np.int64)) == plain_runs(words)


@pytest.mark.parametrize("transform,step", [(0, 10**9), (10**9, 0), (12_000, 9_000)])
def test_lag_counts_however_parted(monkeypatch, transform, step):
    """All words frequent, all rare, or as the estimate says."""
    monkeypatch.setattr(periodic_runs, "TRANSFORM", transform)
    monkeypatch.setattr(periodic_runs, "PER_VALUE", transform and 12)
    monkeypatch.setattr(periodic_runs, "STEP", step)
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 64, 1000, 3001):
        for words in (1, 2, 40, 10_000):
            ids = np.unique((rng.random(n) ** 3 * words).astype(np.int64), return_inverse=True)[1]
            most = n // 4
            want = [0] + [int((ids[q:] == ids[:-q]).sum()) for q in range(1, most + 1)]
            assert periodic_runs.lag_matches(ids, most)[1:].tolist() == want[1:]


def test_transform_lengths():
    smooth = {2**a * 3**b * 5**c for a in range(13) for b in range(8) for c in range(6)}
    for n in range(1, 3000):
        assert periodic_runs._length(n) == min(x for x in smooth if x >= n)


def test_long_texts_use_the_stride(monkeypatch):
    monkeypatch.setattr(periodic_runs, "LONG", 100)
    rng = random.Random(5)
    words = [rng.randrange(50) for _ in range(1500)]
    for at, q, times in ((100, 1, 6), (130, 2, 4), (170, 7, 5), (250, 100, 4), (700, 60, 5), (1100, 3, 4), (1300, 5, 4)):
        words[at : at + q * times] = [rng.randrange(50) for _ in range(q)] * times
    assert periodic_runs.find_runs(np.array(words)) == plain_runs(words)


def test_periodic_runs(docs, odd, none):
    """The plain version takes time quadratic in the words, so it is given the shorter texts."""
    for table in (docs.where("length(text) < 4000"), odd.where("text is null or length(text) < 4000")):
        got = periodic_runs.op11(table).select(RUN_COLUMNS).collect()
        same_rows(got, [plain_row(r["doc_id"], r["text"]) for r in table.collect()])
    assert periodic_runs.op11(none).count() == 0


def test_planted_runs_are_found(docs):
    """Every rewritten text whose period fits four times from its first periodic word on has a run there."""
    got = {r["doc_id"]: r for r in periodic_runs.op11(docs).collect()}
    met = 0
    for r in docs.collect():
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            if n - a >= max(6, 4 * p):
                met += 1
                assert got[r["doc_id"]]["n_runs"] > 0
    assert met > 5


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "x ha ha ha ha ha ha ha y"), (2, "a b a b a b a b c"), (3, "one two three"), (4, None)], "k int, text string")
    got = {r["k"]: r for r in periodic_runs.collapsed(df).collect()}
    assert [got[k]["collapsed"] for k in (1, 2, 3, 4)] == ["x ha y", "a b c", "one two three", ""]
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 7, 1)] and [tuple(r) for r in got[2]["runs"]] == [(0, 8, 2)]


# ---------------------------------------------------------------- 12


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, digest) in Python's integers."""
    kept = []
    for vec_id, label, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            top = (1 << 63) - 1
            kept.append((vec_id, label, [max(-top - 1, min(top, math.floor(4096 * x))) for x in v]))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    size = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == size]
    cut = [k * size // parts for k in range(parts + 1)]
    books = [[r[2][a:b] for r in kept[:entries]] for a, b in zip(cut, cut[1:])]

    def assign():
        out = []
        for _, _, v in kept:
            best = [min((sum((x - y) ** 2 for x, y in zip(v[a:b], c)), i) for i, c in enumerate(book)) for book, a, b in zip(books, cut, cut[1:])]
            out.append(([i for _, i in best], sum(d for d, _ in best)))
        return out

    for _ in range(rounds):
        at = assign()
        for k, book in enumerate(books):
            for i in range(len(book)):
                mine = [v[cut[k] : cut[k + 1]] for (_, _, v), (code, _) in zip(kept, at) if code[k] == i]
                if mine:
                    book[i] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign()
    top = (1 << 63) - 1
    totals = defaultdict(int)
    for (_, label, _), (_, error) in zip(kept, at):
        totals[label] += min(error, top)
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in code), min(e, top), min(totals[label], top), sha) for (i, label, _), (code, e) in zip(kept, at)]


CODE_COLUMNS = "vec_id code error label_error codebooks_sha256".split()
VECTORS = "vec_id long, label int, embedding array<float>"


def coded(df):
    return vector_codes.op12(df).select(CODE_COLUMNS).collect()


def numbers(rng, n, size=16, scale=1.0):
    return [(i * 3 % n, rng.choice([None, 1, 2]), [float(np.float32(rng.gauss(0, scale))) for _ in range(size)]) for i in range(n)]


def test_vector_codes_sql(spark, sf_dir, duck, same):
    same(vector_codes.op12(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).toPandas(), duck.execute(vector_codes.oracle()).df())


@pytest.mark.parametrize("size,scale", [(16, 1.0), (64, 0.2), (13, 1.0), (5, 3.0), (16, 1e6), (16, 1e30)])
def test_vector_codes_by_definition(spark, size, scale):
    """Also lengths that 8 does not divide, and sizes at which doubles and longs do not do."""
    rng = random.Random(size)
    rows = numbers(rng, 60, size, scale)
    rows += [(7, 1, rows[0][2]), (7, 1, rows[0][2]), (None, None, rows[1][2]), (100, 2, None), (101, 2, [None] * size), (102, 1, [float("nan")] * size)]
    rows += [(103, 1, [float("inf")] * size), (104, 1, []), (105, 2, [1.0] * (size + 1)), (-1, 2, [float("-inf")] * size)]
    got = coded(spark.createDataFrame(rows, VECTORS).repartition(5))
    want = plain_codes(rows)
    assert len(want) == 63
    same_rows(got, want)


def test_vector_codes_of_few_and_no_rows(spark):
    for rows in ([], [(1, 1, None)], [(1, None, [0.5] * 8)], [(2, 1, [0.25] * 8), (1, 1, [0.25] * 8), (3, 1, [-0.1] * 8)]):
        same_rows(coded(spark.createDataFrame(rows, VECTORS)), plain_codes(rows))


def test_vector_codes_of_other_columns(spark):
    rows = [(i, [float(i % 7), float(i % 3)] * 4, *(f"own {c}" for c in CLASHES)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x array<double>, " + ", ".join(f"`{c}` string" for c in CLASHES))
    got, books = vector_codes.compressed(df, "x", "id")
    assert set(got.columns) == {"id", "code", "error", *CLASHES}
    row = got.first().asDict()
    assert all(row[c] == f"own {c}" for c in CLASHES if c not in ("code", "error"))
    back = vector_codes.decoded(got.drop("error"), books, "again").join(df.select("id", "x"), "id").collect()
    assert len(back) == 40 and all(max(abs(a - b) for a, b in zip(r["x"], r["again"])) < 1 for r in back)


def test_moved_is_the_difference(spark):
    """Only changed parts are sent, and old sums plus what moved are the new sums."""
    rows = [(b"\0\0", b"\0\0", [1, 2, 3]), (b"\0\1", b"\1\1", [4, 5, 6]), (None, b"\1\0", [7, 8, 9])]
    state = spark.createDataFrame(rows, "old binary, code binary, v array<int>")
    got = {(r["part"], r["entry"][0], r["place"]): (r["n"], r["total"]) for r in vector_codes.moved(state, [0, 1, 3], "long").collect()}
    assert got == {(0, 0, 0): (-1, -4), (0, 1, 0): (2, 11), (1, 0, 0): (1, 8), (1, 0, 1): (1, 9)}


@pytest.mark.parametrize("bound", [0, 10_000])
def test_totals_of_hot_and_many_labels(spark, bound):
    rows = [(i, None if i % 3 == 0 else i % 1500, i) for i in range(4000)] + [(5, 5, 5)] * 2
    df = spark.createDataFrame(rows, "k int, label int, value long").repartition(4)
    want = defaultdict(int)
    for _, label, value in rows:
        want[label] += value
    got = vector_codes.with_totals(df, "label", "value", "sum", bound)
    assert got.columns == ["k", "label", "value", "sum"]
    same_rows(got.collect(), [(*r, want[r[1]]) for r in rows])


# ---------------------------------------------------------------- 13


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_vocabulary())


@lru_cache
def table_of_misses():
    return token_counts.Lengths(token_counts.default_vocabulary(), {})


@pytest.fixture(scope="module")
def library():
    return lambda text: len(tokenizer().encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def lengths():
    return table_of_misses()


ODD_TEXTS = [
    "", " ", "   ", "\n\n  a", "a  b   c\t\td \n", "it's I'LL we've 'tis '' ''s 's's", "x<|endoftext|>y <|endoftext|>", "<|endoftext|", "漢字仮名 ñandú 😀👩‍👩‍👧 é́",
    "\x85\xa0 　 \x1c\x1d\x00", "1234567 ½ ² ٣", "՘Ⱟ꟎\U0001df95 b", "!?!? ...--- a!b", "z" * 3000, " " * 500 + "x", "don't " * 50,
]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_token_counts_of_odd_texts(lengths, library, text):
    assert lengths.tokens(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB s't1 \n!'<|>endoftx")), max_size=60))
def test_token_counts_are_the_librarys(text):
    assert table_of_misses().tokens(text) == len(tokenizer().encode(text, add_special_tokens=False).ids)


def test_stretches_cut_where_no_token_spans(lengths, library, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 20)
    text = "some words, it's 12 or more  with   blanks\n\nand linéas " * 30 + "z" * 90 + " !? end "
    assert "".join(token_counts.stretches(text)) == text and len(list(token_counts.stretches(text))) > 50
    assert lengths.tokens(text) == library(text)


def test_a_full_table_starts_anew(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MISSES", 3)
    table = token_counts.Lengths(token_counts.default_vocabulary(), {" the": 1})
    text = " ".join(f"word{i} the qx{i}z" for i in range(50))
    assert table.tokens(text) == library(text) and " the" in table and len(table) <= 5


def test_token_counts(spark, docs, odd, none, library):
    for table in (docs, odd):
        got = token_counts.op13(table).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
        want = []
        for r in table.collect():
            n = library(r["text"])
            want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 512))
        same_rows(got, want)
    assert token_counts.op13(none).count() == 0
    special = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    assert token_counts.op13(special).first()["n_tokens"] == 3


def test_first_tier_is_bounded_and_right(docs, library):
    table = token_counts.frequent_lengths(docs, "text", token_counts.default_vocabulary())
    assert 30_000 < len(table) <= 50_257 + token_counts.KEPT and all(len(w) <= token_counts.KEPT_LENGTH for w in table)
    for w in random.Random(3).sample(sorted(table), 2000):
        assert table[w] == library(w)


@pytest.mark.parametrize("name", ["collapsed", "counted"])
def test_columns_of_any_name(spark, name):
    df = spark.createDataFrame([(1, "some words and words", *(f"own {c}" for c in CLASHES))], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    operator, results = {"collapsed": (periodic_runs.collapsed, periodic_runs.RUNS), "counted": (token_counts.counted, token_counts.COUNTS)}[name]
    got = operator(df)
    assert set(got.columns) == set(df.columns) - {"text"} | set(results) and len(set(got.columns)) == len(got.columns)
    row = got.first().asDict()
    assert all(row[c] == f"own {c}" for c in CLASHES if c not in results)
    alone = operator(df.select("text"))
    assert set(alone.columns) == set(results) and alone.count() == 1
