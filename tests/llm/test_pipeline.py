"""The corpus pipeline against plain versions of its stages, and on odd and empty tables."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import pandas as pd
import plain_versions as plain
from lectern.llm import bpe, language_id, mixing, secret_scan, simhash


def plain_run(spark, rows):
    """Rows of the last stage, from rows (doc_id, text, lang, source, n_chars)."""
    model = plain.Languages([(r["text"], r["lang"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5])
    judged = [plain.Languages.judged(model, r["text"]) for r in rows]
    rows = [r for r, (lang, score) in zip(rows, judged) if lang != "und" and score >= 0.5]
    known = {r["doc_id"]: simhash.sketch(r["text"]) for r in rows}
    least = plain.components(list(known), lambda a, b: plain.near(known[a], known[b]))
    rows = [r for r in rows if least[r["doc_id"]] == r["doc_id"]]
    table = secret_scan.train(secret_scan.samples(spark))
    rows = [r | {"text": plain.masked(r["text"], table)} for r in rows]
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows))
    times = {r["doc_id"]: r["times"] for r in c.execute(mixing.ORACLE).df().to_dict("records")}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = Counter()
    for r in rows:
        ids = t.encode(r["text"], add_special_tokens=False).ids
        out[r["doc_id"], r["lang"], r["source"], len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += times[r["doc_id"]]
    return +out


def test_run(spark, sf_dir, docs):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, out.collect())) == plain_run(spark, [r.asDict() for r in docs.collect()])


def test_languages(docs, odd):
    for df in (docs, odd):
        rows = df.collect()
        model = plain.Languages([(r["text"], r["lang"]) for r in rows if zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5])
        want = Counter((r["doc_id"], *((x := model.judged(r["text"]))[0], round(x[1], 3))) for r in rows)
        assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in language_id.op4(df).collect()) == want


def test_columns_stay(spark, sf_dir, docs, odd, none):
    for df in (docs, odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, sf_dir).columns == df.columns
        corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count()


def test_odd_rows(spark, sf_dir, odd):
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, odd, sf_dir).collect()} <= {4, 5, None, 7, 8, 9}
    assert Counter(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, odd, sf_dir).select("doc_id").collect())[4] == 1
    assert corpus_pipeline.mask_secrets(spark, odd, sf_dir).count() == odd.count()
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, odd, sf_dir).select("doc_id").collect())
    assert max(mixed.values()) <= 4  # rows of one key may come twice each
    assert corpus_pipeline.encode(spark, odd, sf_dir).count() == odd.count()
