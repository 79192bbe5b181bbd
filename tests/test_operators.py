import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.operators import changes as M
from lectern.operators import chat as H
from lectern.operators import curation as C
from lectern.operators import enrich as E
from lectern.operators import search as S
from lectern.operators.keyword_index import KeywordIndex
from lectern.sources import files, settings, store, web
from lectern.streaming import watch


@pytest.fixture(scope="module")
def lib(spark):
    docs = [(1, "/lib/a.pdf", "h1", "Attention Is All You Need", "ai/transformers"), (2, "/lib/b.pdf", "h2", "The Rust Programming Language", "cs"),
            (3, "/lib/c.pdf", "h2", "Cooking With Fire", "cooking")]
    return {
        "documents": spark.createDataFrame(docs, "id long, path string, sha256 string, title string, category string"),
        "tags": spark.createDataFrame([(1, "transformer", "vocab"), (2, "transformer", "vocab"), (3, "shared", "manual")], "doc_id long, tag string, source string"),
        "collections": spark.createDataFrame([(1, "reading")], "id long, name string"),
        "members": spark.createDataFrame([(1, 3)], "collection_id long, doc_id long"),
    }


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_scopes(lib):
    assert ids(H.scope(lib, "tag", "Transformer")) == [1, 2]
    assert ids(H.scope(lib, "category", "ai")) == [1]
    assert ids(H.scope(lib, "collection", "1")) == [3]
    assert ids(H.scope(lib, "library")) == [1, 2, 3]
    assert ids(H.scope(lib, "tag", "absent")) == []
    for kind, value in (("document", "9"), ("collection", "9"), ("shelf", "")):
        with pytest.raises(H.NotFound):
            H.scope(lib, kind, value)


def test_merge(lib):
    to = M.canonical_ids(lib["documents"])
    assert M.duplicates(lib["documents"]).select("canonical", "duplicate").collect() == [(2, 3)]
    checked = M.verified_duplicates(lib["documents"].withColumn("text", F.col("sha256"))).first()
    assert (checked["canonical"], checked["duplicate"], checked["sha3"]) == (2, 3, hashlib.sha3_256(b"h2").hexdigest())
    assert sorted(map(tuple, M.merged_tags(lib["tags"], to).collect())) == [(1, "transformer", "vocab"), (2, "shared", "manual"), (2, "transformer", "vocab")]
    assert list(map(tuple, M.merged_members(lib["members"], to).collect())) == [(1, 2)]
    left = M.deleted(lib, lib["documents"].where("id = 3").select("id"))
    assert ids(left["documents"]) == [1, 2] and left["members"].isEmpty() and ids(left["tags"], "doc_id") == [1, 2]


def test_rename(spark):
    d = spark.createDataFrame([("cs",), ("cs/ml/transformers",), ("csx",)], "c string")
    assert [r[0] for r in d.select(M.renamed_category(F.col("c"), "cs", "computer-science")).collect()] == ["computer-science", "computer-science/ml/transformers", "csx"]
    for a, b in (("cs", "cs/x"), ("", "x"), ("x", "x")):
        with pytest.raises(M.Conflict):
            M.renamed_category(F.col("c"), a, b)


def test_updates(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, M.upserted(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, M.inserted_or_ignored(old, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 4)]
    d = spark.createDataFrame([(1, "A", None, "x", False, None)], "id long, title string, authors string, category string, category_user boolean, year string")
    d = d.withColumns({"summary": F.lit(None).cast("string"), "status": F.lit("ingested")})
    r = spark.createDataFrame([(1, "B", "Unknown", "2020", "y", "s")], "id long, title string, authors string, year string, category string, summary string")
    got = M.stored_results(d, r).first()
    assert (got["title"], got["authors"], got["year"], got["category"], got["status"]) == ("A", "", "2020", "x", "done")


def test_tags(spark):
    f = lambda tags, c: spark.range(1).select(M.filtered_tags(F.array(*map(F.lit, tags)), F.lit(c))).first()[0]
    assert f(["computer-science", "machine-learning", "quantization"], "computer-science/machine-learning") == ["quantization"]
    assert f(["cs"], "cs") == ["cs"]
    got = spark.range(1).select(M.constrained_tags(F.array(*map(F.lit, ["Logic", "new", "poetry", "b", "c"])), ["logic", "poetry"], F.lit("x"))).first()[0]
    assert got["tags"] == ["logic", "poetry"] and got["other"] == ["new", "b"]


def test_respelled(spark):
    d = spark.createDataFrame([("AI/ML",), ("cs",)], "category string")
    r = spark.createDataFrame([(1, "ai/ml"), (2, "new")], "id long, category string")
    assert sorted(map(tuple, M.respelled(r, d).select("id", "category").collect())) == [(1, "AI/ML"), (2, "new")]


def test_packing(spark):
    f = lambda t, n: spark.range(1).select(C.packed(F.lit(t), n)).first()[0]
    assert f("aaa\n\nbbb\n\ncccccccccc\n\n ", 8) == ["aaa\n\nbbb", "cccccccccc"] or f("aaa\n\nbbb\n\ncccccccccc\n\n ", 8)[0] == "aaa\n\nbbb"
    assert f("", 8) == []


def test_enrichment(spark):
    def broken(t):
        if "bad" in t:
            raise RuntimeError("no")
        return t[:20]

    text = "\n\n".join(f"Part {i} " + "x" * 300 for i in range(40))
    docs = spark.createDataFrame([(1, text, "ingested"), (2, "bad " * 200, "ingested"), (3, "short", "ingested"), (4, "t", "done")], "id long, text string, status string")
    got = {r["id"]: r for r in E.processed(docs, broken, chunk_chars=1000, context_tokens=1450).collect()}
    assert set(got) >= {1, 2} and 4 not in got
    assert got[1]["source"] == "generated" and got[1]["summary"].startswith("Part 0") and got[1]["error"] is None
    assert got[2]["status"] == "ingested" and "no" in got[2]["error"]
    t = E.tagged(docs.select("id", "text"), E.overlapping_tags, ["part", "logic"]).where("id = 1").first()
    assert t["tags"] == ["part"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".trash").mkdir()
    (tmp_path / "notes.md").write_text("hello \nworld")
    (tmp_path / "sub" / "nested.MD").write_text("x" * 7000)
    (tmp_path / ".trash" / "gone.md").write_text("x")
    (tmp_path / "junk.bin").write_text("x")
    f = files.scanned(spark, [str(tmp_path), str(tmp_path / "missing")])
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in f.select("path", "size", "error").collect()}
    assert set(rows) == {"notes.md", "nested.MD", "missing"} and rows["missing"]["error"]
    c = files.text_chunks(f.where("error IS NULL")).collect()
    assert sorted((r["path"].rsplit("/", 1)[-1], r["seq"], len(r["text"])) for r in c) == [("nested.MD", 0, 6000), ("nested.MD", 1, 1000), ("notes.md", 0, 12)]
    assert [(r["name"], r["supported"]) for r in files.listing(spark, str(tmp_path)).collect()] == [("sub", False), ("junk.bin", False), ("notes.md", True)]
    p = files.page_chunks(spark.createDataFrame([("a.pdf", "one\ftwo\f")], "path string, text string"))
    assert [(r["page_no"], r["text"]) for r in p.orderBy("seq").collect()] == [(1, "one"), (2, "two")]
    assert files.needs_ocr(p).first()["pages"] == [1, 2]


def test_store(spark, lib, tmp_path):
    s = store.Store(spark, str(tmp_path / "lib"))
    assert s.version() == 0 and s.read() == {} and s.commit(lib) == 1
    s.export(str(tmp_path / "out"))
    with pytest.raises(M.Conflict):
        s.export(str(tmp_path / "out"))
    assert s.validate(str(tmp_path / "out")) == 3
    assert s.commit({"documents": lib["documents"].where("id < 3")}, after=1) == 2
    assert ids(s.read()["documents"]) == [1, 2] and ids(s.read(1)["documents"]) == [1, 2, 3] and ids(s.read()["collections"]) == [1]
    assert s.load(str(tmp_path / "out")) == 3 and ids(s.read()["documents"]) == [1, 2, 3]
    assert s.restore(2) == 4 and ids(s.read()["documents"]) == [1, 2]
    with pytest.raises(ValueError):
        s.validate(str(tmp_path))
    assert s.vacuum(keep=1) and ids(s.read()["documents"]) == [1, 2]


def test_store_conflicts_and_failed_checks(spark, lib, tmp_path):
    """Of two writers one wins; what fails leaves version and files as they were."""
    s, other = (store.Store(spark, str(tmp_path / "lib")) for _ in range(2))
    s.commit(lib)
    before = sorted(p.name for p in (tmp_path / "lib" / "tables").iterdir())
    other.commit({"members": lib["members"].limit(0)}, after=1)
    with pytest.raises(M.Conflict):
        s.commit({"documents": lib["documents"].limit(0)}, after=1)
    with pytest.raises(ValueError):
        s.commit({"documents": lib["tags"]}, check=store.checked)
    (tmp_path / "broken" / "documents").mkdir(parents=True)
    lib["tags"].write.mode("overwrite").parquet(str(tmp_path / "broken" / "documents"))
    with pytest.raises(ValueError):
        s.load(str(tmp_path / "broken"))
    assert s.version() == 2 and len(list((tmp_path / "lib" / "tables").iterdir())) == len(before) + 1 and ids(s.read()["documents"]) == [1, 2, 3]


def test_replayed_epochs_change_nothing(spark, lib, tmp_path):
    s = store.Store(spark, str(tmp_path / "lib"))
    s.commit(lib)
    add = s.sink("watch", lambda now, batch: {"documents": now["documents"].unionByName(batch)})
    batch = spark.createDataFrame([(9, "/lib/d.pdf", "h9", "New", "cs")], lib["documents"].schema)
    add(batch, 0)
    add(batch, 0)
    assert ids(s.read()["documents"]) == [1, 2, 3, 9] and s.version() == 2
    assert s.commit({"documents": batch}, sink="watch", epoch=0) == 2
    add(batch.withColumn("id", F.lit(10).cast("long")), 1)
    assert ids(s.read()["documents"]) == [1, 2, 3, 9, 10]


def test_import_takes_the_entry_of_the_path(spark):
    """Two collections hold one file name over two documents, and so does a document outside the bundle."""
    docs = spark.createDataFrame([(1, "/in/a/x.md", "old"), (2, "/in/b/x.md", "old"), (3, "/lib/x.md", "old"), (4, "/in/a/y.md", "old")], "id long, path string, title string")
    docs = docs.withColumns({"kind": F.lit(""), "category": F.lit("")})
    rows = [("a", 11, "x.md", "A x", "cs", "book"), ("b", 12, "x.md", "B x", "art", ""), ("b", 13, "z.md", "gone", "art", "")]
    entries = store.extracted(spark.createDataFrame(rows, "name string, doc_id long, file string, title string, category string, kind string"), "/in/")
    got = {r["id"]: (r["title"], r["kind"], r["category"], r["kind_user"], r["category_user"]) for r in store.imported(docs, entries).collect()}
    assert got == {1: ("A x", "book", "cs", True, True), 2: ("B x", "", "art", False, True), 3: ("old", "", "", False, False), 4: ("old", "", "", False, False)}
    assert sorted(map(tuple, store.imported_members(docs, entries.union(entries)).collect())) == [("a", 1), ("b", 2)]


def test_fetched_pages(spark):
    rows = [("http://a/1", "if a < b and c > d then", None), ("http://a/2", "<html><b>x</b> &amp; y", None), ("http://a/3", "<p>x</p>", "text/HTML; charset=x"),
            ("http://a/4", " ", None), ("ftp://a/5", "x", None), ("http://a/6", None, None), ("https://a/7", "z" * 20, None)]
    got = {r["url"][-1]: (r["text"], r["error"]) for r in web.fetched(spark.createDataFrame(rows, "url string, html string, content_type string"), most=23).collect()}
    assert got["1"] == ("if a < b and c > d then", None) and got["2"][0] == "x & y" and got["3"][0] == "x"
    assert got["4"] == ("", "no readable text at http://a/4") and got["6"][1] and "5" not in got
    assert web.fetched(spark.createDataFrame(rows, "url string, html string, content_type string"), most=5).where("url like '%7'").first()["text"] == "zzzzz\n…[truncated]"


def test_bundle(spark, lib, tmp_path):
    docs = lib["documents"].withColumn("kind", F.lit("book"))
    both = spark.createDataFrame([(1, 1), (1, 3)], "collection_id long, doc_id long")
    docs = docs.withColumn("path", F.when(F.col("id") == 3, "/other/a.pdf").otherwise(F.col("path")))
    m = store.manifest(lib["collections"], both, docs, lib["tags"])
    rows = store.parsed(m).orderBy("doc_id").collect()
    assert [r["file"] for r in rows] == ["a.pdf", "3-a.pdf"] and rows[1]["tags"][0]["tag"] == "shared"
    gone = store.write_bundle(str(tmp_path / "b.zip"), "reading", m.first()["manifest"], {"a.pdf": "/no/such"})
    assert gone == ["a.pdf"] and store.read_bundle(str(tmp_path / "b.zip"), str(tmp_path / "x"))["name"] == "reading"


def test_settings(spark, tmp_path):
    c = settings.Config().updated(max_tags=7)
    assert c.max_tags == 7 and c.updated(max_tags=99).max_tags == 7
    c.save(str(tmp_path / "c.yaml"))
    assert settings.load(str(tmp_path / "c.yaml")) == c
    assert settings.vocabulary(spark, str(tmp_path / "none")).isEmpty()
    (tmp_path / "v.yaml").write_text('tags:\n  Logic: "proofs"\n  art: ""\n')
    v = settings.vocabulary(spark, str(tmp_path / "v.yaml"))
    assert list(map(tuple, v.collect())) == [("art", ""), ("logic", "proofs")]


def test_index_on_disk(spark, tmp_path):
    c = spark.createDataFrame([(1, "the cat sat"), (2, "a cat and a dog"), (3, "the dog")], "id long, text string")
    stored = KeywordIndex(spark, str(tmp_path / "ix"))
    stored.refresh(c)
    index, scan = stored.read(), (S.postings(c), S.statistics(c))
    assert [r[0] for r in S.ranked(*index, "cat OR dog", 3).collect()] == [r[0] for r in S.ranked(*scan, "cat OR dog", 3).collect()]
    assert S.ranked(*index, " ?! ", 3).isEmpty()
    assert "PushedFilters: [IsNotNull(term), StringStartsWith(term,do)]" in S._rows(index[0], "do", True)._jdf.queryExecution().toString()
    got = {q: sorted(r[0] for r in S.ranked(*index, q, 9).collect()) for q in ("cat dog", "dog NOT cat", '"the cat" OR do*', "(cat OR dog) NOT sat")}
    assert got == {"cat dog": [2], "dog NOT cat": [3], '"the cat" OR do*': [1, 2, 3], "(cat OR dog) NOT sat": [2, 3]}
    v = S.embed_pending(c.withColumn("embedding", F.lit(None).cast("array<float>")), S.hashing_embedder(16), "m", None)
    assert all(len(r["embedding"]) == 16 for r in v.collect())


def test_chat(spark):
    m = spark.createDataFrame([(1, 1, "hi", '[{"t":"text","text":"a"}]'), (1, 2, "yo", "{broken"), (1, 3, "x", None)], "session_id long, id long, content string, tool_log string")
    assert [[e["text"] for e in r["events"]] for r in H.events(m).orderBy("id").collect()] == [["a"], ["yo"], ["x"]]
    assert ids(H.reverted(m, 1, 2)) == [1]
    assert H.regenerable(None) == list(H.FIELDS) and H.regenerable(["tags", "x"]) == ["tags"]
    with pytest.raises(ValueError):
        H.regenerable(["x"])


def test_jobs(spark):
    from lectern.operators.jobs import FINISHED_KEPT, Jobs

    j = Jobs(spark)
    assert j.run("count", lambda: spark.range(5).count())["result"] == 5
    assert j.run("bad", lambda: 1 / 0)["status"] == "failed" and not j.cancel(2)
    for _ in range(FINISHED_KEPT + 5):
        j.run("x", lambda: None)
    assert len(j.history) == FINISHED_KEPT and j.history[-1]["status"] == "done"


def test_kind_documents_reads_whole_texts(spark, tmp_path):
    """Numbered chapters in the middle, references at the end and the size per page count behind character 40,000 as well."""
    from lectern.plans import registry

    filler = "some plain words in a row\n" * 2000
    chapters = "".join(f"\n{i}. The body of things\nbody\n" for i in range(1, 7))
    ends = "\nReferences\n" + "".join(f"[{i}] A. Body, 2020. doi:10.1000/x{i}\n" for i in range(1, 9))
    rows = [(1, filler + chapters + filler), (2, filler * 2 + ends), (3, filler * 2), (4, filler + "\n" + ends + filler)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["id"]: r["kind"] for r in registry.QUERIES["kind_documents"](spark, str(tmp_path)).collect()}
    # the fourth has its references between head and tail, which the classifier does not read for them
    assert got == {1: "book", 2: "paper", 3: "", 4: ""}


def test_section_queries_read_documents(spark, tmp_path):
    """Sections, kinds and scores of stored documents, one row per document."""
    from lectern.plans import registry

    text = "filler\n" * 9000 + "Contents\nFirst things .... 3\nPreface\n" + "why it was made " * 30 + "\nAbstract\n" + "what it says " * 20 + "\nReferences\n[1] x\n"
    spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: {r["id"]: r for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("toc_documents")[1]["toc"] == "First things"
    assert run("front_matter_documents")[1]["front"].startswith("why it was made")
    assert run("abstract_documents")[1]["abstract"] == ("what it says " * 20).strip()
    assert run("kind_scores_documents")[1]["paper"] == 6.0 and run("kind_with_pins_documents")[1]["kind"] == "paper"
    assert all(len(run(f"{n}_documents")) == 3 for n in ("toc", "front_matter", "abstract", "kind_scores", "kind_with_pins"))


def test_tool_loop(spark):
    from lectern.operators import tools

    docs = spark.createDataFrame([(1, "/a.txt", "One", "en/x", "first text"), (2, "/b.txt", "Two", "fr/y", "second")], "id long, path string, title string, category string, text string")
    lib = {"documents": docs}
    hits = lambda q, mode, k: spark.createDataFrame([(2, 0.9, mode), (1, 0.5, q)], "doc_id long, score double, why string").limit(k)
    reg = tools.library_tools(lib, docs.where("id = 1").select("id"), hits, fetch=lambda url: f"page {url}")
    assert [t["name"] for t in reg.definitions()] == ["search_library", "get_document", "open_document", "regenerate_metadata", "fetch_url"]
    assert reg.call("search_library", {"query": "q"}) == [{"doc_id": 1, "score": 0.5, "why": "q"}]
    assert reg.call("get_document", {"doc_id": 1})["opening"] == "first text"
    assert reg.call("get_document", {"doc_id": 2}) == "error: document 2" and reg.call("nothing", {}) == "error: unknown tool nothing"
    assert reg.call("open_document", {"doc_id": 1, "view": "odd"}) == {"action": "open", "id": 1, "view": "preview"}
    assert reg.call("open_document", {}) == "error: doc_id is missing" and reg.call("open_document", {"doc_id": "x"}).startswith("error: ")
    assert reg.call("regenerate_metadata", {"doc_id": 1, "fields": ["tags", "odd"]})["fields"] == ["tags"]
    assert reg.call("fetch_url", {"url": "u"}) == "page u"
    asked = []

    def backend(messages, tools_):
        asked.append(len(tools_))
        return f"round {len(asked)}", [("get_document", {"doc_id": 1})] if len(asked) < 3 else []

    events = tools.converse(backend, reg, "who?")
    assert [e["t"] for e in events] == ["text", "tool", "text", "tool", "text"] and events[-1]["text"] == "round 3"
    endless = tools.converse(lambda m, t: ("", [("nothing", {})]), reg, "who?", rounds=2)
    assert [e["result"] for e in endless] == ["error: unknown tool nothing"] * 2


def test_streams_of_each_provider(spark):
    from lectern.operators import tools

    lines = {
        "openai": ['data: {"choices":[{"delta":{"content":"a"}}]}', "", ": ping", 'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"name":"f","arguments":"{\\"x\\""}}]}}]}',
                   'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":":1}"}}]}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}'],
        "anthropic": ["event: x", 'data: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"a"}}', 'data: {"type":"content_block_start","index":1,"content_block":{"type":"tool_use","name":"f"}}',
                      'data: {"type":"content_block_delta","index":1,"delta":{"partial_json":"{\\"x\\""}}', 'data: {"type":"content_block_delta","index":1,"delta":{"partial_json":":1}"}}'],
        "ollama": ['{"message":{"content":"a"}}', '{"message":{"content":"","tool_calls":[{"function":{"name":"f","arguments":{"x":1}}}]}}', '{"done":true}'],
    }
    for provider, ls in lines.items():
        log = spark.createDataFrame([(7, i, x) for i, x in enumerate(ls)], "answer long, seq long, line string")
        r = tools.streamed(log, provider).first()
        assert (r["answer"], r["text"], [(c["name"], c["args"]) for c in r["calls"]]) == (7, "a", [("f", '{"x":1}')])


def test_vanished_files_are_forgotten(spark):
    s = spark.createDataFrame([("a", 1, 1, 0), ("a", 1, 1, 1), ("b", 1, 1, 0), ("b", 2, 1, 1), ("c", 1, 1, 0), ("d", 1, 1, 1), ("e", 1, 1, 0), ("e", 1, 1, 1)], "path string, size long, mtime long, scan long")
    done = spark.createDataFrame([("e", 1, 1), ("c", 1, 1), ("b", 1, 1)], "path string, size long, mtime long")
    now, left = watch.due(s, done)
    assert [r["path"] for r in now.collect()] == ["a"] and sorted(r["path"] for r in left.collect()) == ["b", "e"]
    assert sorted(r["path"] for r in watch.due(s, done, settle=False)[0].collect()) == ["a", "b", "d"]


def test_recognised_and_rendered_pages(spark, tmp_path):
    f = spark.createDataFrame([("/a.pdf", 3, "2024-01-01", b"aaa"), ("/b.pdf", 1, "2024-01-01", b"b"), ("/gone.pdf", None, None, None)], "path string, size long, modified string, content binary")
    prose = "This page has plain words that read like prose, so its own text layer is kept as it is. " * 2
    pages = spark.createDataFrame([("/a.pdf", 1, prose, True), ("/a.pdf", 2, "", False), ("/a.pdf", 3, "#" * 200, True), ("/b.pdf", 1, "#" * 200, False), ("/gone.pdf", 1, "", True)], "path string, page_no int, text string, has_image boolean")

    def reader(content, n):
        if n == 3:
            raise RuntimeError("no ink")
        return f"read {len(content)} {n}"

    texts = lambda d: {(r["path"], r["page_no"]): (r["text"], r["ocr"]) for r in d.collect()}
    got = texts(files.recognised(pages, f, reader))
    assert got == {("/a.pdf", 1): (prose, False), ("/a.pdf", 2): ("read 3 2", True), ("/a.pdf", 3): ("#" * 200, False), ("/b.pdf", 1): ("#" * 200, False), ("/gone.pdf", 1): ("", False)}
    assert {k for k, (_, ocr) in texts(files.recognised(pages, f, reader, force=True)).items() if ocr} == {("/a.pdf", 1), ("/a.pdf", 2), ("/b.pdf", 1)}
    one = files.recognised(pages, f, reader, force=True, only=[1])
    assert {k for k, (_, ocr) in texts(one).items() if ocr} == {("/a.pdf", 1), ("/b.pdf", 1)}
    assert {r["path"]: (r["n_pages"], r["n_ocr"]) for r in files.ocr_pages(one).collect()} == {"/a.pdf": (3, 1), "/b.pdf": (1, 1), "/gone.pdf": (1, 0)}
    cache, wanted = str(tmp_path / "covers"), pages.where("page_no = 1").select("path", "page_no")
    draw = lambda content, n: b"png" + content
    assert {r["path"]: bytes(r["image"]) for r in files.rendered(f, wanted, draw, cache).collect()} == {"/a.pdf": b"pngaaa", "/b.pdf": b"pngb"}
    changed = f.withColumn("modified", F.when(F.col("path") == "/b.pdf", "2024-02-02").otherwise(F.col("modified")))
    again = files.rendered(changed, wanted, lambda content, n: b"new" + content, cache)
    assert {r["path"]: bytes(r["image"]) for r in again.collect()} == {"/a.pdf": b"pngaaa", "/b.pdf": b"newb"}
    assert files.rendered(f, wanted, draw).count() == 2
