"""EPUB files as pages."""

import io
import zipfile

from lectern.sources import epub

CONTAINER = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{}"/></rootfiles></container>'
PACKAGE = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> A Book </dc:title>
<dc:creator>Ann A</dc:creator><dc:creator>Bob B</dc:creator></metadata><manifest><item id="a" href="a%20b.xhtml"/><item id="b" href="../other/b.xhtml"/><item id="c" href="gone.xhtml"/>
<item id="css" href="x.css"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="none"/><itemref idref="c"/></spine></package>"""


def book(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_pages_in_the_order_of_the_spine(spark):
    good = book({epub.CONTAINER: CONTAINER.format("OEBPS/p.opf"), "OEBPS/p.opf": PACKAGE, "OEBPS/a b.xhtml": "<html><style>x</style><p>first &amp; last</p></html>",
                 "other/b.xhtml": '<?xml version="1.0" encoding="ISO-8859-1"?><p>caf\xe9</p>'.encode("latin-1")})
    rows = [("good", good), ("cut", good[:60]), ("null", None), ("other", b"x"), ("no container", book({"a": "b"})), ("no spine", book({epub.CONTAINER: CONTAINER.format("p"), "p": "<package/>"})),
            ("no xml", book({epub.CONTAINER: "<"}))]
    got = {}
    for r in epub.epub_pages(spark.createDataFrame(rows, "path string, content binary")).orderBy("path", "seq").collect():
        got.setdefault(r["path"], []).append(r)
    assert [(r["page_no"], r["text"], r["title"], r["authors"]) for r in got["good"][:2]] == [(1, "café", "A Book", "Ann A, Bob B"), (2, "first & last", "A Book", "Ann A, Bob B")]
    assert got["good"][2]["text"] == "" and got["good"][2]["error"].startswith("KeyError") and len(got["good"]) == 3
    assert all(len(got[k]) == 1 and got[k][0]["error"] for k, _ in rows[1:])


def test_declared_and_marked_encodings():
    assert epub.decoded("ä".encode("utf-16")) == "ä"
    assert epub.decoded(b"\xef\xbb\xbfx") == "x" and epub.decoded(b'<?xml encoding="nonsense"?>x').endswith("x")


def test_every_kind_of_file_goes_its_way(spark):
    from lectern.sources import files

    good = book({epub.CONTAINER: CONTAINER.format("p.opf"), "p.opf": PACKAGE.replace("../other", "."), "a b.xhtml": "<p>two</p>", "b.xhtml": "<p>one</p>"})
    rows = [("/a.md", b"x" * 7000, None), ("/b.EPUB", good, None), ("/c.pdf", b"p1\x0cp2\x0c", None), ("/d.pdf", b"", None), ("/e.png", b"x", None), ("/gone.md", None, "no such file")]
    f = spark.createDataFrame(rows, "path string, content binary, error string")

    def extractor(content):
        if not content:
            raise ValueError("empty")
        return content.decode()

    got = {}
    for r in files.pages(f, extractor).orderBy("path", "seq").collect():
        got.setdefault(r["path"], []).append((r["page_no"], r["text"], r["error"]))
    assert [(n, len(t)) for n, t, _ in got["/a.md"]] == [(None, 6000), (None, 1000)]
    assert [(n, t) for n, t, _ in got["/b.EPUB"][:2]] == [(1, "one"), (2, "two")] and got["/b.EPUB"][2][2].startswith("KeyError")
    assert [(n, t) for n, t, _ in got["/c.pdf"]] == [(1, "p1"), (2, "p2")]
    assert got["/d.pdf"] == [(None, None, "ValueError: empty")] and got["/e.png"][0][2] == "unsupported file type" and got["/gone.md"][0][2] == "no such file"
    titled = spark.createDataFrame([(b"/Title (Untitled) /Author (Ann)",)], "content binary").select(files.pdf_text("content").alias("m")).first()["m"]
    assert titled["author"] == "Ann"
