"""EPUB files as pages: the parts of the spine, in order, without outside programs.

A file's container names its package, the package lists parts and their order, and every part is reduced to text by the same rules
as a web page.  A file that is broken, or a part that is missing, is a row with an error; the others go on.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_meta, cleaned, html_to_text
from ..session import ship

CONTAINER = "META-INF/container.xml"
PARTS = "path string, seq int, html string, title string, authors string, error string"


def decoded(part: bytes) -> str:
    """Text of a part: by its byte order mark, its own declaration, or UTF-8."""
    if part[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return part.decode("utf-16", "replace")
    named = re.match(rb"""(?:\xef\xbb\xbf)?\s*<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)""", part)
    try:
        return part.decode(named[1].decode() if named else "utf-8-sig", "replace")
    except LookupError:
        return part.decode("utf-8-sig", "replace")


def package(z: zipfile.ZipFile) -> tuple[str, str, list[str]]:
    """Title, authors and the names of the parts in reading order."""
    root = ElementTree.fromstring(z.read(CONTAINER)).find(".//{*}rootfile")
    if root is None or not root.get("full-path"):
        raise ValueError("the container names no package")
    at = root.get("full-path")
    opf = ElementTree.fromstring(z.read(at))
    items = {i.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(at), unquote(i.get("href") or ""))) for i in opf.iterfind(".//{*}manifest/{*}item")}
    spine = [items[r.get("idref")] for r in opf.iterfind(".//{*}spine/{*}itemref") if r.get("idref") in items]
    said = lambda tag: [" ".join(e.itertext()).strip() for e in opf.iterfind(f".//{{http://purl.org/dc/elements/1.1/}}{tag}")]
    return next(iter(said("title")), ""), ", ".join(a for a in said("creator") if a), spine


def rows_of(path: str, content: bytes | None) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            title, authors, spine = package(z)
            if not spine:
                raise ValueError("the package has no spine")
            for seq, name in enumerate(spine):
                try:
                    yield path, seq, decoded(z.read(name)), title, authors, None
                except (KeyError, RuntimeError, zipfile.BadZipFile) as e:  # missing, encrypted or broken
                    yield path, seq, None, title, authors, f"{type(e).__name__}: {e}"
    except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
        yield path, 0, None, None, None, f"{type(e).__name__}: {e}"


def epub_parts(files: DataFrame) -> DataFrame:
    """(path, seq, html, title, authors, error) of (path, content); a file goes through one task, a part at a time."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield pd.DataFrame(list(rows_of(path, None if content is None else bytes(content))), columns=["path", "seq", "html", "title", "authors", "error"]).astype({"seq": "int32"})

    return files.select("path", "content").mapInPandas(run, PARTS)


def epub_pages(files: DataFrame) -> DataFrame:
    """(path, seq, page_no, text, title, authors, error): a page for each part of the spine; metadata without junk."""
    d = epub_parts(files)
    text = cleaned(html_to_text(F.col("html")))
    return d.select("path", "seq", (F.col("seq") + 1).alias("page_no"), text.alias("text"), clean_meta(F.col("title")).alias("title"), clean_meta(F.col("authors")).alias("authors"), "error")
