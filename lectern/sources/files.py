"""Files as a source: directory scans with failures as rows, text slices, page splits and listings."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import sane
from ..functions.text import basename, clean_meta, cleaned, extension, trimmed
from ..operators.library import CHUNK_CHARS, sliced

TEXT_EXTENSIONS = (".txt", ".md", ".markdown", ".rst")
PAGED_EXTENSIONS = (".pdf", ".epub", ".mobi", ".azw", ".azw3", ".fb2")
MIN_PAGE_CHARS = 50


def kind_of(path: Column) -> Column:
    """``text``, ``pdf`` (anything with pages) or empty for unsupported files."""
    e = extension(path)
    return F.when(e.isin(*TEXT_EXTENSIONS), "text").when(e.isin(*PAGED_EXTENSIONS), "pdf").otherwise("")


def supported(path: Column) -> Column:
    return kind_of(path) != ""


def scanned(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size, modified, content, error): supported files below the paths, hidden ones skipped.

    A missing or unreadable path becomes a row with an error; content is only read where it is asked for.
    """
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    good, bad = [], []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        try:
            at.getFileSystem(hadoop).getFileStatus(at)
            good.append(p)
        except Exception as e:  # the file system says what is wrong with this path
            bad.append((p, str(e).split("\n")[0][:300]))
    failed = spark.createDataFrame(bad, "path string, error string")
    failed = failed.select("path", F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"),
                           F.lit(None).cast("binary").alias("content"), "error")
    if not good:
        return failed
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(good)
    path = F.regexp_replace("path", "^file:(//)?", "")
    files = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", F.lit(None).cast("string").alias("error"))
    return files.where(supported(F.col("path"))).unionByName(failed)


def text_chunks(files: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """(path, seq, page_no, text): fixed slices of text files, each cleaned; no page numbers."""
    t = files.where(kind_of(F.col("path")) == "text").select("path", F.decode("content", "UTF-8").alias("t"))
    return t.select("path", F.posexplode(sliced(F.col("t"), size)).alias("seq", "text")).select(
        "path", "seq", F.lit(None).cast("int").alias("page_no"), cleaned(F.col("text")).alias("text")
    )


def page_chunks(extracted: DataFrame) -> DataFrame:
    """(path, seq, page_no, text) from (path, text) with form feeds between pages; a last empty page goes."""
    pages = F.split("text", "\f")
    pages = F.when((F.size(pages) > 1) & (F.trim(F.element_at(pages, -1)) == ""), F.slice(pages, F.lit(1), F.size(pages) - 1)).otherwise(pages)
    p = extracted.select("path", F.posexplode(pages).alias("seq", "text"))
    return p.select("path", "seq", (F.col("seq") + 1).alias("page_no"), cleaned(F.col("text")).alias("text"))


def needs_ocr(pages: DataFrame, least: int = MIN_PAGE_CHARS) -> DataFrame:
    """(path, needs_ocr, pages): documents with a thin or implausible page, and which pages those are."""
    poor = (F.octet_length("text") < least) | ~F.coalesce(sane(F.col("text")), F.lit(False))
    return pages.groupBy("path").agg(
        F.bool_or(poor).alias("needs_ocr"), F.array_sort(F.collect_list(F.when(poor, F.col("page_no")))).alias("pages")
    )


def ocr_targets(pages: DataFrame, force: bool = False, only: list[int] | None = None, least: int = MIN_PAGE_CHARS) -> DataFrame:
    """(path, page_no) of the pages to recognise.

    By force all pages, or those numbered in ``only``; else thin ones, and implausible ones that hold an image
    (column ``has_image``; without that column every page may).
    """
    p = pages.where(F.col("page_no").isNotNull())
    if force:
        return (p if only is None else p.where(F.col("page_no").isin(only))).select("path", "page_no")
    text = trimmed(F.coalesce("text", F.lit("")))
    thin, implausible = F.octet_length(text) < least, ~F.coalesce(sane(text), F.lit(False))
    image = F.coalesce("has_image", F.lit(False)) if "has_image" in pages.columns else F.lit(True)
    return p.where(thin | (implausible & image)).select("path", "page_no")


def page_results(files: DataFrame, wanted: DataFrame, work, result: str, workers: int | None = None) -> DataFrame:
    """(path, page_no, result, error) of a pluggable ``work(content, page_no)``, a file's pages in one go; a failure is a row.

    The cluster's cores bound how many files are worked on at once; ``workers`` bounds it further, for a program that allows few
    copies of itself.
    """
    kind = {"text": "string", "image": "binary"}[result]

    def run(batches):
        for b in batches:
            out = []
            for path, content, numbers in zip(b["path"], b["content"], b["numbers"]):
                for n in numbers:
                    try:
                        out.append((path, int(n), work(bytes(content), int(n)), None))
                    except Exception as e:  # the other pages go on
                        out.append((path, int(n), None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page_no", result, "error"])

    todo = wanted.groupBy("path").agg(F.array_sort(F.collect_set("page_no")).alias("numbers"))
    todo = todo.join(files.where(F.col("content").isNotNull()).select("path", "content"), "path")
    todo = todo.repartition(workers) if workers else todo
    return todo.mapInPandas(run, f"path string, page_no int, {result} {kind}, error string")


def recognised(pages: DataFrame, files: DataFrame, reader, force: bool = False, only: list[int] | None = None, workers: int | None = None) -> DataFrame:
    """``pages`` with recognised text where a page was wanted and read, and ``ocr``; other pages keep their text."""
    read = page_results(files, ocr_targets(pages, force, only), reader, "text", workers)
    read = read.where("text IS NOT NULL").select("path", "page_no", cleaned(F.col("text")).alias("_read"))
    d = pages.join(read, ["path", "page_no"], "left")
    return d.withColumns({"text": F.coalesce("_read", "text"), "ocr": F.col("_read").isNotNull()}).drop("_read")


def ocr_pages(pages: DataFrame) -> DataFrame:
    """(path, n_pages, n_ocr) per document."""
    return pages.groupBy("path").agg(F.count("*").alias("n_pages"), F.count_if("ocr").alias("n_ocr"))


def rendered(files: DataFrame, wanted: DataFrame, render, cache: str | None = None, workers: int | None = None) -> DataFrame:
    """(path, page_no, size, modified, image): pictures of pages by a pluggable ``render(content, page_no)``.

    ``cache``: a folder of pictures made before; a picture counts for the size and time that its file had, so a changed file is drawn anew.
    """
    spark = files.sparkSession
    stamps = wanted.join(files.select("path", "size", "modified"), "path").select("path", "page_no", "size", "modified")
    key = ["path", "page_no", "size", "modified"]
    old = None
    if cache is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            old = spark.read.parquet(cache)
    todo = stamps if old is None else stamps.join(old.select(*key), key, "left_anti")
    made = page_results(files, todo.select("path", "page_no"), render, "image", workers).where("image IS NOT NULL")
    made = made.join(stamps, ["path", "page_no"]).select(*key, "image")
    if cache is None:
        return made
    made.write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(stamps, key, "left_semi")


def pdf_text(content: Column) -> Column:
    """Literal metadata of an uncompressed PDF header, without junk: struct of title and author."""
    raw = F.decode(F.col(content) if isinstance(content, str) else content, "ISO-8859-1")
    one = lambda k: clean_meta(F.regexp_extract(raw, rf"/{k}\s*\(((?:[^()\\]|\\.)*)\)", 1))
    return F.struct(one("Title").alias("title"), one("Author").alias("author"))


def extract(files: DataFrame, extractor) -> DataFrame:
    """(path, text, error) of paged files by a pluggable ``extractor(bytes) -> str``; a failure is a row."""

    def run(batches):
        for b in batches:
            texts, errors = [], []
            for c in b["content"]:
                try:
                    texts.append(extractor(bytes(c)))
                    errors.append(None)
                except Exception as e:  # a broken document must not stop the others
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            b = b[["path"]].copy()
            b["text"], b["error"] = texts, errors
            yield b

    return files.where(kind_of(F.col("path")) == "pdf").select("path", "content").mapInPandas(run, "path string, text string, error string")


def pages(files: DataFrame, extractor, size: int = CHUNK_CHARS) -> DataFrame:
    """(path, seq, page_no, text, error) of scanned files, each kind its way: slices of text files, the spine of EPUBs, and what ``extractor`` reads of the others.

    What could not be scanned, is of no kind the library reads, or fails, is one row with an error.
    """
    from .epub import epub_pages

    there = files.where("error IS NULL AND content IS NOT NULL")
    columns = ["path", "seq", "page_no", "text", "error"]
    none = F.lit(None).cast("string").alias("error")
    is_epub = extension(F.col("path")) == ".epub"
    read = extract(there.where(~is_epub), extractor)
    failed = files.where("error IS NOT NULL OR content IS NULL").select("path", F.coalesce("error", F.lit("no content")).alias("error"))
    failed = failed.unionByName(there.where(~supported(F.col("path"))).select("path", F.lit("unsupported file type").alias("error")))
    failed = failed.unionByName(read.where("error IS NOT NULL").select("path", "error"))
    failed = failed.select("path", F.lit(0).alias("seq"), F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("string").alias("text"), "error")
    out = text_chunks(there, size).select("path", "seq", "page_no", "text", none)
    out = out.unionByName(epub_pages(there.where(is_epub)).select(*columns))
    out = out.unionByName(page_chunks(read.where("error IS NULL").select("path", "text")).select("path", "seq", "page_no", "text", none))
    return out.unionByName(failed)


def listing(spark: SparkSession, directory: str) -> DataFrame:
    """One directory: name, dir, supported, size; hidden entries left out, directories first."""
    if not os.path.isabs(directory):
        raise ValueError("an absolute path is needed")
    rows = [(e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size) for e in os.scandir(directory) if not e.name.startswith(".")]
    d = spark.createDataFrame(rows, "name string, dir boolean, size long")
    return d.select("name", "dir", (~F.col("dir") & supported(basename(F.col("name")))).alias("supported"), "size").orderBy(F.col("dir").desc(), "name")
