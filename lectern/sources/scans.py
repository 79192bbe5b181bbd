"""Recognition of scanned pages that may lie on their side, upside down, or two on one image.

An image is a page, or the two parts of a double page.  A part has a few rotations to try, likeliest first: a text that reads well
enough decides it at once, else the best text of all rotations does.  Pages that turn out to be double once they are upright are split
then, and their halves are read in the same way.  All of it is one map over the images, so an image never leaves its task; the texts are
written to the shared folder, so no reader is asked twice for what is done.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scan_image as I
from ..functions.quality import odd_share, quality_of
from ..functions.text import cleaned_text
from ..session import shared_folder, ship

#: Fixed value: a text of this quality is taken without trying other rotations.
ACCEPT = 0.40
#: No part has more rotations to try.
MOST_CANDIDATES = 2
PARTS = "path string, page_no int, part int, text string, degrees int, error string"

#: Reads the text of an upright graymap, or of its gray values where it runs in the worker itself.
Reader = Callable[[bytes], str] | Callable[[np.ndarray], str]
#: Says by how many degrees a page has to be turned, or None.
Osd = Callable[[bytes], "int | None"]


def arbitrated(img, reader: Callable[[np.ndarray], str], osd: Osd | None = None, accept: float = ACCEPT) -> tuple[str, int, str | None]:
    """(text, degrees, first error) of a part's best rotation; ties go to the one tried first.

    Characters that no text has count against a reading: prose in words nobody knows is still better than what a turned page reads like.
    """
    sure = osd(I.write_pgm(img)) if osd else None
    best, degrees, most, error = "", 0, -2.0, None
    for turn in (I.candidates(img) if sure is None else [int(sure)])[:MOST_CANDIDATES]:
        try:
            text = cleaned_text(reader(I.rotated(img, turn)) or "")
        except Exception as e:  # the other rotations and parts go on
            error = error or f"{type(e).__name__}: {e}"
            continue
        if text and (score := quality_of(text) - odd_share(text)) > most:
            best, degrees, most = text, turn, score
        if most >= accept:
            break
    return best, degrees, error


def _parts(image: bytes, reader: Callable[[np.ndarray], str], osd: Osd | None, accept: float) -> Iterator[tuple]:
    """(part, text, degrees, error): part 0 of a single page, or parts 1 and 2 of a double one; all three where a page shows a spine after it was turned."""
    img = I.read_pgm(bytes(image))
    pages = I.split(img)
    for k, p in enumerate(pages):
        text, degrees, error = arbitrated(p, reader, osd, accept)
        yield k + (len(pages) > 1), text, degrees, error
    if len(pages) == 1 and degrees and text:
        halves = I.split(I.rotated(img, degrees))
        if len(halves) == 2:
            for k, p in enumerate(halves):
                yield k + 1, *arbitrated(p, reader, osd, accept)


def _recognised(reader: Reader, osd: Osd | None, accept: float, arrays: bool):
    read = reader if arrays else lambda img: reader(I.write_pgm(img))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, number, image in zip(b["path"], b["page_no"], b["image"]):
                try:
                    for part in _parts(image, read, osd, accept):
                        out.append((path, number, *part))
                except Exception as e:  # a broken image is a row with an error, and the other pages go on
                    out.append((path, number, 0, "", 0, f"{type(e).__name__}: {e}"))
            d = pd.DataFrame(out, columns=["path", "page_no", "part", "text", "degrees", "error"])
            yield d.astype({"page_no": "Int32", "part": "Int32", "degrees": "Int32"})

    return run


def oriented(images: DataFrame, reader: Reader, osd: Osd | None = None, accept: float = ACCEPT, arrays: bool = False) -> DataFrame:
    """(path, page_no, text, passes, error): the text of each page image, halves of a double page in order with a blank line between.

    ``images``: (path, page_no, image) as portable graymaps or bitmaps; rows of one page number of a file are one page.  ``arrays``: the reader
    takes gray values, which saves a copy of the turned image and its header.  ``passes`` counts the parts that
    gave a text.  Where both halves stood upside down, so did the double page, and its halves change places.  Halves that show only after turning replace the text of the whole page, unless neither gives any.
    """
    spark = images.sparkSession
    ship(spark)
    at = f"{shared_folder(spark)}/recognised-{uuid.uuid4().hex}"
    images.select("path", F.col("page_no").cast("int").alias("page_no"), "image").mapInPandas(_recognised(reader, osd, accept, arrays), PARTS).write.parquet(at)
    every = spark.read.schema(PARTS).parquet(at)
    found = F.array_sort(F.collect_list(F.struct("part", "text", "degrees")))
    d = every.groupBy("path", "page_no").agg(found.alias("p"), F.min("error").alias("error"))  # three parts at most
    good = F.filter("p", lambda x: x["text"] != "")
    d = d.select("path", "page_no", good.alias("p"), F.filter(good, lambda x: x["part"] > 0).alias("halves"), "error")
    upside_down = (F.size("halves") == 2) & F.forall("halves", lambda x: x["degrees"] == 180)
    used = F.when(upside_down, F.reverse("halves")).when(F.size("halves") > 0, F.col("halves")).otherwise(F.col("p"))
    d = d.select("path", "page_no", used.alias("used"), "error")
    text = F.array_join(F.transform("used", lambda x: x["text"]), "\n\n")
    return d.select("path", "page_no", text.alias("text"), F.size("used").alias("passes"), F.when(F.size("used") == 0, F.col("error")).alias("error"))


def recognised_scans(pages: DataFrame, images: DataFrame, reader: Reader, osd: Osd | None = None, accept: float = ACCEPT) -> DataFrame:
    """``pages`` with the text of their images where one was read, and ``ocr``; other pages keep their text."""
    read = oriented(images, reader, osd, accept).where("text != ''").select("path", "page_no", F.col("text").alias("_read"))
    d = pages.join(read, ["path", "page_no"], "left")
    return d.withColumns({"text": F.coalesce("_read", "text"), "ocr": F.col("_read").isNotNull()}).drop("_read")
