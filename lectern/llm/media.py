"""Media columns: lossless WebP images in a DataFrame.

``decoded`` turns a column of VP8L files into pixel arrays; ``stored`` writes bytes losslessly as
images and ``restored`` reads them back.  A stored value is a run of WebP files, each a tile of 16
ARGB pixels by up to 64 rows (64 bytes a row), so a long value never needs one large image and a batch
of values is coded in lockstep, tile by tile, in bounded memory.

Defined results: a null value is stored as empty; values are padded with zero bytes to a positive
multiple of 64; equal values are stored as equal bytes; a null or broken image decodes to null fields;
extra columns pass through unless named like a result, which then replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import unwrapped, wrapped

ROW, ROWS = 64, 64
TILE = ROW * ROWS
AUDIT = "n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string"
AUDITED = [x.split(":")[0] for x in AUDIT.split(",")]
#: Payload bytes coded at once by a task.
BATCH = 3_000_000


def padded(value: bytes) -> bytes:
    return value + b"\0" * (-len(value) % ROW or (0 if value else ROW))


def store(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload (whose length is a positive multiple of 64)."""
    tiles = [p[i : i + TILE] for p in payloads for i in range(0, len(p), TILE)]
    words = np.frombuffer(b"".join(tiles), dtype="<u4")
    files = iter(webp.encode_many(words, np.array([len(t) // ROW for t in tiles]), ROW // 4))
    return [b"".join(next(files) for _ in range(0, len(p), TILE)) for p in payloads]


def restore(media: list[bytes]) -> list[bytes]:
    """The payload of each stored form."""
    parts = [webp.files_in(m) for m in media]
    images = iter(webp.decode_many([f for p in parts for f in p]))
    return [b"".join(next(images).astype("<u4").tobytes() for _ in p) for p in parts]


def feature(payload: bytes) -> str:
    """Sum and sum of squares of the samples, and the summed steps between neighbouring samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    return f"sum={x.sum()};squares={(x * x).sum()};steps={np.abs(np.diff(x)).sum()}"


def _batches(values: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive values in as few parts of about one size as BATCH allows (one longer value goes alone)."""
    total = sum(map(len, values))
    most = total / max(1, -(-total // BATCH))
    now, n = [], 0
    for v in values:
        if now and n + len(v) / 2 > most:
            yield now
            now, n = [], 0
        now.append(v)
        n += len(v)
    if now:
        yield now


def stored(df: DataFrame, value: str, into: str = "media") -> DataFrame:
    """``df`` plus the stored form of a binary or string column."""

    @F.pandas_udf("binary")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([m for b in _batches([padded(x or b"") for x in s]) for m in store(b)], dtype=object)

    return df.withColumn(into, f(F.col(f"`{value}`").cast("binary")))


def _restored_or_none(media: list[bytes]) -> list[bytes | None]:
    """A batch in lockstep; where one of it is broken, each on its own."""
    try:
        return restore(media)
    except webp.Corrupt:
        return [None] if len(media) == 1 else [p for m in media for p in _restored_or_none([m])]


def restored(df: DataFrame, media: str = "media", into: str = "payload") -> DataFrame:
    """``df`` plus the payload that a stored column holds; null for a null or broken value."""

    @F.pandas_udf("binary")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            there = [m for m in s if m is not None]
            found = iter([p for b in _batches(there) for p in _restored_or_none(b)])
            yield pd.Series([None if m is None else next(found) for m in s], dtype=object)

    return df.withColumn(into, f(F.col(f"`{media}`")))


def decoded(df: DataFrame, image: str, into: str = "pixels") -> DataFrame:
    """``df`` plus struct(width, height, samples): RGBA samples row by row, of one WebP file each."""

    @F.pandas_udf("struct<width:int,height:int,samples:binary>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(x):
            try:
                words = webp.decode(x)
            except (webp.Corrupt, TypeError):
                return None, None, None
            return words.shape[1], words.shape[0], webp.pixels_rgba(words).tobytes()

        for s in batches:
            out = pd.DataFrame([one(x) for x in s], columns=["width", "height", "samples"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return df.withColumn(into, f(F.col(f"`{image}`")))


def audited(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, plus sizes, digests and features of its stored form, all read back.

    ``store`` and ``restore`` as above; bytes stay in the worker, so only digests cross back to the JVM.
    """

    @F.pandas_udf(f"struct<{AUDIT}>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for raw in _batches([(t or "").encode() for t in s]):
                media = store([padded(v) for v in raw])
                for v, m, p in zip(raw, media, restore(media)):
                    rows.append(
                        (len(v), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-ROW:]), len(m), hashlib.sha256(m).hexdigest(), feature(p))
                    )
            yield pd.DataFrame(rows, columns=AUDITED)

    d = wrapped(docs, text).select("_doc", f("_text").alias("_media")).select("_doc", "_media.*")
    return unwrapped(d, docs, AUDITED, [text])


def op1(docs: DataFrame) -> DataFrame:
    return audited(docs.select("doc_id", "text"))
