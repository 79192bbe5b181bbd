"""Geometry of scanned pages: ink profiles, spine of a double page, and reading direction.

Images are grayscale arrays; the DataFrame form is a binary column in portable graymap format, or bitmap format where a page is black and white.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# Thresholds.
INK = 110
SPINE_FROM, SPINE_TO, SPINE_DEPTH, SPINE_FLANK = 0.42, 0.58, 0.004, 0.10
SPINE_NEAR, SPINE_INK, SPINE_SHARE, SPINE_WINDOW, SPINE_PIXELS = 0.30, 0.002, 0.3, 6, 1 << 20
RHYTHM, AXIS_RATIO = 0.15, 1.3
BLANK, MARGIN, LEAST_LINES, LAGS, BAND = 0.0005, 0.15, 24, (4, 120), 1.6


def read_pgm(data: bytes) -> np.ndarray:
    """A graymap, or a bitmap as grays of 0 and 255."""
    if m := re.match(rb"P4\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s", data):
        w, h = int(m[1]), int(m[2])
        body = np.frombuffer(data, dtype=np.uint8, offset=m.end())
        if len(body) < -(-w // 8) * h:
            raise ValueError("the bitmap is cut")
        return np.unpackbits(body[: -(-w // 8) * h].reshape(h, -(-w // 8)), axis=1, count=w) - np.uint8(1)
    m = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not m or int(m[3]) > 255:
        raise ValueError("not an 8-bit graymap")
    w, h = int(m[1]), int(m[2])
    body = np.frombuffer(data, dtype=np.uint8, offset=m.end())
    if len(body) < w * h:
        raise ValueError("the graymap is cut")
    return body[: w * h].reshape(h, w)


def write_pgm(img: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (img.shape[1], img.shape[0]) + np.ascontiguousarray(img, dtype=np.uint8).tobytes()


def write_pbm(ink: np.ndarray) -> bytes:
    """A bitmap: a bit for each pixel, set where there is ink."""
    return b"P4\n%d %d\n" % (ink.shape[1], ink.shape[0]) + np.packbits(ink, axis=1).tobytes()


def rotated(img: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by a multiple of 90."""
    return np.rot90(img, -(degrees // 90) % 4)


def reduced(img: np.ndarray, widest: int) -> np.ndarray:
    """Box-averaged so that the longer side has at most ``widest`` pixels."""
    k = -(-max(img.shape) // widest)
    if k <= 1:
        return img
    h, w = (n // k * k for n in img.shape)
    return img[:h, :w].reshape(h // k, k, w // k, k).mean(axis=(1, 3)).astype(np.uint8)


def unturned(img: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The view of an image that goes forward in memory, which numpy is fast on, and the steps that lead back (1 or -1)."""
    down, right = (-1 if s < 0 else 1 for s in img.strides)
    return img[::down, ::right], down, right


def _share(ink: np.ndarray, axis: int) -> np.ndarray:
    """Share of ink along an axis, counted in bytes: as many pixels at once as a byte can count."""
    x = np.moveaxis(ink.view(np.uint8), axis, 0)
    return sum(np.add.reduce(x[k : k + 255], axis=0, dtype=np.uint8).astype(np.int64) for k in range(0, len(x), 255)) / np.int64(len(x))


def columns(img: np.ndarray) -> np.ndarray:
    """Share of ink in each column."""
    x, _, right = unturned(img)
    return _share(x < INK, 0)[::right]


def profiles(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of ink in each row and each column."""
    x, down, right = unturned(img)
    ink = x < INK
    return _share(ink, 1)[::down], _share(ink, 0)[::right]


def _upper_quarter(x: np.ndarray) -> float:
    """The value three quarters up the sorted ones."""
    return float(np.sort(x)[len(x) * 3 // 4]) if len(x) else 0.0


def spine(img: np.ndarray) -> int | None:
    """Column of the gap between two facing pages, or None.

    The whitest window in the middle band, a fiftieth of the width, has to be near white, and the nearer of the inked parts
    on its sides has to be text by the page's own measure.
    """
    small = img
    while small.size > SPINE_PIXELS:
        small = reduced(small, -(-max(small.shape) // 2))
    cols = columns(small)
    w = len(cols)
    first, last, window = int(w * SPINE_FROM), int(w * SPINE_TO), max(SPINE_WINDOW, w // 50)
    sums = np.concatenate([[0.0], np.cumsum(np.concatenate([cols, np.zeros(window)]))])
    means = (sums[first + window : last + window + 1] - sums[first : last + 1]) / window
    if not len(means):
        return None
    k = int(np.argmin(np.round(means, 12)))
    at, depth = first + k + window // 2, means[k]
    near = cols[int(w * SPINE_NEAR) : max(at - window // 2, 0)], cols[at + window // 2 : int(w * (1 - SPINE_NEAR))]
    flank, own = min(map(_upper_quarter, near)), _upper_quarter(cols)
    if own < SPINE_INK or flank < SPINE_SHARE * own or depth > SPINE_DEPTH or depth > SPINE_FLANK * flank:
        return None
    return at * img.shape[1] // w


def halves(img: np.ndarray, at: int) -> list[np.ndarray]:
    """The two pages beside a spine, without what lies close to it."""
    w = img.shape[1]
    left = at - w // 200 if at > w // 14 else at
    return [img[:, :left], img[:, at + w // 200 :]]


def split(img: np.ndarray) -> list[np.ndarray]:
    """The pages of an image: two where it has a spine."""
    at = spine(img)
    return [img] if at is None else halves(img, at)


def rhythm(profile: np.ndarray) -> float:
    """Strength of the line rhythm: best normalised autocorrelation of the inked part over usual line distances, 0 to 1; the measure is fixed with its thresholds."""
    if profile.mean() < BLANK:
        return 0.0
    inked = np.flatnonzero(profile >= MARGIN * profile.max())
    x = profile[inked[0] : inked[-1] + 1]
    x = x - x.mean()
    variance = float(x @ x) / len(x)
    if len(x) < LEAST_LINES or variance < 1e-9:
        return 0.0
    lags = np.arange(LAGS[0], min(len(x) // 4, LAGS[1]) + 1)
    products = np.correlate(np.r_[x, np.zeros(lags[-1])], x, "valid")[lags]  # of x with itself, by lag
    return max(0.0, float((products / (len(x) - lags)).max()) / variance)


def axis(img: np.ndarray) -> str:
    """``rows`` for upright or upside-down text, ``columns`` for text turned by 90 degrees, else empty."""
    rows, cols = (rhythm(p) for p in profiles(img))
    if max(rows, cols) < RHYTHM:
        return ""
    return "rows" if rows >= AXIS_RATIO * cols else "columns" if cols >= AXIS_RATIO * rows else ""


def lean(rows: np.ndarray) -> float:
    """Median over the lines of a profile of how far the ink's centre lies below the line's middle, in line heights."""
    mean = rows.mean()
    if mean < BLANK:
        return 0.0
    x = np.zeros(len(rows) + 2)  # a white row before and after
    x[1:-1] = rows
    on = x > BAND * mean
    edges = np.flatnonzero(on[1:] != on[:-1]) + 1
    first, size = edges[::2], edges[1::2] - edges[::2]
    ink, moment = np.add.reduceat(x, edges)[::2], np.add.reduceat(np.arange(len(x)) * x, edges)[::2]
    off = np.sort(((moment / ink - (first + size / 2)) / size)[size >= 3])
    return float(off[len(off) // 2]) if len(off) else 0.0


def asymmetry(img: np.ndarray) -> float:
    """How far the ink of a page's lines lies below their middles; upright Latin text is positive."""
    return lean(profiles(img)[0])


def candidates(img: np.ndarray) -> list[int]:
    """Rotations to try, likeliest first; a page without line rhythm is taken as it is."""
    across, down = profiles(img)
    rows, cols = rhythm(across), rhythm(down)
    if cols > AXIS_RATIO * rows and cols >= RHYTHM:
        return [90, 270] if lean(down) > 0 else [270, 90]  # turned by 90 degrees, columns are rows in their order
    if rows >= RHYTHM:
        return [180, 0] if lean(across) < 0 else [0, 180]
    return [0]


def arbitrated(qualities: dict[int, float], accept: float = 0.40) -> int | None:
    """The rotation whose text reads best, if it reads well enough; earlier ones win ties."""
    best = max(qualities, key=lambda k: qualities[k], default=None)
    return best if best is not None and qualities[best] >= accept else None


def analysed():
    """UDF: geometry of each page of a binary column; broken images have an error."""

    @F.pandas_udf("struct<width:int,height:int,ink:double,axis:string,spine:int,error:string>")
    def f(pages: pd.Series) -> pd.DataFrame:
        out = []
        for data in pages:
            try:
                img = read_pgm(bytes(data))
                out.append((img.shape[1], img.shape[0], float((img < INK).mean()), axis(img), spine(img), None))
            except (ValueError, TypeError) as e:
                out.append((None, None, None, None, None, str(e)))
        d = pd.DataFrame(out, columns=["width", "height", "ink", "axis", "spine", "error"])
        return d.astype({"width": "Int32", "height": "Int32", "spine": "Int32"})

    return f
