"""A fixed-height script for pages of known content: text as ink, and ink as text.

A character is a stem and the bits of its code point from the lower left on; gaps between characters vary, so only lines
have a rhythm.  It stands in for a printer and a recognition program where neither is available.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .scan_image import read_pgm, rotated, unturned, write_pbm

HEIGHT, WIDTH, PITCH, MARGIN, INDENT, PAPER = 7, 5, 13, 24, 29, 255
LINES, LINE, FEWEST = 25, 60, 12
PAGE_CHARS = LINES * LINE
#: Texts shorter than this are drawn upright: a page needs some lines before its direction shows.
LEAST_TURNED = 200
_HEIGHT, _WIDTH = 2 * MARGIN + LINES * PITCH, 2 * MARGIN + INDENT + LINE * (WIDTH + 3)


def _stems() -> np.ndarray:
    """Places of the stems of full lines, in a run of the lines' columns."""
    k, place = np.arange(LINES)[:, None], np.arange(LINE)
    mixed = (place + 1 + LINE * k) * 0x9E3779B1 & 0xFFFFFFFF
    gaps = 1 + ((mixed ^ mixed >> 15) * 0x85EBCA6B >> 13) % 3
    steps = np.cumsum(WIDTH + gaps, axis=1) - (WIDTH + gaps)
    return _WIDTH * k + MARGIN + 11 * k % INDENT + steps


_STEMS = _stems()
#: A byte of a code point has two of the six bits of each of the four columns right of a stem: as one byte a column, and back.
_COLUMNS = sum(((np.arange(256) >> c & 1) | (np.arange(256) >> c + 4 & 1) << 1).astype("<u4") << 8 * c for c in range(4))
_BITS = sum((np.arange(256) >> g & 1).astype("<u4") << 4 * g for g in range(HEIGHT - 1))


def _draw(text: str, ink: np.ndarray) -> None:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint8).reshape(-1, 4)
    size = min(LINE, max(1, -(-len(codes) // FEWEST)))
    lines = -(-len(codes) // size)
    char = np.full((len(codes), 5), (1 << HEIGHT) - 1, dtype=np.uint8)
    char[:, 1:] = (_COLUMNS[codes[:, 0]] | _COLUMNS[codes[:, 1]] << 2 | _COLUMNS[codes[:, 2]] << 4).view(np.uint8).reshape(-1, 4)
    columns = np.zeros((lines, _WIDTH), dtype=np.uint8)
    columns.ravel()[_STEMS[:lines, :size].ravel()[: len(codes), None] + np.arange(5)] = char
    for g in range(HEIGHT):
        top = MARGIN + HEIGHT - 1 - g
        ink[top : top + PITCH * lines : PITCH] = columns & 1 << g


def drawn(text: str) -> np.ndarray:
    """A page of up to PAGE_CHARS characters; short texts fill a few short lines, so that every page has a line rhythm."""
    ink = np.zeros((_HEIGHT, _WIDTH), dtype=bool)
    _draw(text, ink)
    return np.where(ink, np.uint8(0), np.uint8(PAPER))


def read(img: np.ndarray) -> str:
    """The text of an upright page; nonsense for any other."""
    on = np.zeros(len(img) + 2, dtype=bool)
    forward, down, _ = unturned(img)
    on[1:-1] = (forward.min(axis=1, initial=PAPER) < 128)[::down]
    edges = np.flatnonzero(on[1:] != on[:-1])
    whole = edges[1::2] - edges[::2] == HEIGHT
    ink = img[edges[::2][whole, None] + np.arange(HEIGHT)] < 128
    every = np.negative(ink.view(np.uint8))  # all bits of a pixel
    columns = every[:, HEIGHT - 1] & 1  # the six pixels of each
    for g in range(1, HEIGHT - 1):
        columns |= every[:, HEIGHT - 1 - g] & 1 << g
    bits = np.zeros((len(ink), img.shape[1] + WIDTH), dtype=np.uint8)  # nothing lies right of the page
    bits[:, : img.shape[1]] = columns
    stems = np.zeros(bits.shape, dtype=bool)
    stems[:, : img.shape[1]] = ink[:, 0]
    at = np.flatnonzero(stems)
    codes = _BITS.take(bits.take(at + 1))
    for c in range(1, 4):
        codes |= _BITS.take(bits.take(at + 1 + c)) << c
    codes[(codes >= 0x110000) | (codes >= 0xD800) & (codes < 0xE000)] = 0xFFFD
    if not whole.all():
        codes = np.insert(codes, np.repeat(np.r_[0, np.cumsum(stems.sum(axis=1))], np.diff(np.r_[-1, np.flatnonzero(whole), len(whole)]) - 1), ord("~"))
    return codes.tobytes().decode("utf-32-le")


def images(text: str, turns: int) -> Iterator[bytes]:
    """Bitmaps of a text's pages: two full pages side by side where there are two, each image a quarter further turned than the one before."""
    at = n = 0
    while at < len(text) or not n:
        part = text[at : at + 2 * PAGE_CHARS]
        part = part if len(part) == 2 * PAGE_CHARS else part[:PAGE_CHARS]
        pages = [part[k : k + PAGE_CHARS] for k in range(0, max(1, len(part)), PAGE_CHARS)]
        turn = 90 * ((turns + n) % 4) if len(part) >= LEAST_TURNED else 0
        shape = _HEIGHT, len(pages) * _WIDTH
        ink = np.zeros(shape if turn % 180 == 0 else shape[::-1], dtype=bool)
        upright = rotated(ink, -turn)  # a view: what is drawn upright lies turned
        for k, page in enumerate(pages):
            _draw(page, upright[:, k * _WIDTH : (k + 1) * _WIDTH])
        yield write_pbm(ink)
        at, n = at + len(part), n + 1


def read_image(image: bytes) -> str:
    return read(read_pgm(image))
