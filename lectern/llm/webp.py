"""Lossless WebP (VP8L): one general decoder, one decoder for many images at once, and an encoder.

``decode`` reads any VP8L file: prefix codes (simple and normal, several groups), back-references,
colour cache, and the predictor, cross-colour, subtract-green and palette transforms.  ``decode_many``
decodes a batch of files in lockstep: every file is a lane, each step yields one pixel of every lane with
a handful of array operations, so a pixel costs about 0.1 microseconds; files with several prefix groups are
passed to ``decode``.  ``encode_many`` writes images of one width: literals, colour-cache
hits, copies of earlier rows, and per image the transforms with the least estimated entropy.

Pixels are ARGB words (uint32); ``pixels_rgba`` gives the usual array.
"""

from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64
N_LITERALS, N_LENGTHS, N_DISTANCES = 256, 24, 40
#: Fixed values of the format: order of code-length codes, hash multiplier of the colour cache.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_HASH = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE = 0xFF000000
MAX_BITS = 15
#: The 120 near neighbours (x to the left, y rows up) of short distance codes, nearest first.
NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0),
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0),
)
REVERSED = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << MAX_BITS)], dtype=np.int64)


class Corrupt(ValueError):
    """The bytes are not a complete VP8L image."""


# ---------------------------------------------------------------- general decoder


class _Bits:
    """Least-significant-first bit reader."""

    def __init__(self, data: bytes):
        self.data, self.pos, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        i = self.pos >> 3
        return int.from_bytes(self.data[i : i + 6], "little") >> (self.pos & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.pos += n
        if self.pos > self.end:
            raise Corrupt("the image ends early")
        return v


def _code(lengths: list[int]) -> dict[tuple[int, int], int] | int:
    """Canonical code as {(length, code read first bit first): symbol}; a lone symbol needs no bits."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if not used:
        return 0
    if len(used) == 1:
        return used[0][1]
    if sum(1 << (MAX_BITS - n) for n, _ in used) != 1 << MAX_BITS:
        raise Corrupt("the prefix code is not complete")
    code, before, out = 0, 0, {}
    for n, s in sorted(used):
        code <<= n - before
        before = n
        out[n, code] = s
        code += 1
    return out


def _symbol(bits: _Bits, code) -> int:
    if isinstance(code, int):
        return code
    v = 0
    for n in range(1, MAX_BITS + 1):
        v = v << 1 | bits.read(1)
        if (s := code.get((n, v))) is not None:
            return s
    raise Corrupt("no such code")


def _read_code(bits: _Bits, size: int):
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        return {(1, 0): min(first, s), (1, 1): max(first, s)} if two and (s := bits.read(8)) != first else first
    own = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    tokens = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, lengths, last = _code(own), [], 8
    while len(lengths) < size and tokens:
        tokens -= 1
        s = _symbol(bits, code)
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + bits.read(2))
        else:
            lengths += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(lengths) > size:
        raise Corrupt("too many code lengths")
    return _code(lengths)


def _prefixed(bits: _Bits, k: int) -> int:
    if k < 4:
        return k + 1
    extra = (k - 2) >> 1
    return ((2 + (k & 1)) << extra) + bits.read(extra) + 1


def _distance(k: int, width: int) -> int:
    if k > len(NEAR):
        return k - len(NEAR)
    x, y = NEAR[k - 1]
    return max(1, x + y * width)


def _entropy_image(bits: _Bits, width: int, height: int, top: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, block, which = 1, 0, None
    if top and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        which = (_entropy_image(bits, across, -(-height >> block), False) >> 8 & 0xFFFF).tolist()
        groups = max(which) + 1
    sizes = (N_LITERALS + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    total, out = width * height, []
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    while len(out) < total:
        t = len(out)
        g, r, b, a, d = codes[which[(t // width >> block) * across + (t % width >> block)] if which else 0]
        s = _symbol(bits, g)
        if s < N_LITERALS:
            red, blue = _symbol(bits, r), _symbol(bits, b)
            fresh = [_symbol(bits, a) << 24 | red << 16 | s << 8 | blue]
        elif s < N_LITERALS + N_LENGTHS:
            n = _prefixed(bits, s - N_LITERALS)
            back = _distance(_prefixed(bits, _symbol(bits, d)), width)
            if back > t or n > total - t:
                raise Corrupt("a copy leaves the image")
            fresh = out[t - back : t][:n]
            while len(fresh) < n:
                fresh += fresh[: n - len(fresh)]
        else:
            fresh = [cache[s - N_LITERALS - N_LENGTHS]]
        out += fresh
        if cache_bits:
            for p in fresh:
                cache[(p * CACHE_HASH & 0xFFFFFFFF) >> shift] = p
    return np.array(out, dtype=np.uint32)


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _palette(coded: np.ndarray) -> tuple[int, np.ndarray]:
    """Packing and the 256 colours (missing ones transparent black) from the coded steps between colours."""
    table = np.zeros((256, 4), dtype=np.uint8)
    table[: len(coded)] = np.cumsum(coded.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8)
    return _packing(len(coded)), table.view(np.uint32).ravel()


def _read_transforms(bits: _Bits, width: int, height: int) -> tuple[list, int]:
    """The transforms in order of appearance, and the width of the coded image."""
    found: list = []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [k for k, *_ in found]:
            raise Corrupt("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            across = -(-width >> block)
            found.append((kind, width, block, _entropy_image(bits, across, -(-height >> block), False).reshape(-1, across)))
        elif kind == PALETTE:
            pack, table = _palette(_entropy_image(bits, bits.read(8) + 1, 1, False))
            found.append((kind, width, pack, table))
            width = -(-width >> pack)
        else:
            found.append((kind, width, 0, None))
    return found, width


# ---------------------------------------------------------------- inverse transforms


def _halves(a, b):
    """Average of two pixels, component by component, as integer arrays."""
    return (a + b) >> 1


def predicted(mode: int, left, top, top_left, top_right):
    """Prediction of one pixel (arrays of components) by one of the 14 modes."""
    if mode == 0:
        return np.array([0, 0, 0, 255])
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _halves(_halves(left, top_right), top)
    if mode <= 9:
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return _halves(a, b)
    if mode == 10:
        return _halves(_halves(left, top_left), _halves(top, top_right))
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(-1), np.abs(left - top_left).sum(-1)
        return np.where((to_left < to_top)[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = _halves(left, top)
    d = mean - top_left
    return np.clip(mean + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)


#: Modes that do not look at the pixel to the left: a whole run is predicted at once.
FREE_OF_LEFT = (0, 2, 3, 4, 8, 9)


def _undo_predictor(res: np.ndarray, block: int, modes: np.ndarray) -> np.ndarray:
    """``res``: (height, width) words."""
    h, w = res.shape
    r = res.view(np.uint8).reshape(h, w, 4).astype(np.int64)
    out = np.zeros((h, w, 4), dtype=np.int64)
    out[0, 0] = (r[0, 0] + [0, 0, 0, 255]) & 255
    out[0] = np.cumsum(np.concatenate([out[:1, 0], r[0, 1:]]), axis=0) & 255
    kinds = (modes >> 8 & 15).astype(int)
    for y in range(1, h):
        up = out[y - 1]
        out[y, 0] = (r[y, 0] + up[0]) & 255
        x = 1
        while x < w:
            end = min(w, ((x >> block) + 1) << block)
            mode = int(kinds[y >> block, x >> block])
            if mode == 1:
                out[y, x - 1 : end] = np.cumsum(np.concatenate([out[y, x - 1 : x], r[y, x:end]]), axis=0) & 255
            elif mode in FREE_OF_LEFT:
                right = np.concatenate([up[x + 1 : end + 1], out[y, :1]])[: end - x]
                out[y, x:end] = (r[y, x:end] + predicted(mode, None, up[x:end], up[x - 1 : end - 1], right)) & 255
            else:
                for i in range(x, end):
                    right = up[i + 1] if i + 1 < w else out[y, 0]
                    out[y, i] = (r[y, i] + predicted(mode, out[y, i - 1], up[i], up[i - 1], right)) & 255
            x = end
    return out.astype(np.uint8).view(np.uint32).reshape(h, w)


def _delta(t, c):
    return (np.asarray(t).astype(np.int8).astype(np.int64) * np.asarray(c).astype(np.int8).astype(np.int64)) >> 5


def _undo_cross_colour(img: np.ndarray, block: int, elements: np.ndarray) -> np.ndarray:
    h, w = img.shape
    e = elements[np.arange(h)[:, None] >> block, np.arange(w)[None] >> block]
    p = img.view(np.uint8).reshape(h, w, 4).copy()
    green = p[..., 1]
    red = p[..., 2].astype(np.int64) + _delta(e & 255, green)
    blue = p[..., 0].astype(np.int64) + _delta(e >> 8 & 255, green) + _delta(e >> 16 & 255, red & 255)
    p[..., 2], p[..., 0] = red & 255, blue & 255
    return p.view(np.uint32).reshape(h, w)


def _undo_subtract_green(img: np.ndarray) -> np.ndarray:
    p = img.view(np.uint8).reshape(*img.shape, 4).copy()
    p[..., 0] += p[..., 1]
    p[..., 2] += p[..., 1]
    return p.view(np.uint32).reshape(img.shape)


def _undo_palette(img: np.ndarray, width: int, pack: int, table: np.ndarray) -> np.ndarray:
    i = img >> 8 & 255
    if pack:
        each = 8 >> pack
        i = (i[..., None] >> (np.arange(1 << pack) * each).astype(np.uint32) & ((1 << each) - 1)).reshape(len(img), -1)[:, :width]
    return table[i]


def _undo(img: np.ndarray, transforms: list) -> np.ndarray:
    for kind, width, block, data in reversed(transforms):
        if kind == PREDICTOR:
            img = _undo_predictor(img, block, data)
        elif kind == CROSS_COLOUR:
            img = _undo_cross_colour(img, block, data)
        elif kind == SUBTRACT_GREEN:
            img = _undo_subtract_green(img)
        else:
            img = _undo_palette(img, width, block, data)
    return img


def _payload(data: bytes) -> bytes:
    """The VP8L chunk of a file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Corrupt("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"VP8L":
            body = data[at + 8 : at + 8 + n]
            if len(body) < max(n, 5) or body[0] != 0x2F:
                raise Corrupt("the VP8L chunk is cut or has another signature")
            return body
        at += 8 + n + (n & 1)
    raise Corrupt("there is no VP8L chunk")


def _header(bits: _Bits) -> tuple[int, int]:
    bits.read(8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Corrupt("another version")
    return width, height


def decode(data: bytes) -> np.ndarray:
    """The (height, width) ARGB words of one lossless WebP file."""
    bits = _Bits(_payload(data))
    width, height = _header(bits)
    transforms, coded = _read_transforms(bits, width, height)
    return _undo(_entropy_image(bits, coded, height, True).reshape(height, coded), transforms)


def pixels_rgba(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words).view(np.uint8).reshape(*words.shape, 4)[..., [2, 1, 0, 3]]


# ---------------------------------------------------------------- many images in lockstep


class _Lanes:
    """Bit readers over one buffer; a lane's position is its bit offset in the buffer."""

    def __init__(self, bodies: list[bytes]):
        sizes = np.array([len(b) + 8 for b in bodies], dtype=np.int64)
        raw = np.frombuffer(b"".join(x for b in bodies for x in (b, b"\0" * 8)) + b"\0" * 8, dtype=np.uint8)
        self.words = np.zeros(len(raw) - 7, dtype=U64)
        for i in range(8):
            self.words |= raw[i : i + len(self.words)].astype(U64) << U64(8 * i)
        self.start = (np.cumsum(sizes) - sizes) * 8
        self.end = self.start + (sizes - 8) * 8
        self.pos = self.start.copy()

    def window(self, lanes) -> np.ndarray:
        p = self.pos[lanes]
        return self.words[p >> 3] >> (p & 7).astype(U64)

    def read(self, lanes, n) -> np.ndarray:
        """``n`` bits (a number, or one for each lane) of each lane; up to 56."""
        n = np.asarray(n)
        v = self.window(lanes) & ((U64(1) << n.astype(U64)) - U64(1))
        self.pos[lanes] += n
        return v.astype(np.int64)


def _table(lengths: np.ndarray, bits: int) -> np.ndarray:
    """Rows of lookup tables: entry at the next ``bits`` bits is symbol | length << 16.

    In canonical order a symbol of length n fills 2**(bits - n) consecutive entries of the table that is
    indexed first bit first; one fixed permutation turns that into the order in which bits are read.
    """
    n, size = lengths.shape
    lengths = lengths.astype(np.int64)
    used = (lengths > 0).sum(axis=1)
    entry = np.arange(size)[None] | lengths << 16
    fill = np.where(lengths > 0, 1 << (bits - np.minimum(lengths, bits)), 0)
    lone = used <= 1
    if lone.any():  # no bits: the symbol (or 0) fills the table
        s = lengths[lone].argmax(axis=1)
        fill[lone] = 0
        fill[np.flatnonzero(lone), s] = 1 << bits
        entry[np.flatnonzero(lone), s] = s
    if (fill.sum(axis=1) != 1 << bits).any():
        raise Corrupt("a prefix code is not complete")
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    flat = np.repeat(np.take_along_axis(entry, order, 1).ravel(), np.take_along_axis(fill, order, 1).ravel())
    return flat.reshape(n, 1 << bits)[:, REVERSED[: 1 << bits] >> (MAX_BITS - bits)].astype(np.int32)


def _lane_lengths(lanes: _Lanes, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Code lengths of the next prefix code of each lane; ``size``: its alphabet."""
    out = np.zeros((len(ids), int(size.max())), dtype=np.uint8)
    simple = lanes.read(ids, 1) == 1
    if simple.any():
        row, at = np.flatnonzero(simple), ids[simple]
        two = lanes.read(at, 1)
        first = lanes.read(at, np.where(lanes.read(at, 1) == 1, 8, 1))
        out[row, first] = 1
        again = two == 1
        out[row[again], lanes.read(at[again], 8)] = 1
    if simple.all():
        return out
    row, at = np.flatnonzero(~simple), ids[~simple]
    count = 4 + lanes.read(at, 4)
    own = np.zeros((len(at), 19), dtype=np.uint8)
    for i, k in enumerate(LENGTH_ORDER):
        some = count > i
        own[some, k] = lanes.read(at[some], 3)
    table = _table(own, 7)
    tokens = size[row].copy()
    short = lanes.read(at, 1) == 1
    if short.any():
        tokens[short] = 2 + lanes.read(at[short], 2 + 2 * lanes.read(at[short], 3))
    here, last = np.zeros(len(at), dtype=np.int64), np.full(len(at), 8)
    live = np.arange(len(at))
    while len(live := live[(here[live] < size[row[live]]) & (tokens[live] > 0)]):
        tokens[live] -= 1
        lane = at[live]
        e = table[live, (lanes.window(lane) & U64(127)).astype(np.int64)]
        lanes.pos[lane] += e >> 16
        s = e & 0xFFFF
        lit = s < 16
        k = live[lit]
        out[row[k], here[k]] = s[lit]
        last[k] = np.where(s[lit] > 0, s[lit], last[k])
        here[k] += 1
        if not lit.all():
            for code, base, extra in ((16, 3, 2), (17, 3, 3), (18, 11, 7)):
                k = live[s == code]
                if len(k):
                    n = base + lanes.read(at[k], extra)
                    if (here[k] + n > size[row[k]]).any():
                        raise Corrupt("too many code lengths")
                    if code == 16:
                        for i in range(6):
                            m = k[n > i]
                            out[row[m], here[m] + i] = last[m]
                    here[k] += n
    return out


def _lane_prefixed(lanes: _Lanes, ids: np.ndarray, k: np.ndarray) -> np.ndarray:
    extra = np.where(k < 4, 0, (k - 2) >> 1)
    return np.where(k < 4, k + 1, ((2 + (k & 1)) << extra) + lanes.read(ids, extra) + 1)


_NEAR_X, _NEAR_Y = (np.array(v) for v in zip(*NEAR))


def _lane_distance(k: np.ndarray, width: np.ndarray) -> np.ndarray:
    i = np.minimum(k, len(NEAR)) - 1
    return np.where(k > len(NEAR), k - len(NEAR), np.maximum(1, _NEAR_X[i] + _NEAR_Y[i] * width))


def _decode_lanes(lanes: _Lanes, ids: np.ndarray, width: np.ndarray, count: np.ndarray, cache_bits: np.ndarray) -> np.ndarray:
    """Pixels (step, lane) of lanes sorted by falling ``count``; all have one prefix group."""
    n = len(ids)
    lengths = [_lane_lengths(lanes, ids, size) for size in (
        N_LITERALS + N_LENGTHS + np.where(cache_bits > 0, 1 << cache_bits, 0), *[np.full(n, 256)] * 3, np.full(n, N_DISTANCES))]
    bits = [max(1, int(x.max())) for x in lengths]
    tables = [_table(x, b).ravel() for x, b in zip(lengths, bits)]
    masks = [U64((1 << b) - 1) for b in bits]
    bases = [np.arange(n, dtype=np.int64) << b for b in bits]
    steps = int(count[0])
    active = np.searchsorted(-count, -np.arange(steps), side="left")
    out = np.zeros((steps, n), dtype=np.uint32)
    pos = lanes.pos[ids]
    left, back = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    copying = 0
    cached = bool((cache_bits > 0).any())
    top = int(cache_bits.max())
    cache = np.zeros((n, 1 << top), dtype=np.uint32)
    shift = np.where(cache_bits > 0, 32 - cache_bits, 32).astype(np.uint32)
    words, all_lanes = lanes.words, np.arange(n)

    def take(c, lane, w):
        e = tables[c][bases[c][lane] + (w & masks[c]).astype(np.int64)]
        return e & 0xFFFF, e >> 16

    for t in range(steps):
        m = int(active[t])
        if not m:
            break
        lane = all_lanes[:m]
        if copying:
            busy = left[:m] > 0
            c = lane[busy]
            out[t, c] = out[t - back[c], c]
            left[c] -= 1
            copying -= int((left[c] == 0).sum())
            lane = lane[~busy]
        if len(lane):
            p = pos[lane] if len(lane) < m else pos[:m]
            w = words[p >> 3] >> (p & 7).astype(U64)
            g, k = take(0, lane, w)
            lit = g < N_LITERALS
            if lit.all():
                w = w >> k.astype(U64)
                r, k1 = take(1, lane, w)
                w >>= k1.astype(U64)
                b, k2 = take(2, lane, w)
                k = k + k1 + k2
                if bits[0] + bits[1] + bits[2] + bits[3] > 56:
                    q = p + k
                    w = words[q >> 3] >> (q & 7).astype(U64)
                else:
                    w >>= k2.astype(U64)
                a, k3 = take(3, lane, w)
                pos[lane] = p + k + k3
                out[t, lane] = (a << 24 | r << 16 | g << 8 | b).astype(np.uint32)
            else:
                pos[lane] = p + k
                for part in (lane[lit],):
                    q = pos[part]
                    value = g[lit].astype(np.int64) << 8
                    for c, place in ((1, 16), (2, 0), (3, 24)):
                        s, k = take(c, part, words[q >> 3] >> (q & 7).astype(U64))
                        q = q + k
                        value |= s.astype(np.int64) << place
                    pos[part] = q
                    out[t, part] = value.astype(np.uint32)
                hit = g >= N_LITERALS + N_LENGTHS
                h = lane[hit]
                out[t, h] = cache[h, g[hit] - N_LITERALS - N_LENGTHS]
                ref = ~lit & ~hit
                if ref.any():
                    f = lane[ref]
                    lanes.pos[ids[f]] = pos[f]
                    length = _lane_prefixed(lanes, ids[f], g[ref].astype(np.int64) - N_LITERALS)
                    s, k = take(4, f, lanes.window(ids[f]))
                    lanes.pos[ids[f]] += k
                    dist = _lane_distance(_lane_prefixed(lanes, ids[f], s.astype(np.int64)), width[f])
                    if (dist > t).any() or (length > count[f] - t).any():
                        raise Corrupt("a copy leaves the image")
                    pos[f] = lanes.pos[ids[f]]
                    out[t, f] = out[t - dist, f]
                    left[f], back[f] = length - 1, dist
                    copying += int((length > 1).sum())
        if cached:
            v = out[t, :m]
            slot = np.where(cache_bits[:m] > 0, (v * np.uint32(CACHE_HASH)) >> np.minimum(shift[:m], 31), 0)
            cache[all_lanes[:m], slot] = v
    lanes.pos[ids] = pos
    if (pos > lanes.end[ids]).any():
        raise Corrupt("an image ends early")
    return out


#: Cells (steps x lanes) decoded at once.
LOCKSTEP_CELLS = 1_500_000


def _lane_images(lanes: _Lanes, ids: np.ndarray, width: np.ndarray, height: np.ndarray, top: bool) -> dict[int, np.ndarray]:
    """The next entropy-coded image of each lane; a top image with several prefix groups is left out."""
    cache_bits = np.zeros(len(ids), dtype=np.int64)
    has = lanes.read(ids, 1) == 1
    cache_bits[has] = lanes.read(ids[has], 4)
    rest = np.arange(len(ids))
    if top:
        rest = rest[lanes.read(ids, 1) == 0]
    count = width * height
    rest = rest[np.argsort(-count[rest], kind="stable")]
    out = {}
    while len(rest):
        n = max(1, int(LOCKSTEP_CELLS // count[rest[0]]))
        now, rest = rest[:n], rest[n:]
        pixels = np.ascontiguousarray(_decode_lanes(lanes, ids[now], width[now], count[now], cache_bits[now]).T)
        for row, i in zip(pixels, now):
            out[int(ids[i])] = row[: count[i]].reshape(height[i], width[i])
    return out


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """``decode`` of every file."""
    if not files:
        return []
    lanes = _Lanes([_payload(f) for f in files])
    ids = np.arange(len(files))
    lanes.read(ids, 8)
    width, height = lanes.read(ids, 14) + 1, lanes.read(ids, 14) + 1
    if (lanes.read(ids, 4) >> 1).any():
        raise Corrupt("another version")
    coded = width.copy()
    transforms: dict[int, list] = {}
    open_ = ids
    while len(open_ := open_[lanes.read(open_, 1) == 1]):
        kind = lanes.read(open_, 2)
        for i, k in zip(open_.tolist(), kind.tolist()):
            if k in [t[0] for t in transforms.setdefault(i, [])]:
                raise Corrupt("a transform occurs twice")
        for i in open_[kind == SUBTRACT_GREEN].tolist():
            transforms[i].append((SUBTRACT_GREEN, int(coded[i]), 0, None))
        for k in (PREDICTOR, CROSS_COLOUR):
            if len(mine := open_[kind == k]):
                block = lanes.read(mine, 3) + 2
                found = _lane_images(lanes, mine, -(-coded[mine] >> block), -(-height[mine] >> block), False)
                for i, b in zip(mine.tolist(), block.tolist()):
                    transforms[i].append((k, int(coded[i]), b, found[i]))
        if len(mine := open_[kind == PALETTE]):
            n = lanes.read(mine, 8) + 1
            found = _lane_images(lanes, mine, n, np.ones_like(n), False)
            for i, k in zip(mine.tolist(), n.tolist()):
                pack, table = _palette(found[i].ravel())
                transforms[i].append((PALETTE, int(coded[i]), pack, table))
                coded[i] = -(-coded[i] >> pack)
    found = _lane_images(lanes, ids, coded, height, True)
    return [_undo(found[i], transforms.get(i, ())) if i in found else decode(f) for i, f in enumerate(files)]


# ---------------------------------------------------------------- encoder


def _shannon(hist: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code for each row of counts; 0 for unused and for lone symbols.

    Shannon's lengths leave some of the code space free; the free space is then given to the
    shortest codes that fit, until none is left.
    """
    n, size = hist.shape
    total = hist.sum(axis=1, keepdims=True)
    used = hist > 0
    with np.errstate(divide="ignore"):
        x = np.ceil(np.log2(np.maximum(total, 1)) - np.log2(hist) - 1e-9)
    lengths = np.where(used, np.maximum(x, 1), 0).astype(np.int64)
    several = used.sum(axis=1) > 1
    lengths[~several] = 0
    cost = np.where(lengths > 0, 1 << (MAX_BITS - lengths), 0)
    free = np.where(several, (1 << MAX_BITS) - cost.sum(axis=1), 0)
    order = np.argsort(np.where(lengths > 0, lengths * 2_000_000 - np.minimum(hist, 1_000_000), 1 << 40), axis=1, kind="stable")
    most = int((lengths > 0).sum(axis=1).max(initial=0))
    row = np.arange(n)
    while (open_ := row[free > 0]).size:
        for k in range(most):
            s = order[open_, k]
            c = cost[open_, s]
            fits = (c > 0) & (c <= free[open_]) & (lengths[open_, s] > 1)
            r, s, c = open_[fits], s[fits], c[fits]
            lengths[r, s] -= 1
            free[r] -= c
            cost[r, s] *= 2
    return lengths


def _codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, first bit lowest."""
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    fill = np.where(lengths > 0, 1 << (MAX_BITS - lengths), 0)
    sorted_fill = np.take_along_axis(fill, order, 1)
    start = np.cumsum(sorted_fill, axis=1) - sorted_fill
    out = np.zeros_like(lengths)
    np.put_along_axis(out, order, REVERSED[np.minimum(start, (1 << MAX_BITS) - 1)], 1)
    return np.where(lengths > 0, out, 0)


#: Lengths of the code-length code: 0 to 12 and runs of zeros (17 short, 18 long); longer lengths do not arise.
_OWN = np.array([[4] * 13 + [0, 0, 0, 0, 4, 3]])
_OWN_CODE = _codes(_OWN)[0]
MAX_PIXELS = 4096


class _Tokens:
    """Bits to write: (image, place, value, width); places order the tokens of an image."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, image, place, value, width):
        image, place, value, width = np.broadcast_arrays(image, place, np.asarray(value).astype(U64), width)
        self.parts.append((image.ravel(), place.ravel(), value.ravel(), width.ravel()))

    def packed(self, n: int) -> list[bytes]:
        image, place, value, width = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(image.astype(np.int64) << 32 | place.astype(np.int64), kind="stable")
        image, value, width = image[order], value[order], width[order].astype(np.int64)
        sizes = (np.bincount(image, weights=width, minlength=n).astype(np.int64) + 7) >> 3
        base = np.cumsum(sizes) - sizes
        upto = np.cumsum(width) - width
        first = np.searchsorted(image, np.arange(n))
        at = upto - upto[np.minimum(first, len(upto) - 1)][image] + 8 * base[image]
        word, off = at >> 6, (at & 63).astype(U64)
        out = np.zeros((int(sizes.sum()) >> 3) + 2, dtype=U64)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[starts]] = np.add.reduceat(value << off, starts)
        over = np.flatnonzero((at & 63) + width > 64)
        out[word[over] + 1] |= value[over] >> (U64(64) - off[over])
        raw = out.tobytes()
        return [raw[a : a + k] for a, k in zip(base.tolist(), sizes.tolist())]


def _write_codes(tokens: _Tokens, image: np.ndarray, place: int, hist: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Writes one prefix code for each image; returns (codes, lengths) by image and symbol."""
    lengths = _shannon(hist)
    lone = (lengths > 0).sum(axis=1) == 0
    sym = hist.argmax(axis=1)
    a = image[lone]
    tokens.add(a, place, 1 | 1 << 2 | sym[lone] << 3, 11)  # simple, one symbol of 8 bits
    rows = np.flatnonzero(~lone)
    if len(rows):
        head, n = 0, 0
        for v, k in [(0, 1), (12, 4), *((int(_OWN[0, s]), 3) for s in LENGTH_ORDER[:16]), (0, 1)]:
            head |= v << n
            n += k
        tokens.add(image[rows], place, head, n)
        x = lengths[rows]
        size = np.broadcast_to(size, len(hist))[rows]
        inside = np.arange(x.shape[1])[None] < size[:, None]
        r, c = np.nonzero((x > 0) & inside)
        tokens.add(image[rows[r]], place + 1 + c, _OWN_CODE[x[r, c]], 4)
        zero = (x == 0) & inside
        edge = np.diff(np.pad(zero, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        r, c = np.nonzero(edge == 1)
        run = np.nonzero(edge == -1)[1] - c
        while len(r):
            img = image[rows[r]]
            step = np.where(run >= 11, np.minimum(run, 138), np.where(run >= 3, run, 1))
            value = np.where(run >= 11, _OWN_CODE[18] | (step - 11) << 3, np.where(run >= 3, _OWN_CODE[17] | (step - 3) << 4, _OWN_CODE[0]))
            tokens.add(img, place + 1 + c, value, np.where(run >= 11, 10, np.where(run >= 3, 7, 4)))
            c, run = c + step, run - step
            r, c, run = r[run > 0], c[run > 0], run[run > 0]
    return _codes(lengths), lengths


def _prefix_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix code, extra value, extra bits) of a length or distance from 1."""
    x = v.astype(np.int64) - 1
    high = np.maximum(np.floor(np.log2(np.maximum(x, 1))).astype(np.int64), 1)
    extra = np.where(x < 4, 0, high - 1)
    code = np.where(x < 4, x, 2 * high + (x >> np.maximum(high - 1, 0) & 1))
    return code, x & ((1 << extra) - 1), extra


def _entropy_coded(tokens: _Tokens, words: np.ndarray, image: np.ndarray, count: np.ndarray, width: int, place: int, top: bool) -> None:
    """Writes entropy-coded images; ``words`` holds the pixels of ``image[0]``, ``image[1]``, ... in turn."""
    n = len(image)
    first = np.cumsum(count) - count
    own = np.repeat(np.arange(n), count)
    within = np.arange(len(words)) - first[own]
    literal = np.ones(len(words), dtype=bool)
    copies = (np.zeros(0, dtype=np.int64),) * 3  # at, length, distance
    cache_bits = np.zeros(n, dtype=np.int64)
    hit = np.zeros(len(words), dtype=bool)
    slot = ((words * np.uint32(CACHE_HASH)) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
    if top:
        copies, literal = _row_copies(words, own, within, first, width)
        order = np.argsort(own << CACHE_BITS | slot, kind="stable")
        k, v = (own << CACHE_BITS | slot)[order], words[order]
        same = np.r_[False, (k[1:] == k[:-1]) & (v[1:] == v[:-1])]
        hit[order] = same
        hit &= literal
        worth = np.bincount(own[hit], minlength=n) * 20 > count
        cache_bits[worth] = CACHE_BITS
        hit &= worth[own]
        literal = literal & ~hit
    tokens.add(image, place, np.where(cache_bits > 0, 1 | cache_bits << 1, 0), np.where(cache_bits > 0, 5, 1))
    if top:
        tokens.add(image, place + 1, 0, 1)  # one prefix group
    size = N_LITERALS + N_LENGTHS + np.where(cache_bits > 0, 1 << cache_bits, 0)
    widest = int(size.max())
    lit_at, hit_at, copy_at = np.flatnonzero(literal), np.flatnonzero(hit), copies[0]
    parts = words.view(np.uint8).reshape(-1, 4)
    l_code, l_value, l_bits = _prefix_of(copies[1])
    d_code, d_value, d_bits = _prefix_of(copies[2] + len(NEAR))

    def hist(wide, *keys):
        return sum(np.bincount(own[at] * wide + sym, minlength=n * wide) for at, sym in keys).reshape(n, wide)

    green = hist(widest, (lit_at, parts[lit_at, 1].astype(np.int64)), (hit_at, N_LITERALS + N_LENGTHS + slot[hit_at]), (copy_at, N_LITERALS + l_code))
    at = place + 2
    books = [_write_codes(tokens, image, at, green, size)]
    for i, channel in enumerate((2, 0, 3), 1):
        books.append(_write_codes(tokens, image, at + 4096 * i, hist(256, (lit_at, parts[lit_at, channel].astype(np.int64))), 256))
    books.append(_write_codes(tokens, image, at + 4096 * 4, hist(N_DISTANCES, (copy_at, d_code)), N_DISTANCES))
    at += 4096 * 5
    o = own[lit_at]
    value, width_ = np.zeros(len(o), dtype=U64), np.zeros(len(o), dtype=np.int64)
    for (codes, lengths), channel in zip(books, (1, 2, 0, 3)):
        s = parts[lit_at, channel]
        value |= codes[o, s].astype(U64) << width_.astype(U64)
        width_ += lengths[o, s]
    tokens.add(image[o], at + within[lit_at], value, width_)
    codes, lengths = books[0]
    if len(hit_at):
        o, s = own[hit_at], N_LITERALS + N_LENGTHS + slot[hit_at]
        tokens.add(image[o], at + within[hit_at], codes[o, s], lengths[o, s])
    if len(copy_at):
        o, s = own[copy_at], N_LITERALS + l_code
        value, bits = codes[o, s] | l_value << lengths[o, s], lengths[o, s] + l_bits
        codes, lengths = books[4]
        value, bits = value | codes[o, d_code] << bits, bits + lengths[o, d_code]
        tokens.add(image[o], at + within[copy_at], value | d_value << bits, bits + d_bits)


CACHE_BITS = 6
_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)], dtype=U64)


def _row_copies(words, own, within, first, width):
    """Copies of whole earlier rows of the same image (neighbouring rows at one distance are one copy)."""
    rows = words.reshape(-1, width)
    img, y = own[::width], within[::width] // width
    with np.errstate(over="ignore"):
        key = (rows.astype(U64) * _MIX[np.arange(width) % 64]).sum(axis=1, dtype=U64)
    order = np.lexsort((y, key, img))
    prev = np.full(len(rows), -1)
    a, b = order[:-1], order[1:]
    same = (img[a] == img[b]) & (key[a] == key[b])
    a, b = a[same], b[same]
    equal = (rows[a] == rows[b]).all(axis=1)
    prev[b[equal]] = a[equal]
    at = np.flatnonzero(prev >= 0)
    literal = np.repeat(prev < 0, width)
    if not len(at):
        return (np.zeros(0, dtype=np.int64),) * 3, literal
    back = at - prev[at]
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (back[1:] != back[:-1]) | (img[at[1:]] != img[at[:-1]])]
    run = np.diff(np.r_[np.flatnonzero(new), len(at)])
    return (at[new] * width, run * width, back[new] * width), literal


def _residual(words, within, width, mode):
    """Prediction residual by the pixel to the left (1) or above (2)."""
    p = words.view(np.uint8).reshape(-1, 4)
    x, y = within % width, within // width
    left, top = np.roll(p, 1, axis=0), np.roll(p, width, axis=0)
    ref = np.where(((x > 0) & ((y == 0) | (mode == 1)))[:, None], left, top)
    ref[within == 0] = (0, 0, 0, 255)
    return np.ascontiguousarray(p - ref).view(np.uint32).ravel()


#: Multipliers (signed, in 32nds) of green to red, green to blue and red to blue.
CROSS = (16, 12, 8)


def _cross_coloured(words):
    p = words.view(np.uint8).reshape(-1, 4).copy()
    green, red = p[:, 1].copy(), p[:, 2].copy()
    p[:, 2] = (red - _delta(CROSS[0], green)) & 255
    p[:, 0] = (p[:, 0] - _delta(CROSS[1], green) - _delta(CROSS[2], red)) & 255
    return p.view(np.uint32).ravel()


def _entropies(words, own, n):
    """Estimated bits of each image, channel by channel."""
    p = words.view(np.uint8).reshape(-1, 4)
    total = np.zeros(n)
    for c in range(4):
        h = np.bincount(own * 256 + p[:, c], minlength=n * 256).reshape(n, 256)
        s = h.sum(axis=1, keepdims=True)
        total += (h * (np.log2(np.maximum(s, 1)) - np.log2(np.maximum(h, 1)))).sum(axis=1)
    return total


def _one_block(tokens, image, place, kind, element):
    """A transform whose data is a single pixel: five codes of one symbol, no bits of data."""
    parts = [int(element) >> 8 & 255, int(element) >> 16 & 255, int(element) & 255, int(element) >> 24, 0]
    tokens.add(image, place, 1 | kind << 1 | 7 << 3, 6)  # blocks of 512 x 512
    tokens.add(image, place + 1, 0, 1)
    for i, s in enumerate(parts):
        tokens.add(image, place + 2 + i, 1 | 1 << 2 | s << 3, 11)


def encode_many(words: np.ndarray, heights: np.ndarray, width: int, transform: bool | str = True) -> list[bytes]:
    """Files of images of one width; ``words`` holds their rows one after the other.

    An image has at most MAX_PIXELS pixels.  ``transform``: False for none, a name (``palette``,
    ``left``, ``top``, ``green``) to apply it wherever possible, True to let estimated sizes decide.
    """
    heights = np.asarray(heights, dtype=np.int64)
    n = len(heights)
    if not n:
        return []
    count = heights * width
    assert int(count.max()) <= MAX_PIXELS and width <= 512 and int(count.sum()) == len(words)
    words = np.ascontiguousarray(words, dtype=np.uint32)
    own = np.repeat(np.arange(n), count)
    first = np.cumsum(count) - count
    within = np.arange(len(words)) - first[own]
    tokens = _Tokens()
    ids = np.arange(n)
    alpha = (np.add.reduceat((words >> np.uint32(24) != 255).astype(np.int64), first) > 0).astype(np.int64)
    tokens.add(ids, 0, 0x2F | (width - 1) << 8 | (heights - 1) << 22 | alpha << 36, 40)
    choice = np.zeros(n, dtype=np.int64)  # 0 none, 1 left, 2 top, 3 palette, 4 subtract green
    variants = {}
    if transform:
        wanted = {"left": [1], "top": [2], "palette": [], "green": []}.get(transform, [1, 2])
        best = _entropies(words, own, n) if transform is True else np.full(n, np.inf)
        for mode in wanted:
            variants[mode] = _cross_coloured(_residual(words, within, width, mode))
            bits = _entropies(variants[mode], own, n) + 150
            choice = np.where(bits < best, mode, choice)
            best = np.minimum(bits, best)
        if transform == "green":
            choice[:] = 4
        if transform in (True, "palette"):
            key = own.astype(U64) << U64(32) | words
            tables = np.sort(key)
            tables = tables[np.r_[True, tables[1:] != tables[:-1]]]
            colours = np.bincount((tables >> U64(32)).astype(np.int64), minlength=n)
            choice[(colours <= 256) & ((colours * 4 <= count) if transform is True else True)] = 3
    tokens_at = 100_000_000
    coded = words.copy()
    for mode, v in variants.items():
        mine = ids[choice == mode]
        if len(mine):
            at = choice[own] == mode
            coded[at] = v[at]
            _one_block(tokens, mine, 10, PREDICTOR, mode << 8)
            _one_block(tokens, mine, 20, CROSS_COLOUR, OPAQUE | CROSS[2] << 16 | CROSS[1] << 8 | CROSS[0])
    mine = ids[choice == 4]
    if len(mine):
        at = choice[own] == 4
        p = coded[at].view(np.uint8).reshape(-1, 4)
        p[:, 0] -= p[:, 1]
        p[:, 2] -= p[:, 1]
        coded[at] = p.view(np.uint32).ravel()
        tokens.add(mine, 10, 1 | SUBTRACT_GREEN << 1, 3)
    tokens.add(ids, tokens_at - 1, 0, 1)  # no more transforms
    plain = ids[choice != 3]
    if len(plain):
        _entropy_coded(tokens, coded[(choice != 3)[own]], plain, count[plain], width, tokens_at, True)
    if len(mine := ids[choice == 3]):
        at = (choice == 3)[own]
        _palette_coded(tokens, mine, key[at], tables[(choice == 3)[(tables >> U64(32)).astype(np.int64)]], colours[mine], count[mine], width, tokens_at)
    return [_riff(b) for b in tokens.packed(n)]


def _palette_coded(tokens: _Tokens, ids, key, tables, colours, count, width, place) -> None:
    """Palettes of the images and their packed indices; ``key``: image << 32 | word, ``tables``: sorted distinct keys."""
    first = np.cumsum(colours) - colours
    index = (np.searchsorted(tables, key) - np.repeat(first, count)).astype(np.uint32)
    parts = (tables & U64(0xFFFFFFFF)).astype(np.uint32).view(np.uint8).reshape(-1, 4)
    steps = np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
    steps[first] = parts[first]
    tokens.add(ids, 10, 1 | PALETTE << 1 | (colours - 1) << 3, 11)
    _entropy_coded(tokens, np.ascontiguousarray(steps).view(np.uint32).ravel(), ids, colours, 1, 11, False)
    packs = np.array([_packing(c) for c in colours])
    for pack in range(4):
        if not len(mine := np.flatnonzero(packs == pack)):
            continue
        rows = index[np.repeat(packs == pack, count)].reshape(-1, width)
        each = 1 << pack
        rows = np.pad(rows, ((0, 0), (0, -width % each))).reshape(len(rows), -1, each)
        rows = (rows << (np.arange(each) * (8 >> pack)).astype(np.uint32)).sum(axis=2, dtype=np.uint32)
        coded = OPAQUE | rows << np.uint32(8)
        _entropy_coded(tokens, coded.ravel().astype(np.uint32), ids[mine], count[mine] // width * rows.shape[1], rows.shape[1], place, True)


def _riff(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def files_in(data: bytes) -> list[bytes]:
    """The RIFF files of which ``data`` is the concatenation."""
    out, at = [], 0
    while at < len(data):
        n = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] != b"RIFF" or at + n > len(data):
            raise Corrupt("a file is cut")
        out.append(data[at : at + n])
        at += n
    return out
