"""Lossless WebP (VP8L): a decoder for the whole format, and an encoder that can use each of its parts.

Pixels are uint32 ARGB. The decoder reads prefix codes (simple and normal, with meta groups), back-references, the colour cache, and
inverts predictor, cross-colour, subtract-green and palette transforms. Streams of one group without a colour cache are decoded
from tables: every bit position gets the length of a pixel that would start there, and the true positions are followed by jumps.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

MAX_SIDE = 16384
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
# Fixed values of the format: order of code length codes, and offsets (x, y) of the short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_MULT = 0x1E35A7BD
FARTHEST = (1 << 20) - len(NEAR)
SPREAD = 0x9E3779B97F4A7C15
BLACK = 0xFF000000
_REVERSED = {n: None for n in range(16)}
_STEP = 1 << 18


def _reversed_bits(n: int) -> np.ndarray:
    if _REVERSED[n] is None:
        r = np.zeros(1, np.int64)
        for _ in range(n):
            r = np.concatenate([r * 2, r * 2 + 1])
        _REVERSED[n] = r
    return _REVERSED[n]


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes, pos: int = 0) -> None:
        self.data, self.pos = data, pos

    def peek(self, n: int) -> int:
        at = self.pos >> 3
        return (int.from_bytes(self.data[at : at + 8], "little") >> (self.pos & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.pos += n
        return v


class Code:
    """A prefix code from its code lengths: a table over the next ``bits`` bits of symbol << 4 | length."""

    def __init__(self, lengths: Sequence[int]) -> None:
        lens = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lens)
        if len(used) <= 1:
            self._single(int(used[0]) if len(used) else 0)
            return
        self.only = None
        order = used[np.argsort(lens[used], kind="stable")]
        own = lens[order]
        self.bits = n = int(own[-1])
        spread = np.repeat((order << 4) | own, 1 << (n - own))
        if len(spread) != 1 << n:
            raise ValueError("prefix code is not complete")
        self.table = spread[_reversed_bits(n)].astype(np.int32)

    def _single(self, symbol: int) -> None:
        """No bits are spent on a single symbol."""
        self.bits, self.only, self.table = 0, symbol, np.array([symbol << 4], np.int32)

    @classmethod
    def single(cls, symbol: int) -> Code:
        code = cls.__new__(cls)
        code._single(symbol)
        return code

    def read(self, bits: Bits) -> int:
        e = int(self.table[bits.peek(self.bits)])
        bits.pos += e & 15
        return e >> 4


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        if not two:
            if first >= size:
                raise ValueError("symbol is out of range")
            return Code.single(first)
        lengths = [0] * size
        lengths[first] = lengths[bits.read(8)] = 1
        return Code(lengths)
    lengths = [0] * size
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(own)
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    table, n = code.table.tolist(), code.bits
    data, pos, mask = bits.data, bits.pos, (1 << n) - 1
    i, last = 0, 8
    while i < size and left:
        left -= 1
        at = pos >> 3
        window = int.from_bytes(data[at : at + 4], "little") >> (pos & 7)
        e = table[window & mask]
        k = e & 15
        pos += k
        s = e >> 4
        if s < 16:
            if s:
                lengths[i] = last = s
            i += 1
        else:
            window >>= k
            if s == 16:
                run, value = 3 + (window & 3), last
                pos += 2
            elif s == 17:
                run, value = 3 + (window & 7), 0
                pos += 3
            else:
                run, value = 11 + (window & 127), 0
                pos += 7
            if i + run > size:
                raise ValueError("code lengths run over")
            if value:
                lengths[i : i + run] = [value] * run
            i += run
    bits.pos = pos
    return Code(lengths)


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _copy(out: np.ndarray, n: int, length: int, dist: int) -> int:
    if dist > n:
        raise ValueError("back-reference before the first pixel")
    length = min(length, len(out) - n)
    out[n : n + length] = out[n - dist : n - dist + length] if dist >= length else np.resize(out[n - dist : n], length)
    return n + length


def _pixels_fast(bits: Bits, codes: list[Code], width: int, total: int) -> np.ndarray:
    """One group, no colour cache."""
    green, *rest, far = codes
    out, n = np.empty(total, np.uint32), 0
    data, flat = bits.data, all(c.only is not None for c in rest)
    fixed = np.uint32((rest[2].only << 24 | rest[0].only << 16 | rest[1].only) if flat else 0)
    shifts = np.arange(8, dtype=np.uint32)
    while n < total:
        begun, base = bits.pos, bits.pos >> 3
        limit = min(_STEP, max(64, (len(data) - base) * 8), (total - n) * 64 + 64)
        piece = np.frombuffer(data[base : base + limit // 8 + 24].ljust(limit // 8 + 24, b"\0"), np.uint8)
        wide = piece[:-3] | piece[1:-2].astype(np.uint32) << 8 | piece[2:-1].astype(np.uint32) << 16 | piece[3:].astype(np.uint32) << 24
        window = (wide[:, None] >> shifts).ravel()
        size = len(window) - 128
        g = green.table.take((window & np.uint32((1 << green.bits) - 1)).astype(np.intp), mode="clip")
        own = np.arange(len(g), dtype=np.intp)
        after = own + (g & 15)
        at = []
        if not flat:
            top = len(g) - 1
            for c in rest:
                np.minimum(after, top, out=after)
                at.append(after)
                e = c.table[window[after] & np.uint32((1 << c.bits) - 1)]
                after = after + (e & 15)
        special = g >= 256 << 4
        nxt = np.where(special | (after >= len(g)), own, after)
        two = nxt.take(nxt, mode="clip")
        four = two.take(two, mode="clip")
        jumps, is_special, p = memoryview(four.take(four, mode="clip")), memoryview(special), bits.pos - base * 8
        while n < total and p < size:
            chain, room = [], total - n
            q = p
            for _ in range(-(-room // 8)):
                if q >= size:
                    break
                chain.append(q)
                r = jumps[q]
                if r == q:
                    break
                q = r
            c = np.array(chain, np.intp)
            c = np.stack([c, four[c]], axis=1).ravel()
            c = np.stack([c, two[c]], axis=1).ravel()
            places = np.stack([c, nxt[c]], axis=1).ravel()
            places = places[~special[places] & (places < size)][:room]
            if len(places):
                px = (g[places] >> 4).astype(np.uint32) << 8
                if flat:
                    px |= fixed
                else:
                    for where, code, shift in zip(at, rest, (16, 0, 24), strict=True):
                        w = where[places]
                        px |= (code.table[window[w] & np.uint32((1 << code.bits) - 1)] >> 4).astype(np.uint32) << np.uint32(shift)
                out[n : n + len(places)] = px
                n += len(places)
                p = int(after[places[-1]])
            if n < total and p < size and is_special[p]:
                bits.pos = base * 8 + p
                symbol = green.read(bits)
                length = _value(bits, symbol - 256)
                n = _copy(out, n, length, _distance(_value(bits, far.read(bits)), width))
                p = bits.pos - base * 8
            elif not len(places):
                break
        bits.pos = base * 8 + p
        if bits.pos == begun and n < total:
            raise ValueError("no progress")
        if bits.pos > len(data) * 8:
            raise ValueError("data ends early")
    return out


def _pixels(bits: Bits, groups: list[list[Code]], width: int, height: int, cache_bits: int, meta: np.ndarray | None, meta_bits: int) -> np.ndarray:
    total = width * height
    if len(groups) == 1 and not cache_bits:
        return _pixels_fast(bits, groups[0], width, total)
    out, n = np.empty(total, np.uint32), 0
    cache, shift, kept = [0] * (1 << cache_bits), 32 - cache_bits, 0
    across = -(-width >> meta_bits) if meta is not None else 0
    while n < total:
        group = groups[int(meta[(n // width >> meta_bits) * across + (n % width >> meta_bits)])] if meta is not None else groups[0]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (c.read(bits) for c in group[1:4])
            out[n] = alpha << 24 | red << 16 | s << 8 | blue
            n += 1
        elif s < 280:
            length = _value(bits, s - 256)
            n = _copy(out, n, length, _distance(_value(bits, group[4].read(bits)), width))
        else:
            out[n] = cache[s - 280]
            n += 1
        if cache_bits:
            for px in out[kept:n].tolist():
                cache[(px * CACHE_MULT & 0xFFFFFFFF) >> shift] = px
            kept = n
        if bits.pos > len(bits.data) * 8 + 64:
            raise ValueError("data ends early")
    return out


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, meta_bits, count = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = _image(bits, -(-width >> meta_bits), -(-height >> meta_bits), False) >> np.uint32(8) & np.uint32(0xFFFF)
        count = int(meta.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_read_code(bits, s) for s in sizes] for _ in range(count)]
    return _pixels(bits, groups, width, height, cache_bits, meta, meta_bits)


# ---------------------------------------------------------------- transforms


def _channels(px: np.ndarray) -> np.ndarray:
    """(..., 4) of int64: alpha, red, green, blue."""
    return np.stack([px >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predicted(mode: int, left, top, right, corner) -> np.ndarray:
    """The prediction from the pixels left, above, above right and above left, by channel."""
    half = lambda a, b: (a + b) // 2
    if mode == 11:
        p = left + top - corner
        return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = half(left, top)
        d = a - corner
        return np.clip(a + np.sign(d) * (np.abs(d) // 2), 0, 255)
    ways = {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: half(half(left, right), top), 6: lambda: half(left, corner),
        7: lambda: half(left, top), 8: lambda: half(corner, top), 9: lambda: half(top, right), 10: lambda: half(half(left, corner), half(top, right)),
    }
    return ways[mode]() if mode in ways else np.array([255, 0, 0, 0])


def _one_way(px: np.ndarray, width: int, axis: int, sign: int) -> np.ndarray:
    """All pixels predicted by the one above (axis 0) or to the left (axis 1), as sums along that axis; borders as always. Bytes wrap."""
    c = np.ascontiguousarray(px, "<u4").view(np.uint8).reshape(-1, width, 4)  # alpha comes last
    if sign < 0:
        out = _differences(c, axis)
        out[0, 0, 3:] -= np.uint8(255)
    else:
        c = c.copy()
        c[0, 0, 3:] += np.uint8(255)
        edge = c[0] if axis == 0 else c[:, 0]
        edge[:] = np.cumsum(edge, axis=0, dtype=np.uint8)
        out = np.cumsum(c, axis=axis, dtype=np.uint8)
    return out.reshape(-1).view("<u4").astype(np.uint32, copy=False)


def _predictor(px: np.ndarray, width: int, modes: np.ndarray, size_bits: int, sign: int) -> np.ndarray:
    """sign 1 adds the predictions to residuals; -1 takes them from pixels."""
    kinds = modes >> np.uint32(8) & np.uint32(15)
    if kinds[0] in (1, 2) and (kinds == kinds[0]).all():
        return _one_way(px, width, 1 if kinds[0] == 1 else 0, sign)
    c = _channels(px)
    out = c.copy()
    seen = out if sign > 0 else c  # pixels as they are, which predictions look at
    across = -(-width >> size_bits)
    for i in range(len(px)):
        y, x = divmod(i, width)
        if y == 0:
            p = seen[i - 1] if x else np.array([255, 0, 0, 0])
        elif x == 0:
            p = seen[i - width]
        else:
            p = _predicted(int(kinds[(y >> size_bits) * across + (x >> size_bits)]), seen[i - 1], seen[i - width], seen[i - width + 1], seen[i - width - 1])
        out[i] = (c[i] + sign * p) & 255
    return _joined(out)


def _cross(px: np.ndarray, width: int, factors: np.ndarray, size_bits: int, sign: int) -> np.ndarray:
    i = np.arange(len(px))
    f = _channels(factors)[(i // width >> size_bits) * -(-width >> size_bits) + (i % width >> size_bits)]
    signed = lambda v: ((v & 255) ^ 128) - 128
    delta = lambda t, c: signed(t) * signed(c) >> 5
    c = _channels(px)
    red = c[:, 1] + sign * delta(f[:, 3], c[:, 2])
    by = red if sign > 0 else c[:, 1]
    c[:, 3] += sign * (delta(f[:, 2], c[:, 2]) + delta(f[:, 1], by))
    c[:, 1] = red
    return _joined(c)


def _green(px: np.ndarray, sign: int) -> np.ndarray:
    g = px >> np.uint32(8) & np.uint32(255)
    if sign > 0 and not (px & np.uint32(0xFF00FF)).any():  # grey
        return px & np.uint32(BLACK) | g * np.uint32(0x10101)
    red, blue = (px >> np.uint32(16)) + (g if sign > 0 else np.uint32(256) - g), px + (g if sign > 0 else np.uint32(256) - g)
    return px & np.uint32(0xFF00FF00) | (red & np.uint32(255)) << np.uint32(16) | blue & np.uint32(255)


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _packed(index: np.ndarray, width: int, colours: int) -> np.ndarray:
    """Places in a palette, as many to a pixel as fit into eight bits."""
    k = _pack_bits(colours)
    full = -(-width >> k)
    rows = np.pad(index.reshape(-1, width), ((0, 0), (0, (full << k) - width))).reshape(-1, full, 1 << k)
    return (rows << (np.arange(1 << k, dtype=np.uint32) * (8 >> k))).sum(axis=2, dtype=np.uint32).ravel()


def _coloured(px: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    k = _pack_bits(len(table))
    index = (px >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
    if k:
        each = 8 >> k
        index = (index[:, :, None] >> (np.arange(1 << k, dtype=np.uint32) * each) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index].ravel()


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and ARGB pixels, row by row, of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image")
        at += 8 + (n := struct.unpack("<I", data[at + 4 : at + 8])[0]) + (n & 1)
    size = struct.unpack("<I", data[at + 4 : at + 8])[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("bad signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    across, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            k = bits.read(3) + 2
            undo.append((kind, across, k, _image(bits, -(-across >> k), -(-height >> k), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            deltas = _channels(_image(bits, n, 1, False))
            undo.append((kind, across, 0, _joined(np.cumsum(deltas, axis=0))))
            across = -(-across >> _pack_bits(n))
        else:
            undo.append((kind, across, 0, None))
    px = _image(bits, across, height, True)
    for kind, across, k, extra in reversed(undo):
        if kind == PREDICTOR:
            px = _predictor(px, across, extra, k, 1)
        elif kind == CROSS_COLOUR:
            px = _cross(px, across, extra, k, 1)
        elif kind == SUBTRACT_GREEN:
            px = _green(px, 1)
        else:
            px = _coloured(px, across, height, extra)
    return width, height, px


# ---------------------------------------------------------------- encoder


def _code_lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """Lengths of a Huffman code of at most ``most`` bits; rare symbols are raised until it fits."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    floor, total = 0, sum(counts.values())
    while True:
        # leaves by weight, then the nodes over them, which come by weight of themselves: the least two are always at the front of either
        leaves = sorted((max(c, floor), s) for s, c in counts.items())
        n = len(leaves)
        weight, above = [c for c, _ in leaves], [0] * (2 * n - 1)
        leaf, node = 0, n
        for new in range(n, 2 * n - 1):
            both = 0
            for _ in range(2):
                if leaf < n and (node == new or weight[leaf] <= weight[node]):
                    least, leaf = leaf, leaf + 1
                else:
                    least, node = node, node + 1
                both += weight[least]
                above[least] = new
            weight.append(both)
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[above[i]] + 1
        if max(depth[:n]) <= most:
            return {s: d for (_, s), d in zip(leaves, depth, strict=False)}
        floor = max(floor * 2, total >> most, 1)


def _codewords(lengths: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit-reversed canonical codes and their lengths, for a table of ``size`` symbols."""
    codes, lens = np.zeros(size, np.int64), np.zeros(size, np.int64)
    if len(lengths) > 1:
        used, own = np.array(list(lengths)), np.array(list(lengths.values()))
        lens[used] = own
        order = np.lexsort((used, own))
        most = int(own[order[-1]])
        room = 1 << (most - own[order])
        codes[used[order]] = _reversed_bits(most)[np.cumsum(room) - room]
    return codes, lens


class Writer:
    def __init__(self) -> None:
        self.value, self.size, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def put_many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Values of up to 63 bits, one after another."""
        whole, head = divmod(self.size, 8)
        self.parts.append((self.value & ((1 << whole * 8) - 1)).to_bytes(whole, "little"))
        end = np.cumsum(sizes) + head
        begin, total = end - sizes, int(end[-1]) if len(end) else head
        words = np.zeros((total >> 6) + 2, np.uint64)
        if len(end):
            word, shift, values = begin >> 6, (begin & 63).astype(np.uint64), values.astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] = np.add.reduceat(values << shift, first)  # no two have a bit in common
            over = np.flatnonzero((end - 1) >> 6 > word)  # one at most reaches into a word from the one before
            words[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        words[0] |= np.uint64(self.value >> whole * 8)
        data = words.tobytes()
        self.parts.append(data[: total >> 3])
        self.value, self.size = data[total >> 3] & ((1 << (total & 7)) - 1), total & 7

    def data(self) -> bytes:
        return b"".join(self.parts) + self.value.to_bytes(-(-self.size // 8), "little")


def _write_code(w: Writer, counts: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    used = sorted(counts) or [0]
    if len(used) <= 2 and used[-1] < 256:
        wide = used[0] > 1
        w.put(1 | (len(used) - 1) << 1 | wide << 2, 3)
        w.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return _codewords(dict.fromkeys(used, 1), size)
    lengths = _code_lengths(counts, 12)
    tokens = []
    row = np.zeros(used[-1] + 1, np.int64)
    row[list(lengths)] = list(lengths.values())
    edges = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
    for i, n in enumerate(row[edges[:-1]].tolist()):
        run = edges[i + 1] - edges[i]
        if n:
            tokens.append((n, 0, 0))
            run -= 1
            while run >= 3:
                take = min(run, 6)
                tokens.append((16, take - 3, 2))
                run -= take
        else:
            while run >= 3:
                take = min(run, 138)
                tokens.append((18, take - 11, 7) if take >= 11 else (17, take - 3, 3))
                run -= take
        tokens += [(n, 0, 0)] * run
    seen: dict[int, int] = {}
    for t, _, _ in tokens:
        seen[t] = seen.get(t, 0) + 1
    own = _code_lengths(seen, 7)
    n = max(i for i, s in enumerate(LENGTH_ORDER) if s in own) + 1
    w.put(0, 1)
    w.put(max(n, 4) - 4, 4)
    for s in LENGTH_ORDER[: max(n, 4)]:
        w.put(own.get(s, 0), 3)
    count = max(2, len(tokens))
    if count < size and (len(tokens) >= 2 or size == 2):
        k = max(0, ((count - 2).bit_length() - 1) // 2)
        w.put(1 | k << 1, 4)
        w.put(count - 2, 2 + 2 * k)
    else:
        w.put(0, 1)
    codes, lens = _codewords(own, 19)
    for t, extra, bits in tokens:
        w.put(int(codes[t]) | extra << int(lens[t]), int(lens[t]) + bits)
    return _codewords(lengths, size)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix code, extra bits and their number for a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    return 2 * top + (v >> (top - 1) & 1), v & ((1 << (top - 1)) - 1), top - 1


@lru_cache(maxsize=64)
def _near(width: int) -> dict[int, int]:
    """Short codes of distances."""
    return {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}


def _tokens(px: np.ndarray, width: int, cache_bits: int, copies: Sequence[tuple[int, int, int]]):
    """Green symbols; places of copies with length and distance symbols and their extra bits; and whether a pixel is spelt out."""
    lit = np.ones(len(px), bool)
    for at, length, _ in copies:
        lit[at : at + length] = False
    symbols = (px >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if cache_bits:
        cache: dict[int, int] = {}
        for i, p in enumerate(px.tolist()):
            k = (p * CACHE_MULT & 0xFFFFFFFF) >> (32 - cache_bits)
            if lit[i] and cache.get(k) == p:
                symbols[i] = 280 + k
            cache[k] = p
    near = _near(width)
    return symbols, [(at, *_prefix(length), *_prefix(near.get(dist, dist + len(NEAR)))) for at, length, dist in copies], lit


def _write_image(w: Writer, px: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: Sequence[tuple[int, int, int]] = ()) -> None:
    w.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        w.put(0, 1)
    symbols, backs, lit = _tokens(px, width, cache_bits, copies)
    size = 280 + (1 << cache_bits if cache_bits else 0)
    where = np.flatnonzero(lit)
    counted = np.bincount(symbols[where], minlength=size)
    for b in backs:
        counted[256 + b[1]] += 1
    spelt = where[symbols[where] < 256]
    alike = not ((px ^ px[0]) & ~np.uint32(0xFF00)).any()  # only green differs
    others = [np.array([px[0] >> np.uint32(s) & np.uint32(255)], np.int64) if alike else (px >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (16, 0, 24)]
    of = lambda a: dict(zip((i := np.flatnonzero(a)).tolist(), a[i].tolist(), strict=True))
    far: dict[int, int] = {}
    for b in backs:
        far[b[4]] = far.get(b[4], 0) + 1
    codes = [_write_code(w, of(counted), size)]
    codes += [_write_code(w, {int(c[0]): len(spelt)} if alike and len(spelt) else of(np.bincount(c[spelt], minlength=256)), 256) for c in others]
    codes.append(_write_code(w, far, 40))
    value, n = codes[0][0][symbols], codes[0][1][symbols]
    for c, (code, lens) in zip(others, codes[1:4], strict=True):
        if lens.any():
            full = symbols < 256
            value = np.where(full, value | code[c] << n, value)
            n = np.where(full, n + lens[c], n)
    if backs:  # a copy stands at its first pixel
        at, g, extra, bits, d, d_extra, d_bits = np.array(backs, np.int64).T
        k = codes[0][1][256 + g]
        v, k = codes[0][0][256 + g] | extra << k, k + bits
        v, k = v | codes[4][0][d] << k, k + codes[4][1][d]
        value[at], n[at], lit[at] = v | d_extra << k, k + d_bits, True
        where = np.flatnonzero(lit)
    w.put_many(value[where], n[where])


def matches(px: np.ndarray, least: int = 24) -> list[tuple[int, int, int]]:
    """Back-references (place, length, distance): stretches of ``least`` pixels or more that stood before.

    Short runs of pixels are exact 64-bit keys; sorted with their places, equal keys stand side by side, so each place knows the nearest one
    before it with the same run. Neighbouring places with one distance are one stretch. Stretches are taken from left to right, without overlaps.
    """
    if ((px ^ px[0]) & ~np.uint32(0xFF00)).any():
        colours, symbols = np.unique(px, return_inverse=True)
        symbols = symbols.astype(np.uint8 if len(colours) <= 1 << 8 else np.uint16 if len(colours) <= 1 << 16 else np.uint32)
    else:  # only green differs
        symbols = (px >> np.uint32(8)).astype(np.uint8)
    each = 8 // symbols.itemsize
    n = len(px) - each + 1
    if n < 2:
        return []
    # windows of eight bytes at every place, read as numbers: one view for each phase
    keys = np.empty(n, np.uint64)
    for i in range(min(each, n)):
        keys[i::each] = symbols[i : i + (n - i + each - 1) // each * each].view(np.uint64)
    width = np.uint64(n.bit_length())
    placed = keys * np.uint64(SPREAD) >> width << width | np.arange(n, dtype=np.uint64)
    placed.sort()
    order = (placed & np.uint64((1 << int(width)) - 1)).astype(np.int64)
    step = np.diff(order)
    back, keys = np.zeros(n, np.int64), keys[order]
    back[order[1:]] = np.where((keys[1:] == keys[:-1]) & (step <= FARTHEST), step, 0)
    edge = np.flatnonzero(np.diff(back)) + 1
    begin, end = np.append(0, edge), np.append(edge, n) + each - 1
    found = np.flatnonzero((back[begin] > 0) & (end - begin >= least))
    out, done = [], 0
    for at, stop, dist in zip(begin[found].tolist(), end[found].tolist(), back[begin[found]].tolist(), strict=True):
        at = max(at, done)
        if stop - at >= least:
            out += [(i, min(4096, stop - i), dist) for i in range(at, stop, 4096)]
            done = stop
    return out


def _entropy(channel: np.ndarray) -> float:
    """Bits of an ideal prefix code of these bytes."""
    counts = np.bincount(channel.ravel())
    counts = counts[counts > 0]
    return float(channel.size * np.log2(channel.size) - counts @ np.log2(counts))


def _differences(c: np.ndarray, axis: int) -> np.ndarray:
    """Each value less the one above (axis 0) or to the left (axis 1); the first row or column by the other axis, the first value as it is."""
    out = c.copy()
    if axis:
        out[:, 1:] -= c[:, :-1]
        out[1:, 0] -= c[:-1, 0]
    else:
        out[1:] -= c[:-1]
        out[0, 1:] -= c[0, :-1]
    return out


def chosen(px: np.ndarray, width: int) -> tuple[list[tuple], int]:
    """Transforms and bits of the colour cache by which the image is likely to take the fewest bits.

    Estimates are entropies of the channels as they are, less green, and less the pixel to the left or above; a palette adds its colours.
    More than 256 colours, but no more than 1,024, that differ in several channels get a colour cache.
    """
    height = len(px) // width
    blocks = np.full(-(-width >> 9) * -(-height >> 9), BLACK, np.uint32)
    left, top = ([(PREDICTOR, 9, blocks | np.uint32(mode << 8)), (SUBTRACT_GREEN,)] for mode in (1, 2))
    channel = lambda s: (px >> np.uint32(s)).astype(np.uint8).reshape(height, width)
    bits = lambda planes: sum(_entropy(c) for c in planes)
    green = channel(8)
    grey = not (((px >> np.uint32(8) ^ px) & np.uint32(0xFFFF)).any() or (px >> np.uint32(24) != px[0] >> np.uint32(24)).any())
    varied = [green] if grey else [green, channel(16) - green, channel(0) - green, channel(24)]
    ways = [(bits(varied), [(SUBTRACT_GREEN,)])]
    ways += [(128 + bits(_differences(c, axis) for c in varied), way) for axis, way in ((1, left), (0, top))]
    if grey:
        colours = np.flatnonzero(np.bincount(green.ravel())).astype(np.uint32) * np.uint32(0x10101) | px[0] & np.uint32(BLACK)
    else:
        ways.append((bits(channel(s) for s in (8, 16, 0, 24)), []))
        colours = np.unique(px)
    if len(colours) <= (16 if grey else 256):
        index = np.searchsorted(colours, px).astype(np.uint32)
        ways.append((16 * len(colours) + bits([_packed(index, width, len(colours)).astype(np.uint8)]), [(PALETTE, colours)]))
    cache = (len(colours) - 1).bit_length() if 256 < len(colours) <= 1024 else 0
    return ([], cache) if cache else (min(ways, key=lambda w: w[0])[1], 0)


def smallest(px: np.ndarray, width: int) -> bytes:
    """A lossless WebP file of ARGB pixels by the transforms that ``chosen`` takes, with the back-references that ``matches`` finds."""
    transforms, cache = chosen(px, width)
    return encode(px, width, transforms, cache)


def encode(px: np.ndarray, width: int, transforms: Sequence[tuple] = (), cache_bits: int = 0, copies: Sequence[tuple[int, int, int]] | None = None) -> bytes:
    """A lossless WebP file of ARGB pixels.

    ``transforms``, in the order of the stream: (SUBTRACT_GREEN,), (PREDICTOR, size_bits, modes), (CROSS_COLOUR, size_bits,
    factors) or (PALETTE, colours); ``copies``: back-references (place, length, distance) over the transformed pixels; None
    takes those that ``matches`` finds.
    """
    height = len(px) // width
    if not 1 <= width <= MAX_SIDE or not 1 <= height <= MAX_SIDE or width * height != len(px):
        raise ValueError("bad size")
    w = Writer()
    w.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    across = width
    for kind, *args in transforms:
        w.put(1 | kind << 1, 3)
        if kind == SUBTRACT_GREEN:
            px = _green(px, -1)
        elif kind == PALETTE:
            table = np.asarray(args[0], np.uint32)
            w.put(len(table) - 1, 8)
            c = _channels(table)
            _write_image(w, _joined(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64))), len(table), False)
            place = {int(v): i for i, v in enumerate(table)}
            index = _packed(np.array([place[p] for p in px.tolist()], np.uint32), across, len(table))
            px = index << np.uint32(8) | np.uint32(BLACK)
            across = -(-across >> _pack_bits(len(table)))
        else:
            k, block = args[0], np.asarray(args[1], np.uint32)
            w.put(k - 2, 3)
            _write_image(w, block, -(-across >> k), False)
            px = _predictor(px, across, block, k, -1) if kind == PREDICTOR else _cross(px, across, block, k, -1)
    w.put(0, 1)
    _write_image(w, px, across, True, cache_bits, matches(px) if copies is None else copies)
    body = w.data()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
