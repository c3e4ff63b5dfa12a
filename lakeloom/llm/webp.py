"""Lossless WebP (VP8L) in numpy and plain Python: a decoder of the whole format and an encoder.

The decoder reads prefix codes, back-references, the colour cache and meta prefix codes, and inverts the predictor,
cross-colour, subtract-green and palette transforms. The encoder writes every feature of the format, and chooses by size
between a palette, back-references with a cache, and prefix codes alone. Streams of the last kind are decoded many at a
time: each is cut into stretches of bits that are read side by side. A stretch is first entered at a guessed place. Prefix
codes soon fall into step, so where one stretch ends tells where the next begins, and those that were entered wrongly are
read again until all fit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np

SIGNATURE = 0x2F
#: Fixed values of the format: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
GREENS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_HASH = 0x1E35A7BD
PREDICTOR, CROSS, SUBTRACT, PALETTE = range(4)
#: Near pixels that the 120 short distance codes name: by distance, then by |x|, the right one first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Bits:
    """Reads bits, the lowest of each byte first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def between(self, at: int, n: int) -> int:
        """The n bits from a place on."""
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        return self.between(self.at, n)

    def read_over(self, n: int) -> None:
        self.at += n

    def read(self, n: int) -> int:
        first = self.at >> 3
        got = int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream is too short")
        return got & ((1 << n) - 1)


class Out:
    """Writes bits, the lowest of each byte first."""

    def __init__(self):
        self.done, self.value, self.held = bytearray(), 0, 0

    @property
    def n(self) -> int:
        return 8 * len(self.done) + self.held

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.held
        self.held += n
        if self.held > 2048:  # so that no number grows long
            whole = self.held >> 3
            self.done += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.held &= 7

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes(-(-self.held // 8), "little")


class Code:
    """A canonical prefix code; read by a table of the bits that follow."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None if used else 0
        self.most = max(lengths) if self.only is None else 0
        if self.only is None and sum(1 << (15 - lengths[s]) for s in used) != 1 << 15:
            raise ValueError("the prefix code is not complete")
        self._table: list[int] | None = None

    def codes(self) -> dict[int, int]:
        code, last, out = 0, 0, {}
        for n, s in sorted((n, s) for s, n in enumerate(self.lengths) if n):
            code <<= n - last
            out[s], last = code, n
            code += 1
        return out

    def table(self, bits: int) -> np.ndarray:
        """For the next ``bits`` bits, the lowest first: symbol and length, as symbol << 4 | length."""
        n = np.array(self.lengths)
        order = np.lexsort((np.arange(len(n)), n))
        order = order[n[order] > 0]
        return np.repeat((order << 4 | n[order]).astype(np.uint16), 1 << (bits - n[order]))[_reversed(bits)]

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self._table is None:
            self._table = self.table(self.most).tolist()
        first = bits.at >> 3
        found = self._table[int.from_bytes(bits.data[first : first + 4], "little") >> (bits.at & 7) & ((1 << self.most) - 1)]
        bits.at += found & 15
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream is too short")
        return found >> 4


@cache
def _backwards(bits: int) -> list[int]:
    return _reversed(bits).tolist()


@cache
def _reversed(bits: int) -> np.ndarray:
    """All numbers of so many bits with their bits in the other order."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = [0] * len(LENGTH_ORDER)
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    of, before, at = Code(own), 8, 0
    while at < size and most:
        most -= 1
        s = of.read(bits)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        value, count = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + count > size:
            raise ValueError("too many code lengths")
        lengths[at : at + count] = [value] * count
        at += count
    return Code(lengths)


def read_value(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


@dataclass
class Body:
    """What precedes the pixels of an entropy-coded image: its cache, and its codes by block or one group of them."""

    cache_bits: int
    meta: list[int] | None
    shift: int
    codes: list[list[Code]]

    def alike(self) -> bool:
        """Pixels only, all four channels by one code of a few bits."""
        first = self.codes[0][0]
        return len(self.codes) == 1 and not self.cache_bits and first.only is None and first.most <= WINDOW and not any(first.lengths[GREENS:]) and all(c.lengths[:GREENS] == first.lengths[:GREENS] for c in self.codes[0][1:4])


def read_body(bits: Bits, width: int, height: int, main: bool) -> Body:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits and not 1 <= cache_bits <= 11:
        raise ValueError("no such colour cache")
    meta, shift = None, 0
    groups = 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        meta = (read_pixels(bits, (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False) >> 8 & 0xFFFF).tolist()
        groups = max(meta) + 1
    sizes = (GREENS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    return Body(cache_bits, meta, shift, [_group(bits, sizes) for _ in range(groups)])


def _group(bits: Bits, sizes: tuple[int, ...]) -> list[Code]:
    """Five codes; one that is written like the code before it, bit by bit, isn't taken apart again."""
    out: list[Code] = []
    written, n = -1, 0
    for size in sizes:
        if out and size < DISTANCES + 256 and size > DISTANCES and not any(out[-1].lengths[size:]) and bits.peek(n) == written:
            bits.read_over(n)
            out.append(out[-1] if len(out[-1].lengths) == size else Code(out[-1].lengths[:size]))
            continue
        start = bits.at
        out.append(read_code(bits, size))
        n = bits.at - start
        written = bits.between(start, n)
    return out


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values (uint32) of an entropy-coded image, row by row."""
    return read_rest(bits, width, height, read_body(bits, width, height, main))


def read_rest(bits: Bits, width: int, height: int, body: Body) -> np.ndarray:
    cache_bits, meta, shift, codes = body.cache_bits, body.meta, body.shift, body.codes
    total = width * height
    out, at = [0] * total, 0
    cache = [0] * (1 << cache_bits)
    across = (width + (1 << shift) - 1) >> shift

    def keep(argb: int) -> None:
        if cache_bits:
            cache[(CACHE_HASH * argb & 0xFFFFFFFF) >> (32 - cache_bits)] = argb

    while at < total:
        g = codes[meta[(at // width >> shift) * across + (at % width >> shift)] if meta else 0]
        s = g[0].read(bits)
        if s < GREENS:
            red, blue, alpha = (c.read(bits) for c in g[1:4])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            keep(out[at])
            at += 1
        elif s < GREENS + LENGTHS:
            length = read_value(bits, s - GREENS)
            d = read_value(bits, g[4].read(bits))
            if d <= len(NEAR):
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            else:
                d -= len(NEAR)
            if d > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + length):
                out[i] = out[i - d]
                keep(out[i])
            at += length
        else:
            out[at] = cache[s - GREENS - LENGTHS]
            keep(out[at])
            at += 1
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4)


def _signed(v: np.ndarray | int) -> np.ndarray | int:
    return v - ((v & 0x80) << 1)


def _average(a: list[int], b: list[int]) -> list[int]:
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def predict(mode: int, left: list[int], top: list[int], corner: list[int], right: list[int]) -> list[int]:
    """The predicted channels of a pixel from its neighbours (corner: top left, right: top right)."""
    if mode == 0:
        return [0, 0, 0, 255]
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7):
        return _average(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return _average(top, corner if mode == 8 else right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:  # the neighbour that is nearer to left + top - corner, summed over the channels
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    clip = lambda v: min(255, max(0, v))
    if mode == 12:
        return [clip(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        half = _average(left, top)
        return [clip(h + int((h - c) / 2)) for h, c in zip(half, corner, strict=True)]
    return [0, 0, 0, 255]


def _predicted(argb: np.ndarray, width: int, height: int, block_bits: int, modes: np.ndarray, inverse: bool) -> np.ndarray:
    """The predictor transform. inverse: residuals to pixels."""
    px = _channels(argb.reshape(height, width)).astype(int).tolist()
    across = (width + (1 << block_bits) - 1) >> block_bits
    kind = (modes >> 8 & 0xFF).tolist()
    done: list[list[list[int]]] = []
    out = []
    for y in range(height):
        row: list[list[int]] = []
        res = []
        done.append(row)
        for x in range(width):
            if y == 0:
                p = [0, 0, 0, 255] if x == 0 else row[x - 1]
            elif x == 0:
                p = done[y - 1][0]
            else:
                above = done[y - 1]
                mode = kind[(y >> block_bits) * across + (x >> block_bits)] & 15
                p = predict(mode, row[x - 1], above[x], above[x - 1], above[x + 1] if x + 1 < width else row[0])
            v = px[y][x]
            if inverse:
                row.append([(a + b) & 255 for a, b in zip(v, p, strict=True)])
            else:
                row.append(v)
                res.append([(a - b) & 255 for a, b in zip(v, p, strict=True)])
        out.append(row if inverse else res)
    return np.array(out, np.uint8).reshape(-1, 4).view("<u4").reshape(-1)


def _cross(argb: np.ndarray, width: int, height: int, block_bits: int, elements: np.ndarray, inverse: bool) -> np.ndarray:
    """The cross-colour transform with an element (green to red, green to blue, red to blue) for each block."""
    c = _channels(argb).astype(np.int32)
    across = (width + (1 << block_bits) - 1) >> block_bits
    at = np.arange(len(argb))
    e = _channels(elements).astype(np.int32)[(at // width >> block_bits) * across + (at % width >> block_bits)]
    step = lambda t, v: (_signed(t) * _signed(v)) >> 5
    sign = 1 if inverse else -1
    blue, green, red = c[:, 0], c[:, 1], c[:, 2]
    new_red = (red + sign * step(e[:, 0], green)) & 255
    by = new_red if inverse else red
    new_blue = (blue + sign * (step(e[:, 1], green) + step(e[:, 2], by))) & 255
    return np.stack([new_blue, green, new_red, c[:, 3]], 1).astype(np.uint8).view("<u4").reshape(-1)


def _green(argb: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(argb).copy()
    for k in (0, 2):
        c[:, k] = c[:, k] + c[:, 1] if sign > 0 else c[:, k] - c[:, 1]
    return c.view("<u4").reshape(-1)


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


@dataclass
class Opened:
    """An image before its pixels are read."""

    bits: Bits
    width: int
    height: int
    inner: int
    transforms: list[tuple]
    body: Body

    def finished(self, argb: np.ndarray) -> np.ndarray:
        """Pixels from the coded values: the transforms inverted, the last one first."""
        for t in reversed(self.transforms):
            if t[0] == PREDICTOR:
                argb = _predicted(argb, t[1], self.height, t[2], t[3], True)
            elif t[0] == CROSS:
                argb = _cross(argb, t[1], self.height, t[2], t[3], True)
            elif t[0] == SUBTRACT:
                argb = _green(argb, 1)
            else:
                index = argb >> 8 & 255
                if t[2]:
                    n = 8 >> t[2]
                    parts = index.reshape(self.height, -1)[:, :, None] >> (np.arange(1 << t[2]) * n) & ((1 << n) - 1)
                    index = parts.reshape(self.height, -1)[:, : t[1]].reshape(-1)
                argb = np.concatenate([t[3], np.zeros(256, np.uint32)])[index]
        return _channels(argb).reshape(self.height, self.width, 4)


def opened(data: bytes) -> Opened:
    if data[:4] == b"RIFF":
        if data[8:12] != b"WEBP" or data[12:16] != b"VP8L":
            raise ValueError("no lossless WebP file")
        data = data[20 : 20 + int.from_bytes(data[16:20], "little")]
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("no VP8L stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms: list[tuple] = []
    inner = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (t[0] for t in transforms):
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS):
            b = bits.read(3) + 2
            transforms.append((kind, inner, b, read_pixels(bits, (inner + (1 << b) - 1) >> b, (height + (1 << b) - 1) >> b, False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(read_pixels(bits, n, 1, False)), axis=0, dtype=np.uint8).view("<u4").reshape(-1)
            transforms.append((kind, inner, _pack_bits(n), table))
            inner = (inner + (1 << _pack_bits(n)) - 1) >> _pack_bits(n)
        else:
            transforms.append((kind, inner))
    return Opened(bits, width, height, inner, transforms, read_body(bits, inner, height, True))


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4: blue, green, red, alpha) of a WebP file or a bare VP8L stream, read one symbol after the other."""
    o = opened(data)
    return o.finished(read_rest(o.bits, o.inner, o.height, o.body))


#: Bits of the table by which stretches are read, bits of a stretch, steps after which finished stretches are put aside.
WINDOW, STRETCH, STEPS = 12, 1020, 32


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The same pixels as decode(), for many files: streams of one plain code are read side by side."""
    images = [opened(f) for f in files]
    side = [i for i, o in enumerate(images) if o.body.alike()]
    found: dict[int, np.ndarray] = {}
    if side:
        streams = [(images[i].bits.data, images[i].bits.at, 4 * images[i].inner * images[i].height, images[i].body.codes[0][0]) for i in side]
        for i, symbols in zip(side, read_side_by_side(streams), strict=True):
            found[i] = _channels_to_argb(symbols)
    return [o.finished(found[i] if i in found else read_rest(o.bits, o.inner, o.height, o.body)) for i, o in enumerate(images)]


def _channels_to_argb(symbols: np.ndarray) -> np.ndarray:
    """Green, red, blue, alpha as they are written, to values."""
    return np.ascontiguousarray(symbols.reshape(-1, 4)[:, [2, 0, 1, 3]]).view("<u4").reshape(-1).astype(np.uint32)


def read_side_by_side(streams: list[tuple[bytes, int, int, Code]]) -> list[np.ndarray]:
    """The first symbols of streams (data, first bit, how many symbols, code)."""
    sizes = np.array([len(d) for d, *_ in streams], np.int64)
    base = (np.cumsum(sizes) - sizes) * 8
    raw = np.frombuffer(b"".join(d for d, *_ in streams) + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    tables = np.concatenate([c.table(WINDOW) for *_, c in streams])
    first, end = base + np.array([at for _, at, *_ in streams]), base + sizes * 8
    # Codes whose lengths have a common divisor never fall into step from another remainder, so stretches keep it.
    divisor = np.array([math.gcd(*(n for n in c.lengths if n)) for *_, c in streams])
    stretch = STRETCH // divisor * divisor
    count = np.maximum(1, -(-(end - first) // stretch))
    owner = np.repeat(np.arange(len(streams)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    entry = first[owner] + number * stretch[owner]
    stop = np.minimum(entry + stretch[owner], end[owner])
    out, got, leave = np.zeros((len(owner), STEPS), np.uint8), np.zeros(len(owner), np.int64), entry.copy()
    due = np.arange(len(owner))
    while len(due):
        at, alive, t = entry[due], due, 0
        got[due], leave[due] = 0, at
        while len(alive):
            if t + STEPS > out.shape[1]:
                out = np.concatenate([out, np.zeros_like(out)], axis=1)
            block = np.zeros((STEPS, len(alive)), np.uint8)
            steps, until, row = np.zeros(len(alive), np.int64), stop[alive], owner[alive] << WINDOW
            for k in range(STEPS):
                e = tables[row + (window[at >> 3] >> (at & 7).astype(np.uint32) & ((1 << WINDOW) - 1))]
                block[k] = e >> 4
                on = at < until
                at = at + (e & 15) * on
                steps += on
            out[alive, t : t + STEPS] = block.T
            got[alive] += steps
            leave[alive] = at
            on = at < until
            at, alive, t = at[on], alive[on], t + STEPS
        true = np.concatenate([[0], leave[:-1]])
        true[number == 0] = first
        due = np.flatnonzero((true != entry) & (entry < end[owner]))
        entry[due] = true[due]
    total = np.bincount(owner, got, len(streams)).astype(np.int64)
    flat = out[:, : max(1, int(got.max()))][np.arange(max(1, int(got.max())))[None, :] < got[:, None]]
    starts = np.cumsum(total) - total
    result = []
    for (_, _, n, _), a, have in zip(streams, starts.tolist(), total.tolist(), strict=True):
        if have < n:
            raise ValueError("the stream is too short")
        result.append(flat[a : a + n])
    return result


def _lengths(counts: list[int], most: int = 15) -> list[int]:
    """Lengths of a complete prefix code; counts are raised until none is longer than most."""
    used = [s for s, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) <= 1:
        for s in used:
            out[s] = 1
        return out
    n, floor = len(used), 1
    while True:
        leaves = sorted((max(counts[s], floor), s) for s in used)
        weight = [c for c, _ in leaves]  # leaves by weight, then the nodes made of two, which come in the order of weight too
        parent = [0] * (2 * n - 1)
        leaf, node = 0, n
        for made in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (node >= made or weight[leaf] <= weight[node]):
                    take, leaf = leaf, leaf + 1
                else:
                    take, node = node, node + 1
                total += weight[take]
                parent[take] = made
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:n]) <= most:
            for d, (_, s) in zip(depth, leaves, strict=False):
                out[s] = d
            return out
        floor *= 2


def _write_code(out: Out, lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Writes the code; symbol -> (bits in the order of writing, number)."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.write(1, 1)
        out.write(len(used) - 1, 1)
        out.write(int(used[0] > 1), 1)
        out.write(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.write(used[1], 8)
        return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
    out.write(*_code_bits(lengths))
    return _symbols(lengths)


def _symbols(lengths: list[int]) -> dict[int, tuple[int, int]]:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {used[0]: (0, 0)}
    out, code, last = {}, 0, 0
    for n, s in sorted((lengths[s], s) for s in used):
        code <<= n - last
        out[s], last = (_backwards(n)[code], n), n
        code += 1
    return out


def _value_prefix(v: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance."""
    if v <= 4:
        return v - 1, 0, 0
    n = (v - 1).bit_length() - 2
    return 2 * n + 2 + ((v - 1) >> n & 1), (v - 1) & ((1 << n) - 1), n


def _write_pixels(out: Out, argb: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = False) -> None:
    """An entropy-coded image with one group of codes."""
    tokens: list[tuple] = []
    cache: dict[int, int] = {}
    seen: dict[tuple[int, ...], int] = {}
    at = 0
    while at < len(argb):
        took, key = 1, tuple(argb[at : at + 4])
        back = seen.get(key) if references and len(key) == 4 else None
        slot = (CACHE_HASH * argb[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else -1
        if back is not None:
            while at + took < len(argb) and took < 4096 and argb[back + took] == argb[at + took]:
                took += 1
            d = at - back
            near = next((i + 1 for i, (x, y) in enumerate(NEAR) if max(1, x + y * width) == d), d + len(NEAR))
            tokens.append(("copy", _value_prefix(took), _value_prefix(near)))
        elif cache_bits and cache.get(slot) == argb[at]:
            tokens.append(("cache", slot))
        else:
            tokens.append(("pixel", argb[at]))
        for i in range(at, at + took):
            if references:
                seen[tuple(argb[i : i + 4])] = i
            if cache_bits:
                cache[(CACHE_HASH * argb[i] & 0xFFFFFFFF) >> (32 - cache_bits)] = argb[i]
        at += took
    sizes = (GREENS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    counts = [[0] * n for n in sizes]
    symbols = []
    for t in tokens:
        if t[0] == "pixel":
            p = t[1]
            s = [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]
        elif t[0] == "cache":
            s = [(0, GREENS + LENGTHS + t[1], 0, 0)]
        else:
            s = [(0, GREENS + t[1][0], *t[1][1:]), (4, *t[2])]
        symbols += s
        for k, v, *_ in s:
            counts[k][v] += 1
    if cache_bits:
        out.write(1, 1)
        out.write(cache_bits, 4)
    else:
        out.write(0, 1)
    if main:
        out.write(0, 1)
    codes = [_write_code(out, _lengths(c)) for c in counts]
    for k, v, extra, n in symbols:
        out.write(*codes[k][v])
        out.write(extra, n)


def _riff(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + bytes(len(stream) % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def _head(width: int, height: int) -> Out:
    if not (1 <= width <= 1 << 14 and 1 <= height <= 1 << 14):
        raise ValueError("an image has 1 to 16384 rows and columns")
    out = Out()
    for v, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.write(v, n)
    return out


def encode(pixels: np.ndarray, palette: bool = False, subtract: bool = False, cross: tuple[int, int, int] | None = None, predictor: int | None = None, block_bits: int = 2, cache_bits: int = 0, references: bool = False) -> bytes:
    """A WebP file of pixels (height, width, 4: blue, green, red, alpha) with the named features; prefix codes fit the image."""
    height, width = pixels.shape[:2]
    out = _head(width, height)
    argb = np.ascontiguousarray(pixels, np.uint8).reshape(-1, 4).view("<u4").reshape(-1)
    blocks = ((width + (1 << block_bits) - 1) >> block_bits) * ((height + (1 << block_bits) - 1) >> block_bits)
    inner = width
    if palette:
        table, index = np.unique(argb, return_inverse=True)
        if len(table) > 256:
            raise ValueError("a palette has 256 colours at most")
        for v, n in ((1, 1), (PALETTE, 2), (len(table) - 1, 8)):
            out.write(v, n)
        delta = np.diff(_channels(table), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
        _write_pixels(out, delta.view("<u4").reshape(-1).tolist(), len(table), False)
        pack = _pack_bits(len(table))
        inner = (width + (1 << pack) - 1) >> pack
        padded = np.zeros((height, inner << pack), np.uint32)
        padded[:, :width] = index.reshape(height, width)
        packed = (padded.reshape(height, inner, 1 << pack) << (np.arange(1 << pack, dtype=np.uint32) * (8 >> pack))).sum(2).astype(np.uint32)
        argb = (packed << 8 | 0xFF000000).astype(np.uint32).reshape(-1)
        blocks = ((inner + (1 << block_bits) - 1) >> block_bits) * ((height + (1 << block_bits) - 1) >> block_bits)
    for kind, image in ((SUBTRACT, None if not subtract else ()), (CROSS, cross), (PREDICTOR, predictor)):
        if image is None:
            continue
        out.write(1, 1)
        out.write(kind, 2)
        if kind == SUBTRACT:
            argb = _green(argb, -1)
            continue
        out.write(block_bits - 2, 3)
        if kind == CROSS:
            data = np.full(blocks, 0xFF000000 | cross[2] << 16 | cross[1] << 8 | cross[0], np.uint32)
            argb = _cross(argb, inner, height, block_bits, data, False)
        else:
            data = (np.uint32(0xFF000000) | ((predictor + np.arange(blocks, dtype=np.uint32)) % 14) << 8).astype(np.uint32)
            argb = _predicted(argb, inner, height, block_bits, data, False)
        _write_pixels(out, data.tolist(), (inner + (1 << block_bits) - 1) >> block_bits, False)
    out.write(0, 1)
    _write_pixels(out, argb.tolist(), inner, True, cache_bits, references)
    return _riff(out.bytes())


def _code_bits(lengths: list[int]) -> tuple[int, int]:
    """A code of three symbols or more as it is written, with runs of zeros: (bits, their number)."""
    end = max(s for s, n in enumerate(lengths) if n) + 1
    words: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    at = 0
    while at < end:
        run = 0
        while at + run < end and lengths[at + run] == 0 and run < 138:
            run += 1
        if run >= 3:
            words.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
            at += run
        else:
            words.append((lengths[at], 0, 0))
            at += 1
    counts = [0] * 19
    for w, _, _ in words:
        counts[w] += 1
    if sum(c > 0 for c in counts) == 1:
        counts[0 if not counts[0] else 1] = 1
    own = _lengths(counts, 7)
    value, n = 0, 1  # a first bit of zero: not one of the short forms
    last = max(i for i, s in enumerate(LENGTH_ORDER) if own[s]) + 1
    last = max(4, last)
    value |= (last - 4) << n
    n += 4
    for s in LENGTH_ORDER[:last]:
        value |= own[s] << n
        n += 3
    value |= 1 << n
    n += 1
    width = max(2, (len(words) - 2).bit_length() + (len(words) - 2).bit_length() % 2)
    value |= (width - 2) // 2 << n
    n += 3
    value |= (len(words) - 2) << n
    n += width
    codes = _symbols(own)
    for w, extra, k in words:
        c, m = codes[w]
        value |= c << n
        n += m
        value |= extra << n
        n += k
    return value, n


def encode_fitted(pixels: np.ndarray) -> bytes:
    """A WebP file of pixels alone, all four channels by one prefix code that fits their bytes."""
    height, width = pixels.shape[:2]
    flat = np.ascontiguousarray(np.asarray(pixels, np.uint8).reshape(-1, 4)[:, [1, 2, 0, 3]]).reshape(-1)
    counts = np.bincount(flat, minlength=256)
    if np.count_nonzero(counts) < 3:
        return encode(pixels)
    lengths = _lengths(counts.tolist(), WINDOW)
    written, size = _code_bits(lengths)
    out = _head(width, height)
    out.write(0, 3)  # no transform, no cache, one group of codes
    for _ in range(4):
        out.write(written, size)
    _write_code(out, [0] * DISTANCES)
    codes = _symbols(lengths)
    value, length = np.zeros(256, np.uint32), np.zeros(256, np.int64)
    value[list(codes)], length[list(codes)] = [c for c, _ in codes.values()], [n for _, n in codes.values()]
    took = length[flat]
    at = out.n + np.cumsum(took) - took
    size = (int(out.n + took.sum()) + 7) // 8 + 3
    shifted = value[flat] << (at & 7).astype(np.uint32)  # 12 + 7 bits at most
    stream = sum(np.bincount((at >> 3) + k, shifted >> (8 * k) & 255, size) for k in range(3)).astype(np.uint8)
    head = out.bytes()
    stream[: len(head)] |= np.frombuffer(head, np.uint8)
    return _riff(stream[:-3].tobytes())


def encode_best(pixels: np.ndarray) -> bytes:
    """The smallest of the forms that can pay: prefix codes alone; a palette where few colours make it; back-references and a cache where much repeats."""
    argb = np.ascontiguousarray(pixels, np.uint8).reshape(-1, 4).view("<u4").reshape(-1)
    forms = [encode_fitted(pixels)]
    colours = _distinct(argb)
    if colours <= 64 and 1.25 * (3 * colours + len(argb) * math.log2(max(2, colours)) / 8) < len(forms[0]):
        forms.append(encode(pixels, palette=True))
    if len(argb) >= 16 and 2 * colours < len(argb):
        a, b = (argb[i : i + len(argb) - 3].astype(np.uint64) << np.uint64(32) | argb[i + 1 : i + len(argb) - 2] for i in (0, 2))
        if 6 * _distinct(a * np.uint64(0x9E3779B97F4A7C15) ^ b) < len(a):
            forms.append(encode(pixels, references=True, cache_bits=4))
    return min(forms, key=len)


def _distinct(values: np.ndarray) -> int:
    s = np.sort(values)
    return 1 + int(np.count_nonzero(s[1:] != s[:-1]))
