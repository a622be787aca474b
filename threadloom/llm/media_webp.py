"""Media columns: bytes stored as lossless WebP images, decoded to pixel arrays.

The decoder reads the whole lossless format: prefix codes and their groups, back-references,
colour cache, and the predictor, cross-colour, subtract-green and palette transforms. Bytes
are stored as grey samples, 64 to a row: green is subtracted, samples become palette indices,
repeated lines and zero runs become back-references, and one prefix code is fitted to each
image. Where only the green channel carries bits, as in these images, prefix codes are decoded
for all bit positions at once and the chain of symbols is followed in strides.

A text's samples choose none of predictor, cross-colour and colour cache: after subtract-green
and the palette only one channel is left, and neighbouring bytes of text don't predict each
other. ``decode`` inverts them wherever an image has them.

Defined results: a null or empty payload is one row of 64 zero samples; a payload of more
than 16,383 rows is one wider image, with zeros up to a whole number of rows and its length in
a chunk of its own; equal payloads give equal bytes; damaged images raise ValueError; other columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW, ROWS = 64, 16_383  # the format allows so many rows
STRETCH = 1 << 17  # bytes of a stream that are decoded at a time
REACH = (1 << 20) - 120  # the longest distance of a back-reference
LIMIT = 12  # bits of the longest code that the encoder makes
# Fixed values of the format: order of code length codes, and the offsets (x, y) of near distances.
_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
_CACHE_HASH = 0x1E35A7BD
_BLACK = 0xFF000000


# --- prefix codes ------------------------------------------------------------------------


class Code:
    """A prefix code of up to 15 bits: for each peeked value the symbol and its length."""

    def __init__(self, lengths: dict[int, int]):
        """lengths: by symbol, without zeros. A single symbol takes no bits."""
        self.only = next(iter(lengths)) if len(lengths) == 1 else -1
        self.bits = 0 if self.only >= 0 else max(lengths.values(), default=0)
        if not lengths:
            raise ValueError("a prefix code without symbols")
        self.symbol = np.full(1 << self.bits, max(self.only, 0), np.int32)
        self.length = np.zeros(1 << self.bits, np.int32)
        if self.only < 0:
            if sum(1 << (self.bits - n) for n in lengths.values()) != 1 << self.bits:
                raise ValueError("a prefix code that is not complete")
            for s, (code, n) in canonical(lengths).items():
                self.symbol[code :: 1 << n] = s
                self.length[code :: 1 << n] = n

    def read(self, r: Reader) -> int:
        if self.only >= 0:
            return self.only
        at = r.peek(self.bits)
        r.at += self.length.item(at)
        return self.symbol.item(at)


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes, first bit lowest, by symbol: (code, length)."""
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - before
        before = n
        out[s] = int(f"{code:0{n}b}"[::-1], 2), n
        code += 1
    return out


def code_lengths(counts: dict[int, int], limit: int) -> dict[int, int]:
    """Lengths of a best prefix code; counts are flattened until no length is over ``limit``."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    while True:
        heap: list[tuple[int, int, object]] = [(n, s, s) for s, n in counts.items()]
        heapq.heapify(heap)
        tie = 1 << 20
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            tie += 1
            heapq.heappush(heap, (a[0] + b[0], tie, (a[2], b[2])))
        out: dict[int, int] = {}
        stack = [(heap[0][2], 0)]
        while stack:
            node, depth = stack.pop()
            if isinstance(node, tuple):
                stack += [(node[0], depth + 1), (node[1], depth + 1)]
            else:
                out[node] = depth
        if max(out.values()) <= limit:
            return out
        counts = {s: (n >> 1) + 1 for s, n in counts.items()}


class Reader:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends too early")
        return out


class Writer:
    """Bits of a header, lowest first."""

    def __init__(self) -> None:
        self.value = self.n = 0

    def bits(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def read_code(r: Reader, alphabet: int) -> Code:
    if r.bits(1):
        two = r.bits(1)
        symbols = [r.bits(8 if r.bits(1) else 1)]
        if two:
            symbols.append(r.bits(8))
        return Code(dict.fromkeys(symbols, 1))
    own = {}
    for s in _ORDER[: 4 + r.bits(4)]:
        if n := r.bits(3):
            own[s] = n
    code = Code(own)
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    lengths, at, before = {}, 0, 8
    while at < alphabet and left:
        left -= 1
        n = code.read(r)
        if n < 16:
            if n:
                lengths[at] = before = n
            at += 1
        else:
            times = r.bits((2, 3, 7)[n - 16]) + (3, 3, 11)[n - 16]
            if at + times > alphabet:
                raise ValueError("code lengths beyond the alphabet")
            if n == 16:
                lengths |= dict.fromkeys(range(at, at + times), before)
            at += times
    return Code(lengths)


def write_code(w: Writer, lengths: dict[int, int]) -> None:
    """A code's lengths: as one or two symbols where that will do, else run by run under a code of their own."""
    symbols = sorted(lengths)
    if len(symbols) <= 2 and symbols[-1] < 256:
        w.bits(1, 1)
        w.bits(len(symbols) - 1, 1)
        w.bits(int(symbols[0] > 1), 1)
        w.bits(symbols[0], 8 if symbols[0] > 1 else 1)
        if len(symbols) == 2:
            w.bits(symbols[1], 8)
        return
    runs: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    at = 0
    for s in symbols:
        gap = s - at
        while gap:
            n = min(gap, 138)
            if n >= 11:
                runs.append((18, n - 11, 7))
            elif n >= 3:
                runs.append((17, n - 3, 3))
            else:
                runs += [(0, 0, 0)] * n
            gap -= n
        runs.append((lengths[s], 0, 0))
        at = s + 1
    counts: dict[int, int] = {}
    for s, *_ in runs:
        counts[s] = counts.get(s, 0) + 1
    own = code_lengths(counts, 7)
    w.bits(0, 1)
    last = max(i for i, s in enumerate(_ORDER) if s in own)
    w.bits(max(0, last - 3), 4)
    for s in _ORDER[: max(4, last + 1)]:
        w.bits(own.get(s, 0), 3)
    w.bits(1, 1)  # the number of runs follows
    size = max(2, (len(runs) - 2).bit_length() + 1 & ~1)
    w.bits((size - 2) // 2, 3)
    w.bits(len(runs) - 2, size)
    codes = canonical(own) if len(own) > 1 else dict.fromkeys(own, (0, 0))
    for s, extra, n in runs:
        w.bits(*codes[s])
        w.bits(extra, n)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and extra bits of a length or distance of at least 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n


def value_of(symbol: int, r: Reader) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + r.bits(n) + 1


# --- decoding ----------------------------------------------------------------------------


def _distance(value: int, width: int) -> int:
    if value > 120:
        return value - 120
    x, y = _NEAR[value - 1]
    return max(1, x + y * width)


def _parts(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def read_pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as 32-bit ARGB. Only the main image has groups of codes."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of too many bits")
    groups, group_bits, of_block = 1, 0, None
    if main and r.bits(1):
        group_bits = r.bits(3) + 2
        of_block = (read_pixels(r, _parts(width, group_bits), _parts(height, group_bits), False) >> 8 & 0xFFFF).astype(np.int64)
        groups = int(of_block.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(r, n) for n in sizes] for _ in range(groups)]
    if groups == 1 and not cache_bits and all(c.only >= 0 for c in codes[0][1:4]) and width * height > 64:
        return _green_pixels(r, width, height, codes[0])
    out = np.zeros(width * height, np.uint32)
    cache, cached, shift = [0] * (1 << cache_bits), 0, 32 - cache_bits
    at, n, per_row = 0, width * height, _parts(width, group_bits)
    while at < n:
        own = codes[0] if of_block is None else codes[of_block[(at // width >> group_bits) * per_row + (at % width >> group_bits)]]
        s = own[0].read(r)
        if s < 256:
            red, blue, alpha = own[1].read(r), own[2].read(r), own[3].read(r)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = value_of(s - 256, r)
            back = _distance(value_of(own[4].read(r), r), width)
            if back > at or at + length > n:
                raise ValueError("a back-reference beyond the image")
            for i in range(at, at + length):
                out[i] = out[i - back]
            at += length
        else:
            while cached < at:
                cache[int(out[cached]) * _CACHE_HASH % (1 << 32) >> shift] = int(out[cached])
                cached += 1
            out[at] = cache[s - 280]
            at += 1
        if r.at > r.end:
            raise ValueError("the image ends too early")
    return out


def _green_pixels(r: Reader, width: int, height: int, codes: list[Code]) -> np.ndarray:
    """Pixels of which only green takes bits, a stretch of the stream at a time."""
    green, red, blue, alpha, far = codes
    n, base = width * height, alpha.only << 24 | red.only << 16 | blue.only
    if green.only >= 0:
        if green.only >= 256:
            raise ValueError("a back-reference beyond the image")
        return np.full(n, base | green.only << 8, np.uint32)
    out, done = np.empty(n, np.uint8), 0
    while done < n:
        before = r.at
        done = _green_stretch(r, width, green, far, out, done)
        if r.at > r.end or r.at == before:
            raise ValueError("the image ends too early")
    return out.astype(np.uint32) << 8 | np.uint32(base)


def _green_stretch(r: Reader, width: int, green: Code, far: Code, out: np.ndarray, done: int) -> int:
    """Symbols for all bit positions of a stretch at once, then their chain; fills ``out`` from ``done`` on and says how far."""
    n, skip = len(out), r.at >> 3
    raw = np.frombuffer(r.data, np.uint8)[skip : skip + STRETCH + 10].astype(np.uint32)
    wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    peeks = (wide[:, None] >> np.arange(8, dtype=np.uint32)).ravel()  # 17 bits at least from each position
    ends = len(peeks)
    limit = min(ends - 1, 8 * STRETCH)  # a symbol and its extra bits take less than the 64 bits that lie beyond it
    symbol = green.symbol[peeks & np.uint32((1 << green.bits) - 1)]
    nxt = np.arange(ends, dtype=np.int64) + green.length[peeks & np.uint32((1 << green.bits) - 1)]
    copies = np.flatnonzero(symbol >= 256)
    if len(copies):
        extra = np.maximum(symbol[copies] - 256 - 2 >> 1, 0)
        p = np.minimum(nxt[copies] + extra, ends - 1)
        d = peeks[p] & np.uint32((1 << far.bits) - 1)
        nxt[copies] = p + far.length[d] + np.maximum(far.symbol[d] - 2 >> 1, 0)
    np.minimum(nxt, ends - 1, out=nxt)
    stride, leap = 1, nxt
    while stride < 16 and n - done > 512:
        leap = leap[leap]
        stride *= 2
    starts, p, jump = [], r.at - 8 * skip, memoryview(leap)
    total = done
    while p < limit and total < n:
        starts.append(p)
        p = jump[p]
        total += stride
    chain = np.array(starts, np.int64)
    if stride > 1:
        steps = [chain]
        for _ in range(stride - 1):
            steps.append(nxt[steps[-1]])
        chain = np.stack(steps, 1).ravel()
        chain = chain[: np.searchsorted(chain, limit)]
    found = symbol[chain]
    jumps, before = np.flatnonzero(found >= 256), 0
    for j in jumps.tolist():
        k = min(j - before, n - done)
        out[done : done + k] = found[before : before + k]
        done += k
        before += k
        if done == n:
            break
        r.at = int(chain[j]) + 8 * skip
        green.read(r)
        length = value_of(int(found[j]) - 256, r)
        back = _distance(value_of(far.read(r), r), width)
        if back > done or done + length > n:
            raise ValueError("a back-reference beyond the image")
        if back >= length:
            out[done : done + length] = out[done - back : done - back + length]
        else:
            out[done : done + length] = np.resize(out[done - back : done], length)
        done += length
        before = j + 1
    k = min(len(found) - before, n - done)
    out[done : done + k] = found[before : before + k]
    used = before + k
    if used:
        r.at = int(nxt[chain[used - 1]]) + 8 * skip
    return done + k


def _channels(p: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue as rows of an int array."""
    return np.stack([p >> s & 0xFF for s in (24, 16, 8, 0)]).astype(np.int64)


def _joined(c: np.ndarray) -> np.ndarray:
    a, r, g, b = (x.astype(np.uint32) & 0xFF for x in c)
    return a << 24 | r << 16 | g << 8 | b


def _mean2(a: tuple, b: tuple) -> tuple:
    return tuple((x + y) >> 1 for x, y in zip(a, b, strict=True))


def _clamped(values: Iterator[int]) -> tuple:
    return tuple(min(255, max(0, v)) for v in values)


def _predict(mode: int, left: tuple, top: tuple, top_right: tuple, top_left: tuple) -> tuple:
    """The predicted pixel of a mode from its four neighbours, by channel."""
    if mode == 11:
        to_left = sum(abs(t - d) for t, d in zip(top, top_left, strict=True))
        to_top = sum(abs(x - d) for x, d in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return _clamped(x + t - d for x, t, d in zip(left, top, top_left, strict=True))
    if mode == 13:
        m = _mean2(left, top)
        return _clamped(x + int((x - d) / 2) for x, d in zip(m, top_left, strict=True))
    simple = {1: left, 2: top, 3: top_right, 4: top_left}
    if mode in simple:
        return simple[mode]
    pairs = {6: (left, top_left), 7: (left, top), 8: (top_left, top), 9: (top, top_right)}
    if mode in pairs:
        return _mean2(*pairs[mode])
    if mode == 5:
        return _mean2(_mean2(left, top_right), top)
    if mode == 10:
        return _mean2(_mean2(left, top_left), _mean2(top, top_right))
    return (255, 0, 0, 0)


def predicted(p: np.ndarray, width: int, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Residuals to pixels (inverse) or pixels to residuals, by the predictor of each block."""
    src = [tuple(x) for x in _channels(p).T.tolist()]
    pix = [] if inverse else src
    out, per_row = [], _parts(width, bits)
    for i, own in enumerate(src):
        y, x = divmod(i, width)
        if i == 0:
            guess = (255, 0, 0, 0)
        elif y == 0:
            guess = pix[i - 1]
        elif x == 0:
            guess = pix[i - width]
        else:
            guess = _predict(int(modes[(y >> bits) * per_row + (x >> bits)]) & 15, pix[i - 1], pix[i - width], pix[i - width + 1], pix[i - width - 1])
        sign = 1 if inverse else -1
        new = tuple((a + sign * b) & 255 for a, b in zip(own, guess, strict=True))
        out.append(new)
        if inverse:
            pix.append(new)
    return _joined(np.array(out, np.int64).T)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) + 128 & 255) - 128


def cross_coloured(p: np.ndarray, width: int, blocks: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Adds (inverse) or takes the shares of green in red, and of green and red in blue, of each block."""
    a, r, g, b = _channels(p)
    i = np.arange(len(p))
    block = blocks[(i // width >> bits) * _parts(width, bits) + (i % width >> bits)]
    _, red_blue, green_blue, green_red = _channels(block)
    share = lambda t, c: _signed(t) * _signed(c) >> 5
    sign = 1 if inverse else -1
    new_red = (r + sign * share(green_red, g)) & 255
    blue = b + sign * share(green_blue, g) + sign * share(red_blue, new_red if inverse else r)
    return _joined(np.stack([a, new_red, g, blue & 255]))


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and ARGB pixels of a lossless WebP file."""
    image = _chunks(data).get(b"VP8L", b"")
    if len(image) < 5 or image[0] != 0x2F:
        raise ValueError("not a lossless WebP image")
    r = Reader(image[1:])
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("an unknown version")
    undo, own_width = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (k for k, *_ in undo):
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.bits(3) + 2
            undo.append((kind, own_width, bits, read_pixels(r, _parts(own_width, bits), _parts(height, bits), False)))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, own_width, 0, None))
        else:
            colours = r.bits(8) + 1
            steps = _channels(read_pixels(r, colours, 1, False))
            bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            undo.append((kind, own_width, bits, _joined(np.cumsum(steps, 1))))
            own_width = _parts(own_width, bits)
    p = read_pixels(r, own_width, height, True)
    for kind, wide, bits, block in reversed(undo):
        if kind == SUBTRACT_GREEN:
            g = p >> 8 & 0xFF
            p = p & 0xFF00FF00 | ((p >> 16) + g & 0xFF) << 16 | (p + g & 0xFF)
        elif kind == PALETTE:
            p = _unpacked(p, wide, height, bits, block)
        elif kind == PREDICTOR:
            p = predicted(p, wide, block >> 8 & 0xFF, bits, True)
        else:
            p = cross_coloured(p, wide, block, bits, True)
    return width, height, p


def _unpacked(p: np.ndarray, width: int, height: int, bits: int, table: np.ndarray) -> np.ndarray:
    """Palette indices, of which small palettes pack several into a green sample, to colours."""
    index = (p >> 8 & 0xFF).reshape(height, -1)
    if bits:
        each = 8 >> bits
        index = (index[:, :, None] >> np.arange(0, 8, each, dtype=np.uint32) & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index.ravel()]


# --- encoding ----------------------------------------------------------------------------


def _packed(value: np.ndarray, length: np.ndarray, w: Writer) -> bytes:
    """The header's bits and then all values of up to 16 bits each, as bytes."""
    pad = -len(value) % 4
    v = np.concatenate([value, np.zeros(pad, np.uint64)]).astype(np.uint64)
    n = np.concatenate([length, np.zeros(pad, np.int64)]).astype(np.uint64)
    for _ in range(2):  # four values in one of up to 64 bits
        v, n = v[::2] | v[1::2] << n[::2], n[::2] + n[1::2]
    at = np.cumsum(n) - n + np.uint64(w.n)
    total = int(at[-1] + n[-1]) if len(n) else w.n
    words = np.zeros(total // 64 + 2, np.uint64)
    own, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    if len(n):
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        words[own[first]] = np.bitwise_or.reduceat(v << shift, first)
        over = np.flatnonzero(shift + n > np.uint64(64))
        words[own[over] + 1] |= v[over] >> (np.uint64(64) - shift[over])
    head = w.value.to_bytes((w.n + 63) // 64 * 8, "little")
    words[: len(head) // 8] |= np.frombuffer(head, np.uint64)
    return words.tobytes()[: (total + 7) // 8]


def _framed(body: bytes) -> bytes:
    chunk = b"\x2f" + body
    pad = len(chunk) % 2
    return b"RIFF" + struct.pack("<I", 12 + len(chunk) + pad) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + bytes(pad)


def _header(width: int, height: int) -> Writer:
    w = Writer()
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(1, 1)  # alpha may be used
    w.bits(0, 3)
    return w


def _repeated_lines(raw: bytes, least: int = 16) -> list[tuple[int, int, int]]:
    """(place, length, distance) of lines that stand earlier in the bytes too, and of zeros at the end."""
    seen: dict[bytes, int] = {}
    out, at = [], 0
    body = raw.rstrip(b"\0")
    for line in body.split(b"\n"):
        if len(line) >= least:
            known = seen.get(line, at)
            if known == at or at - known > REACH:
                seen[line] = at
            else:
                out += [(at + i, min(4096, len(line) - i), at - known) for i in range(0, len(line), 4096)]
        at += len(line) + 1
    zeros = len(raw) - len(body)
    if zeros > 4:
        out += [(len(body) + 1 + i, min(4096, zeros - 1 - i), 1) for i in range(0, zeros - 1, 4096)]
    return out


def encode_samples(raw: bytes, width: int = ROW) -> bytes:
    """Bytes, a multiple of the width, as a grey lossless WebP image."""
    height = len(raw) // width
    samples = np.frombuffer(raw, np.uint8)
    values = np.flatnonzero(np.bincount(samples, minlength=256))
    w = _header(width, height)
    w.bits(1, 1)
    w.bits(SUBTRACT_GREEN, 2)
    w.bits(1, 1)
    w.bits(PALETTE, 2)
    w.bits(len(values) - 1, 8)
    steps = np.diff(values, prepend=0).tolist()
    w.bits(0, 1)  # no colour cache
    counts: dict[int, int] = {}
    for s in steps:
        counts[s] = counts.get(s, 0) + 1
    lengths = code_lengths(counts, LIMIT)
    alphas = [255, 0][: len(steps)] if len(steps) > 1 else [255]
    for code in (lengths, {0: 1}, {0: 1}, dict.fromkeys(alphas, 1), {0: 1}):
        write_code(w, code)
    green = canonical(lengths) if len(lengths) > 1 else dict.fromkeys(lengths, (0, 0))
    alpha = canonical(dict.fromkeys(alphas, 1)) if len(alphas) > 1 else {255: (0, 0)}
    for i, s in enumerate(steps):
        w.bits(*green[s])
        w.bits(*alpha[0 if i else 255])
    w.bits(0, 1)  # no further transform
    index = np.zeros(256, np.int64)
    index[values] = np.arange(len(values))
    symbols = index[samples]
    bits = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1 if len(values) <= 16 else 0
    copies = []
    if bits:
        each = 8 >> bits
        symbols = (symbols.reshape(-1, 1 << bits) << np.arange(0, 8, each)).sum(1)
    else:
        copies = _repeated_lines(raw)
    w.bits(0, 2)  # no colour cache, one group of codes
    # literals and, for each copy, its length, its distance and their extra bits
    gone = np.ones(len(symbols), bool)
    lens, dists, extras = [], [], []
    for at, n, back in copies:
        gone[at : at + n] = False
        ls, le, ln = prefix_of(n)
        ds, de, dn = prefix_of(back + 120)
        lens.append(256 + ls)
        dists.append(ds)
        extras.append((le, ln, de, dn))
    kept = symbols[gone]
    hist = np.bincount(np.concatenate([kept, np.array(lens, np.int64)]), minlength=280)
    main = code_lengths({int(s): int(hist[s]) for s in np.flatnonzero(hist)}, LIMIT)
    far = code_lengths({s: dists.count(s) for s in set(dists)}, LIMIT) if dists else {0: 1}
    for code in (main, {0: 1}, {0: 1}, {255: 1}, far):
        write_code(w, code)
    value, length = np.zeros(280, np.uint64), np.zeros(280, np.int64)
    for s, (c, n) in (canonical(main) if len(main) > 1 else dict.fromkeys(main, (0, 0))).items():
        value[s], length[s] = c, n
    v, n = value[kept], length[kept]
    if copies:
        codes = canonical(far) if len(far) > 1 else dict.fromkeys(far, (0, 0))
        at = np.cumsum(gone)[[c[0] for c in copies]]  # literals before each copy
        more_v, more_n = [], []
        for s, d, (le, ln, de, dn) in zip(lens, dists, extras, strict=True):
            more_v += [int(value[s]), le, codes[d][0], de & 0xFFFF, de >> 16]
            more_n += [int(length[s]), ln, codes[d][1], min(dn, 16), max(0, dn - 16)]
        where = np.repeat(at, 5)
        v, n = np.insert(v, where, np.array(more_v, np.uint64)), np.insert(n, where, more_n)
    return _framed(_packed(v, n, w))


def encode_pixels(p: np.ndarray, width: int, predictor: int | None = None, cross: tuple[int, int, int] | None = None, subtract_green: bool = False, cache_bits: int = 0, block_bits: int = 2) -> bytes:
    """Any ARGB pixels as a lossless WebP image, with the transforms and the colour cache that are asked for.

    predictor: one mode for all blocks; cross: multipliers (red to blue, green to blue,
    green to red). Runs of equal pixels become back-references.
    """
    height = len(p) // width
    w = _header(width, height)
    blocks = _parts(width, block_bits) * _parts(height, block_bits)

    def flat(colour: int) -> None:
        """A block image of one colour takes no bits beyond its codes."""
        w.bits(0, 1)
        for s in (colour >> 8 & 255, colour >> 16 & 255, colour & 255, colour >> 24, 0):
            write_code(w, {s: 1})

    if predictor is not None:
        p = predicted(p, width, np.full(blocks, predictor), block_bits, False)
        w.bits(1 | PREDICTOR << 1 | (block_bits - 2) << 3, 6)
        flat(_BLACK | predictor << 8)
    if cross:
        colour = _BLACK | cross[0] << 16 | cross[1] << 8 | cross[2]
        p = cross_coloured(p, width, np.full(blocks, colour, np.uint32), block_bits, False)
        w.bits(1 | CROSS_COLOUR << 1 | (block_bits - 2) << 3, 6)
        flat(colour)
    if subtract_green:
        a, r, g, b = _channels(p)
        p = _joined(np.stack([a, r - g & 255, g, b - g & 255]))
        w.bits(1 | SUBTRACT_GREEN << 1, 3)
    w.bits(0, 1)
    w.bits(1 if cache_bits else 0, 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    w.bits(0, 1)
    tokens: list[list[tuple[int, int, int, int]]] = []  # (code, symbol, extra, extra bits)
    cache = [0] * (1 << cache_bits)
    pix, i = p.tolist(), 0
    while i < len(pix):
        run = 0
        while i and run < 4096 and i + run < len(pix) and pix[i + run] == pix[i - 1]:
            run += 1
        slot = pix[i] * _CACHE_HASH % (1 << 32) >> (32 - cache_bits)
        if run > 2:
            tokens.append([(0, 256 + (x := prefix_of(run))[0], *x[1:]), (4, (y := prefix_of(121))[0], *y[1:])])
        elif cache_bits and cache[slot] == pix[i]:
            tokens.append([(0, 280 + slot, 0, 0)])
            run = 1
        else:
            tokens.append([(0, pix[i] >> 8 & 255, 0, 0), (1, pix[i] >> 16 & 255, 0, 0), (2, pix[i] & 255, 0, 0), (3, pix[i] >> 24, 0, 0)])
            run = 1
        for v in pix[i : i + run] if cache_bits else ():
            cache[v * _CACHE_HASH % (1 << 32) >> (32 - cache_bits)] = v
        i += run
    counts: list[dict[int, int]] = [{}, {}, {}, {}, {}]
    for t in tokens:
        for c, s, *_ in t:
            counts[c][s] = counts[c].get(s, 0) + 1
    codes = []
    for c in counts:
        lengths = code_lengths(c, LIMIT) if c else {0: 1}
        write_code(w, lengths)
        codes.append(canonical(lengths) if len(lengths) > 1 else dict.fromkeys(lengths, (0, 0)))
    for t in tokens:
        for c, s, extra, n in t:
            w.bits(*codes[c][s])
            w.bits(extra, n)
    return _framed(_packed(np.zeros(0, np.uint64), np.zeros(0, np.int64), w))


# --- columns -----------------------------------------------------------------------------


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % ROW or (0 if raw else ROW))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)


def store(payload: bytes) -> bytes:
    """A payload as one image of 64 columns; if that is too high, as a wider one with its length beside it."""
    rows = len(payload) // ROW
    if rows <= ROWS:
        return encode_samples(payload)
    width = ROW * -(-rows // ROWS)
    image = encode_samples(payload + bytes(-len(payload) % width), width)
    height = -(-len(payload) // width)
    canvas = bytes(4) + struct.pack("<I", width - 1)[:3] + struct.pack("<I", height - 1)[:3]
    body = b"WEBP" + _chunk(b"VP8X", canvas) + image[12:] + _chunk(b"PLEN", struct.pack("<Q", len(payload)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(media: bytes) -> dict[bytes, bytes]:
    """The chunks of a WebP file by name."""
    if len(media) < 20 or media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, at = {}, 12
    while at + 8 <= len(media):
        size = struct.unpack("<I", media[at + 4 : at + 8])[0]
        out[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return out


def load(media: bytes) -> np.ndarray:
    """Samples of a stored image: all grey channels must agree, and the first is returned."""
    p = decode(media)[2]
    grey = (p & 0xFF).astype(np.uint8)
    if (p != (grey.astype(np.uint32) * np.uint32(0x010101) | np.uint32(_BLACK))).any():
        raise ValueError("not a grey image")
    length = _chunks(media).get(b"PLEN")
    return grey if length is None else grey[: struct.unpack("<Q", length)[0]]


def feature_of(samples: np.ndarray) -> str:
    """Rows, mean and spread of the samples, mean step between neighbours, and the share of each quarter of the range."""
    x = samples.astype(np.float64)
    quarters = np.bincount(samples >> 6, minlength=4) / len(samples)
    return f"64x{len(samples) // ROW};mean={x.mean():.3f};std={x.std():.3f};step={np.abs(np.diff(x)).mean():.3f};quarters={','.join(f'{q:.3f}' for q in quarters)}"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and the media themselves if asked for.

    All but n_bytes and the media's own figures are computed from what is read back.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * keep_media]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, payload = payload_of(text.as_py())
                media = store(payload)
                samples = load(media)
                back = samples.tobytes()
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples), *[media] * keep_media))
            cols = [*zip(*rows, strict=True)] if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
