"""Lossless WebP: a decoder and an encoder of the public bitstream format, without any image library.

``decode`` reads a RIFF file with one VP8L chunk: prefix codes (simple and normal, several groups), literals,
back-references with the distance map, colour cache, and the predictor, cross-colour, subtract-green and palette
transforms in any order, into an (height, width, 4) array of 8-bit R, G, B, A. Streams that hold literals only take a
vectorised path: every bit position is decoded at once by table lookup and the chain of pixel starts is followed.
``encode`` writes files that use any of these parts; ``encode_rows`` writes many payloads at once with literals under
one of a few fixed prefix-code books, the cheapest for each payload.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Order in which the lengths of the code-length code are stored: fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICT, CROSS, GREEN, PALETTE = range(4)
_HASH = 0x1E35A7BD
#: The 120 near distances as (x, y): by distance, then from the higher row, then from the right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


class Bits:
    """Reads bits from the low end of each byte."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        first = self.at >> 3
        out = int.from_bytes(self.data[first : first + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, x: int, n: int) -> None:
        self.value |= x << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def canonical(lengths) -> dict[int, tuple[int, int]]:
    """symbol -> (code as it is written, low bit first, length); a lone symbol takes no bits."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, last = {}, 0, 0
    for n, s in sorted(used):
        code <<= n - last
        out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code, last = code + 1, n
    return out


class Prefix:
    """A prefix code as a lookup table over its longest code.

    Lengths must make a whole code, as the format asks, or name one symbol, which takes no bits.
    """

    def __init__(self, lengths):
        used = [n for n in lengths if n]
        if len(used) > 1 and sum(1 << (15 - n) for n in used) != 1 << 15:
            raise ValueError("the lengths of a prefix code leave gaps or overlap")
        codes = canonical(lengths)
        self.most = max((n for _, n in codes.values()), default=0)
        self.symbol = np.zeros(1 << self.most, np.int32)
        self.length = np.zeros(1 << self.most, np.int32)
        for s, (code, n) in codes.items():
            self.symbol[code :: 1 << n] = s
            self.length[code :: 1 << n] = n
        self._lists = None

    def read(self, bits: Bits) -> int:
        if not self.most:
            return int(self.symbol[0])
        if self._lists is None:
            self._lists = (self.symbol.tolist(), self.length.tolist())
        at = bits.at
        i = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & ((1 << self.most) - 1)
        bits.at = at + self._lists[1][i]
        return self._lists[0][i]


def read_prefix(bits: Bits, size: int) -> Prefix:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    own = [0] * 19
    for i in CODE_ORDER[: 4 + bits.read(4)]:
        own[i] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, at, last = Prefix(own), 0, 8
    while at < size and left > 0:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
        else:
            n = _repeat(bits, s)
            if at + n > size:
                raise ValueError("a run of code lengths is too long")
            if s == 16:
                lengths[at : at + n] = [last] * n
            at += n
    return Prefix(lengths[:size])


def _repeat(bits: Bits, s: int) -> int:
    return 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)


def _value(bits: Bits, p: int) -> int:
    """Length or distance from its prefix symbol and extra bits."""
    if p < 4:
        return p + 1
    extra = (p - 2) >> 1
    return ((2 + (p & 1)) << extra) + bits.read(extra) + 1


def _ends(bits: Bits) -> None:
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends early")


#: Header of codes already parsed in this process: first bytes -> (bits, value, groups).
_headers: dict[int, tuple[int, int, list]] = {}


def _groups(bits: Bits, cache: int, n: int) -> list:
    return [[read_prefix(bits, size) for size in (280 + cache, 256, 256, 256, 40)] for _ in range(n)]


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as A<<24 | R<<16 | G<<8 | B."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    size, block, groups_of = (1 << cache_bits) if cache_bits else 0, 0, None
    count = 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        groups_of = (_image(bits, across, (height + (1 << block) - 1) >> block, False) >> 8 & 0xFFFF).tolist()
        count = max(groups_of) + 1
    if count == 1 and main and not size:
        groups = _known(bits)
    else:
        groups = _groups(bits, size, count)
    if count == 1 and not size and not groups[0][0].symbol.max() >= 256:
        return _literals(bits, groups[0], width * height)
    out: list[int] = []
    cache = [0] * size
    total, shift = width * height, 32 - cache_bits
    group = groups[0]
    at = 0
    while at < total:
        _ends(bits)
        if groups_of is not None:
            group = groups[groups_of[(at // width >> block) * across + (at % width >> block)]]
        s = group[0].read(bits)
        if s < 256:
            red = group[1].read(bits)
            blue = group[2].read(bits)
            new = [group[3].read(bits) << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            n = _value(bits, s - 256)
            d = _value(bits, group[4].read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or n > total - at:
                raise ValueError("a back-reference leaves the image")
            new = out[at - d : at - d + n] if n <= d else [out[at - d + i % d] for i in range(n)]
        else:
            new = [cache[s - 280]]
        out += new
        at += len(new)
        if size:
            for v in new:
                cache[(_HASH * v & 0xFFFFFFFF) >> shift] = v
    return np.array(out, np.uint32)


def _known(bits: Bits) -> list:
    """One group of codes without a cache; a header that was parsed before is recognised by its bits."""
    first = bits.at
    stream = int.from_bytes(bits.data[first >> 3 : (first >> 3) + 1200], "little") >> (first & 7)
    key = stream & ((1 << 160) - 1)
    known = _headers.get(key)
    if known and stream & ((1 << known[0]) - 1) == known[1]:
        bits.at = first + known[0]
        return known[2]
    groups = _groups(bits, 0, 1)
    n = bits.at - first
    if len(_headers) < 256 and n < 9000:
        _headers[key] = (n, stream & ((1 << n) - 1), groups)
    return groups


#: Bytes of a stream that are looked at together, so memory does not grow with the image.
_WINDOW = 1 << 17


def _literals(bits: Bits, group: list, n: int) -> np.ndarray:
    """n pixels of literals, window by window of the stream."""
    out = []
    while n > 0:
        part = _window_literals(bits, group, n)
        out.append(part)
        n -= len(part)
    _ends(bits)
    return np.concatenate(out) if len(out) != 1 else out[0]


def _window_literals(bits: Bits, group: list, n: int) -> np.ndarray:
    """Up to n pixels that begin in the next window: all bit positions at once, then the chain of pixel starts."""
    _ends(bits)
    first = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8, min(len(bits.data) - first, _WINDOW + 8), first)
    # a pixel has four codes of 15 bits at most, so one that begins before the limit ends inside
    partial = len(raw) > _WINDOW
    limit = 8 * _WINDOW if partial else max(8 * len(raw), n)
    raw = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    window = (words[:, None] >> np.arange(8, dtype=np.uint32)).ravel().astype(np.int32)
    end = len(window)
    here = np.arange(end, dtype=np.int32)
    ways: dict[int, np.ndarray] = {}
    nexts = []
    for code in group[:4]:
        if id(code) not in ways:
            same = next((ways[id(c)] for c in group[:4] if id(c) in ways and c.most == code.most and np.array_equal(c.length, code.length)), None)
            ways[id(code)] = np.minimum(here + code.length[window & ((1 << code.most) - 1)], end - 1) if same is None else same
        nexts.append(ways[id(code)])
    step = nexts[0]
    for follow in nexts[1:]:
        step = follow[step]
    jump, at = memoryview(step), bits.at & 7
    starts = np.empty(min(n, limit), np.int32)
    if not partial:
        for i in range(n):
            starts[i] = at
            at = jump[at]
    else:
        i = 0
        while i < len(starts) and at < limit:
            starts[i] = at
            at = jump[at]
            i += 1
        starts = starts[:i]
    out, pos = [], starts
    for code, follow in zip(group[:4], nexts, strict=True):
        out.append(code.symbol[window[pos] & ((1 << code.most) - 1)].astype(np.uint32))
        pos = follow[pos]
    bits.at = (bits.at & ~7) + at
    green, red, blue, alpha = out
    return alpha << 24 | red << 16 | green << 8 | blue


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _parts(v: int) -> tuple[int, int, int, int]:
    return v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255


def _clip(parts) -> int:
    out = 0
    for p in parts:
        out = out << 8 | (0 if p < 0 else 255 if p > 255 else p)
    return out


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predictor's value from left, top, top-right and top-left pixels; modes 14 and 15 are opaque black as mode 0."""
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode <= 9:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    lf, tp, cn = _parts(left), _parts(top), _parts(corner)
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(tp, cn, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(lf, cn, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return _clip(x + t - c for x, t, c in zip(lf, tp, cn, strict=True))
    mean = _parts(_average(left, top))
    return _clip(m + int((m - c) / 2) for m, c in zip(mean, cn, strict=True))


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _minus(a: int, b: int) -> int:
    # ones between the channels take the borrows
    high, low = 0x00FF00FF + (a & 0xFF00FF00) - (b & 0xFF00FF00), 0xFF00FF00 + (a & 0x00FF00FF) - (b & 0x00FF00FF)
    return high & 0xFF00FF00 | low & 0x00FF00FF


def _neighbour_mode(i: int, width: int, block: int, modes: list[int]) -> int:
    x, y = i % width, i // width
    if not y:
        return 1 if x else 0
    return modes[(y >> block) * ((width + (1 << block) - 1) >> block) + (x >> block)] if x else 2


def _predictor(px: list[int], width: int, block: int, modes: list[int], forward: bool) -> list[int]:
    """Residuals from pixels, or pixels from residuals."""
    out: list[int] = []
    seen = px if forward else out
    for i, v in enumerate(px):
        mode = _neighbour_mode(i, width, block, modes)
        left, top = (seen[i - 1] if i else 0), (seen[i - width] if i >= width else 0)
        right, corner = (seen[i - width + 1] if i >= width else 0), (seen[i - width - 1] if i > width else 0)
        guess = predicted(mode, left, top, right, corner)
        out.append(_minus(v, guess) if forward else _add(v, guess))
    return out


def _cross(px: np.ndarray, width: int, block: int, factors: np.ndarray, sign: int) -> np.ndarray:
    """Cross-colour with factors (green to red, green to blue, red to blue) per block; sign +1 inverts."""
    i = np.arange(len(px))
    own = factors[(i // width >> block) * ((width + (1 << block) - 1) >> block) + (i % width >> block)].astype(np.int8).astype(np.int32)
    signed = lambda v: v.astype(np.uint8).astype(np.int8).astype(np.int32)
    red, green, blue = (px >> 16 & 255).astype(np.int32), (px >> 8 & 255).astype(np.int32), (px & 255).astype(np.int32)
    new_red = red + sign * (own[:, 0] * signed(green) >> 5) & 255
    base = new_red if sign > 0 else red
    new_blue = blue + sign * ((own[:, 1] * signed(green) >> 5) + (own[:, 2] * signed(base) >> 5)) & 255
    return px & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << 16 | new_blue.astype(np.uint32)


def _green(px: np.ndarray, sign: int) -> np.ndarray:
    g = (px >> 8 & 255).astype(np.int64)
    red, blue = (px >> 16 & 255).astype(np.int64) + sign * g & 255, (px & 255).astype(np.int64) + sign * g & 255
    return px & np.uint32(0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def _bundle(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode_stream(data: bytes) -> np.ndarray:
    """The pixels of a VP8L chunk's data, (height, width) of A<<24 | R<<16 | G<<8 | B."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICT, CROSS):
            block = bits.read(3) + 2
            n = 1 << block
            undo.append((kind, w, block, _image(bits, (w + n - 1) >> block, (height + n - 1) >> block, False)))
        elif kind == GREEN:
            undo.append((kind, w, 0, None))
        else:
            size = bits.read(8) + 1
            table = _image(bits, size, 1, False)
            table = np.cumsum(np.stack([table >> s & 255 for s in (24, 16, 8, 0)]), axis=1) & 255
            undo.append((kind, w, _bundle(size), (table[0] << 24 | table[1] << 16 | table[2] << 8 | table[3]).astype(np.uint32)))
            w = (w + (1 << _bundle(size)) - 1) >> _bundle(size)
    px = _image(bits, w, height, True)
    _ends(bits)
    for kind, w, block, more in reversed(undo):
        if kind == PREDICT:
            px = np.array(_predictor(px.tolist(), w, block, (more >> 8 & 15).tolist(), False), np.uint32)
        elif kind == CROSS:
            px = _cross(px, w, block, np.stack([more & 255, more >> 8 & 255, more >> 16 & 255], axis=1), 1)
        elif kind == GREEN:
            px = _green(px, 1)
        else:
            packed = (px >> 8 & 255).reshape(height, -1)
            per, depth = 1 << block, 8 >> block
            index = (packed[:, :, None] >> (np.arange(per) * depth) & ((1 << depth) - 1)).reshape(height, -1)[:, :w].ravel()
            px = np.where(index < len(more), more[np.minimum(index, len(more) - 1)], 0).astype(np.uint32)
    return px.reshape(height, width)


def samples(px: np.ndarray) -> np.ndarray:
    """R, G, B, A as 8-bit samples on a last axis."""
    return np.stack([px >> 16 & 255, px >> 8 & 255, px & 255, px >> 24], axis=-1).astype(np.uint8)


def pixels(rgba: np.ndarray) -> np.ndarray:
    r, g, b, a = (rgba[..., i].astype(np.uint32) for i in range(4))
    return a << 24 | r << 16 | g << 8 | b


def container(stream: bytes) -> bytes:
    body = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + body


def files(media: bytes) -> list[bytes]:
    """The VP8L data of one or more WebP files that follow each other."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("no lossless WebP file")
        n = int.from_bytes(media[at + 16 : at + 20], "little")
        out.append(media[at + 20 : at + 20 + n])
        at += 8 + int.from_bytes(media[at + 4 : at + 8], "little")
    return out


def decode(media: bytes) -> np.ndarray:
    """(height, width, 4) samples of the first file."""
    return samples(decode_stream(files(media)[0]))


# --- encoding


def code_lengths(weights, limit: int = 15) -> list[int]:
    """Lengths of a prefix code for positive weights, none above ``limit``."""
    weights = [int(w) for w in weights]
    used = [s for s, w in enumerate(weights) if w]
    out = [0] * len(weights)
    if len(used) == 1:
        out[used[0]] = 1
    while len(used) > 1:
        heap = [(weights[s], s, (s,)) for s in used]
        heapq.heapify(heap)
        out = [0] * len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max(out) <= limit:
            break
        weights = [(w + 1) // 2 if w else 0 for w in weights]
    return out


def write_prefix(out: Writer, lengths: list[int]) -> dict[int, tuple[int, int]]:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        s = used[0] if used else 0
        out.put(1, 1)
        out.put(0, 1)
        out.put(1, 1)
        out.put(s, 8)
        return {s: (0, 0)}
    runs, i = [], 0
    while i < len(lengths):
        n = 1
        while i + n < len(lengths) and lengths[i + n] == lengths[i]:
            n += 1
        i, v, left = i + n, lengths[i], n
        if v:
            runs.append((v, 0, 0))
            left -= 1
        while left:
            if v:
                k = min(left, 6)
                runs += [(16, k - 3, 2)] if k >= 3 else [(v, 0, 0)] * k
            else:
                k = min(left, 138)
                runs += [(18, k - 11, 7)] if k >= 11 else [(17, k - 3, 3)] if k >= 3 else [(0, 0, 0)] * k
            left -= k
    weights = [0] * 19
    for s, _, _ in runs:
        weights[s] += 1
    own = code_lengths(weights, 7)
    if sum(n > 0 for n in own) == 1:  # two symbols at least keep every reader's table whole
        own[next(s for s in (0, 1) if not own[s])] = 1
    n = max(4, max(k for k, s in enumerate(CODE_ORDER) if own[s]) + 1)
    out.put(0, 1)
    out.put(n - 4, 4)
    for s in CODE_ORDER[:n]:
        out.put(own[s], 3)
    out.put(0, 1)
    codes = canonical(own)
    for s, extra, size in runs:
        out.put(*codes[s])
        out.put(extra, size)
    return canonical(lengths)


def _split(v: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and extra bits of a length or distance."""
    v -= 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    half = v >> extra & 1
    return 2 * (extra + 1) + half, v - ((2 + half) << extra), extra


def _tokens(px: list[int], width: int, cache_bits: int, references: bool) -> list[tuple]:
    out, seen, at = [], {}, 0
    cache = [None] * (1 << cache_bits) if cache_bits else None
    near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}

    def note(v):
        if cache is not None:
            cache[(_HASH * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v

    while at < len(px):
        n, key = 0, tuple(px[at : at + 3])
        if references and len(key) == 3 and key in seen:
            first = seen[key]
            while at + n < len(px) and n < 4096 and px[first + n] == px[at + n]:
                n += 1
        if n >= 3:
            d = at - first
            out.append(("copy", n, near.get(d, d + 120)))
        else:
            n, v = 1, px[at]
            slot = (_HASH * v & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            out.append(("cache", slot) if cache is not None and cache[slot] == v else ("literal", v))
        for i in range(at, at + n):
            seen[tuple(px[i : i + 3])] = i
            note(px[i])
        at += n
    return out


def _write_image(out: Writer, px: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = False, block: int = 0) -> None:
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    tokens = _tokens(px, width, cache_bits, references)
    across, groups = (width + (1 << block) - 1) >> block, 1
    of = lambda at: 0
    if main:
        out.put(1 if block else 0, 1)
        if block:
            rows = (len(px) // width + (1 << block) - 1) >> block
            groups = 2 if across * rows > 1 else 1
            out.put(block - 2, 3)
            _write_image(out, [(k % groups) << 8 for k in range(across * rows)], across, False)
            of = lambda at: ((at // width >> block) * across + (at % width >> block)) % groups
    size = 1 << cache_bits if cache_bits else 0
    weights = [[[0] * n for n in (280 + size, 256, 256, 256, 40)] for _ in range(groups)]
    plan, at = [], 0
    for t in tokens:
        g = of(at)
        if t[0] == "literal":
            a, r, gr, b = _parts(t[1])
            own = [(0, gr, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
        elif t[0] == "cache":
            own = [(0, 280 + t[1], 0, 0)]
        else:
            s, e, n = _split(t[1])
            d = _split(t[2])
            own = [(0, 256 + s, e, n), (4, *d)]
        for k, s, _, _ in own:
            weights[g][k][s] += 1
        plan.append((g, own))
        at += t[1] if t[0] == "copy" else 1
    codes = [[write_prefix(out, code_lengths(w)) for w in group] for group in weights]
    for g, own in plan:
        for k, s, extra, n in own:
            out.put(*codes[g][k][s])
            out.put(extra, n)


def encode(rgba: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = False, block: int = 0) -> bytes:
    """A WebP file of an (height, width, 4) array.

    ``transforms``, in the order in which they are applied: ("predictor", block bits, modes), ("cross", block bits,
    factors), ("green",), ("palette",). ``block`` above 1 uses two groups of prefix codes in turn.
    """
    height, width = rgba.shape[:2]
    px, w, out = pixels(rgba).ravel(), width, Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for kind, *more in transforms:
        out.put(1, 1)
        if kind == "palette":
            table, index = np.unique(px, return_inverse=True)
            if len(table) > 256:
                raise ValueError("more than 256 colours")
            bundle = _bundle(len(table))
            out.put(PALETTE, 2)
            out.put(len(table) - 1, 8)
            parts = np.diff(np.stack([table >> s & 255 for s in (24, 16, 8, 0)]).astype(np.int64), axis=1, prepend=0) & 255
            _write_image(out, (parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]).tolist(), len(table), False)
            new = (w + (1 << bundle) - 1) >> bundle
            grid = np.zeros((height, new << bundle), np.uint32)
            grid[:, :w] = index.reshape(height, w)
            depth = 8 >> bundle
            packed = (grid.reshape(height, new, 1 << bundle) << (np.arange(1 << bundle, dtype=np.uint32) * depth)).sum(axis=2, dtype=np.uint32)
            px, w = (packed << 8 | np.uint32(0xFF000000)).ravel().astype(np.uint32), new
        elif kind == "green":
            out.put(GREEN, 2)
            px = _green(px, -1)
        else:
            bits, values = more
            n = 1 << bits
            across, down = (w + n - 1) >> bits, (height + n - 1) >> bits
            out.put(PREDICT if kind == "predictor" else CROSS, 2)
            out.put(bits - 2, 3)
            if kind == "predictor":
                modes = [int(v) for v in np.resize(values, across * down)]
                _write_image(out, [0xFF000000 | m << 8 for m in modes], across, False)
                px = np.array(_predictor(px.tolist(), w, bits, modes, True), np.uint32)
            else:
                factors = np.resize(np.asarray(values, np.int64) & 255, (across * down, 3))
                _write_image(out, (0xFF000000 | factors[:, 2] << 16 | factors[:, 1] << 8 | factors[:, 0]).tolist(), across, False)
                px = _cross(px, w, bits, factors, -1)
    out.put(0, 1)
    _write_image(out, px.tolist(), w, True, cache_bits, references, block)
    return container(out.bytes())


def _books() -> list[list[int]]:
    """Code lengths of the fixed books: prose, capitals, symbols and digits, any byte."""
    base = np.ones(256)
    base[32:127] = 6
    base[128:192] = 14
    base[192:224] = 20
    lower, upper, marks = base.copy(), base.copy(), base.copy()
    for rank, c in enumerate("etaoinshrldcumwfgypbvkjxqz"):
        weight = 900 / (1 + rank * 0.45)
        lower[ord(c)], upper[ord(c.upper())], marks[ord(c)] = weight, weight, weight * 0.7
        lower[ord(c.upper())], upper[ord(c)], marks[ord(c.upper())] = weight * 0.03, weight * 0.1, weight * 0.05
    for book, space in ((lower, 1300), (upper, 1100), (marks, 1100)):
        book[32], book[10], book[ord(".")], book[ord(",")], book[255] = space, 20, 90, 70, 40
    upper[ord("!")] = 1400
    for c in "#$%&*|<>/=0123456789":
        marks[ord(c)] = 160
    return [code_lengths(np.maximum(b, 1).astype(int), 12) for b in (lower, upper, marks)] + [[8] * 256]


class _Book:
    def __init__(self, lengths: list[int]):
        head = Writer()
        head.put(0, 3)  # no transform, no cache, one group
        codes = write_prefix(head, lengths + [0] * 24)
        for _ in range(3):
            write_prefix(head, lengths)
        write_prefix(head, [0] * 40)
        self.bits = np.unpackbits(np.frombuffer(head.bytes(), np.uint8), bitorder="little")[: head.n]
        self.code = np.array([codes[s][0] for s in range(256)], np.uint32)
        self.length = np.array([codes[s][1] for s in range(256)], np.int64)


_made: list[_Book] = []


def books() -> list[_Book]:
    if not _made:
        _made.extend(_Book(b) for b in _books())
    return _made


def encode_rows(payload: np.ndarray, width: int) -> bytes:
    """A WebP file of rows of ``width`` R, G, B, A pixels, literals under the cheapest fixed book."""
    height = len(payload) // (4 * width)
    hist = np.bincount(payload, minlength=256)
    book = min(books(), key=lambda b: int(hist @ b.length) + len(b.bits))
    order = payload.reshape(-1, 4)[:, [1, 0, 2, 3]].ravel()
    n = book.length[order]
    ends = np.cumsum(n)
    at = np.arange(ends[-1]) - np.repeat(ends - n, n)
    data = np.repeat(book.code[order], n) >> at.astype(np.uint32) & 1
    head = 0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36
    packed = np.packbits(np.concatenate([book.bits, data.astype(np.uint8)]), bitorder="little").tobytes()
    return container(head.to_bytes(5, "little") + packed)
