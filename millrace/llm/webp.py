"""Lossless WebP (RFC 9649): a decoder for the whole bit stream, and an encoder that can use each of its parts.

Pixels are arrays (height, width, 4) of RGBA bytes.
"""

from __future__ import annotations

import struct

import numpy as np

from .token_store import canonical, code_lengths

PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
#: The order in which lengths of code-length codes are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values: (x, y) back-reference offsets of distance codes 1 to 120.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = 0x1E35A7BD
MASK = 0xFFFFFFFF


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + (n + 14) // 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        return out


def _reversed(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2) if n else 0


_MIRROR: dict[int, np.ndarray] = {}


def _mirror(n: int) -> np.ndarray:
    """All numbers of n bits, their bits in reverse order."""
    if n not in _MIRROR:
        out = np.zeros(1, np.int64)
        for _ in range(n):
            out = np.concatenate([2 * out, 2 * out + 1])
        _MIRROR[n] = out
    return _MIRROR[n]


class Prefix:
    """A canonical prefix code; a code with one symbol takes no bits. table: for every ``width`` bits, symbol * 16 + length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            raise ValueError("a prefix code without symbols")
        self.only = int(used[0]) if len(used) == 1 else -1
        self.width = 0 if self.only >= 0 else int(lengths.max())
        if self.only >= 0:
            self.table = np.array([self.only << 4], np.int32)
        else:
            used = used[np.argsort(lengths[used], kind="stable")]
            size = lengths[used].astype(np.int64)
            span = 1 << (self.width - size)
            if int(span.sum()) != 1 << self.width:
                raise ValueError("an incomplete prefix code")
            self.table = np.repeat(used << 4 | size, span).astype(np.int32)[_mirror(self.width)]
        self.quick: list[int] = []

    def read(self, bits: Bits) -> int:
        if self.only >= 0:
            return self.only
        if not self.quick:
            self.quick = self.table.tolist()
        hit = self.quick[bits.peek(self.width)]
        bits.at += hit & 15
        return hit >> 4


_OWN: dict[bytes, Prefix] = {}


def _code_lengths(bits: Bits, code: Prefix, size: int, left: int) -> list[int]:
    """Code lengths of ``size`` symbols, written as at most ``left`` numbers and runs."""
    quick, mask = code.table.tolist(), (1 << code.width) - 1
    single = code.only >= 0
    out: list[int] = []
    last, word, held = 8, 0, 0
    while len(out) < size and left:
        left -= 1
        if held < 32:  # a number and its extra bits take 22 at most
            word, held = bits.peek(1024), 1024
        if single:
            s = code.only
        else:
            hit = quick[word & mask]
            n = hit & 15
            s, word, held = hit >> 4, word >> n, held - n
            bits.at += n
        if s < 16:
            out.append(s)
            last = s or last
            continue
        n, least, v = (2, 3, last) if s == 16 else (3, 3, 0) if s == 17 else (7, 11, 0)
        out += [v] * (least + (word & ((1 << n) - 1)))
        word, held = word >> n, held - n
        bits.at += n
    if len(out) > size:
        raise ValueError("code lengths beyond the alphabet")
    return out + [0] * (size - len(out))


def _read_prefix(bits: Bits, size: int, seen: dict) -> Prefix:
    start = bits.at
    for n, value, code in seen.get((size, bits.peek(64)), ()):
        if bits.peek(n) == value:
            bits.at += n
            return code
    lengths = np.zeros(size, np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
    else:
        own = bytearray(19)
        for k in range(4 + bits.read(4)):
            own[LENGTH_ORDER[k]] = bits.read(3)
        code = _OWN.get(bytes(own))
        if code is None:
            if len(_OWN) >= 1024:
                _OWN.clear()
            code = _OWN[bytes(own)] = Prefix(np.frombuffer(bytes(own), np.uint8))
        left = size if not bits.read(1) else 2 + bits.read(2 + 2 * bits.read(3))
        lengths = np.array(_code_lengths(bits, code, size, left), np.uint8)
    out = Prefix(lengths)
    n, bits.at = bits.at - start, start
    if n <= 64 and len(seen) < 4096:  # short ones recur
        seen.setdefault((size, bits.peek(64)), []).append((n, bits.peek(n), out))
    bits.at += n
    return out


def _value(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


#: Bits of a stream that are looked at together.
WINDOW = 1 << 17


def _numbers(raw: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n bits (24 at most) at each place of a stream of bytes."""
    i = at >> 3
    word = raw[i].astype(np.int64) | raw[i + 1].astype(np.int64) << 8 | raw[i + 2].astype(np.int64) << 16 | raw[i + 3].astype(np.int64) << 24
    return word >> (at & 7) & ((1 << n) - 1)


def _values(prefix: np.ndarray, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances of prefixes whose extra bits are at ``at``, and the bits after those."""
    extra = np.maximum((prefix - 2) >> 1, 0)
    base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
    return base + _numbers(raw, at, extra) + 1, at + extra


def _symbols(bits: Bits, codes: list[Prefix], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels (literals), counts of pixels (1 for a literal) and distance codes (0 for a literal) of n pixels and whose code
    has no cache. What follows each bit of a window, if a symbol began there, is looked up for all bits at once; then the
    symbols are those that the first one leads to."""
    green, far = codes[0], codes[4]
    others = list(zip(codes[1:4], (16, 0, 24)))
    if all(c.only >= 0 for c in codes[:4]) and green.only < 256:
        word = sum(c.only << k for c, k in [(green, 8), *others])
        return np.full(n, word, np.uint32), np.ones(n, np.int64), np.zeros(n, np.int64)
    if green.only >= 256:
        raise ValueError("a reference outside the image")
    raw = np.frombuffer(bits.data, np.uint8)
    end = 8 * (len(raw) - 8)
    raw = np.concatenate([raw, np.zeros(64, np.uint8)])
    margin = 15 * 5 + 48
    pixels, counts, dists, left, at = [], [], [], n, bits.at
    while left > 0:
        if at >= end:
            raise ValueError("the bit stream ends early")
        lo = at >> 3
        size = min(WINDOW, end - 8 * lo + 8)  # places where a symbol may begin
        own = raw[lo : lo + (size + margin >> 3) + 4].astype(np.int32)
        word = own[:-3] | own[1:-2] << 8 | own[2:-1] << 16
        window = (word[:, None] >> np.arange(8, dtype=np.int32)).reshape(-1)

        def look(code: Prefix, place: np.ndarray | slice) -> np.ndarray:
            return code.table[window[place] & ((1 << code.width) - 1)]

        hit = look(green, slice(0, size))
        after = np.arange(size, dtype=np.int32) + (hit & 15)
        refers = np.flatnonzero(hit >= 256 << 4)
        if any(c.only < 0 for c, _ in others):
            where = np.flatnonzero(hit < 256 << 4)
            place = after[where]
            for c, _ in others:
                place = place + (look(c, place) & 15)
            after[where] = place
        if len(refers):
            prefix = (hit[refers] >> 4) - 256
            if prefix.max() >= 24:
                raise ValueError("a symbol beyond the alphabet")
            place = after[refers] + np.maximum((prefix - 2) >> 1, 0)
            distance = look(far, place)
            after[refers] = place + (distance & 15) + np.maximum(((distance >> 4) - 2) >> 1, 0)
        follow = np.append(after, np.arange(size, size + 256, dtype=np.int32))  # what lies beyond stays there
        two = follow[follow]
        four = two[two]
        far_on, path, place = memoryview(four[four]), [], at - 8 * lo
        while place < size:
            path.append(place)
            place = far_on[place]
        path = np.array(path, np.int64)
        path = np.stack([path, two[path], four[path], two[four[path]]], 1)
        path = np.stack([path, follow[path]], 2).reshape(-1)
        path = path[: np.searchsorted(path, size)]
        sym = (hit[path] >> 4).astype(np.int64)
        count, dist, pixel = np.ones(len(path), np.int64), np.zeros(len(path), np.int64), np.zeros(len(path), np.uint32)
        place = path + (hit[path] & 15)
        refers = np.flatnonzero(sym >= 256)
        literal = np.flatnonzero(sym < 256)
        if len(refers):
            base = 8 * lo
            count[refers], q = _values(sym[refers] - 256, raw, base + place[refers])
            distance = look(far, q - base)
            dist[refers], _ = _values(distance >> 4, raw, q + (distance & 15))
        value = sym[literal] << 8
        place = place[literal]
        for c, shift in others:
            found = look(c, place)
            value |= (found >> 4).astype(np.int64) << shift
            place = place + (found & 15)
        pixel[literal] = value
        total = np.cumsum(count)
        keep = int(np.searchsorted(total, left, "left")) + 1
        if keep <= len(path):  # the last symbol is here
            if total[keep - 1] != left:
                raise ValueError("a reference outside the image")
            at = 8 * lo + int(follow[path[keep - 1]])
            left = 0
        else:
            at, left = 8 * lo + int(follow[path[-1]]), left - int(total[-1])
        pixels.append(pixel[:keep])
        counts.append(count[:keep])
        dists.append(dist[:keep])
    bits.at = at
    return np.concatenate(pixels), np.concatenate(counts), np.concatenate(dists)


_NEAR_X, _NEAR_Y = (np.array(x, np.int64) for x in zip(*NEAR))


def _plain_pixels(bits: Bits, codes: list[Prefix], width: int, n: int) -> np.ndarray:
    """The ARGB words of an image with one group of codes and no cache."""
    pixel, count, code = _symbols(bits, codes, n)
    refers = np.flatnonzero(code)
    if not len(refers):
        return pixel
    near = np.minimum(code[refers], 120) - 1
    dist = np.where(code[refers] > 120, code[refers] - 120, np.maximum(_NEAR_X[near] + _NEAR_Y[near] * width, 1))
    start = np.cumsum(count) - count
    if (dist > start[refers]).any():
        raise ValueError("a reference outside the image")
    out = np.repeat(pixel, count)
    size = count[refers]
    own = np.repeat(start[refers] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    source = np.arange(n)
    source[own] = own - np.repeat(dist, size)
    at = source[own]
    while True:  # references to references: each round doubles the way that is followed
        back = source[at]
        if np.array_equal(back, at):
            break
        source[own] = at = back
    out[own] = out[at]
    return out


def _read_image(bits: Bits, width: int, height: int, main: bool, seen: dict) -> np.ndarray:
    """An entropy-coded image: ARGB words."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of more than 11 bits")
    meta, meta_bits, per_row = None, 0, 0
    groups = 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        per_row = -(-width // (1 << meta_bits))
        meta = (_read_image(bits, per_row, -(-height // (1 << meta_bits)), False, seen) >> 8 & 0xFFFF).tolist()
        groups = max(meta) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_prefix(bits, s, seen) for s in sizes] for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_bits:
        return _plain_pixels(bits, codes[0], width, n)
    pixels = [0] * n
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    i = 0
    while i < n:
        if meta is not None:
            green, red, blue, alpha, far = codes[meta[(i // width >> meta_bits) * per_row + (i % width >> meta_bits)]]
        else:
            green, red, blue, alpha, far = codes[0]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            made, count = alpha.read(bits) << 24 | r << 16 | s << 8 | b, 1
            pixels[i] = made
        elif s < 280:
            count = _value(s - 256, bits)
            d = _value(far.read(bits), bits)
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > i or i + count > n:
                raise ValueError("a reference outside the image")
            for k in range(i, i + count):
                pixels[k] = pixels[k - d]
        else:
            count = 1
            pixels[i] = cache[s - 280]
        if cache_bits:
            for k in range(i, i + count):
                cache[HASH * pixels[k] >> shift & (1 << cache_bits) - 1] = pixels[k]
        i += count
    return np.array(pixels, np.uint32)


def _mean(a: int, b: int) -> int:
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def _bytes(x: int) -> tuple[int, int, int, int]:
    return x >> 24, x >> 16 & 255, x >> 8 & 255, x & 255


def _word(parts) -> int:
    a, r, g, b = (min(max(p, 0), 255) for p in parts)
    return a << 24 | r << 16 | g << 8 | b


def predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predicted ARGB word from the neighbours: left, top, top right and top left."""
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode == 6:
        return _mean(left, corner)
    if mode == 7:
        return _mean(left, top)
    if mode == 8:
        return _mean(corner, top)
    if mode == 9:
        return _mean(top, right)
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(_bytes(top), _bytes(corner)))
        to_top = sum(abs(x - c) for x, c in zip(_bytes(left), _bytes(corner)))
        return left if to_left < to_top else top
    if mode == 12:
        return _word(x + t - c for x, t, c in zip(_bytes(left), _bytes(top), _bytes(corner)))
    if mode == 13:
        return _word(m + int((m - c) / 2) for m, c in zip(_bytes(_mean(left, top)), _bytes(corner)))
    return 0xFF000000


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _guess(pixels: list[int], i: int, width: int, modes, bits: int, per_row: int) -> int:
    x, y = i % width, i // width
    if i == 0:
        return 0xFF000000
    if y == 0:
        return pixels[i - 1]
    if x == 0:
        return pixels[i - width]
    return predict(modes[(y >> bits) * per_row + (x >> bits)], pixels[i - 1], pixels[i - width], pixels[i - width + 1], pixels[i - width - 1])


def _undo_predictor(image: np.ndarray, width: int, bits: int, data: np.ndarray) -> np.ndarray:
    per_row, modes = -(-width // (1 << bits)), (data >> 8 & 15).tolist()
    out = image.tolist()
    for i in range(len(out)):
        out[i] = _add(out[i], _guess(out, i, width, modes, bits, per_row))
    return np.array(out, np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def _cross(image: np.ndarray, width: int, bits: int, data: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) the correlated parts of red and blue."""
    y, x = np.divmod(np.arange(len(image)), width)
    m = data[(y >> bits) * -(-width // (1 << bits)) + (x >> bits)]
    green, red, blue = (_signed(image >> s & 255) for s in (8, 16, 0))
    new_red = (image >> 16 & 255).astype(np.int32) + sign * (_signed(m & 255) * green >> 5)
    source = _signed(new_red & 255) if sign > 0 else red
    new_blue = blue + sign * ((_signed(m >> 8 & 255) * green >> 5) + (_signed(m >> 16 & 255) * source >> 5))
    return (image & np.uint32(0xFF00FF00)) | (new_red & 255).astype(np.uint32) << np.uint32(16) | (new_blue & 255).astype(np.uint32)


def _green(image: np.ndarray, sign: int) -> np.ndarray:
    g = (image >> 8 & 255).astype(np.int64) * sign
    return (image & np.uint32(0xFF00FF00)) | ((image >> 16 & 255) + g & 255).astype(np.uint32) << np.uint32(16) | ((image & 255) + g & 255).astype(np.uint32)


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(image: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    pack = _pack_bits(len(table))
    step = 8 >> pack
    packed = (image >> 8 & 255).reshape(height, -1)
    index = np.stack([packed >> (k * step) & ((1 << step) - 1) for k in range(1 << pack)], 2).reshape(height, -1)[:, :width].reshape(-1)
    return np.append(table, np.zeros(256, np.uint32))[index]  # an index beyond the table is transparent black


_SEEN: dict = {}


def chunks_of(data: bytes) -> dict[bytes, bytes]:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, i, end = {}, 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))
    while i + 8 <= end:
        n = int.from_bytes(data[i + 4 : i + 8], "little")
        out.setdefault(data[i : i + 4], data[i + 8 : i + 8 + n])
        i += 8 + n + (n & 1)
    return out


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file."""
    body = chunks_of(data).get(b"VP8L")
    if body is None or body[:1] != b"\x2f":
        raise ValueError("no lossless image")
    bits = Bits(body + b"\0" * 8, 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    if len(_SEEN) >= 4096:
        _SEEN.clear()
    undo, coded = [], width
    used = set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in used:
            raise ValueError("a transform used twice")
        used.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            size = bits.read(3) + 2
            sub = _read_image(bits, -(-coded // (1 << size)), -(-height // (1 << size)), False, _SEEN)
            undo.append((kind, coded, size, sub))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = _read_image(bits, n, 1, False, _SEEN)
            parts = np.cumsum(steps.astype(np.int64)[:, None] >> np.array([24, 16, 8, 0]) & 255, axis=0) & 255
            undo.append((kind, coded, 0, (parts << np.array([24, 16, 8, 0])).sum(1).astype(np.uint32)))
            coded = -(-coded // (1 << _pack_bits(n)))
        else:
            undo.append((kind, coded, 0, None))
    image = _read_image(bits, coded, height, True, _SEEN)
    if bits.at > 8 * len(body):
        raise ValueError("the bit stream ends early")
    for kind, wide, size, sub in reversed(undo):
        if kind == PREDICTOR:
            image = _undo_predictor(image, wide, size, sub)
        elif kind == CROSS_COLOR:
            image = _cross(image, wide, size, sub, 1)
        elif kind == SUBTRACT_GREEN:
            image = _green(image, 1)
        else:
            image = _undo_palette(image, wide, height, sub)
    return image.view(np.uint8).reshape(height, width, 4)[:, :, [2, 1, 0, 3]]


class Out:
    """Writes bits, least significant first."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append(np.array([value >> k & 1 for k in range(n)], np.uint8))

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def _put_prefix(out: Out, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (len(used) == 0 or used[-1] < 256):
        first = int(used[0]) if len(used) else 0
        out.put(1, 1)
        out.put(int(len(used) == 2), 1)
        out.put(int(first > 1), 1)
        out.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            out.put(int(used[1]), 8)
        return
    out.put(0, 1)
    tokens, i = [], 0
    size = int(used[-1]) + 1
    while i < size:
        j = i
        while j < size and lengths[j] == lengths[i]:
            j += 1
        n = j - i
        if lengths[i] == 0 and n >= 11:
            n = min(n, 138)
            tokens.append((18, n - 11, 7))
        elif lengths[i] == 0 and n >= 3:
            tokens.append((17, n - 3, 3))
        elif lengths[i] and i and lengths[i - 1] == lengths[i] and n >= 3:
            n = min(n, 6)
            tokens.append((16, n - 3, 2))
        else:
            n = 1
            tokens.append((int(lengths[i]), 0, 0))
        i += n
    own = code_lengths(np.bincount([t for t, _, _ in tokens], minlength=19), 7)
    last = max(k for k in range(19) if own[LENGTH_ORDER[k]])
    last = max(last, 3)
    out.put(last - 3, 4)
    for k in range(last + 1):
        out.put(int(own[LENGTH_ORDER[k]]), 3)
    if size == len(lengths):
        out.put(0, 1)
    else:
        out.put(1, 1)
        n = max(1, (len(tokens) - 2).bit_length()) if len(tokens) > 2 else 1
        n = max(2, n + n % 2)
        out.put((n - 2) // 2, 3)
        out.put(max(0, len(tokens) - 2), n)
    codes = canonical(own)
    single = np.count_nonzero(own) == 1
    for t, extra, n in tokens:
        if not single:
            out.put(_reversed(int(codes[t]), int(own[t])), int(own[t]))
        out.put(extra, n)


def _split_value(v: int) -> tuple[int, int, int]:
    """The prefix, extra bits and their number of a length or distance."""
    v -= 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v & ((1 << (top - 1)) - 1), top - 1


def _put_image(out: Out, image: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False, meta_bits: int = 0) -> None:
    pixels = image.tolist()
    n, height = len(pixels), -(-len(pixels) // width)
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    per_row, groups = width, 1
    if main:
        out.put(int(meta_bits > 0), 1)
        if meta_bits:
            out.put(meta_bits - 2, 3)
            per_row = -(-width // (1 << meta_bits))
            rows = -(-height // (1 << meta_bits))
            groups = min(3, per_row * rows)
            _put_image(out, (np.arange(per_row * rows, dtype=np.uint32) % groups) << np.uint32(8), per_row, False)
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    symbols, i, last, cache = [], 0, {}, [0] * (1 << cache_bits)
    while i < n:
        group = ((i // width >> meta_bits) * per_row + (i % width >> meta_bits)) % groups if meta_bits else 0
        count, d = 0, 0
        if references and tuple(pixels[i : i + 3]) in last:
            d = i - last[tuple(pixels[i : i + 3])]
            while i + count < n and count < 4096 and pixels[i + count] == pixels[i + count - d]:
                count += 1
        slot = HASH * pixels[i] >> (32 - cache_bits) & (1 << cache_bits) - 1 if cache_bits else 0
        if count >= 3:
            code = near.get(d, d + 120)
            symbols.append((group, 256 + _split_value(count)[0], _split_value(count)[1:], _split_value(code)))
        elif cache_bits and cache[slot] == pixels[i]:
            symbols.append((group, 280 + slot, None, None))
            count = 1
        else:
            symbols.append((group, pixels[i] >> 8 & 255, None, pixels[i]))
            count = 1
        for k in range(i, i + count):
            last[tuple(pixels[k : k + 3])] = k
            if cache_bits:
                cache[HASH * pixels[k] >> (32 - cache_bits) & (1 << cache_bits) - 1] = pixels[k]
        i += count
    counts = [[np.zeros(s, np.int64) for s in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    for g, s, extra, rest in symbols:
        counts[g][0][s] += 1
        if s < 256:
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                counts[g][k][rest >> shift & 255] += 1
        elif s < 280:
            counts[g][4][rest[0]] += 1
    lengths = [[code_lengths(c, 15) for c in group] for group in counts]
    for group in lengths:
        for c in group:
            _put_prefix(out, c)
    codes = [[canonical(c) for c in group] for group in lengths]

    def put(g: int, k: int, s: int) -> None:
        if np.count_nonzero(lengths[g][k]) > 1:
            out.put(_reversed(int(codes[g][k][s]), int(lengths[g][k][s])), int(lengths[g][k][s]))

    for g, s, extra, rest in symbols:
        put(g, 0, s)
        if s < 256:
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                put(g, k, rest >> shift & 255)
        elif s < 280:
            out.put(*extra)
            put(g, 4, rest[0])
            out.put(*rest[1:])


def _riff(body: bytes, more: bytes = b"") -> bytes:
    inner = b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1) + more
    return b"RIFF" + struct.pack("<I", len(inner)) + inner


def _start(width: int, height: int) -> Out:
    if not (0 < width <= 1 << 14 and 0 < height <= 1 << 14):
        raise ValueError("a side of 1 to 16384 pixels")
    out = Out()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    return out


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, references: bool = False, meta_bits: int = 0, block_bits: int = 2, seed: int = 0) -> bytes:
    """A lossless WebP file of RGBA pixels, with these transforms in this order. Modes of blocks follow ``seed``."""
    height, width, _ = pixels.shape
    out = _start(width, height)
    image = np.ascontiguousarray(pixels[:, :, [2, 1, 0, 3]]).view(np.uint32).reshape(-1)
    random = np.random.default_rng(seed)
    coded = width
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        per_row, rows = -(-coded // (1 << block_bits)), -(-height // (1 << block_bits))
        if kind == PREDICTOR:
            modes = random.integers(0, 14, per_row * rows)
            flat = image.tolist()
            guessed = np.array([_guess(flat, i, coded, modes.tolist(), block_bits, per_row) for i in range(len(flat))], np.uint32)
            image = sum(((image >> np.uint32(s) & 255) - (guessed >> np.uint32(s) & 255) & np.uint32(255)) << np.uint32(s) for s in (0, 8, 16, 24))
            out.put(block_bits - 2, 3)
            _put_image(out, (modes << 8).astype(np.uint32), per_row, False)
        elif kind == CROSS_COLOR:
            data = random.integers(0, 1 << 24, per_row * rows).astype(np.uint32)
            image = _cross(image, coded, block_bits, data, -1)
            out.put(block_bits - 2, 3)
            _put_image(out, data, per_row, False)
        elif kind == SUBTRACT_GREEN:
            image = _green(image, -1)
        else:
            table, index = np.unique(image, return_inverse=True)
            if len(table) > 256:
                raise ValueError("more than 256 colours")
            out.put(len(table) - 1, 8)
            steps = np.diff(table.astype(np.int64)[:, None] >> np.array([24, 16, 8, 0]) & 255, axis=0, prepend=0) & 255
            _put_image(out, (steps << np.array([24, 16, 8, 0])).sum(1).astype(np.uint32), len(table), False)
            pack = _pack_bits(len(table))
            wide = -(-coded // (1 << pack))
            grid = np.zeros((height, wide << pack), np.uint32)
            grid[:, :coded] = index.reshape(height, coded)
            image = sum(grid[:, k :: 1 << pack] << np.uint32(k * (8 >> pack)) for k in range(1 << pack)).reshape(-1) << np.uint32(8)
            coded = wide
    out.put(0, 1)
    _put_image(out, image, coded, True, cache_bits, references, meta_bits)
    return _riff(out.bytes())


#: Bytes that a reference repeats at least and at most; longest codes; how far a reference reaches.
LEAST, MOST, LIMIT, REACH = 5, 4096, 13, (1 << 20) - 121
#: A fixed code for code lengths 0 to LIMIT and runs of zeros: four bits each.
_LENGTHS = (*range(LIMIT + 1), 17, 18)
#: Samples that are searched for repeats together, and whose symbols are kept between counting and writing.
SPAN, KEPT = 1 << 17, 4 << 20


def _split_values(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefixes, extra bits and their numbers of lengths or distances."""
    v = v.astype(np.int64) - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1)), v & ((1 << extra) - 1), extra


class _Tokens:
    """Literals and references of runs of samples: sym of the green code, distance prefix (-1: none), and their extra bits."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(data)
        key = data.astype(np.int64) << 20
        for k in range(1, LEAST):
            key[: n - k] |= data[k:].astype(np.int64) << (8 * k + 20)
        key |= np.arange(n)
        key = np.delete(key, np.maximum(at[1:, None] - np.arange(1, LEAST), at[:-1, None]).reshape(-1))  # nothing is repeated across an end
        key.sort()
        same = np.flatnonzero(key[1:] >> 20 == key[:-1] >> 20)
        a, b = key[same] & 0xFFFFF, key[same + 1] & 0xFFFFF
        del key
        owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
        here = (owner[a] == owner[b]) & (b - a <= REACH)
        back = np.zeros(n + 1, np.int32)
        back[b[here]] = (b - a)[here]
        # a run of places of one distance is one repeat: each of them repeats as far as the run goes
        cut = np.flatnonzero(back[1:] != back[:-1]) + 1
        start = np.concatenate([[0], cut]) if n else cut[:0]
        end = np.append(cut, n + 1)[: len(start)]
        some = back[start] > 0
        start, end = start[some], end[some]
        began, stop = start.tolist(), end.tolist()
        refs, length, at_ = [], [], 0
        for i, j in zip(began, stop):
            i = i if i > at_ else at_
            while i < j:
                m = j - i + LEAST - 1
                m = m if m < MOST else MOST
                refs.append(i)
                length.append(m)
                i += m
                at_ = i
        refs, length = np.array(refs, np.int64), np.array(length, np.int64)
        cover = np.zeros(n + 1, np.int32)
        cover[refs] += 1
        np.subtract.at(cover, refs + length, 1)
        literal = np.cumsum(cover[:n]) == 0
        literal[refs] = True
        where = np.flatnonzero(literal)
        spot = np.searchsorted(where, refs)
        self.doc = owner[where].astype(np.int64)
        self.sym, self.extra, self.bits = data[where].astype(np.int64), np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        prefix, self.extra[spot], self.bits[spot] = _split_values(length)
        self.sym[spot] = 256 + prefix
        self.far, self.far_extra, self.far_bits = np.full(len(where), -1), np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        self.far[spot], self.far_extra[spot], self.far_bits[spot] = _split_values(back[refs].astype(np.int64) + 120)


def code_lengths_of(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits for each row of counts, by package-merge on all rows side by side."""
    rows, size = counts.shape
    n = (counts > 0).sum(1)
    wide = max(2, int(n.max(initial=0)))
    if wide > 1 << limit:
        raise ValueError(f"{wide} symbols need more than {limit} bits")
    weight = np.where(counts > 0, counts, np.inf)
    order = np.argsort(weight, 1, kind="stable")[:, :wide]
    leaf = np.take_along_axis(weight, order, 1)
    merged, marks = np.zeros((rows, 0)), []
    for _ in range(limit):
        pack = merged[:, : merged.shape[1] // 2 * 2].reshape(rows, -1, 2).sum(2)
        both = np.concatenate([leaf, pack], 1)
        by = np.argsort(both, 1, kind="stable")
        merged = np.take_along_axis(both, by, 1)
        marks.append(np.cumsum(by < wide, 1))
    take, own = np.maximum(2 * n - 2, 0), np.zeros((rows, wide), np.int64)
    for mark in reversed(marks):
        take = np.minimum(take, mark.shape[1])
        leaves = np.where(take > 0, np.take_along_axis(mark, np.maximum(take - 1, 0)[:, None], 1)[:, 0], 0)
        own += np.arange(wide) < leaves[:, None]
        take = 2 * (take - leaves)
    own[n == 1, 0] = 1
    out = np.zeros((rows, size), np.int64)
    np.put_along_axis(out, order, np.where(np.isfinite(leaf), own, 0), 1)
    return out


def codes_of(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The canonical codes of each row of lengths, first bit lowest."""
    rank = np.where(lengths > 0, lengths, limit + 1)
    order = np.argsort(rank, 1, kind="stable")
    size = np.take_along_axis(rank, order, 1)
    span = np.where(size <= limit, 1 << np.maximum(limit - size, 0), 0)
    first = np.cumsum(span, 1) - span
    out = np.zeros(lengths.shape, np.int64)
    np.put_along_axis(out, order, _mirror(limit)[np.where(size <= limit, first, 0)], 1)
    return out  # bits of the mirrored number beyond the length are zero


def _length_items(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, values and bit numbers that write each row of lengths: the fixed code, then lengths and runs of zeros."""
    rows, size = lengths.shape
    flat = lengths.reshape(-1)
    change = np.append(True, flat[1:] != flat[:-1])
    change[::size] = True
    start = np.flatnonzero(change)
    count, value = np.diff(np.append(start, len(flat))), flat[start]
    full = np.where(value == 0, count // 138, 0)
    rest = count - 138 * full
    alone = np.where((value > 0) | (rest < 3), rest, 0)
    last = (value == 0) & (rest >= 3)
    n = full + alone + last
    run = np.repeat(np.arange(len(start)), n)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    long = nth < full[run]
    tail = ~long & last[run]
    extra = np.where(long, 127, np.where(tail, np.where(rest[run] >= 11, rest[run] - 11, rest[run] - 3), 0))
    eleven = long | tail & (rest[run] >= 11)
    code = np.where(eleven, 15, np.where(tail, 14, value[run]))
    items = _mirror(4)[code] | extra << 4, 4 + np.where(eleven, 7, np.where(tail, 3, 0))
    head = [(15 << 1, 5), (sum((4 if k in _LENGTHS else 0) << 3 * i for i, k in enumerate(LENGTH_ORDER[:12])), 36), (sum((4 if k in _LENGTHS else 0) << 3 * i for i, k in enumerate(LENGTH_ORDER[12:])), 21), (0, 1)]
    which = np.concatenate([np.repeat(np.arange(rows), len(head)), start[run] // size])
    order = np.argsort(which, kind="stable")
    return which[order], np.concatenate([np.tile([v for v, _ in head], rows), items[0]])[order], np.concatenate([np.tile([k for _, k in head], rows), items[1]])[order]


def _write(doc: np.ndarray, value: np.ndarray, bits: np.ndarray, base: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Puts items (at most 57 bits), in the order of their documents, into a stream of 64-bit words from each document's
    bit ``base`` on; returns the bits after."""
    total = np.cumsum(bits) - bits
    count = np.bincount(doc, minlength=len(base))
    first = np.append(total, bits.sum())[np.cumsum(count) - count]
    at = total - first[doc] + base[doc]
    shift = (at & 63).astype(np.uint64)
    np.bitwise_or.at(words, at >> 6, value.astype(np.uint64) << shift)
    over = np.flatnonzero(shift.astype(np.int64) + bits > 64)
    np.bitwise_or.at(words, (at[over] >> 6) + 1, value[over].astype(np.uint64) >> (np.uint64(64) - shift[over]))
    return base + np.bincount(doc, bits, len(base)).astype(np.int64)


def _palette(samples: np.ndarray, width: int) -> tuple[np.ndarray, int, list[tuple[int, int]]]:
    """Samples of at most 16 kinds as indices, several to a byte: packed samples, their width, and the transform's items."""
    kinds = np.flatnonzero(np.bincount(samples, minlength=256))
    rank = np.zeros(256, np.uint8)
    rank[kinds] = np.arange(len(kinds))
    pack = _pack_bits(len(kinds))
    step = 8 >> pack
    wide = -(-width // (1 << pack))
    grid = np.zeros((len(samples) // width, wide << pack), np.uint8)
    grid[:, :width] = rank[samples].reshape(-1, width)
    packed = np.bitwise_or.reduce([grid[:, k :: 1 << pack] << (k * step) for k in range(1 << pack)]).reshape(-1)
    steps = np.diff(kinds, prepend=0).astype(np.uint32) << np.uint32(8)
    steps[0] |= np.uint32(0xFF000000)
    out = Out()
    out.put(1, 1)
    out.put(PALETTE, 2)
    out.put(len(kinds) - 1, 8)
    _put_image(out, steps, len(kinds), False)
    flat = np.concatenate(out.parts)
    parts = [flat[i : i + 48] for i in range(0, len(flat), 48)]
    return packed, wide, [(int((x.astype(np.int64) << np.arange(len(x))).sum()), len(x)) for x in parts]


def encode_samples(runs: list[np.ndarray], widths: list[int], more: list[bytes]) -> list[bytes]:
    """A lossless WebP file for each run of samples (a multiple of its width): opaque pixels whose green is the sample. Samples
    take prefix codes from their counts, repeats of LEAST samples and more are references, and runs of at most 16
    kinds of samples have a palette, whose indices share bytes. All runs are coded side by side."""
    count = len(runs)
    heads: list[list[tuple[int, int]]] = []
    samples = []
    for x, w in zip(runs, widths):
        head = [(0x2F, 8), (w - 1, 14), (len(x) // w - 1, 14), (0, 4)]
        if len(np.flatnonzero(np.bincount(x[: 1 << 16], minlength=256))) <= 16 and len(np.flatnonzero(np.bincount(x, minlength=256))) <= 16:
            x, w, extra = _palette(x, w)
            head += extra
        samples.append(x)
        heads.append([*head, (0, 3)])  # no more transforms, no cache, one group of codes
    spans, at = [], 0
    pieces = [(k, x[i : i + SPAN]) for k, x in enumerate(samples) for i in range(0, len(x), SPAN)]
    while at < len(pieces):  # whole runs together as far as SPAN goes; a longer one piece by piece
        stop, held = at + 1, len(pieces[at][1])
        while stop < len(pieces) and held + len(pieces[stop][1]) <= SPAN:
            held += len(pieces[stop][1])
            stop += 1
        spans.append(pieces[at:stop])
        at = stop

    def tokens():
        for span in spans:
            t = _Tokens(np.concatenate([x for _, x in span]), np.concatenate([[0], np.cumsum([len(x) for _, x in span])]))
            t.doc = np.array([k for k, _ in span])[t.doc]
            yield t

    few = sum(map(len, samples)) <= KEPT
    greens, fars, kept = np.zeros((count, 280), np.int64), np.zeros((count, 40), np.int64), []
    for t in tokens():
        greens += np.bincount(t.doc * 280 + t.sym, minlength=count * 280).reshape(count, 280)
        on = t.far >= 0
        fars += np.bincount(t.doc[on] * 40 + t.far[on], minlength=count * 40).reshape(count, 40)
        if few:
            kept.append(t)
    fars[fars.sum(1) == 0, 0] = 1
    green, far = code_lengths_of(greens), code_lengths_of(fars)
    green_code, far_code = codes_of(green), codes_of(far)
    first = np.repeat(np.arange(count), [len(h) for h in heads]), *np.array([i for h in heads for i in h], np.int64).T
    middle = np.arange(count), np.full(count, 0x7FD << 8 | 1 << 4 | 1), np.full(count, 19)  # red and blue 0, alpha 255
    parts = [first, _length_items(green), middle, _length_items(far)]
    green, far = (np.where((x > 0).sum(1, keepdims=True) == 1, 0, x) for x in (green, far))  # of one symbol: no bits
    size = sum(np.bincount(d, b, count) for d, _, b in parts) + (greens * green).sum(1) + (fars * far).sum(1)
    prefix = np.arange(280) - 256
    size += (greens * np.where(prefix >= 4, (prefix - 2) >> 1, 0)).sum(1) + (fars * np.where(np.arange(40) >= 4, (np.arange(40) - 2) >> 1, 0)).sum(1)
    size = -(-size.astype(np.int64) // 8)
    start = np.concatenate([[0], np.cumsum(size)])
    words = np.zeros(int(start[-1]) // 8 + 3, np.uint64)
    base = start[:-1] * 8
    for doc, value, bits in parts:
        base = _write(doc, value, bits, base, words)
    for t in kept or tokens():
        value, bits = green_code[t.doc, t.sym] * (green[t.doc, t.sym] > 0), green[t.doc, t.sym]
        value, bits = value | t.extra << bits, bits + t.bits
        on = np.flatnonzero(t.far >= 0)
        d, f = t.doc[on], t.far[on]
        value[on] |= far_code[d, f] * (far[d, f] > 0) << bits[on]
        bits[on] += far[d, f]
        value[on] |= t.far_extra[on] << bits[on]
        bits[on] += t.far_bits[on]
        base = _write(t.doc, value, bits, base, words)
    raw = words.astype("<u8").tobytes()
    return [_riff(raw[i:j], m) for i, j, m in zip(start, start[1:], more)]
