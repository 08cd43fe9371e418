"""Lossless WebP, many images at a time.

``decode`` reads RIFF files with a VP8L chunk: prefix codes (simple and normal, with several groups chosen by an entropy
image), back-references, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms. ``encode``
writes them. Both work on all images of a batch in step: numpy holds one bit position for each image, so the cost of a step
is shared by the batch. An image of over LONG pixels is read by itself: of every bit position the length of a symbol that
would begin there is looked up at once, and one walk along these lengths finds where symbols do begin. Pixels are 32-bit
numbers, alpha in the highest byte, then red, green and blue.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

_U = np.uint64

# Fixed values of the format.
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_ORDER = np.array([17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15])
LENGTH_CODES, DISTANCE_CODES, MAX_BITS = 24, 40, 15
CACHE_FACTOR = 0x1E35A7BD
SIGNATURE = 0x2F
OPAQUE = 0xFF000000
#: Short distances are given by place: nearest first, then by column distance, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
_NEAR = np.array(NEAR)


def _reversals(bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, np.int64)
    for k in range(bits):
        out |= (np.arange(1 << bits) >> k & 1) << (bits - 1 - k)
    return out


_REV = [_reversals(b) for b in range(MAX_BITS + 1)]


class Bits:
    """Bit positions in one buffer, least significant bit first."""

    def __init__(self, parts: list[bytes]):
        size = np.array([len(p) for p in parts], np.int64)
        raw = np.frombuffer(b"".join(parts) + b"\0" * 16, np.uint8)
        self.raw = raw
        self.start = (np.cumsum(size) - size) * 8
        self.pos = self.start.copy()
        self.end = self.start + size * 8
        n = len(raw) - 8
        self.words = np.zeros(n, _U)
        for k in range(8):
            self.words |= raw[k : n + k].astype(_U) << _U(8 * k)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits or more of each image."""
        p = self.pos[at]
        return self.words[np.minimum(p >> 3, len(self.words) - 1)] >> (p & 7).astype(_U)

    def read(self, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        if isinstance(n, (int, np.integer)):
            out = self.peek(at) & _U((1 << int(n)) - 1)
        else:
            out = self.peek(at) & ((_U(1) << n.astype(_U)) - _U(1))
        self.pos[at] += n
        return out.astype(np.int64)


@dataclass
class Codes:
    """Prefix codes with one table of 2**bits entries each: symbol << 4 | length, in the order of the code's bits."""

    bits: int
    table: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray) -> Codes:
        """From a row of code lengths for each code. A code of one symbol has length 0; one of none gives symbol 0."""
        used = (lengths > 0).sum(axis=1)
        rows, symbols = np.nonzero(lengths)
        size = lengths[rows, symbols].astype(np.int64)
        size[used[rows] == 1] = 0
        bits = max(1, int(size.max(initial=0)))
        order = np.lexsort((symbols, size, rows))
        rows, symbols, size = rows[order], symbols[order], size[order]
        share = np.int64(1) << (bits - size)
        filled = np.bincount(rows, weights=share, minlength=len(lengths)).astype(np.int64)
        if np.any((filled != 1 << bits) & (used > 0)):
            raise ValueError("a prefix code is not complete")
        entries = np.repeat(symbols << 4 | size, share)
        if np.all(used > 0):
            return Codes(bits, entries)
        table = np.zeros((len(lengths), 1 << bits), np.int64)
        table[used > 0] = entries.reshape(-1, 1 << bits)
        return Codes(bits, table.reshape(-1))

    def by_window(self, code: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and lengths of one code, by the next ``bits`` bits of the stream."""
        e = self.table[code << self.bits : (code + 1) << self.bits][_REV[self.bits]]
        return (e >> 4).astype(np.int32), (e & 15).astype(np.int32)

    def look(self, code: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.table[(code << self.bits) + _REV[self.bits][(word & _U((1 << self.bits) - 1)).astype(np.int64)]]


def _read_lengths(b: Bits, at: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Code lengths of one prefix code of each image in at."""
    out = np.zeros((len(at), int(alphabet.max())), np.int8)
    simple = b.read(at, 1) == 1
    k = np.flatnonzero(simple)
    if len(k):
        two = b.read(at[k], 1) == 1
        wide = b.read(at[k], 1) == 1
        first = np.empty(len(k), np.int64)
        first[wide] = b.read(at[k[wide]], 8)
        first[~wide] = b.read(at[k[~wide]], 1)
        out[k, first] = 1
        out[k[two], b.read(at[k[two]], 8)] = 1
    k = np.flatnonzero(~simple)
    if not len(k):
        return out
    count = 4 + b.read(at[k], 4)
    inner = np.zeros((len(k), 19), np.int8)
    for i in range(19):
        has = np.flatnonzero(i < count)
        if len(has):
            inner[has, LENGTH_ORDER[i]] = b.read(at[k[has]], 3)
    codes = Codes.of(inner)
    limit = alphabet[k].astype(np.int64)
    told = np.flatnonzero(b.read(at[k], 1) == 1)
    left = limit.copy()
    if len(told):
        n = 2 + 2 * b.read(at[k[told]], 3)
        left[told] = 2 + b.read(at[k[told]], n)
    place, last = np.zeros(len(k), np.int64), np.full(len(k), 8, np.int64)
    live = np.arange(len(k))
    while len(live):
        who = at[k[live]]
        e = codes.look(live, b.peek(who))
        b.pos[who] += e & 15
        symbol = e >> 4
        left[live] -= 1
        plain = symbol < 16
        p = live[plain]
        out[k[p], np.minimum(place[p], out.shape[1] - 1)] = symbol[plain]
        place[p] += 1
        fresh = p[symbol[plain] > 0]
        last[fresh] = symbol[plain][symbol[plain] > 0]
        for code, extra, least in ((16, 2, 3), (17, 3, 3), (18, 7, 11)):
            r = live[symbol == code]
            if len(r):
                n = least + b.read(at[k[r]], extra)
                if code == 16:
                    for i, m in zip(r.tolist(), n.tolist(), strict=True):
                        out[k[i], place[i] : place[i] + m] = last[i]
                place[r] += n
        live = live[(place[live] < limit[live]) & (left[live] > 0)]
    return out


def _extended(b: Bits, at: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The length or distance that a prefix and its extra bits mean."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
    return base + b.read(at, extra) + 1


def _distance(far: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Pixels back that a distance number means in an image of that width."""
    near = far <= len(NEAR)
    xy = _NEAR[np.where(near, far, 1) - 1]
    return np.where(near, np.maximum(1, xy[:, 0] + xy[:, 1] * width), far - len(NEAR))


#: Images of more pixels are read by themselves, WALK_BYTES of the stream at a time.
LONG, WALK_BYTES = 4096, 1 << 18
_EXTRA = np.array([0 if k < 4 else (k - 2) >> 1 for k in range(DISTANCE_CODES)], np.int32)


def _read_long(b: Bits, who: int, codes: tuple[Codes, ...], code: int, width: int, size: int, cache_bits: int) -> np.ndarray | None:
    """Pixels of one image with one group of codes; None if a symbol may take no bits, so that a walk would not move."""
    tables = [c.by_window(code) for c in codes]
    masks = [(1 << c.bits) - 1 for c in codes]
    (green, green_len), *rest, (far, far_len) = tables
    if int(green_len.min()) == 0:
        return None
    out = np.zeros(size, np.int64)
    cache = np.zeros(1 << cache_bits if cache_bits else 0, np.int64)
    done = cached = 0

    def fill_cache(upto: int) -> None:
        nonlocal cached
        if cache_bits and upto > cached:
            px = out[cached:upto]
            cache[_slot(px, np.int64(cache_bits))] = px  # of equal slots the last counts
            cached = upto

    while done < size:
        if b.pos[who] >= b.end[who]:
            raise ValueError("a stream ends too early")
        first = int(b.pos[who]) >> 3
        n = min(WALK_BYTES, (int(b.end[who]) >> 3) - first + 1)
        held = np.zeros(n + 24, np.uint32)  # and what a symbol that begins in the last byte may take
        raw = b.raw[first : first + n + 27].astype(np.uint32)
        for k in range(4):
            part = raw[k : k + n + 24]
            held[: len(part)] |= part << np.uint32(8 * k)
        window = (held[:, None] >> np.arange(8, dtype=np.uint32)).astype(np.uint16).reshape(-1)
        bits = 8 * n
        here = np.arange(bits, dtype=np.int32)
        at = here + green_len[window[:bits] & masks[0]]
        places = [at]
        for (_, length), mask in zip(rest, masks[1:4], strict=True):
            if length.any():
                at = at + length[window[at] & mask]
            places.append(at)
        symbol = green[window[:bits] & masks[0]]
        other = np.flatnonzero(symbol >= 256)
        after = places[-1].copy()
        after[other] = places[0][other]
        refs = other[symbol[other] < 256 + LENGTH_CODES]
        if len(refs):
            where = after[refs] + _EXTRA[symbol[refs] - 256]
            f = window[where] & masks[4]
            after[refs] = where + far_len[f] + _EXTRA[far[f]]
        steps, p, starts, most = memoryview(after), int(b.pos[who]) - 8 * first, [], size - done
        while p < bits and len(starts) < most:
            starts.append(p)
            p = steps[p]
        t = np.array(starts, np.int64)
        kind = symbol[t]
        length = np.ones(len(t), np.int64)
        ref = np.flatnonzero((kind >= 256) & (kind < 256 + LENGTH_CODES))
        word = lambda x: b.words[first + (x >> 3)] >> (x & 7).astype(_U)  # noqa: B023, E731
        value = lambda prefix, x: np.where(prefix < 4, prefix, (2 + (prefix & 1)) << _EXTRA[prefix]) + (word(x) & ((_U(1) << _EXTRA[prefix].astype(_U)) - _U(1))).astype(np.int64) + 1  # noqa: B023, E731
        back = np.empty(0, np.int64)
        if len(ref):
            prefix, x = kind[ref].astype(np.int64) - 256, places[0][t[ref]].astype(np.int64)
            length[ref] = value(prefix, x)
            x = x + _EXTRA[prefix]
            f = window[x] & masks[4]
            back = _distance(value(far[f].astype(np.int64), x + far_len[f]), width)
        begin = done + np.cumsum(length) - length
        keep = int(np.searchsorted(begin, size))  # what follows the last pixel is no symbol
        if keep < len(t):
            p = starts[keep]
            t, kind, length, begin = t[:keep], kind[:keep], length[:keep], begin[:keep]
            ref, back = ref[: int(np.searchsorted(ref, keep))], back[: int(np.searchsorted(ref, keep))]
        plain = np.flatnonzero(kind < 256)
        channel = [s[window[q[t[plain]]] & m] for (s, _), q, m in zip(rest, places[:3], masks[1:4], strict=True)]
        out[begin[plain]] = channel[2].astype(np.int64) << 24 | channel[0].astype(np.int64) << 16 | kind[plain].astype(np.int64) << 8 | channel[1]
        far_of = dict(zip(ref.tolist(), back.tolist(), strict=True))
        for k in np.flatnonzero(kind >= 256).tolist():
            to, m = int(begin[k]), int(length[k])
            if k in far_of:
                d = far_of[k]
                if d > to or m > size - to:
                    raise ValueError("a back-reference leaves the image")
                out[to : to + m] = out[to - d : to - d + m] if d >= m else np.resize(out[to - d : to], m)
            else:
                fill_cache(to)
                out[to] = cache[int(kind[k]) - 256 - LENGTH_CODES]
        done = int(begin[-1] + length[-1]) if len(t) else done
        fill_cache(done)
        b.pos[who] = 8 * first + p
    return out


def _slot(pixel: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return ((pixel.astype(_U) * _U(CACHE_FACTOR)) & _U(0xFFFFFFFF)).astype(np.int64) >> (32 - bits)


def _read_image(b: Bits, at: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of the entropy-coded images, one after the other, and where each starts."""
    n = len(at)
    size = width * height
    start = np.cumsum(size) - size
    cache_bits = np.zeros(n, np.int64)
    has = np.flatnonzero(b.read(at, 1) == 1)
    if len(has):
        cache_bits[has] = b.read(at[has], 4)
        if np.any((cache_bits[has] < 1) | (cache_bits[has] > 11)):
            raise ValueError("colour cache of a size that is not allowed")
    group_of, groups, tile = None, np.ones(n, np.int64), np.zeros(n, np.int64)
    if main:
        many = np.flatnonzero(b.read(at, 1) == 1)
        if len(many):
            tile[many] = b.read(at[many], 3) + 2
            w, h = (width[many] + (1 << tile[many]) - 1) >> tile[many], (height[many] + (1 << tile[many]) - 1) >> tile[many]
            map_px, map_start = _read_image(b, at[many], w, h, False)
            map_px = (map_px >> 8) & 0xFFFF
            for i, m in enumerate(many.tolist()):
                groups[m] = int(map_px[map_start[i] : map_start[i] + w[i] * h[i]].max()) + 1
            group_of = (many, map_px, map_start, w)
    first = np.cumsum(groups) - groups
    codes_of = np.repeat(np.arange(n), groups)
    total = len(codes_of)
    rank = np.arange(total) - first[codes_of]
    cache_size = np.where(cache_bits > 0, 1 << cache_bits, 0)
    alphabets = [256 + LENGTH_CODES + cache_size, 256, 256, 256, DISTANCE_CODES]
    lengths = [np.zeros((total, int(np.max(a))), np.int8) for a in alphabets]
    for r in range(int(groups.max(initial=0))):
        here = np.flatnonzero(rank == r)
        for c, a in enumerate(alphabets):
            limit = a[codes_of[here]] if isinstance(a, np.ndarray) else np.full(len(here), a)
            found = _read_lengths(b, at[codes_of[here]], limit)
            lengths[c][here, : found.shape[1]] = found
    green, red, blue, alpha, distance = (Codes.of(x) for x in lengths)
    out = np.zeros(int(size.sum()), np.int64)
    cache_at = np.cumsum(cache_size) - cache_size
    cache = np.zeros(int(cache_size.sum()), np.int64)
    cached = cache_bits > 0
    any_cache = bool(cached.any())
    roomy = green.bits + red.bits + blue.bits + alpha.bits <= 57
    done = np.zeros(n, np.int64)
    for i in np.flatnonzero((size > LONG) & (groups == 1)).tolist() if main else ():
        own = _read_long(b, int(at[i]), (green, red, blue, alpha, distance), int(first[i]), int(width[i]), int(size[i]), int(cache_bits[i]))
        if own is not None:
            out[start[i] : start[i] + size[i]] = own
            done[i] = size[i]
    live = np.flatnonzero(done < size)
    tiles = np.full(n, -1, np.int64)
    if group_of is not None:
        tiles[group_of[0]] = np.arange(len(group_of[0]))

    while len(live):
        who = at[live]
        code = first[live]
        if group_of is not None:
            t = tiles[live]
            x, y = done[live] % width[live], done[live] // width[live]
            mapped = np.flatnonzero(t >= 0)
            m = t[mapped]
            lm = live[mapped]
            code = code.copy()
            code[mapped] += group_of[1][group_of[2][m] + (y[mapped] >> tile[lm]) * group_of[3][m] + (x[mapped] >> tile[lm])]
        word = b.peek(who)
        e = green.look(code, word)
        used = e & 15
        symbol = e >> 4
        literal = symbol < 256
        plain = bool(literal.all())
        if plain:
            i, g, c, word = live, symbol, code, word >> used.astype(_U)
        else:
            k = np.flatnonzero(literal)
            i, g, c, word = live[k], symbol[k], code[k], word[k] >> used[k].astype(_U)
        b.pos[who] += used
        if len(i):
            e1 = red.look(c, word)
            word >>= (e1 & 15).astype(_U)
            e2 = blue.look(c, word)
            b.pos[at[i]] += (e1 & 15) + (e2 & 15)
            word = word >> (e2 & 15).astype(_U) if roomy else b.peek(at[i])
            e3 = alpha.look(c, word)
            b.pos[at[i]] += e3 & 15
            pixel = (e3 >> 4) << 24 | (e1 >> 4) << 16 | g << 8 | e2 >> 4
            out[start[i] + done[i]] = pixel
            done[i] += 1
            if any_cache:
                h = cached[i]
                j = i[h]
                cache[cache_at[j] + _slot(pixel[h], cache_bits[j])] = pixel[h]
        if not plain:
            hit = np.flatnonzero(symbol >= 256 + LENGTH_CODES)
            if len(hit):
                i = live[hit]
                pixel = cache[cache_at[i] + symbol[hit] - 256 - LENGTH_CODES]
                out[start[i] + done[i]] = pixel
                done[i] += 1
                cache[cache_at[i] + _slot(pixel, cache_bits[i])] = pixel
            ref = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTH_CODES))
            if len(ref):
                i = live[ref]
                length = _extended(b, at[i], symbol[ref] - 256)
                e = distance.look(code[ref], b.peek(at[i]))
                b.pos[at[i]] += e & 15
                far = _extended(b, at[i], e >> 4)
                far = _distance(far, width[i])
                if np.any(far > done[i]) or np.any(length > size[i] - done[i]):
                    raise ValueError("a back-reference leaves the image")
                for j, m, d in zip(i.tolist(), length.tolist(), far.tolist(), strict=True):
                    to = start[j] + done[j]
                    out[to : to + m] = out[to - d : to - d + m] if d >= m else np.resize(out[to - d : to], m)
                    done[j] += m
                    if cached[j]:
                        p = out[to : to + m]
                        cache[cache_at[j] + _slot(p, cache_bits[j])] = p
        live = live[done[live] < size[live]]
    return out, start


# -- transforms, on one image of shape (height, width, 4): blue, green, red, alpha ------------------------------------


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predict(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """The prediction of a pixel (last axis: channels) by one of the 14 modes."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255]), left.shape)
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode <= 9:
        return _average(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        by_left = np.abs(top - top_left).sum(axis=-1, keepdims=True)
        by_top = np.abs(left - top_left).sum(axis=-1, keepdims=True)
        return np.where(by_left < by_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = _average(left, top)
    off = mean - top_left
    return np.clip(mean + np.where(off < 0, -(-off // 2), off // 2), 0, 255)


_FREE_OF_LEFT = {0, 2, 3, 4, 8, 9}


def _predicted(px: np.ndarray, modes: np.ndarray, tile: int, invert: bool) -> np.ndarray:
    """Adds (invert) or takes off the predictions. Left and top of an edge pixel are its neighbour there, opaque black at the first."""
    h, w, _ = px.shape
    src = px.astype(np.int64)
    out = np.empty_like(src)
    full = out if invert else src
    black = np.array([0, 0, 0, 255])
    sign = 1 if invert else -1
    for y in range(h):
        if y == 0:
            for x in range(w):
                out[0, x] = (src[0, x] + sign * (full[0, x - 1] if x else black)) & 255
            continue
        above = full[y - 1]
        out[y, 0] = (src[y, 0] + sign * above[0]) & 255
        x = 1
        while x < w:
            stop = min(w, ((x >> tile) + 1) << tile)
            mode = int(modes[y >> tile, x >> tile])
            right = np.concatenate([above[x + 1 : stop + 1], full[y, :1]])[: stop - x]
            if mode in _FREE_OF_LEFT or not invert:
                left = full[y, x - 1 : stop - 1]
                out[y, x:stop] = (src[y, x:stop] + sign * predict(mode, left, above[x:stop], right, above[x - 1 : stop - 1])) & 255
            else:
                for i in range(x, stop):
                    out[y, i] = (src[y, i] + predict(mode, full[y, i - 1], above[i], right[i - x], above[i - 1])) & 255
            x = stop
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _crossed(px: np.ndarray, elements: np.ndarray, tile: int, invert: bool) -> np.ndarray:
    h, w, _ = px.shape
    e = elements[np.arange(h)[:, None] >> tile, np.arange(w)[None, :] >> tile]
    to_red, green_to_blue, red_to_blue = (_signed(e[..., k]) for k in range(3))
    out = px.astype(np.int64).copy()
    green, red = _signed(out[..., 1]), out[..., 2]
    sign = 1 if invert else -1
    new_red = (red + sign * ((to_red * green) >> 5)) & 255
    base = _signed(new_red if invert else red)
    out[..., 0] = (out[..., 0] + sign * (((green_to_blue * green) >> 5) + ((red_to_blue * base) >> 5))) & 255
    out[..., 2] = new_red
    return out


def _channels(px: np.ndarray, h: int, w: int) -> np.ndarray:
    return np.stack([(px.reshape(h, w) >> (8 * k)) & 255 for k in range(4)], axis=-1)


def _pixels(ch: np.ndarray) -> np.ndarray:
    return sum(ch[..., k].astype(np.int64) << (8 * k) for k in range(4)).reshape(-1)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


@dataclass
class _Image:
    width: int
    height: int
    steps: list[tuple] = field(default_factory=list)


def lossless_chunk(file: bytes) -> bytes | None:
    """The VP8L chunk of a RIFF file, whatever chunks (of the extended format) stand before it."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        return None
    at = 12
    while at + 8 <= len(file):
        size = int.from_bytes(file[at + 4 : at + 8], "little")
        if file[at : at + 4] == b"VP8L":
            return file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def decode(files: list[bytes]) -> list[np.ndarray]:
    """The images' pixels as arrays (height, width) of unsigned 32-bit numbers."""
    if not files:
        return []
    bodies = []
    for f in files:
        body = lossless_chunk(f)
        if body is None or len(body) < 5:
            raise ValueError("not a lossless WebP file")
        bodies.append(body)
    b = Bits(bodies)
    every = np.arange(len(files))
    if np.any(b.read(every, 8) != SIGNATURE):
        raise ValueError("not a VP8L stream")
    width, height = b.read(every, 14) + 1, b.read(every, 14) + 1
    b.read(every, 1)
    if np.any(b.read(every, 3)):
        raise ValueError("unknown VP8L version")
    images = [_Image(w, h) for w, h in zip(width.tolist(), height.tolist(), strict=True)]
    now = width.copy()  # after palettes have bundled pixels
    more = every
    while len(more := more[b.read(more, 1) == 1]):
        kind = b.read(more, 2)
        for t in (PREDICTOR, CROSS_COLOUR):
            some = more[kind == t]
            if len(some):
                tile = b.read(some, 3) + 2
                w, h = (now[some] + (1 << tile) - 1) >> tile, (height[some] + (1 << tile) - 1) >> tile
                px, start = _read_image(b, some, w, h, False)
                for i, s in enumerate(some.tolist()):
                    own = _channels(px[start[i] : start[i] + w[i] * h[i]], int(h[i]), int(w[i]))
                    images[s].steps.append((t, int(tile[i]), own[..., 1] & 15 if t == PREDICTOR else own))
        for s in more[kind == SUBTRACT_GREEN].tolist():
            images[s].steps.append((SUBTRACT_GREEN,))
        some = more[kind == PALETTE]
        if len(some):
            n = b.read(some, 8) + 1
            px, start = _read_image(b, some, n, np.ones(len(some), np.int64), False)
            for i, s in enumerate(some.tolist()):
                table = _pixels(np.cumsum(_channels(px[start[i] : start[i] + n[i]], 1, int(n[i])), axis=1) & 255)
                bits = _bundle_bits(int(n[i]))
                images[s].steps.append((PALETTE, int(now[s]), bits, table))
                now[s] = (now[s] + (1 << bits) - 1) >> bits
    px, start = _read_image(b, every, now, height, True)
    if np.any(b.pos > b.end):
        raise ValueError("a stream ends too early")
    out = []
    for k, im in enumerate(images):
        own, w = px[start[k] : start[k] + now[k] * height[k]], int(now[k])
        for step in reversed(im.steps):
            if step[0] == PALETTE:
                _, w0, bits, table = step
                green = (own.reshape(im.height, w) >> 8) & 255
                depth = 8 >> bits
                x = np.arange(w0)
                index = (green[:, x >> bits] >> (depth * (x & ((1 << bits) - 1)))) & ((1 << depth) - 1)
                own = np.where(index < len(table), table[np.minimum(index, len(table) - 1)], 0).reshape(-1)
                w = w0
                continue
            ch = _channels(own, im.height, w)
            if step[0] == PREDICTOR:
                ch = _predicted(ch, step[2], step[1], True)
            elif step[0] == CROSS_COLOUR:
                ch = _crossed(ch, step[2], step[1], True)
            else:
                ch[..., 0] = (ch[..., 0] + ch[..., 1]) & 255
                ch[..., 2] = (ch[..., 2] + ch[..., 1]) & 255
            own = _pixels(ch)
        out.append(own.astype(np.uint32).reshape(im.height, im.width))
    return out


# -- writing -------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a complete prefix code for each row of counts, ``most`` bits at most; all 0 but a 1 for a lone symbol.

    Lengths follow the symbols' shares, rounded up; what is then left free goes to the shortest codes and most frequent symbols first.
    """
    n, s = counts.shape
    used = counts > 0
    total = counts.sum(axis=1, keepdims=True)
    floor = np.maximum(total / (1 << (most - 1)), 1e-9)
    share = np.where(used, np.maximum(counts, floor), 0.0)
    whole = share.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        length = np.where(used, np.ceil(np.log2(whole / share) - 1e-12), 0)
    length = np.where(used, np.clip(length, 1, most), 0).astype(np.int64)
    order = np.argsort(-counts, axis=1, kind="stable")
    sorted_length = np.take_along_axis(length, order, axis=1)
    n_used = used.sum(axis=1)
    free = (1 << most) - np.where(sorted_length > 0, np.int64(1) << (most - sorted_length), 0).sum(axis=1)
    free[n_used <= 1] = 0
    if np.any(free < 0):
        raise ValueError("more symbols than codes of this length")
    place = np.arange(s)[None, :]
    open_rows = np.flatnonzero(free > 0)
    while len(open_rows):
        for bits in range(2, most + 1):
            rows = open_rows[free[open_rows] >= 1 << (most - bits)]
            if not len(rows):
                continue
            own = sorted_length[rows]
            shorter = ((own > 0) & (own < bits)).sum(axis=1)
            here = (own == bits).sum(axis=1)
            take = np.minimum(here, free[rows] >> (most - bits))
            own -= (place >= shorter[:, None]) & (place < (shorter + take)[:, None])
            sorted_length[rows] = own
            free[rows] -= take << (most - bits)
        open_rows = np.flatnonzero(free > 0)
    np.put_along_axis(length, order, sorted_length, axis=1)
    return length


def _code_values(lengths: np.ndarray) -> np.ndarray:
    """The codes' bits in the order they are written; a lone symbol's code is empty."""
    n, s = lengths.shape
    rows, symbols = np.nonzero(lengths)
    size = lengths[rows, symbols]
    order = np.lexsort((symbols, size, rows))
    rows, symbols, size = rows[order], symbols[order], size[order]
    most = max(1, int(size.max(initial=1)))
    share = np.int64(1) << (most - size)
    before = np.cumsum(share) - share
    opens = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(opens, before, 0)) if len(rows) else before
    out = np.zeros((n, s), np.int64)
    out[rows, symbols] = _REV[most][before - base] & ((1 << size) - 1)
    return out


class Writer:
    """Collects fields (image, value, bits) and packs each image's, in the order given within an image."""

    def __init__(self, n: int):
        self.n = n
        self.fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, image: np.ndarray, value: np.ndarray | int, bits: np.ndarray | int) -> None:
        image = np.asarray(image, np.int64)
        self.fields.append((image, np.broadcast_to(np.asarray(value, np.int64), image.shape), np.broadcast_to(np.asarray(bits, np.int64), image.shape)))

    def packed(self) -> list[bytes]:
        """Fields of 48 bits at most. They are added up by 16-bit word; no two have a bit in common."""
        image = np.concatenate([f[0] for f in self.fields])
        value = np.concatenate([f[1] for f in self.fields])
        bits = np.concatenate([f[2] for f in self.fields])
        order = np.argsort(image, kind="stable")
        image, value, bits = image[order], value[order], bits[order]
        total = np.bincount(image, weights=bits, minlength=self.n).astype(np.int64)
        words = (total + 15) >> 4
        base = np.cumsum(words) - words
        ends = np.cumsum(bits)
        begin = ends - bits
        first = np.searchsorted(image, np.arange(self.n))
        zero = np.zeros(self.n, np.int64)
        full = total > 0
        zero[full] = begin[first[full]]
        at = begin - zero[image] + (base[image] << 4)
        word = at >> 4
        shifted = value.astype(_U) << (at & 15).astype(_U)
        out = np.zeros(int(words.sum()) + 4, _U)
        if len(word):
            cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sums = np.add.reduceat(shifted, cut)
            to = word[cut]
            for k in range(4):
                out[to + k] += (sums >> _U(16 * k)) & _U(0xFFFF)
        raw = out.astype("<u2").tobytes()
        return [raw[2 * s : 2 * s + ((t + 7) >> 3)] for s, t in zip(base.tolist(), total.tolist(), strict=True)]


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, number of extra bits and extra bits of lengths or distances from 1 on."""
    v = value - 1
    top = np.where(v < 4, 0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64))
    second = (v >> np.maximum(top - 1, 0)) & 1
    prefix = np.where(v < 4, v, 2 * top + second)
    extra = np.where(v < 4, 0, top - 1)
    return prefix, extra, np.where(v < 4, 0, v - ((2 + second) << extra))


def _put_code(w: Writer, who: np.ndarray, lengths: np.ndarray) -> None:
    """Writes one prefix code of each image of who."""
    used = (lengths > 0).sum(axis=1)
    lone = np.flatnonzero(used <= 1)
    if len(lone):
        symbol = lengths[lone].argmax(axis=1)
        short = symbol < 256  # simple codes hold symbols of 8 bits
        k = lone[short]
        w.put(who[k], 0b101, 3)  # simple, one symbol, of 8 bits
        w.put(who[k], symbol[short], 8)
        used = used.copy()
        used[k] = -1
    k = np.flatnonzero(used >= 0)
    if not len(k):
        return
    lengths = lengths[k]
    who = who[k]
    n, s = lengths.shape
    flat = lengths.reshape(-1)
    row = np.repeat(np.arange(n), s)
    opens = np.ones(len(flat), bool)
    opens[1:] = (flat[1:] != 0) | (flat[:-1] != 0) | (row[1:] != row[:-1])
    begin = np.flatnonzero(opens)
    run = np.diff(np.append(begin, len(flat)))
    value, run_row = flat[begin], row[begin]
    zero = value == 0
    most = np.where(zero, run // 138, 0)
    rest = np.where(zero, run - 138 * most, 0)
    tail = np.where(rest >= 3, 1, rest)
    tokens = np.where(zero, most + tail, 1)
    of = np.repeat(np.arange(len(begin)), tokens)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(tokens) - tokens, tokens)
    z, long_run = zero[of], nth < most[of]
    r = rest[of]
    symbol = np.where(~z, value[of], np.where(long_run | (r >= 11), 18, np.where(r >= 3, 17, 0)))
    extra = np.where(symbol == 18, 7, np.where(symbol == 17, 3, 0))
    added = np.where(symbol == 18, np.where(long_run, 138, r) - 11, np.where(symbol == 17, r - 3, 0))
    token_row = run_row[of]
    counts = np.bincount(token_row * 19 + symbol, minlength=19 * n).reshape(n, 19)
    inner = code_lengths(counts, 7)
    last = 19 - (inner[:, LENGTH_ORDER[::-1]] > 0).argmax(axis=1)
    last = np.maximum(last, 4)
    w.put(who, 0, 1)
    w.put(who, last - 4, 4)
    for i in range(19):
        has = np.flatnonzero(i < last)
        w.put(who[has], inner[has, LENGTH_ORDER[i]], 3)
    w.put(who, 0, 1)  # as many lengths as symbols
    size = inner.copy()
    size[(inner > 0).sum(axis=1) == 1] = 0
    code = _code_values(size)
    bits = size[token_row, symbol]
    w.put(who[token_row], code[token_row, symbol] | added << bits, bits + extra)


#: Matches of at least so many pixels become back-references; images of so many pixels get a colour cache.
LEAST_MATCH, MOST_MATCH, MOST_DISTANCE = 3, 4096, (1 << 20) - 120
CACHE_FROM, CACHE_BITS = 512, 6
CODE_BITS = 12


def matches(px: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of back-references for images one after the other (of: each pixel's image); they do not overlap.

    A pixel's match is the last earlier place of the same LEAST_MATCH pixels; neighbours of one distance are one match.
    """
    none = np.empty(0, np.int64)
    n = len(px) - LEAST_MATCH + 1
    if n <= 0:
        return none, none, none
    h = px.astype(_U)
    key = h[:n] * _U(0x9E3779B97F4A7C15)
    for k in range(1, LEAST_MATCH):
        key = (key ^ (key >> _U(29)) ^ h[k : k + n]) * _U(0xBF58476D1CE4E5B9)
    key ^= of[:n].astype(_U) * _U(0x94D049BB133111EB)
    by = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[by][1:] == key[by][:-1])
    here, before = by[same + 1], by[same]
    good = (of[here] == of[before]) & (of[here + LEAST_MATCH - 1] == of[here]) & (here - before <= MOST_DISTANCE)
    for k in range(LEAST_MATCH):  # equal keys of unequal pixels are no match
        good &= px[here + k] == px[before + k]
    far = np.zeros(n + 1, np.int64)
    far[here[good]] = here[good] - before[good]
    opens = np.flatnonzero((far[1:] != far[:-1]) | np.append(of[1:n] != of[: n - 1], True)) + 1
    begin = np.concatenate([[0], opens])
    stop = np.concatenate([opens, [n]]) + LEAST_MATCH - 1
    some = (far[np.minimum(begin, n)] > 0) & (begin < n)
    begin, stop = begin[some], stop[some]
    distance = far[begin]
    begin[1:] = np.maximum(begin[1:], stop[:-1])
    length = stop - begin
    some = length >= LEAST_MATCH
    begin, length, distance = begin[some], length[some], distance[some]
    pieces = -(-length // MOST_MATCH)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, distance = np.repeat(begin, pieces) + nth * MOST_MATCH, np.repeat(distance, pieces)
    return begin, np.minimum(MOST_MATCH, np.repeat(length, pieces) - nth * MOST_MATCH), distance


def _put_image(w: Writer, who: np.ndarray, images: list[np.ndarray], main: bool, width: np.ndarray) -> None:
    """Writes the pixels of each image of who, of these widths, with one group of prefix codes."""
    n = len(images)
    size = np.array([len(p) for p in images], np.int64)
    px = np.concatenate(images).astype(np.int64)
    of = np.repeat(np.arange(n), size)
    cached = (size >= CACHE_FROM) & (size <= LONG)
    w.put(who, cached, 1)
    w.put(who[cached], CACHE_BITS, 4)
    if main:
        w.put(who, 0, 1)
    head, run, far = matches(px, of)
    inside = np.zeros(len(px) + 1, np.int64)
    np.add.at(inside, head, 1)
    np.add.at(inside, head + run, -1)
    unit = np.cumsum(inside[:-1]) == 0
    unit[head] = True
    is_run = np.zeros(len(px), bool)
    is_run[head] = True
    length, back = np.ones(len(px), np.int64), np.ones(len(px), np.int64)
    length[head] = run
    # the pixel to the left and the one above have numbers of their own
    back[head] = np.where(far == 1, 2, np.where(far == width[of[head]], 1, far + len(NEAR)))
    hit = np.zeros(len(px), bool)
    slot = np.zeros(len(px), np.int64)
    if cached.any():
        c = np.flatnonzero(cached[of])
        slot[c] = _slot(px[c], np.int64(CACHE_BITS))
        key = of[c] << CACHE_BITS | slot[c]
        by = np.argsort(key, kind="stable")
        same = np.zeros(len(c), bool)
        same[1:] = (key[by][1:] == key[by][:-1]) & (px[c][by][1:] == px[c][by][:-1])
        # an empty cache holds 0, so a first pixel of 0 is a hit
        first = np.ones(len(c), bool)
        first[1:] = key[by][1:] != key[by][:-1]
        same |= first & (px[c][by] == 0)
        hit[c[by]] = same
    at = np.flatnonzero(unit)
    image, value = of[at], px[at]
    runs, hits = is_run[at], hit[at] & ~is_run[at]
    literal = ~runs & ~hits
    prefix, extra, added = _prefix(length[at])
    far_prefix, far_extra, far_added = _prefix(back[at[runs]])
    green = np.where(runs, 256 + prefix, np.where(hits, 256 + LENGTH_CODES + slot[at], (value >> 8) & 255))
    sizes = 256 + LENGTH_CODES + (1 << CACHE_BITS)
    every = np.ones(len(at), bool)
    coded = [(green, every, sizes), ((value >> 16) & 255, literal, 256), (value & 255, literal, 256), ((value >> 24) & 255, literal, 256)]
    tables = [code_lengths(np.bincount(image[mask] * alphabet + symbols[mask], minlength=n * alphabet).reshape(n, alphabet), CODE_BITS) for symbols, mask, alphabet in coded]
    far_table = code_lengths(np.bincount(image[runs] * DISTANCE_CODES + far_prefix, minlength=n * DISTANCE_CODES).reshape(n, DISTANCE_CODES), CODE_BITS)
    for k, t in enumerate([*tables, far_table]):
        if k == 0:
            for has, limit in ((cached, sizes), (~cached, 256 + LENGTH_CODES)):
                rows = np.flatnonzero(has)
                if len(rows):
                    _put_code(w, who[rows], t[rows, :limit])
        else:
            _put_code(w, who, t)

    def codes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = t.copy()
        t[(t > 0).sum(axis=1) == 1] = 0
        return _code_values(t), t

    out = np.zeros(len(at), np.int64)
    bits = np.zeros(len(at), np.int64)
    for (symbols, mask, _), t in zip(coded, tables, strict=True):
        value_of, size_of = codes(t)
        some = np.flatnonzero(mask)
        out[some] |= value_of[image[some], symbols[some]] << bits[some]
        bits[some] += size_of[image[some], symbols[some]]
    out[runs] |= added[runs] << bits[runs]
    bits[runs] += extra[runs]
    # a reference is two fields: length and distance
    row = np.repeat(np.arange(len(at)), 1 + runs)
    second = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.zeros(0, bool)
    out, bits = out[row], bits[row]
    value_of, size_of = codes(far_table)
    ours = size_of[image[runs], far_prefix]
    out[second] = value_of[image[runs], far_prefix] | far_added << ours
    bits[second] = ours + far_extra
    w.put(who[image[row]], out, bits)


def _tiles(h: int, w: int, tile: int) -> tuple[int, int]:
    return (h + (1 << tile) - 1) >> tile, (w + (1 << tile) - 1) >> tile


def _entropy(channels: np.ndarray) -> float:
    """Bits that the bytes of each column take by themselves."""
    n = len(channels)
    count = np.bincount((channels + 256 * np.arange(channels.shape[1])).reshape(-1), minlength=256 * channels.shape[1])
    count = count[count > 0]
    return float((count * (math.log2(n) - np.log2(count))).sum())


def choose(px: np.ndarray) -> tuple[str, ...]:
    """Transforms for an image: a palette where colours repeat often, else the one whose bytes have the least entropy, if any."""
    h, w = px.shape
    flat = px.reshape(-1)
    if px.size < 64:
        return ()
    if len(np.unique(flat[:256])) * 8 <= min(256, px.size):  # else many colours are certain
        colours = len(np.unique(flat))
        if colours <= 256 and 8 * colours <= px.size:
            return ("palette",)
    ch = flat.astype("<u4").view(np.uint8).reshape(-1, 4).astype(np.int64)
    ways = {(): ch, ("subtract_green",): np.stack([(ch[:, 0] - ch[:, 1]) & 255, ch[:, 1], (ch[:, 2] - ch[:, 1]) & 255, ch[:, 3]], axis=1)}
    if h > 1:
        ways[("predictor",)] = (ch[w:] - ch[:-w]) & 255
    cost = {k: _entropy(v) * len(ch) / len(v) for k, v in ways.items()}
    best = min(cost, key=cost.__getitem__)
    return best if cost[best] < 0.97 * cost[()] else ()  # a transform has its own cost


def encode(images: list[np.ndarray], transforms: list[tuple[str, ...] | None] | None = None, mode: int | list[int] = 2, tile: int = 4, element: tuple[int, int, int] = (24, 8, 250), mixed: bool = False) -> list[bytes]:
    """Lossless WebP files of images (height, width) of 32-bit pixels.

    transforms: names ("palette", "predictor", "cross_colour", "subtract_green") in the order of application, chosen by
    ``choose`` where not given. mode is the predictor's, of all images or of each; with ``mixed`` tiles take the modes after
    it in turn. element is green to red, green to blue and red to blue.
    """
    if not images:
        return []
    n = len(images)
    plans = [choose(im) if plan is None else plan for im, plan in zip(images, transforms or [None] * n, strict=True)]
    modes = [mode] * n if isinstance(mode, int) else mode
    w = Writer(n)
    every = np.arange(n)
    height = np.array([im.shape[0] for im in images])
    width = np.array([im.shape[1] for im in images])
    w.put(every, SIGNATURE, 8)
    w.put(every, width - 1, 14)
    w.put(every, height - 1, 14)
    w.put(every, 1, 1)
    w.put(every, 0, 3)
    ready, widths = [], []
    for k, (im, plan) in enumerate(zip(images, plans, strict=True)):
        px, (h, wide) = im.astype(np.int64).reshape(-1), im.shape
        me = np.array([k])
        for name in plan:
            w.put(me, 1, 1)
            if name == "palette":
                table, index = np.unique(px, return_inverse=True)
                if len(table) > 256:
                    raise ValueError("more than 256 colours")
                bits = _bundle_bits(len(table))
                w.put(me, PALETTE, 2)
                w.put(me, len(table) - 1, 8)
                steps = np.diff(_channels(table, 1, len(table)), axis=1, prepend=0) & 255
                _put_image(w, me, [_pixels(steps)], False, np.array([len(table)]))
                packed = (wide + (1 << bits) - 1) >> bits
                grid = np.zeros((h, packed << bits), np.int64)
                grid[:, :wide] = index.reshape(h, wide)
                depth = 8 >> bits
                green = (grid.reshape(h, packed, 1 << bits) << (depth * np.arange(1 << bits))).sum(axis=2)
                px, wide = (OPAQUE | green << 8).reshape(-1), packed
            elif name == "subtract_green":
                w.put(me, SUBTRACT_GREEN, 2)
                ch = _channels(px, h, wide)
                ch[..., 0] = (ch[..., 0] - ch[..., 1]) & 255
                ch[..., 2] = (ch[..., 2] - ch[..., 1]) & 255
                px = _pixels(ch)
            else:
                th, tw = _tiles(h, wide, tile)
                w.put(me, PREDICTOR if name == "predictor" else CROSS_COLOUR, 2)
                w.put(me, tile - 2, 3)
                if name == "predictor":
                    own = (modes[k] + (np.arange(th * tw) if mixed else 0) * np.ones(th * tw, np.int64)) % 14
                    _put_image(w, me, [OPAQUE | own << 8], False, np.array([tw]))
                    px = _pixels(_predicted(_channels(px, h, wide), own.reshape(th, tw), tile, False))
                else:
                    e = np.broadcast_to(np.array([*element, 255]) & 255, (th, tw, 4))
                    _put_image(w, me, [_pixels(e)], False, np.array([tw]))
                    px = _pixels(_crossed(_channels(px, h, wide), e, tile, False))
        ready.append(px)
        widths.append(wide)
    w.put(every, 0, 1)
    _put_image(w, every, ready, True, np.array(widths))
    out = []
    for body in w.packed():
        even = body + b"\0" * (len(body) % 2)
        out.append(b"RIFF" + (12 + len(even)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + even)
    return out
