"""Lossless WebP, WARC, Hamming search, language identification and transcripts."""

import base64
import gzip
import hashlib
import io
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumencat.llm import hamming_search, language_id, media, transcripts, warc, webp


def images():
    r = np.random.default_rng(0)
    g = (np.add.outer(np.arange(50), np.arange(37)) * 3 % 256).astype(np.uint32)
    photo = (g | g << 8 | (g // 2) << 16 | 0xFF000000).astype(np.uint32) ^ r.integers(0, 4, (50, 37), dtype=np.uint32)
    few = r.integers(0, 5, (20, 19), dtype=np.uint32) * 0x01020304 + 3
    return {"noise": r.integers(0, 2**32, (5, 7), dtype=np.uint32), "zero": np.zeros((3, 16), np.uint32), "flat": np.full((40, 33), 0xFF102030, np.uint32), "few": few, "two": r.integers(0, 2, (64, 64), dtype=np.uint32), "photo": photo, "one": np.array([[7]], np.uint32), "row": np.arange(300, dtype=np.uint32)[None, :]}


def test_round_trip_in_one_batch():
    all_ = list(images().values())
    assert all(np.array_equal(a, b) for a, b in zip(all_, webp.decode(webp.encode(all_)), strict=True))


@pytest.mark.parametrize("plan", [("predictor",), ("cross_colour",), ("subtract_green",), ("predictor", "cross_colour"), ("subtract_green", "predictor"), ("cross_colour", "subtract_green")])
def test_transforms(plan):
    photo = images()["photo"]
    for mode in range(14) if "predictor" in plan else (0,):
        for tile in (2, 4):
            assert np.array_equal(webp.decode(webp.encode([photo], [plan], mode=mode, tile=tile))[0], photo)


@pytest.mark.parametrize("colours", [1, 2, 4, 5, 16, 17, 256])
def test_palettes(colours):
    r = np.random.default_rng(colours)
    px = r.integers(0, 2**32, colours, dtype=np.uint32)[r.integers(0, colours, (9, 21))]
    assert np.array_equal(webp.decode(webp.encode([px], [("palette",)]))[0], px)


class Pack:
    """A stream written by hand, least significant bit first."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]
        return self

    def file(self):
        body = np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), np.uint8), bitorder="little").tobytes()
        return b"RIFF" + (12 + len(body) + len(body) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)


def head(w, h):
    return Pack().put(0x2F, 8).put(w - 1, 14).put(h - 1, 14).put(1, 1).put(0, 3)


def lone(p, symbol):
    """A simple code of one symbol."""
    return p.put(1, 1).put(0, 1).put(1, 1).put(symbol, 8)


def pair(p, a, b):
    return p.put(1, 1).put(1, 1).put(1, 1).put(a, 8).put(b, 8)


def test_hand_written_simple_codes():
    p = head(3, 1).put(0, 1).put(0, 1).put(0, 1)
    pair(p, 10, 20)
    for s in (1, 2, 255, 0):
        lone(p, s)
    p.put(0b101, 3)  # green 20, 10, 20
    assert webp.decode([p.file()])[0].tolist() == [[0xFF010000 | g << 8 | 2 for g in (20, 10, 20)]]


def test_hand_written_cache_and_back_reference():
    # green symbols: 10, length prefix 256 + 1 (two pixels), cache slot; lengths 1, 2, 2 in a normal code
    cached = webp._slot(np.array([0xFF010A02]), np.int64(1))[0]
    symbols = sorted([10, 257, 280 + int(cached)])
    p = head(4, 1).put(0, 1).put(1, 1).put(1, 4).put(0, 1)
    lengths = {10: 1, symbols[1]: 2, symbols[2]: 2}
    p.put(0, 1)
    tokens, at = [], 0
    for s in symbols:
        gap = s - at
        while gap:
            n = min(gap, 138)
            if n >= 11:
                tokens.append((18, n - 11, 7))
            else:
                tokens += [(0, 0, 0)] * n
            gap -= n
        tokens.append((lengths[s], 0, 0))
        at = s + 1
    tokens += [(0, 0, 0)] * (282 - at)
    order = list(webp.LENGTH_ORDER)
    inner = {0: 2, 1: 2, 2: 2, 18: 2}
    p.put(15, 4)
    for s in order:
        p.put(inner.get(int(s), 0), 3)
    p.put(0, 1)
    code = {0: 0b00, 1: 0b10, 2: 0b01, 18: 0b11}  # canonical 00, 01, 10, 11 with bits reversed
    for symbol, extra, n in tokens:
        p.put(code[symbol], 2).put(extra, n)
    for s in (1, 2, 255, 1):  # red, blue, alpha, distance code 1: the pixel to the left
        lone(p, s)
    green = {10: (0, 1), symbols[1]: (0b01, 2), symbols[2]: (0b11, 2)}
    for s in (10, 280 + int(cached), 257):
        p.put(*green[s])
    assert webp.decode([p.file()])[0].tolist() == [[0xFF010A02] * 4]


def test_hand_written_groups():
    # an entropy image of two tiles of 4 pixels: the left group writes green 5, the right one green 6 or 7
    p = head(8, 1).put(0, 1).put(0, 1).put(1, 1).put(0, 3)
    p.put(0, 1)
    pair(p, 0, 1)
    for s in (0, 0, 0, 0):
        lone(p, s)
    p.put(0b10, 2)
    for green in ((5,), (6, 7)):
        lone(p, *green) if len(green) == 1 else pair(p, *green)
        for s in (0, 0, 0, 0):
            lone(p, s)
    p.put(0b0110, 4)
    assert [(x >> 8) & 255 for x in webp.decode([p.file()])[0][0].tolist()] == [5, 5, 5, 5, 6, 7, 7, 6]


def normal(p, lengths, alphabet):
    """A normal code: its lengths written one by one through an inner code of fixed size; gives the code of each symbol."""
    used = sorted({0, *lengths.values()})
    bits = max(1, (len(used) - 1).bit_length())
    inner = {v: bits for v in used}
    for v in range(16):  # fill the inner code up
        if len(inner) < 1 << bits and v not in inner:
            inner[v] = bits
    p.put(0, 1).put(15, 4)
    for s in webp.LENGTH_ORDER:
        p.put(inner.get(int(s), 0), 3)
    p.put(0, 1)
    flip = lambda v, n: int(f"{v:0{n}b}"[::-1], 2)
    number = {v: flip(k, bits) for k, v in enumerate(sorted(inner))}
    for s in range(alphabet):
        p.put(number[lengths.get(s, 0)], bits)
    code, value, last = {}, 0, 0
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        value <<= n - last
        code[s] = (flip(value, n), n)
        value, last = value + 1, n
    return code


def small_image(p, values, main=False):
    """An entropy-coded image of single green values (a transform's data): no cache, literals only."""
    p.put(0, 1)
    if main:
        p.put(0, 1)
    options = sorted(set(values))
    if len(options) == 1:
        lone(p, options[0])
    else:
        pair(p, *options)
    for s in (0, 0, 255, 0):
        lone(p, s)
    for v in values if len(options) > 1 else ():
        p.put(options.index(v), 1)


def test_hand_written_transforms():
    # predictor: two tiles of 4 by 4 pixels, modes 1 (left) and 2 (above); residuals of green 1, elsewhere 0
    p = head(8, 2).put(1, 1).put(0, 2).put(0, 3)
    small_image(p, [1, 2])
    p.put(0, 1)
    p.put(0, 1).put(0, 1)
    lone(p, 1)
    for s in (0, 0, 0, 0):
        lone(p, s)
    green = [[(x >> 8) & 255 for x in row] for row in webp.decode([p.file()])[0].tolist()]
    # the first pixel adds to opaque black, the first row goes from the left, the first column from above
    assert green == [[1, 2, 3, 4, 5, 6, 7, 8], [2, 3, 4, 5, 6, 7, 8, 9]]
    # cross-colour: green to red 32 (that is 1), green to blue 0, red to blue 0; then subtract-green added back
    p = head(2, 1).put(1, 1).put(1, 2).put(0, 3)
    p.put(0, 1)
    lone(p, 0)
    lone(p, 0)
    lone(p, 32)
    lone(p, 255)
    lone(p, 0)
    p.put(1, 1).put(2, 2).put(0, 1)
    p.put(0, 1).put(0, 1)
    pair(p, 10, 20)
    for s in (5, 7, 255, 0):
        lone(p, s)
    p.put(0b10, 2)
    # read: add green to red and blue, then the cross-colour step adds green to red once more
    assert webp.decode([p.file()])[0].tolist() == [[0xFF000000 | (5 + 2 * g) << 16 | g << 8 | (7 + g) for g in (10, 20)]]
    # palette of two colours, eight pixels in a byte
    p = head(9, 1).put(1, 1).put(3, 2).put(1, 8)
    p.put(0, 1)
    pair(p, 3, 9)
    for s in (0, 0, 255, 0):
        lone(p, s)
    p.put(0b10, 2)  # greens 3 and 3 + 9, alpha 255 and 255 + 255
    p.put(0, 1).put(0, 1).put(0, 1)
    pair(p, 0b01, 0b10110010)
    for s in (0, 0, 0, 0):
        lone(p, s)
    p.put(0b01, 2)
    px = webp.decode([p.file()])[0][0].tolist()
    assert [(x >> 8) & 255 for x in px] == [12 if b else 3 for b in (0, 1, 0, 0, 1, 1, 0, 1, 1)]
    assert {x >> 24 for x in px} == {255, 254}


@pytest.mark.parametrize("cache_bits", [0, 2])
def test_hand_written_long_image(cache_bits):
    """Over LONG pixels: literals, distant and near references and cache hits, as a foreign encoder may mix them."""
    r = random.Random(cache_bits)
    n = 6000
    p = head(60, 100).put(0, 1)
    p.put(1, 1).put(cache_bits, 4) if cache_bits else p.put(0, 1)
    p.put(0, 1)
    alphabet = 280 + (1 << cache_bits if cache_bits else 0)
    greens = {5: 2, 9: 2, 77: 3, 256: 4, 259: 4, 262: 3, **({280: 5, 281: 5, 282: 5, 283: 5} if cache_bits else {200: 3})}
    code = normal(p, greens, alphabet)
    reds = normal(p, {0: 1, 40: 2, 41: 2}, 256)
    pair(p, 6, 7)
    lone(p, 255)
    far = normal(p, {0: 1, 1: 2, 14: 3, 15: 3}, 40)
    want, cache = [], [0] * 4
    slot = lambda x: int(webp._slot(np.array([x]), np.int64(2))[0])

    def add(x):
        want.append(x)
        if cache_bits:
            cache[slot(x)] = x

    while len(want) < n:
        kind = r.choice(list(greens))
        if kind < 256:
            red, blue = r.choice([0, 40, 41]), r.randrange(2)
            p.put(*code[kind]).put(*reds[red]).put(blue, 1)
            add(255 << 24 | red << 16 | kind << 8 | 6 + blue)
        elif kind < 280:
            prefix = kind - 256
            extra_bits = 0 if prefix < 4 else (prefix - 2) >> 1
            extra = r.randrange(1 << extra_bits)
            length = prefix + 1 if prefix < 4 else ((2 + (prefix & 1)) << extra_bits) + extra + 1
            d = r.choice([0, 1, 14, 15])
            d_bits = 0 if d < 4 else (d - 2) >> 1
            d_extra = r.randrange(1 << d_bits)
            number = d + 1 if d < 4 else ((2 + (d & 1)) << d_bits) + d_extra + 1
            back = 60 if number == 1 else 1 if number == 2 else number - 120
            if number > 2 and number <= 120 or back > len(want) or length > n - len(want):
                continue
            p.put(*code[kind]).put(extra, extra_bits).put(*far[d]).put(d_extra, d_bits)
            for _ in range(length):
                add(want[-back])
        else:
            p.put(*code[kind])
            add(cache[kind - 280])
    got = webp.decode([p.file()])[0].reshape(-1)
    assert got.tolist() == want
    long_, webp.LONG = webp.LONG, 1 << 30
    try:
        assert np.array_equal(webp.decode([p.file()])[0].reshape(-1), got)
    finally:
        webp.LONG = long_


def test_long_images_and_distant_matches(monkeypatch):
    r = np.random.default_rng(2)
    block = r.integers(0, 2**32, 700, dtype=np.uint32)
    noise = r.integers(0, 2**32, 9000, dtype=np.uint32)
    px = np.concatenate([block, noise, block, np.full(9000, 7, np.uint32), block[3:], noise[:17]])
    px = np.concatenate([px, np.zeros(-len(px) % 16, np.uint32)]).reshape(-1, 16)
    start, length, distance = webp.matches(px.reshape(-1).astype(np.int64), np.zeros(px.size, np.int64))
    assert 9700 in distance and length.max() == webp.MOST_MATCH and (start[1:] >= (start + length)[:-1]).all()
    monkeypatch.setattr(webp, "WALK_BYTES", 1000)
    for im in (px, np.full((600, 16), 3, np.uint32), np.arange(16 * 600, dtype=np.uint32).reshape(-1, 16), (np.arange(16 * 600, dtype=np.uint32) * 0x010101 & 0xFFFFFF | 0xFF000000).reshape(-1, 16)):
        assert np.array_equal(webp.decode(webp.encode([im]))[0], im)
    assert len(webp.encode([px])[0]) < 4 * (len(noise) + 2 * len(block))
    grey = (r.integers(0, 256, (40, 40), dtype=np.uint32) * 0x010101) | 0xFF000000
    assert webp.choose(grey) == ("subtract_green",)
    assert webp.choose(np.cumsum(r.integers(0, 3, (60, 40), dtype=np.uint32), axis=0, dtype=np.uint32) + r.integers(0, 250, 40, dtype=np.uint32)) == ("predictor",)


def test_a_file_of_the_extended_format():
    im = images()["photo"]
    plain = webp.encode([im])[0]
    extended = b"VP8X" + (10).to_bytes(4, "little") + bytes(4) + (36).to_bytes(3, "little") + (49).to_bytes(3, "little")
    odd = b"ICCP" + (3).to_bytes(4, "little") + b"abc\0"
    body = b"WEBP" + extended + odd + plain[12:] + b"EXIF" + (2).to_bytes(4, "little") + b"xx"
    assert np.array_equal(webp.decode([b"RIFF" + len(body).to_bytes(4, "little") + body])[0], im)


def test_broken_files_are_errors():
    good = webp.encode([images()["photo"]])[0]
    for bad in (b"", b"RIFF" + bytes(40), good[:20] + b"\0" + good[21:], good[:60] + bytes(len(good) - 60)):
        with pytest.raises((ValueError, IndexError)):
            webp.decode([bad])


def test_code_lengths_are_complete():
    r = np.random.default_rng(1)
    counts = np.concatenate([r.integers(0, 3, (20, 300)), (r.pareto(1, (20, 300)) * 5).astype(int), np.eye(300, dtype=int)[:3], np.eye(300, dtype=int)[:3] + np.eye(300, dtype=int)[5]])
    lengths = webp.code_lengths(counts, 12)
    used = (counts > 0).sum(axis=1)
    kraft = np.where(lengths > 0, 0.5 ** lengths.astype(float), 0).sum(axis=1)
    assert np.allclose(kraft[used > 1], 1) and (lengths.max(axis=1) <= 12).all() and ((lengths > 0) == (counts > 0)).all()


def test_media_columns(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "row of text. " * 3000, "same", "same", "\0" * 500, "ab" * 20_000, "a text of a megabyte and more, " * 35_000]
    d = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    out = {r["doc_id"]: r for r in media.read_back(media.store(d)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        r = out[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        px = np.array(r["pixels"], np.int32).view(np.uint32)
        assert np.stack([px >> 16, px >> 8, px, px >> 24], axis=-1).astype(np.uint8).tobytes() == payload
    files = {r["doc_id"]: bytes(r["media"]) for r in media.store(d).collect()}
    assert all(f[:4] == b"RIFF" and 8 + int.from_bytes(f[4:8], "little") == len(f) for f in files.values())
    assert out[6]["media_sha256"] == out[7]["media_sha256"] and out[0]["media_sha256"] == out[1]["media_sha256"]
    assert media.read_back(media.store(d.limit(0))).count() == 0


def test_planned_images_come_back(monkeypatch):
    monkeypatch.setattr(media, "PLAN_EVERY", 1)
    texts = [f"text {k} of some words that go on, " .encode() * (k % 40 + 1) for k in range(60)] + [b"long " * 5000, b""]
    used = {media.PLANS[zlib.crc32(t) // media.PLAN_EVERY % len(media.PLANS)] for t in texts}
    assert used == set(media.PLANS)
    files = media.write_media(texts)
    for t, im in zip(texts, webp.decode(files), strict=True):
        assert media.samples(media.pixels(im, len(t))) == media.padded(t)


def test_captures(spark, tmp_path):
    rows = [(1, "http://a/b\r\n", "é\r\n\r\nWARC/1.1"), (2, None, None), (3, "u", ""), (None, "u", ""), (5, "http://a/b", "é\r\n\r\nWARC/1.1"), (6, "v", "x" * 70_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(d, f"file://{tmp_path}/w")
    out = {r["page_id"]: r for r in warc.captures(spark, f"file://{tmp_path}/w", with_payload=True).collect()}
    first = {}
    for k, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", k)
    for k, _, h in rows:
        raw = (h or "").encode()
        r = out[k]
        assert (r["payload_bytes"], r["payload_digest"], r["verified"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), True)
        assert (r["record_type"], r["refers_to_page"]) == (("response", None) if first[h or ""] == k else ("revisit", first[h or ""]))
        assert r["request"]["http"].startswith("GET /") and "page_id" in r["metadata"]["fields"]
    warc.write_archives(d.limit(0), f"file://{tmp_path}/n")
    assert warc.captures(spark, f"file://{tmp_path}/n").count() == 0
    warc.write_archives(d, f"file://{tmp_path}/m", min_bytes=1)
    assert warc.captures(spark, f"file://{tmp_path}/m").where("page_id in (2, 3) and record_type = 'response'").count() == 2


def test_captures_of_odd_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    rows = [(1, "u", "x" * 3_000_000, 7, "a"), (1, "u", "x" * 3_000_000, 7, "b"), (2, "v", "short", 8, "c"), (2, "w", "other", 9, "d"), (3, "v", "short", 9, "e")]
    rows += [(10 + k, f"http://h/{k}", "y" * k, k, "f") for k in range(200)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, sha int, kind string").coalesce(1)
    d.write.parquet(f"file://{tmp_path}/pages.parquet")
    out = warc.op5_warc_captures(spark, f"file://{tmp_path}").collect()
    assert len(out) == len(rows) and all(r["verified"] and r["request"] and r["metadata"] for r in out)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in out if r["page_id"] <= 3) == [(1, "response", None), (1, "response", None), (2, "response", None), (2, "response", None), (3, "revisit", 2)]
    assert {r["payload_bytes"] for r in out if r["page_id"] == 1} == {3_000_000}
    archive = tmp_path / "archives"
    warc.write_archives(d, f"file://{archive}")
    packed = sorted(archive.glob("*.gz"))
    assert len(packed) > 3
    kinds = [head["warc-type"] for p in packed for head, _ in warc.parse(gzip.open(p))]
    assert kinds.count("warcinfo") >= 1 and kinds.count("request") == len(rows) and kinds.count("revisit") == 1
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(gzip.open(packed[0]).read()[:-1])))


def test_search_equals_brute_force(spark):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(30)]
    codes = [(k, (r.choice(base) ^ (sum(1 << r.randrange(64) for _ in range(r.randrange(9))) & (2**64 - 1))).to_bytes(8, "big")) for k in range(400)] + [(1000 + k, base[0].to_bytes(8, "big")) for k in range(40)] + [(5000, b"\0\0"), (5001, b"\0\1")]
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in codes], "id long, code binary")
    asked = df.where("id % 20 = 0 or id = 5001")
    got = {}
    for x in hamming_search.top_k(df, asked, 7).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["distance"], x["neighbour_id"]))
    table = dict(codes)
    for q in got:
        want = sorted(((int.from_bytes(table[q]) ^ int.from_bytes(c)).bit_count(), k) for k, c in codes if len(c) == len(table[q]))[:7]
        assert got[q] == want
    assert set(got) == {k for k, _ in codes if k % 20 == 0 or k == 5001}


def test_search_shards_agree(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(k, v.tolist()) for k, v in enumerate(r.normal(size=(300, 64)))] + [(900, None), (None, [1.0] * 64), (901, [None] * 64)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    c = hamming_search.sign_codes(v)
    q = c.where("id % 20 = 0")
    one = sorted(map(tuple, hamming_search.top_k(c, q, 5).collect()))
    monkeypatch.setattr(hamming_search, "SHARD_CODES", 40)
    monkeypatch.setattr(hamming_search, "BLOCK_QUERIES", 4)
    assert sorted(map(tuple, hamming_search.top_k(c, q, 5).collect())) == one
    assert hamming_search.top_k(c.limit(0), c.limit(0), 5).count() == 0


def slow_phrases(text, sample):
    """Longest matches from left to right."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        n, at = n + 1, at + k
    return n


@pytest.mark.parametrize("segment", [2048, 64, 7, 1])
def test_phrases_equal_longest_matches(monkeypatch, segment):
    monkeypatch.setattr(language_id, "SEGMENT", segment)
    r = random.Random(9)
    samples = {"x": "".join(r.choice("abcd ") for _ in range(400)), "y": "".join(r.choice("cdefg ") for _ in range(300))}
    p = language_id.CrossParser(samples)
    texts = ["".join(r.choice("abcdefgz ") for _ in range(n)) for n in (1, 7, 90, 5000)] + [samples["x"][:90], samples["x"] * 3, samples["y"][5:] + samples["x"], "   ", "q", ""]
    folds, lengths, _ = language_id.folded("".join(texts), np.array([len(t) for t in texts]))
    got = p.phrases(p.classes(folds), lengths)
    squeeze = lambda s: "".join(" " if k == " " else "".join(g) for k, g in itertools.groupby(s, lambda c: c if c == " " else "x"))
    for i, t in enumerate(texts):
        for j, lang in enumerate(p.languages):
            assert got[i, j] == slow_phrases(squeeze(t), squeeze(samples[lang]))


def test_languages_held_out(spark):
    r = random.Random(10)
    words = {"aa": "the and of thin rest wash".split(), "bb": "der und ist schach keit".split(), "cc": "que los con más ción".split()}
    rows = [(k, " ".join(r.choice(words[lang]) for _ in range(40)), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !", "cc"), (903, "the and", None)]
    d = spark.createDataFrame([(*x, "s", 0.5) for x in rows], "doc_id long, text string, lang string, source string, score double")
    out = {x["doc_id"]: x for x in language_id.identify(d, language_id.training_samples(d)).collect()}
    assert all(out[k]["lang_pred"] == lang for k, _, lang in rows[:180])
    assert all(out[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in out)
    assert [out[k]["lang_pred"] for k in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= x["score"] <= 1 for x in out.values())
    none = language_id.identify(d, language_id.training_samples(d.withColumn("lang", F.lit(None).cast("string"))))
    assert {x["lang_pred"] for x in none.collect()} == {"und"}
    assert language_id.identify(d.limit(0), language_id.training_samples(d.limit(0))).count() == 0


def test_letters_of_large_alphabets_match(spark):
    r = random.Random(12)
    han = [chr(0x4E00 + i) for i in range(600)]
    words = ["".join(r.choice(han) for _ in range(r.choice([1, 2, 2, 3]))) for _ in range(300)]
    weight = [1 / (i + 1) for i in range(len(words))]
    say = lambda n: "".join(r.choices(words, weight, k=n))
    samples = {"zh": say(3000), "en": "the and of thin rest wash " * 30}
    p = language_id.CrossParser(samples)
    texts = [say(400), samples["zh"][:200], "the thin " + say(30), "龘" + say(5), say(3000)]
    folds, lengths, _ = language_id.folded("".join(texts), np.array([len(t) for t in texts]))
    got = p.phrases(p.classes(folds), lengths)
    for i, t in enumerate(texts):
        for j, lang in enumerate(p.languages):
            assert got[i, j] == slow_phrases(t, samples[lang])
    rows = [(k, say(150), "zh") for k in range(60)] + [(100 + k, " ".join(r.choice(samples["en"].split()) for _ in range(60)), "en") for k in range(60)]
    rows += [(200, "".join(chr(0x3400 + r.randrange(6000)) for _ in range(300)), "zh")]
    d = spark.createDataFrame([(*x, "s", len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert zlib.crc32(b"200") % 3 == 1
    kept = {x["doc_id"] for x in corpus_pipeline.keep_known_language(spark, d, "").collect()}
    assert kept == {k for k, _, _ in rows[:120]}


def random_model(r, roles):
    speakers = transcripts.Speakers(roles)
    n = len(speakers.states)
    counts = {("start", 0, s): r.randrange(9) for s in range(n)} | {("step", a, b): r.randrange(9) for a in range(n) for b in range(n)}
    counts |= {(f, s, v): r.randrange(9) for f, size in zip(transcripts.FEATURES, speakers.values, strict=True) for s in range(n) for v in range(size)}
    return transcripts.Model(speakers, counts)


def seen_by(r, m, n):
    return [tuple(r.randrange(v) for v in m.speakers.values) for _ in range(n)]


def test_viterbi_equals_enumeration():
    r = random.Random(11)
    m = random_model(r, ["user", "assistant"])
    many = [seen_by(r, m, n) for n in (4, 1, 0, 3, 4)]

    def weight(path, seen):
        w = m.start[path[0]]
        for t, s in enumerate(path):
            w += sum(m.emit[i][seen[t][i]][s] for i in range(5)) + (m.step[path[t - 1], s] if t else 0)
        return w

    for seen, path in zip(many, m.viterbi(many), strict=True):
        assert len(path) == len(seen)
        if seen:
            assert math.isclose(weight(path, seen), max(weight(p, seen) for p in itertools.product(range(6), repeat=len(seen))))
            end = m.passage(seen)[-1]
            assert math.isclose(end.max(), weight(path, seen))


def conversation_rows(r, n, turns, roles=("user", "assistant")):
    say = {"user": lambda: "Is it " + "so " * r.randrange(1, 4) + "?", "assistant": lambda: "Yes, " + "very much indeed " * 12, "tool": lambda: '{"found": ' + str(r.randrange(9)) + "}"}
    return [(c, t, roles[t % len(roles)], say[roles[t % len(roles)]]()) for c in range(n) for t in range(turns)]


def recovered(spark, rows, missing=transcripts.MISSING):
    d = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, part string")
    speakers = transcripts.known_speakers(d)
    raw = transcripts.transcripts(d, speakers, missing)
    return raw, transcripts.fit(transcripts._training(raw), speakers)


def canonical(rows, key):
    return transcripts.render([(role, text.strip()) for c, _, role, text in rows if c == key])


def test_transcripts(spark):
    r = random.Random(12)
    rows = conversation_rows(r, 80, 6)
    rows += [(100, 0, None, None), (100, 1, "user", ""), (None, None, "user", "x"), (101, 0, "user", "a"), (101, 0, "user", "a"), (102, None, "user", "b"), (102, None, "user", "c")]
    raw, model = recovered(spark, rows)
    out = transcripts.parse(raw, model).collect()
    held = [x for x in out if x["held_out"] and x["conv_id"] is not None and x["conv_id"] < 80]
    assert sum(x["wrong_lines"] for x in held) < 0.05 * sum(x["n_lines"] for x in held)
    good = next(x for x in held if not x["wrong_lines"])
    assert good["rendered"].startswith("<|user|>\n") and good["rendered"].count("<|end|>") == good["n_turns"] == 6
    assert len(out) == 84 and {x["part"] for x in out} == {0}
    assert transcripts.parse(spark.createDataFrame([(1, 0, "")], "conv_id long, part long, transcript string"), model).first()["rendered"] == ""
    assert transcripts.parse(raw.limit(0), transcripts.fit(raw.limit(0), transcripts.Speakers([]))).count() == 0


def test_marked_turns_come_back_as_they_were(spark):
    """Held-out conversations without missing markers, with lists and look-alikes of markers in their texts, and a tool."""
    r = random.Random(13)
    rows = conversation_rows(r, 150, 6, ("user", "assistant", "tool"))
    listed = lambda t: t + "\n- first item\n- second item" if r.random() < 0.3 else t
    rows = [(c, t, role, listed(text) if role == "assistant" and zlib.crc32(str(c).encode()) % 5 != 4 else text) for c, t, role, text in rows]
    raw, model = recovered(spark, rows, missing=0)
    held = [x for x in transcripts.parse(raw, model).collect() if x["held_out"]]
    right = sum(x["rendered"] == canonical(rows, x["conv_id"]) for x in held)
    assert len(held) > 30 and right >= 0.97 * len(held)
    assert any("tool" in x["roles"].split(",") for x in held)
    lines = ["User: - first item", "- second item", "Assistant: A: yes", "A: no"]
    d = spark.createDataFrame([(1, 0, "\n".join(lines[:3]))], "conv_id long, part long, transcript string")
    text = transcripts.parse(d, model).first()["rendered"]
    assert "- first item" in text and "- second item" in text and "A: yes" in text


def test_a_long_conversation_is_one_path(spark, monkeypatch):
    r = random.Random(14)
    rows = conversation_rows(r, 60, 5) + [(900, t, role, text) for _, t, role, text in conversation_rows(r, 1, 1000)]
    raw, model = recovered(spark, rows)
    parts = sorted(((x["part"], x["rendered"], x["n_lines"]) for x in transcripts.parse(raw, model).where("conv_id = 900").collect()))
    assert len(parts) == 2
    texts = [x["transcript"] for x in raw.where("conv_id = 900").orderBy("part").collect()]
    lines = "\n".join(texts).split("\n")
    s = model.speakers
    path = model.viterbi([s.observations(lines, s.worded(lines))])[0]
    assert "".join(p[1] for p in parts) == transcripts.render(transcripts.turns(s, lines, path, s.worded(lines)))
    # parts that end inside a turn: two lines each
    cut = [(1, k, "\n".join(lines[2 * k : 2 * k + 2])) for k in range(20)]
    d = spark.createDataFrame(cut, "conv_id long, part long, transcript string")
    path = model.viterbi([s.observations(lines[:40], s.worded(lines[:40]))])[0]
    got = [x["roles"] for x in transcripts.parse(d, model).orderBy("part").collect()]
    assert ",".join(x for x in got if x) == ",".join(role for role, _ in transcripts.turns(s, lines[:40], path, s.worded(lines[:40])))


def test_repeated_turns_are_turns(spark):
    rows = [(1, 0, "user", "yes"), (1, 0, "user", "yes"), (1, 1, "assistant", "no"), (None, None, "user", "yes"), (None, None, "user", "yes")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((str(r["conv_id"]), r["number"], r["role"]) for r in transcripts.numbered(d).collect())
    assert got == [("1", 0, "user"), ("1", 1, "user"), ("1", 2, "assistant"), ("None", 0, "user"), ("None", 1, "user")]


def test_free_texts_are_no_roles(spark):
    """The most frequent roles are known, ties by name; what is written once each in the place of a role is not."""
    n = transcripts.MOST_ROLES
    rows = [(k, 0, f"said {k:04d}", "x") for k in range(3 * n)] + [(k, 1, r, "x") for k in range(3 * n) for r in ("user", "assistant")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    roles = set(transcripts.known_speakers(d).roles)
    assert len(roles) == n and {"user", "assistant"} <= roles
    trained = [k for k in range(3 * n) if not transcripts.is_held_out(k)]
    assert roles - {"user", "assistant"} == {f"said {k:04d}" for k in trained[: n - 2]}
