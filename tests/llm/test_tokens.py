"""Encoders, packing and the chunk store against the libraries and brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lumencat.llm import chunk_store, packing, piece_bpe, tokens

ODD = ["", " ", "  a", "a  b", "\n a \n\nb ", "a\tb c", "x ", " x", "don't    stop　now", "é́ ñ", "it's 'tis", "<|endoftext|> a<|endoftext|>", "▁ab▁ c", "\x00\x01\x7f\x80\xa0\xad", "日本語 テスト 🎉👨‍👩‍👧", "a" * 3000, "\x1c a\x1c b", "\x85 y", "ı İ ß 𝕏 ①②", "No.1, two; three: 4!", "word " * 500]


def documents(n=60, seed=4):
    r = random.Random(seed)
    rows = [(k, " ".join("".join(r.choice("aeioubdn.,\n") for _ in range(r.randrange(1, 9))) for _ in range(r.choice([1, 5, 80, 900])))) for k in range(n)]
    rows += [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000, None), (2001, rows[3][1]), (2002, rows[3][1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, 1, "e") for k, t in documents()], "doc_id long, text string, start long, ids string")


@pytest.fixture(scope="module")
def ids():
    e = tokens.encoder(tokens.vocabulary_path()).tokenizer
    return {k: [*e.encode(t or "", add_special_tokens=False).ids, 0] for k, t in documents()}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_encoder_equals_library(ids):
    e = tokens.encoder(tokens.vocabulary_path())
    got = e.encode([t or "" for _, t in documents()])
    assert [[*g.tolist(), 0] for g in got] == [ids[k] for k, _ in documents()]
    assert e.encode([]) == []


def test_library_encodes_a_word_once(monkeypatch):
    """Neither the signs after a word, nor a line end before it, nor a later batch sends it to the library again."""
    e = tokens.Encoder(tokens.vocabulary_path())
    words = ["".join(random.Random(k).choices("abdeinoruéñ", k=9)) for k in range(300)]
    sent = []
    ids_of = e._ids
    monkeypatch.setattr(e, "_ids", lambda texts: sent.extend(texts) or ids_of(texts))
    e.encode(["I " + " ".join(words) + " . x\nx"])
    assert all("".join(sent).count(w) == 1 for w in words)
    sent.clear()
    later = [f"I {w}, {w}. {w}***" for w in words] + [f"I {w}\nx" for w in words]
    got = e.encode(later)
    assert not any(w in t for w in words for t in sent)
    assert [g.tolist() for g in got] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in later]


@pytest.mark.parametrize("kept", [0, 40, 1_000_000])
def test_units_are_cut_where_the_library_cuts(monkeypatch, kept):
    monkeypatch.setattr(tokens, "KEPT_UNITS", kept)
    e = tokens.Encoder(tokens.vocabulary_path())
    r = random.Random(kept)
    bits = [*"abZ'_×÷éĀſЖ҂µº²٠·\t\r\xa0\u3000\u2028\x1c\x85", "'s", "'ll", " ", " ", " ", "  ", "\n", "\n", "\n\n", "\r\n", ".", ",", "!?", "***", "(", ")", "-", "/", '"', "42", "word", "日本", "🎉", "é", "é.", "<|endoftext|>"]
    for _ in range(12):
        batch = ["".join(r.choices(bits, k=r.randrange(30))) for _ in range(200)]
        assert [g.tolist() for g in e.encode(batch)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in batch]
        assert len(e.kept) == len(e.begin) == len(e.count) == len(e.batches) <= kept


def test_marks_do_not_depend_on_blocks(monkeypatch):
    ids = np.random.default_rng(3).integers(0, 50_000, 70_000).astype(np.uint16)
    monkeypatch.setattr(chunk_store, "BLOCK_IDS", len(ids))
    want = chunk_store.marks(ids).tolist()
    for block in (1, 15, 16, 17, 4099):
        monkeypatch.setattr(chunk_store, "BLOCK_IDS", block)
        assert chunk_store.marks(ids[: 40 * block + 9]).tolist() == [m for m in want if m <= 40 * block + 9]
    assert chunk_store.marks(ids[:0]).tolist() == []


def padding(n):
    return 0 if n & (n - 1) == 0 else packing.LENGTH - n


def test_pieces_hold_each_id_once(spark, docs, ids):
    out = packing.pack(docs, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == crc(r["ids"]) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for k, parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        assert [i for r in parts for i in r["ids"]] == ids[k] and parts[0]["start"] == 0
    pad = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.LENGTH
        pad += padding(at)
    assert pad < 0.1 * sum(map(len, ids.values())) + 4 * packing.LENGTH
    assert packing.pack(docs.limit(0)).count() == 0


def cost(cuts, position, penalty, length):
    total = 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n = position[b] - position[a]
        if n > length:
            return float("inf")
        exact = n & (n - 1) == 0
        total += (0 if exact else length - n) + penalty[b] + packing.WINDOW_COST
    return total


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_optimal(seed):
    r = random.Random(seed)
    position = np.array([0, *sorted(r.sample(range(1, 400), 14))])
    position = position[np.concatenate([[True], np.diff(position) <= 64])]
    while (np.diff(position) > 64).any():
        position = np.sort(np.append(position, position[:-1][np.diff(position) > 64] + 64))
    penalty = np.array([r.choice([0, 4, 12]) for _ in position])
    n = len(position)
    best = [0] + [float("inf")] * (n - 1)
    for i in range(1, n):
        best[i] = min(best[j] + cost([j, i], position, penalty, 64) for j in range(i))
    cuts = packing.best_cuts(position, penalty, 64)
    assert cuts[0] == 0 and cuts[-1] == n - 1 and cost(cuts, position, penalty, 64) == best[-1]


def test_store_reads_back_what_was_written(spark, docs, ids, tmp_path):
    path = f"file://{tmp_path}/store"
    chunk_store.write_store(docs, path)
    got = {r["doc_id"]: r for r in chunk_store.verify(spark, path).collect()}
    start = 0
    for k in sorted(ids):
        r = got[k]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["verified"]) == (start, len(ids[k]), crc(ids[k]), True)
        start += len(ids[k])
    assert {r["doc_id"]: r["ids"] for r in chunk_store.reconstruct(spark, path).collect()} == ids
    digests = [bytes(r["digest"]) for r in chunk_store.chunks(spark, path).collect()]
    assert len(digests) == len(set(digests))


def test_store_of_nothing_and_repeated_rows(spark, docs, tmp_path):
    chunk_store.write_store(docs.limit(0), f"file://{tmp_path}/none")
    assert chunk_store.verify(spark, f"file://{tmp_path}/none").count() == 0
    d = spark.createDataFrame([(1, "same"), (1, "same"), (None, "same")], "doc_id long, text string")
    chunk_store.write_store(d, f"file://{tmp_path}/twice")
    out = chunk_store.verify(spark, f"file://{tmp_path}/twice").collect()
    assert len(out) == 3 and all(r["verified"] for r in out)
    assert chunk_store.chunks(spark, f"file://{tmp_path}/twice").count() == 1


def test_a_store_of_wide_ids_knows_its_width(spark, tmp_path, monkeypatch):
    """A vocabulary of over 65,536 ids: here the same one, told to be larger."""
    path = tokens.vocabulary_path()
    wide = tokens.Encoder(path)
    wide.dtype = np.dtype("<u4")
    assert chunk_store._MANIFEST.endswith("width int")
    d = spark.createDataFrame([(k, f"text number {k} " * 50) for k in range(4)], "doc_id long, text string")
    want = {k: [*wide.tokenizer.encode(f"text number {k} " * 50, add_special_tokens=False).ids, 0] for k in range(4)}
    store = f"file://{tmp_path}/wide"
    chunk_store.write_store(d, store)
    m = spark.read.schema(chunk_store._MANIFEST).parquet(f"{store}/manifest")
    assert chunk_store.width_of(spark, store) == 2 and m.count() >= 1
    # the same content with four bytes an id
    staged = spark.read.schema(chunk_store._STAGED).parquet(f"{store}/staged")
    widened = {bytes(r["content"]): np.frombuffer(r["content"], "<u2").astype("<u4").tobytes() for r in staged.where("kind = 'chunk'").collect()}
    new = {chunk_store.digest(k): chunk_store.digest(v) for k, v in widened.items()}
    rows = []
    for r in staged.collect():
        x = r.asDict()
        if x["kind"] == "chunk":
            x["content"] = widened[bytes(x["content"])]
            x["digest"] = chunk_store.digest(x["content"])
        else:
            x["digests"] = [new[bytes(k)] for k in x["digests"]]
        rows.append(tuple(x[f.split()[0]] for f in chunk_store._STAGED.split(", ")))
    other = f"file://{tmp_path}/four"
    spark.createDataFrame(rows, chunk_store._STAGED).write.partitionBy("kind").parquet(f"{other}/staged")
    chunk_store._publish(spark, other, 4)
    assert {r["doc_id"]: r["ids"] for r in chunk_store.reconstruct(spark, other).collect()} == want
    assert all(r["verified"] and r["ids_crc32"] == crc(want[r["doc_id"]]) for r in chunk_store.verify(spark, other).collect())


def test_packing_of_repeated_rows(spark):
    d = spark.createDataFrame([(1, "same text"), (1, "same text"), (1, "other text"), (None, "x"), (2, None)], "doc_id long, text string")
    out = packing.pack(d, with_ids=True).collect()
    e = tokens.encoder(tokens.vocabulary_path()).tokenizer
    want = sorted([*e.encode(t or "", add_special_tokens=False).ids, 0] for t in ("same text", "same text", "other text", "x", None))
    whole = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        whole.setdefault(r["doc_id"], []).extend(r["ids"])
    assert sorted(i for v in whole.values() for i in v) == sorted(i for v in want for i in v)
    assert sum(r["length"] for r in out) == sum(map(len, want)) and piece_bpe.encode_decode(d, public_tokenizers.path(piece_bpe.RANKS), public_tokenizers.PATTERN).count() == 5


def test_a_changed_chunk_is_found(spark, tmp_path):
    d = spark.createDataFrame([(k, f"text number {k} " * 50) for k in range(4)], "doc_id long, text string")
    chunk_store.write_store(d, f"file://{tmp_path}/s")
    from pyspark.sql import functions as F

    bad = f"file://{tmp_path}/bad"
    staged = spark.read.schema(chunk_store._STAGED).parquet(f"file://{tmp_path}/s/staged")
    broken = F.when(F.col("kind") == "chunk", F.concat(F.col("content").substr(1, 2), F.col("content").substr(F.lit(1), F.octet_length("content") - 2))).otherwise(F.col("content"))
    staged.withColumn("content", broken).write.partitionBy("kind").parquet(f"{bad}/staged")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"file://{tmp_path}/s/{part}").write.parquet(f"{bad}/{part}")
    assert not any(r["verified"] for r in chunk_store.verify(spark, bad).collect())


def test_crc_combination():
    r = random.Random(5)
    for _ in range(20):
        a, b = r.randbytes(r.randrange(0, 300)), r.randbytes(r.randrange(0, 5000))
        assert int(chunk_store.shifted_crc(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_chunks_follow_content():
    r = np.random.default_rng(6)
    body = r.integers(0, 50_000, 6000).astype(np.uint16)
    parts = []
    for head in (r.integers(0, 50_000, 37), r.integers(0, 50_000, 501)):
        ids = np.concatenate([head.astype(np.uint16), body])
        ends = chunk_store.cut_points(chunk_store.marks(ids).tolist(), len(ids))
        parts.append({ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)})
        assert ends[-1] == len(ids) and all(b - a <= chunk_store.MOST for a, b in zip([0, *ends[:-1]], ends, strict=True))
    assert len(parts[0] & parts[1]) >= len(parts[0]) - 3


def test_piece_model_equals_tiktoken(spark, docs):
    path = public_tokenizers.path(piece_bpe.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r["doc_id"]: r for r in piece_bpe.encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True).collect()}
    for k, t in documents():
        want = enc.encode_ordinary(t or "")
        assert out[k]["ids"] == want and out[k]["n_tokens"] == len(want)
        assert out[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert out[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert piece_bpe.encode_decode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0
