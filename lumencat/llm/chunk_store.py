"""Operator 8: a content-addressed store of token ids.

A rolling hash over the last WINDOW_IDS ids cuts each document's ids into chunks where the hash meets a mask, so that equal
passages give equal chunks wherever they stand. A chunk's address is the digest of its bytes. The store is one folder:

    staged/kind=chunk/  digest, content: each distinct chunk once
    recipes/    doc_id, n_tokens, start, root, chunks (digest and length in order): in ascending doc_id order, with the Merkle
                root of the document's chunk digests
    manifest/   for each recipe partition: its first and last doc_id, documents, tokens, start, Merkle root over its
                documents' roots, and the bytes of a stored id

Reading verifies: every chunk's content is hashed again, every recipe's lengths and root are checked against the verified
chunks, every recipe partition against the manifest. ``reconstruct`` gives the ids themselves, ``verify`` the length and
CRC-32 of each document's ids, put together from its chunks' sums, which needs no shuffle of content.

Scale: texts are encoded once and not shuffled. A task sends a chunk's content only at its first sight of the digest, to the
partition of that digest, where one copy is kept: at most one row a task for each digest, however many documents share
it. Recipes are dealt at random until they are sorted by range. Recipe rows with a frequent chunk are joined to the chunks
by a join adaptive execution may split, and sums of documents are combined before their shuffle. Starts come from one total
for each recipe partition.

Defined cases: null text is empty and stores its end id alone; repeated rows of an id are stored each and come back each,
in the order of their digests; extra columns are not read; an empty table gives an empty store and result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumencat.llm.common import pieces, scratch, table, texts
from lumencat.llm.tokens import END_ID, encoder, vocabulary_path

WINDOW_IDS = 16
MASK = (1 << 9) - 1
LEAST, MOST = 64, 4096
BATCH_BYTES = 24 << 20
BLOCK_IDS = 1 << 16

_U = np.uint64
_GEAR = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


def marks(ids: np.ndarray) -> np.ndarray:
    """Positions in a stream of ids where the rolling hash of the WINDOW_IDS ids before has its masked bits 0."""
    found = [np.empty(0, np.int64)]
    for lo in range(0, len(ids), BLOCK_IDS):  # in blocks, as temporary arrays of all ids cost more
        before = min(lo, WINDOW_IDS - 1)
        h = _GEAR[ids[lo - before : lo + BLOCK_IDS].astype(np.int64) & 0xFFFF]
        # sum over the window of gear << age, by doubling: each step joins two halves of the window
        span = 1
        while span < WINDOW_IDS:
            h[span:] += h[:-span] << _U(span)
            span *= 2
        found.append(np.flatnonzero((h[before:] >> _U(20)) & _U(MASK) == 0) + (lo + 1))
    return np.concatenate(found)


def cut_points(found: list[int], n: int) -> list[int]:
    """Ends of a document's chunks: at its marks, LEAST to MOST ids apart, and at n.

    A mark before LEAST is never taken, so ids of another document ahead in the stream have no influence.
    """
    ends, last = [], 0
    for m in [*found, n]:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST or m == n and m > last:
            ends.append(m)
            last = m
    return ends


def digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd node moves up as it is. Leaves and nodes are hashed apart."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


_ROW = "kind string, place long, doc_id long, n_tokens long, digests array<binary>, lengths array<int>, digest binary, content binary"
_FIELDS = ["kind", "place", "doc_id", "n_tokens", "digests", "lengths", "digest", "content"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], _FIELDS)


def write_store(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> None:
    """Encodes each text, closes it with the end id and writes the store to path."""
    vocabulary = vocabulary or vocabulary_path()

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        sent: set[bytes] = set()
        task = TaskContext.get().partitionId()
        number = 0
        for whole in batches:
            for b in pieces(iter([whole]), BATCH_BYTES, "text"):
                rows: list[tuple] = []
                end_id = np.array([END_ID], e.dtype)
                encoded = [part for ids in e.encode(b.column("text")) for part in (ids, end_id)]
                sizes = np.array([len(p) for p in encoded], np.int64).reshape(-1, 2).sum(axis=1)
                stream = np.concatenate(encoded)
                raw, width = stream.tobytes(), e.dtype.itemsize
                cuts = marks(stream)
                opens = np.cumsum(sizes) - sizes
                lo, hi = np.searchsorted(cuts, opens, side="right").tolist(), np.searchsorted(cuts, opens + sizes).tolist()
                for k, (doc, n, base) in enumerate(zip(b.column("doc_id").to_pylist(), sizes.tolist(), opens.tolist(), strict=True)):
                    at, digests, lengths = 0, [], []
                    for end in cut_points((cuts[lo[k] : hi[k]] - base).tolist(), n):
                        content = raw[(base + at) * width : (base + end) * width]
                        d = digest(content)
                        digests.append(d)
                        lengths.append(end - at)
                        at = end
                        if d not in sent:
                            if len(sent) >= 1_000_000:  # forgetting only sends a chunk once more
                                sent.clear()
                            sent.add(d)
                            rows.append(("chunk", int.from_bytes(d[:8], "little", signed=True), None, None, None, None, d, content))
                    number += 1
                    rows.append(("recipe", (task * 0x9E3779B1 + number * 0x85EBCA77) & 0x7FFFFFFF, doc, n, digests, lengths, None, None))
                yield _rows(rows)

    spark = docs.sparkSession
    staged = texts(docs, key, text).mapInArrow(chunk, _ROW)
    # a chunk's place is part of its digest: equal chunks are neighbours in the window
    before = F.lag("digest").over(Window.partitionBy("place").orderBy("digest"))
    one = staged.repartition("place").withColumn("before", before).where("kind = 'recipe' or before is null or before <> digest")
    one.drop("place", "before").write.partitionBy("kind").parquet(f"{path}/staged")
    _publish(spark, path, encoder(vocabulary).dtype.itemsize)


_STAGED = "kind string, doc_id long, n_tokens long, digests array<binary>, lengths array<int>, digest binary, content binary"
_RECIPE = "doc_id long, part int, n_tokens long, start long, root binary, digests array<binary>, lengths array<int>"
_MANIFEST = "part int, first_doc long, last_doc long, n_docs long, n_tokens long, start long, root binary, width int"


def _publish(spark: SparkSession, path: str, width: int) -> None:
    staged = spark.read.schema(_STAGED).parquet(f"{path}/staged").where("kind = 'recipe'").select("doc_id", "n_tokens", "digests", "lengths")
    ranged = staged.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.element_at("digests", 1))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            begin = start + np.cumsum(n) - n
            start += int(n.sum())
            roots = [merkle_root(d) for d in b.column("digests").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([part] * b.num_rows, pa.int32()), b.column("n_tokens"), pa.array(begin, pa.int64()), pa.array(roots, pa.binary()), b.column("digests"), b.column("lengths")],
                ["doc_id", "part", "n_tokens", "start", "root", "digests", "lengths"],
            )

    ranged.mapInArrow(number, _RECIPE).write.parquet(f"{path}/recipes")  # start: within its partition; the manifest has the partition's
    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes")

    def seal(part: pa.Table) -> pa.Table:
        part = part.sort_by("start")
        n, doc = part.column("n_tokens").to_pylist(), [d for d in part.column("doc_id").to_pylist() if d is not None]
        return pa.Table.from_pylist(
            [{"part": part.column("part")[0].as_py(), "first_doc": min(doc, default=None), "last_doc": max(doc, default=None), "n_docs": len(n), "n_tokens": sum(n), "start": 0, "root": merkle_root(part.column("root").to_pylist()), "width": width}],
            schema=pa.schema([("part", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("start", pa.int64()), ("root", pa.binary()), ("width", pa.int32())]),
        )

    # one small row for each partition: the running total over them is a window over so many rows
    sealed = recipes.select("part", "doc_id", "n_tokens", "start", "root").groupBy("part").applyInArrow(seal, _MANIFEST)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sealed.withColumn("start", before).coalesce(1).write.parquet(f"{path}/manifest")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STAGED).parquet(f"{path}/staged").where("kind = 'chunk'").select("digest", "content")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with each document's start in the whole stream."""
    parts = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").select("part", F.col("start").alias("before"))
    return spark.read.schema(_RECIPE).parquet(f"{path}/recipes").join(parts, "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


_POLY = 0xEDB88320


def _zero_operators(n: int) -> list[np.ndarray]:
    """For k < n the 32 columns of the linear map of a CRC-32 that 2**k zero bytes effect."""

    def apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for bit in range(32):
            out ^= np.where((x >> bit) & 1, columns[bit], 0).astype(np.uint32)
        return out

    one_bit = np.array([_POLY] + [1 << k for k in range(31)], np.uint32)
    op = one_bit
    for _ in range(3):
        op = apply(op, op)
    out = [op]
    while len(out) < n:
        out.append(apply(out[-1], out[-1]))
    return out


def shifted_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc32(a + b) is shifted_crc(crc32(a), len(b)) ^ crc32(b)."""
    x = crc.astype(np.uint32)
    for k, columns in enumerate(_zero_operators(max(1, int(n_bytes.max(initial=0)).bit_length()))):
        rows = np.flatnonzero((n_bytes >> k) & 1)
        if len(rows):
            y, z = x[rows], np.zeros(len(rows), np.uint32)
            for bit in range(32):
                z ^= np.where((y >> np.uint32(bit)) & 1, columns[bit], 0).astype(np.uint32)
            x[rows] = z
    return x


def width_of(spark: SparkSession, path: str) -> int:
    """Bytes of a stored id, as the manifest has it."""
    first = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").select("width").first()
    return first["width"] if first else 2  # an empty store has none


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) from the stored files.

    verified: every chunk's content has its digest and length, and the recipe's root is that of its chunks.
    """
    width = width_of(spark, path)
    wide = np.dtype(f"<u{width}")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column("content").to_pylist()
            crc = [zlib.crc32(np.frombuffer(c, wide).astype("<u4").tobytes()) for c in found]
            sound = [digest(c) == d for c, d in zip(found, b.column("digest").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([len(c) // width for c in found], pa.int64()), pa.array(crc, pa.int64()), pa.array(sound, pa.bool_())], ["digest", "stored_ids", "crc", "sound"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                some = b.slice(lo, 2000)
                lists = some.column("digests").to_pylist()
                sizes = some.column("lengths").to_pylist()
                right = [merkle_root(d) == r and sum(s) == n for d, r, s, n in zip(lists, some.column("root").to_pylist(), sizes, some.column("n_tokens").to_pylist(), strict=True)]
                n = np.array([len(d) for d in lists])
                after = [np.sum(s) - np.cumsum(s) for s in sizes]
                row = np.repeat(np.arange(len(n)), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id").take(pa.array(row)),
                        some.column("start").take(pa.array(row)),
                        pa.array([d for x in lists for d in x], pa.binary()),
                        pa.array(np.concatenate(sizes), pa.int64()),
                        pa.array(np.concatenate(after), pa.int64()),
                        pa.array(np.repeat(np.array(right), n)),
                    ],
                    ["doc_id", "start", "digest", "ids", "after", "right"],
                )

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = shifted_crc(b.column("crc").to_numpy(), 4 * b.column("after").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("ids"), pa.array(x.astype(np.int64)), b.column("ok")], ["doc_id", "start", "ids", "crc", "ok"])

    stored = chunks(spark, path).mapInArrow(sums, "digest binary, stored_ids long, crc long, sound boolean")
    parts = recipes(spark, path).mapInArrow(explode, "doc_id long, start long, digest binary, ids long, after long, right boolean")
    met = parts.join(stored, "digest", "left").select("doc_id", "start", "ids", "after", F.coalesce("crc", F.lit(0)).alias("crc"), (F.col("right") & F.coalesce(F.col("sound") & (F.col("stored_ids") == F.col("ids")), F.lit(False))).alias("ok"))
    moved = met.mapInArrow(shift, "doc_id long, start long, ids long, crc long, ok boolean")
    return moved.groupBy("doc_id", "start").agg(F.sum("ids").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.bool_and("ok").alias("verified"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>): the ids of each document, from its recipe and the chunks."""
    width = width_of(spark, path)
    r = recipes(spark, path)
    parts = r.select("doc_id", "start", F.posexplode("digests").alias("no", "digest"))

    def join_up(group: pa.Table) -> pa.Table:
        group = group.sort_by("no")
        raw = b"".join(group.column("content").to_pylist())
        ids = np.frombuffer(raw, f"<u{width}").astype(np.int32)
        return pa.table({"doc_id": group.column("doc_id")[:1], "start": group.column("start")[:1], "ids": pa.array([ids], pa.list_(pa.int32()))})

    return parts.join(chunks(spark, path), "digest").groupBy("doc_id", "start").applyInArrow(join_up, "doc_id long, start long, ids array<int>")


def op8_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path)
    return verify(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "verified")
