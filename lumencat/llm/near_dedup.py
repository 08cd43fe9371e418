"""Operator 4: near-duplicate documents by min-max hashing.

Each document becomes the set of its distinct five-word shingles. Under each of PERMUTATIONS hash functions both the
minimum and the maximum over the set are kept, so that one evaluation of a function yields two independent signature
values, each equal in two sets with probability J. Some values make a band, as many as the threshold allows when at most
MISS of the pairs at it may share none; documents with an equal band are candidates.
Candidates are confirmed on their full sets, and linked documents form components.

Scale: whole texts are read in the tasks, once for the signatures and once more for documents that have a candidate.
Equal sets are collapsed before any comparing, so copies cost one row each. Every document of a band is first confirmed
against the band's smallest one alone, which an aggregate with map-side combining finds: pairs in proportion to the
documents, whatever the band holds. That joins up families of near copies. What is left in bands of several components is
compared through shingles: of two linked sets each has a shared one among its rarest (a prefix filter, exact for the
threshold), so sets that only share a common template meet nothing. The groups that such shared rare shingles connect are
compared in blocks of bounded size: classes of set size, of which only neighbours can hold linked sets, are dealt out to
blocks, a component of many documents to blocks of its own, which are not compared with each other; each pair of blocks is
one task's work. Nothing is capped, sampled or collected to the driver.

Defined cases: null or blank text has an empty set, is linked with nothing and kept; fewer than five words make one
shingle; repeated rows of one doc_id make one result row, linked by any of its texts; rows without an id make one row, which
is linked with nothing and kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumencat.llm.common import components, pieces, stored, table, texts

WORDS = 5
PERMUTATIONS = 84
MISS = 1e-5
BLOCK_SHINGLES = 600_000
BLOCK_DOCS = 1500
#: So many pairs share one copy of the set that they have in common.
FAN = 500
BATCH_BYTES = 4 << 20

_U = np.uint64


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


_PLACE = _odd(WORDS, 5)
_A, _B = _odd(PERMUTATIONS, 11), _odd(PERMUTATIONS, 12)
_FOLD = _odd(2 * PERMUTATIONS, 13)


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits all depend on all input bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Words(dict):
    """Word to 64-bit hash; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; ASCII letters are lowered, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U)
    w = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    if len(w) < WORDS:
        w = np.concatenate([w, np.full(WORDS - len(w), _U(0x5851F42D4C957F2D))])
    n = len(w) - WORDS + 1
    h = w[:n] * _PLACE[0]
    for k in range(1, WORDS):
        h = h + w[k : k + n] * _PLACE[k]
    return np.unique(_mix(h))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 2 * PERMUTATIONS values per non-empty set: the minima, then the maxima, of the same evaluations."""
    out = np.empty((len(sets), 2 * PERMUTATIONS), _U)
    step = 1 << 15
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= step):
            total += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]])]).astype(np.int64) if j - i > 1 else np.zeros(1, np.int64)
        for p in range(PERMUTATIONS):
            h = flat * _A[p]
            h += _B[p]
            h ^= h >> _U(32)
            h *= _U(0xD6E8FEB86659FD93)
            out[i:j, p] = np.minimum.reduceat(h, starts)
            out[i:j, PERMUTATIONS + p] = np.maximum.reduceat(h, starts)
        i = j
    return out


def layout(per_cent: int) -> tuple[int, int]:
    """(bands, rows) with the most rows for which a pair of that similarity shares no band with probability MISS at most."""
    for rows in range(2 * PERMUTATIONS, 0, -1):
        bands = 2 * PERMUTATIONS // rows
        if (1 - (per_cent / 100) ** rows) ** bands <= MISS:
            return bands, rows
    raise ValueError(f"{PERMUTATIONS} functions miss too many pairs at {per_cent} per cent")


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Folds each band of signature values to one 64-bit key that also tells the band."""
    values = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = (values * _FOLD[:rows]).sum(axis=2, dtype=_U) + np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    return _mix(key)


_SIGNED = "doc_id long, n_shingles long, digest binary, node long, keys array<long>"


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def node(digest_: bytes) -> int:
    """The number of a set: half of its digest, as shingles are 64 bits too."""
    return int.from_bytes(digest_[:8], "little", signed=True)


def _sign(batches: Iterator[pa.RecordBatch], n_bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(iter([whole]), BATCH_BYTES, "text"):
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(signatures([sets[i] for i in full]), n_bands, rows).view(np.int64) if full else np.empty((0, n_bands), np.int64)
            lengths = np.zeros(len(sets), np.int32)
            lengths[full] = n_bands
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            digests = [digest(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([node(x) for x in digests], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1), pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "node", "keys"],
            )


def prefix(size: np.ndarray | int, per_cent: int):
    """How many shingles of a set, in any order that all sets have in common, must hold one of a linked set's."""
    return size - -(-per_cent * size // 100) + 1


def links_within(sets: list[np.ndarray], per_cent: int, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links 100 * |a & b| >= per_cent * |a | b| between sorted sets, those of equal parts taken as joined.

    A linked pair shares one of the first s - ceil(per_cent * s / 100) + 1 shingles of each set when all sets are ordered
    by the same rank, here rarest first; those are indexed. Sizes must differ by less than the threshold allows.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.empty(0, _U)
    doc = np.repeat(np.arange(n), size)
    token, count = np.unique(flat, return_inverse=True, return_counts=True)[1:]
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    order = np.lexsort((rank[token], doc))
    token, doc = token[order], doc[order]
    start = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(len(doc)) - start[doc]
    inside = (place < prefix(size, per_cent)[doc]) & (count[token] > 1)
    p_doc, p_token = doc[inside], token[inside]
    by_token = np.argsort(p_token, kind="stable")
    p_doc_sorted = p_doc[by_token]
    bounds = np.searchsorted(p_token[by_token], np.arange(len(count) + 1))
    every = np.argsort(token, kind="stable")
    every_doc, every_at = doc[every], np.searchsorted(token[every], np.arange(len(count) + 1))
    p_start = np.searchsorted(p_doc, np.arange(n + 1))
    part = np.arange(n) if parts is None else np.unique(parts, return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    for d in range(n):
        lists = [p_doc_sorted[bounds[t] : bounds[t + 1]] for t in p_token[p_start[d] : p_start[d + 1]]]
        if not lists:
            continue
        near = np.unique(np.concatenate(lists))
        near = near[near < d]
        s = size[near]
        near = near[(part[near] != part[d]) & (100 * np.minimum(s, size[d]) >= per_cent * np.maximum(s, size[d]))]
        if not len(near):
            continue
        if len(near) > 24:
            common = np.zeros(n, np.int64)
            for t in token[start[d] : start[d + 1]]:
                if count[t] > 1:
                    common[every_doc[every_at[t] : every_at[t + 1]]] += 1
            common = common[near]
        else:
            common = np.array([len(np.intersect1d(sets[d], sets[e], assume_unique=True)) for e in near], np.int64)
        linked = near[100 * common >= per_cent * (size[near] + size[d] - common)]
        for e in linked:
            if part[e] != part[d]:
                links.append((d, int(e)))
                part[part == part[e]] = part[d]
    return links


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the wanted texts: a row's own set is that of its node, unless its id has several texts."""
    for b in pieces(batches, BATCH_BYTES, "text"):
        sets = [shingle_set(t) for t in b.column("text").to_pylist()]
        own = [k for k, (s, n) in enumerate(zip(sets, b.column("node").to_pylist(), strict=True)) if node(digest(s)) == n]
        yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(own, pa.int64())), pa.array([sets[k].tobytes() for k in own], pa.binary())], ["node", "shingles"])


def confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) are linked. A set that many pairs share as b is sent once for FAN of them."""
    fan = pairs.groupBy("b").agg(F.ceil(F.count("*") / FAN).cast("int").alias("copies"))
    salted = pairs.join(fan, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("salt"))
    spread = sets.join(fan, F.col("node") == F.col("b")).select("b", F.col("shingles").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    met = salted.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(spread, ["b", "salt"]).select("a", "b", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(iter([whole]), BATCH_BYTES, "sa"):
                good = []
                for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                    if 100 * min(len(x), len(y)) < per_cent * max(len(x), len(y)):
                        good.append(False)
                        continue
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * common >= per_cent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return met.mapInArrow(check, "a long, b long")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle."""
    for b in pieces(batches, BATCH_BYTES, "shingles"):
        lists = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("shingles")]
        row = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
        yield pa.RecordBatch.from_arrays([b.column("node").take(row), b.column("part").take(row), pa.array(np.repeat([len(x) for x in lists], [len(x) for x in lists]), pa.int64()), pa.array(np.concatenate(lists) if lists else [], pa.int64())], ["node", "part", "size", "shingle"])


def linked_through_shingles(sets: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) that join all linked sets (node, part, shingles) of different parts to one component each."""
    tokens = sets.mapInArrow(_spread, "node long, part long, size long, shingle long")
    # stored, so that what is joined is no aggregate and adaptive execution may split a frequent shingle's rows
    shared = stored(tokens.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    # shingles of one set alone are the rarest: they fill a prefix before any shared one
    met = stored(tokens.join(shared, "shingle").select("node", "part", "size", "shingle", "n"), "shared")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("n", "shingle"))
    rare = met.withColumn("alone", F.col("size") - F.count("*").over(Window.partitionBy("node"))).withColumn("rank", rank + F.col("alone"))
    whole = -F.floor(-F.col("size") * per_cent / 100)
    rare = rare.where(F.col("rank") <= F.col("size") - whole + 1).select("node", "part", "shingle")
    rare = stored(rare, "rare")
    heads = stored(rare.groupBy("shingle").agg(F.min("node").alias("b"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("shingle", "b"), "firsts")
    near = rare.join(heads, "shingle").select(F.col("node").alias("a"), "b").distinct()
    coarse = components(near, "coarse")

    n_shingles = F.octet_length("shingles") / 8
    # linked sets are in one class of size or in neighbouring ones
    width = math.log(100 / per_cent) * 1.0001 if per_cent < 100 else 1e-9
    members = sets.join(coarse, "node").select("node", "part", "component", n_shingles.alias("n_shingles"), F.floor(F.log(n_shingles) / width).cast("long").alias("class"))
    blocks = F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int")
    large = members.groupBy("component", "part").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_DOCS // 2).select("component", "part", F.col("part").alias("own"))
    small = members.groupBy("component").agg((blocks == 1).alias("small"))  # a small group is not cut
    members = members.join(large, ["component", "part"], "left").join(small, "component")
    members = members.select("node", "part", "component", "n_shingles", F.when(F.col("small"), 0).otherwise(F.col("class")).alias("class"), F.when(~F.col("small"), F.col("own")).alias("own"))
    members = stored(members, "members")
    cells = members.groupBy("component", "class", "own").agg(blocks.alias("blocks"))
    mine = F.struct(F.col("class"), F.col("own"), F.pmod(F.xxhash64("node"), F.col("mine")).cast("int").alias("block"))
    own_cell = cells.toDF("c", "k", "o", "mine")
    place = members.join(own_cell, (F.col("component") == F.col("c")) & (F.col("class") == F.col("k")) & F.col("own").eqNullSafe(F.col("o"))).select("node", "part", "component", mine.alias("mine"))
    other = cells.select("component", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("class"), F.col("own"), k.alias("block")))).alias("other"))
    # all of one large component's blocks hold nothing to compare with each other
    apart = (F.abs(F.col("mine.class") - F.col("other.class")) <= 1) & (F.col("mine.own").isNull() | ~F.col("mine.own").eqNullSafe(F.col("other.own")))
    pairs = place.join(other, "component").where(apart).select("node", "part", "component", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    dealt = pairs.join(sets.select("node", "shingles"), "node")

    def confirm(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        ids = group.column("node").to_numpy()
        found = links_within([np.frombuffer(s, _U) for s in group.column("shingles").to_pylist()], per_cent, group.column("part").to_numpy())
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[at[:, 0]], pa.int64()), "b": pa.array(ids[at[:, 1]], pa.int64())})

    return dealt.groupBy("component", "low", "high").applyInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, per_cent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Returns (doc_id, n_shingles, component_id, kept), one row per distinct document id."""
    read = texts(docs, key, text)
    n_bands, rows = layout(per_cent)
    signed = stored(read.mapInArrow(lambda batches: _sign(batches, n_bands, rows), _SIGNED), "signed")
    full = signed.where("n_shingles > 0")
    heads = stored(full.groupBy("digest").agg(F.min("doc_id").alias("head"), F.first("node").alias("node"), F.first("keys").alias("keys")), "heads")
    copies = full.select("doc_id", "digest").join(heads.select("digest", "head"), "digest").where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))

    bands = heads.select("node", F.explode("keys").alias("key"))
    first = bands.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low")
    members = stored(bands.join(first, "key").select("key", "node", "low"), "bands")
    wanted = members.select("node").distinct().join(heads.select("node", "head"), "node")
    found = read.join(wanted, F.col("doc_id") == F.col("head")).select("node", "text").mapInArrow(_sets, "node long, shingles binary")
    sets = stored(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    with_first = stored(confirmed(members.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), sets, per_cent), "with_first")

    parts = components(with_first, "parts")
    rest = members.where("node <> low").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    several = rest.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key")
    open_ = stored(rest.join(several, "key", "left_semi").select("node", "part").distinct(), "open")
    links = with_first
    if not open_.isEmpty():
        links = links.unionByName(linked_through_shingles(stored(sets.join(open_, "node").select("node", "part", "shingles"), "open_sets"), per_cent))
    ids = heads.select("node", "head")
    by_id = links.join(ids.toDF("a", "head_a"), "a").join(ids.toDF("b", "head_b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    label = F.coalesce("component", "doc_id")
    sizes = signed.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    joined = components(by_id.unionByName(copies), "links").withColumnRenamed("node", "doc_id")
    return sizes.join(joined, "doc_id", "left").select("doc_id", "n_shingles", label.alias("component_id"), F.coalesce(label == F.col("doc_id"), F.lit(True)).alias("kept"))


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
