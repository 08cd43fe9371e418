"""Operator 6: exact top-k search of binary codes by incremental multi-index hashing.

A code is cut into segments of about log2(n) bits, n being the number of codes indexed together, each with an index from
segment value to codes. A query probes the segment values within radius 0 of its own, then radius 1, and so on, one segment
after another. Once segments 0..s are probed to radius r and the others to r - 1, every code within m * r + s bits is known,
for a farther one differs by more in each. The search stops when the distance of the k-th verified neighbour is within that
bound. There is no other way to a neighbour, whatever n is.

Scale: equal codes are one entry with their k smallest ids, which is all a result can hold of them, so copies cost nothing.
Distinct codes are dealt by hash to shards of about SHARD_CODES and distinct query codes to blocks of BLOCK_QUERIES; a
task searches one block in one shard, its queries side by side, and returns at most k ids a query. Results meet in a window
whose rows are limited before the shuffle. No task holds more than a shard and a block, nothing is broadcast or collected.

Defined cases: null vectors and rows without an id are neither found nor searched; an element that is null or NaN gives a 0 bit; codes
of different lengths never meet; ties in distance go to the smaller id; a query finds itself too; repeated rows of an id
count as often as they occur, k at most; extra columns are not read; an empty table gives an empty result; fewer than k
rows give all.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumencat.llm.common import stored, table

K = 10
QUERY_STEP = 20
MOST_SEGMENT_BITS = 20
SHARD_CODES = 1 << 15
BLOCK_QUERIES = 1 << 8
#: Probes that are looked up at once.
PROBES = 1 << 20


@cache
def masks(bits: int, radius: int) -> np.ndarray:
    """All values of that many bits with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.int64)


class SegmentIndex:
    """Codes, a row of bytes each, with how many ids each stands for, indexed by their segments."""

    def __init__(self, codes: np.ndarray, weight: np.ndarray):
        self.n, n_bytes = codes.shape
        self.bits, self.weight = 8 * n_bytes, weight
        self.words = self._words(codes)
        width = min(MOST_SEGMENT_BITS, self.bits, max(1, round(math.log2(max(2, self.n)))))
        m = -(-self.bits // width)
        self.cuts = [self.bits * s // m for s in range(m + 1)]
        own = self._segments(codes)
        self.order = [np.argsort(own[:, s], kind="stable") for s in range(m)]
        self.bounds = [np.searchsorted(own[o, s], np.arange((1 << (self.cuts[s + 1] - self.cuts[s])) + 1)) for s, o in enumerate(self.order)]

    @staticmethod
    def _words(codes: np.ndarray) -> np.ndarray:
        whole = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
        whole[:, : codes.shape[1]] = codes
        return whole.view(np.uint64)

    def _segments(self, codes: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(codes, axis=1).astype(np.int64)
        return np.stack([bits[:, a:b] @ (1 << np.arange(b - a)[::-1]) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)], axis=1)

    def search(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of every verified code: all that can hold one of a query's k nearest ids are among them."""
        n_queries, m = len(codes), len(self.order)
        words, asked = self._words(codes), self._segments(codes)
        seen = np.zeros(n_queries * self.n, bool)
        within = np.zeros((n_queries, self.bits + 1), np.int64)  # ids at each distance
        live = np.arange(n_queries)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for radius in range(max(b - a for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)) + 1):
            for s in range(m):
                near = masks(self.cuts[s + 1] - self.cuts[s], radius)
                step = max(1, PROBES // max(1, len(near)))
                for lo in range(0, len(live) if len(near) else 0, step):
                    who = live[lo : lo + step]
                    probe = asked[who, s][:, None] ^ near
                    begin = self.bounds[s][probe].reshape(-1)
                    count = self.bounds[s][probe + 1].reshape(-1) - begin
                    total = int(count.sum())
                    if not total:
                        continue
                    # a code has one value in a segment, so no pair comes twice here
                    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(total)
                    query, row = np.repeat(np.repeat(who, len(near)), count), self.order[s][at]
                    pair = query * self.n + row
                    fresh = ~seen[pair]
                    seen[pair[fresh]] = True
                    query, row = query[fresh], row[fresh]
                    distance = np.bitwise_count(self.words[row] ^ words[query]).sum(axis=1, dtype=np.int64)
                    np.add.at(within, (query, distance), self.weight[row])
                    out.append((query, row, distance))
                live = live[within[live, : m * radius + s + 1].sum(axis=1) < k]
            if not len(live):
                break
        none = np.empty(0, np.int64)
        return tuple(np.concatenate([none, *(o[i] for o in out)]) for i in range(3))  # type: ignore[return-value]


def sign_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code binary): one bit an element, set where it is above 0, whole bytes."""

    def run(batches):
        for b in batches:
            out = []
            for v in b.column("v").to_pylist():
                bits = np.nan_to_num(np.array([0.0 if x is None else x for x in v])) > 0
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "code"])

    read = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    return read.mapInArrow(run, "id long, code binary")


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Returns (query_id, neighbour_id, distance, rank) for codes (id, code) and queries (id, code)."""
    smallest = Window.partitionBy("code").orderBy("id")
    entries = codes.select("id", "code").withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = stored(entries, "codes")
    asked = stored(queries.select("code").distinct(), "asked")
    shards = max(1, -(-entries.count() // SHARD_CODES))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.octet_length("code").alias("size")
    left = entries.select("code", "ids", size, deal(shards).alias("shard"), every(blocks).alias("block"))
    right = asked.select("code", size, deal(blocks).alias("block"), every(shards).alias("shard"))

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[tuple[bytes, int, int]] = []
        if mine.num_rows and theirs.num_rows and mine.column("size")[0].as_py():
            bytes_of = lambda t: np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            ids = mine.column("ids").to_pylist()
            index = SegmentIndex(bytes_of(mine), np.array([len(i) for i in ids]))
            query, row, distance = index.search(bytes_of(theirs), k)
            order = np.lexsort((distance, query))
            query, row, distance = query[order], row[order], distance[order]
            bounds = np.searchsorted(query, np.arange(theirs.num_rows + 1))
            for code, lo, hi in zip(theirs.column("code").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                total = np.cumsum(index.weight[row[lo:hi]])
                last = distance[lo + min(int(np.searchsorted(total, k)), hi - lo - 1)]
                stop = lo + int(np.searchsorted(distance[lo:hi], last, side="right"))
                best = sorted((d, i) for r, d in zip(row[lo:stop].tolist(), distance[lo:stop].tolist(), strict=True) for i in ids[r])[:k]
                out += [(code, i, d) for d, i in best]
        elif mine.num_rows:  # codes of no bits are all equal
            out = [(code, i, 0) for code in theirs.column("code").to_pylist() for i in mine.column("ids")[0].as_py()]
        return pa.table({"code": pa.array([o[0] for o in out], pa.binary()), "neighbour_id": pa.array([o[1] for o in out], pa.int64()), "distance": pa.array([o[2] for o in out], pa.int32())})

    place = ["size", "shard", "block"]
    n = shards * blocks  # as many tasks: small rows, much work
    found = left.repartition(n, *place).groupBy(*place).cogroup(right.repartition(n, *place).groupBy(*place)).applyInArrow(search, "code binary, neighbour_id long, distance int")
    order = Window.partitionBy("code").orderBy("distance", "neighbour_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return queries.select(F.col("id").alias("query_id"), "code").join(best, "code").select("query_id", "neighbour_id", "distance", "rank")


def op6_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = stored(sign_codes(table(spark, sf_dir, "embeddings")), "signs")
    return top_k(codes, codes.where(F.col("id") % QUERY_STEP == 0))


OP6_SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as bits from embeddings where embedding is not null
), p as (
  select q.vec_id as query_id, r.vec_id as neighbour_id,
    cast(len(list_filter(range(1, len(q.bits) + 1), lambda i: q.bits[i] <> r.bits[i])) as integer) as distance
  from v q, v r where q.vec_id % {QUERY_STEP} = 0 and len(q.bits) = len(r.bits)
), o as (
  select query_id, neighbour_id, distance, cast(row_number() over (partition by query_id order by distance, neighbour_id) as integer) as rank from p
)
select query_id, neighbour_id, distance, rank from o where rank <= {K}
"""
