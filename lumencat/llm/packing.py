"""Operator 3: packing token ids into sequences by order-preserving dynamic programming.

A task's documents, in the order of their ids, form one stream of token ids, each document closed by the end id. The stream
is cut into windows of at most ``length`` ids. Cuts at a document's end are free; cuts at a sentence's end, or inside a
sentence longer than half a window, cost a truncation penalty. A window is padded to ``length`` unless its own length is a
power of two. Each window also costs WINDOW_COST, so that short exact windows are opened only where they save padding. The
cuts that minimise padding plus penalties come from one pass: the best predecessor of a cut is the
minimum of cost + position over the candidates within ``length``, which a monotone queue keeps; a window of a power of two
is looked up directly.

Scale: there is no shuffle. A task packs the rows it reads, sorted by id, one bounded run of documents at a time: the pass
is closed at a document's end every RUN_TOKENS ids, so memory is bounded whatever the partition holds. Only the last
window of a run pays for that. Sequence ids join the partition's number and a count within it.

Defined cases: null text is empty and still gives its end id; a document longer than a window is cut into several pieces;
ties take the nearest cut; repeated rows are packed as often as they occur; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lumencat.llm.common import pieces, table, texts
from lumencat.llm.tokens import END_ID, encoder, sentence_ends, vocabulary_path

LENGTH = 1024
SENTENCE_PENALTY = 4
INNER_PENALTY = 12
WINDOW_COST = 20
RUN_TOKENS = 4_000_000
BATCH_BYTES = 24 << 20


def best_cuts(position: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Indices of the chosen cuts among candidates at rising positions; index 0 is the start and the last one the end.

    Minimises the sum over windows of padding(end - start) + penalty[end] + WINDOW_COST; no two neighbours are further apart than length.
    """
    pos = position.tolist()
    pen = penalty.tolist()
    n = len(pos)
    exact: dict[int, list[int]] = {}
    number = np.full(pos[-1] + 1, -1, np.int32)  # of the candidate at each position
    number[position] = np.arange(n)
    for k in range(length.bit_length() - (length & (length - 1) == 0)):
        far = np.searchsorted(position, position[0] + (1 << k))
        at = number[position[far:] - (1 << k)]
        hit = np.flatnonzero(at >= 0)
        for i, j in zip((hit + far).tolist(), at[hit].tolist(), strict=True):
            exact.setdefault(i, []).append(j)
    cost = [0] * n
    back = [0] * n
    queue: deque[tuple[int, int, int]] = deque([(0, pos[0], 0)])  # cost + position, position, index: keys rise from the left
    for i in range(1, n):
        p = pos[i]
        while queue[0][1] < p - length:
            queue.popleft()
        key, _, j = queue[0]
        best = key + length - p
        for e in exact.get(i, ()):
            if cost[e] < best:
                best, j = cost[e], e
        cost[i] = best = best + pen[i] + WINDOW_COST
        back[i] = j
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, i))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, at_sentence: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, with penalties. ends: the positions after each document."""
    penalty = np.full(len(ids) + 1, -1, np.int32)
    penalty[1:][at_sentence[ids]] = SENTENCE_PENALTY
    penalty[0] = 0
    penalty[ends] = 0
    place = np.flatnonzero(penalty >= 0)
    gap = np.diff(place)
    for k in np.flatnonzero(gap > length // 2):  # a long sentence: every 16th id of it may end a window
        penalty[place[k] + 16 : place[k + 1] : 16] = INNER_PENALTY
    place = np.flatnonzero(penalty >= 0)
    return place, penalty[place]


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE_IDS = _PIECE + ", ids array<int>"


def _pack(docs: list[tuple[int, np.ndarray]], length: int, at_sentence: np.ndarray, first_sequence: int, with_ids: bool) -> tuple[pa.RecordBatch, int]:
    ids = np.concatenate([d[1] for d in docs]).astype("<u4")
    sizes = np.array([len(d[1]) for d in docs], np.int64)
    ends = np.cumsum(sizes)
    position, penalty = candidates(ids, ends, at_sentence, length)
    cuts = position[best_cuts(position, penalty, length)]
    # pieces: between neighbours among all window cuts and document ends
    edges = np.union1d(cuts, np.concatenate([[0], ends]))
    start, stop = edges[:-1], edges[1:]
    doc = np.searchsorted(ends, start, side="right")
    window = np.searchsorted(cuts, start, side="right") - 1
    raw = memoryview(ids.tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
    keys = np.array([d[0] if d[0] is not None else 0 for d in docs], np.int64)
    null = np.array([d[0] is None for d in docs])
    columns = [
        pa.array(keys[doc], pa.int64(), mask=null[doc]),
        pa.array(start - (ends - sizes)[doc]),
        pa.array(stop - start),
        pa.array(crc, pa.int64()),
        pa.array(sizes[doc]),
        pa.array(first_sequence + window),
        pa.array(start - cuts[window]),
    ]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names), len(cuts) - 1


def pack(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, with_ids: bool = False, batch_bytes: int = BATCH_BYTES, kept_units: int | None = None) -> DataFrame:
    """Returns one row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    batch_bytes: text that is encoded at a time; less takes less memory and, as fewer words repeat, more time.
    kept_units: units a worker keeps for its later batches and tasks, as the encoder has it.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        at_sentence = sentence_ends(path)
        sequence = TaskContext.get().partitionId() << 36
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0
        for whole in batches:
            for b in pieces(iter([whole]), batch_bytes, "text"):
                for k, ids in zip(b.column("doc_id").to_pylist(), e.encode(b.column("text"), kept_units), strict=True):
                    waiting.append((k, np.append(ids, e.dtype.type(END_ID))))
                    held += len(ids) + 1
                    if held >= RUN_TOKENS:
                        out, n = _pack(waiting, length, at_sentence, sequence, with_ids)
                        yield out
                        sequence, waiting, held = sequence + n, [], 0
        if waiting:
            yield _pack(waiting, length, at_sentence, sequence, with_ids)[0]

    return texts(docs, key, text).sortWithinPartitions("doc_id", "text").mapInArrow(run, _PIECE_IDS if with_ids else _PIECE)


def op3_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
