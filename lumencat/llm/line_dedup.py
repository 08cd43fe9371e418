"""Operator 2: substring deduplication by hashing the units of a text.

A text is cut into lines and each line into sentences; units are the sentences and, after them, the lines of several
sentences. A unit is normalised (case and punctuation at its edges are ignored, white space is one space) and hashed to
128 bits; a sentence of under MIN_UNIT_WORDS words is hashed with those after it until they have CONTEXT_WORDS words, so
that "Yes." alone is never a repeat. In scripts without spaces a character counts as a word. Digests are grouped globally
and the earliest occurrence, by (document id, hash of the row's text, unit number), is kept. Every later occurrence is a repeat. A line that is a
repeat is removed whatever its length. Repeated sentences that follow one another, with sentences without a digest between
them, form a run; runs of at least ``min_words`` words are removed, so long passages go even when other text surrounds
them, and a short sentence stays where the rest of its line is new.

The result keeps the offsets of what was removed and of what was kept, counted in characters of the original text.

Scale: units leave the tasks as a digest and two numbers, never as text, and once per document. The earliest occurrence is
an aggregate with map-side combining; the join back has the small aggregate on one side and is one adaptive execution may
split, so a unit that a third of all documents share is not one task's work. The repeats of a document come back to its
text by one join on the document id and the text's hash. Tasks work on BATCH_BYTES of text at a time.

Defined cases: null text gives null text and no spans; empty text stays empty; equal rows of one document id are one
document, and each row comes out; rows of one id with differing texts are documents of their own, in the order of their
texts' hashes; a row without an id is left as it is, but for repeats within it; within a document the first occurrence
stays; an empty table gives an empty result. Columns beside key and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumencat.llm.common import pieces, stored, table

MIN_UNIT_WORDS = 3
CONTEXT_WORDS = 6
MIN_RUN_WORDS = 10
BATCH_BYTES = 4 << 20
BATCH_ROWS = 5000
_END = re.compile(r"(?<=[.!?…])[ \t]+|(?<=[。！？])(?=[^\s。！？])|[ \t]*\n\s*")
#: Letters of scripts that set no space between words.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]")
_EDGE = " \t\r\f\v.,;:!?…。！？、，\"'()[]{}«»“”‘’*#-"


class Line(str):
    """What is hashed of a whole line."""


def _unit(text: str, a: int, b: int, whole: bool) -> tuple[int, int, int, str] | None:
    words = text[a:b].lower().split()
    if not words:
        return None
    form = " ".join(words)
    n = len(words)
    if not form.isascii():
        spaced, dense = _DENSE.subn(" ", form)
        n = len(spaced.split()) + dense if dense else n
    form = form.strip(_EDGE)
    return a, b, n, Line(form) if whole and n >= MIN_UNIT_WORDS else form


def units(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, what is hashed) of each line's sentences, then of each line of several; blank ones are left out.

    The form of a whole line of MIN_UNIT_WORDS words is a Line. Too little text at the end has no form.
    """
    lines: list[list[tuple[int, int]]] = [[]]
    start = 0
    for m in _END.finditer(text):
        if m.start() > start:
            lines[-1].append((start, m.start()))
        start = m.end()
        if "\n" in m[0]:
            lines.append([])
    if start < len(text):
        lines[-1].append((start, len(text)))
    found, whole = [], []
    for line in lines:
        own = [u for a, b in line if (u := _unit(text, a, b, len(line) == 1))]
        found += own
        if len(line) > 1 and own:
            u = _unit(text, own[0][0], own[-1][1], True)
            if isinstance(u[3], Line):
                whole.append(u)
    for k, (a, b, n, form) in enumerate(found):
        if n < MIN_UNIT_WORDS:
            j = k + 1
            while n < CONTEXT_WORDS and j < len(found):
                n, form = n + found[j][2], f"{form} {found[j][3]}"  # later units still have their own forms
                j += 1
            found[k] = (a, b, found[k][2], form if n >= CONTEXT_WORDS else "")
    return found + whole


def _digest(form: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(form.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


_UNIT = "hi long, lo long, doc_id long, row long, unit int"


def _units(rows: list[list[int | None]]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], [f.split()[0] for f in _UNIT.split(", ")])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First occurrence in its document of each digest; later ones are repeats whatever other documents hold."""
    for b in pieces(batches, BATCH_BYTES, "text"):
        out: list[list[int | None]] = [[], [], [], [], []]
        for key, row, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
            seen: set[str] = set()
            for k, (_, _, _, form) in enumerate(units(text or "")):
                if form and form not in seen:
                    seen.add(form)
                    for column, value in zip(out, (*_digest(form), key, row, k), strict=True):
                        column.append(value)
            if len(out[0]) > 200_000:
                yield _units(out)
                out = [[], [], [], [], []]
        if out[0]:
            yield _units(out)


def runs(found: list[tuple[int, int, int, str]], repeat: list[bool], min_words: int) -> list[tuple[int, int]]:
    """Spans of repeated lines and of the runs of repeats that hold min_words words; sentences without a form inside a run belong to it."""
    spans = [u[:2] for u, again in zip(found, repeat, strict=True) if again and isinstance(u[3], Line)]
    # lines of several sentences follow the sentences
    k, n = 0, next((i for i in range(1, len(found)) if found[i][0] < found[i - 1][1]), len(found))
    while k < n:
        if not repeat[k]:
            k += 1
            continue
        last, words, j = k, 0, k
        while j < n and (repeat[j] or not found[j][3]):
            if repeat[j]:
                last = j
            j += 1
        words = sum(u[2] for u in found[k : last + 1])
        if words >= min_words:
            spans.append((found[k][0], found[last][1]))
        k = last + 1
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str | None, seen_before: np.ndarray | None, min_words: int) -> tuple[str | None, list[tuple[int, int]], list[tuple[int, int]], int, int]:
    """What is left of a text whose units of the given numbers occur earlier elsewhere: text, removed and kept spans, units, removed characters."""
    if text is None:
        return None, [], [], 0, 0
    found = units(text)
    before = set() if seen_before is None else set(seen_before)
    own: dict[str, bool] = {}
    repeat = []
    for k, (_, _, _, form) in enumerate(found):
        repeat.append(form != "" and (form in own or k in before))
        own[form] = True
    gone = runs(found, repeat, min_words)
    kept, at = [], 0
    for a, b in gone:
        if a > at:
            kept.append((at, a))
        at = b
    if at < len(text):
        kept.append((at, len(text)))
    return "".join(text[a:b] for a, b in kept) if gone else text, gone, kept, len(found), sum(b - a for a, b in gone)


_SPAN = "array<struct<start:int,end:int>>"
_CUT = f"doc_id long, text string, removed {_SPAN}, kept {_SPAN}, n_units int, removed_chars long"


def dedup_units(docs: DataFrame, min_words: int = MIN_RUN_WORDS, text: str = "text", key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """Returns (doc_id, text, removed, kept, n_units, removed_chars), one row for each row of docs, then the carried columns."""
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("row"), F.col(text).cast("string").alias("text"))
    found = stored(read.mapInArrow(_emit, _UNIT), "units")
    first = found.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("hi", "lo", "first")
    later = found.join(first, ["hi", "lo"]).where("doc_id <> first").select("doc_id", "row", "unit")
    # ids with several texts: within an id the text of the smallest hash comes first
    several = stored(read.groupBy("doc_id").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").select("doc_id"), "several")
    if not several.isEmpty():
        among = found.join(several, "doc_id", "left_semi")
        before = among.groupBy("hi", "lo", "doc_id").agg(F.min("row").alias("before"))
        later = later.unionByName(among.join(before, ["hi", "lo", "doc_id"]).where("row <> before").select("doc_id", "row", "unit"))
    later = later.groupBy("doc_id", "row").agg(F.collect_set("unit").alias("again"))

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pieces(batches, BATCH_BYTES, "text"):
            for lo in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(lo, BATCH_ROWS)
                rows = [cut(t, again, min_words) for t, again in zip(b.column("text").to_pylist(), b.column("again").to_pylist(), strict=True)]
                spans = lambda i: pa.array([[{"start": x, "end": y} for x, y in r[i]] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), spans(1), spans(2), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.int64()), *(b.column(c) for c in own)],
                    ["doc_id", "text", "removed", "kept", "n_units", "removed_chars", *own],
                )

    own = {f"_carried_{k}": c for k, c in enumerate(carry)}
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(k) for k, c in own.items()))
    schema = StructType([*StructType.fromDDL(_CUT), *(f for f in whole.schema.fields if f.name in own)])
    met = whole.withColumn("row", F.xxhash64("text")).join(later, ["doc_id", "row"], "left").drop("row")
    return met.mapInArrow(cut_all, schema).withColumnsRenamed(own)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_units(table(spark, sf_dir, "documents"))
