"""A stored inverted index: for each word, field and document the word's positions, sorted by word.

    postings/    flat (the word without accents), word, field, id, positions: in ranges of (flat, word, id), so that a
                 word's rows are read by themselves, and a frequent word is several files
    vocabulary/  word, field, documents, positions (how many)

Built from token arrays, read by any number of searches: conditions on words reach the Parquet scan. A search's work
is in proportion to the postings of its words, not to the texts. An index that changes is made of such parts: ``segments``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencat.functions.interpret import PREFIX, Clause
from lumencat.functions.text import ACCENTED, PLAIN, deaccent
from lumencat.operators.storage import stored

BATCH_ROWS = 1000


class Index:
    """An index that lies in a folder. Its tables are opened once."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.postings: DataFrame = spark.read.parquet(f"{path}/postings")
        self.vocabulary: DataFrame = spark.read.parquet(f"{path}/vocabulary")


def _post(key_type: pa.DataType, fields: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(lo, BATCH_ROWS)
                for f in fields:
                    lists = b.column(f)
                    row = pc.list_parent_indices(lists).to_numpy()
                    if not len(row):
                        continue
                    table = lists.flatten().dictionary_encode()
                    word = table.indices.to_numpy().astype(np.int64)
                    first = np.concatenate([[True], row[1:] != row[:-1]])
                    place = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
                    order = np.lexsort((place, row, word))
                    opens = np.concatenate([[True], (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])])
                    at = np.flatnonzero(opens)
                    positions = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([table.dictionary.take(pa.array(word[order][at])), pa.array([f] * len(at)), b.column("id").take(pa.array(row[order][at])).cast(key_type), positions], ["word", "field", "id", "positions"])

    return run


def posted(tokens: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(word, field, id, positions) of documents (id, and an array of tokens for each field); nulls are empty."""
    arrays = [F.coalesce(F.col(f), F.array().cast("array<string>")).alias(f) for f in fields]
    kind = tokens.schema["id"].dataType.simpleString()
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return tokens.select("id", *arrays).mapInArrow(_post(key_type, list(fields)), f"word string, field string, id {kind}, positions array<int>")


def write_postings(rows: DataFrame, path: str) -> None:
    """Writes stored posting rows below path, in ranges of (flat, word, id)."""
    kept = rows.select(deaccent(F.col("word")).alias("flat"), "*")
    kept.repartitionByRange("flat", "word", "id").sortWithinPartitions("flat", "word", "field", "id").write.parquet(f"{path}/postings")


def write_index(tokens: DataFrame, fields: Sequence[str], path: str) -> None:
    """Writes the index of documents as one that does not change."""
    write_postings(stored(posted(tokens, fields), "postings"), path)
    rows = tokens.sparkSession.read.parquet(f"{path}/postings")
    rows.groupBy("word", "field").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("positions")).write.parquet(f"{path}/vocabulary")


def of_words(index: Index, words: Sequence[str], prefixes: Sequence[str] = (), fields: Sequence[str] = (), accents: bool = True) -> DataFrame:
    """The postings of words and of words that begin with a prefix; with accents False also of words that differ in accents only."""
    plain = lambda w: w.translate(str.maketrans(ACCENTED, PLAIN))
    flat = F.col("flat")
    tests = [flat.isin(sorted({plain(w) for w in words})) & (F.col("word").isin(sorted(set(words))) if accents else F.lit(True))] * bool(words)
    tests += [flat.startswith(plain(p)) & (F.col("word").startswith(p) if accents else F.lit(True)) for p in sorted(set(prefixes))]
    found = index.postings.where(reduce(lambda a, b: a | b, tests, F.lit(False)))
    return found.where(F.col("field").isin(list(fields))) if fields else found


def clause_hits(index: Index, clauses: Sequence[Clause], fields: Sequence[str]) -> DataFrame:
    """(id, h<clause>_<field> boolean): which clause is found in which field of a document; documents without any have no row.

    Several tokens of a clause must follow each other.
    """
    words = {t for c in clauses for t in (c.tokens[:-1] if c.kind == PREFIX else c.tokens)}
    prefixes = {c.tokens[-1] for c in clauses if c.kind == PREFIX and c.tokens}
    names: dict[tuple[str, str], str] = {("word", w): f"_w{k}" for k, w in enumerate(sorted(words))} | {("prefix", p): f"_p{k}" for k, p in enumerate(sorted(prefixes))}
    picked = []
    for (kind, w), n in names.items():
        is_it = F.col("word") == w if kind == "word" else F.col("word").startswith(w)
        picked.append(F.flatten(F.collect_list(F.when(is_it, F.col("positions")))).alias(n))
    by_field = of_words(index, sorted(words), sorted(prefixes), fields).groupBy("id", "field").agg(*(picked or [F.count("*").alias("_none")]))

    def found(c: Clause) -> Column:
        if not c.tokens:
            return F.lit(False)
        places = [F.col(names["prefix" if c.kind == PREFIX and k == len(c.tokens) - 1 else "word", t]) for k, t in enumerate(c.tokens)]
        if len(places) == 1:
            return F.size(places[0]) > 0
        return F.exists(places[0], lambda p: reduce(lambda a, b: a & b, [F.array_contains(q, p + k) for k, q in enumerate(places[1:], 1)]))

    hits = [F.bool_or(found(c) & (F.col("field") == f)).alias(f"h{k}_{f}") for k, c in enumerate(clauses) for f in fields]
    return by_field.groupBy("id").agg(*(hits or [F.count("*").alias("_none")]))
