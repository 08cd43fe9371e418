"""Operator 13: spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, so anagrams have equal keys and one letter more,
less or other changes a key by that letter's power, or by the difference of two. Each word is entered under its key and
under its key without each of its letters. Words meet where two entries are equal: key and reduced key for an addition or
removal, two reduced keys for an exchange. Only entries that several words share are looked at further. There the order of
letters is verified by fingerprints of the word without the letter at each of its places: equal fingerprints at one place are
an exchange, a fingerprint that is another word's own is a removal.

Scale: texts are read once and counted in the tasks; what follows is on distinct words. Entries are counted with map-side
combining and joined on their number, which adaptive execution may split. No pairs of a key are formed: verified entries are
grouped by fingerprint and place, a group holds words that differ in one letter at one place and so at most as many as there
are letters (90). Removals give one row for each place of a word at most. Chains of forms are followed by doubling.

Defined cases: null text has no words; a null id is written as an empty one; repeated rows count again; words of any length
are taken (fingerprints of all places of a word are found in one walk); extra columns are ignored; an empty table gives an
empty result. Keys are taken modulo 2**63, fingerprints are two hashes modulo 2**61 - 1.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencat.llm.common import pieces, stored, table

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is so many times as frequent as its variant.
FORM_RATIO = 5
#: One run in so many of a document loses a letter.
SLIP = 199
BATCH_BYTES = 8 << 20
TASK_WORDS = 300_000

_POWER = 5
_KEYS = (1 << 63) - 1
_PRIME = (1 << 61) - 1
_BASES = (0x0F3C5A1D2B4E6978 % _PRIME, 0x1A2B3C4D5E6F7081 % _PRIME)


def _runs(least: int) -> re.Pattern[bytes]:
    """Maximal runs of that many letters and more in lower-cased UTF-8; U+00C0 to U+00FF are C3 80 to C3 BF."""
    return re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least)


def slipped(run: str, at: int) -> str:
    """run without the letter at at % length if SLIP divides at."""
    if at % SLIP:
        return run
    k = at % len(run)
    return run[:k] + run[k + 1 :]


def _count(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Words of at least that length with their counts in the task."""
    runs = _runs(least)
    counts: Counter[bytes] = Counter()

    def told() -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for b in pieces(batches, BATCH_BYTES, "text"):
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            head = zlib.crc32(b":" if i is None else b"%d:" % i)
            own = Counter(runs.findall(text.lower()))
            for run in [run for run in own if not zlib.crc32(run, head) % SLIP]:
                n = own.pop(run)
                word = slipped(run.decode(), zlib.crc32(run, head))
                if len(word) >= least:
                    counts[word.encode()] += n
            counts.update(own)
        if len(counts) > TASK_WORDS:
            yield told()
            counts.clear()
    if counts:
        yield told()


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the texts' words after the slips of letters."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = d.mapInArrow(lambda batches: _count(batches, least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def key(word: str) -> int:
    return sum(ord(c) ** _POWER for c in word) & _KEYS


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, letter, word, n): each word under its key (letter null) and under its key without each of its letters."""
    for b in batches:
        words, keys, letters, at = b.column("word").to_pylist(), [], [], []
        for i, word in enumerate(words):
            own = key(word)
            distinct = set(word)
            keys.append(own)
            letters.append(None)
            keys.extend((own - ord(c) ** _POWER) & _KEYS for c in distinct)
            letters.extend(distinct)
            at.extend([i] * (len(distinct) + 1))
        rows = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(letters, pa.string()), b.column("word").take(rows), b.column("n").take(rows)], ["key", "letter", "word", "n"])


def fingerprints(word: str, letter: str | None) -> list[tuple[int | None, int, int]]:
    """(place, two hashes) of the word without each occurrence of the letter; of the whole word, place null, without one."""
    out: list[tuple[int, int]] = []
    places = [None] if letter is None else [p for p, c in enumerate(word) if c == letter]
    hashes = []
    for base in _BASES:
        heads, power = [0], [1]
        for c in word:
            heads.append((heads[-1] * base + ord(c)) % _PRIME)
            power.append(power[-1] * base % _PRIME)
        m = len(word)
        # the head up to the place, moved past the tail behind it, and that tail
        hashes.append([heads[m] if p is None else (heads[p] * power[m - p - 1] + heads[m] - heads[p + 1] * power[m - p - 1]) % _PRIME for p in places])
    out = list(zip(*hashes, strict=True))
    return [(p, *h) for p, h in zip(places, out, strict=True)]


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries with the fingerprint of each place of their letter; a removal's fingerprint stands at its first place (first)."""
    for b in batches:
        at, place, one, two, first = [], [], [], [], []
        for i, (word, letter) in enumerate(zip(b.column("word").to_pylist(), b.column("letter").to_pylist(), strict=True)):
            seen = set()
            for p, x, y in fingerprints(word, letter):
                at.append(i)
                place.append(p)
                one.append(x)
                two.append(y)
                first.append((x, y) not in seen)
                seen.add((x, y))
        rows = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("key").take(rows), pa.array(place, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(first, pa.bool_()), b.column("word").take(rows), b.column("n").take(rows)], ["key", "place", "one", "two", "first", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best struct<n, word>) of the words that have near ones; best.n is negative, the least is the best."""
    entries = stored(words.select("word", "n").mapInArrow(_entries, "key long, letter string, word string, n long"), "entries")
    shared = entries.groupBy("key").agg(F.count("*").alias("_c")).where("_c > 1").select("key")
    ordered = entries.join(shared, "key", "left_semi").mapInArrow(_ordered, "key long, place long, one long, two long, first boolean, word string, n long")
    ordered = stored(ordered, "ordered")
    at = ["key", "one", "two"]
    row = F.struct((-F.col("n")).alias("n"), F.col("word"))

    # words that are equal but for the letter at one place: as many as there are letters at most
    group = ordered.where(F.col("place").isNotNull()).groupBy(*at, "place").agg(F.sort_array(F.collect_list(row)).alias("all")).where(F.size("all") > 1)
    other = F.when(F.col("w") == F.col("all")[0], F.col("all")[1]).otherwise(F.col("all")[0])
    exchanged = group.select("all", F.explode("all").alias("w")).select("w.word", (F.size("all") - 1).alias("c"), other.alias("best"))

    longer = ordered.where(F.col("place").isNotNull() & F.col("first")).select(*at, row.alias("more"))
    pairs = longer.join(ordered.where(F.col("place").isNull()).select(*at, row.alias("less")), at).select(F.explode(F.array(F.struct(F.col("more").alias("w"), F.col("less").alias("best")), F.struct(F.col("less").alias("w"), F.col("more").alias("best")))).alias("p"))
    removed = pairs.select("p.w.word", F.lit(1).alias("c"), "p.best")
    return exchanged.unionByName(removed).groupBy("word").agg(F.sum("c").cast("long").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms; ``forms`` has word and form, null at the ends. Each round doubles the steps."""
    d = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        following = d.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(d.join(following, "root").select("word", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")), "roots")
        d = moved.select("word", "root")
        if not moved.where("_moved").head(1):
            return d


def variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n), whose words are distinct."""
    found = words.join(near_words(words), "word", "left")
    is_form = -F.col("best.n") >= ratio * F.col("n")
    forms = stored(found.select("word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.n")).alias("form_n")), "forms")
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words and forms."""
    words = stored(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")), "vocabulary")
    return variants(words)
