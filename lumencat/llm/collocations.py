"""Operator 12: collocations by growth of contiguous patterns, in the manner of PrefixSpan.

Words are counted first. Then every occurrence of a frequent word that a frequent word follows is projected: a pointer
that carries the words it may grow by, as hashes. Equal pointers of a batch are one pointer with a weight. Each prefix of
two words is one task's work: its pointers arrive sorted, so the runs of the next word are its extensions, and those that
are frequent are extended in turn, depth first, until MAX_WORDS. What is frequent nowhere is extended nowhere.

Scale: two passes over the texts, two shuffles of counts. Words that cannot be frequent are cut out of the pointers by a
bit table of fixed size (2**FILTER_BITS), which only prunes: counts decide. Pointers are dealt out by their first two
words, so a very frequent word is spread over the words behind it. Where both of the two are more than one word in
HOT_SHARE of all words (at most HOT_SHARE words can be, which bounds that broadcast), their pointers are dealt out by
the third word also, and their counts are added up afterwards. A task holds the pointers of one prefix at most, after
equal ones of a batch are one. Scores are decimals of 38 digits; a rank list takes the first rows of each task first.

Defined cases: null text is empty; null language is ``und``; a text without words gives nothing; repeated rows count again;
extra columns are ignored; an empty table gives an empty result. Words are told apart by 64-bit hashes, seeded by language;
frequent words of equal hash are found and another seed is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumencat.llm.common import pieces, stored, table

MAX_WORDS = 3
MIN_COUNT = 10
COVER_PER_CENT = 50
BEST = 2000
FILTER_BITS = 27
HOT_SHARE = 1024
BATCH_BYTES = 6 << 20
#: Words of a language that a worker numbers before it starts anew.
LOCAL_WORDS = 400_000

UNKNOWN = "und"
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)


class _Words(dict):
    """Words of one language with local numbers; number 0 is the end of a piece."""

    def __init__(self, lang: str, seed: int):
        self.seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8"), seed)
        self.list: list[bytes] = []
        self.hashes = np.empty(0, np.int64)
        self[b"."]  # noqa: B018  (takes number 0)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.list)
        self.list.append(word)
        return n

    def numbers(self, texts: list[bytes]) -> np.ndarray:
        words = b"\n".join(texts).lower().translate(_ENDS).replace(b".", b" . ").split()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        new = [xxhash.xxh3_64_intdigest(w, self.seed) for w in self.list[len(self.hashes) :]]
        self.hashes = np.concatenate([self.hashes, np.array(new, np.uint64).view(np.int64)])
        return out


def _by_language(b: pa.RecordBatch) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
        out.setdefault(lang, []).append(text)
    return out


_COUNTED = "lang string, hash long, word string, n long"


def _count(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """The words of a task with their counts, and one row a language with word null for the number of all its words."""
    held: dict[str, tuple[_Words, list[np.ndarray]]] = {}

    def told(lang: str) -> pa.RecordBatch:
        words, parts = held.pop(lang)
        n = np.zeros(len(words.list), np.int64)
        for p in parts:
            n[: len(p)] += p
        n[0] = 0
        at = np.flatnonzero(n)
        names = pa.array([words.list[i] for i in at.tolist()] + [None], pa.binary()).cast(pa.string())
        count = np.append(n[at], n.sum())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(count)), pa.array(np.append(words.hashes[at], 0)), names, pa.array(count)], ["lang", "hash", "word", "n"])

    for b in pieces(batches, BATCH_BYTES, "text"):
        for lang, texts in _by_language(b).items():
            if lang not in held:
                held[lang] = (_Words(lang, seed), [])
            words, parts = held[lang]
            parts.append(np.bincount(words.numbers(texts)))
            if len(words.list) > LOCAL_WORDS or len(parts) >= 64:
                yield told(lang)
    for lang in list(held):
        yield told(lang)


def word_counts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(lang, hash, word, n): the occurrences of each word; word null and hash 0 hold the number of all words of a language."""
    counted = _texts(docs).mapInArrow(lambda batches: _count(batches, seed), _COUNTED)
    return counted.groupBy("lang", "hash", "word").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text.alias("text"))


def _in_table(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Of each hash whether its bit is set; the table's size is a power of two."""
    bit = h & np.int64(64 * len(bits) - 1)
    return (bits[bit >> np.int64(6)] >> (bit & np.int64(63))) & 1 == 1


def bit_table(words: DataFrame, filter_bits: int = FILTER_BITS) -> np.ndarray:
    """The hashes of words as a table of 2**filter_bits bits, whatever their number."""
    bit = F.col("hash").bitwiseAND(F.lit((1 << filter_bits) - 1))
    one = F.expr("shiftleft(1L, cast(hash & 63 as int))")
    rows = words.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (filter_bits - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _pointers(batches: Iterator[pa.RecordBatch], seed: int, bits: Broadcast, hot: Broadcast, depth: int) -> Iterator[pa.RecordBatch]:
    """Of each batch the distinct windows of frequent words, up to depth words long, with their number."""
    held: dict[str, tuple[_Words, np.ndarray, np.ndarray]] = {}
    for b in pieces(batches, BATCH_BYTES, "text"):
        for lang, texts in _by_language(b).items():
            words, frequent, parts = held.pop(lang, None) or (_Words(lang, seed), np.zeros(0, bool), np.zeros(0, np.int64))
            ids = words.numbers(texts)
            new = words.hashes[len(frequent) :]
            frequent = np.concatenate([frequent, _in_table(new, bits.value)])
            frequent[0] = False
            parts = np.concatenate([parts, np.array([hot.value.get(h, 1) for h in new.tolist()], np.int64)])
            if len(words.list) <= LOCAL_WORDS:
                held[lang] = (words, frequent, parts)
            ids = np.where(frequent[ids], ids, -1)
            start = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)) if len(ids) > 1 else np.empty(0, np.int64)
            if not len(start):
                continue
            ids = np.concatenate([ids, np.full(depth, -1, np.int64)])
            columns = [ids[start], ids[start + 1]]
            for k in range(2, depth):
                columns.append(np.where(columns[-1] >= 0, ids[start + k], -1))
            key = columns[0]
            for k in range(1, depth):
                key = key * np.int64(len(words.list) + 1) + columns[k] + 1
                if k < depth - 1:
                    key = np.unique(key, return_inverse=True)[1]
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            columns = [c[first] for c in columns]
            share = np.minimum(parts[columns[0]], parts[columns[1]])
            third = words.hashes[columns[2]].view(np.uint64) if depth > 2 else np.zeros(len(first), np.uint64)
            part = np.where(share > 1, (third % share.astype(np.uint64)).astype(np.int64), -1)
            arrays = [pa.array(words.hashes[c], mask=c < 0) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n), pa.array(part)], [*(f"k{i}" for i in range(depth)), "n", "part"])


def _runs(values: np.ndarray, lo: int, hi: int) -> list[int]:
    """Where runs of equal values begin in lo..hi, and hi."""
    return [lo, *(np.flatnonzero(values[lo + 1 : hi] != values[lo : hi - 1]) + lo + 1).tolist(), hi]


def _grow(batches: Iterator[pa.RecordBatch], depth: int, least: int) -> Iterator[pa.RecordBatch]:
    """Frequent patterns of two words and more from sorted pointers; a prefix that is dealt out is told whatever its count."""
    names = [f"k{i}" for i in range(depth)]

    def grown(t: pa.Table) -> pa.RecordBatch:
        keys = [t.column(c).fill_null(0).to_numpy() for c in names]
        there = [t.column(c).is_valid().to_numpy() for c in names]
        n, part = t.column("n").to_numpy(), t.column("part").to_numpy()
        before = np.concatenate([[0], np.cumsum(n)])
        found: list[tuple[int, int, int]] = []  # row, length, count

        def extend(lo: int, hi: int, length: int) -> None:
            """Rows lo..hi share their first ``length`` words."""
            if length == depth:
                return
            cuts = _runs(keys[length], lo, hi)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                total = int(before[b] - before[a])
                if total >= least and there[length][a]:
                    found.append((a, length + 1, total))
                    extend(a, b, length + 1)

        change = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
        lows = np.concatenate([[0], change])
        highs = np.concatenate([change, [len(n)]])
        total = before[highs] - before[lows]
        for i in np.flatnonzero((total >= least) | (part[lows] >= 0)).tolist():
            found.append((int(lows[i]), 2, int(total[i])))
            extend(int(lows[i]), int(highs[i]), 2)
        ids = [int(keys[k][row]) for row, length, _ in found for k in range(length)]
        ends = np.cumsum([0, *(length for _, length, _ in found)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64()))
        return pa.RecordBatch.from_arrays([lists, pa.array([c for _, _, c in found], pa.int64())], ["ids", "a"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        first, last = (tuple(b.column(c)[i].as_py() for c in ("k0", "k1")) for i in (0, b.num_rows - 1))
        if held and first == last == tuple(held[0].column(c)[0].as_py() for c in ("k0", "k1")):
            held.append(b)
            continue
        k0, k1 = b.column("k0").to_numpy(), b.column("k1").to_numpy()
        cut = int(np.flatnonzero((k0 != last[0]) | (k1 != last[1]))[-1]) + 1 if first != last else 0
        whole = [*held, b.slice(0, cut)] if cut else held
        if whole:
            yield grown(pa.Table.from_batches(whole))
        held = [b.slice(cut)]
    if held:
        yield grown(pa.Table.from_batches(held))


def frequent_words(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """Words of at least that count, the number of words by language, and the seed under which their hashes differ."""
    for seed in range(100):
        counts = word_counts(docs, seed)
        kept = stored(counts.where((F.col("n") >= least) | F.col("word").isNull()), "words")
        words = kept.where(F.col("word").isNotNull())
        if not words.groupBy("hash").count().where("count > 1").head(1):
            return words, kept.where(F.col("word").isNull()).select("lang", "n"), seed
    raise ValueError("frequent words of equal hash under every seed")


def grow_phrases(docs: DataFrame, words: DataFrame, n_words: int, seed: int, least: int = MIN_COUNT, depth: int = MAX_WORDS, hot_share: int = HOT_SHARE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(ids array<long>, a): phrases of two to ``depth`` frequent words, as their words' hashes, that occur ``least`` times."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bit_table(words, filter_bits))
    part = max(1, n_words // hot_share)
    hot = {r["hash"]: -(-r["n"] // part) for r in words.where(F.col("n") > part).select("hash", "n").toLocalIterator()}
    shares = spark.sparkContext.broadcast(hot)
    keys = [f"k{i}" for i in range(depth)]
    schema = ", ".join(f"{k} long" for k in keys) + ", n long, part long"
    pointers = _texts(docs).mapInArrow(lambda b: _pointers(b, seed, bits, shares, depth), schema)
    tasks = pointers.repartition("k0", "k1", "part").sortWithinPartitions(*keys)
    found = tasks.mapInArrow(lambda b: _grow(b, depth, least), "ids array<long>, a long")
    return found.groupBy("ids").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def score_of(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits, for counts below 10**16."""
    return F.expr(f"(1000000 * (cast({a} as decimal(16,0)) * cast({a} as decimal(16,0)))) div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))").cast("long")


def collocations(docs: DataFrame, least: int = MIN_COUNT, depth: int = MAX_WORDS, cover_per_cent: int = COVER_PER_CENT, hot_share: int = HOT_SHARE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Scored phrases (lang, phrase, a, l, r, n, score): the cut that binds least counts; covered phrases are left out.

    ``docs`` has text and lang. A phrase is covered if a longer frequent one that holds it has cover_per_cent of its count.
    """
    words, totals, seed = frequent_words(docs, least)
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    phrases = stored(grow_phrases(docs, words, n_words, seed, least, depth, hot_share, filter_bits), "phrases")
    counts = phrases.unionByName(words.select(F.array("hash").alias("ids"), F.col("n").alias("a")))

    length = F.size("ids")
    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", 1, F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, length - F.col("k")).alias("right"))
    cuts = cuts.join(counts.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    best = cuts.withColumn("score", score_of("a", "l", "r")).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # the proper parts of two words and more of each phrase, with the largest count of a phrase that holds them
    spans = F.expr("flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), i -> slice(ids, i, m))))")
    parts = phrases.where(length > 2).select(F.explode(spans).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("held"))
    kept = best.join(parts, "ids", "left").where(F.col("held").isNull() | (100 * F.col("held") < cover_per_cent * F.col("a")))

    spelt = kept.select("ids", "a", "cut", F.posexplode("ids").alias("at", "hash")).join(words.select("hash", "lang", "word"), "hash")
    spelt = spelt.groupBy("ids", "a", "cut").agg(F.min("lang").alias("lang"), F.array_join(F.array_sort(F.collect_list(F.struct("at", "word"))).getField("word"), " ").alias("phrase"))
    return spelt.join(totals, "lang").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def ranked(scored: DataFrame, best: int = BEST) -> DataFrame:
    """The first phrases of each language with their rank."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    w = Window.partitionBy("lang").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best).withColumn("rank", F.col("rank").cast("long"))


def op12_prefix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two to three words of all documents, the first 2000 of each language."""
    out = ranked(collocations(table(spark, sf_dir, "documents").select("text", "lang")))
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Counts every window of every piece.
OP12_SQL = """
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') as w from pieces),
grams as (
  select lang, m, w[i : i + m - 1] as g from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from words, (values (1), (2), (3)) s(m))),
f as materialized (select lang, m, array_to_string(g, ' ') as g, g as ws, count(*) as a from grams group by all),
totals as (select lang, sum(a) as n from f where m = 1 group by lang),
parts as (
  select lang, m, g, ws, a, k, array_to_string(ws[1 : k], ' ') as first, array_to_string(ws[k + 1 : m], ' ') as rest
  from f, (values (1), (2)) s(k) where m >= 2 and a >= 10 and k < m),
cuts as (
  select c.lang, c.g, c.a, k, l.a as l, r.a as r, (1000000::hugeint * c.a * c.a) // (l.a::hugeint * r.a) as score
  from parts c join f l on l.lang = c.lang and l.g = c.first join f r on r.lang = c.lang and r.g = c.rest),
best as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
held as (
  select lang, part, max(a) as a from (
    select lang, ws[1] || ' ' || ws[2] as part, a from f where m = 3 and a >= 10
    union all select lang, ws[2] || ' ' || ws[3], a from f where m = 3 and a >= 10) group by all),
kept as (select b.*, b.g as phrase from best b left join held h on h.lang = b.lang and h.part = b.g where h.a is null or 100 * h.a < 50 * b.a)
select lang, row_number() over w as rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from kept join totals using (lang)
window w as (partition by lang order by score desc, a desc, phrase)
qualify rank <= 2000
"""
