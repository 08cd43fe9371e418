"""Operator 9: language identification by cross-parsing against suffix automata.

For each language a suffix automaton is built from labelled text. A text is parsed against it from left to right: each
phrase is the longest string at that place which occurs in the language's sample, and a character that never occurs is a
phrase of its own. Phrases times the logarithm of the sample's size, per character, estimate the cross entropy; the
language that needs fewest wins.

The automata are fitted on a bounded sample. The labelled texts are cut into passages of PASSAGE_CHARS characters, all of
which can be drawn; of each language those first by a hash of id and place are taken, at most SAMPLE_PASSAGES of them and
SAMPLE_TOTAL over all languages together (one a language at least). Passages that several rows or languages share are left
out, so that text copied into a sample does not decide. The automata are broadcast: a dense table for the most frequent
letters, of TABLE_ENTRIES at most (64 MB), and for every other letter of a sample its transitions in a sorted array of 12
bytes a character of sample (15 MB at SAMPLE_TOTAL).

Every text is parsed as a whole. Segments of SEGMENT characters advance in step, each begun as if a phrase opened there.
Then the phrase that is open at a segment's end is carried on into the next one, until it ends a phrase where that one's own
parse does: from there on both agree. So the counts are those of one parse from the text's start. Only text takes part in a
prediction.

Defined cases: null text, empty text and text without a letter give ``und`` and score 0, as does everything when there
is no labelled row; ties go to the language that sorts first; extra columns are not read; repeated rows repeat their
result; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from lumencat.llm.common import pieces, table

PASSAGE_CHARS = 400
SAMPLE_PASSAGES = 64
SAMPLE_TOTAL = 4096
TABLE_ENTRIES = 16 << 20
SYMBOLS = 63
SEGMENT = 2048
BATCH_BYTES = 3 << 20
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """Of each code point its lower-case form if it is a letter, else 0 (code points past the last letter planes: 0)."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for cp in range(0x32400):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


_table: np.ndarray | None = None


def letters() -> np.ndarray:
    global _table
    if _table is None:
        _table = _letters()
    return _table


def folded(joined: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters and single 0 for what is between them: symbols, each text's number of symbols and of letters."""
    cps = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    keep = np.ones(len(cps), bool)
    keep[1:] = (cps[1:] != 0) | (cps[:-1] != 0) | (doc[1:] != doc[:-1])
    return cps[keep], np.bincount(doc[keep], minlength=len(lengths)), np.bincount(doc[cps != 0], minlength=len(lengths))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class CrossParser:
    """Step tables of all languages. An entry holds four times the next row's start plus the phrases that the step closes.

    Letters have a class each: 0 between letters, then the frequent ones, width - 1 for letters of no sample, and from width
    on the other letters, whose steps are looked up by (row's start, class) in ``keys``.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        folds = {k: folded(v, np.array([len(v)]))[0] for k, v in samples.items()}
        every = np.concatenate([*folds.values(), np.zeros(1, np.uint32)])
        seen, count = np.unique(every[every != 0], return_counts=True)
        # an automaton has under twice as many states as its sample characters
        dense = min(SYMBOLS, max(2, TABLE_ENTRIES // (2 * len(every)) - 1))
        top = seen[np.lexsort((seen, -count))][: dense - 1]
        self.symbols = seen
        self.width = len(top) + 2
        rare = ~np.isin(seen, top)
        self.numbers = np.empty(len(seen), np.int32)
        self.numbers[~rare] = np.arange(1, len(top) + 1)
        self.numbers[rare] = np.arange(self.width, self.width + rare.sum())
        self.n_classes = self.width + int(rare.sum())
        keys, nexts = [], []
        tables, roots, self.log = [], [], []
        base = 0
        for k in self.languages:
            cls = self.classes(folds[k])
            nxt = suffix_automaton([c for c in cls.tolist()])
            t = np.empty((len(nxt), self.width), np.int64)
            root = np.array([nxt[0].get(c, -1) for c in range(self.width)])
            root[self.width - 1] = -1
            known = root >= 0
            restart = np.where(known, root, 0)
            for s, edges in enumerate(nxt):
                row = (restart * self.width + base) * 4 + (~known).astype(np.int64) + (s != 0)
                for c, to in edges.items():
                    if c < self.width:
                        row[c] = (to * self.width + base) * 4
                    else:
                        keys.append((s * self.width + base) * self.n_classes + c)
                        nexts.append((to * self.width + base) * 4)
                t[s] = row
            tables.append(t.reshape(-1))
            roots.append(base)
            base += t.size
            self.log.append(math.log(max(2, len(cls))))
        if base * 4 >= 1 << 31:
            raise ValueError("too much sample text for the step table")  # far above what training_samples draws
        by_key = np.argsort(np.array(keys, np.int64))
        self.keys, self.nexts = np.array(keys, np.int64)[by_key], np.array(nexts, np.int32)[by_key]
        self.steps = np.concatenate(tables).astype(np.int32) if tables else np.empty(0, np.int32)
        self.roots = np.array(roots, np.int32)

    def classes(self, folds: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.symbols, folds)
        at[at == len(self.symbols)] = 0
        known = self.symbols[at] == folds if len(self.symbols) else np.zeros(len(folds), bool)
        return np.where(folds == 0, 0, np.where(known, self.numbers[at] if len(self.symbols) else 0, self.width - 1)).astype(np.int32)

    def _looked_up(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The transition from each state by its letter, -1 where there is none."""
        key = state.astype(np.int64) * self.n_classes + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nexts[at], -1)

    def _step(self, state: np.ndarray, roots: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Entries of the step tables for states, the roots of their languages and the letters' classes, all of one shape."""
        if not len(self.keys):
            return self.steps[state + c]
        e = self.steps[state + np.minimum(c, self.width - 1)]
        rare = np.nonzero(c >= self.width)
        if len(rare[0]):
            # as the dense table has it: go on, or close the phrase and begin anew
            held, root, cls = state[rare], roots[rare], c[rare]
            to, anew = self._looked_up(held, cls), self._looked_up(root, cls)
            e[rare] = np.where(to >= 0, to, np.where(anew >= 0, anew + (held != root), e[rare]))
        return e

    def phrases(self, cls: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each text (row) in each language (column)."""
        n_docs, n_lang = len(lengths), len(self.languages)
        out = np.zeros((n_docs, n_lang), np.int64)
        per = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(n_docs), per)
        if not len(doc):
            return out
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        size = np.minimum(SEGMENT, lengths[doc] - nth * SEGMENT)
        start = np.repeat(np.cumsum(lengths) - lengths, per) + nth * SEGMENT
        order = np.argsort(-size, kind="stable")  # the longest segments first
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc))
        after = np.full(len(doc), -1)  # of each segment the one that follows it
        same = np.flatnonzero(doc[1:] == doc[:-1])
        after[rank[same]] = rank[same + 1]
        doc, start, size = doc[order], start[order], size[order]
        roots = np.repeat(self.roots[:, None], len(doc), axis=1)
        state, count = roots.copy(), np.zeros((n_lang, len(doc)), np.int64)
        closes = []  # of each step: how many phrases each parse closes before its letter, or with it if no sample has it
        live = np.searchsorted(-size, -np.arange(size[0]), side="left")
        for k, m in enumerate(live):
            c = np.broadcast_to(cls[start[:m] + k], (n_lang, m))
            e = self._step(state[:, :m], roots[:, :m], c)
            state[:, :m] = e >> 2
            e &= 3
            closes.append(e.astype(np.int8))
            count[:, :m] += e
        self._carry_on(cls, closes, count, state, start, size, after)
        count += (state != roots) & (after < 0)
        for i in range(n_lang):
            out[:, i] = np.bincount(doc, weights=count[i], minlength=n_docs)
        return out

    def _carry_on(self, cls: np.ndarray, closes: list[np.ndarray], count: np.ndarray, ends: np.ndarray, start: np.ndarray, size: np.ndarray, after: np.ndarray) -> None:
        """Puts closes, count and ends right where a segment does not open with a phrase of the whole parse.

        Segments are mended side by side, each until a phrase opens at the same letter in both parses. If that never
        happens the segment's end may have changed, and then the one after it is mended again, until none is left.
        """
        before = np.flatnonzero(after >= 0)
        lang, prev = (x.reshape(-1) for x in np.meshgrid(np.arange(len(self.languages)), before, indexing="ij"))
        own_opens = np.ones(ends.shape, bool)  # the segment's parse opens a phrase at its first letter
        while len(prev):
            seg = after[prev]
            state, root = ends[lang, prev], self.roots[lang]
            opens = state == root
            live = np.flatnonzero(~opens | ~own_opens[lang, seg])
            state, k = state[live], 0
            changed = []
            while len(live):
                lv, sg, rt = lang[live], seg[live], root[live]
                e = self._step(state, rt, cls[start[sg] + k])
                state, now = e >> 2, (e & 3).astype(np.int8)
                own = closes[k][lv, sg]
                closes[k][lv, sg] = now
                count[lv, sg] += now.astype(np.int64) - own
                if k == 0:
                    both = (opens[live] | (now > 0)) & (own_opens[lv, sg] | (own > 0))
                    own_opens[lv, sg] = opens[live]
                else:
                    both = (now > 0) & (own > 0)
                k += 1
                going = ~(both | (state == rt))  # a letter of no sample ends any phrase
                over = going & (k >= size[sg])
                if over.any():
                    x, y = lv[over], sg[over]
                    new = ends[x, y] != state[over]
                    ends[x, y] = state[over]
                    changed.append(live[over][new])
                going &= ~over
                live, state = live[going], state[going]
            moved = np.concatenate([np.empty(0, np.int64), *changed])
            lang, prev = lang[moved], seg[moved]
            lang, prev = lang[after[prev] >= 0], prev[after[prev] >= 0]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and phrases a character of each text."""
        none = np.zeros(len(texts))
        if not texts or not self.languages:
            return [UNDETERMINED] * len(texts), none, none
        folds, lengths, n_letters = folded("".join(texts), np.array([len(t) for t in texts]))
        n = np.maximum(lengths, 1)[:, None]
        rate = self.phrases(self.classes(folds), lengths) / n
        cost = rate * np.array(self.log)
        best = np.argmin(cost, axis=1)
        rows = np.arange(len(texts))
        low = cost[rows, best]
        rest = cost.copy()
        rest[rows, best] = np.inf
        second = rest.min(axis=1) if len(self.languages) > 1 else np.full(len(texts), self.log[0])
        ok = n_letters > 0
        score = np.where(ok & (second > 0), 1 - low / np.maximum(second, 1e-300), 0.0).clip(0, 1)
        return [self.languages[b] if o else UNDETERMINED for b, o in zip(best, ok, strict=True)], score, np.where(ok, rate[rows, best], 0.0)


def is_held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def training_samples(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, str]:
    """The bounded sample: collected, for it has SAMPLE_PASSAGES passages of PASSAGE_CHARS characters a language at most."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).alias("l")).where(~is_held_out("k") & F.col("l").isNotNull())
    most = max(1, min(SAMPLE_PASSAGES, SAMPLE_TOTAL // max(1, rows.select("l").distinct().count())))
    cut = rows.select("k", "l", F.posexplode(F.regexp_extract_all("t", F.lit(rf"(?s).{{1,{PASSAGE_CHARS}}}"), F.lit(0))).alias("no", "t")).where(F.col("t").rlike(r"\p{L}"))
    # longer passages first: a text's last one may be a few characters
    short = F.length("t") < PASSAGE_CHARS // 4
    order = Window.partitionBy("l").orderBy(short, F.xxhash64("k", "no"), "k", "no", F.xxhash64("t"))
    parts: dict[str, list[str]] = {}
    for r in cut.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).orderBy("l", "n").collect():
        parts.setdefault(r["l"], []).append(r["t"])
    # a line or passage of several rows or languages is boilerplate, which says nothing of either
    count = Counter(line for v in parts.values() for t in v for line in dict.fromkeys(t.split("\n")))
    own = {k: ["\n".join(line for line in t.split("\n") if count[line] == 1) for t in v] for k, v in parts.items()}
    return {k: "\n".join(v) if any(map(str.strip, v)) else "\n".join(parts[k]) for k, v in own.items()}


#: Phrases a character above which a text looks like none of the languages; running text of small alphabets stays below 0.4.
REJECT_RATE = 0.55
#: A language whose own text needs more may need so many times what the last quarter of its sample needs against the rest.
OWN_RATE = 1.25
#: But no more than this; a text that matches nothing needs 1.
MOST_RATE = 0.95


def reject_rates(samples: dict[str, str]) -> dict[str, float]:
    """Of each language the phrases a character above which a text is none of it: REJECT_RATE, or more for large alphabets."""
    out = {}
    for k, v in samples.items():
        at = len(v) * 3 // 4
        rate = CrossParser({k: v[:at]}).predict([v[at:]])[2][0]
        out[k] = max(REJECT_RATE, min(MOST_RATE, OWN_RATE * float(rate)))
    return out


def identify(docs: DataFrame, samples: dict[str, str], key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Returns (doc_id, held_out, lang_pred, score, phrase_rate), a row for each row of docs.

    With carry, the named columns of docs come back instead of the id, beside (held_out, lang_pred, score, phrase_rate).
    """
    shared = docs.sparkSession.sparkContext.broadcast(CrossParser(samples))
    own = {f"_carried_{k}": c for k, c in enumerate(carry or [key])}
    read = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), is_held_out(key).alias("held_out"), *(F.col(c).alias(k) for k, c in own.items()))
    back = [f for f in read.schema.fields if f.name in own]
    schema = StructType([*back, StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("phrase_rate", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for b in pieces(iter([whole]), BATCH_BYTES, "text"):
                lang, score, rate = model.predict(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], [*own, "held_out", "lang_pred", "score", "phrase_rate"])

    found = read.mapInArrow(run, schema)
    names = list(carry) or ["doc_id"]
    return found.select(*(F.col(k).alias(n) for k, n in zip(own, names, strict=True)), "held_out", "lang_pred", "score", "phrase_rate")


def op9_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, training_samples(docs))
