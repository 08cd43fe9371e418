"""Operators 11 to 13 against brute force, on tables with nulls, ties, repeats, empty and long texts and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumencat.llm import collocations, outliers, spelling
from lumencat.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sample_texts():
    """Texts of a few words each, some odd ones among them."""
    r = random.Random(7)
    stems = ["harbour", "harbours", "harbor", "lantern", "lanterns", "lentern", "über", "größer", "größen", "ÀLTERE", "a", "bb", "co-op", "meadow", "meadew", "Meadow"]
    rows = []
    for i in range(300):
        words = [r.choice(stems) for _ in range(r.randrange(0, 60))]
        text = "".join(w + r.choice([" ", "  ", "\t", " ", ". ", ", ", "\n", "!\r\n", "\x0b"]) for w in words)
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["s1", "s2", None]), len(text)))
    line = "the same old line of seven words"
    rows += [(300, None, "en", "s1", 0), (301, "", "en", "s1", 0), (302, "\n".join([line] * 5), "en", "s1", 0), (303, " \t\r\n\x0c", None, None, 0)]
    rows += [rows[5], rows[5], (None, rows[9][1], "en", None, 0), (304, ("harbour lantern " * 20_000).strip(), "en", "s2", 0), (305, "x" * 30_000, "en", "s2", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample_texts(), DOCS).withColumn("hash", F.lit("h"))


# ---- operator 11


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {k for places in at.values() if len(places) > 1 for i in places for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_equal_brute_force(docs):
    rows = outliers.statistics(docs, "doc_id", "text").collect()
    assert len(rows) == len(sample_texts())
    for r in rows:
        assert tuple(r[c] for c in NUMBERS) == brute_statistics(r["text"]), r["doc_id"]


def test_the_rules_on_the_tables(spark):
    rows = QUERIES["op11_robust_outliers"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        n, _, _, _, repeated = want = brute_statistics(texts[r["doc_id"]])
        assert tuple(r[c] for c in NUMBERS) == want
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
        assert not (r["kept"] and r["base_failed"])


def test_no_python_runs_in_tasks(spark):
    plan = outliers.statistics(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def made_statistics(n=400, odd=120, seed=3):
    """Rows of one source of which a large minority is far away, and a small one beside it."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = r.randrange(80, 400)
        rows.append((i, "en", "hot", words, int(words * r.gauss(5, 0.15)), r.choice([0, 0, 0, 1, 2]), 0, r.choice([0, 0, 6])))
    for i in range(n, n + odd):
        words = r.randrange(80, 400)
        rows.append((i, "en", "hot", words, int(words * r.gauss(7.5, 0.2)), words * 2, 0, 0))
    rows += [(10_000 + i, "en", "small", 100, 500, 0, 0, 0) for i in range(3)]
    rows += [(20_000, None, None, 100, 500, 0, 0, 0), (20_001, "en", "hot", 5, 20, 0, 0, 0)]
    return rows


STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def test_a_large_minority_does_not_hide_itself(spark):
    rows = outliers.judged(spark.createDataFrame(made_statistics(), STATS), "doc_id").collect()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert all(kept[i] for i in range(400)) and not any(kept[i] for i in range(400, 520))
    assert all(kept[10_000 + i] for i in range(3)) and kept[20_000] and not kept[20_001]
    assert {r["doc_id"]: r["distance"] is None for r in rows}[20_000]


def test_verdicts_do_not_depend_on_order_or_repeats_of_partitions(spark):
    rows = made_statistics(seed=5)
    a = outliers.judged(spark.createDataFrame(rows, STATS), "doc_id").collect()
    random.Random(1).shuffle(rows)
    b = outliers.judged(spark.createDataFrame(rows, STATS).repartition(7), "doc_id").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_scatter_of_a_normal_sample(spark):
    """Without odd rows the estimate is the plain covariance but for sampling, whichever way the axes are turned."""
    import numpy as np

    g = np.random.default_rng(4)
    mix = g.normal(size=(4, 4)) * 3000
    x = g.normal(size=(6000, 4)) @ mix.T
    rows = spark.createDataFrame([("g", *map(int, v)) for v in x.round()], "g string, y0 long, y1 long, y2 long, y3 long")
    e = outliers.minimum_determinant(rows).first().asDict()
    k = np.array([[e[f"k{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    d2 = ((x - [e[f"u{i}"] for i in range(4)]) @ k.T) ** 2
    assert abs((d2.sum(axis=1) <= 3.357).mean() - 0.5) < 0.05  # the median of chi squared with four degrees of freedom
    assert abs((d2.sum(axis=1) <= 9.488).mean() - 0.95) < 0.015


# ---- operator 12


def brute_collocations(rows, least, best=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in (1, 2, 3):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in found.items()):
                continue
            score, _, x, y = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), x, y))
        for rank, (score, a, p, x, y) in enumerate(sorted(scored)[:best], 1):
            out.add((lang, rank, p.decode(), -a, x, y, n[lang], -score))
    return out


def collected(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_collocations_equal_brute_force(docs):
    got = collected(collocations.ranked(collocations.collocations(docs, least=4)))
    assert got == brute_collocations(sample_texts(), 4)
    assert len(got) > 100 and {x[0] for x in got} == {"en", "de", "und"}


def test_prefixes_dealt_out_by_the_third_word_count_the_same(docs):
    """Nearly every word is hot, and the bit table prunes next to nothing."""
    got = collected(collocations.ranked(collocations.collocations(docs, least=4, hot_share=20, filter_bits=7), best=50))
    assert got == brute_collocations(sample_texts(), 4, best=50)


def test_longer_phrases(spark):
    text = "one two three four five. " * 3 + "two three four. one two"
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    got = {r["phrase"]: r["a"] for r in collocations.collocations(docs, least=2, depth=5).collect()}
    assert got == {"one two three four five": 3}
    got = {r["phrase"]: r["a"] for r in collocations.collocations(docs, least=2, depth=5, cover_per_cent=76).collect()}
    assert got == {"one two three four five": 3, "one two": 4, "two three four": 4}


def test_pointers_of_a_prefix_over_several_batches():
    import pyarrow as pa

    n = 50
    rows = pa.table({"k0": [1] * n + [2], "k1": [1] * n + [2], "k2": [*range(n), None], "n": [1] * n + [3], "part": [-1] * (n + 1)})
    grown = pa.Table.from_batches(collocations._grow(iter(rows.to_batches(max_chunksize=4)), 3, 3)).to_pylist()
    assert grown == [{"ids": [1, 1], "a": n}, {"ids": [2, 2], "a": 3}]


def test_score_beyond_64_bits(spark):
    """Products of counts that pass 64 bits stay exact."""
    a, left, right = 3_000_000_019, 5_000_000_029, 7_000_000_001
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations.score_of("a", "l", "r").alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (left * right)


# ---- operator 13


def brute_variants(rows, least=5):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least}
    near = {w: [u for u in n if u != w and one_edit(w, u)] for w in n}
    best = {w: min(us, key=lambda u: (-n[u], u)) for w, us in near.items() if us}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def got_variants(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_equal_brute_force(spark, docs):
    words = spelling.word_counts(docs)
    assert got_variants(spelling.variants(words)) == brute_variants(sample_texts())


def test_registered_variants_on_the_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = got_variants(QUERIES["op13_spelling_variants"](spark, SF))
    assert got == brute_variants(rows)


def test_chains_ties_anagrams_and_long_words(spark):
    long = "abcdefghij" * 400
    words = {
        "colour": 1000, "color": 200, "colr": 40, "colrs": 8, "clor": 40,  # a chain, and a tie of two variants
        "listen": 50, "silent": 300, "enlist": 10,  # anagrams are not near
        "aaaaaa": 7, "aaaaaaa": 36, "aaaaab": 7, "aaaaba": 7,  # one removal at any of seven places; two exchanges apart
        long: 100, long[:1999] + long[2000:]: 10, long[:77] + "z" + long[78:]: 10, "àéîõüx": 5, "àéîõüÿ": 25,
    }
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling.variants(rows).collect()}
    want = {}
    near = {w: [u for u in words if u != w and one_edit(w, u)] for w in words}
    for w, us in near.items():
        b = min(us, key=lambda u: (-words[u], u)) if us else None
        want[w] = (b if b and words[b] >= 5 * words[w] else None, len(us))
    assert {w: (f, k) for w, (f, _, k) in got.items()} == want
    assert got["colrs"] == ("colr", "colour", 1) and got["silent"][2] == 0
    assert got[long[:1999] + long[2000:]][0] == long


def test_places_of_a_word():
    assert [p for p, *_ in spelling.fingerprints("banana", "a")] == [1, 3, 5]
    at = {p: h for p, *h in spelling.fingerprints("banana", "n")}
    assert at[2] == list(spelling.fingerprints("baana", None)[0][1:])
    assert spelling.key("listen") == spelling.key("silent")


@pytest.mark.parametrize("name", ["op11_robust_outliers", "op12_prefix_collocations", "op13_spelling_variants"])
def test_empty_tables_and_odd_columns(spark, tmp_path, name):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    assert QUERIES[name](spark, folder).count() == 0
    odd = str(tmp_path / "odd")
    rows = [(1, None, None, None, 0, 7, "w", 1), (1, "few words here", "en", "s", 3, 7, "w", 1), (None, "x", None, "s", 3, 7, "w", 1)]
    spark.createDataFrame(rows, DOCS + ", n long, word string, hash long").write.parquet(f"{odd}/documents.parquet")
    out = QUERIES[name](spark, odd).collect()
    assert len(out) == (3 if name.startswith("op11") else 0)

