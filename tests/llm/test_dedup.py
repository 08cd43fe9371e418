"""Near-duplicates, substring dedup and components against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lumencat.llm import common, line_dedup, near_dedup

DOC = "doc_id long, text string, lang string, keys string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "x", "y") for k, t in rows], DOC)


def near_rows(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, key = [], 0
    for base in range(12):
        words = [word() for _ in range(r.choice([8, 60, 200]))]
        for _ in range(8):
            own = list(words)
            for _ in range(r.randrange(0, 1 + len(own) // 40)):
                own[r.randrange(len(own))] = word()
            rows.append((key, " ".join(own) if base % 2 else "\n".join(own).upper()))
            key += 1
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "One  TWO"), (905, "two one"), (906, "a b c d e"), (907, "x " * 3000), (908, "x " * 2500), (909, "ünï é x y"), (910, "a b c d e")]
    r.shuffle(rows)
    return rows


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, per_cent=85):
    sets = {k: shingles(t) for k, t in rows}
    label = {k: k for k in sets}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {k: (len(s), top(k)) for k, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 3)
    rows = near_rows(2)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {k: c for k, (_, c) in brute(rows).items()}


def test_near_duplicates_of_nothing_and_repeats(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    out = near_dedup.near_duplicates(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in out] == [(1, 1, True), (2, 1, False)]


def test_both_ends_are_kept_and_estimate_similarity():
    a = near_dedup.shingle_set(" ".join(f"w{i}" for i in range(400)))
    b = near_dedup.shingle_set(" ".join(f"w{i}" for i in range(40, 440)))
    sig = near_dedup.signatures([a, b])
    j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs((sig[0] == sig[1]).mean() - j) < 0.15
    assert (sig[:, : near_dedup.PERMUTATIONS] <= sig[:, near_dedup.PERMUTATIONS :]).all()


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(5, 4), (4, 3), (3, 2), (2, 1)], [(i, i + 1) for i in range(0, 60, 2)] + [(i, i + 2) for i in range(0, 40, 4)], [(7, 7), (8, 9), (9, 8)], [(0, i) for i in range(1, 50)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r["node"]: r["component"] for r in common.components(df).collect()} == label


def brute_cut(rows, min_words):
    """Units in the order of (id, number): a unit is a repeat if its form came before."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[key] = (None, [])
            continue
        found = line_dedup.units(text)
        repeat, own = [], set()
        for _, _, _, form in found:
            repeat.append(form != "" and (form in seen or form in own))
            own.add(form)
        seen |= own
        gone = line_dedup.runs(found, repeat, min_words)
        left, at = "", 0
        for a, b in gone:
            left += text[at:a]
            at = b
        out[key] = (left + text[at:], gone)
    return out


def unit_rows(seed=3):
    r = random.Random(seed)
    pool = [" ".join(r.choice("red blue old new gate rain wind door metal glass".split()) for _ in range(r.randrange(1, 14))).capitalize() + r.choice(".!?") for _ in range(60)]
    rows = [(k, r.choice([" ", "\n", "\n\n"]).join(r.choice(pool) for _ in range(r.randrange(0, 25)))) for k in range(80)]
    return rows + [(200, None), (201, ""), (202, "   \n"), (203, "Same words here and there and everywhere again now yes."), (204, "same  words here and there and everywhere again now yes!"), (205, "x" * 100_000)]


def test_substring_dedup_equals_brute_force(spark):
    rows = unit_rows()
    out = line_dedup.dedup_units(frame(spark, rows)).collect()
    got = {r["doc_id"]: (r["text"], [(s["start"], s["end"]) for s in r["removed"]]) for r in out}
    assert got == brute_cut(rows, line_dedup.MIN_RUN_WORDS)
    text = dict(rows)
    for r in out:
        if r["text"] is not None:
            assert "".join(text[r["doc_id"]][s["start"] : s["end"]] for s in r["kept"]) == r["text"]


def test_a_long_passage_inside_other_text_goes(spark):
    passage = " ".join(f"The number {i} of the passage is here again." for i in range(8))
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_units(frame(spark, [(1, f"Own start of one. {passage} Own end."), (2, f"Another beginning of two. {passage} Some other end. Yes."), (3, "Yes. Own start of one.")])).collect()}
    assert passage in out[1] and "passage" not in out[2] and out[2].endswith("Some other end. Yes.")
    assert out[3] == "Yes. Own start of one."


def test_substring_dedup_carries_columns_and_takes_nothing(spark):
    d = frame(spark, [(1, "a")]).withColumn("unit", F.lit(3)).withColumn("hi", F.lit(4))
    assert line_dedup.dedup_units(d, carry=["unit", "hi"]).first()["hi"] == 4
    assert line_dedup.dedup_units(frame(spark, [])).count() == 0


def test_short_lines_go_whole_and_dense_scripts_count_by_characters(spark):
    planted = "Seven made up words stand in here, the. end there"
    rows = [(1, f"{planted}\nFirst text of its own."), (2, f"Second text of its own.\n{planted}\nAnother end"), (3, f"{planted}\nLicensed under the licence."), (4, "New.\nLicensed under the licence.\nYes.")]
    rows += [(5, "Yes.\n今日はとても良い天気ですね。\n一つ目の文章です"), (6, "二つ目は違う。\n今日はとても良い天気ですね。"), (7, f"Kept since new. {planted}")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_units(frame(spark, rows)).collect()}
    assert out[1] == rows[0][1] and out[2] == "Second text of its own.\n\nAnother end"
    assert out[3] == "\nLicensed under the licence." and out[4] == "New.\n\nYes."
    assert out[5] == rows[4][1] and out[6] == "二つ目は違う。\n"
    assert out[7] == rows[6][1]


def test_repeated_ids_are_cut_by_their_own_text(spark):
    shared = "This sentence of more than ten words stands in many documents of the table."
    rows = [(1, shared), (5, f"Here stands some text that nobody else has. {shared}"), (5, "Another text under the same id begins here. It has a last sentence of its own that must stay."), (5, f"Here stands some text that nobody else has. {shared}"), (None, f"No id at all. {shared}")]
    out = line_dedup.dedup_units(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == sorted([(1, shared), (5, "Here stands some text that nobody else has. "), (5, rows[2][1]), (5, "Here stands some text that nobody else has. "), (0, rows[4][1])])
    both = [(7, f"{shared}\nOne."), (7, f"{shared}\nTwo.")]
    out = [r["text"] for r in line_dedup.dedup_units(frame(spark, both)).collect()]
    assert sum(shared in t for t in out) == 1 and sorted(t.strip()[-4:] for t in out) == ["One.", "Two."]
    mixed = [(k, f"{t} {k % 3}") for k, t in unit_rows(4) if t]
    mixed = [(k % 30, t) for k, t in mixed]
    first: dict[str, tuple] = {}
    row = {t: r for t, r in spark.createDataFrame([(t,) for _, t in mixed], "t string").select("t", F.xxhash64("t")).collect()}
    for k, t in sorted(set(mixed), key=lambda x: (x[0], row[x[1]])):
        for u in line_dedup.units(t):
            first.setdefault(u[3], (k, t))
    got = {(r["doc_id"], r["removed_chars"], r["text"]) for r in line_dedup.dedup_units(frame(spark, mixed)).collect()}
    want = set()
    for k, t in mixed:
        left, _, _, _, gone = line_dedup.cut(t, [i for i, u in enumerate(line_dedup.units(t)) if u[3] and first[u[3]] != (k, t)], line_dedup.MIN_RUN_WORDS)
        want.add((k, gone, left))
    assert got == want


def test_template_family_and_chain(spark):
    """Near copies of one text, texts that share half of a template, and links that only a second look finds."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    base, template = [word() for _ in range(300)], [word() for _ in range(120)]
    rows = []
    for k in range(300):
        own = list(base)
        for _ in range(r.randrange(1, 6)):
            own[r.randrange(len(own))] = word()
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join([*template, *(word() for _ in range(70))])) for k in range(300)]
    for k in range(0, 40, 2):  # linked pairs among those that share the template
        other = dict(rows)[1000 + k].split()
        other[-1] = word()
        rows.append((2000 + k, " ".join(other)))
    chain = [word() for _ in range(600)]
    rows += [(3000 + k, " ".join(chain[60 * k : 60 * k + 180])) for k in range(8)]
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {k: c for k, (_, c) in brute(rows).items()}


def test_large_components_get_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 6)
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(200)]
    rows = []
    for k in range(60):
        own = list(base)
        for _ in range(r.randrange(1, 9)):
            own[r.randrange(len(own))] = word()
        rows.append((k, " ".join(own)))
    sets = {k: near_dedup.shingle_set(t) for k, t in rows}
    # halves that are taken as joined already, and some sets on their own
    part = {k: 0 if k < 25 else 1 if k < 50 else k for k in sets}
    d = spark.createDataFrame([(k, part[k], bytearray(s.tobytes())) for k, s in sets.items()], "node long, part long, shingles binary")
    links = [tuple(x) for x in near_dedup.linked_through_shingles(d, 85).collect()]
    label = dict(part)
    for _ in rows:
        for a, b in links:
            low = min(label[a], label[b])
            for k in [k for k in label if label[k] in (label[a], label[b])]:
                label[k] = low
    want = dict(part)
    for a in sets:
        for b in sets:
            common = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if want[a] != want[b] and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                low = min(want[a], want[b])
                for k in [k for k in want if want[k] in (want[a], want[b])]:
                    want[k] = low
    assert label == want


def test_ids_with_several_texts_are_linked_by_any(spark):
    a, b = ("one two three four five six seven", "other words stand here in this text now")
    out = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(frame(spark, [(1, a), (2, a), (2, b), (3, b), (3, b), (4, None)])).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4}
