"""Operators on small tables with known answers."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from lumencat.functions import text as T
from lumencat.functions.interpret import StructuredQuery, TextQuery
from lumencat.operators import dedup, evaluation, jobs, merge, moves, numbering, paging, postings, provenance, scalars, search, tags, timeseries, vectors
from lumencat.sources import files, folders

SOUND = "id string, source_id string, status string, online boolean, favorite boolean, duration double, channels int, channel_layout string, title string, comment string, user_tags array<string>, profile_tags array<string>, description string"


def sounds(spark, *rows):
    base = {"source_id": "s", "status": "ready", "online": True, "favorite": False, "duration": 2.0, "channels": 2, "channel_layout": "", "comment": "", "user_tags": [], "profile_tags": [], "description": ""}
    names = [c.split()[0] for c in SOUND.split(", ")]
    return spark.createDataFrame([tuple((base | {"id": str(i)} | r)[n] for n in names) for i, r in enumerate(rows)], SOUND)


def found(spark, df, **q):
    m, parsed = search.ranked_matches(df, TextQuery(**q))
    return [r["title"] for r in search.page(m, search.rank_order()).collect()], parsed


def test_exact_title_ranks_first(spark):
    df = sounds(spark, {"title": "Metal door slam long"}, {"title": "Door"}, {"title": "Cellar", "comment": "a door"})
    assert found(spark, df, text="door")[0] == ["Door", "Metal door slam long", "Cellar"]


def test_typos_are_corrected_but_words_are_kept(spark):
    df = sounds(spark, {"title": "Vinyl scratch"}, {"title": "Train passing"}, {"title": "Rain on roof"})
    titles, parsed = found(spark, df, text="vinly")
    assert titles == ["Vinyl scratch"] and parsed.corrected == ["vinly -> vinyl"]
    assert found(spark, df, text="rain")[0] == ["Rain on roof"]


def test_accents_and_cjk(spark):
    df = sounds(spark, {"title": "Café ambience"}, {"title": "雨の音"})
    assert found(spark, df, text="cafe")[0] == ["Café ambience"]
    assert found(spark, df, text="雨")[0] == ["雨の音"]


def test_strict_bounds_scope_and_nulls(spark):
    df = sounds(spark, {"title": "rain a", "duration": 3.0}, {"title": "rain b", "duration": 2.9}, {"title": "rain c", "online": False}, {"title": "rain d", "status": "failed"}, {"title": None, "comment": "rain", "user_tags": None, "profile_tags": None, "description": None})
    titles = found(spark, df, text="rain under 3 seconds")[0]
    assert set(titles) == {"rain b", ""}


def test_exclusion_hits_substrings(spark):
    df = sounds(spark, {"title": "rain category"}, {"title": "rain"})
    assert found(spark, df, text="rain -cat")[0] == ["rain"]


def test_facets_count_each_sound_once(spark):
    df = sounds(spark, {"title": "rain", "user_tags": ["Wet_Floor"], "profile_tags": ["wet floor"]}, {"title": "rain", "channels": 6})
    rows = {(r["dim"], r["value"]): r["n"] for r in search.text_facets(search.ranked_matches(df, TextQuery(text="rain"))[0]).collect()}
    assert rows[("tag", "wet floor")] == 1 and rows[("layout", "6 ch")] == 1 and rows[("duration", "under 3s")] == 2


def test_empty_table(spark):
    assert found(spark, sounds(spark), text="anything")[0] == []


def docs(spark):
    rows = [("1", "s", ["red"], ["a", "red", "car"], ["x"], ["old", "gate"], None, 10), ("2", "s", [], ["gate", "old"], ["red"], [], 5, 20), ("3", "t", [], ["old", "gateway"], [], [], 3, 30)]
    d = spark.createDataFrame(rows, "id string, source_id string, tags_tokens array<string>, caption_tokens array<string>, name_tokens array<string>, notes_tokens array<string>, rating int, width int")
    d = d.withColumns({"kind": F.lit("image"), "admitted": F.lit(True), "online": F.lit(True), "availability": F.lit("available"), "path": F.col("id"), "height": F.lit(1), "added_at": F.lit(0)})
    return d, spark.createDataFrame([("1", "red", "confirmed"), ("3", "red", "suggested")], "id string, key string, state string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_structured_terms_phrases_prefixes(spark):
    d, t = docs(spark)
    assert ids(search.structured_matches(d, t, StructuredQuery(text='"old gate"'))) == ["1"]
    assert ids(search.structured_matches(d, t, StructuredQuery(text="gate"))) == ["1", "2"]
    assert ids(search.structured_matches(d, t, StructuredQuery(text="gate*"))) == ["1", "2", "3"]
    assert ids(search.structured_matches(d, t, StructuredQuery(text="old -gateway"))) == ["1", "2"]


def test_unknown_never_satisfies_a_bound(spark):
    d, t = docs(spark)
    assert ids(search.structured_matches(d, t, StructuredQuery(min_rating=1))) == ["2", "3"]
    assert ids(search.structured_matches(d, t, StructuredQuery(rated=False))) == ["1"]


def test_tiers_and_scope(spark):
    d, t = docs(spark)
    m = search.structured_matches(d, t, StructuredQuery(text="red"))
    assert {r["id"]: r["tier"] for r in m.collect()} == {"1": 0, "2": 3}
    assert ids(search.structured_matches(d, t, StructuredQuery(), allowed=[])) == []
    assert ids(search.structured_matches(d, t, StructuredQuery(source_ids=["t", "u"]), allowed=["s", "t"])) == ["3"]
    assert ids(search.structured_matches(d, t, StructuredQuery(tags=["Red"], tag_state="any"))) == ["1", "3"]


def test_windows_stitch_without_gaps(spark):
    df = spark.range(57).select(F.col("id"), (F.col("id") % 7).alias("k"))
    order = [F.col("k"), F.col("id")]
    whole = [r["id"] for r in df.orderBy(*order).collect()]
    got = [r["id"] for o in range(0, 57, 10) for r in paging.numbered(df, order, o, 10).orderBy("ord").collect()]
    assert got == whole


def test_collapsed_paths(spark):
    df = spark.createDataFrame([("a",), ("a/b",), ("a/b/c.wav",), ("ab",), (None,), ("d/e",)], "path string")
    assert sorted(r["path"] for r in paging.collapsed(df).collect()) == ["a", "ab", "d/e"]


def test_merge_outcomes_and_upsert(spark):
    now = spark.createDataFrame([(1, 5, "a"), (2, 7, "b")], "id int, revision int, v string")
    edits = spark.createDataFrame([(1, 5, "x"), (1, 5, "a"), (2, 6, "y"), (9, 0, "z")], "id int, expected_revision int, new string")
    got = {(r["id"], r["new"]): r["outcome"] for r in merge.outcomes(now, edits, "id", "revision", changed=F.col("new") != F.col("v")).collect()}
    assert got == {(1, "x"): "applied", (1, "a"): "unchanged", (2, "y"): "conflict", (9, "z"): "missing"}
    inc = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert {(r["id"], r["v"]) for r in merge.upsert(now, inc, ["id"], ["v"]).collect()} == {(1, "a"), (2, None), (3, "c")}


def test_incomplete_scan_marks_nothing(spark):
    rows = spark.createDataFrame([("a", "ready")], "path string, status string")
    assert merge.mark_missing(rows, rows.limit(0), ["path"], "status", complete=False).first()["status"] == "ready"
    assert merge.mark_missing(rows, rows.limit(0), ["path"], "status").first()["status"] == "missing"


def test_idempotent_requests(spark):
    r = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b")], "key string, at int, args string")
    assert [x["outcome"] for x in merge.idempotent(r, ["key"], "args", "at").orderBy("at").collect()] == ["created", "replayed", "conflict"]


def test_rename_merges_and_aliases_do_not_chain(spark):
    df = spark.createDataFrame([(["Red", "blue", "crimson"],)], "t array<string>")
    assert df.select(tags.renamed(F.col("t"), "red", "crimson").alias("t")).first()["t"] == ["crimson", "blue"]
    a = spark.createDataFrame([("scarlet", "red")], "alias_key string, canonical string")
    assert {tuple(r) for r in tags.with_alias(a, "red", "crimson").collect()} == {("scarlet", "crimson"), ("red", "crimson")}


def test_pyramid_root_mean_square_is_unweighted(spark):
    df = spark.range(18).select(F.lit("p").alias("path"), F.col("id").alias("frame"), F.when(F.col("id") >= 16, 3.0).otherwise(1.0).alias("value"))
    rows = {(r["level"], r["bucket"]): r for r in timeseries.pyramid(df, ["path"], 4, 2).collect()}
    assert len([k for k in rows if k[0] == 0]) == 5
    assert rows[(1, 1)]["rms"] == 3.0 and rows[(1, 0)]["high"] == 1.0


def test_impulse_bucket(spark):
    df = spark.range(5000).select(F.lit("p").alias("path"), F.col("id").alias("frame"), F.when(F.col("id") == 2500, 1.0).otherwise(0.0).alias("value"))
    assert [r["bucket"] for r in timeseries.buckets(df, ["path"], 256).where("high > 0").collect()] == [9]
    assert timeseries.level_for(1_000_000, 1000) == 0 and timeseries.level_for(10_000_000, 1000) == 2


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],)], "v array<double>")
    got = [r["n"] for r in df.select(vectors.normalised(F.col("v")).alias("n")).collect()]
    assert got[0] == [0.6, 0.8] and got[1] is None and got[2] is None


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(20)], "g string, v double")
    r = evaluation.ranked_percentiles(df, "v", ["g"], [50, 95]).first()
    assert (r["p50"], r["p95"]) == (10.0, 19.0)


def test_retrieval_summary(spark):
    rows = [("q", True, 2, 1, 2, True), ("none", True, 4, None, None, False), ("empty", True, 0, None, None, True), ("unknown", True, None, None, None, None), ("o", False, None, None, None, True), ("p", False, 3, 1, 1, None)]
    q = spark.createDataFrame(rows, "query string, in_domain boolean, size int, found int, first int, returned boolean")
    assert tuple(evaluation.retrieval_summary(q).first()) == (2, 0.25, 0.25, 2, 1)
    assert tuple(evaluation.retrieval_summary(q.limit(0)).first()) == (0, 0.0, 0.0, 0, 0)


def test_scalars(spark):
    df = spark.createDataFrame([(48, 18, 441)], "a long, b long, n long")
    r = df.select(scalars.gcd(F.col("a"), F.col("b")).alias("g"), scalars.rescaled(F.col("n"), 44100, 48000).alias("f"), scalars.gcd(F.col("a"), F.lit(0)).alias("z")).first()
    assert (r["g"], r["f"], r["z"]) == (6, 480, 48)
    assert math.isclose(1.0, 1.0)


def test_evenly_spaced_counts_across_partitions(spark):
    got = scalars.evenly_spaced(spark.range(0, 1000, 1, 7), "id", 100).collect()
    assert sorted(r["id"] for r in got) == list(range(0, 1000, 10)) and got[0]["total"] == 1000


def test_decisions_follow_each_other(spark):
    members = spark.createDataFrame([(d, f"{d}{k}") for d in "xyz" for k in range(3)] + [("one", "one0")], "digest string, asset string")
    groups = spark.createDataFrame([("x", "x1", False, 2), ("y", "gone", True, 1)], "digest string, preferred string, dismissed boolean, revision long")
    marks = spark.createDataFrame([("y", "y0", "reviewed"), ("y", "y2", "separated"), ("y", "left", "reviewed")], "digest string, asset string, mark string")
    log = [
        ("x", 1, 2, "prefer", "x0"), ("x", 2, 2, "dismiss", None), ("x", 3, 3, "separate", "x0"), ("x", 4, 4, "prefer", "x0"), ("x", 4, 4, "dismiss", None), ("x", 6, 5, "rejoin", "x0"),
        ("y", 1, 1, "rejoin", "y2"), ("y", 1, 1, "rejoin", "y2"), ("y", 2, 2, "rejoin", "y1"), ("y", 3, 2, "prefer", "x0"),
        ("z", 1, 0, "dismiss", None), ("z", 2, 1, "restore", None), ("z", 3, 2, "separate", "z1"), ("one", 1, 0, "prefer", "one0"), ("none", 1, 0, "clear", None), (None, 1, 0, "clear", None),
    ]
    done = dedup.decide(groups, marks, spark.createDataFrame(log, "digest string, at int, expected int, action string, asset string"), members)
    got = sorted(((r["digest"], r["at"], r["action"], r["outcome"]) for r in done.outcomes.collect()), key=str)
    want = [
        ("x", 1, "prefer", "applied"), ("x", 2, "dismiss", "conflict"), ("x", 3, "separate", "applied"), ("x", 4, "dismiss", "applied"), ("x", 6, "rejoin", "applied"),
        ("y", 1, "rejoin", "applied"), ("y", 1, "rejoin", "conflict"), ("y", 2, "rejoin", "invalid"), ("y", 3, "prefer", "missing"),
        ("z", 1, "dismiss", "applied"), ("z", 2, "restore", "applied"), ("z", 3, "separate", "applied"), ("one", 1, "prefer", "missing"), ("none", 1, "clear", "missing"), (None, 1, "clear", "missing"),
    ]
    tied = [x for x in got if x[:3] == ("x", 4, "prefer")]
    assert sorted([x for x in got if x not in tied], key=str) == sorted(want, key=str) and tied[0][3] in ("invalid", "conflict")
    assert {(r["digest"], r["preferred"], r["dismissed"], r["revision"]) for r in done.groups.collect()} == {("x", None, True, 6), ("y", None, True, 2), ("z", None, False, 3)}
    assert sorted(map(tuple, done.marks.collect())) == [("x", "x0", "reviewed"), ("x", "x1", "reviewed"), ("x", "x2", "reviewed"), ("y", "y0", "reviewed"), ("y", "y2", "reviewed"), ("z", "z1", "separated")]


def test_two_actions_on_one_revision(spark):
    now = spark.createDataFrame([(1, "a", 3), (2, "b", 0), (2, "b", 0)], "id int, v string, revision int")
    value = lambda v: None if v is None else (v,)
    rows = [(1, 1, 3, value("x")), (1, 2, 3, value("y")), (1, 3, 4, (None,)), (1, 4, 5, None), (2, 1, 0, value("c")), (9, 1, 0, value("d"))]
    entries = spark.createDataFrame(rows, "id int, at int, after int, before_v struct<value:string>")
    done = merge.undo(now, entries, "id", "revision", ["v"])
    assert sorted(map(tuple, done.states.collect())) == [(1, None, 6), (2, "c", 1)]
    assert sorted((r["id"], r["at"], r["outcome"]) for r in done.outcomes.collect()) == [(1, 1, "applied"), (1, 2, "conflict"), (1, 3, "applied"), (1, 4, "applied"), (2, 1, "applied"), (9, 1, "missing")]

    held = spark.createDataFrame([("k", 1, "imported", "p", "d", 1)], "id string, revision int, origin string, parser string, digest string, sidecar int")
    edit = [("k", 1, 1, "old", "d", 1), ("k", 2, 1, "p", "d", 1), ("k", 3, 1, "p", "d", 1), ("k", 4, 2, "p", "e", 1)]
    edits = spark.createDataFrame(edit, "id string, at int, expected_revision int, expected_parser string, expected_digest string, expected_sidecar int")
    done = provenance.confirmed(held, edits, "id")
    assert [r["outcome"] for r in done.outcomes.orderBy("at").collect()] == ["parser", "applied", "conflict", "digest"]
    assert [(r["origin"], r["revision"]) for r in done.states.collect()] == [("confirmed", 2)]


def test_a_log_of_one_hot_key_in_many_parts(spark):
    """Every second action expects what its predecessor has left; a random walk in Python agrees."""
    import random

    r = random.Random(2)
    rows, revision = [], 0
    for at in range(3000):
        expected = r.choice([revision, revision, revision - 1, revision + 1])
        rows.append(("hot", at, expected, (str(at),)))
        revision += expected == revision
    log = spark.createDataFrame(rows, "id string, at int, after int, before_v struct<value:string>").repartition(9, "at")
    done = merge.undo(spark.createDataFrame([("hot", "", 0), ("cold", "", 5)], "id string, v string, revision int"), log, "id", "revision", ["v"])
    assert {x["id"]: x["revision"] for x in done.states.collect()} == {"hot": revision, "cold": 5}
    assert done.outcomes.where("outcome = 'applied'").count() == revision and done.outcomes.count() == 3000


def test_rows_given_twice_stay_one(spark):
    stamps = spark.createDataFrame([("p", 5, 10)], "path string, size int, modified int")
    recorded = spark.createDataFrame([("p", 4, 100), ("p", 5, 200), ("p", 5, 200)], "path string, size int, checked int")
    assert [tuple(r) for r in files.trusted(stamps, recorded, ["size"], "checked", 50).collect()] == [("p", 5, 10, True)]


def test_snapshots_are_published_behind_a_fence(spark, tmp_path):
    path = f"file://{tmp_path}/published"
    rows = lambda expected, **folders: spark.createDataFrame([(f, k, e) for f, ks in folders.items() for k in ks for e in [expected[f]]], "folder string, id int, expected long")
    fence = lambda staged: {r["folder"]: (r["revision"], r["committed"]) for r in merge.publish(staged, path, "folder", "id").collect()}
    table = lambda: {(r["folder"], r["id"], r["revision"]) for r in merge.table_at(spark, path, spark.createDataFrame([], "folder string, id int"), "folder", "revision").collect()}
    assert table() == set()
    assert fence(rows({"a": 0, "b": 0, "early": 3}, a=[1, 2], b=[3], early=[9])) == {"a": (0, True), "b": (0, True), "early": (0, False)}
    assert table() == {("a", 1, 1), ("a", 2, 1), ("b", 3, 1)}
    # one folder moves on, a stale writer of another is refused, a new folder appears
    assert fence(rows({"a": 1, "b": 0, "new": 0}, a=[2], b=[4, 5], new=[6])) == {"a": (1, True), "b": (1, False), "new": (0, True)}
    after = {("a", 2, 2), ("b", 3, 1), ("new", 6, 1)}
    assert table() == after
    files_before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert fence(rows({"a": 1}, a=[7])) == {"a": (2, False)} and table() == after
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == files_before


def test_snapshots_of_a_stream(spark, tmp_path):
    path, source = f"file://{tmp_path}/table", str(tmp_path / "in")
    schema = "folder string, id int, expected long"
    outcomes = []

    def each(batch, number):
        outcomes.append({r["folder"]: r["committed"] for r in merge.publish(batch, path, "folder", "id").collect()})

    for k, rows in enumerate([[("a", 1, 0), ("b", 2, 0)], [("a", 3, 1)], [("a", 4, 1), ("b", 5, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        assert len(outcomes) == k + 1
    assert outcomes == [{"a": True, "b": True}, {"a": True}, {"a": False, "b": True}]
    got = merge.table_at(spark, path, spark.createDataFrame([], "folder string, id int"), "folder", "revision")
    assert sorted((r["folder"], r["id"], r["revision"]) for r in got.collect()) == [("a", 3, 2), ("b", 5, 2)]


def test_upsert_of_repeated_keys_stays_one_row(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    inc = spark.createDataFrame([(1, "x"), (1, "y"), (3, "c"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, merge.upsert(now, inc, ["id"], ["v"]).collect())) == [(1, "y"), (2, "b"), (3, "c")]


def test_moves_are_matched_one_for_one(spark):
    m = spark.createDataFrame([(1, "d"), (2, "d"), (3, "d"), (4, "e")], "id long, digest string")
    p = spark.createDataFrame([(8, "d"), (7, "d"), (9, "f")], "id long, digest string")
    assert sorted(map(tuple, moves.reconciled(m, p).collect())) == [(1, 7), (2, 8)]


def test_numbers_sums_and_next_rows_across_ranges(spark):
    rows = [(k % 3 if k % 7 else None, k, float(k % 5)) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, id int, v double").repartition(5)
    by_key: dict = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(k, []).append((i, v))
    want = {i: (n, sum(v for _, v in g[: n + 1]), g[n + 1][0] if n + 1 < len(g) else None) for g in by_key.values() for n, (i, _) in enumerate(g)}
    n = {r["id"]: r["n"] for r in numbering.numbered(df, ["k"], ["id"], "n", 0).collect()}
    s = {r["id"]: r["s"] for r in numbering.running_sum(df, ["k"], ["id"], "v", "s").collect()}
    x = {r["id"]: r["x"] for r in numbering.with_next(df, ["k"], ["id"], "id", "x").collect()}
    assert {i: (n[i], s[i], x[i]) for i in n} == want
    assert numbering.numbered(df.limit(0), ["k"], ["id"], "n").count() == 0


def test_index_holds_every_position(spark, tmp_path):
    rows = [("1", ["a", "b", "a"], ["c"]), ("2", [], None), ("3", ["b", "a", "b", "bc"], ["a"])]
    d = spark.createDataFrame(rows, "id string, notes array<string>, name array<string>")
    postings.write_index(d, ["notes", "name"], f"file://{tmp_path}/i")
    index = postings.Index(spark, f"file://{tmp_path}/i")
    got = {(r["word"], r["field"], r["id"]): r["positions"] for r in index.postings.collect()}
    assert got == {("a", "notes", "1"): [0, 2], ("b", "notes", "1"): [1], ("c", "name", "1"): [0], ("b", "notes", "3"): [0, 2], ("a", "notes", "3"): [1], ("bc", "notes", "3"): [3], ("a", "name", "3"): [0]}
    assert {(r["word"], r["field"]): (r["documents"], r["positions"]) for r in index.vocabulary.collect()}[("b", "notes")] == (2, 3)
    postings.write_index(d.limit(0), ["notes"], f"file://{tmp_path}/none")
    assert postings.Index(spark, f"file://{tmp_path}/none").postings.count() == 0


def test_indexed_search_equals_the_direct_one(spark, tmp_path):
    d, t = docs(spark)
    fields = ("tags", "caption", "name", "notes")
    postings.write_index(d.select("id", *[F.col(f"{f}_tokens").alias(f) for f in fields]), fields, f"file://{tmp_path}/i")
    index = postings.Index(spark, f"file://{tmp_path}/i")
    for text in ('"old gate"', "gate", "gate*", "old -gateway", "red", "-red", '"red car"', "old ga*", '"gate old" -car', "nothing"):
        q = StructuredQuery(text=text)
        plain = sorted((r["id"], r["tier"], r["hit_fields"]) for r in search.structured_matches(d, t, q).collect())
        assert sorted((r["id"], r["tier"], r["hit_fields"]) for r in search.structured_matches(d, t, q, index=index).collect()) == plain
        both = [sorted(map(tuple, search.guidance(d, q, i).collect())) for i in (None, index)]
        assert both[0] == both[1]
    s = sounds(spark, {"title": "The rain", "comment": "rain on a metal door"}, {"title": "Café", "user_tags": ["swoosh"], "comment": "a loud hit"}, {"title": "Rainfall don't", "profile_tags": ["doors"]}, {"title": "cafe", "description": "rain, the quiet one"})
    postings.write_index(search.token_index_columns(s), search.SEARCHED, f"file://{tmp_path}/s")
    index = postings.Index(spark, f"file://{tmp_path}/s")
    for text in ("rain", "doors metal", "rain -loud", "raim", '"the"', "whosh impact", "café", ""):
        q = TextQuery(text=text)
        (a, x), (b, y) = search.ranked_matches(s, q), search.ranked_matches(s, q, index=index)
        assert (x.terms, x.corrected) == (y.terms, y.corrected)
        assert sorted((r["id"], r["score"]) for r in a.collect()) == sorted((r["id"], r["score"]) for r in b.collect())
    assert search.ranked_matches(s, TextQuery(text="rain"), index=index, allowed=[])[0].count() == 0


def test_decomposed_accents_match(spark):
    d = spark.createDataFrame([("café noir",)], "t string")
    assert d.select(T.index_tokens(F.col("t")).alias("t")).first()["t"] == ["cafe", "noir"]


def test_leases(spark):
    cols = "id int, source string, state string, at int, lease_until long, attempts int, what string"
    rows = [(1, "s", "running", 1, 50, 1, "a"), (2, "s", "queued", 2, None, 0, "b"), (3, "t", "queued", 3, None, 0, "a"), (4, "t", "queued", 4, None, 0, "b"), (5, "u", "running", 5, 200, 3, "a"), (6, "v", "running", 6, 60, 3, "a")]
    j = spark.createDataFrame(rows, cols)
    now, lease = F.lit(100).cast("long"), F.lit(30).cast("long")
    state = lambda df: {r["id"]: (r["state"], r["lease_until"], r["attempts"]) for r in df.collect()}
    r = state(jobs.recovered(j, now, 3))
    assert r[1] == ("queued", None, 1) and r[5] == ("running", 200, 3) and r[6] == ("failed", None, 3)
    c = state(jobs.claimed(j, now, lease))
    assert c[2] == ("queued", None, 0) and c[3] == ("running", 130, 1) and c[4] == ("queued", None, 0)
    own = spark.createDataFrame([(5, 3), (5, 3), (5, 2), (1, 1), (6, 2)], "id int, attempts int")
    assert jobs.renewed(j, own, now, lease).count() == len(rows)
    n = state(jobs.renewed(j, own, now, lease))
    assert n[5] == ("running", 130, 3) and n[1] == ("running", 50, 1) and n[6] == ("running", 60, 3)
    new = spark.createDataFrame([(10, "t", 9, "a"), (11, "w", 9, "a"), (12, "w", 9, "a")], "id int, source string, at int, what string")
    assert set(state(jobs.enqueued(j, new, ["what"]))) == {1, 2, 3, 4, 5, 6, 11}


def test_discovery_resumes(spark):
    e = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "path string, epoch int")
    found = spark.createDataFrame([("b",), ("d",)], "path string")
    assert sorted(map(tuple, jobs.resumed(e, found, "path", 2, False).collect())) == [("a", 2, "done"), ("b", 2, "again"), ("c", 1, "open"), ("d", 2, "new")]
    after = jobs.resumed(e, found, "path", 2, True).select("path", "epoch")
    assert {r["state"] for r in jobs.resumed(after.where("epoch = 2"), found, "path", 2, True).collect()} == {"done"}


def test_cosine_does_not_see_lengths(spark):
    rows = [(1, [2.0, 0.0], "a"), (2, [100.0, 90.0], "a"), (3, [0.0, 0.0], "a"), (4, None, "a"), (5, [1.0, None], "a"), (6, [float("inf"), 1.0], "a"), (7, [3.0, 0.0], "b"), (8, [1.0, 0.0, 0.0], "a"), (9, [], "a"), (10, [-1.0, 0.0], None), (11, [7.0, 0.0], "a")]
    items = spark.createDataFrame(rows, "item long, embedding array<double>, space string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, None, "a"), (3, [5.0, 0.0], None)], "query long, q array<double>, space string")
    got = [(r["query"], r["item"], round(r["similarity"], 3)) for r in vectors.ranking(asked, items, 9, space="space").orderBy("query", "rank").collect()]
    assert got == [(1, 1, 1.0), (1, 11, 1.0), (1, 2, round(100 / math.hypot(100, 90), 3)), (3, 10, -1.0)]
    assert vectors.ranking(asked.limit(0), items, 3).count() == vectors.ranking(asked, items.limit(0), 3).count() == 0


def test_vector_blocks_agree(spark):
    r = np.random.default_rng(1)
    rows = [(k, (v * (1 + k % 5)).tolist(), int(k % 4)) for k, v in enumerate(r.normal(size=(90, 8)))]
    e = spark.createDataFrame(rows, "item long, embedding array<double>, vl int")
    asked = e.where("item % 9 = 0").select(F.col("item").alias("query"), F.col("embedding").alias("q"), F.col("vl").alias("ql"))
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    want = {}
    for q in range(0, 90, 9):
        order = [i for i in np.lexsort((np.arange(90), -s[q])) if i != q]
        same = [n for n, i in enumerate(order, 1) if i % 4 == q % 4]
        want[q] = (len(same), sum(n <= 5 for n in same), same[0], [int(i) for i in order[:5]])
    got = {x["query"]: (x["size"], x["found"], x["first"]) for x in vectors.label_retrieval(asked, e, 5).collect()}
    for block in (4096, 13):
        near: dict = {}
        for x in vectors.pruned_ranking(asked, e, 5, own=False, block=block).rows.orderBy("query", "rank").collect():
            near.setdefault(x["query"], []).append(x["item"])
        assert {q: (*got[q], near[q]) for q in got} == want


def test_blocks_that_cannot_matter_are_skipped(spark):
    """Vectors around twenty directions: most pairs of blocks are never multiplied, and the nearest are those of all pairs."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(20, 12))
    x = centres[np.arange(800) % 20] + 0.05 * r.normal(size=(800, 12))
    x[:40] = x[40:80]  # ties
    e = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "item long, embedding array<double>")
    asked = e.where("item % 7 = 0").select(F.col("item").alias("query"), F.col("embedding").alias("q"))
    done = vectors.pruned_ranking(asked, e, 4, block=40, pivots=30)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got: dict = {}
    for row in done.rows.orderBy("query", "rank").collect():
        got.setdefault(row["query"], []).append((row["item"], row["similarity"]))
    for q, found in got.items():
        s = unit @ unit[q]
        best = np.sort(s)[::-1][:4]
        assert np.allclose([v for _, v in found], best, atol=1e-12) and np.allclose(s[[i for i, _ in found]], best, atol=1e-12)
    assert len(got) == len(range(0, 800, 7))
    assert done.compared < 0.35 * done.pairs


def test_rendered_signal(spark):
    f = spark.createDataFrame([("p", k, 1.0) for k in range(10)], "path string, frame long, value double")
    out = [r["value"] for r in timeseries.rendered(f, ["path"], 2, 8, 0.5, 2, 3, (1, 1)).orderBy("frame").collect()]
    assert np.allclose(out, [0.25, 0.5, 0.5, 0.5, 0.5 * 2 / 3, 0.5 / 3])
    assert timeseries.rendered(f, ["path"], 2, 8, 1.0, 1, 1, (2, 3)).count() == 9
    assert timeseries.rendered(f, ["path"], 20, 30, 1.0, 1, 1, (2, 3)).count() == 0


def test_scan(spark, tmp_path):
    for name in ("a.wav", "b.wav", "c.wav", "sub/deeper/d.WAV", ".hidden.wav", ".dots/e.wav", "notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "link.wav").symlink_to(tmp_path / "a.wav")
    (tmp_path / "linked").symlink_to(tmp_path / "sub")
    found = files.listing(spark, str(tmp_path), ["wav"]).withColumn("modified", F.unix_timestamp("modified"))
    assert sorted(r["path"].split(f"{tmp_path.name}/")[1] for r in found.collect()) == ["a.wav", "b.wav", "c.wav", "sub/deeper/d.WAV"]
    known = found.where("path not like '%c.wav'").select("path", F.when(F.col("path").endswith("b.wav"), 0).otherwise(F.col("size")).alias("size"), "modified", F.lit("old").alias("digest"))
    known = known.unionByName(known.limit(1).withColumn("path", F.lit("gone")))
    got = {r["path"].rsplit("/", 1)[-1]: (r["action"], r["digest"]) for r in files.scan(spark, found, known, str(tmp_path)).collect()}
    assert got["a.wav"] == got["d.WAV"] == ("reuse", "old") and got["b.wav"] == ("hash", hashlib.sha1(b"b.wav").hexdigest()) and got["c.wav"][0] == "hash" and got["gone"][0] == "missing"
    assert len(got) == 5


def test_folder_source(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"f{k % 3}/g{k % 2}/h{k % 5}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"f{k % 3}/g{k % 2}/h{k % 5}/{k}.png").write_bytes(b"x" * k)
    (tmp_path / "top é.png").write_bytes(b"t")
    spark.dataSource.register(folders.FolderSource)
    read = lambda **o: spark.read.format("lumencat_folder").options(**o).load(str(tmp_path))
    for split in (0, 1, 2, 5):
        assert {(r["path"].rsplit("/", 1)[-1], r["size"], r["depth"]) for r in read(split=split).collect()} == {(f"{k}.png", k, 4) for k in range(30)} | {("top é.png", 1, 1)}
    assert [read(depth=n).count() for n in (1, 2, 3, 4)] == [1, 1, 1, 31]
    assert spark.read.format("lumencat_folder").load(f"file://{tmp_path}/f0/g0").count() == 5 and spark.read.format("lumencat_folder").load(f"{tmp_path}/none").count() == 0
    (tmp_path / "link").symlink_to(tmp_path / "f0/g0")
    (tmp_path / ".dot").write_bytes(b"")
    asked = [f"file:{tmp_path}/top é.png", f"{tmp_path}/top é.png", f"{tmp_path}/link", f"{tmp_path}/.dot", f"{tmp_path}/f0", f"{tmp_path}/gone", f"{tmp_path}/gone", None, "s3://other/x"]
    got = sorted((r["path"].rsplit("/", 1)[-1], r["status"], r["digest"]) for r in folders.read_paths(spark.createDataFrame([(p,) for p in asked], "path string"), digest=True).collect())
    sha = hashlib.sha1(b"t").hexdigest()
    assert got == [(".dot", "hidden", None), ("f0", "no_file", None), ("gone", "absent", None), ("link", "link", None), ("top é.png", "found", sha), ("top é.png", "found", sha), ("x", "absent", None)]
