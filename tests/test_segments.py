"""The index that changes, against one built anew from the same documents."""

import random

from pyspark.sql import functions as F

from lumencat.operators import cache, search, segments

FIELDS = ("title", "notes")
TOKENS = "id long, title array<string>, notes array<string>"


def contents(r, ids, words=("gate", "gates", "old", "red", "der", "über")):
    return {i: ([r.choice(words) for _ in range(r.randrange(3))], [r.choice(words) for _ in range(r.randrange(6))]) for i in ids}


def frame(spark, docs):
    return spark.createDataFrame([(i, *d) for i, d in sorted(docs.items())], TOKENS)


def state(index):
    rows = {(r["word"], r["field"], r["id"]): tuple(r["positions"]) for r in index.postings.collect()}
    words = {(r["word"], r["field"]): (r["documents"], r["positions"]) for r in index.vocabulary.collect()}
    return rows, words


def expected(docs):
    rows, words = {}, {}
    for i, fields in docs.items():
        for f, tokens in zip(FIELDS, fields, strict=True):
            for w in set(tokens):
                at = tuple(k for k, t in enumerate(tokens) if t == w)
                rows[w, f, i] = at
                n, m = words.get((w, f), (0, 0))
                words[w, f] = (n + 1, m + len(at))
    return rows, words


def test_changes_equal_a_full_rebuild(spark, tmp_path, monkeypatch):
    r, root = random.Random(3), f"file://{tmp_path}/index"
    docs = contents(r, range(40))
    index = segments.build(frame(spark, docs), FIELDS, root)
    assert state(index) == expected(docs) and len(index.segments) == 1
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 4)
    for step in range(5):
        changed = contents(r, r.sample(range(50), 9))  # some are new
        gone = r.sample(sorted(docs), 3)
        docs = {i: d for i, d in (docs | changed).items() if i not in gone}
        ids = spark.createDataFrame([(i,) for i in [*changed, *gone, *gone]] + [(None,)], "id long")
        before = len(index.segments)
        index = segments.refresh(index, ids, frame(spark, docs), FIELDS)
        assert len(index.segments) == (before + 1 if before < 4 else 1), step
        assert state(index) == expected(docs)
        assert state(segments.SegmentedIndex(spark.newSession(), root)) == expected(docs)  # another session, no build
    assert {x["id"] for x in index.documents().collect()} == set(docs)
    live = {s["path"].rsplit("/", 1)[-1] for s in index.segments}
    assert live <= {p.name for p in (tmp_path / "index/segments").iterdir()}


def test_old_segments_are_deleted(spark, tmp_path):
    r, root = random.Random(5), f"file://{tmp_path}/index"
    docs = contents(r, range(6))
    index = segments.build(frame(spark, docs), FIELDS, root)
    for _ in range(3):
        index = segments.refresh(index, spark.createDataFrame([(1,)], "id long"), frame(spark, docs), FIELDS)
    folder = tmp_path / "index/segments"
    assert len(list(folder.iterdir())) == 4
    index = segments.compact(segments.compact(index))
    assert len(list(folder.iterdir())) == 2 and state(index) == expected(docs)


def test_a_batch_counts_once(spark, tmp_path):
    r, root = random.Random(7), f"file://{tmp_path}/index"
    docs = contents(r, range(5))
    index = segments.build(frame(spark, docs), FIELDS, root)
    ids = spark.createDataFrame([(2,)], "id long")
    docs[2] = (["new"], [])
    once = segments.refresh(index, ids, frame(spark, docs), FIELDS, batch="7")
    again = segments.refresh(once, ids, frame(spark, docs), FIELDS, batch="7")
    assert len(again.segments) == len(once.segments) == 2 and state(again) == expected(docs)


def test_an_empty_index_and_one_that_is_emptied(spark, tmp_path):
    none = segments.build(frame(spark, {}), FIELDS, f"file://{tmp_path}/none")
    assert state(none) == ({}, {})
    one = segments.refresh(none, spark.createDataFrame([(1,)], "id long"), frame(spark, {1: (["a"], ["b"])}), FIELDS)
    assert state(one) == expected({1: (["a"], ["b"])})
    assert state(segments.refresh(one, spark.createDataFrame([(1,)], "id long"), frame(spark, {}), FIELDS)) == ({}, {})


def test_an_index_of_a_table_follows_its_files(spark, tmp_path):
    r, table = random.Random(9), str(tmp_path / "table")
    docs = contents(r, range(12))
    built = []

    def make():
        built.append(1)
        return spark.read.schema(TOKENS).parquet(table)

    frame(spark, docs).write.parquet(table)
    index = segments.index_of(spark, "test", table, make, FIELDS)
    assert state(index) == expected(docs) and len(built) == 1
    segments._open.clear()  # as another application does
    again = segments.index_of(spark.newSession(), "test", table, make, FIELDS)
    assert state(again) == expected(docs) and len(built) == 1 and again.number == index.number
    docs[3] = (["changed"], ["twice", "twice"])
    docs[99] = (["new"], [])
    del docs[4]
    frame(spark, docs).write.mode("overwrite").parquet(table)
    after = segments.index_of(spark, "test", table, make, FIELDS)
    assert state(after) == expected(docs) and [s["documents"] for s in after.segments] == [12, 3]
    assert segments.index_of(spark, "test", table, make, FIELDS) is after


def test_a_stream_of_changes(spark, tmp_path):
    r, root, queue = random.Random(11), f"file://{tmp_path}/index", str(tmp_path / "queue")
    docs = contents(r, range(20))
    index = segments.build(frame(spark, docs), FIELDS, root)
    for ids in ([1, 2, 2], [3], [1, 30]):
        docs |= contents(r, ids)
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(queue)
    now = frame(spark, docs)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(queue)
    for _ in range(2):  # run again: nothing is new
        segments.follow(stream, index.path, lambda ids: now.join(ids, "id", "left_semi"), FIELDS, str(tmp_path / "state"))
        after = segments.SegmentedIndex(spark, root)
        assert len(after.segments) == 4 and state(after) == expected(docs)


def test_conditions_on_words_reach_every_scan(spark, tmp_path):
    r = random.Random(13)
    docs = contents(r, range(10))
    index = segments.build(frame(spark, docs), FIELDS, f"file://{tmp_path}/index")
    index = segments.refresh(index, spark.createDataFrame([(2,)], "id long"), frame(spark, docs), FIELDS)
    plan = search.of_words(index, ["gate"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("flat = ") + plan.count("EqualTo(flat") + plan.count("In(flat") >= 2
    assert index.postings.where(F.col("word") == "gate").count() == sum(k[0] == "gate" for k in expected(docs)[0])


def test_kept_results_follow_the_counters(spark, tmp_path):
    root = f"file://{tmp_path}/results"
    rows = spark.createDataFrame([(k, (k * 7) % 10) for k in range(30)], "id int, score int")
    order = [F.desc("score"), F.asc("id")]
    made = []

    def look(session, keep=lambda df: df, query="q", scopes=("a", "b"), size=4):
        def make():
            made.append(query)
            return keep(rows)

        result, kept = cache.ResultCache(session, root, size).get(query, scopes, order, make)
        return [r["id"] for r in cache.ResultCache.page(result, 2, 3).orderBy("place").collect()], kept

    first = look(spark)
    assert first == ([27, 4, 14], False) and look(spark.newSession()) == ([27, 4, 14], True) and made == ["q"]
    assert look(spark, scopes=("b",))[1] is False  # another scope, another result
    other = cache.ChangeCounters(spark.newSession(), root)
    other.changed(spark.createDataFrame([("c",), (None,)], "scope string"))
    assert look(spark)[1] is True  # not in its scopes
    other.changed(spark.createDataFrame([("a",), ("a",)], "scope string"))
    other.changed(spark.createDataFrame([("a",)], "scope string"))
    assert other.values(["b", "a", "c"]) == (("a", 2), ("b", 0), ("c", 1))
    assert look(spark, lambda df: df.where("id <> 27")) == ([4, 14, 24], False)
    assert look(spark, lambda df: df.limit(0)) == ([4, 14, 24], True)
    for k in range(3):
        look(spark, query=f"q{k}", size=2)
    assert len(list((tmp_path / "results/results").iterdir())) == 2
    assert look(spark, lambda df: df.limit(0), query="none") == ([], False)


def test_a_merge_keeps_how_many_were_written(spark, tmp_path, monkeypatch):
    r, root = random.Random(11), f"file://{tmp_path}/index"
    docs = contents(r, range(5))
    index = segments.build(frame(spark, docs), FIELDS, root)
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 2)
    for k in range(2, 6):
        index = segments.refresh(index, spark.createDataFrame([(1,)], "id long"), frame(spark, docs), FIELDS)
        assert index.written == segments.SegmentedIndex(spark.newSession(), root).written == k
    assert len(index.segments) == 1 and segments.branch(index, f"file://{tmp_path}/other").written == 5
