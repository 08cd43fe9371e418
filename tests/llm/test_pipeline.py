"""The pipeline's stages on a small corpus, and its registration."""

import pathlib
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lumencat.llm import language_id, near_dedup, queries


def test_stages(spark, tmp_path):
    r = random.Random(13)
    words = {"en": "the and of thin rest wash hand".split(), "de": "der und ist schach keit mit von".split()}
    say = lambda lang, n: " ".join(r.choice(words[lang]) + str("abcdefgh"[r.randrange(8)]) for _ in range(n)).capitalize() + "."
    passage = " ".join(say("en", 12) for _ in range(5))
    docs = [(k, f"{say(lang, 60)} {say(lang, 9)}", lang) for k, lang in enumerate(["en", "de"] * 20)]
    docs += [(100, docs[0][1], "en"), (101, f"{say('en', 30)} {passage}", "en"), (102, f"{say('en', 31)} {passage} {say('en', 8)}", "en"), (103, None, "en"), (104, "12 !", "de")]
    d = spark.createDataFrame([(k, t, lang, "s", len(t or ""), "more") for k, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.keep_known_language(spark, d, str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _, _ in docs} - {103, 104}
    single = corpus_pipeline.drop_near_duplicates(spark, kept, str(tmp_path))
    assert {r["doc_id"] for r in single.collect()} == {k for k, _, _ in docs} - {100, 103, 104}
    cut = corpus_pipeline.cut_repeated_passages(spark, single, str(tmp_path))
    texts = {r["doc_id"]: r for r in cut.collect()}
    assert set(texts) == {r["doc_id"] for r in single.collect()} and cut.columns == corpus_pipeline.COLUMNS
    assert passage in texts[101]["text"] and passage not in texts[102]["text"] and texts[102]["n_chars"] == len(texts[102]["text"])
    assert texts[1]["text"] == docs[1][1]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(texts)
    assert language_id.REJECT_RATE > 0.5


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_near_stage_takes_similarities_of_eighty_per_cent(spark, tmp_path):
    rows = []
    for k, changed in enumerate([2, 3, 4, 5, 6] * 4):
        words = [f"w{k}x{i}" for i in range(204)]
        other = [f"new{i}" if i % 30 == 7 and i // 30 < changed else w for i, w in enumerate(words)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    sets = {k: set(near_dedup.shingle_set(t).tolist()) for k, t in rows}
    share = {k: len(sets[k] & sets[k - 1]) / len(sets[k] | sets[k - 1]) for k in sets if k % 2}
    assert any(0.8 <= j < 0.85 for j in share.values()) and any(j < 0.8 for j in share.values())
    d = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, d, str(tmp_path)).collect()}
    assert left == set(sets) - {k for k, j in share.items() if j >= 0.8}
    assert near_dedup.layout(85) == (28, 6) and near_dedup.layout(80) == (33, 5)
    for p in range(10, 100, 5):
        bands, n = near_dedup.layout(p)
        assert (1 - (p / 100) ** n) ** bands <= 1e-5


def test_repeated_and_missing_ids_and_an_empty_table(spark, tmp_path):
    r = random.Random(17)
    words = {"en": "the and of thin rest wash hand".split(), "de": "der und ist schach keit mit von".split()}
    say = lambda lang, n: " ".join(r.choice(words[lang]) + str("abcdefgh"[r.randrange(8)]) for _ in range(n)).capitalize() + "."
    rows = [(k, say(lang, 50), lang) for k, lang in enumerate(["en", "de"] * 20)]
    rows += [(3, say("de", 40), "de"), (3, rows[3][1], "de"), (None, say("en", 45), "en"), (None, rows[4][1], "en"), (50, rows[6][1], None)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    d = spark.createDataFrame([(k, t, lang, None, len(t)) for k, t, lang in rows], cols)
    d.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some"))
    ids = {x["doc_id"] for x in out.select("doc_id").distinct().collect()}
    assert ids == {None, *range(40)}  # 50 is a copy of 6
    d.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    null = near_dedup.near_duplicates(d).where("doc_id is null").collect()
    assert len(null) == 1 and null[0]["kept"] is True


def test_registered_queries_run_on_tables(spark):
    """Each operator's registered query on the smallest tables: one row for each row of its table where that is its result."""
    folder = "/root/testdata/sf0.001"
    if not pathlib.Path(folder).exists():
        pytest.skip("no test tables")
    docs, pages = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/pages.parquet")
    found = {n: f(spark, folder) for n, f in queries.QUERIES.items()}
    for name in ("op1_webp_media", "op2_line_dedup", "op4_minmax_near_dedup", "op7_piece_bpe", "op8_content_store", "op9_cross_parsing_language"):
        assert found[name].select("doc_id").distinct().count() == found[name].count() == docs.count()
    assert found["op5_warc_captures"].select("page_id").distinct().count() == pages.count()
    assert found["op3_dp_packing"].groupBy("doc_id").agg({"length": "sum"}).count() == docs.count()
    assert found["op6_multi_index_hamming"].count() > 0 and found["op10_hmm_transcripts"].count() > 0
    store = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in found["op8_content_store"].collect()}
    packed = found["op3_dp_packing"].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] == store[r["doc_id"]][0] for r in packed)
