"""Every registered query against its SQL on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lumencat.operators import segments
from lumencat.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plain(v):
    if isinstance(v, decimal.Decimal) or isinstance(v, float):
        return "nan" if math.isnan(v) else round(float(v), 5)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equal_to_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(([plain(r[n]) for n in names] for r in df.collect()), key=str)
    c = con.execute(registry.SQL[name])
    at = [d[0] for d in c.description]
    assert sorted(at) == names
    want = sorted(([plain(r[at.index(n)]) for n in names] for r in c.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "title", "score"]


def test_plans_prune_and_limit_before_sorting(spark):
    plan = registry.QUERIES["JN-05"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan and "CartesianProduct" not in plan
    page = registry.QUERIES["text_search_ranked"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in page and "BatchEvalPython" not in page


def test_merged_segments_still_count_as_written(spark, con, monkeypatch):
    """As in a queue of over 15 batches, here by a limit of one segment; the other tests have fewer batches than are merged."""
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 1)
    rows = entry.queries()["TXT-18"](spark, FOLDER).select("word", "docs", "counted", "segments").collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(f"select word, docs, counted, segments from ({registry.SQL['TXT-18']})").fetchall())
