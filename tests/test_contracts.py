"""The validator: one document for each kind of rule, and the same documents with one thing changed."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from lumencat.operators import contracts as C

SIZE = C.Object({"w": C.whole(1, 100), "h": C.whole(1, 100)}, {"area": (C.LIMIT, lambda read: read("w", "long") * read("h", "long") > 2000)}, nullable=True)
PHOTO = C.Object(
    {
        "schema": C.text(20), "id": C.uuid(), "sum": C.digest(nullable=True), "at": C.relative_path(30), "kind": C.choice(["still", "loop"]), "size": SIZE,
        "tags": C.Items(C.text(8), most=3, unique=True), "marks": C.Items(C.Object({"x": C.whole(0, 9, code=C.INVALID), "note": C.text(5, empty=True, optional=True)}), optional=True), "on": C.flag(),
    },
    {"still": (C.INVALID, lambda read: (read("kind") == "still") & read("on", "boolean"))},
)
GOOD = {"schema": "photo/2", "id": "0b5c0a8e-1111-4222-8333-00000000abcd", "sum": None, "at": "sea/été 1.png", "kind": "loop", "size": {"w": 40, "h": 50}, "tags": ["sea", "sky"], "marks": [{"x": 3}, {"x": 4, "note": ""}], "on": True}


def changed(path, value):
    out = copy.deepcopy(GOOD)
    *way, last = path
    at = out
    for k in way:
        at = at[k]
    if value is KeyError:
        del at[last]
    else:
        at[last] = value
    return out


CASES = [
    (("sum",), "a" * 64, []), (("sum",), "A" * 64, [(C.INVALID, "$.sum")]), (("sum",), "a" * 63, [(C.INVALID, "$.sum")]), (("sum",), KeyError, [(C.INVALID, "$.sum")]),
    (("size",), None, []), (("size",), KeyError, [(C.INVALID, "$.size")]), (("size",), 7, [(C.INVALID, "$.size")]), (("size", "w"), 0, [(C.LIMIT, "$.size.w")]), (("size", "w"), 41, [(C.LIMIT, "$.size.area")]),
    (("size", "h"), None, [(C.INVALID, "$.size.h")]), (("size", "h"), "50", [(C.INVALID, "$.size.h")]), (("size", "h"), 50.5, [(C.INVALID, "$.size.h")]), (("size", "d"), 1, [(C.INVALID, "$.size.d")]),
    (("schema",), "photo/3", [(C.SCHEMA, "$.schema")]), (("schema",), KeyError, [(C.SCHEMA, "$.schema")]), (("schema",), 2, [(C.SCHEMA, "$.schema")]),
    (("id",), GOOD["id"].upper(), [(C.INVALID, "$.id")]), (("id",), "00000000-0000-0000-0000-000000000000", [(C.INVALID, "$.id")]), (("id",), GOOD["id"] + "\n", [(C.INVALID, "$.id")]),
    *[(("at",), p, [(C.PATH, "$.at")]) for p in ("", "/a", "a//b", "a/", "./a", "a/..", "c:a", "a\\b", "a\tb", "x" * 31)], (("at",), "a/...b", []), (("at",), "a/.b", []),
    (("kind",), "video", [(C.INVALID, "$.kind")]), (("kind",), "still", [(C.INVALID, "$.still")]), (("on",), "true", [(C.INVALID, "$.on")]), (("on",), 1, [(C.INVALID, "$.on")]),
    (("tags",), [], []), (("tags",), ["a", "b", "c", "d"], [(C.LIMIT, "$.tags")]), (("tags",), ["a", "a"], [(C.CONFLICT, "$.tags")]), (("tags",), ["a", ""], [(C.INVALID, "$.tags[1]")]), (("tags", 1), None, [(C.INVALID, "$.tags[1]")]),
    (("tags",), {"0": "a"}, [(C.INVALID, "$.tags")]), (("tags",), None, [(C.INVALID, "$.tags")]), (("tags", 0), "ééééé", [(C.INVALID, "$.tags[0]")]),
    (("marks",), KeyError, []), (("marks",), None, [(C.INVALID, "$.marks")]), (("marks", 1, "x"), 10, [(C.INVALID, "$.marks[1].x")]), (("marks", 0, "note"), None, [(C.INVALID, "$.marks[0].note")]), (("marks", 0, "y"), 1, [(C.INVALID, "$.marks[0].y")]),
    (("b",), 1, [(C.INVALID, "$.b")]),
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [json.dumps(GOOD), *[json.dumps(changed(p, v), ensure_ascii=False) for p, v, _ in CASES]]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    return {r["n"]: [tuple(e) for e in r["e"]] for r in rows.select("n", C.errors(F.col("t"), PHOTO, "photo/2").alias("e")).collect()}


def test_a_good_document(found):
    assert found[0] == []


@pytest.mark.parametrize("n", range(len(CASES)), ids=lambda n: f"{'.'.join(map(str, CASES[n][0]))}={str(CASES[n][1])[:12]}")
def test_one_change(found, n):
    assert found[n + 1] == CASES[n][2]


def test_texts_that_are_no_documents(spark):
    two = changed(("on",), None) | {"kind": 3}
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "{"), (3, "[]"), (4, "null"), (5, json.dumps(GOOD) + " " * 3000), (6, json.dumps(two))], "n int, t string")
    got = {r["n"]: [tuple(e) for e in r["e"]] for r in rows.select("n", C.errors(F.col("t"), PHOTO, "photo/2", most_bytes=2000).alias("e")).collect()}
    assert all(got[k] == [(C.INVALID, "$")] for k in range(5)) and got[5] == [(C.LIMIT, "$")]
    assert got[6] == [(C.INVALID, "$.kind"), (C.INVALID, "$.on")]


def test_rules_over_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 6), (6, 4), (7, 7), (8, 99), (9, 4), (9, 4)], "id int, parent int")
    assert [r["id"] for r in C.repeated(rows, ["id"]).collect()] == [9]
    assert [r["id"] for r in C.dangling(rows, "id", "parent", rows, "id").collect()] == [8]
    assert sorted(r["id"] for r in C.cyclic(rows, "id", "parent").collect()) == [4, 5, 6, 7, 9]
    assert C.cyclic(rows.limit(0), "id", "parent").count() == 0
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(70)], "id int, parent int")
    assert C.cyclic(chain, "id", "parent").count() == 0
