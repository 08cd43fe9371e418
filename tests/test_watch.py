"""The watch planner: timelines with known ends, a second planner written as a plain loop, and the stream against the table form."""

import random
import time
from datetime import datetime, timedelta, timezone

import duckdb
import pytest

from lumencat.plans import changes, registry  # noqa: F401  (changes registers its queries)
from lumencat.streaming import watch

SCHEMA = "source string, at double, what string, path string, observed string, size long"


def plan(spark, rows, quiet=2.0, stable=3.0, most=100):
    log = spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], SCHEMA)
    return sorted((r["source"], r["at"], r["kind"], r["path"]) for r in watch.planned(log, quiet, stable, most).collect())


def stat(at, path, observed="file", size=1, source="s"):
    return (source, float(at), "stat", path, observed, size)


def event(at, path, source="s"):
    return (source, float(at), "event", path)


def test_a_path_settles_after_quiet_and_two_equal_looks(spark):
    rows = [stat(0, "p")] + [event(t, "p") for t in (1, 2, 2.5, 4)]
    assert plan(spark, rows) == [("s", 9.0, "file", "p")]
    # the size grows at the time of the second look, so that a third one is needed
    assert plan(spark, [*rows, stat(8, "p", size=2)]) == [("s", 12.0, "file", "p")]
    # an event between the looks starts anew; what was seen before does not count
    assert plan(spark, [*rows, event(8.5, "p")]) == [("s", 13.5, "file", "p")]
    # settled once, and again only after another event
    assert plan(spark, [*rows, event(30, "p")]) == [("s", 9.0, "file", "p"), ("s", 35.0, "file", "p")]


def test_kinds_come_from_what_is_seen(spark):
    rows = [stat(0, "d", "folder"), stat(0, "f"), stat(0, "x", "ignored"), stat(0, "gone"), stat(4, "gone", "absent"), *[event(1, p) for p in ("d", "f", "x", "gone", "never")]]
    assert plan(spark, rows) == [("s", 6.0, "file", "f"), ("s", 6.0, "folder", "d"), ("s", 6.0, "removed", "never"), ("s", 9.0, "removed", "gone")]


def test_too_many_pending_give_one_refresh_after_quiet(spark):
    rows = [stat(0, p) for p in "abcd"] + [event(1, "a"), event(1.5, "b"), event(2, "a"), event(2.5, "c"), event(3, "d"), event(4.5, "a")]
    assert plan(spark, rows, most=2) == [("s", 6.5, "refresh", None)]
    assert plan(spark, rows, most=4) == [("s", 6.5, "file", "b"), ("s", 7.5, "file", "c"), ("s", 8.0, "file", "d"), ("s", 9.5, "file", "a")]
    # afterwards paths are pending again
    assert plan(spark, [*rows, event(20, "a")], most=2) == [("s", 6.5, "refresh", None), ("s", 25.0, "file", "a")]


def test_losses_and_refusals(spark):
    rows = [stat(0, "a"), event(1, "a"), ("s", 2.0, "lost", None)]
    assert plan(spark, rows) == [("s", 4.0, "refresh", None)]
    assert plan(spark, [*rows, ("s", 4.5, "refused", None)]) == [("s", 4.0, "refresh", None), ("s", 6.5, "refresh", None)]
    assert plan(spark, [stat(0, "a"), event(1, "a"), ("s", 6.5, "refused", "a")]) == [("s", 6.0, "file", "a"), ("s", 11.5, "file", "a")]
    assert plan(spark, [stat(0, "a"), event(1, "a"), event(1, "a", "t"), ("t", 2.0, "lost", None), (None, 1.0, "event", "a")]) == [("s", 6.0, "file", "a"), ("t", 4.0, "refresh", None)]
    assert plan(spark, []) == []


def by_ticks(rows, quiet, stable, most):
    """Looks at everything at every tick: slow, and written otherwise."""
    out = []
    for source in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == source), key=lambda r: (r[1], r[2] != "stat", r[3]))
        last, seen, there, over = {}, {}, {}, None
        for k in range(int(mine[-1][1] + 60) * 32):
            now = k / 32
            for _, _, what, path, observed, size in (r for r in mine if r[1] == now):
                if what == "stat":
                    there[path] = (observed, size)
                elif over is not None:
                    over = now
                elif path not in last and len(last) >= most:
                    last, seen, over = {}, {}, now
                else:
                    last[path] = now
                    seen.pop(path, None)
            if over is not None and now == over + quiet:
                out.append((source, now, "refresh", None))
                over = None
            for p in [p for p, t in last.items() if now >= t + quiet and (p not in seen or now >= seen[p][0] + stable)]:
                stat_now = there.get(p, ("absent", None))
                if stat_now[0] == "absent":
                    stat_now = ("absent", None)
                if p in seen and seen[p][1] == stat_now:
                    del last[p], seen[p]
                    if stat_now[0] != "ignored":
                        out.append((source, now, {"absent": "removed"}.get(stat_now[0], stat_now[0]), p))
                else:
                    seen[p] = (now, stat_now)
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_random_timelines(spark, seed):
    r = random.Random(seed)
    rows = set()
    for s in "st":
        for k in range(60):
            path = r.choice("abcde")
            at = r.randrange(400) / 8
            rows.add((s, at, "event", path, None, None) if k % 3 else (s, at + 1 / 32, "stat", path, r.choice(["file", "file", "folder", "absent", "ignored"]), r.randrange(2)))
    at_once = {}
    rows = sorted(at_once.setdefault(x[:4], x) for x in sorted(rows, key=str) if x[:4] not in at_once)  # one stat a moment
    quiet, stable = 2.0, 3.0
    most = [2, 3, 9][seed % 3]
    got = sorted(plan(spark, rows, quiet, stable, most), key=str)
    want = by_ticks(rows, quiet, stable, most)
    assert got == want


def test_the_stream_agrees_with_the_table(spark, tmp_path):
    """Rows arrive in several files, partly out of order; a last row far behind them lets the watermark pass all that is due."""
    r = random.Random(4)
    rows = [(s, float(r.randrange(4000)) / 8, "event" if r.random() < 0.7 else "stat", r.choice("abcdef"), None, None) for s in "xyz" for _ in range(80)]
    rows = [x if x[2] == "event" else (*x[:4], r.choice(["file", "folder"]), r.randrange(3)) for x in rows]
    rows = sorted(set(rows), key=lambda x: (x[1], str(x)))
    want = plan(spark, rows, 10.0, 5.0, 3)
    for k in range(4):
        part = [(x[0], datetime.fromtimestamp(x[1], timezone.utc), *x[2:]) for x in rows if int(x[1] // 125) == k]
        r.shuffle(part)
        spark.createDataFrame(part, "source string, time timestamp, what string, path string, observed string, size long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = [(s, datetime.fromtimestamp(9999, timezone.utc), "stat", "zz", "file", 1) for s in "xyz"]
    spark.createDataFrame(late, "source string, time timestamp, what string, path string, observed string, size long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", watch.ROCKS)
    try:
        stream = spark.readStream.schema("source string, time timestamp, what string, path string, observed string, size long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = watch.watch_stream(stream, "time", "130 seconds", 10.0, 5.0, 3)
        run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    got = sorted((x["source"], x["at"], x["kind"], x["path"]) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want and len(want) > 20


def test_a_row_does_not_cost_what_is_pending():
    """60,000 events of 4,000 paths that stay pending: a look at each of them for each row takes over ten times as long."""
    planner, began = watch.Planner(50_000.0, 3.0, watch.MOST_PENDING), time.process_time()
    done = [e for k in range(60_000) for e in planner.step(float(k), "event", str(k % 4000), None, None, None)]
    assert not done and len(planner.pending) == 4000 and len(planner.looks) == 4000
    assert time.process_time() - began < 3
    again = watch.Planner.restored(planner.saved(), 50_000.0, 3.0, watch.MOST_PENDING)
    ends = planner.until(float("inf"))
    assert ends == again.until(float("inf")) and [e[:3] for e in ends] == [(56_000.0 + k + 50_003, "removed", str(k)) for k in range(4000)]


@pytest.mark.parametrize("users, rows_in_a_file", [(5000, 0), (200, 8)])
def test_the_stream_query_on_more_paths_and_files(spark, tmp_path, users, rows_in_a_file):
    """More paths of one source pending at once than a source may have, and more files in a part than a batch took: every path stands by itself, and no row is late."""
    r, start = random.Random(users), datetime(2024, 1, 1)
    seconds = [k / users * 3000 for k in range(users)] + [r.randrange(30 * 86_400) for _ in range(4000)]
    rows = [(k, start + timedelta(seconds=at), 20 * (k % users), "view" if k % 5 == 0 else "click", float(r.randrange(200))) for k, at in enumerate(seconds)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    was = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", rows_in_a_file)
    try:
        got = sorted(tuple(x) for x in registry.QUERIES["STR-01-stream"](spark, str(tmp_path)).select("path", "settled_at", "kind").collect())
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", was)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(f"select path, settled_at, kind from ({registry.SQL['STR-01-stream']}) p").fetchall())
    assert len(want) > 1000 and len(got) == len(want)
    assert [(p, round(t, 3), k) for p, t, k in got] == [(p, round(t, 3), k) for p, t, k in want]
