"""Watched folders: which changes are worth a look, when they have settled, and when everything must be looked at anew.

A source's rows, in the order of their time, are events of paths, stats of paths, and losses:

    event    something happened to a path: it is pending, and quiet counts from now
    stat     what stands at a path from now on: ``observed`` is file, folder, absent or ignored, with size and modified
    lost     events went missing: nothing that is pending counts any more, everything is to be refreshed
    refused  what was given out could not be taken (a path, or null for a refresh): it waits anew

A path that was quiet for QUIET_SECONDS is looked at, and again every STABLE_SECONDS until two looks see the same stat: then
it settles, as what the stat says (file, folder or removed; what is ignored settles silently). An event in between starts
anew. A source with MOST_PENDING paths pending and one more gives them all up for one refresh, which comes when its events
have been quiet. A path without a stat is absent.

Both forms walk a source's rows in order and hold MOST_PENDING paths at most: ``planned`` over tables, sorted by Spark and
streamed through the tasks, and ``WatchProcessor`` as a stateful processor with event-time timers, for streams.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

QUIET_SECONDS = 0.75
STABLE_SECONDS = 1.0
MOST_PENDING = 4096

def admitted(events: DataFrame, path: str, ignored: str = r"(^|/)(\.[^/]*|~[^/]*|[^/]*\.(tmp|part|crdownload))$") -> DataFrame:
    """Events of paths that are neither temporary nor the application's own."""
    return events.where(~F.col(path).rlike(ignored))


#: The state store that stateful processors need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLANNED = "source string, at double, kind string, path string, events int"
_KIND = {"file": "file", "folder": "folder", "absent": "removed"}
_INPUT = ["at", "what", "path", "observed", "size", "modified"]
_CHUNK = 4096  # rows in one value of the state


class Planner:
    """What one source has pending. Times are seconds. Emissions are (at, kind, path, events)."""

    def __init__(self, quiet: float, stable: float, most: int):
        self.quiet, self.stable, self.most = quiet, stable, most
        self.pending: dict[str, list] = {}  # path: next look, what the last look saw (None: none), events, the look that counts in looks
        self.looks: list[tuple[float, str]] = []  # a heap of looks and paths, no later than the paths' next ones
        self.stats: dict[str, tuple] = {}  # of pending paths and of those yet to come: what stands there now
        self.over: float | None = None  # the last event since paths were given up

    def due(self) -> float | None:
        """When something is to be done next."""
        if self.over is not None:
            return self.over + self.quiet
        while self.looks:
            at, path = self.looks[0]
            entry = self.pending.get(path)
            if entry is None or entry[3] != at:
                heappop(self.looks)
            elif entry[0] != at:
                entry[3] = entry[0]
                heapreplace(self.looks, (entry[0], path))
            else:
                return at
        return None

    def until(self, now: float) -> list[tuple]:
        """What comes to pass before ``now``."""
        out = []
        while (at := self.due()) is not None and at < now:
            if self.over is not None:
                self.over = None
                out.append((at, "refresh", None, 0))
                continue
            path = self.looks[0][1]
            entry = self.pending[path]
            seen = self.stats.get(path, ("absent", None, None))
            if entry[1] != seen:
                entry[0], entry[1] = at + self.stable, seen
                continue
            del self.pending[path]
            if seen[0] in _KIND:
                out.append((at, _KIND[seen[0]], path, entry[2]))
        return out

    def _give_up(self, at: float) -> None:
        self.pending.clear()
        self.looks.clear()
        self.over = at

    def take(self, at: float, what: str, path: str | None, stat: tuple) -> None:
        if what == "stat" and path is not None:
            self.stats[path] = stat
            if stat[0] == "absent":
                del self.stats[path]
        elif what == "lost" or what == "refused" and path is None:
            self._give_up(at)
        elif what in ("event", "refused") and path is not None:
            if self.over is not None:
                self.over = max(at, self.over)
            elif path not in self.pending and len(self.pending) >= self.most:
                self._give_up(at)
            else:
                look = at + self.quiet
                _, _, events, counts = self.pending.get(path, (0, None, 0, None))
                if counts is None or look < counts:  # else the heap has an earlier look, which is put off when it comes
                    heappush(self.looks, (look, path))
                    counts = look
                self.pending[path] = [look, None, events + 1, counts]

    def step(self, at: float, what: str, path: str | None, *stat: Any) -> list[tuple]:
        done = self.until(at)
        self.take(at, what, path, stat)
        return done

    def saved(self) -> str:
        return json.dumps([{k: v[:3] for k, v in self.pending.items()}, self.stats, self.over])

    @classmethod
    def restored(cls, text: str, *limits) -> Planner:
        p = cls(*limits)
        pending, stats, p.over = json.loads(text)
        p.stats = {k: tuple(v) for k, v in stats.items()}
        p.pending = {k: [v[0], None if v[1] is None else tuple(v[1]), v[2], v[0]] for k, v in pending.items()}
        p.looks = [(v[0], k) for k, v in pending.items()]
        heapify(p.looks)
        return p


def _rows(log: DataFrame, *more: str) -> DataFrame:
    """log with all columns of the input; what is not there is null."""
    types = {"at": "double", "size": "long", "modified": "double"}
    column = lambda c: (F.col(c) if c in log.columns else F.lit(None)).cast(types.get(c, "string")).alias(c)
    return log.select(F.col("source").cast("string").alias("source"), *map(column, _INPUT), *more).where("source is not null and at is not null")


#: Of rows at the same time stats come first, as a look at that time sees them; then events by path.
def _order() -> list[Column | str]:
    return ["source", "at", F.col("what") != "stat", "what", "path", "observed", "size", "modified"]


def planned(log: DataFrame, quiet: float = QUIET_SECONDS, stable: float = STABLE_SECONDS, most: int = MOST_PENDING) -> DataFrame:
    """(source, at, kind, path, events) of a whole log (source, at, what, path, observed, size, modified): file, folder, removed and refresh.

    What is pending at the log's end settles by its last stats. Ties are taken by kind and path, so that partitions do not matter.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: str | None = None
        planner = Planner(quiet, stable, most)
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            column = lambda i, t: pa.array([r[i] for r in out], t)
            b = pa.RecordBatch.from_arrays([column(0, pa.string()), column(1, pa.float64()), column(2, pa.string()), column(3, pa.string()), column(4, pa.int32())], ["source", "at", "kind", "path", "events"])
            out.clear()
            return b

        for b in batches:
            for row in b.to_pylist():
                if row["source"] != at:
                    out += [(at, *e) for e in planner.until(float("inf"))] if at is not None else []
                    at, planner = row["source"], Planner(quiet, stable, most)
                out += [(at, *e) for e in planner.step(*(row[c] for c in _INPUT))]
            if out:
                yield told()
        if at is not None:
            out += [(at, *e) for e in planner.until(float("inf"))]
            yield told()

    return _rows(log).repartition("source").sortWithinPartitions(*_order()).mapInArrow(walk, PLANNED)


class WatchProcessor(StatefulProcessor):
    """The planner of a source as state; rows wait until the watermark has passed them, and a timer stands at what is due next."""

    def __init__(self, quiet: float = QUIET_SECONDS, stable: float = STABLE_SECONDS, most: int = MOST_PENDING):
        self.limits = (quiet, stable, most)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("planner", "text string")
        self.waiting = handle.getListState("waiting", "rows string")  # each value holds many rows: a state's row costs more than its contents

    def _forward(self, key: Any, mark: float, arrived: list[list]) -> Iterator[pd.DataFrame]:
        """Takes what waits at or before the watermark, and sets the next timer."""
        planner = Planner.restored(self.state.get()[0], *self.limits) if self.state.exists() else Planner(*self.limits)
        rows = [r for text, in self.waiting.get() for r in json.loads(text)] if self.waiting.exists() else []
        rows += arrived
        text = lambda v: "" if v is None else str(v)
        due = sorted((r for r in rows if r[0] <= mark), key=lambda r: (r[0], r[1] != "stat", r[1], text(r[2]), text(r[3]), r[4] or 0, r[5] or 0))
        later = [r for r in rows if r[0] > mark]
        out = [e for r in due for e in planner.step(*r)]
        out += planner.until(mark)
        self.waiting.clear()
        if later:
            self.waiting.put([(json.dumps(later[k : k + _CHUNK]),) for k in range(0, len(later), _CHUNK)])
        self.state.update((planner.saved(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [t for t in (planner.due(), min((r[0] for r in later), default=None)) if t is not None]
        if times:
            self.handle.registerTimer(int(max(min(times), mark) * 1000) + 1)
        if out:
            source = [str(key[0])] * len(out)
            yield pd.DataFrame({"source": source, "at": [e[0] for e in out], "kind": [e[1] for e in out], "path": [e[2] for e in out], "events": pd.array([e[3] for e in out], "int32")})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived: list[list] = []
        for part in rows:
            columns = [[None if v is None or v != v else v for v in part[c].tolist()] for c in _INPUT]
            columns[4] = [None if v is None else int(v) for v in columns[4]]  # a column with nulls comes as floats
            arrived += map(list, zip(*columns, strict=True))
        yield from self._forward(key, timerValues.getCurrentWatermarkInMs() / 1000, arrived)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._forward(key, timerValues.getCurrentWatermarkInMs() / 1000, [])

    def close(self) -> None:
        pass


def watch_stream(log: DataFrame, time: str, delay: str, quiet: float = QUIET_SECONDS, stable: float = STABLE_SECONDS, most: int = MOST_PENDING) -> DataFrame:
    """The same of a stream whose column ``time`` is the rows' timestamp; ``events`` and ``stats`` are one stream (unionByName).

    Rows later than ``delay`` behind the newest are dropped; what is due after the last watermark stays in the state. Needs the RocksDB state store.
    """
    grouped = _rows(log.withWatermark(time, delay).withColumn("at", F.col(time).cast("double")), time).groupBy("source")
    return grouped.transformWithStateInPandas(WatchProcessor(quiet, stable, most), PLANNED, "append", "eventTime")
