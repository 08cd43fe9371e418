"""An ordered log of actions on rows that carry a revision: compare and swap, one action after the other.

Of several actions of one key the first whose expectation holds applies, and the next ones meet the revision that it left.
Current rows and actions are sorted by key and order and walked by the tasks as a stream: a task holds the state of one key,
never its actions. A key's own actions are a chain in which each step needs the one before, so they are one task's stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from lumencat.operators.storage import stored

State = dict[str, Any]
#: Next state, or None for no change, and the outcome, which is ``applied`` where there is a next state.
Step = Callable[[State | None, dict[str, Any]], tuple[State | None, str]]


class Folded:
    """``states`` (key and state columns) of keys that were there or came to be; ``outcomes``: the actions with ``outcome`` and ``met``, the revision found."""

    def __init__(self, states: DataFrame, outcomes: DataFrame):
        self.states, self.outcomes = states, outcomes


def _ordered_column(name: str) -> str:
    return f"_o_{name}"


def folded(current: DataFrame, log: DataFrame, key: str, order: Sequence[str], step: Step, revision: str = "revision") -> Folded:
    """Walks ``log`` (key, order columns, what step reads) over ``current`` (key and state columns, revision among them).

    Equal order is broken by the row's hash, so that a repeated action follows itself and meets what it has left. A key given twice in
    ``current`` is taken with its greatest revision. Actions without a key are ``missing``.
    """
    fields = [c for c in current.columns if c != key]
    own = current.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(revision, F.xxhash64(*fields))).alias("_state"))
    acts = log.select(F.col(key).cast(current.schema[key].dataType).alias(key), F.struct(*log.columns).alias("_action"), *[F.col(o).alias(_ordered_column(o)) for o in order], F.xxhash64(*log.columns).alias("_tie"))
    both = own.unionByName(acts, allowMissingColumns=True).withColumn("_kind", F.col("_action").isNotNull())
    sort = [key, "_kind", *map(_ordered_column, order), "_tie"]
    walked = both.repartition(key).sortWithinPartitions(*sort).select(key, "_state", "_action")
    state_type, action_type = own.schema["_state"].dataType, acts.schema["_action"].dataType
    out = StructType([current.schema[key], StructField("_state", state_type), StructField("_action", action_type), StructField("outcome", StringType()), StructField("met", state_type[revision].dataType)])
    arrow = to_arrow_schema(out)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Any = None
        state: State | None = None
        for b in batches:
            rows: list[dict[str, Any]] = []
            for k, given, action in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if k != at:
                    if state is not None:
                        rows.append({key: at, "_state": state})
                    at, state = k, None
                if action is None:
                    state = given
                    continue
                met = None if state is None else state[revision]
                following, outcome = (None, "missing") if k is None else step(state, action)
                state = following if following is not None else state
                rows.append({key: k, "_action": action, "outcome": outcome, "met": met})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{key: at, "_state": state}], schema=arrow)

    done = stored(walked.mapInArrow(walk, out), "folded")
    states = done.where(F.col("_state").isNotNull()).select(key, *[F.col(f"_state.{c}").alias(c) for c in fields])
    return Folded(states.select(*current.columns), done.where(F.col("_action").isNotNull()).select("_action.*", "outcome", "met"))


def compare_and_swap(change: Callable[[State, dict[str, Any]], State | str], revision: str = "revision", expected: str = "expected") -> Step:
    """A step for rows that are there: a conflict unless the revision is the expected one, else change's state one revision on, or the reason it names."""

    def step(state: State | None, action: dict[str, Any]) -> tuple[State | None, str]:
        if state is None:
            return None, "missing"
        if action[expected] != state[revision]:
            return None, "conflict"
        new = change(state, action)
        return (None, new) if isinstance(new, str) else (new | {revision: state[revision] + 1}, "applied")

    return step
