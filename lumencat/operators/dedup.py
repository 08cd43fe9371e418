"""Exact-duplicate stacks and the decisions about them."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumencat.operators.actions import State, folded
from lumencat.operators.storage import stored

SEPARATED, REVIEWED = "separated", "reviewed"


def stacks(assets: DataFrame, digest: str, shown: Column, reviewed: Column) -> DataFrame:
    """(digest, n, shown, reviewed) of digests with several copies; single ones are dropped before any join."""
    return assets.groupBy(digest).agg(F.count("*").alias("n"), F.count_if(shown).alias("shown"), F.count_if(reviewed).alias("reviewed")).where("n > 1")


class Decisions(NamedTuple):
    """groups (digest, preferred, dismissed, revision), marks (digest, asset, mark) and the log's outcomes."""

    groups: DataFrame
    marks: DataFrame
    outcomes: DataFrame


def _decision(state: State | None, action: dict[str, Any]) -> tuple[State | None, str]:
    """One action on a stack; ``apart`` and ``seen`` are the copies separated, and rejoined since the stack was dismissed."""
    now = state or {"preferred": None, "dismissed": False, "revision": 0, "apart": [], "seen": [], "anew": False}
    does, asset = action["action"], action["asset"]
    if action["expected"] != now["revision"]:
        return None, "conflict"
    if not action["_stack"] or does in ("prefer", "separate", "rejoin") and not action["_member"]:
        return None, "missing"
    is_apart = asset in now["apart"]
    if does in ("prefer", "separate") and is_apart or does == "rejoin" and not is_apart:
        return None, "invalid"
    new = dict(now, revision=now["revision"] + 1)
    if does == "prefer":
        new["preferred"] = asset
    elif does == "clear":
        new["preferred"] = None
    elif does == "separate":
        new["apart"] = [*now["apart"], asset]
        new["seen"] = [a for a in now["seen"] if a != asset]
        if now["preferred"] == asset:
            new["preferred"] = None
    elif does == "rejoin":
        new["apart"] = [a for a in now["apart"] if a != asset]
        if now["dismissed"]:  # rejoining is a review: it brings no dismissed stack back
            new["seen"] = [*now["seen"], asset]
    elif does in ("dismiss", "restore"):
        new |= {"dismissed": does == "dismiss", "seen": [], "anew": True}
    else:
        return None, "invalid"
    return new, "applied"


def decide(groups: DataFrame, marks: DataFrame, log: DataFrame, members: DataFrame) -> Decisions:
    """The decisions after a log of actions (digest, at, expected, action, asset) on the stacks of members (digest, asset).

    Actions: prefer, clear, separate, rejoin, dismiss, restore. One applies if its expected revision is the stack's (0 for
    a stack without decisions), its stack has two copies and its copy is one of them: else it is a conflict or missing. A
    separated copy is neither preferred nor separated again, and no other rejoins: else invalid. Dismissing marks every copy
    that is not separated as reviewed; restoring takes these marks away. Marks whose copy is no longer in its stack go,
    and so does a preference for one.
    """
    copies = members.select("digest", "asset").where("digest is not null and asset is not null").distinct()
    apart = marks.where(F.col("mark") == SEPARATED).groupBy("digest").agg(F.collect_set("asset").alias("apart"))
    none = F.array().cast(apart.schema["apart"].dataType)
    state = groups.select("digest", "preferred", F.coalesce("dismissed", F.lit(False)).alias("dismissed"), F.col("revision").cast("long").alias("revision")).join(apart, "digest", "left")
    state = state.select("digest", "preferred", "dismissed", "revision", F.coalesce("apart", none).alias("apart"), none.alias("seen"), F.lit(False).alias("anew"))
    size = copies.groupBy("digest").agg(F.count("*").alias("_n")).where("_n > 1").select("digest", F.lit(True).alias("_stack"))
    asked = log.join(size, "digest", "left").join(copies.withColumn("_member", F.lit(True)), ["digest", "asset"], "left").na.fill(False, ["_stack", "_member"])
    done = folded(state, asked, "digest", ["at"], _decision)
    after = done.states

    now = copies.join(after, "digest")
    is_apart = F.array_contains("apart", F.col("asset"))
    was = marks.where(F.col("mark") == REVIEWED).select("digest", "asset", F.lit(True).alias("_was")).distinct()
    reviewed = F.col("dismissed") & (F.col("anew") | F.array_contains("seen", F.col("asset")) | F.coalesce("_was", F.lit(False)))
    mark = F.when(is_apart, SEPARATED).when(reviewed, REVIEWED)
    marked = now.join(was, ["digest", "asset"], "left").select("digest", "asset", mark.alias("mark")).where("mark is not null")
    kept = without_stale(after.select("digest", "preferred", "dismissed", "revision"), copies, "asset")
    return Decisions(kept, stored(marked, "marks"), done.outcomes.drop("_stack", "_member"))


def without_stale(groups: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """Decisions whose preferred copy is no longer there, with the digest, prefer none."""
    there = assets.select("digest", F.col(key).alias("preferred"), F.lit(True).alias("_there")).distinct()
    return groups.join(there, ["digest", "preferred"], "left").withColumn("preferred", F.when(F.col("_there"), F.col("preferred"))).select(*groups.columns)
