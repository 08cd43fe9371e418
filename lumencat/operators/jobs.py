"""Durable work as tables: a leased queue, resumable discovery, and budgeted enrichment. Each step gives the next table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumencat.operators.numbering import running_sum


def enqueued(jobs: DataFrame, requests: DataFrame, selection: Sequence[str]) -> DataFrame:
    """Jobs (id, source, state, at, lease_until, attempts, selection columns) and the new requests (id, source, at, selection columns).

    A request whose selection an active job has, or an earlier request, is left out.
    """
    active = jobs.where(F.col("state").isin("queued", "running")).select("source", *selection).distinct()
    first = requests.groupBy("source", *selection).agg(F.min(F.struct("at", "id")).alias("f"))
    new = first.select("f.id", "source", "f.at", *selection).join(active, ["source", *selection], "left_anti")
    rest = {"state": F.lit("queued"), "lease_until": F.lit(None).cast(jobs.schema["lease_until"].dataType), "attempts": F.lit(0).cast(jobs.schema["attempts"].dataType)}
    return jobs.unionByName(new.withColumns(rest).select(*jobs.columns))


def renewed(jobs: DataFrame, owners: DataFrame, now: Column, lease: Column) -> DataFrame:
    """Running jobs of the given owners (id, attempts) whose lease still holds get a new one; a stale owner, of an earlier attempt, gets none.

    An owner that asks twice renews once.
    """
    mine = owners.select("id", "attempts").distinct().withColumn("_mine", F.lit(True))
    j = jobs.join(mine, ["id", "attempts"], "left").select(*jobs.columns, "_mine")
    holds = F.coalesce((F.col("state") == "running") & F.col("_mine") & (F.col("lease_until") > now), F.lit(False))
    return j.withColumn("lease_until", F.when(holds, now + lease).otherwise(F.col("lease_until"))).drop("_mine")


def recovered(jobs: DataFrame, now: Column, most: int) -> DataFrame:
    """Running jobs whose lease has ended are queued again, or failed after ``most`` attempts."""
    over = (F.col("state") == "running") & F.coalesce(F.col("lease_until") <= now, F.lit(True))
    state = F.when(over & (F.col("attempts") >= most), "failed").when(over, "queued").otherwise(F.col("state"))
    return jobs.withColumns({"state": state, "lease_until": F.when(over, None).otherwise(F.col("lease_until"))})


def claimed(jobs: DataFrame, now: Column, lease: Column) -> DataFrame:
    """The oldest queued job of each source on which none runs becomes running, with a lease and one more attempt."""
    busy = jobs.where("state = 'running'").select("source").distinct()
    oldest = jobs.where("state = 'queued'").groupBy("source").agg(F.min(F.struct("at", "id")).alias("f")).join(busy, "source", "left_anti").select(F.col("f.id").alias("id"), F.lit(True).alias("_mine"))
    j = jobs.join(oldest, "id", "left")
    mine = F.coalesce("_mine", F.lit(False))
    return j.withColumns({"state": F.when(mine, "running").otherwise(F.col("state")), "lease_until": F.when(mine, now + lease).otherwise(F.col("lease_until")), "attempts": F.col("attempts") + F.when(mine, 1).otherwise(0)}).drop("_mine")


def resumed(entries: DataFrame, found: DataFrame, key: str, epoch: int, complete: bool) -> DataFrame:
    """(key, epoch, state) of entries (key, epoch) after an epoch's listing so far (key), however often it is run.

    Entries of this epoch are done, those found now are new or seen again; once the listing is complete the rest is missing.
    """
    j = entries.select(key, "epoch").join(found.select(key).distinct().withColumn("_found", F.lit(True)), key, "full_outer")
    state = F.when(F.col("epoch") == epoch, "done").when(F.col("_found") & F.col("epoch").isNull(), "new").when(F.col("_found"), "again").otherwise("missing" if complete else "open")
    return j.select(key, F.when(F.col("_found") | (F.col("epoch") == epoch), epoch).otherwise(F.col("epoch")).alias("epoch"), state.alias("state"))


def enriched(items: DataFrame, results: DataFrame, answers: DataFrame, ceiling: float) -> DataFrame:
    """(id, state) of waiting items (id, source, content, cost, revision) after one round.

    reused: a result (content) is there already. Otherwise costs are reserved by source, in order of id, up to the ceiling:
    the others are deferred. A reserved item with an answer (id, expected_revision, ok) is settled or unknown, or late if the
    item has another revision by now; without one it stays reserved.
    """
    known = results.select("content").distinct().withColumn("_known", F.lit(True))
    j = items.join(known, "content", "left")
    spent = running_sum(j.where("_known is null"), ["source"], ["id"], "cost", "_spent")
    a = answers.groupBy("id").agg(F.max(F.struct("expected_revision", "ok")).alias("a"))
    s = spent.join(a, "id", "left")
    state = F.when(F.col("_spent") > ceiling, "deferred").when(F.col("a").isNull(), "reserved").when(F.col("a.expected_revision") != F.col("revision"), "late").when(F.col("a.ok"), "settled").otherwise("unknown")
    return j.where("_known").select("id", F.lit("reused").alias("state")).unionByName(s.select("id", state.alias("state")))
