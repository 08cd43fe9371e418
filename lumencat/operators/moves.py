"""Moved files: missing and present assets with the same digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumencat.operators.numbering import numbered


def candidates(missing: DataFrame, present: DataFrame) -> DataFrame:
    """(id, digest, n, first): for each missing asset (id, digest) how many present ones (id, digest) hold its content, and the smallest.

    Present ones are counted by digest before they meet the missing ones: copies are never listed as pairs. Who the others
    are is a join of the digest with the present assets, which a reader of one asset asks for.
    """
    by_digest = present.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return missing.select("id", "digest").join(by_digest, "digest").select("id", "digest", "n", "first")


def reconciled(missing: DataFrame, present: DataFrame) -> DataFrame:
    """(missing, present): within a digest the missing and the present records (id, digest), each in order of id, one for one."""
    m = numbered(missing.select("id", "digest"), ["digest"], ["id"], "n").select(F.col("id").alias("missing"), "digest", "n")
    p = numbered(present.select("id", "digest"), ["digest"], ["id"], "n").select(F.col("id").alias("present"), "digest", "n")
    return m.join(p, ["digest", "n"]).select("missing", "present")


def without_source(records: DataFrame, removed: str, converted: str) -> DataFrame:
    """Records (id, digest, source) after one source is removed and another converted to a folder, with ``relinked``, n and state.

    A removed source's records are relinked to the smallest id of equal content elsewhere (n of them); without any they go.
    """
    at = F.col("source") == removed
    links = candidates(records.where(at), records.where(~at)).select("id", F.col("first").alias("relinked"), "n")
    j = records.join(links, "id", "left").where(~at | F.col("n").isNotNull())
    state = F.when(at, "removed").when(F.col("source") == converted, "folder").otherwise("linked")
    return j.withColumn("state", state).withColumn("n", F.coalesce("n", F.lit(0)))
