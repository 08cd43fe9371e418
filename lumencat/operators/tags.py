"""Tag identity, aliases and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_facet(rows: DataFrame, state: str, top: int = 50) -> DataFrame:
    """(state, tag, n) of tag rows (id, key, tag, state): most frequent first, ties by key."""
    counts = rows.where(F.col("state") == state).groupBy("key").agg(F.min("tag").alias("tag"), F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "key").limit(top).select(F.lit(state).alias("state"), "tag", "n")


def vocabulary(rows: DataFrame, tag: str, top: int = 1000) -> DataFrame:
    """(tag, n, truncated) of the most frequent tags: those that differ in case only are one, spelt as the smallest of them; truncated: there are more than ``top``."""
    counts = rows.groupBy(F.lower(tag).alias("key")).agg(F.min(tag).alias("tag"), F.count("*").alias("n"))
    more = rows.agg((F.countDistinct(F.lower(tag)) > top).alias("truncated"))
    return counts.orderBy(F.desc("n"), "key").limit(top).select("tag", "n").join(F.broadcast(more))  # one row beside each


def renamed(tags: Column, old: str, new: str) -> Column:
    """An array of tags in which the old one, in any case, is the new one; a tag that then repeats goes, the first stays."""
    swapped = F.transform(tags, lambda t: F.when(F.lower(t) == old.lower(), F.lit(new)).otherwise(t))
    return F.aggregate(swapped, F.array().cast("array<string>"), lambda acc, t: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t))))


def with_alias(aliases: DataFrame, old: str, new: str) -> DataFrame:
    """Aliases (alias_key, canonical) with old to new added and those that pointed at old repointed: there are no chains."""
    kept = aliases.where(F.col("alias_key") != new.lower()).withColumn("canonical", F.when(F.lower("canonical") == old.lower(), new).otherwise(F.col("canonical")))
    one = aliases.sparkSession.createDataFrame([(old.lower(), new)], "alias_key string, canonical string")
    return kept.where(F.col("alias_key") != old.lower()).unionByName(one)


def resolved(rows: DataFrame, aliases: DataFrame, tag: str) -> DataFrame:
    """Rows whose tag is its canonical form where an alias exists."""
    a = aliases.select(F.col("alias_key").alias("_key"), "canonical")
    return rows.join(a, F.lower(F.col(tag)) == F.col("_key"), "left").withColumn(tag, F.coalesce("canonical", tag)).drop("_key", "canonical")
