"""Mutations as functions of current rows and changes: upserts, fenced and revision-checked updates, undo, retention.

Each gives the next state or the outcome of each change; writing the result is one atomic table write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumencat.operators.actions import Folded, State, compare_and_swap, folded
from lumencat.operators.storage import stored


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Current rows with the ``update`` columns of the incoming row of the same keys, and the new rows. Other columns are kept.

    Of incoming rows with the same keys the greatest in the ``update`` columns, in their order, counts: a row stays one row.
    """
    one = incoming.groupBy(*keys).agg(F.max(F.struct(*update)).alias("_new"))
    inc = one.select(*keys, *[F.col(f"_new.{c}").alias(f"_new_{c}") for c in update], F.lit(True).alias("_there"))
    both = current.withColumn("_was", F.lit(True)).join(inc, list(keys), "full_outer")
    take = lambda c: F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[take(c) if c in update else F.col(c) for c in current.columns])


def fenced(current: DataFrame, changes: DataFrame, key: str, fence: Sequence[str]) -> DataFrame:
    """The changes whose expected values (``expected_<column>``) are still current; the others are late and left out."""
    now = current.select(key, *[F.col(c).alias(f"_now_{c}") for c in fence])
    same = F.lit(True)
    for c in fence:
        same = same & F.col(f"expected_{c}").eqNullSafe(F.col(f"_now_{c}"))
    return changes.join(now, key).where(same).drop(*[f"_now_{c}" for c in fence])


def outcomes(current: DataFrame, changes: DataFrame, key: str, revision: str, changed: Column, denied: Column | None = None) -> DataFrame:
    """changes with ``outcome``: missing, denied, conflict (of the expected revision), unchanged or applied, the first that holds."""
    j = changes.join(current.withColumn("_there", F.lit(True)), key, "left")
    why = F.when(F.col("_there").isNull(), "missing")
    if denied is not None:
        why = why.when(denied, "denied")
    why = why.when(~F.col(f"expected_{revision}").eqNullSafe(F.col(revision)), "conflict").when(~changed, "unchanged").otherwise("applied")
    return j.withColumn("outcome", why).drop("_there")


def limited(outcomes: DataFrame, over: Column) -> DataFrame:
    """Outcomes in which applied changes that would go over a limit are ``limit``."""
    return outcomes.withColumn("outcome", F.when((F.col("outcome") == "applied") & over, "limit").otherwise(F.col("outcome")))


def updated(current: DataFrame, outcomes: DataFrame, key: str, revision: str, values: dict[str, str]) -> DataFrame:
    """The next rows (relation ``row``): applied changes set each column of ``values`` from the named one and raise the revision."""
    new = outcomes.where("outcome = 'applied'").groupBy(key).agg(F.max(F.struct(*values.values())).alias("_new"))
    j = current.join(new, key, "left")
    there = F.col("_new").isNotNull()
    out = j.withColumns({c: F.when(there, F.col(f"_new.{n}")).otherwise(F.col(c)) for c, n in values.items()} | {revision: F.col(revision) + F.when(there, 1).otherwise(0)})
    return out.withColumn("relation", F.lit("row")).select("relation", *current.columns)


def history(current: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """What the applied changes replace (relation ``history``): the row as it was, with its revision."""
    return current.join(outcomes.where("outcome = 'applied'").select(key).distinct(), key, "left_semi").withColumn("relation", F.lit("history")).select("relation", *current.columns)


def patched(current: DataFrame, patch: dict[str, Column]) -> DataFrame:
    """Rows with the patch's columns set, and ``inverse``, the patch that takes it back.

    Each column of a patch is null (leave) or struct<value>, whose value may be null (clear).
    """
    given = current.withColumns({f"_p_{c}": p for c, p in patch.items()})
    inverse = F.struct(*[F.when(F.col(f"_p_{c}").isNotNull(), F.struct(F.col(c).alias("value"))).alias(c) for c in patch])
    out = given.withColumn("inverse", inverse)
    return out.withColumns({c: F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}.value")).otherwise(F.col(c)) for c in patch}).drop(*[f"_p_{c}" for c in patch])


def saved(current: DataFrame, incoming: DataFrame, key: str, value: str, most: int = 256) -> DataFrame:
    """(key, value, outcome) of saved rows and requests (key, value, replace): kept, replaced, exists, created, or full beyond ``most``."""
    asked = incoming.groupBy(key).agg(F.max(F.struct("replace", value)).alias("_in"))
    j = current.withColumn("_was", F.lit(True)).join(asked, key, "full_outer")
    old = j.where("_was").withColumn("outcome", F.when(F.col("_in.replace"), "replaced").when(F.col("_in").isNotNull(), "exists").otherwise("kept"))
    old = old.select(key, F.when(F.col("outcome") == "replaced", F.col(f"_in.{value}")).otherwise(F.col(value)).alias(value), "outcome")
    # the room left is at most ``most`` rows: a top-k, not a window over all requests
    new = j.where("_was is null").select(key, F.col(f"_in.{value}").alias(value))
    room = max(0, most - current.count())
    taken = new.orderBy(key).limit(room)
    rest = new.join(taken.select(key), key, "left_anti")
    return old.unionByName(taken.withColumn("outcome", F.lit("created"))).unionByName(rest.select(key, F.lit(None).cast(current.schema[value].dataType).alias(value), F.lit("full").alias("outcome")))


def fenced_folders(staged: DataFrame, current: DataFrame, folder: str, revision: str = "revision", expected: str = "expected") -> DataFrame:
    """(folder, revision, committed) of the staged folders (folder, expected): a commit holds if the expected revision is the current one, 0 for a folder that is not there.

    A folder staged twice with different expectations holds where one of them does.
    """
    now = current.groupBy(folder).agg(F.max(revision).alias("_now"))
    j = staged.select(folder, expected).distinct().join(now, folder, "left")
    holds = F.col(expected) == F.coalesce("_now", F.lit(0))
    return j.groupBy(folder).agg(F.coalesce(F.max("_now"), F.lit(0)).alias(revision), F.bool_or(holds).alias("committed"))


def publish(staged: DataFrame, path: str, folder: str, order: str, revision: str = "revision", expected: str = "expected", salt: int = 16) -> DataFrame:
    """Writes whole snapshots of folders (folder, expected, entries) into the table at ``path``; gives (folder, revision, committed).

    The table is partitioned by folder and only the folders whose fence holds are overwritten, by Spark's dynamic partition overwrite:
    new folders appear, others stay as they are, and a stale writer changes nothing. A folder's rows are dealt out by ``order``,
    so a large folder is written by several tasks. Give it to ``foreachBatch`` for a stream of snapshots.
    """
    spark = staged.sparkSession
    rows = stored(staged, "staged")
    fence = stored(fenced_folders(rows, table_at(spark, path, rows.drop(expected), folder, revision), folder, revision, expected), "fence")
    new = rows.join(fence.where("committed").select(folder, F.col(revision).alias("_now")), folder).withColumn(revision, F.col("_now") + 1).drop("_now", expected)
    if new.head(1):
        spread = new.repartition(folder, F.pmod(F.xxhash64(order), F.lit(salt)))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder).parquet(path)
    return fence


def table_at(spark: SparkSession, path: str, like: DataFrame, folder: str, revision: str) -> DataFrame:
    """The published table, with the columns of ``like`` and the revision; empty before anything is published."""
    fields = [f for f in like.schema.fields if f.name not in (folder, revision)]
    schema = StructType([*fields, StructField(revision, LongType()), like.schema[folder]])
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def patched_tags(tags: Column, add: Column, remove: Column) -> Column:
    """Tags without the removed and with the added ones, each once by its lower-case key, first spelling kept."""
    low = lambda a: F.transform(a, F.lower)
    kept = F.filter(tags, lambda t: ~F.array_contains(low(remove), F.lower(t)))
    return F.concat(kept, F.filter(F.array_distinct(add), lambda t: ~F.array_contains(low(kept), F.lower(t))))


def undo(current: DataFrame, entries: DataFrame, key: str, revision: str, values: Sequence[str], order: Sequence[str] = ("at",)) -> Folded:
    """Reverses log entries (key, after, ``before_<value>`` of each value, order) whose row still has the revision that their action left.

    Entries of one row are taken in their order: the first that fits reverses its action and raises the revision, so that another
    entry for the same revision is a conflict. A value that an entry leaves out (a struct column that is null) stays.
    """

    def change(row: State, entry: dict) -> State:
        return row | {v: entry[f"before_{v}"]["value"] for v in values if entry[f"before_{v}"] is not None}

    return folded(current, entries, key, order, compare_and_swap(change, revision, "after"), revision)


def mark_missing(rows: DataFrame, seen: DataFrame, keys: Sequence[str], status: str, complete: bool = True) -> DataFrame:
    """Rows that a complete scan has not seen become missing; an incomplete one marks nothing."""
    if not complete:
        return rows
    s = seen.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return rows.join(s, list(keys), "left").withColumn(status, F.when(F.col("_seen"), F.col(status)).otherwise("missing")).drop("_seen")


def retained(log: DataFrame, order: list[Column], keep: int, partition: Sequence[str] = ()) -> DataFrame:
    """The newest ``keep`` rows, of each partition if one is named. Spark limits rows before they meet."""
    if not partition:
        return log.orderBy(*order).limit(keep)
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def idempotent(requests: DataFrame, keys: Sequence[str], arguments: str, order: str) -> DataFrame:
    """Requests with ``outcome``: the first of a key is created, equal later ones are replayed, different ones are errors."""
    first = requests.groupBy(*keys).agg(F.min(F.struct(order, arguments)).alias("_first"))
    j = requests.join(first, list(keys))
    why = F.when(F.col(order) == F.col(f"_first.{order}"), "created").when(F.col(arguments).eqNullSafe(F.col(f"_first.{arguments}")), "replayed").otherwise("conflict")
    return j.withColumn("outcome", why).drop("_first")


def change_counts(changes: DataFrame, by: str) -> DataFrame:
    """(by, n): how many changes each source has pending."""
    return changes.groupBy(by).agg(F.count("*").alias("n"))
