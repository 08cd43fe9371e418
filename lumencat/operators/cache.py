"""Results kept between pages, and the change counters that say whether they still hold.

Every mutation appends to a table of counters (scope, n); a counter is the sum of its rows, so writers need no lock. A kept
result is found by its query, the scopes that it reads and their counters: after a change in one of them the next page is made
anew, whichever session has written. Results lie in the shared folder, in their order and with their places, so a page is read by its
places, and any session serves it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencat.operators.numbering import numbered
from lumencat.operators.storage import shared_root

_COUNTERS = "scope string, n long"


class ChangeCounters:
    """The counters of a catalogue, in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/counters"

    def _there(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def changed(self, scopes: DataFrame) -> None:
        """Counts one change of each scope (scope) of a mutation's rows; appended in the batch of the mutation."""
        rows = scopes.select(F.col("scope").cast("string").alias("scope")).where("scope is not null").distinct().withColumn("n", F.lit(1).cast("long"))
        rows.coalesce(1).write.mode("append").parquet(self.path)

    def values(self, scopes: Sequence[str]) -> tuple[tuple[str, int], ...]:
        """The counters of stated scopes, in order; 0 where nothing has changed yet."""
        found: dict[str, int] = {}
        if self._there():
            rows = self.spark.read.schema(_COUNTERS).parquet(self.path).where(F.col("scope").isin(list(scopes)))
            found = {r["scope"]: r["n"] for r in rows.groupBy("scope").agg(F.sum("n").alias("n")).toLocalIterator()}
        return tuple((s, found.get(s, 0)) for s in sorted(set(scopes)))


class ResultCache:
    """Ordered results by query, scopes and change counters; the last ``size`` are kept."""

    def __init__(self, spark: SparkSession, root: str | None = None, size: int = 4):
        self.spark, self.size = spark, size
        self.root = root or f"{shared_root(spark)}/lumencat-results"
        self.counters = ChangeCounters(spark, self.root)

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/results")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def get(self, query: Any, scopes: Sequence[str], order: Sequence[Column | str], make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """The result with ``place`` from 0, and whether it was kept. The counters are read before it is made, so that a change meanwhile makes it stale."""
        key = hashlib.sha1(repr((query, self.counters.values(scopes))).encode()).hexdigest()
        path = f"{self.root}/results/{key}"
        place, fs = self._files()
        if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            return self.spark.read.parquet(path), True
        numbered(make(), [], order, "place", 0).repartitionByRange("place").sortWithinPartitions("place").write.mode("overwrite").parquet(path)
        found = sorted(fs.listStatus(place), key=lambda f: f.getModificationTime())
        for old in found[: max(0, len(found) - self.size)]:
            if old.getPath().getName() != key:
                fs.delete(old.getPath(), True)
        return self.spark.read.parquet(path), False

    @staticmethod
    def page(result: DataFrame, offset: int, limit: int) -> DataFrame:
        return result.where((F.col("place") >= offset) & (F.col("place") < offset + limit))
