"""Arithmetic and classes of media metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumencat.operators.storage import stored


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def rescaled(frames: Column, source: int, target: int) -> Column:
    """Frames at another rate, rounded to the nearest: (n * target + source / 2) / source in whole numbers."""
    return _div(frames * target + source // 2, source)


def gcd(a: Column, b: Column, steps: int = 96) -> Column:
    """Greatest common divisor by Euclid's steps; 96 are enough for 64-bit numbers."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0).cast("long"))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["a"])


def fit_inside(width: Column, height: Column, box_height: int, most: int) -> Column:
    """The width that belongs to a box's height, to the nearest, from 1 to ``most``."""
    return F.least(F.lit(most).cast("long"), F.greatest(F.lit(1).cast("long"), _div(2 * box_height * width + height, 2 * height)))


# The class words and bounds of the profiles below.
def _silent(peak: Column, rms: Column) -> Column:
    return (peak < 0.0001) | (rms < 0.0001)


def texture(peak: Column, rms: Column, loud: float = 0.2) -> Column:
    return F.when(_silent(peak, rms), "silent").when(rms < 0.01, "quiet").when(rms > loud, "loud").otherwise("moderate level")


def envelope(peak: Column, rms: Column) -> Column:
    crest = peak / F.greatest(rms, F.lit(0.00001))
    return F.when(_silent(peak, rms), "uniform silent level").when(crest > 6, "pronounced peaks").otherwise("a relatively even level")


def duration_class(seconds: Column) -> Column:
    return F.when(seconds < 3, "short").when(seconds > 30, "long").otherwise("medium duration")


def layout_class(channels: Column) -> Column:
    return F.when(channels == 1, "mono").when(channels == 2, "stereo").when(channels == 6, "5.1 surround").when(channels == 8, "7.1 surround").otherwise("multichannel")


def evenly_spaced(df: DataFrame, key: str, most: int) -> DataFrame:
    """Every ceil(n / most)-th row in the key's order, with ``total``. Positions come from counts of key ranges, not from one sorted task."""
    ranged = df.repartitionByRange(key).sortWithinPartitions(key).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    ranged = stored(ranged, "ranges")
    local = ranged.withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = [(r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()]  # one row for each partition
    total = sum(n for _, n in sizes)
    if not total:
        return df.withColumn("total", F.lit(0).cast("long"))
    step, before, start = -(-total // most), 0, []
    for part, n in sizes:
        start += [F.lit(part), F.lit(before)]
        before += n
    place = F.element_at(F.create_map(*start), F.col("_part")) + F.col("_row")
    return local.where(place % step == 0).drop("_part", "_id", "_row").withColumn("total", F.lit(total).cast("long"))


def relink_counts(seen: DataFrame, recorded: str, now: str) -> DataFrame:
    """(total, sampled, matched, changed, unreadable) of a sample with ``total``: the content is the recorded one, another, or null."""
    r, n = F.col(recorded), F.col(now)
    return seen.agg(F.max("total").alias("total"), F.count("*").alias("sampled"), F.count_if(n == r).alias("matched"), F.count_if(n != r).alias("changed"), F.count_if(n.isNull()).alias("unreadable"))
