"""Signals as rows (key columns, frame, value): levels, buckets, pyramids, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumencat.operators.numbering import numbered
from lumencat.operators.storage import stored


def numbered_frames(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows with ``frame``, their number from 0 within a key. Signals that come numbered do not need it."""
    return numbered(df, [key], order, "frame", 0)


def levels(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, peak, rms): the largest magnitude and the root of the mean square, combined map-side."""
    return df.groupBy(*keys).agg(F.max(F.abs(value)).alias("peak"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def buckets(frames: DataFrame, keys: Sequence[str], size: int | Column, value: str = "value") -> DataFrame:
    """(keys, bucket, low, high, rms) of runs of ``size`` frames; the last may be shorter."""
    at = F.floor(F.col("frame") / size).cast("long").alias("bucket")
    return frames.groupBy(*keys, at).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def overview(frames: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """(keys, bucket, low, high) with fewer than ``most`` full buckets: the size is the power of two that the number of frames asks for."""
    n = frames.groupBy(*keys).agg(F.count("*").alias("_n"))
    size = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2((F.col("_n") + 1) / F.lit(most)))))
    return buckets(frames.join(n, list(keys)), keys, size).drop("rms")


CACHE_VERSION = 1


def write_cache(frames: DataFrame, keys: Sequence[str], size: int, path: str) -> None:
    """A level of buckets as Parquet, with the version and each signal's number of frames."""
    b = buckets(frames, keys, size)
    n = frames.groupBy(*keys).agg((F.max("frame") + 1).alias("frames"))
    b.join(n, list(keys)).withColumn("version", F.lit(CACHE_VERSION)).write.parquet(path)


def sound_cache(held: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """The buckets of signals whose rows are all of this version and as many as their frames ask for."""
    whole = held.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("version").alias("_low"), F.max("version").alias("_high"), F.max("frames").alias("_frames"))
    good = whole.where((F.col("_low") == CACHE_VERSION) & (F.col("_high") == CACHE_VERSION) & (F.col("_n") == F.ceil(F.col("_frames") / size)))
    return held.join(good.select(*keys), list(keys), "left_semi")


def coarser(level: DataFrame, keys: Sequence[str], by: int = 4) -> DataFrame:
    """The next level. Root mean squares are averaged without weights, so a short last bucket counts fully."""
    at = F.floor(F.col("bucket") / by).cast("long").alias("bucket")
    return level.groupBy(*keys, at).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("rms"))


def pyramid(frames: DataFrame, keys: Sequence[str], base: int = 256, levels: int = 6, most: int = 65_536) -> DataFrame:
    """(level, keys, bucket, low, high, rms): each level from the one below, as long as a signal has more than four buckets there.

    A signal of over ``most`` buckets has its base doubled until it has no more. Frames are numbered from 0 without a gap, so the number of
    buckets of each level follows from theirs; each level is stored and read by the next one only.
    """
    n = frames.groupBy(*keys).agg((F.max("frame") + 1).alias("_n"))
    doubled = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.ceil(F.col("_n") / base) / F.lit(float(most))))))
    size = (F.lit(base) * doubled).cast("long")
    sized = n.select(*keys, size.alias("_size"), F.ceil(F.col("_n") / size).alias("_count"))
    at = F.floor(F.col("frame") / F.col("_size")).cast("long").alias("bucket")
    value = F.col("value")
    now = frames.join(sized, list(keys)).groupBy(*keys, "_count", at).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sqrt(F.avg(value * value)).alias("rms"))
    out = None
    for k in range(levels):
        if k:
            large = now.where(F.ceil(F.col("_count") / 4 ** (k - 1)) > 4)
            now = coarser(large, [*keys, "_count"])
        now = stored(now, "level")
        level = now.select(F.lit(k).alias("level"), *keys, "bucket", "low", "high", "rms")
        out = level if out is None else out.unionByName(level)
    return out


def window(levels_: DataFrame, keys: Sequence[str], first: int, last: int, points: int, base: int = 256, levels: int = 6, show: int | None = None) -> DataFrame:
    """(keys, level, point, low, high, rms): frames first to last of a pyramid, from the level that the points ask for, brought to ``show`` points."""
    level = level_for(last - first, points, base, levels)
    size = base * 4**level
    part = levels_.where((F.col("level") == level) & (F.col("bucket") >= first // size) & (F.col("bucket") < -(-last // size)))
    part = part.withColumn("bucket", F.col("bucket") - first // size).drop("level")
    return resampled(part, keys, show or points).withColumn("level", F.lit(level))


def level_for(span: int, points: int, base: int = 256, levels: int = 6) -> int:
    """The coarsest level whose buckets are no longer than a point of the window; points are kept within 32 and 4000."""
    wanted = span / min(max(points, 32), 4000)
    return max((k for k in range(levels) if base * 4**k <= wanted), default=0)


def resampled(slice_: DataFrame, keys: Sequence[str], points: int) -> DataFrame:
    """(keys, point, low, high, rms) of signals with more than ``points`` buckets, numbered from 0. A bucket at an edge counts on both sides."""
    n = slice_.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > points)
    s = slice_.join(n, list(keys))
    b, step = F.col("bucket"), F.col("_n") / F.lit(float(points))
    # the points i with floor(i * step) <= bucket < ceil((i + 1) * step)
    first = F.greatest(F.lit(0), F.floor(b / step).cast("int") - 1)
    last = F.least(F.lit(points - 1), F.floor((b + 1) / step).cast("int") + 1)
    i = F.col("point")
    each = s.withColumn("point", F.explode(F.sequence(first, last))).where((F.floor(i * F.col("_n") / F.lit(float(points))) <= b) & (b < F.ceil((i + 1) * F.col("_n") / F.lit(float(points)))))
    return each.groupBy(*keys, F.col("point").cast("long").alias("point")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("rms"))


def seconds(frame: Column, rate: Column) -> Column:
    return frame / rate


def valid_region(start: Column, end: Column, frames: Column) -> Column:
    """Not empty and within the signal."""
    return (start >= 0) & (start < end) & (end < frames)


def next_clips(clips: DataFrame, keys: Sequence[str], deleted: DataFrame, created: DataFrame, frames: int, rebind: tuple[int, int, int]) -> DataFrame:
    """Clips (keys, start_frame, end_frame, sound) after deletions, creations and a rebind, with ``clamped``.

    Created ones must be regions within ``frames``. rebind (sound, other, length) moves a sound's clips to another of that
    length: ends are clamped to it, and what then starts behind the end goes.
    """
    sound, other, length = rebind
    kept = clips.join(deleted.select(*keys).distinct(), list(keys), "left_anti")
    moved = F.col("sound") == sound
    kept = kept.where(~moved | (F.col("start_frame") < length))
    kept = kept.withColumn("clamped", moved & (F.col("end_frame") > length))
    kept = kept.withColumn("end_frame", F.when(moved, F.least("end_frame", F.lit(length).cast("long"))).otherwise(F.col("end_frame"))).withColumn("sound", F.when(moved, other).otherwise(F.col("sound")))
    new = created.where((F.col("start_frame") >= 0) & (F.col("start_frame") < F.col("end_frame")) & (F.col("end_frame") <= frames)).withColumn("clamped", F.lit(False))
    return kept.unionByName(new.select(*kept.columns))


def rendered(frames: DataFrame, keys: Sequence[str], start: int, end: int, gain: float, fade_in: int, fade_out: int, rate: tuple[int, int]) -> DataFrame:
    """(keys, frame, value, frames): frames start to end of each signal, at a gain, faded in and out, resampled from one rate to another.

    ``frames`` is the number that the rates ask for, rounded to the nearest; values between frames are interpolated, and
    behind the last one it is held.
    """
    n = frames.where(F.col("frame") < end).groupBy(*keys).agg((F.max("frame") + 1 - start).alias("_n")).where("_n > 0")
    at = F.col("frame") - start
    fade = F.least(F.lit(1.0), (at + 1) / F.lit(float(fade_in))) * F.least(F.lit(1.0), (F.col("_n") - at) / F.lit(float(fade_out)))
    cut = frames.where((F.col("frame") >= start) & (F.col("frame") < end)).join(n, list(keys)).select(*keys, at.alias("_at"), (F.col("value") * gain * fade).alias("_v"))
    a, b = rate
    count = F.call_function("div", F.col("_n") * b * 2 + a, F.lit(2 * a).cast("long"))
    out = n.select(*keys, "_n", count.alias("frames")).where("frames > 0").withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)))
    place = F.col("frame") * a / F.lit(float(b))
    out = out.withColumn("_low", F.least(F.floor(place), F.col("_n") - 1)).withColumn("_high", F.least(F.floor(place) + 1, F.col("_n") - 1)).withColumn("_share", place - F.floor(place))
    low = cut.select(*keys, F.col("_at").alias("_low"), F.col("_v").alias("_a"))
    high = cut.select(*keys, F.col("_at").alias("_high"), F.col("_v").alias("_b"))
    j = out.join(low, [*keys, "_low"]).join(high, [*keys, "_high"])
    return j.select(*keys, "frame", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).alias("value"), "frames")
