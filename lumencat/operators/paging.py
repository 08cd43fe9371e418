"""Scopes, pages, bounded walks and path sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_scope(df: DataFrame, column: str, requested: Sequence | None, allowed: Sequence | None) -> DataFrame:
    """Rows of the requested values that are allowed, before anything else is computed; None does not restrict."""
    scope = [v for v in requested if allowed is None or v in allowed] if requested is not None else allowed
    return df if scope is None else df.where(F.col(column).isin(list(scope)) if scope else F.lit(False))


def safe_path(c: Column) -> Column:
    """No parent step, backslash or colon."""
    return ~(F.contains(c, F.lit("..")) | F.contains(c, F.lit("\\")) | F.contains(c, F.lit(":")))


def numbered(df: DataFrame, order: list[Column], offset: int, limit: int, name: str = "ord") -> DataFrame:
    """A page with its rows' numbers in the whole order, from 0. Only the rows up to the page's end are brought together."""
    head = df.orderBy(*order).limit(offset + limit)
    return head.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1).where(F.col(name) >= offset)


def with_totals(page: DataFrame, totals: DataFrame) -> DataFrame:
    """A page beside one row of totals."""
    return page.join(F.broadcast(totals), how="inner")  # one row by construction


def after(df: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """The rows after a key, with one more that tells whether there is a next page."""
    return df.where(F.col(key) > cursor).orderBy(key).limit(limit + 1)


def within_bytes(df: DataFrame, order: list[Column], size: str, budget: int, limit: int) -> DataFrame:
    """The first rows in order, ``limit`` at most, whose sizes add up to no more than the budget."""
    total = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.orderBy(*order).limit(limit).withColumn("_total", total).where(F.col("_total") <= budget).drop("_total")


def walk(start: DataFrame, stops: DataFrame, parent: Callable[[Column], Column], depth: int) -> DataFrame:
    """(id, origin, depth): from each id to parents until a stop, zero or the depth is met. One join a step, on the step's key."""
    at = start.select("id", F.col("id").alias("origin"), F.lit(0).alias("depth"))
    marked = stops.withColumn("_halt", F.lit(True)).withColumnRenamed("stop", "origin")
    for _ in range(depth):
        step = at.join(marked, "origin", "left")
        go = F.col("_halt").isNull() & (F.col("origin") > 0)
        at = step.select("id", F.when(go, parent(F.col("origin"))).otherwise(F.col("origin")).cast("long").alias("origin"), (F.col("depth") + F.when(go, 1).otherwise(0)).alias("depth"))
    return at


def collapsed(paths: DataFrame) -> DataFrame:
    """Distinct paths without those below another one. Each path meets its own ancestors by equality, never by comparing all pairs."""
    p = paths.select("path").where("path is not null").distinct()
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = p.where(F.size(parts) > 1).select(F.col("path").alias("own"), F.explode(ancestors).alias("path"))
    below = above.join(p, "path", "left_semi").select(F.col("own").alias("path")).distinct()
    return p.join(below, "path", "left_anti")


def agent_filter(rows: DataFrame, text: str | None = None, untagged: bool | None = None, favorites: bool | None = None, formats: list[str] | None = None) -> DataFrame:
    """Rows (path, tags, favorite, lang) by a part of the path, whether they have tags, whether they are favourites, and formats; None does not filter."""
    if text is not None:
        rows = rows.where(F.contains(F.lower("path"), F.lit(text.lower())))
    if untagged is not None:
        rows = rows.where((F.size("tags") == 0) == F.lit(untagged))
    if favorites is not None:
        rows = rows.where(F.col("favorite") == F.lit(favorites))
    return rows if formats is None else rows.where(F.col("lang").isin(formats))
