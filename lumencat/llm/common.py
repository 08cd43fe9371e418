"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and the master is local (tests, one machine) a temporary folder is set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumencat-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lumencat-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Key and text only: other columns, whatever their names, never meet the operator's own."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *more)


def pieces(batches: Iterator[pa.RecordBatch], limit_bytes: int, column: str) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one piece holds about limit_bytes of the named string or binary column (a single row may be larger)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(column)
        if b.num_rows == 1 or col.nbytes <= limit_bytes:
            yield b
            continue
        sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
        part = sizes.cumsum() // limit_bytes
        start = 0
        cuts = (part[1:] != part[:-1]).nonzero()[0] + 1
        for cut in [*cuts.tolist(), b.num_rows]:
            if cut > start:
                yield b.slice(start, cut - start)
            start = cut


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of an edge table (a long, b long): every node of an edge with the smallest node it reaches.

    Alternating large-star and small-star steps: each joins the edges with the smallest neighbour of a node, which an
    aggregate with map-side combining finds, so that no neighbour list is ever gathered. Steps follow until the edges stay
    as they are, about the square of the logarithm of a component's length. Edges with equal or null ends are left out. Returns (node long, component long), one row per node; an empty table gives an empty table.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = stored(e, name)
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low2, "a")
        small = hung.select("a", F.col("m").alias("b")).unionByName(hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        e = stored(small, name)
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def single_threaded() -> None:
    """One task, one core: libraries with thread pools of their own keep to it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
