"""The corpus pipeline: language identification, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. A
stage's result is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencat.llm import language_id, line_dedup, near_dedup, packing
from lumencat.llm.common import scratch, table

#: Similarity of five-word shingles from which on documents are near-duplicates here.
NEAR_PER_CENT = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or text, and those that read like none of the languages."""
    samples = language_id.training_samples(docs)
    found = language_id.identify(docs, samples, carry=COLUMNS)
    most = F.lit(language_id.REJECT_RATE)
    for lang, rate in language_id.reject_rates(samples).items():
        most = F.when(F.col("lang_pred") == lang, rate).otherwise(most)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("phrase_rate") <= most)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component."""
    gone = near_dedup.near_duplicates(docs, NEAR_PER_CENT).where("not kept").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeats out of the texts; a document of which nothing but white space is left goes."""
    cut = line_dedup.dedup_units(docs, carry=["lang", "source", "n_chars"])
    text = F.col("text")
    size = F.when(F.size("removed") > 0, F.length(text)).otherwise(F.col("n_chars"))
    return cut.where((F.size("removed") == 0) | text.rlike(r"\S")).select("doc_id", "text", "lang", "source", size.cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the workers hold what the stages before have left: smaller batches than by default, and no words kept between them
    return packing.pack(docs, batch_bytes=12 << 20, kept_units=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: No SQL: cross-parsing, hashing of shingles and the packing's dynamic programming are not expressible in it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
