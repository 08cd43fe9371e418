"""A stored index that changes: segments that are written once, and manifests that say which of them count.

    manifest/number=N/   one row: the live segments in order (path, documents, batch, written), the stamp of what was indexed
    <segment>/postings, vocabulary   as in ``postings``; a vocabulary holds differences
    <segment>/forward    id, word, field, positions (how many), in ranges of id
    <segment>/documents  id, digest of the document's tokens; null: the document is gone

A document is what the last segment that names it says. A change writes one segment with the changed documents and a new
manifest; nothing is rewritten. What the changed documents had before is found in the forward tables by their ids, so the
vocabulary's differences cost what the change does. Any session opens an index by its last manifest. Beyond MOST_SEGMENTS
segments are merged into one, and segments that neither of the last two manifests names are deleted. A merged segment says of
how many written ones it is made, so that the number of changes outlives the merges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencat.operators.postings import Index, posted, write_postings
from lumencat.operators.storage import scratch, shared_root, stored

MOST_SEGMENTS = 16
FORMAT = 1
_MANIFEST = "segments array<struct<path string, documents long, batch string, written long>>, stamp string"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _last_number(spark: SparkSession, root: str) -> int:
    """The number of the last manifest that was written whole; 0 without one."""
    place, fs = _file_system(spark, f"{root}/manifest")
    if not fs.exists(place):
        return 0
    done = [p.getPath().getName() for p in fs.listStatus(place) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))]
    return max((int(n.removeprefix("number=")) for n in done if n.startswith("number=")), default=0)


class SegmentedIndex(Index):
    """The index at ``root`` as its last manifest has it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, root
        self.number = _last_number(spark, root)
        if not self.number:
            raise ValueError(f"no index at {root}")
        row = spark.read.schema(_MANIFEST).json(f"{root}/manifest/number={self.number}").first()
        self.segments, self.stamp = [s.asDict() for s in row["segments"]], row["stamp"]
        self.postings = self._live("postings")
        deltas = self._all("vocabulary").groupBy("word", "field").agg(F.sum("documents").alias("documents"), F.sum("positions").alias("positions"))
        self.vocabulary = self._all("vocabulary") if len(self.segments) == 1 else deltas.where("documents > 0")

    def _all(self, table: str) -> DataFrame:
        read = lambda k, s: self.spark.read.parquet(f"{s['path']}/{table}").withColumn("_segment", F.lit(k))
        return reduce(DataFrame.unionByName, [read(k, s) for k, s in enumerate(self.segments)])

    def _live(self, table: str) -> DataFrame:
        """Rows of documents in the last segment that names them; conditions on words still reach every segment's scan."""
        rows = self._all(table)
        if len(self.segments) == 1:
            return rows.drop("_segment")
        last = self._all("documents").where("_segment > 0").groupBy("id").agg(F.max("_segment").alias("_last"))
        return rows.join(last, "id", "left").where(F.col("_last").isNull() | (F.col("_last") == F.col("_segment"))).drop("_segment", "_last")

    @property
    def written(self) -> int:
        """How many segments were written for what is there, those that were merged since included."""
        return sum(s["written"] or 1 for s in self.segments)  # null: an older manifest

    def documents(self) -> DataFrame:
        """(id, digest) of the documents that are there."""
        return self._live("documents").where("digest is not null")


def _publish(spark: SparkSession, root: str, number: int, segments: list[dict], stamp: str) -> SegmentedIndex:
    row = spark.createDataFrame([([(s["path"], s["documents"], s["batch"], s["written"]) for s in segments], stamp)], _MANIFEST)
    row.coalesce(1).write.json(f"{root}/manifest/number={number}")  # fails if another writer has published this number
    return SegmentedIndex(spark, root)


def _write_segment(spark: SparkSession, root: str, rows: DataFrame, documents: DataFrame, before: DataFrame | None) -> dict:
    """A segment of posting rows (word, field, id, positions) and documents (id, digest); ``before``: forward rows that they replace."""
    path = f"{root}/segments/{hashlib.sha1(scratch(spark, 'segment').encode()).hexdigest()[:16]}"
    rows = stored(rows, "postings")
    write_postings(rows, path)
    rows.select("id", "word", "field", F.size("positions").cast("long").alias("positions")).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/forward")
    back = spark.read.parquet(f"{path}/forward")
    documents.write.parquet(f"{path}/documents")
    deltas = back.select("word", "field", F.lit(1).alias("_d"), "positions")
    if before is not None:
        deltas = deltas.unionByName(before.select("word", "field", F.lit(-1).alias("_d"), (-F.col("positions")).alias("positions")))
    deltas.groupBy("word", "field").agg(F.sum("_d").cast("long").alias("documents"), F.sum("positions").alias("positions")).write.parquet(f"{path}/vocabulary")
    return {"path": path, "documents": spark.read.parquet(f"{path}/documents").count(), "batch": None, "written": 1}


def _digests(tokens: DataFrame, fields: Sequence[str]) -> DataFrame:
    return tokens.select("id", F.xxhash64(*fields).alias("digest"))


def build(tokens: DataFrame, fields: Sequence[str], root: str, stamp: str = "") -> SegmentedIndex:
    """A new index of documents (id, and an array of tokens for each field), as one segment."""
    spark, tokens = tokens.sparkSession, stored(tokens.select("id", *fields), "tokens")
    segment = _write_segment(spark, root, posted(tokens, fields), _digests(tokens, fields), None)
    return _publish(spark, root, _last_number(spark, root) + 1, [segment], stamp)


def branch(index: SegmentedIndex, root: str) -> SegmentedIndex:
    """An index at another root that begins with the same segments."""
    return _publish(index.spark, root, 1, index.segments, index.stamp)


def refresh(index: SegmentedIndex, changed: DataFrame, tokens: DataFrame, fields: Sequence[str], batch: str | None = None, stamp: str | None = None) -> SegmentedIndex:
    """The index after changes of documents (id): those with a row in ``tokens`` are as it says, the others are gone.

    A batch that a live segment already names is not applied again, so that a repeated ``foreachBatch`` does no harm.
    """
    spark, stamp = index.spark, index.stamp if stamp is None else stamp
    if batch is not None and any(s["batch"] == batch for s in index.segments):
        return index
    ids = changed.select("id").where("id is not null").distinct()
    new = stored(tokens.select("id", *fields).join(ids, "id", "left_semi"), "tokens")
    documents = ids.join(_digests(new, fields), "id", "left").select("id", "digest")
    before = index._live("forward").join(ids, "id", "left_semi")
    segment = _write_segment(spark, index.path, posted(new, fields), documents, before) | {"batch": batch}
    after = _publish(spark, index.path, index.number + 1, [*index.segments, segment], stamp)
    return compact(after) if len(after.segments) > MOST_SEGMENTS else after


def compact(index: SegmentedIndex) -> SegmentedIndex:
    """One segment of what is live, which remembers the last batch and how many were merged; segments that are named no more are deleted."""
    spark = index.spark
    segment = _write_segment(spark, index.path, index.postings.select("word", "field", "id", "positions"), index.documents(), None) | {"batch": index.segments[-1]["batch"], "written": index.written}
    after = _publish(spark, index.path, index.number + 1, [segment], index.stamp)
    vacuum(after)
    return after


def vacuum(index: SegmentedIndex) -> None:
    """Deletes the segments below the index's root that neither of its last two manifests names."""
    spark = index.spark
    numbers = [n for n in (index.number, index.number - 1) if n > 0]
    rows = spark.read.schema(_MANIFEST).json([f"{index.path}/manifest/number={n}" for n in numbers])
    named = {r["path"].rsplit("/", 1)[-1] for r in rows.select(F.explode("segments.path").alias("path")).toLocalIterator()}
    place, fs = _file_system(spark, f"{index.path}/segments")
    for p in fs.listStatus(place):
        if p.getPath().getName() not in named:
            fs.delete(p.getPath(), True)


def follow(queue: DataFrame, root: str, make: Callable[[DataFrame], DataFrame], fields: Sequence[str], state: str) -> None:
    """Applies a stream of changed ids (id) to the index at root until it is used up: each micro-batch is one segment.

    ``make`` gives the tokens (id, fields) of the batch's documents as they are now. The batch's number and the stream's own
    checkpoint make each batch count once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        ids = batch.select("id").distinct()
        refresh(SegmentedIndex(batch.sparkSession, root), ids, make(ids), fields, f"{state}#{number}")

    run = queue.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()


_open: dict[tuple[str, str], SegmentedIndex] = {}


def index_of(spark: SparkSession, name: str, table: str, make: Callable[[], DataFrame], fields: Sequence[str]) -> SegmentedIndex:
    """The index of a table's files below spark.checkpoint.dir: opened where it is, else built; changed documents become a segment.

    It is found by the table's path and the fields, by any session. Where a file of the table has changed since, the digests of the
    documents' tokens tell which of them have.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(table).select("path", "length", "modificationTime")
    stamp = str(tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()))
    root = f"{shared_root(spark)}/lumencat-index/{name}-{hashlib.sha1(repr((table, tuple(fields), FORMAT)).encode()).hexdigest()[:12]}"
    key = (spark.sparkContext.applicationId, root)
    if key in _open and _open[key].stamp == stamp:
        return _open[key]
    if not _last_number(spark, root):
        _open[key] = build(make(), fields, root, stamp)
        return _open[key]
    index = SegmentedIndex(spark, root)
    if index.stamp != stamp:
        tokens = stored(make().select("id", *fields), "tokens")
        now = _digests(tokens, fields)
        was = index.documents().select("id", F.col("digest").alias("_was"))
        changed = now.join(was, "id", "full_outer").where(~F.col("digest").eqNullSafe(F.col("_was"))).select("id")
        index = refresh(index, changed, tokens, fields, stamp=stamp)
    _open[key] = index
    return index
