"""File listings and what a scan makes of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumencat.sources import folders

AUDIO = ("wav", "mp3", "flac", "ogg", "aif", "aiff", "m4a", "wma", "opus", "aac", "caf")
IMAGE = ("png", "jpg", "jpeg", "webp")


def listing(spark: SparkSession, root: str, extensions: Sequence[str] | None = None, content: bool = False) -> DataFrame:
    """(path, size, modified[, content]) of files below a folder, by extension, without dot entries. Contents are read only if asked for.

    Folders of this machine's paths are listed by tasks, without links; other stores, and contents, by Spark's own reader.
    """
    if not content and folders.local_path(root) is not None:
        spark.dataSource.register(folders.FolderSource)
        f = spark.read.format("lumencat_folder").load(root).select("path", "size", F.timestamp_seconds("modified").alias("modified"))
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        f = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *["content"] * content).where(~F.col("path").rlike(r"/\.[^/]*(/|$)"))
    return f if extensions is None else f.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(extensions)))


def changed(found: DataFrame, snapshot: DataFrame, stat: Sequence[str] = ("size", "modified")) -> DataFrame:
    """Found files with ``changed``: new ones and those whose stat differs from the snapshot's (path and stat columns)."""
    s = snapshot.select("path", *[F.col(c).alias(f"_old_{c}") for c in stat], F.lit(True).alias("_known"))
    same = F.coalesce(F.col("_known"), F.lit(False))
    for c in stat:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return found.join(s, "path", "left").withColumn("changed", ~same).drop("_known", *[f"_old_{c}" for c in stat])


def trusted(stamps: DataFrame, recorded: DataFrame, keys: Sequence[str], checked_at: str, racy_seconds: int) -> DataFrame:
    """Stamps with ``trusted``: the same as recorded and last modified before the window in which a change may go unseen.

    Of a path recorded twice the record checked last counts.
    """
    last = recorded.groupBy("path").agg(F.max(F.struct(checked_at, *keys)).alias("_r"))
    same = F.coalesce(F.col("modified") + racy_seconds < F.col(f"_r.{checked_at}"), F.lit(False))
    for k in keys:
        same = same & F.coalesce(F.col(k) == F.col(f"_r.{k}"), F.lit(False))
    return stamps.join(last, "path", "left").withColumn("trusted", same).drop("_r")


def missing(rows: DataFrame, found: DataFrame, folder: str, epoch: int) -> DataFrame:
    """Rows under a folder that this epoch did not find. The folder is a literal prefix."""
    prefix = folder.rstrip("/") + "/"
    return rows.where(F.col("path").startswith(prefix)).join(found.where(F.col("epoch") == epoch).select("path"), "path", "left_anti")


def adopted(records: DataFrame, found: DataFrame) -> DataFrame:
    """(id, old_path, new_path): renames. A new path takes the record of the only one with its (volume, file, digest) whose old path is gone."""
    new = found.join(records.select("path"), "path", "left_anti").select("volume", "file", "digest", F.col("path").alias("new_path"))
    gone = records.join(found.select("path"), "path", "left_anti").select("id", F.col("path").alias("_gone"))
    one = records.groupBy("volume", "file", "digest").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("path").alias("old_path")).where("n = 1")
    taken = Window.partitionBy("id").orderBy("new_path")
    pairs = new.join(one, ["volume", "file", "digest"]).join(gone.select("id"), "id", "left_semi")
    return pairs.withColumn("_n", F.row_number().over(taken)).where("_n = 1").select("id", "old_path", "new_path")


def scan(spark: SparkSession, found: DataFrame, known: DataFrame, root: str) -> DataFrame:
    """(path, action, digest) of a listing against known files (path, size, modified, digest).

    reuse: same size and time, the digest is the known one; hash: new or changed, the digest is the SHA-1 of the content,
    which tasks read of these alone by their paths (in other stores than a file system Spark's reader reads all that is below root);
    missing: known but not listed.
    """
    k = known.dropDuplicates(["path"]).select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("digest").alias("_digest"))
    j = found.dropDuplicates(["path"]).withColumn("_there", F.lit(True)).join(k, "path", "full_outer")
    same = (F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified"))
    action = F.when(F.col("_there").isNull(), "missing").when(F.coalesce(same, F.lit(False)), "reuse").otherwise("hash")
    state = j.select("path", action.alias("action"), F.col("_digest").alias("digest"))
    asked = state.where("action = 'hash'").select("path")
    if folders.local_path(root) is not None:
        hashed = folders.read_paths(asked, digest=True).where("status = 'found'").select("path", "digest")
    else:
        hashed = listing(spark, root, content=True).join(asked, "path", "left_semi").select("path", F.sha1("content").alias("digest"))
    return state.where("action <> 'hash'").unionByName(hashed.withColumn("action", F.lit("hash")))


def stated(paths: DataFrame, catalogue: DataFrame) -> DataFrame:
    """A list of paths, each once, with its row of the catalogue (path, ...) and ``status``: found or absent."""
    return paths.select("path").distinct().join(catalogue.withColumn("_there", F.lit(True)), "path", "left").withColumn("status", F.when(F.col("_there"), "found").otherwise("absent")).drop("_there")


def discovered(entries: DataFrame, path: str, key: str, depth: int, most: int, epoch: int) -> DataFrame:
    """Entries down to a depth, the first ``most`` in order of depth and path, with the epoch and whether there are more."""
    within = entries.withColumn("depth", F.size(F.split(path, "/")).cast("long")).where(F.col("depth") <= depth)
    more = within.agg((F.count("*") > most).alias("truncated"))
    first = within.orderBy("depth", path, key).limit(most).withColumn("epoch", F.lit(epoch))
    return first.crossJoin(F.broadcast(more))  # one row beside each


def verified(stated: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Manifest rows (key, stated) with ``status`` by the recomputed digests (key, digest): verified, mismatch or missing."""
    why = F.when(F.col("digest").isNull(), "missing").when(F.col("digest") == F.col("stated"), "verified").otherwise("mismatch")
    return stated.join(actual.select(key, "digest"), key, "left").withColumn("status", why)


def members(found: DataFrame, recorded: DataFrame, stat: Sequence[str], analyzer: str, racy: int) -> DataFrame:
    """Found members with ``action`` and ``restored``, by what is recorded (path, stat columns, analyzer, checked, status).

    reuse: the stat is the recorded one, last changed before the window in which a change may go unseen, and the analyzer is
    current; then a member that was missing is available again (restored). rehash: recorded otherwise. new: not recorded.
    """
    r = recorded.select("path", *[F.col(c).alias(f"_r_{c}") for c in stat], F.col("analyzer").alias("_analyzer"), F.col("checked").alias("_checked"), F.col("status").alias("_status"), F.lit(True).alias("_known"))
    j = found.join(r, "path", "left")
    same = (F.col("_analyzer") == analyzer) & (F.col("modified") + racy < F.col("_checked"))
    for c in stat:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    reuse = F.coalesce(same, F.lit(False))
    action = F.when(F.col("_known").isNull(), "new").when(reuse, "reuse").otherwise("rehash")
    restored = F.coalesce(F.col("_known") & reuse & (F.col("_status") == "missing"), F.lit(False))
    return j.withColumn("action", action).withColumn("restored", restored).drop("_known", "_analyzer", "_checked", "_status", *[f"_r_{c}" for c in stat])


def backup_summary(original: dict[str, DataFrame], copy: dict[str, DataFrame], content: dict[str, Column]) -> DataFrame:
    """(relation, n, digest, intact) of a copy: rows, an order-free digest of their content, and whether the original has the same."""
    sums = lambda df, c: df.agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")).alias("digest"))
    out = None
    for name, df in copy.items():
        was = sums(original[name], content[name]).toDF("_n", "_digest")
        one = sums(df, content[name]).crossJoin(was)  # one row beside one
        one = one.select(F.lit(name).alias("relation"), "n", "digest", ((F.col("n") == F.col("_n")) & F.col("digest").eqNullSafe(F.col("_digest"))).alias("intact"))
        out = one if out is None else out.unionByName(one)
    return out


def summary(table: DataFrame, content: Column) -> dict:
    """Columns, rows and an order-free digest of a table: what a backup keeps beside the copy."""
    one = table.agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(F.md5(content), 1, 15), 16, 10).cast("long")).alias("digest")).first()
    return {"columns": table.columns, "n": one["n"], "digest": one["digest"]}


def restored(current: DataFrame, copy: DataFrame, kept: dict, content: Column) -> tuple[DataFrame, str]:
    """The table after a restore and its outcome: the copy if it is what its summary says, else the current table (refused)."""
    return (copy, "restored") if copy.columns == kept["columns"] and summary(copy, content) == kept else (current, "refused")


def title_of(path: Column) -> Column:
    from lumencat.functions.text import file_stem

    return file_stem(path)
