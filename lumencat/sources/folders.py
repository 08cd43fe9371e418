"""Folders as a data source: files below a root, listed by tasks, without dot entries and without following links.

    spark.dataSource.register(FolderSource)
    spark.read.format("lumencat_folder").option("depth", 8).load(root)      # (path, size, modified, depth)

The driver lists folders only, down to ``split`` levels; each is a partition, whose files its task lists. Files are read by
their paths in tasks too (``digests``), so no list of paths passes through the driver, however many there are. It is for folders
that every machine sees under one path; other stores are listed by Spark's own reader (``files.listing``).
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT, DEPTH = 2, 64
CHUNK = 1 << 20


def local_path(path: str) -> str | None:
    """The path on this machine that a path or a file address names; None for another store's."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        return None
    return path if not url.scheme else unquote(url.path)


class FolderPart(InputPartition):
    def __init__(self, folder: str, depth: int, below: bool):
        self.folder, self.depth, self.below = folder, depth, below  # below: with its folders


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """Entries of a folder in order of name, but for dot entries and links; a folder that is gone or closed has none."""
    try:
        with os.scandir(folder) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError:
        return
    yield from (e for e in entries if not e.name.startswith(".") and not e.is_symlink())


class FolderReader(DataSourceReader):
    def __init__(self, root: str, depth: int, split: int):
        self.root, self.depth, self.split = root, depth, min(split, depth)

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        level = [] if os.path.islink(self.root) else [self.root]
        for k in range(self.split):
            parts += [FolderPart(f, k + 1, False) for f in level]
            level = [e.path for f in level for e in _entries(f) if e.is_dir(follow_symlinks=False)]
        parts += [FolderPart(f, self.split + 1, True) for f in level if self.split < self.depth]
        return parts or [FolderPart(os.path.join(self.root, ".none"), 1, False)]

    def read(self, part: FolderPart) -> Iterator[tuple]:  # type: ignore[override]
        open_ = [(part.folder, part.depth)]
        while open_:
            folder, depth = open_.pop()
            for e in _entries(folder):
                if e.is_dir(follow_symlinks=False):
                    if part.below and depth < self.depth:
                        open_.append((e.path, depth + 1))
                elif e.is_file(follow_symlinks=False):
                    try:
                        s = e.stat(follow_symlinks=False)
                    except OSError:
                        continue
                    yield ("file:" + e.path, s.st_size, s.st_mtime, depth)


class FolderSource(DataSource):
    """Options: depth (a file in the root has 1), split."""

    @classmethod
    def name(cls) -> str:
        return "lumencat_folder"

    def schema(self) -> str:
        return "path string, size long, modified double, depth int"

    def reader(self, schema) -> DataSourceReader:
        root = local_path(self.options["path"])
        if root is None:
            raise ValueError("a folder on this store is listed by Spark's own reader")
        return FolderReader(os.path.abspath(root), int(self.options.get("depth", DEPTH)), int(self.options.get("split", SPLIT)))


def read_paths(paths: DataFrame, digest: bool = False) -> DataFrame:
    """(path, status, size, modified, digest) of stated files, each once: found, absent, link, hidden, or no_file. digest: the SHA-1 of what is found.

    A file is read in pieces by the task that has its path.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_seen(p, digest) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.string())))], ["path", "status", "size", "modified", "digest"])

    stated = paths.select(F.col("path").cast("string").alias("path")).where("path is not null").distinct()
    return stated.mapInArrow(look, "path string, status string, size long, modified double, digest string")


def _seen(path: str, digest: bool) -> tuple:
    local = local_path(path)
    try:
        s = os.lstat(local)  # type: ignore[arg-type]
        if any(part.startswith(".") and part not in (".", "..") for part in local.split("/")):  # type: ignore[union-attr]
            return "hidden", None, None, None
        if stat.S_ISLNK(s.st_mode):
            return "link", None, None, None
        if not stat.S_ISREG(s.st_mode):
            return "no_file", None, None, None
        sha = hashlib.sha1()
        if digest:
            with open(local, "rb") as f:  # type: ignore[arg-type]
                while piece := f.read(CHUNK):
                    sha.update(piece)
        return "found", s.st_size, s.st_mtime, sha.hexdigest() if digest else None
    except (OSError, TypeError, ValueError):
        return "absent", None, None, None
