"""Sound files of plain PCM as frames: (path, channel, frame, value)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAMES_PER_BATCH = 1 << 18


def wav(b: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and values (frame, channel) of a RIFF file of 16- or 24-bit whole or 32-bit floating samples."""
    if b[:4] != b"RIFF" or b[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form, rate, channels, bits = 12, 0, 0, 0, 0
    while at + 8 <= len(b):
        kind, size = b[at : at + 4], struct.unpack("<I", b[at + 4 : at + 8])[0]
        data = b[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack("<HHIIHH", data[:16])
        elif kind == b"data":
            frame = channels * bits // 8
            if not frame or len(data) % frame:
                raise ValueError("truncated PCM")
            if (form, bits) == (1, 16):
                x = np.frombuffer(data, "<i2").astype(np.float32) / 32768
            elif (form, bits) == (1, 24):
                low, middle, high = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32).T
                x = ((high << 24 | middle << 16 | low << 8) >> 8).astype(np.float32) / (1 << 23)
            elif (form, bits) == (3, 32):
                x = np.frombuffer(data, "<f4")
            else:
                raise ValueError("unsupported sample format")
            if not np.isfinite(x).all():
                raise ValueError("non-finite samples")
            return rate, x.reshape(-1, channels)
    raise ValueError("no samples")


def wav_bytes(values: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A RIFF file of 32-bit floating samples."""
    data = np.ascontiguousarray(values, "<f4").tobytes()
    head = struct.pack("<HHIIHH", 3, channels, rate, rate * channels * 4, channels * 4, 32)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data


def frames(files: DataFrame) -> DataFrame:
    """(path, rate, channel, frame, value, error) of files (path, content); a file leaves its task in bounded batches.

    A file that cannot be read is one row with its error and without a frame.
    """
    names = ["path", "rate", "channel", "frame", "value", "error"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    rate, x = wav(content.as_py() or b"")
                except (ValueError, struct.error) as e:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, None, None, None, None, str(e)), kinds, strict=True)], names)
                    continue
                n, channels = x.shape
                for lo in range(0, n, max(1, FRAMES_PER_BATCH // channels)):
                    part = x[lo : lo + max(1, FRAMES_PER_BATCH // channels)]
                    size = part.size
                    frame = np.repeat(np.arange(lo, lo + len(part)), channels)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * size), pa.array([rate] * size, pa.int32()), pa.array(np.tile(np.arange(channels, dtype=np.int32), len(part))), pa.array(frame), pa.array(part.reshape(-1).astype(np.float64)), pa.nulls(size, pa.string())], names)

    return files.select("path", "content").mapInArrow(run, "path string, rate int, channel int, frame long, value double, error string")


def profiles(samples: DataFrame) -> DataFrame:
    """(path, rate, channels, frames, duration, peak, rms) from frames."""
    p = samples.where("error is null").groupBy("path", "rate").agg(F.countDistinct("channel").alias("channels"), (F.max("frame") + 1).alias("frames"), F.max(F.abs("value")).alias("peak"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return p.withColumn("duration", F.col("frames") / F.col("rate"))
