"""Operator 1: media columns holding lossless WebP.

``store`` keeps each payload as one image in one RIFF file: a payload's bytes, padded with 0 to a positive multiple of
ROW_BYTES, are the red, green, blue and alpha samples of rows of 16 pixels. Payloads of over MOST_ROWS such rows (1 MB), the
most that the format's height allows, have rows of twice, three times, ... as many pixels, the last of which may end in
zeros that are not part of the payload; images end at 1 GB, where the format does. ``read_back`` decodes the files with the
operator's own decoder (prefix codes, back-references, colour cache, and the inverse of predictor, cross-colour,
subtract-green and palette transforms) and gives the payload and its pixels as an array.

The encoder takes the transform that saves most, which on text is rarely any. So that a stored column holds what other
encoders write too, one image in PLAN_EVERY, by the payload's checksum, is written under one of PLANS, with all modes of the
predictor in turn; its file is larger, its pixels are the same.

Scale: no shuffle. Both sides work on bounded runs of bytes within a task. The stored column is written as Parquet in the
shared folder.

Defined cases: null text is an empty payload, padded to one row of zeros; equal payloads have equal files and values;
a payload of over 1 GB is an error of its row's task; repeated rows repeat their result; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumencat.llm import webp
from lumencat.llm.common import pieces, stored, table, texts

ROW_PIXELS = 16
ROW_BYTES = 4 * ROW_PIXELS
MOST_ROWS = 1 << 14
PLAN_EVERY = 32
PLANS = (("predictor",), ("cross_colour",), ("subtract_green", "predictor"), ("predictor", "cross_colour"))
BATCH_BYTES = 5 << 20


def padded(payload: bytes) -> bytes:
    return payload + b"\0" * (-len(payload) % ROW_BYTES or (0 if payload else ROW_BYTES))


def image(payload: bytes) -> np.ndarray:
    """Rows of pixels; a pixel's samples in order are red, green, blue, alpha."""
    raw = padded(payload)
    rows = len(raw) // ROW_BYTES
    wide = -(-rows // MOST_ROWS)
    raw += b"\0" * (-rows % wide * ROW_BYTES)
    sample = np.frombuffer(raw, np.uint8).reshape(-1, 4).astype(np.uint32)
    return (sample[:, 3] << 24 | sample[:, 0] << 16 | sample[:, 1] << 8 | sample[:, 2]).reshape(-1, wide * ROW_PIXELS)


def pixels(im: np.ndarray, n_bytes: int) -> np.ndarray:
    """The pixels of the padded payload of so many bytes, without zeros that fill a long payload's last row."""
    return im.reshape(-1)[: max(1, -(-n_bytes // ROW_BYTES)) * ROW_PIXELS]


def samples(px: np.ndarray) -> bytes:
    """The bytes that pixels were made of."""
    return np.stack([px >> 16, px >> 8, px, px >> 24], axis=-1).astype(np.uint8).tobytes()


def write_media(payloads: list[bytes]) -> list[bytes]:
    """The WebP file of each payload; equal payloads have equal files."""
    sums = [zlib.crc32(p) for p in payloads]
    plans = [PLANS[c // PLAN_EVERY % len(PLANS)] if c % PLAN_EVERY == 0 else None for c in sums]
    return webp.encode([image(p) for p in payloads], plans, mode=[c // 256 % 14 for c in sums], mixed=True)


def feature(px: np.ndarray) -> str:
    """Size, mean of each channel, and a 64-bit hash: which of a row's 64 samples are above the mean on average."""
    raw = np.frombuffer(samples(px), np.uint8).reshape(-1, ROW_BYTES)
    means = raw.mean(axis=0)
    channel = means.reshape(-1, 4).mean(axis=0)
    bits = np.packbits(means > means.mean()).tobytes().hex()
    return f"{ROW_PIXELS}x{len(raw)}x4;mean={','.join(f'{m:.3f}' for m in channel)};ahash={bits}"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 of each text as lossless WebP."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(iter([whole]), BATCH_BYTES, "text"):
                payloads = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(p) for p in payloads], pa.int64()), pa.array(write_media(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs, key, text).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_SEEN = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pixels array<int>"


def read_back(kept: DataFrame) -> DataFrame:
    """Decodes a stored column: sizes, digests and feature of each row, with its pixels as an array (alpha, red, green, blue from the highest byte)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(iter([whole]), BATCH_BYTES // 2, "media"):
                media, sizes = b.column("media").to_pylist(), b.column("n_bytes").to_pylist()
                found = [pixels(im, n) for im, n in zip(webp.decode(media), sizes, strict=True)]
                payloads = [samples(px) for px in found]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                columns = [
                    b.column("doc_id"),
                    b.column("n_bytes"),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-ROW_BYTES:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array([feature(px) for px in found]),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SEEN.split(", ")])

    return kept.select("doc_id", "n_bytes", "media").mapInArrow(run, _SEEN)


def op1_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(stored(store(table(spark, sf_dir, "documents")), "media"))
