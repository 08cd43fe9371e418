"""Headers of still images, from their bytes: PNG, JPEG and WebP. Pixels are not decoded here."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

HEADER = StructType([StructField("format", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("alpha", BooleanType()), StructField("orientation", IntegerType()), StructField("profile", BooleanType()), StructField("error", StringType())])

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _jpeg(b: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 < len(b):
        if b[at] != 0xFF:
            raise ValueError("no marker")
        kind = b[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        size = struct.unpack(">H", b[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h
        at += 2 + size
    raise ValueError("no frame header")


def _webp(b: bytes) -> tuple[int, int, bool]:
    kind = b[12:16]
    if kind == b"VP8X":
        w, h = int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
        return w, h, bool(b[20] & 0x10)
    if kind == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, bool(bits >> 28 & 1)
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", b[26:30])
        return w & 0x3FFF, h & 0x3FFF, False
    raise ValueError("unknown WebP chunk")


def _blocks(b: bytes) -> tuple[bytes | None, bool]:
    """The EXIF block, and whether there is a colour profile, among the chunks or markers before and after the image data."""
    exif, profile = None, False
    if b.startswith(PNG_SIGNATURE):
        at = 8
        while at + 12 <= len(b):
            size = int.from_bytes(b[at : at + 4], "big")
            exif = b[at + 8 : at + 8 + size] if b[at + 4 : at + 8] == b"eXIf" else exif
            profile = profile or b[at + 4 : at + 8] == b"iCCP"
            at += 12 + size
    elif b.startswith(b"\xff\xd8"):
        at = 2
        while at + 4 <= len(b) and b[at] == 0xFF and b[at + 1] != 0xDA:
            body = b[at + 4 : at + 2 + int.from_bytes(b[at + 2 : at + 4], "big")]
            exif = body[6:] if b[at + 1] == 0xE1 and body.startswith(b"Exif\0\0") else exif
            profile = profile or b[at + 1] == 0xE2 and body.startswith(b"ICC_PROFILE\0")
            at += 4 + len(body)
    else:
        at = 12
        while at + 8 <= len(b):
            size = int.from_bytes(b[at + 4 : at + 8], "little")
            exif = b[at + 8 : at + 8 + size] if b[at : at + 4] == b"EXIF" else exif
            profile = profile or b[at : at + 4] == b"ICCP"
            at += 8 + size + size % 2
    return exif, profile


def orientation(exif: bytes | None) -> int:
    """How an image is to be turned, 1 to 8; 1, upright, where nothing valid is said."""
    order = {b"II": "<", b"MM": ">"}.get((exif or b"")[:2])
    if exif is None or order is None:
        return 1
    try:
        (start,) = struct.unpack_from(order + "I", exif, 4)
        (n,) = struct.unpack_from(order + "H", exif, start)
        for k in range(min(n, 512)):
            tag, kind, _, value = struct.unpack_from(order + "HHIH", exif, start + 2 + 12 * k)
            if (tag, kind) == (0x0112, 3) and 1 <= value <= 8:
                return value
    except struct.error:
        pass
    return 1


def header(b: bytes | None) -> dict:
    """Format, size as shown (turned by the EXIF orientation), alpha channel, colour profile; ``error`` for bytes that are none of the three."""
    none = dict.fromkeys(HEADER.names)
    if b is None:
        return none
    try:
        if b.startswith(PNG_SIGNATURE):
            if b[12:16] != b"IHDR":
                raise ValueError("no IHDR")
            w, h = struct.unpack(">II", b[16:24])
            out = {"format": "png", "width": w, "height": h, "alpha": b[25] in (4, 6)}
        elif b.startswith(b"\xff\xd8"):
            w, h = _jpeg(b)
            out = {"format": "jpeg", "width": w, "height": h, "alpha": False}
        elif b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            w, h, a = _webp(b)
            out = {"format": "webp", "width": w, "height": h, "alpha": a}
        else:
            raise ValueError("unknown format")
        if not (0 < out["width"] <= 65_535 and 0 < out["height"] <= 65_535):
            raise ValueError("size out of bounds")
        exif, profile = _blocks(b)
        turn = orientation(exif)
        if turn >= 5:  # a quarter turn
            out |= {"width": out["height"], "height": out["width"]}
        return none | out | {"orientation": turn, "profile": profile}
    except (ValueError, struct.error, IndexError) as e:
        return none | {"error": str(e) or "truncated"}


@F.pandas_udf(HEADER)
def image_header(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header(None if b is None else bytes(b)) for b in content], columns=HEADER.names).astype({"width": "Int32", "height": "Int32", "orientation": "Int32"})
