"""Small files with generation metadata, for fixtures and round trips."""

from __future__ import annotations

import struct
import zlib

from lumencat.sources.images import PNG_SIGNATURE


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_with_text(text: str, key: str = "parameters") -> bytes:
    """A PNG file without pixels whose text chunk holds a settings text."""
    head = png_chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
    return PNG_SIGNATURE + head + png_chunk(b"tEXt", key.encode() + b"\0" + text.encode("latin-1", "replace")) + png_chunk(b"IEND", b"")


def webp_with_comment(text: str, software: str) -> bytes:
    """A WebP container whose EXIF block holds a tool's name and a user comment."""
    comment, tool = b"UNICODE\0" + text.encode("utf-16-le"), software.encode() + b"\0"
    first = struct.pack("<HHHII", 2, 0x0131, 2, len(tool), 56) + struct.pack("<HHIII", 0x8769, 4, 1, 38, 0)
    second = struct.pack("<HHHIII", 1, 0x9286, 7, len(comment), 56 + len(tool), 0)
    tiff = b"II*\0" + struct.pack("<I", 8) + first + second + tool + comment
    body = b"WEBPEXIF" + struct.pack("<I", len(tiff)) + tiff + b"\0" * (len(tiff) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def jpeg_with_xmp(kind: str, tool: str) -> bytes:
    """The head of a JPEG file with an XMP packet that names the source type and the tool."""
    packet = f'<rdf:Description xmp:CreatorTool="{tool}"><Iptc4xmpExt:DigitalSourceType>http://cv.iptc.org/newscodes/digitalsourcetype/{kind}</Iptc4xmpExt:DigitalSourceType></rdf:Description>'
    body = b"http://ns.adobe.com/xap/1.0/\0" + packet.encode()
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"
