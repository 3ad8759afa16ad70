"""Small whole picture files, put together chunk by chunk."""

import struct
import zlib


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width, height, level=0, pieces=3):
    raw = zlib.compress(b"".join(b"\0" + bytes([(level + x + y) % 256 for x in range(width)]) for y in range(height)))
    cut = -(-len(raw) // pieces)
    body = b"".join(chunk(b"IDAT", raw[i : i + cut]) for i in range(0, len(raw), cut))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + body + chunk(b"IEND", b"")


def jpeg(width, height, fill=b""):
    segment = lambda mark, data: b"\xff" + bytes([mark]) + struct.pack(">H", len(data) + 2) + data
    frame = struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00"
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + fill + segment(0xDB, bytes(65)) + segment(0xC0, frame) + segment(0xC4, bytes(20)) + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + b"scan\xff\x00scan" + b"\xff\xd9"
