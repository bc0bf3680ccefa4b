"""Image sizes from the leading bytes of PNG, JPEG and WebP files.

A reader is asked for a range of bytes at a time, so a file costs one small read, and a JPEG one more per segment that
stands before its frame header (embedded profiles and previews are stepped over, not read).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa

# ---- Fixed values: file formats ---------------------------------------------
PNG_START = b"\x89PNG\r\n\x1a\n"
JPEG_START = b"\xff\xd8"
# Start-of-frame markers; 0xC4, 0xC8 and 0xCC of that range mean other things.
JPEG_FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
JPEG_ALONE = {0x01, *range(0xD0, 0xD9)}  # markers without a segment
JPEG_SCAN, JPEG_END = 0xDA, 0xD9
# -----------------------------------------------------------------------------

HEAD = 64
Read = Callable[[int, int], bytes]  # offset, length


def _png(head: bytes) -> tuple[int, int] | None:
    return struct.unpack(">II", head[16:24]) if len(head) >= 24 and head[12:16] == b"IHDR" else None


def _webp(head: bytes) -> tuple[int, int] | None:
    kind = head[12:16]
    if kind == b"VP8X" and len(head) >= 30:
        return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
    if kind == b"VP8 " and len(head) >= 30 and head[23:26] == b"\x9d\x01\x2a":
        wide, high = struct.unpack("<HH", head[26:30])
        return wide & 0x3FFF, high & 0x3FFF
    if kind == b"VP8L" and len(head) >= 25 and head[20] == 0x2F:
        bits = int.from_bytes(head[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return None


def _jpeg(read: Read) -> tuple[int, int] | None:
    """Segments one after another until the frame header; none after the scan begins."""
    at = 2
    while True:
        part = read(at, 9)
        if len(part) < 2 or part[0] != 0xFF:
            return None
        marker = part[1]
        if marker == 0xFF:  # fill byte
            at += 1
        elif marker in JPEG_ALONE:
            at += 2
        elif marker in (JPEG_SCAN, JPEG_END) or len(part) < 4:
            return None
        elif marker in JPEG_FRAMES:
            return struct.unpack(">HH", part[5:9])[::-1] if len(part) == 9 else None
        else:
            at += 2 + max(2, struct.unpack(">H", part[2:4])[0])


def size_of(read: Read) -> tuple[int, int] | None:
    """(width, height), or None for other formats and broken files."""
    head = read(0, HEAD)
    if head.startswith(PNG_START):
        size = _png(head)
    elif head.startswith(JPEG_START):
        size = _jpeg(lambda at, n: head[at : at + n] if at + n <= len(head) else read(at, n))
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        size = _webp(head)
    else:
        size = None
    return size if size and min(size) > 0 and max(size) < 1 << 31 else None


def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, width, height) for batches of file paths; a file that cannot be opened has null sizes."""
    from pyarrow import fs

    for batch in batches:
        paths = batch.column(0).to_pylist()
        found = []
        for path in paths:
            try:
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as f:
                    end = f.size()
                    found.append(size_of(lambda at, n: f.read_at(max(0, min(n, end - at)), at) if at < end else b""))
            except (OSError, ValueError):
                found.append(None)
        width, height = ([s[k] if s else None for s in found] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(width, pa.int32()), pa.array(height, pa.int32())], names=["path", "width", "height"])
