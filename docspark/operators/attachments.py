"""Anonymised attachments: pictures become blank ones of the same size, diagrams keep their shape, other files become stubs."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .anonymize import Anonymizer
from .dom import parse, serialize

STUB = b"anonymized"
IMAGES = (".png", ".jpg", ".jpeg", ".gif")


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + length
    return None


def blank_png(width: int, height: int) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    packer, line = zlib.compressobj(9), b"\x00" + b"\xdd" * width
    rows = b"".join([*(packer.compress(line) for _ in range(height)), packer.flush()])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def diagram(source: str, a: Anonymizer) -> str:
    """A diagram's XML with its labels scrubbed."""
    root = parse(source)
    for e in root.walk():
        for name in ("value", "label", "name", "tooltip"):
            if e.attrs.get(name):
                e.attrs[name] = re.sub(r">[^<]+<|^[^<]+$", lambda m: a.scrub(m.group()), e.attrs[name])
    return serialize(root)


def anonymized(name: str, data: bytes, a: Anonymizer) -> bytes:
    lower = name.lower()
    if lower.endswith(IMAGES) and (size := image_size(data)):
        return blank_png(max(size[0], 1), max(size[1], 1))
    if lower.endswith((".drawio", ".xml", ".svg")):
        return diagram(data.decode("utf-8", "replace"), a).encode()
    return STUB


def anonymize_attachments(df: DataFrame, name: str = "name", data: str = "bytes", key: str = "42") -> DataFrame:
    """``df`` with the names and bytes of attachments anonymised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Anonymizer(key)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                i, j = part.schema.names.index(name), part.schema.names.index(data)
                names, blobs = part.column(i).to_pylist(), part.column(j).to_pylist()
                made = [None if b is None else anonymized(n or "", b, a) for n, b in zip(names, blobs, strict=True)]
                part = part.set_column(j, part.schema.field(j), pa.array(made, type=part.schema.field(j).type))
                yield part.set_column(i, part.schema.field(i), pa.array([None if n is None else a.file_name(n) for n in names], type=part.schema.field(i).type))

    return df.mapInArrow(run, T.StructType(df.schema.fields))
