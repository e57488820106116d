"""Editable diagrams: a picture that carries the diagram's source, put together from a page's attachments.

For a diagram X up to five attachments matter, which are joined by name and ranked: a picture that is ready (``X.drawio.png`` or ``.svg``) is taken as it is; else the source in ``X`` goes into
the picture ``X.png`` or ``X.svg``; else an attachment that carries a source already gets the name that says so. Where none of this is there, the diagram has no file.

A PNG is read and written chunk by chunk: its source is a text chunk behind the header, in place of any that it had. An SVG has it in an attribute of its root.

Defined results: of attachments with one name the least bytes count; null bytes are no attachment; broken pictures carry nothing and take no source; repeated rows are one diagram; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The signature of a PNG, the keyword of the chunk, the marks of a diagram's source, and the endings of what a diagram X may be in.
PNG = b"\x89PNG\r\n\x1a\n"
KEYWORD = b"mxfile"
MARKS = (b"<mxfile", b"mxGraphModel")
ENDINGS = (".drawio.png", ".drawio.svg", "", ".png", ".svg")
TEXT_CHUNKS = (b"tEXt", b"zTXt", b"iTXt")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]] | None:
    """(kind, body) of a PNG's chunks; None where the bytes are no whole PNG."""
    if not data.startswith(PNG):
        return None
    at, out = len(PNG), []
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            return None
        out.append((kind, body))
        at += 12 + size
        if kind == b"IEND":
            return iter(out)
    return None


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def is_source(kind: bytes, body: bytes) -> bool:
    return kind in TEXT_CHUNKS and body.partition(b"\0")[0] == KEYWORD


def in_png(picture: bytes, source: str) -> bytes | None:
    found = chunks(picture)
    if found is None:
        return None
    kept = [chunk(k, b) for k, b in found if not is_source(k, b)]
    text = KEYWORD + b"\0" + quote(source, safe="-_.*").encode()
    return PNG + b"".join([*kept[:1], chunk(b"tEXt", text), *kept[1:]])


def in_svg(picture: bytes, source: str) -> bytes | None:
    text = picture.decode("utf-8", "replace")
    root = re.search(r"(?i)<svg\b[^>]*?(?=/?>)", text)
    if root is None:
        return None
    opened = re.sub(r'(?i)\s+content\s*=\s*"[^"]*"', "", root.group()).rstrip()
    value = html.escape(source, quote=False).replace('"', "&quot;")
    return (text[: root.start()] + f'{opened} content="{value}"' + text[root.end() :]).encode()


def carries(data: bytes | None) -> str | None:
    """The ending of a picture that holds its diagram's source."""
    if not data:
        return None
    if data.startswith(PNG):
        return ".drawio.png" if any(is_source(*c) for c in chunks(data) or ()) else None
    return ".drawio.svg" if b"<svg" in data and b"content=" in data and any(m.strip(b"<") in data for m in MARKS) else None


def assemble(name: str, found: list[bytes | None]) -> tuple[str, bytes] | None:
    """The file of diagram ``name`` from what there is of ENDINGS, in their order."""
    for ending, data in zip(ENDINGS[:2], found[:2], strict=True):
        if data is not None:
            return name + ending, data
    raw, png, svg = found[2:]
    if raw is not None and any(m in raw[:512] for m in MARKS):
        source = raw.decode("utf-8", "replace")
        for ending, picture, put in ((".drawio.png", png, in_png), (".drawio.svg", svg, in_svg)):
            if picture is not None and (made := put(picture, source)) is not None:
                return name + ending, made
    for ending, some in ((".drawio.png", (raw, png)), (".drawio.svg", (raw, svg))):
        for data in some:
            if carries(data) == ending:
                return name + ending, data
    return None


def assembled(wanted: DataFrame, attached: DataFrame) -> DataFrame:
    """(page_id, diagram, file, bytes) of each of ``wanted`` (page_id, diagram) from ``attached`` (page_id, name, bytes); file and bytes are null where nothing can be made."""
    ranks = F.array(*(F.struct(F.lit(i).alias("rank"), F.concat("diagram", F.lit(e)).alias("name")) for i, e in enumerate(ENDINGS)))
    asked = wanted.select("page_id", "diagram").distinct().select("page_id", "diagram", F.explode(ranks).alias("r")).select("page_id", "diagram", "r.rank", "r.name")
    there = attached.filter("bytes is not null").groupBy("page_id", "name").agg(F.min("bytes").alias("bytes"))
    both = asked.join(there, ["page_id", "name"], "left")
    wide = both.groupBy("page_id", "diagram").agg(*(F.max(F.when(F.col("rank") == i, F.col("bytes"))).alias(f"_{i}") for i in range(len(ENDINGS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a row's pictures at a time
                row = batch.slice(at, 1)
                name = row.column("diagram")[0].as_py()
                made = None if name is None else assemble(name, [row.column(f"_{i}")[0].as_py() for i in range(len(ENDINGS))])
                file, data = made or (None, None)
                yield pa.RecordBatch.from_arrays([row.column("page_id"), row.column("diagram"), pa.array([file], pa.string()), pa.array([data], pa.binary())], names=["page_id", "diagram", "file", "bytes"])

    kind = wide.schema["page_id"].dataType.simpleString()
    return wide.mapInArrow(run, f"page_id {kind}, diagram string, file string, bytes binary")
