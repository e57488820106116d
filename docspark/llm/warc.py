"""WARC archives of web pages: written by Spark's text writer, read back as a stream of records, joined to captures.

A page is one transaction of three records: the request, the response (or a revisit of an equal payload) and the metadata, the first and the last with the
identifier of the second as the one they are concurrent to. A transaction is one string, the writer's line separator is the end of a record, and files are compressed as
they are written, so archives go to any store that Spark writes to, under its commit protocol. Archives are read as lines, in the order of the file, which no task has whole: a parser takes
records out of the stream by their lengths. It trusts no line to be a boundary, so a payload that holds a whole archive is only a payload.

Transaction assembly joins requests and metadata to captures (responses, revisits, resources) through concurrent-to identifiers in either direction and emits one nested row per capture.
Identifiers that only requests or metadata name give a row without a capture. A revisit gets its page and its payload's length from the response that it refers to.

Equal payloads of at least ``REVISIT_BYTES`` bytes are stored once, by the row with the largest page id. They are told apart by SHA-1, a 64-bit hash and their length.

Defined results: a null html is an empty payload; a null url has no target; a null page id is written without one and reads back as null, less than any other; repeated page ids are captures of their own, and of equal payloads
the one that comes first in the table's order is the response (``write`` then numbers rows in a copy of the table); texts of any length are written whole and read in pieces; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
# The format's line end, version, end of a record, and the profile of revisits.
LINE = "\r\n"
VERSION = "WARC/1.1"
END = LINE + LINE
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit", "resource")

RECORD = (
    "record_id string, type string, uri string, date string, concurrent_to array<string>, refers_to string, content_type string, "
    "declared string, payload_bytes long, payload_digest string, complete boolean, page_id long, fields map<string,string>, payload binary"
)


def identifier(kind: str, *of: Column) -> Column:
    """A record's URN, of what the record is and the row it is made of."""
    h = F.md5(F.concat_ws("/", F.lit(kind), *(F.coalesce(c.cast("string"), F.lit("-")) for c in of)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def one_line(value: Column) -> Column:
    """A header's value without blanks and control characters, which are percent-encoded."""
    code = lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.when(value.rlike(r"[\x00-\x20\x7f]"), F.array_join(F.transform(F.split(value, ""), code), "")).otherwise(value)


def record(kind: str, headers: dict[str, Column], block: Column) -> Column:
    """A record without the separator behind it; headers without a value are left out."""
    lines = [F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), *(F.concat(F.lit(f"{k}: "), v) for k, v in headers.items())]
    return F.concat(F.concat_ws(LINE, *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(END), block)


def marked(df: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, size, uid, keeper): the row's own number, and the number of the row that stores its payload."""
    rows = df.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    ids = rows.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1 or page_id is null")
    if ids.isEmpty():
        rows = rows.withColumn("uid", F.col("page_id"))
    else:
        rows = cut(rows.withColumn("uid", -1 - F.monotonically_increasing_id()))
    same = ["digest", "other", "size"]
    rows = rows.withColumns({"digest": F.sha1("html"), "other": F.xxhash64("html"), "size": F.octet_length("html").cast("long")})
    large = rows.filter(F.col("size") >= REVISIT_BYTES)
    best = F.max(F.struct("page_id", "uid"))
    kept = large.groupBy(*same).agg(best.alias("best"), F.count("*").alias("n")).filter("n > 1")
    # a payload that very many rows share is a skewed key of a plain join, whose partitions Spark splits
    return rows.join(kept.select(*same, F.col("best.uid").alias("keeper"), F.col("best.page_id").alias("kept_id")), same, "left").drop("other")


def transactions(df: DataFrame, date: str = DATE) -> DataFrame:
    """One row per page: (value), the text of its three records."""
    rows = marked(df)
    revisit = F.col("keeper").isNotNull() & (F.col("keeper") != F.col("uid"))
    own, host = identifier("capture", F.col("page_id"), F.col("uid")), F.parse_url(one_line(F.col("url")), F.lit("HOST"))
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": one_line(F.col("url"))}
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("size").cast("string"), F.lit(END))
    held = {"WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")), "Content-Type": F.lit("application/http; msgtype=response")}
    response = record("response", {"WARC-Record-ID": own} | common | held, F.concat(http, F.col("html")))
    refers = {"WARC-Profile": F.lit(PROFILE), "WARC-Refers-To": identifier("capture", F.col("kept_id"), F.col("keeper"))}
    again = record("revisit", {"WARC-Record-ID": own} | common | refers | held, http)
    path = F.regexp_extract(one_line(F.col("url")), r"^[^:/?#]+://[^/?#]*([^#]*)", 1)
    line = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), F.coalesce(path, F.lit("")))), F.lit(" HTTP/1.1"))
    asked = F.concat(F.concat_ws(LINE, line, F.concat(F.lit("Host: "), host)), F.lit(END))
    beside = lambda kind: {"WARC-Record-ID": identifier(kind, F.col("page_id"), F.col("uid"))} | common | {"WARC-Concurrent-To": own}
    request = record("request", beside("request") | {"Content-Type": F.lit("application/http; msgtype=request")}, asked)
    known = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(LINE)), F.lit(""))
    metadata = record("metadata", beside("metadata") | {"Content-Type": F.lit("application/warc-fields")}, known)
    return rows.select(F.concat_ws(END, request, F.when(revisit, again).otherwise(response), metadata).alias("value"))


def write(df: DataFrame, path: str, date: str = DATE) -> None:
    """Archives of ``df`` (page_id, url, html), one a partition, in the folder ``path``."""
    transactions(df, date).write.option("lineSep", END).option("compression", "gzip").text(path)


HEADER = re.compile(rb"^([^:\s]+)[ \t]*:[ \t]*(.*?)[ \t]*$")


def fields_of(lines: list[bytes]) -> list[tuple[str, str]]:
    """Names in lower case and values; a line that begins with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for x in lines:
        if x[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {x.strip().decode('utf-8', 'replace')}".strip())
        elif m := HEADER.match(x):
            out.append((m.group(1).decode("utf-8", "replace").lower(), m.group(2).decode("utf-8", "replace")))
    return out


class Parser:
    """Takes bytes as they come and gives records, by their lengths."""

    def __init__(self, with_payload: bool):
        self.held, self.size, self.need, self.with_payload = [], 0, 1, with_payload
        self.data = b""

    def feed(self, piece: bytes) -> Iterator[tuple]:
        self.held.append(piece)
        self.size += len(piece)
        if self.size >= self.need:
            yield from self.parsed(b"".join([self.data, *self.held]), last=False)

    def end(self) -> Iterator[tuple]:
        """What is left at the end of a file; a record that was cut off is not complete."""
        yield from self.parsed(b"".join([self.data, *self.held]), last=True)
        self.data, self.held, self.size, self.need = b"", [], 0, 1

    def parsed(self, data: bytes, last: bool) -> Iterator[tuple]:
        at, need = 0, 1
        while True:
            while data[at : at + 1] in (b"\r", b"\n"):
                at += 1
            stop = data.find(b"\r\n\r\n", at)
            if stop < 0:
                if last and data[at:].strip():
                    raise ValueError(f"no record begins at {data[at : at + 40]!r}")
                need = 2 * (len(data) - at) + 1
                break
            if not data.startswith(b"WARC/", at):
                raise ValueError(f"no record begins at {data[at : at + 40]!r}")
            named = fields_of(data[at:stop].split(b"\r\n")[1:])
            length = int(dict(named).get("content-length", 0))
            if stop + 4 + length > len(data) and not last:
                need = stop + 4 + length - at
                break
            block = data[stop + 4 : stop + 4 + length]
            yield self.record(named, block, len(block) == length)
            at = min(stop + 4 + length, len(data))
        self.data, self.held = data[at:], []
        self.size, self.need = len(self.data), need

    def record(self, named: list[tuple[str, str]], block: bytes, complete: bool) -> tuple:
        one = dict(reversed(named))
        kind, sort = one.get("warc-type"), one.get("content-type", "")
        stop = block.find(b"\r\n\r\n") if sort.startswith("application/http") else -1
        payload = block[stop + 4 :] if stop >= 0 else block
        found = dict(fields_of(block.split(b"\r\n"))) if sort.startswith("application/warc-fields") else {}
        page = found.get("page-id", "")
        stored = kind not in ("revisit", "request", "metadata", "warcinfo")
        return (
            one.get("warc-record-id"), kind, one.get("warc-target-uri"), one.get("warc-date"), [v for k, v in named if k == "warc-concurrent-to"], one.get("warc-refers-to"), sort,
            one.get("warc-payload-digest", "").rpartition(":")[2] or None, len(payload) if stored else None, hashlib.sha1(payload).hexdigest() if stored else None, complete,
            int(page) if re.fullmatch(r"-?\d{1,19}", page) else None, list(found.items()), payload if self.with_payload else None,
        )


def records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the gzip archives in ``path``; see RECORD. Without payloads, their lengths and digests still are those of the whole payloads.

    An archive that ends inside a record gives what it has, with ``complete`` false; bytes that begin no record raise.
    """
    # the line end is one byte, which no reader's buffer can part
    lines = spark.read.option("lineSep", "\n").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    string, names = pa.string(), [x.split()[0] for x in re.split(r", (?=\w+ )", RECORD)]
    kinds = [*[string] * 4, pa.list_(string), *[string] * 3, pa.int64(), string, pa.bool_(), pa.int64(), pa.map_(string, string), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, now, rows, size = Parser(with_payload), None, [], 0

        def pieces() -> Iterator[tuple]:
            nonlocal now
            for batch in batches:
                files, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                at = 0
                for i in range(1, len(files) + 1):
                    if i == len(files) or files[i] != files[at]:
                        if files[at] != now:
                            if now is not None:
                                yield from parser.end()
                            now = files[at]
                        yield from parser.feed(b"\n".join(values[at:i]) + b"\n")
                        at = i
            if now is not None:
                yield from parser.end()

        for row in pieces():
            rows.append(row)
            size += len(row[-1] or b"")
            if len(rows) >= 1024 or size >= 1 << 22:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)

    return lines.mapInArrow(run, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """``records`` to one row per capture: (record_id, capture, requests, metadata), the records as structs."""
    whole = F.struct(*found.columns)
    main = F.col("type").isin(*CAPTURES)
    # concurrent-to is symmetric: a capture may name its request as well as be named by it
    named = found.select("record_id", main.alias("main"), F.explode("concurrent_to").alias("other"))
    pair = lambda of, side: named.filter("main" if of == "record_id" else "not main").select(F.col(of).alias("capture_id"), F.col(side).alias("side_id"))
    pairs = pair("record_id", "other").unionByName(pair("other", "record_id")).distinct()
    sides = found.filter(~main).select(F.col("record_id").alias("side_id"), whole.alias("it"))
    of = lambda kind: F.filter("them", lambda x: x["type"] == kind)
    beside = pairs.join(sides, "side_id").groupBy(F.col("capture_id").alias("record_id")).agg(F.collect_list("it").alias("them"))
    beside = beside.select("record_id", of("request").alias("requests"), of("metadata").alias("metadata"))
    return found.filter(main).select("record_id", whole.alias("capture")).join(beside, "record_id", "full")


def pages(assembled: DataFrame) -> DataFrame:
    """``captures`` to (page_id, url, payload_bytes, payload_digest, record_type, refers_to): revisits with what they refer to."""
    one = assembled.filter("capture is not null").select(
        "record_id", F.try_element_at(F.filter(F.transform("metadata", lambda m: m["page_id"]), lambda x: x.isNotNull()), F.lit(1)).alias("page_id"),
        F.col("capture.uri").alias("url"), F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("refers_id"),
        "capture.payload_bytes", F.coalesce("capture.payload_digest", "capture.declared").alias("payload_digest"),
    )
    one = cut(one)
    stored = one.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"))
    both = one.join(stored, "refers_id", "left")
    return both.select(
        "page_id", "url", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), F.coalesce("full_digest", "payload_digest").alias("payload_digest"), "record_type", "refers_to"
    )
