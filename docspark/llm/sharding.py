"""Sharding of a table by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with the same text form a group. The large groups, above 1/``LARGE`` of a shard in bytes, tokens or rows, come first: they are at most 3 * ``LARGE``
a shard, so they are listed and placed together. All others are dealt over partitions by hash, as many partitions as the number of rows asks for, and each partition
fills what the large groups leave of the shards. Placing is the same for both: largest first, in the shard whose residual capacity has the highest dot
product with the group's (bytes, tokens, rows), all three as shares of the totals, among the shards that still have room for its bytes (or
the one with the most room left, if none has). As every partition fills its shards alike, so do all of them together. A group stays whole wherever it fits; only
where no shard has as much room left, as for every group above the mean shard, its rows are dealt in turn, by their number in the group, into parts of at most 1/``parts`` of a shard.

Rows are numbered by one sort over ranges: their places are counts per range, a row a range, plus the place in the range. The result depends on the rows alone, not
on how they are partitioned; rows equal in id and text may swap places.

Tokens are counted as the runs that a tokenizer could make of a text: up to six letters, up to three digits, single ideographs, single other
characters that are not white space. They stand for a vocabulary's ids without the price of encoding.

Defined results: a null text has no bytes and is not in the group of the empty text; null and repeated ids are dealt and numbered like others;
a row of any length is placed whole; ids are numbers (others raise, as the cast does); an empty table gives no rows; other input columns are not
carried, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, numbered, on_group

SHARDS = 24
PARTS = 10
LARGE = 64
OVERHEAD = 8
#: Groups to a partition of the placement.
PLACED = 1 << 14
#: Rows of a shard are numbered by these; _u only parts rows that are equal otherwise.
ORDER = ["doc_id", "text_crc32", "size", "_u"]
# What counts as one token.
TOKEN = r"\p{IsIdeographic}|[\p{L}\p{M}&&[^\p{IsIdeographic}]]{1,6}+|\p{N}{1,3}+|[^\s\p{L}\p{M}\p{N}]"

LAW = "bytes"


def place(sizes: np.ndarray, room: np.ndarray, turn: int = 0) -> np.ndarray:
    """The shard of each row of ``sizes``, which come largest first, as shares of the same totals as ``room``, the shards' capacities; both have
    columns for bytes, tokens and rows.

    ``turn`` moves the order in which equal shards are taken, so that partitions don't favour the same ones.
    """
    room = np.roll(room, -turn, axis=0)
    return np.array([(put(room, want) + turn) % len(room) for want in sizes], dtype=np.int32)


def put(room: np.ndarray, want: np.ndarray) -> int:
    """The shard that takes ``want``, which it has less room for then."""
    fits = room[:, 0] >= want[0]
    score = np.where(fits, room @ want, -np.inf) if fits.any() else room[:, 0]
    best = int(np.argmax(score))
    room[best] -= want
    return best


def place_large(sizes: np.ndarray, rows: list[int], room: np.ndarray, parts: int) -> list[list[int]]:
    """The shards of the parts of each large group: first of those that a shard has room for, largest first; the others are then dealt out in parts of 1/``parts`` of a shard."""
    out: list[list[int]] = [[] for _ in sizes]
    for i, want in enumerate(sizes):
        if (room[:, 0] >= want[0]).any():
            out[i] = [put(room, want)]
    for i, want in enumerate(sizes):
        if not out[i]:
            count = max(1, min(rows[i], int(-(-want.max() * len(room) * parts // 1))))
            out[i] = [put(room, want / count) for _ in range(count)]
    return out


def shares(sizes: np.ndarray) -> np.ndarray:
    total = sizes.sum(axis=0)
    return sizes / np.where(total > 0, total, 1)


def assign(df: DataFrame, shards: int = SHARDS, parts: int = PARTS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, tokens, shard, slot. A group that no shard has room for is dealt out."""
    value = F.col(text)
    rows = cut(df.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(value, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.regexp_count(value, F.lit(TOKEN)), F.lit(0)).cast("long").alias("tokens"),
        F.when(value.isNotNull(), F.xxhash64(value)).alias("h"),
        F.monotonically_increasing_id().alias("_u"),
    ))
    same = ["h", "text_crc32", "size"]
    groups = rows.groupBy(*same).agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.sum("tokens").alias("t"))
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.sum("tokens").alias("t")).first()
    if not total.n:
        return rows.select("doc_id", "size", "text_crc32", "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    whole = np.array([total.b, max(total.t, 1), total.n], dtype=np.float64)
    share = F.greatest(*(F.col(c) / float(x) for c, x in zip("btn", whole, strict=True))) * shards
    large = groups.filter(share * LARGE > 1).withColumn("share", share).orderBy(F.desc("share"), *same).collect()  # at most 3 * LARGE * shards rows
    sizes = np.array([[g.b, g.t, g.n] for g in large]).reshape(-1, 3) / whole
    room = np.full((shards, 3), 1 / shards)
    found = place_large(sizes, [g.n for g in large], room, parts)
    room = shares(np.maximum(room, 0))
    key_kind = "h long, text_crc32 long, size long"
    spark = df.sparkSession
    parted = spark.createDataFrame([(g.h, g.text_crc32, g.size, len(at)) for g, at in zip(large, found, strict=True)], f"{key_kind}, parts int")
    fixed = spark.createDataFrame([(g.h, g.text_crc32, g.size, i, x) for g, at in zip(large, found, strict=True) for i, x in enumerate(at)], f"{key_kind}, sub int, shard int")
    marked = on_group(rows, F.broadcast(parted), same, "left", F.col("r.parts").alias("parts"))
    hot = numbered(marked.filter("parts > 1"), same, ORDER, total.n).withColumn("sub", F.pmod("_at", "parts").cast("int")).drop("_at")
    hot = hot.unionByName(marked.filter("parts = 1").withColumn("sub", F.lit(0))).drop("parts")
    rows = marked.filter("parts is null").drop("parts").withColumn("sub", F.lit(0))
    unit = [*same, "sub"]
    dealt = rows.groupBy(*unit).agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    places = max(1, total.n // PLACED)
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(*unit), F.lit(places)).cast("int")).repartition(places, "_part")
    dealt = dealt.sortWithinPartitions("_part", F.desc("b"), *unit)
    schema = T.StructType([*(dealt.schema[c] for c in unit), T.StructField("shard", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part = None

        def flush() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(held_table := pa.Table.from_batches(held)), WINDOW):
                piece = held_table.slice(at, WINDOW).combine_chunks()
                sizes = shares(np.column_stack([piece.column(c).to_numpy().astype(np.float64) for c in ("b", "t", "n")]))
                yield from piece.select(unit).append_column("shard", pa.array(place(sizes, room, (part or 0) % shards))).to_batches()

        for batch in batches:
            at = batch.column("_part").to_numpy()
            for cut_at in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(at) else []:
                if part is not None and at[cut_at[0]] != part:
                    yield from flush()
                    held = []
                part = int(at[cut_at[0]])
                held.append(batch.slice(cut_at[0], len(cut_at)))
                if sum(x.num_rows for x in held) >= WINDOW:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    placed = dealt.mapInArrow(run, schema)
    joined = on_group(rows, placed, unit, "inner", F.col("r.shard").alias("shard"))
    joined = joined.unionByName(on_group(hot, F.broadcast(fixed), unit, "inner", F.col("r.shard").alias("shard")))
    out = numbered(joined, ["shard"], ORDER, total.n)
    return out.select("doc_id", "size", "text_crc32", "tokens", "shard", F.col("_at").alias("slot"))


#: Groups that a partition places at once; their shares of the capacities are those of this many.
WINDOW = 1 << 16
