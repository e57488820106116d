"""What vector searches share: usable vectors, classes of equal vectors, shards, and query blocks.

Equal vectors are one *class* with its least ids, as many as any answer can need; so a vector that a third of the rows hold is
indexed and searched once. Classes are dealt to shards of about ``rows`` by hash. Query classes travel in packed blocks; each block
meets each shard, which is the stated query set against all rows in blocks. Ids are numbers (others raise, as the cast does); an id that stands on
several vectors is a candidate by each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, few_rows_a_batch, shuffle_partitions

QUERY_BLOCK = 512


def usable(vector: Column) -> Column:
    """Whether a vector is not null and has no null, NaN or infinite component; an empty one is usable."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, good), F.lit(False))


def classes(df: DataFrame, keep: int, rows: int) -> tuple[DataFrame, int]:
    """``df`` (id, vec: array of doubles) to (shard, h, vec, ids: the ``keep`` least), written once, and the number of shards.

    Vectors of different lengths never share a shard number's row group, since the length is part of the class and of the shard's key.
    """
    h = df.withColumn("h", F.xxhash64("vec"))
    # the limit is applied before the exchange as well, so a common vector sends ``keep`` rows a task
    ranked = h.withColumn("r", F.row_number().over(W.partitionBy("h", "vec").orderBy("id"))).filter(F.col("r") <= keep)
    found = cut(ranked.groupBy("h", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    shards = max(1, -(-found.count() // rows))
    return found.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")), shards


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with the same keys, as they come."""
    now, held = None, []
    for batch in batches:
        marks = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        at = 0
        for i in range(1, len(marks) + 1):
            if i == len(marks) or marks[i] != marks[at]:
                if marks[at] != now:
                    if held:
                        yield now, pa.Table.from_batches(held).combine_chunks()
                    now, held = marks[at], []
                held.append(batch.slice(at, i - at))
                at = i
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of the same length as rows."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), len(flat) // max(1, len(lists)))


def unpacked(data: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(rows, dim) if dim else np.zeros((rows, 0))


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def indexed(found: DataFrame, shards: int, build: Callable[[np.ndarray], bytes]) -> DataFrame:
    """One row per shard and vector length: (shard, dim, vecs, ids, ends, extra); ids of class i lie between ends i and i + 1.

    ``extra`` is what ``build`` makes of the shard's vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, dim), rows in grouped(batches, ["shard", "dim"]):
            vecs, ids = matrix(rows.column("vec")), rows.column("ids").combine_chunks()
            ends = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            row = [[shard], [dim], [blob(vecs)], [blob(ids.flatten().to_numpy())], [blob(ends.astype(np.int32))], [build(vecs)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(row, kinds, strict=True)], names=names)

    names, kinds = ["shard", "dim", "vecs", "ids", "ends", "extra"], [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    rows = found.withColumn("dim", F.size("vec")).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "h")
    return cut(rows.mapInArrow(run, "shard int, dim int, vecs binary, ids binary, ends binary, extra binary"))


def blocks(queries: DataFrame, shards: int, parts: int) -> DataFrame:
    """(shard, dim, hs, qs): packed blocks of query classes (h, vec), each once for every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim,), rows in grouped(batches, ["dim"]):
            for at in range(0, rows.num_rows, QUERY_BLOCK):
                part = rows.slice(at, QUERY_BLOCK)
                row = [pa.array([dim], pa.int32()), pa.array([blob(part.column("h").to_numpy())], pa.binary()), pa.array([blob(matrix(part.column("vec")))], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["dim", "hs", "qs"])

    dealt = queries.select("h", "vec", F.size("vec").alias("dim")).repartition(parts, "h").sortWithinPartitions("dim", "h")
    packed = dealt.mapInArrow(run, "dim int, hs binary, qs binary")
    return packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", "hs", "qs")


class Shard:
    """An unpacked index row."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.ends = np.frombuffer(row["ends"], dtype=np.int32)
        self.vecs = unpacked(row["vecs"], row["dim"], len(self.ends) - 1)
        self.extra = row["extra"]

    def ids_of(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] : self.ends[i + 1]]


def searched(index: DataFrame, queries: DataFrame, find: Callable[[Shard, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]], shards: int, copies: int, score: str) -> DataFrame:
    """(h, found: array of (s, id)) for each query class and shard; ``find`` gives scores and ids of each query, best first.

    The best have the greatest score, then the least id. A task unpacks one shard's index, which comes first in it, and then meets query blocks one after the other; the index
    travels ``copies`` times, and not with each block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("shard", "dim", "part")}
                if not batch.column("hs")[i].is_valid:
                    key, shard = row, Shard(row | {n: batch.column(n)[i].as_py() for n in ("vecs", "ids", "ends", "extra")})
                    continue
                if row != key:  # the shard has no vectors of this length
                    continue
                hs = np.frombuffer(batch.column("hs")[i].as_py(), dtype=np.int64)
                qs = unpacked(batch.column("qs")[i].as_py(), row["dim"], len(hs))
                scores, ids = zip(*find(shard, qs), strict=True)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(scores), type=kind), pa.array(np.concatenate(ids), type=pa.int64())], names=["s", "id"])
                yield pa.RecordBatch.from_arrays([pa.array(hs), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["h", "found"])

    kind = pa.float64() if score == "double" else pa.int64()
    none = F.lit(None).cast("binary")
    stored = index.select("shard", "dim", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("part"), none.alias("hs"), none.alias("qs"), "vecs", "ids", "ends", "extra")
    asked = queries.select("shard", "dim", F.pmod(F.xxhash64("hs"), F.lit(copies)).cast("int").alias("part"), "hs", "qs", *(none.alias(c) for c in ("vecs", "ids", "ends", "extra")))
    key = ["shard", "dim", "part"]
    rows = stored.unionByName(asked).repartition(shards * copies, *key).sortWithinPartitions(*key, F.col("hs").isNotNull())
    return rows.mapInArrow(run, f"h long, found array<struct<s:{score},id:long>>")


def merged(answers: DataFrame, members: DataFrame, keep: int, k: int) -> DataFrame:
    """Shards' answers to (query_id, rank, vec_id, score): the k best other ids of each query.

    ``members`` has the query ids (query_id, h); ``keep`` is k + 1, since a query's own id may be among its class's answers.
    """
    one = answers.select("h", F.explode("found").alias("f")).select("h", (-F.col("f.s")).alias("n"), F.col("f.id").alias("id"))
    best = one.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("n", "id"))).filter(F.col("r") <= keep)
    best = best.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("best"))
    each = members.join(best, "h").select("query_id", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k).alias("best"))
    each = each.select("query_id", F.posexplode("best").alias("p", "b"))
    return each.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.n")).alias("score"))


def search(df: DataFrame, is_query: Column, k: int, rows: int, build: Callable, find: Callable, score: str) -> DataFrame:
    """All steps over ``df`` (id, vec), written once; the ids for which ``is_query`` holds are the queries."""
    spark = df.sparkSession
    with few_rows_a_batch(spark, 64):
        found, shards = classes(df, k + 1, rows)
        index = indexed(found, shards, build)
        members = df.filter(is_query).select(F.col("id").alias("query_id"), F.xxhash64("vec").alias("h")).distinct()
        asked = cut(found.join(members.select("h").distinct(), "h", "left_semi").select("h", "vec"))
        many = -(-asked.count() // QUERY_BLOCK)
        # as many copies of the index as keep all cores busy, with a few query blocks each
        copies = max(1, min(shuffle_partitions(spark) // shards, many // 4))
        answers = searched(index, blocks(asked, shards, max(1, many)), find, shards, copies, score)
        return cut(merged(answers, members, k + 1, k))
