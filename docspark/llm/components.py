"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: longs) to (v, root): each vertex that has an edge and is not its component's least, with that least.

    Every step is two joins on a vertex's least neighbour, so a vertex with very many edges is a skewed join and not a
    collected list. Each round is written to the shared checkpoint folder. An empty table gives an empty table.
    """
    now = cut(_clean(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))))
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _clean(large)
        # here u > v everywhere
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = cut(_clean(small))
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("v"), F.col("v").alias("root"))


def _clean(edges: DataFrame) -> DataFrame:
    """Distinct edges from the greater to the lesser vertex."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
