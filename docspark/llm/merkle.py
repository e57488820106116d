"""A Merkle manifest of a table: leaves, group roots, one root, and for every row the path that proves it.

Rows are ranked inside their group by key without a global sort: a histogram over the high digits of the keys is summed digit by digit, so that each cell knows
how many rows of its group come before it, and rows are counted only inside their cell of 1,024 keys. A rank's digits to base ``FANOUT`` name the row's place in a trie: the nodes whose
ranks agree in all but the last three digits make a block, which is reduced by three levels at once; the blocks' digests, with the digits that are left as their ranks, are
the next round's nodes. The groups' roots are ranked by the group's name and reduced in the same way. Paths come back down: a block is joined to the
path above it, one row for 512 nodes, before its rows are told apart.

Defined results: null values are a field ``-``; rows without a key come first, as a group without a name does; rows with one key are ordered by their leaf, and equal leaves
are places of their own in any order; a group of one row has its leaf as root; a text of any length is hashed whole; an empty table gives no rows; other columns travel as one struct and keep their names
unless the result has them. A key that very many rows share is ranked by the digits of its leaves as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .spans import let

FANOUT = 8
#: Levels of the trie that a block holds.
LEVELS = 3
BLOCK = FANOUT**LEVELS
#: A cell of the key histogram has 2**CELL_BITS keys; one with more than CELL_ROWS rows is parted by leaves.
CELL_BITS = 10
CELL_ROWS = 1 << 16
#: Groups to a range of their numbering.
RANGE_GROUPS = 1 << 16

PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon and itself, or a dash for null."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return digest(*(field(c) for c in columns))


def starts(cells: DataFrame, group: list[str], digits: list[str]) -> DataFrame:
    """``cells`` (group, digits, n) with ``start``, the rows of the group in the cells before, and ``total``, those of the group.

    Each level's histogram is the sum of the one below; a window only spans the cells that differ in one digit.
    """
    levels = [cells]
    for i in range(len(digits) - 1, 0, -1):
        levels.append(levels[-1].groupBy(*group, *digits[:i]).agg(F.sum("n").alias("n")))
    now = None
    for i, level in enumerate(reversed(levels)):
        same = W.partitionBy(*group, *digits[:i])
        before = same.orderBy(digits[i]).rowsBetween(W.unboundedPreceding, -1)
        start = F.coalesce(F.sum("n").over(before), F.lit(0))
        if now is None:
            now = level.withColumns({"start": start, "total": F.sum("n").over(same)})
        else:
            above = now.select(*group, *digits[:i], F.col("start").alias("_above"), "total")
            now = level.withColumn("start", start).join(above, [*group, *digits[:i]]).withColumn("start", F.col("start") + F.col("_above")).drop("_above")
    return now.drop("n").withColumnRenamed("total", "_n")


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (_g, _k, _d, _x) as (_g, _n, _r, _d, _x): the group's rows and the rank in it by key and leaf from 0; and the groups (_g, _n)."""
    digits = ["_c1", "_c2", "_c3"]
    key = F.coalesce("_k", F.lit(0))
    shifted = [F.when(F.col("_k").isNull(), -(1 << 20)).otherwise(F.shiftright(key, CELL_BITS + 36).cast("int"))]
    shifted += [F.shiftright(key, CELL_BITS + at).bitwiseAND(0x3FFFF).cast("int") for at in (18, 0)]
    rows = cut(rows.withColumns(dict(zip(digits, shifted, strict=True)) | {"_u": F.monotonically_increasing_id()}))
    cells = cut(rows.groupBy("_g", *digits).agg(F.count("*").alias("n")))
    groups = cells.groupBy("_g").agg(F.sum("n").alias("_n"))
    # a cell has 1,024 keys at most, so only keys that repeat make one larger
    full, cell = cells.filter(F.col("n") > CELL_ROWS), ["_g", *digits]
    if not full.isEmpty():
        parts = [key.bitwiseAND((1 << CELL_BITS) - 1).cast("int"), *(F.conv(F.substring("_d", at, 4), 16, 10).cast("int") for at in (1, 5)), F.pmod(F.xxhash64("_u"), F.lit(1 << 12)).cast("int")]
        wide = rows.join(full.select(*cell, F.lit(True).alias("_full")), cell, "left")
        fine = {f"_f{i}": F.when(F.col("_full"), x).otherwise(F.lit(0)) for i, x in enumerate(parts)}
        rows = cut(wide.withColumns(fine).drop("_full"))
        cell += fine
        cells = cut(rows.groupBy(*cell).agg(F.count("*").alias("n")))
    number = F.row_number().over(W.partitionBy(*cell).orderBy("_k", "_d", "_u"))
    placed = rows.join(starts(cells, ["_g"], cell[1:]), cell)
    return placed.select("_g", "_n", (F.col("start") + number - 1).alias("_r"), "_d", "_x"), groups


def ranked_groups(groups: DataFrame) -> DataFrame:
    """``groups`` (_g, ...) with ``_r``: their rank by name, from counts of sorted ranges."""
    groups = cut(groups)
    ranges = 1 + groups.count() // RANGE_GROUPS
    dealt = cut(groups.repartitionByRange(ranges, "_g").withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row a range
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_g"))
    return dealt.withColumn("_i", inside).join(sums, "_range").withColumn("_r", F.col("start") + F.col("_i") - 1).drop("_range", "n", "start", "_i")


def upper(nodes: Column) -> Column:
    """The digests of the runs of ``nodes``, an array of digests."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / FANOUT).cast("int") - 1)
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)), "")))


def step(nodes: Column, at: Column) -> Column:
    """The other nodes of the run of node ``at`` of ``nodes``: those before it and those after it."""
    first = F.shiftright(at, 3) * FANOUT
    left = F.array_join(F.slice(nodes, first + 1, at - first), "")
    right = F.array_join(F.slice(nodes, at + 2, first + FANOUT - 1 - at), "")
    return F.struct(left.alias("left"), right.alias("right"))


def levels(nodes: Column, steps: Column, then: Callable[[list[Column]], Column]) -> Column:
    """``then`` of the arrays of digests of a block's levels, from its nodes up; levels above the root repeat it."""

    def climb(known: list[Column]) -> Column:
        if len(known) > LEVELS:
            return then(known)
        return let(F.when(steps >= len(known), upper(known[-1])).otherwise(known[-1]), lambda up: climb([*known, up]))

    return let(nodes, lambda n: climb([n]))


def climbed(nodes: DataFrame, most: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` (_g, _n: nodes of the group, _r, _d, _x) to (_d, _x, _path, _sub, _root); ``most`` is the largest _n.

    ``crown`` makes of the groups' tops (_g, _sub) what is above them: (_g, _sub, _over: a path, _root).
    """
    depth = F.lit(0)
    for k in range(21):
        depth = depth + (F.col("_n") > F.lit(FANOUT**k)).cast("int")
    blocks = nodes.groupBy("_g", "_n", F.shiftright("_r", 3 * LEVELS).alias("_b")).agg(F.collect_list(F.struct("_r", "_d", "_x")).alias("_m"))  # at most BLOCK nodes
    in_order = F.array_sort("_m", lambda a, b: (a["_r"] - b["_r"]).cast("int"))
    blocks = cut(blocks.withColumns({"_m": in_order, "_s": F.least(depth, F.lit(LEVELS))}))
    own, steps = F.transform("_m", lambda m: m["_d"]), F.col("_s")
    top = levels(own, steps, lambda known: F.element_at(known[-1], 1))
    if most > BLOCK:
        upper_nodes = blocks.select("_g", F.ceil(F.col("_n") / BLOCK).cast("long").alias("_n"), F.col("_b").alias("_r"), top.alias("_d"), F.col("_b").alias("_x"))
        above = climbed(upper_nodes.withColumn("_x", F.struct("_g", "_x")), -(-most // BLOCK), crown)
        above = above.select(F.col("_x._g").alias("_g"), F.col("_x._x").alias("_b"), F.col("_path").alias("_over"), "_sub", "_root")
        blocks = blocks.join(above, ["_g", "_b"])
    else:
        blocks = blocks.join(crown(blocks.select("_g", top.alias("_sub"))), "_g")

    def paths(known: list[Column]) -> Column:
        def one(m: Column, i: Column) -> Column:
            way = F.array(*(step(known[k], F.shiftright(i, 3 * k)) for k in range(LEVELS)))
            return F.struct(m["_d"].alias("_d"), m["_x"].alias("_x"), F.concat(F.slice(way, F.lit(1), steps), F.col("_over")).alias("_path"))

        return F.transform("_m", one)

    return blocks.select("_sub", "_root", F.inline(levels(own, steps, paths)))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the other nodes of its path make."""
    return F.aggregate(path, leaf, lambda d, s: digest(s["left"], d, s["right"]))


def manifest(df: DataFrame, leaf: Column, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``df``: its columns and leaf, subroot, root and path (left and right nodes of each level, from the leaf up)."""
    name = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # the group without a name comes first
    rows = df.select(name.alias("_g"), F.col(key).cast("long").alias("_k"), leaf.alias("_d"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_x"))
    nodes, groups = ranked(rows)
    groups = ranked_groups(groups)
    size = groups.agg(F.count("*").alias("n"), F.max("_n").alias("most")).first()

    def root(tops: DataFrame) -> DataFrame:
        return tops.select("_g", "_sub", F.array().cast(PATH).alias("_over"), F.col("_sub").alias("_root"))

    def crown(tops: DataFrame) -> DataFrame:
        named = groups.join(tops, "_g").select(F.lit("").alias("_g"), F.lit(size.n).cast("long").alias("_n"), "_r", F.col("_sub").alias("_d"), F.col("_g").alias("_x"))
        return climbed(named, size.n, root).select(F.col("_x").alias("_g"), F.col("_d").alias("_sub"), F.col("_path").alias("_over"), "_root")

    made = {"leaf", "subroot", "root", "path"}
    kept = [F.col("_x")[c].alias(c) for c in df.columns if c.lower() not in made]
    return climbed(nodes, size.most or 0, crown).select(*kept, F.col("_d").alias("leaf"), F.col("_sub").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"))


def proof(path: Column) -> Column:
    """The digest of a path's nodes, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))
