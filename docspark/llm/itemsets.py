"""Closed frequent itemsets of baskets, and association rules, from minimal generators.

A generator is a frequent itemset that every proper subset exceeds in support. Generators are found level by level: those of one level that agree in all but the last item make the
candidates of the next, which need all their subsets to be generators; a candidate whose support equals a subset's is pruned, with all that would grow from it. Afterwards
each generator's closure is the intersection of the baskets that hold it, as counts: the items that as many of these baskets hold as there are. Every closed frequent itemset is the closure of a generator.

Baskets are cut to frequent items, of which there are at most (rows / least support), and equal ones become one with a weight. A few very large baskets would make pairs with the square of their size. They are set aside:
as they weigh at most half the least support, every frequent itemset is in other baskets, which give the candidates; the large ones are only asked for the candidates' counts.

Defined results: rows without a basket or an item take no part, repeated items of a basket count once; a basket counts in the number of baskets even if nothing in it is frequent; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LEAST = 8
PER_BASKETS = 5000
MIN_PERCENT = 10
#: Baskets of up to so many frequent items are never set aside.
SMALL = 16
#: Frequent items are at most PER_BASKETS times the mean rows of a basket, whatever the table's size; up to so many are sent to all tasks.
SENT_ROWS = 100_000


#: Rows to a partition of the tables between levels, which are small beside the baskets.
PART_ROWS = 20_000


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written once, in as many partitions as its rows ask for, and their number."""
    out = cut(df)
    rows = out.count()
    return out.coalesce(1 + rows // PART_ROWS), rows


def small_side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def frequent(df: DataFrame, basket: str, item: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Distinct baskets (items: ascending, w: how many) of frequent items, written once; the items' supports (i, s); the number of baskets; the least support."""
    rows = df.select(F.col(basket).cast("long").alias("b"), F.col(item).cast("long").alias("i")).dropna()
    total = rows.agg(F.countDistinct("b").alias("n")).first().n
    least = max(LEAST, -(-total // PER_BASKETS))
    # an item's rows are no fewer than its baskets, so most items go before any row is moved
    often, many = settled(rows.groupBy("i").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("i"))
    pairs = cut(rows.join(small_side(often, many), "i").select("b", "i").distinct())
    support, many = settled(pairs.groupBy("i").agg(F.count("*").alias("s")).filter(F.col("s") >= least))
    lists = pairs.join(small_side(support.select("i"), many), "i").groupBy("b").agg(F.sort_array(F.collect_list("i")).alias("items"))  # frequent items only
    return cut(lists.groupBy("items").agg(F.count("*").alias("w"))), support, total, least


def set_aside(found: DataFrame, least: int) -> int:
    """The size above which baskets weigh at most half the least support together; a power of two, so that what comes to the driver are a few counts."""
    size = F.ceil(F.log2(F.size("items").cast("double"))).cast("int")
    weights = {r.k: r.w for r in found.groupBy(size.alias("k")).agg(F.sum("w").alias("w")).collect()}
    above, edge = 0, max(weights, default=0)
    while edge > 0 and 1 << edge > SMALL and above + weights.get(edge, 0) <= least // 2:
        above += weights.get(edge, 0)
        edge -= 1
    return max(SMALL, 1 << edge)


def subsets(column: str) -> Column:
    """All subsets of an array that lack one item."""
    return F.transform(F.sequence(F.lit(1), F.size(column)), lambda i: F.concat(F.slice(column, F.lit(1), i - 1), F.slice(column, i + 1, F.size(column))))


class Baskets:
    """The distinct baskets, and those set aside as (h, i, w), one row an item."""

    def __init__(self, found: DataFrame, least: int):
        edge = set_aside(found, least)
        self.light = found.filter(F.size("items") <= edge)
        large = found.filter(F.size("items") > edge).withColumn("h", F.xxhash64("items"))
        self.heavy, _ = settled(large.select("h", F.explode("items").alias("i"), "w"))
        self.weight = self.heavy.select("h", "w").distinct().agg(F.sum("w")).first()[0] or 0

    def add(self, counted: DataFrame, holding: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """``counted`` (g, light, ...) with ``s``, the support in all baskets; and (g, h, w), the large baskets that hold g.

        ``holding`` is the same of the sets without their last item.
        """
        if not self.weight:
            return counted.withColumn("s", F.col("light")), None
        last = F.element_at("g", -1)
        if holding is None:
            held = counted.select("g", last.alias("i")).join(self.heavy, "i").select("g", "h", "w")
        else:
            prefix = counted.select("g", F.slice("g", F.lit(1), F.size("g") - 1).alias("p"), last.alias("i"))
            held = prefix.join(holding.select(F.col("g").alias("p"), "h"), "p").join(self.heavy, ["h", "i"]).select("g", "h", "w")
        held, _ = settled(held)
        sums = held.groupBy("g").agg(F.sum("w").alias("more"))
        return counted.join(sums, "g", "left").withColumn("s", F.col("light") + F.coalesce("more", F.lit(0))).drop("more"), held


def generators(baskets: Baskets, support: DataFrame, total: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The generators (g, light, s); the distinct baskets that hold each (g, items, w); and the large baskets that do (g, h, w)."""
    all_rows = baskets.light.select("items", "w", F.explode("items").alias("i")).withColumn("g", F.array("i"))
    first = all_rows.groupBy("g").agg(F.sum("w").alias("light"))
    single = support.select(F.array("i").alias("g"), "s").filter(F.col("s") < total)
    first = single.join(first, "g").select("g", "light", "s")
    _, held = baskets.add(first.drop("s"), None)
    (level, many), rows = settled(first), all_rows.select("g", "items", "w")
    out, places, large = [], [], []
    size = 1
    while many:
        rows, _ = settled(rows.join(small_side(level.select("g"), many), "g", "left_semi"))
        out.append(level)
        places.append(rows)
        if held is not None:
            held = held.join(level.select("g"), "g", "left_semi")
            large.append(held)
        # the next level's candidates, with the least support of their subsets
        head, tail = F.slice("g", F.lit(1), size - 1), F.element_at("g", -1)
        grown = rows.select("items", "w", "g", F.explode(F.filter("items", lambda i: i > F.element_at("g", -1))).alias("i")).withColumn("g", F.concat("g", F.array("i")))
        if size == 1:
            # both items are generators; all pairs of a basket are candidates
            grown = grown.join(small_side(level.select(F.element_at("g", 1).alias("i")), many), "i", "left_semi")
        else:
            ends = level.select(head.alias("p"), tail.alias("z"))
            pairs = ends.join(ends.select("p", F.col("z").alias("y")), "p").filter("z < y").select(F.concat("p", F.array("z", "y")).alias("g"))
            parts = pairs.select("g", F.explode(subsets("g")).alias("sub"))
            whole = parts.join(level.select(F.col("g").alias("sub")), "sub").groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") == size + 1)
            grown = grown.join(small_side(*settled(whole.select("g"))), "g", "left_semi")
        counted = grown.groupBy("g").agg(F.sum("w").alias("light")).filter(F.col("light") >= least - baskets.weight)
        counted, held = baskets.add(settled(counted)[0] if held is not None else counted, held)
        enough, _ = settled(counted.filter(F.col("s") >= least).select("g", "light", "s"))
        known = small_side(level.select(F.col("g").alias("sub"), F.col("s").alias("t")), many)
        below = enough.select("g", "light", "s", F.explode(subsets("g")).alias("sub")).join(known, "sub").groupBy("g", "light", "s").agg(F.min("t").alias("t"))
        level, many = settled(below.filter(F.col("s") < F.col("t")).select("g", "light", "s"))
        rows = grown.select("g", "items", "w")
        size += 1
    union = lambda some: None if not some else some[0] if len(some) == 1 else some[0].unionByName(union(some[1:]))
    return union(out), union(places), union(large)


def closures(found: DataFrame, places: DataFrame, large: DataFrame | None, baskets: Baskets) -> DataFrame:
    """(g, z, s): each generator's closure, the intersection of the baskets that hold it."""
    held = places.select("g", F.explode("items").alias("i"), "w").groupBy("g", "i").agg(F.sum("w").alias("n"))
    common = held.join(found.withColumnRenamed("light", "n"), ["g", "n"]).select("g", "i", "s")
    if large is not None:
        # large baskets are asked only for the items that all others share
        common, _ = settled(common)
        need = large.groupBy("g").agg(F.sum("w").alias("need"))
        both = common.join(large, "g").join(baskets.heavy.select("h", "i"), ["h", "i"]).groupBy("g", "i").agg(F.sum("w").alias("have"))
        common = common.join(need, "g", "left").join(both, ["g", "i"], "left").filter(F.coalesce("need", F.lit(0)) == F.coalesce("have", F.lit(0)))
    return common.groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("z"), F.first("s").alias("s"))  # within one basket


def supports(sets: DataFrame, found: DataFrame, closed: DataFrame, single: DataFrame) -> DataFrame:
    """``sets`` (x, distinct subsets of closed sets) with their supports ``a``: of generators and closed sets as they are, of others that of their closure.

    A closure is the superset of greatest support; it is looked for among the closed sets with the subset's rarest item.
    """
    known = found.select(F.col("g").alias("x"), F.col("s").alias("a")).unionByName(closed.select(F.col("z").alias("x"), F.col("s").alias("a"))).distinct()
    marked, _ = settled(sets.join(known, "x", "left"))
    open_ = marked.filter("a is null").select("x")
    items = open_.select("x", F.explode("x").alias("i")).join(single, "i")
    key = items.groupBy("x").agg(F.min_by("i", F.struct("s", "i")).alias("i"))
    within = closed.select("z", "s", F.explode("z").alias("i"))
    above = key.join(within, "i").filter(F.size(F.array_intersect("x", "z")) == F.size("x")).groupBy("x").agg(F.max("s").alias("a"))
    return marked.filter("a is not null").unionByName(above)


def closed_sets(df: DataFrame, basket: str = "sale_id", item: str = "item_id") -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The closed frequent itemsets (z, s), the generators (g, light, s), the items' supports (i, s), and the number of baskets."""
    found, support, total, least = frequent(df, basket, item)
    baskets = Baskets(found, least)
    made, places, large = generators(baskets, support, total, least)
    # the empty set is a generator as well; its closure are the items of all baskets
    of_all = support.filter(F.col("s") == total).agg(F.sort_array(F.collect_list("i")).alias("z"), F.lit(total).cast("long").alias("s")).filter(F.size("z") > 0)
    if made is None:
        none = support.select(F.array("i").alias("g"), F.col("s").alias("light"), "s").limit(0)
        return cut(of_all), none, support, total
    closed = closures(made, places, large, baskets).select("z", "s").distinct().unionByName(of_all)
    return settled(closed)[0], made, support, total


def with_rules(closed: DataFrame, made: DataFrame, support: DataFrame, total: int) -> DataFrame:
    """``closed`` with ``rules``: array of (c, a, s) by c, the items that the rest of the set implies."""
    large = closed.filter(F.size("z") >= 2)
    each = large.select("z", "s", F.posexplode(F.arrays_zip(F.col("z").alias("c"), subsets("z").alias("x"))).alias("p", "q")).select("z", "s", "q.c", "q.x")
    each, _ = settled(each)
    known = supports(each.select("x").distinct(), made, closed, support)
    both = each.join(known, "x").join(support.select(F.col("i").alias("c"), F.col("s").alias("t")), "c")
    exact = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  # products beyond a long don't overflow
    good = (100 * F.col("s") >= MIN_PERCENT * F.col("a")) & (exact("s") * total > exact("a") * exact("t"))
    rules = both.filter(good).groupBy("z").agg(F.sort_array(F.collect_list(F.struct("c", "a", F.col("t").alias("s")))).alias("rules"))
    return closed.join(rules, "z", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<struct<c:bigint,a:bigint,s:bigint>>")))
