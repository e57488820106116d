"""Operators on listings: paging, tiered search, first and last wins, counters, routing, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.shared import cut


def clamp_limit(n: int | None, default: int = 50, most: int = 100) -> int:
    return max(1, min(default if n is None else int(n), most))


def clamp_start(n: int | None) -> int:
    return max(0, int(n or 0))


def page(df: DataFrame, order: list, start: int | None = 0, limit: int | None = None, default: int = 50, most: int = 100) -> DataFrame:
    """One page of a listing in a stated order; the limit and the start are brought into range."""
    return df.orderBy(*order).offset(clamp_start(start)).limit(clamp_limit(limit, default, most))


def numbered_pages(df: DataFrame, order: list, size: int = 100) -> DataFrame:
    """``df`` with page_no and place: every row's place in an offset pager, by sorted ranges and not by one task.

    The ranges are written first, so that their counts and the places in them come from the same rows.
    """
    rows = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"))  # one row a partition
    starts = counts.select("_part", (F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("_start"))
    rows = rows.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    placed = rows.join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + F.col("_in"))
    return placed.withColumn("page_no", F.floor(F.col("place") / size)).drop("_part", "_in", "_start")


def first_tier(df: DataFrame, tiers: list[Column], partition: list[str] | None = None) -> DataFrame:
    """Rows of the first condition that any row meets, with ``tier``; per ``partition`` where given."""
    tier = F.coalesce(*(F.when(c, i) for i, c in enumerate(tiers, 1)))
    rows = df.withColumn("tier", tier).filter("tier is not null")
    if partition:
        return rows.withColumn("_least", F.min("tier").over(W.partitionBy(*partition))).filter("tier = _least").drop("_least")
    least = rows.agg(F.min("tier").alias("_least"))  # one row
    return rows.join(F.broadcast(least), F.col("tier") == F.col("_least")).drop("_least")


def first_wins(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def last_wins(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def unchanged(current: DataFrame, stored: DataFrame, key: str, mark: str) -> DataFrame:
    """Rows of ``current`` whose ``mark`` (a version or a hash) is the stored one."""
    return current.join(stored.select(key, mark), [key, mark], "left_semi")


def changed(current: DataFrame, stored: DataFrame, key: str, mark: str) -> DataFrame:
    """Rows of ``current`` that are new or whose ``mark`` differs."""
    return current.join(stored.select(key, mark), [key, mark], "left_anti")


def actions(current: DataFrame, stored: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, action, number): created, updated with the next version number, or skipped."""
    both = current.alias("c").join(stored.alias("s"), key, "left")
    same = F.col(f"c.{mark}") == F.col(f"s.{mark}")
    action = F.when(F.col(f"s.{mark}").isNull(), "created").when(same, "skipped").otherwise("updated")
    number = F.when(F.col(f"s.{mark}").isNull(), 1).when(same, F.col("s.number")).otherwise(F.col("s.number") + 1)
    return both.select(key, action.alias("action"), number.alias("number"))


def summary(results: DataFrame, action: str = "action") -> DataFrame:
    """One row of counts and the line that reports them."""
    kinds = ("created", "updated", "skipped", "failed")
    counts = results.agg(*(F.count_if(F.col(action) == k).alias(k) for k in kinds))
    return counts.withColumn("line", F.concat_ws(", ", *(F.concat(F.lit(f"{k}: "), F.col(k).cast("string")) for k in kinds)))


def failed_of(line: Column) -> Column:
    return F.regexp_extract(line, r"failed: (\d+)", 1).try_cast("int")


def route(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Each request (id, kind) with its endpoint's host: primary of its kind, else any of it, else the first; by ``ord`` among equals.

    ``endpoints`` (host, kind, is_primary, ord) is a configuration of a few rows.
    """
    tier = F.when((F.col("r.kind") == F.col("e.kind")) & F.col("e.is_primary"), 1).when(F.col("r.kind") == F.col("e.kind"), 2).otherwise(3)
    kinds = requests.select("kind").distinct().alias("r").join(F.broadcast(endpoints.alias("e")), F.lit(True))
    best = kinds.groupBy(F.col("r.kind").alias("kind")).agg(F.min_by(F.col("e.host"), F.struct(tier.alias("t"), F.col("e.ord"))).alias("host"))
    return requests.join(F.broadcast(best), "kind").select("id", "kind", "host")


def link_types(wanted: DataFrame, types: DataFrame) -> DataFrame:
    """Each wanted name with the link type it means: by name, inward or outward label in any case, the first by ``ord``.

    The three labels become rows, so the join is on equality.
    """
    labels = types.select("name", "ord", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("inward"), F.lower("outward")))).alias("label"))
    first = labels.groupBy("label").agg(F.min_by("name", "ord").alias("type"))
    rows = wanted.withColumn("label", F.lower(F.trim("wanted")))
    return rows.join(first, "label", "left").select("wanted", "type")


def version_pair(versions: DataFrame, key: str, old: int, new: int) -> DataFrame:
    """(key, old_text, new_text) of two versions of each document, in one pass."""
    pick = lambda n: F.max(F.when(F.col("version") == n, F.col("text")))
    return versions.filter(F.col("version").isin(old, new)).groupBy(key).agg(pick(old).alias("old_text"), pick(new).alias("new_text"))


def enabled_tools(tools: DataFrame, kinds: list[str]) -> DataFrame:
    """Tools whose prefix is an enabled kind, and those without a known prefix."""
    prefix = F.regexp_extract("name", "^(jira|confluence|bitbucket)_", 1)
    return tools.filter((prefix == "") | F.upper(prefix).isin(*kinds))


def table_width(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The widest row of each table, by its cells' column spans."""
    rows = cells.groupBy(*keys, "row_no").agg(F.sum("colspan").alias("w"))
    return rows.groupBy(*keys).agg(F.max("w").cast("int").alias("width"))


def heading_levels(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``under``: the level of the last heading before each among its siblings, 0 where there is none."""
    w = W.partitionBy("page_id", "parent_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("under", F.coalesce(F.last(F.when(F.col("kind") == "heading", F.col("level")), ignorenulls=True).over(w), F.lit(0)))
