"""Page trees: closures with folder paths, ancestors, publish roots. Recursion is a loop of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.columns import safe_folder
from docspark.shared import cut


#: Levels that are kept apart before they are written as one table.
MERGED = 16
# The file that marks a folder as part of a tree, and how far up a publish root is looked for.
INDEX = "index.adoc"
ROOT_LEVELS = 10


def closure(edges: DataFrame, roots: DataFrame, depth: int | None = None, paths: bool = True) -> DataFrame:
    """(id, title, path, depth) of the pages below ``roots`` (id, title); a page that is reached twice keeps its least depth, then path.

    ``edges``: (parent_id, child_id, title). The path is made of safe folder names, or empty without ``paths``. Where every page has one parent, as in a site, the chains upward are
    ranked by doubling: a tree of n levels takes about log2(n) rounds. Where pages have several parents, it goes level by level.
    """
    folder = (lambda title: safe_folder(title)) if paths else (lambda title: F.lit(""))
    top = roots.select("id", "title", folder("title").alias("path")).groupBy("id").agg(F.min(F.struct("path", "title")).alias("r"))
    top = cut(top.select("id", "r.title", "r.path", F.lit(0).alias("depth")))
    if depth == 0:
        return top
    kids = edges.select("parent_id", "child_id", F.col("title").alias("_title"), (F.concat(F.lit("/"), folder("title")) if paths else F.lit("")).alias("_tail"))
    kids = cut(kids.join(top.select(F.col("id").alias("child_id")), "child_id", "left_anti").groupBy("parent_id", "child_id").agg(F.min(F.struct("_tail", "_title")).alias("r")).select("parent_id", "child_id", "r.*"))
    if kids.groupBy("child_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        found = doubled(kids, top)
    else:
        found = by_levels(kids, top, depth)
    return found if depth is None else found.filter(F.col("depth") <= depth)


def doubled(kids: DataFrame, top: DataFrame) -> DataFrame:
    """List ranking: every page points to an ancestor, at first its parent, and takes over the pointer of the page that it points to, so the way that a pointer spans doubles each round.

    A page whose pointer reaches a root has its depth and path. One whose chain ends elsewhere falls out of the join; when a round finds no page's root, as the depths on a way have no
    gaps, the pages that are left go in circles.
    """
    found = [top]
    open_ = kids.select(F.col("child_id").alias("id"), F.col("_title").alias("title"), F.col("_tail").alias("path"), F.lit(1).alias("depth"), F.col("parent_id").alias("up"))
    while True:
        ends = [x.select(F.col("id").alias("up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.lit(None).cast(open_.schema["up"].dataType).alias("_up")) for x in found]
        more = open_.select(F.col("id").alias("up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("up").alias("_up"))
        both = open_.join(reduce(DataFrame.unionByName, [*ends, more]), "up")
        both = cut(both.select("id", "title", F.concat("_path", "path").alias("path"), (F.col("_depth") + F.col("depth")).alias("depth"), F.col("_up").alias("up")))
        new = both.filter("up is null").drop("up")
        told = both.agg(F.count_if(F.col("up").isNull()).alias("new"), F.count("up").alias("open")).first()
        if told.new:
            found.append(new)
        if not told.new or not told.open:
            return reduce(DataFrame.unionByName, found)
        open_ = both.filter("up is not null")


def by_levels(kids: DataFrame, top: DataFrame, depth: int | None) -> DataFrame:
    """Level by level, the pages reached are joined with their children, and those that an earlier level holds are left out, so cycles end and each page is
    entered once, however many paths lead to it. Each level is written to the shared checkpoint folder."""
    best = lambda rows: rows.groupBy("id").agg(F.min(F.struct("path", "title")).alias("r")).select("id", "r.title", "r.path")
    level, at = top, 0
    done, apart = None, [level]
    while not level.isEmpty() and (depth is None or at < depth):
        at += 1
        below = level.select(F.col("id").alias("parent_id"), "path").join(kids, "parent_id")
        rows = best(below.select(F.col("child_id").alias("id"), F.col("_title").alias("title"), F.concat("path", "_tail").alias("path")))
        seen = reduce(DataFrame.unionByName, apart if done is None else [done, *apart])
        level = cut(rows.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(at)))
        apart.append(level)
        if len(apart) == MERGED:
            done, apart = cut(reduce(DataFrame.unionByName, apart if done is None else [done, *apart])), []
    return reduce(DataFrame.unionByName, apart if done is None else [done, *apart])


def publish_roots(files: DataFrame, path: str = "path", limit: int = ROOT_LEVELS) -> DataFrame:
    """(folder, root) of every folder that holds a file: the top of the tree that the folder belongs to, from which links are resolved.

    From the folder up, each parent that holds an index file is part of the tree, ``limit`` of them at most; the first that holds none ends it. The folders' ancestors are joined
    with the folders of index files; the length of the run of hits from the folder up gives the root.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    rows = files.select(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"), (name == INDEX).alias("index"))
    indexed = rows.filter("index").select(F.col("folder").alias("above"), F.lit(True).alias("hit")).distinct()
    parts = F.filter(F.split("folder", "/"), lambda x: x != "")
    folders = rows.select("folder").distinct().withColumn("parts", parts)
    up = F.transform(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(limit))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("parts", F.lit(1), F.size("parts") - k), "/").alias("above")))
    each = folders.select("folder", F.explode_outer(F.when(F.size("parts") > 0, up)).alias("u")).select("folder", "u.k", "u.above")
    # the first miss ends the run; where there is none, the run is as long as the way
    run = F.coalesce(F.min(F.when(F.col("hit").isNull(), F.col("k"))) - 1, F.max("k"), F.lit(0))
    long = each.join(indexed, "above", "left").groupBy("folder").agg(run.alias("n"))
    kept = F.filter(F.split("folder", "/"), lambda x: x != "")
    return long.select("folder", F.array_join(F.slice(kept, F.lit(1), F.size(kept) - F.col("n")), "/").alias("root"))


def collisions(tree: DataFrame) -> DataFrame:
    """Paths that several pages share, with their number."""
    return tree.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")


def ancestors(path: Column) -> Column:
    """Folders above a file, the outermost first."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def folder_tree(files: DataFrame, path: str = "path") -> DataFrame:
    """(folder, depth) of all folders above files, each once; a reader who needs parents first orders by depth, then folder."""
    rows = files.select(F.explode(ancestors(F.col(path))).alias("folder")).distinct()
    return rows.select("folder", F.size(F.split("folder", "/")).alias("depth"))
