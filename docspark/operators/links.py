"""Link resolution by joins: cached, then local pages, then the page's rendered view, then search; users and attachments by lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "http://mock"


def page_links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, href, label) of every ``<a>`` of rendered pages, by patterns and so in the JVM."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"""(?s)<a\b[^>]*?\bhref=(?:"[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>.*?</a>"""), F.lit(0))
    rows = pages.select(key, F.posexplode(tags).alias("pos", "tag"))
    label = F.trim(F.regexp_replace(F.regexp_replace("tag", "<[^>]+>", ""), r"\s+", " "))
    return rows.select(key, "pos", _href(F.col("tag")).alias("href"), label.alias("label"))


def _href(tag: Column) -> Column:
    value = F.regexp_extract(tag, r"""\bhref=("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def view_map(links: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, label, href): the last link of each label; blank labels and targets are left out."""
    kept = links.filter((F.trim("label") != "") & (F.trim("href") != ""))
    return kept.groupBy(key, "label").agg(F.max_by("href", "pos").alias("href"))


def resolve(links: DataFrame, cached: DataFrame, sitemap: DataFrame, view: DataFrame, search: DataFrame, users: DataFrame, attachments: DataFrame) -> DataFrame:
    """``links`` (page_id, kind, key, space) with title and url, both null where nothing has the link, and ``local``: whether the url is a path of the sitemap.

    cached (kind, key, space, title, url); sitemap (title, path); view (page_id, label, href); search (title, space, url, rank); users
    (user_key, title, url); attachments (page_id, name, title, url). Of several rows of a key the least by its other columns is taken.

    All sides are one table of places by (side, key), and every link asks it once for each place where it may be, best first; so there is one join, and the best answer
    of a link is one aggregate. A target that very many links have is a skewed key of this join, whose partitions Spark splits.
    """
    text, none = (lambda c: F.col(c).cast("string")), F.lit("")
    bare, fragment = F.regexp_extract("key", "^([^#]*)", 1), F.regexp_extract("key", "(#.*)$", 1)
    # a link that names no space has an empty one or none
    space = F.coalesce(text("space"), none)

    def places(df: DataFrame, side: str, key: tuple, title, url, rank=none) -> DataFrame:
        named = [x.alias(n) for n, x in zip(("_a", "_b", "_c"), (*key, *[none] * (3 - len(key))), strict=True)]
        return df.select(F.lit(side).alias("_side"), *named, rank.cast("string").alias("_rank"), title.alias("_title"), url.alias("_url"))

    unknown = F.lit(None).cast("string")
    known = places(cached, "cached", (text("kind"), text("key"), space), text("title"), text("url"))
    for more in (
        places(sitemap, "site", (text("title"),), unknown, text("path")),
        places(view, "view", (text("page_id"), text("label")), unknown, text("href")),
        places(search, "search", (text("title"), space), unknown, text("url"), text("rank")),
        places(users, "user", (text("user_key"),), text("title"), text("url")),
        places(attachments, "file", (text("page_id"), text("name")), text("title"), text("url")),
    ):
        known = known.unionByName(more)
    at = ["_side", "_a", "_b", "_c"]
    known = known.groupBy(*at).agg(F.min(F.struct("_rank", "_title", "_url")).alias("_r")).select(*at, "_r._title", "_r._url")
    page, user, file = (F.col("kind") == k for k in ("page", "user", "attachment"))

    def ask(when, order: int, side: str, *key, tail=none):
        wide = (*key, *[none] * (3 - len(key)))
        return F.when(when, F.struct(F.lit(order).alias("_order"), F.lit(side).alias("_side"), *(x.alias(n) for n, x in zip(("_a", "_b", "_c"), wide, strict=True)), tail.alias("_tail")))

    asks = F.array(
        ask(F.lit(True), 0, "cached", text("kind"), text("key"), space),
        # a title may hold the sign that begins a fragment, so the whole key is looked up first
        ask(page, 1, "site", text("key")),
        ask(page & (fragment != ""), 2, "site", bare, tail=fragment),
        ask(page, 3, "view", text("page_id"), text("key")),
        ask(page, 4, "search", text("key"), space),
        ask(page & (fragment != ""), 5, "search", bare, space),
        ask(user, 6, "user", text("key")),
        ask(file, 7, "file", text("page_id"), text("key")),
    )
    each = links.select(*links.columns, F.explode(F.filter(asks, lambda x: x.isNotNull())).alias("_ask")).select(*links.columns, "_ask.*")
    each = each.join(known, at, "left")
    local = F.col("_order").isin(1, 2)
    hit = F.when(F.col("_url").isNotNull(), F.struct("_order", F.concat("_url", "_tail").alias("url"), local.alias("local")))
    # rows that are equal stay as many; each has one first question
    best = each.groupBy(*links.columns).agg(F.min(hit).alias("_hit"), F.min(F.when(F.col("_title").isNotNull(), F.struct("_order", "_title"))).alias("_named"), F.count_if(F.col("_order") == 0).alias("_n"))
    best = best.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int"))))
    title = F.coalesce("_named._title", F.when(F.col("_hit").isNotNull(), text("key")))
    return best.select(*links.columns, title.alias("title"), F.col("_hit.url").alias("url"), F.coalesce("_hit.local", F.lit(False)).alias("local"))


def _first(side: DataFrame, *keys: str) -> DataFrame:
    """One row a key."""
    rest = [c for c in side.columns if c not in keys]
    return side.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")


def resolve_local(links: DataFrame, view: DataFrame, attachments: DataFrame) -> DataFrame:
    """As ``resolve`` from what a page brings along: its rendered view and its attachments. Users and other pages' links stay open."""
    rows = links.alias("l")
    is_page, is_file = F.col("l.kind") == "page", F.col("l.kind") == "attachment"
    rows = rows.join(_first(view, "page_id", "label").alias("v"), is_page & (F.col("l.page_id") == F.col("v.page_id")) & (F.col("l.key") == F.col("v.label")), "left")
    rows = rows.join(_first(attachments, "page_id", "name").alias("a"), is_file & (F.col("l.page_id") == F.col("a.page_id")) & (F.col("l.key") == F.col("a.name")), "left")
    url = F.coalesce(F.col("v.href"), F.col("a.url"))
    return rows.select("l.*", F.coalesce(F.col("a.title"), F.when(url.isNotNull(), F.col("l.key"))).alias("title"), url.alias("url"))


def rendered(resolved: DataFrame) -> DataFrame:
    """What a link prints as: an unresolved one points to a stand-in and is labelled by its key."""
    label = F.coalesce("title", F.concat(F.lit("Links"), F.initcap("kind"), F.lit("["), F.col("key"), F.lit("]")))
    return resolved.withColumns({"url": F.coalesce("url", F.lit(MISSING)), "label": label})


def anchors(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(anchor, path) of the three ways to declare an anchor; the first file by path has it."""
    forms = (r"\[\[([A-Za-z0-9_:.\-]+)(?:,[^\]]*)?\]\]", r"\[#([A-Za-z0-9_:\-]+)[.%,\]]", r"anchor:([A-Za-z0-9_:.\-]+)\[")
    found = F.array_distinct(F.concat(*(F.regexp_extract_all(F.col(content), F.lit(p), F.lit(1)) for p in forms)))
    return files.select(F.col(path).alias("path"), F.explode(found).alias("anchor")).groupBy("anchor").agg(F.min("path").alias("path"))


def anchor_links(references: DataFrame, declared: DataFrame) -> DataFrame:
    """``references`` (path, anchor) with target: the declaring file where that is another one, else null for a link in the page."""
    at = references.alias("r").join(declared.alias("d"), (F.col("r.anchor") == F.col("d.anchor")) & (F.col("r.path") != F.col("d.path")), "left")
    return at.select("r.*", F.col("d.path").alias("target"))


def cross_path(base: Column, target: Column) -> Column:
    """A path as seen from a folder, by array functions: the shared start is dropped and each folder left over goes up."""
    split = lambda p: F.filter(F.split(p, "/"), lambda x: x != "")
    a, b = split(base), split(target)
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)))
    same = F.when(F.least(F.size(a), F.size(b)) > 0, same).otherwise(0)
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - same), F.slice(b, same + 1, F.size(b))), "/")
