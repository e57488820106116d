"""Export and publish of page trees as plans of joins around the narrow conversion stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.columns import ID_ATTRIBUTE, content_hash, file_title, header, normal_path, replace_id
from docspark.operators import blocks, diagrams, includes, links
from docspark.operators.convert import link_rows, to_text
from docspark.operators.publish import to_storage
from docspark.operators.relational import actions, changed
from docspark.operators.sitemap import closure, publish_roots
from docspark.operators.split import LONG, is_long, sections
from docspark.shared import cut, keyed, stored


#: What can be left out of an export: the sides from which links are resolved.
SIDES = {
    "cached": "kind string, key string, space string, title string, url string",
    "users": "user_key string, title string, url string",
    "attachments": "page_id string, name string, title string, url string",
}


def page_links_resolved(
    rows: DataFrame, pages: DataFrame, tree: DataFrame, form: str, sides: dict[str, DataFrame] | None = None, cross: bool = True, wanted: DataFrame | None = None
) -> DataFrame:
    """(page_id, kind, key, space, title, url) of the links of ``rows`` (page_id, path, storage) that something has; ``wanted`` are these links where they are known.

    A link to a page of ``tree`` is a path as seen from the linking page's folder; with ``cross`` off, it goes to the page's address.
    """
    spark = rows.sparkSession
    side = {k: (sides or {}).get(k) for k in SIDES}
    if side["attachments"] is None and "attachments" in pages.columns:
        side["attachments"] = pages.select("page_id", F.explode("attachments").alias("name", "a")).select("page_id", "name", F.coalesce("a.title", "name").alias("title"), "a.url")
    side = {k: spark.createDataFrame([], SIDES[k]) if v is None else v for k, v in side.items()}
    wanted = link_rows(rows.select("page_id", "storage"), "storage").drop("ord") if wanted is None else wanted
    local = tree.select("title", F.concat("path", F.lit(f"/index.{form}")).alias("path")).filter(F.lit(cross))
    view = links.view_map(links.page_links(pages.select("page_id", "view"), "view")) if "view" in pages.columns else spark.createDataFrame([], "page_id string, label string, href string")
    found = pages.select("title", "space" if "space" in pages.columns else F.lit(None).cast("string").alias("space"), "url" if "url" in pages.columns else F.lit(None).cast("string").alias("url"))
    anywhere = found.withColumn("space", F.lit(None).cast("string")).unionByName(found.filter("space is not null")).filter("url is not null").withColumn("rank", F.col("url"))
    out = links.resolve(wanted, side["cached"], local, view, anywhere, side["users"], side["attachments"]).filter("url is not null")
    out = out.join(rows.select("page_id", "path"), "page_id")
    return out.select("page_id", "kind", "key", "space", "title", F.when(F.col("local"), links.cross_path(F.col("path"), F.col("url"))).otherwise(F.col("url")).alias("url"))


def export_tree(
    pages: DataFrame, edges: DataFrame, root: str | None = None, space: str | None = None, form: str = "adoc", state: DataFrame | None = None, sides: dict[str, DataFrame] | None = None,
    children: bool = True, colours: bool = True, cross: bool = True, lines: int = LONG, attached: DataFrame | None = None, debug: bool = False,
) -> DataFrame:
    """(path, page_id, version_when, content) of every file of the pages below a root, or of a space's roots; with ``state`` only of pages whose version changed.

    With ``attached`` (page_id, name, bytes), the pages' attachments and the diagrams put together from them are files too, in a further column ``bytes``; a diagram of which nothing can be
    shown is told of. With ``debug``, what each page was made from lies in its folder ``source``.

    A page is a folder with an index file. Its links and its list of children are resolved by joins and travel with its row; a page of ``lines`` lines or more is cut at
    its headings, and long code goes to files of its own. Without ``children`` only the roots themselves are exported.
    """
    top = pages.filter(F.col("page_id") == root) if root else pages
    if space:
        top = top.filter(F.col("space") == space)
    if not root:
        top = top.join(edges.select(F.col("child_id").alias("page_id")), "page_id", "left_anti")
    tree = closure(edges, top.select(F.col("page_id").alias("id"), "title"), None if children else 0)
    wanted = pages if state is None else changed(pages, state, "page_id", "version_when")
    rows = keyed(wanted, "page_id").join(tree.select(F.col("id").alias("page_id"), "path"), "page_id")
    form = "md" if form.lower() in ("md", "markdown") else "adoc"
    wanted_links = link_rows(rows.select("page_id", "storage"), "storage", diagrams=attached is not None, deal=False).drop("ord")
    if attached is not None:
        wanted_links = cut(wanted_links)  # parsed once for links and diagrams
    known = page_links_resolved(rows, pages, tree, form, sides, cross, wanted_links.filter("kind <> 'diagram'"))
    if attached is not None:
        own = attached.join(rows.select("page_id"), "page_id", "left_semi").select("page_id", "name", "bytes")
        shown = cut(diagrams.assembled(wanted_links.filter("kind = 'diagram'").select("page_id", F.col("key").alias("diagram")), own))
        none = F.lit(None).cast("string")
        known = known.unionByName(shown.select("page_id", F.lit("diagram").alias("kind"), F.col("diagram").alias("key"), none.alias("space"), F.col("diagram").alias("title"), F.col("file").alias("url")))
    known = known.groupBy("page_id").agg(F.collect_list(F.struct("kind", "key", "space", "title", "url")).alias("_links"))
    below = edges.join(tree.select(F.col("id").alias("child_id"), F.col("path").alias("_to")), "child_id").join(rows.select(F.col("page_id").alias("parent_id"), "path"), "parent_id")
    order = F.col("ord") if "ord" in edges.columns else F.lit(0)
    entry = F.struct(order.alias("ord"), "title", links.cross_path(F.col("path"), F.concat("_to", F.lit(f"/index.{form}"))).alias("url"))
    below = below.groupBy(F.col("parent_id").alias("page_id")).agg(F.array_sort(F.collect_list(entry)).alias("_children"))
    rows = rows.withColumnRenamed("title", "page_title").join(known, "page_id", "left").join(below, "page_id", "left")
    named = {"confluency-id": "page_id", "confluency-version": "version_when", "confluency-url": "url", "confluency-space": "space", "confluency-author": "author", "confluency-created": "created"}
    options = blocks.Options(in_memory=False, colours=colours)
    made = to_text(rows, "storage", form, options, "attache" if form == "md" else None, "_links", "_children", deal=False)
    attributes = {k: F.col(v).cast("string") for k, v in named.items() if v in made.columns}
    labels = F.col("labels") if "labels" in made.columns else F.array().cast("array<string>")
    content = header(F.col("page_title"), attributes, labels, F.col("text"), form)
    keep = ["path", "page_id", *(c for c in ("version_when",) if c in made.columns)]
    # a page's text and the files beside it come from one conversion
    index = F.array(F.struct(F.lit(None).cast("string").alias("path"), content.alias("content")))
    each = made.select(*keep, F.explode(F.concat(index, "files")).alias("f")).select(*keep, F.col("f.path").alias("_file"), "f.content")
    every = sections(each, "content", form, whole=F.col("_file").isNotNull() | ~is_long("content", lines)).select(*keep, F.coalesce("_file", "file").alias("file"), "content")
    if debug:
        every = every.unionByName(sources_of(rows, keep))
    if attached is not None:
        made_files = shown.filter("file is not null").select("page_id", F.col("file").alias("name"), "bytes")
        files = own.filter("bytes is not null").groupBy("page_id", "name").agg(F.min("bytes").alias("bytes")).join(made_files, ["page_id", "name"], "left_anti").unionByName(made_files.distinct())
        files = files.join(rows.select(*keep), "page_id").select(*keep, F.concat(F.lit("attache/"), "name").alias("file"), F.lit(None).cast("string").alias("content"), "bytes")
        every = every.withColumn("bytes", F.lit(None).cast("binary")).unionByName(files)
    return every.select(F.concat_ws("/", "path", "file").alias("path"), *keep[1:], "content", *(["bytes"] if attached is not None else []))


def sources_of(rows: DataFrame, keep: list[str]) -> DataFrame:
    """What each page was made from: its storage markup, its rendered view, the whole row and its resolved links."""
    row = [c for c in rows.columns if c not in ("path", "_links", "_children")]
    kinds = {"storage.html": F.col("storage"), "view.html": F.col("view") if "view" in rows.columns else F.lit(None).cast("string"), "page.json": F.to_json(F.struct(*row)), "links.json": F.to_json("_links")}
    files = F.array(*(F.struct(F.lit(f"source/{k}").alias("file"), v.alias("content")) for k, v in kinds.items()))
    return rows.select(*keep, F.explode(files).alias("f")).select(*keep, "f.file", "f.content").filter("content is not null")


def with_links(rows: DataFrame, pages: DataFrame, form: str, sides: dict[str, DataFrame] | None = None, fast: bool = False) -> DataFrame:
    """``rows`` (page_id, storage, ...) with ``_links``, their resolved links: from all that is known or, ``fast``, from what a page brings along."""
    spark = rows.sparkSession
    if fast:
        wanted = link_rows(rows.select("page_id", "storage"), "storage").drop("ord")
        none = spark.createDataFrame([], "page_id string, label string, href string")
        view = links.view_map(links.page_links(rows.select("page_id", "view"), "view")) if "view" in rows.columns else none
        files = (sides or {}).get("attachments")
        found = links.resolve_local(wanted, view, spark.createDataFrame([], SIDES["attachments"]) if files is None else files).filter("url is not null")
    else:
        nowhere = spark.createDataFrame([], "title string, path string")
        found = page_links_resolved(rows.withColumn("path", F.lit("")), pages, nowhere, form, sides)
    found = found.groupBy("page_id").agg(F.collect_list(F.struct("kind", "key", "space", "title", "url")).alias("_links"))
    return rows.join(found, "page_id", "left")


def publishable(files: DataFrame) -> DataFrame:
    """``files`` (path, content) without those whose header says that they stay unpublished. Order is for who writes: sorting contents here would be undone by the joins that follow."""
    mark = F.lower(F.trim(F.regexp_extract("content", rf"(?m)^{ID_ATTRIBUTE}[ \t]*(.*)$", 1)))
    return files.filter(F.coalesce(mark != "ignore", F.lit(True)))


def publish_files(files: DataFrame, deal: bool = True) -> DataFrame:
    """The AsciiDoc files of a tree (path, content) as storage markup; titles of other files and the files of anchors come by joins on what each file names.

    Other files of the tree are what its directives include. Contents move once at most, to meet what other files have for them; in a tree where no file names a page or an anchor, there is nothing
    to meet. ``deal`` is False where the rows are dealt already.
    """
    is_page = F.lower("path").endswith(".adoc")
    named_somewhere = files.agg(F.bool_or(F.col("content").rlike(r"\.adoc|<<|xref:")).alias("x")).first().x
    roots = publish_roots(files.filter(is_page)).select(F.col("folder").alias("_folder"), F.col("root").alias("_root"))
    plain, made = (x.filter(is_page) for x in includes.parted(files))
    if not named_somewhere:
        return to_storage((keyed(plain, "path") if deal else plain).unionByName(made), deal=False)
    files = plain.unionByName(stored(made))  # read several times
    tokens = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?<![A-Za-z0-9_./%-])[A-Za-z0-9_./%-]+\.adoc"), F.lit(0)))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    points = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?:<<|xref:)#?([A-Za-z0-9_:.\-]+)"), F.lit(1)))
    asking = files.select("path", folder.alias("_folder"), tokens.alias("_tokens"), points.alias("_points")).filter((F.size("_tokens") > 0) | (F.size("_points") > 0))
    # a target is seen from the folder of its file, else from the root of the tree
    asking = cut(asking.join(roots, "_folder", "left"))
    seen = F.flatten(F.transform("_tokens", lambda t: F.array(normal_path("_folder", t), normal_path(F.coalesce("_root", F.lit("")), t))))
    named = asking.select("path", F.explode(F.array_distinct(seen)).alias("other"))
    titles = files.select(F.col("path").alias("other"), file_title("content", "path").alias("title"))
    titles = named.distinct().join(titles, "other").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("other", "title"))).alias("_titles"))
    declared = links.anchors(files).select("anchor", F.col("path").alias("file"))
    declared = asking.select("path", F.explode("_points").alias("anchor")).distinct().join(declared, "anchor")
    declared = declared.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("anchor", "file"))).alias("_declared"))
    known = asking.select("path", "_root").distinct().join(titles, "path", "left").join(declared, "path", "left")
    return to_storage(keyed(files, "path").join(known, "path", "left"), titles="_titles", declared="_declared", root="_root", deal=False)


def publish_plan(rendered: DataFrame, remote: DataFrame) -> DataFrame:
    """(page_id, action, number) of rendered pages (page_id, storage) against stored ones (page_id, number, content_hash)."""
    current = rendered.select("page_id", content_hash("storage").alias("content_hash"))
    return actions(current, remote, "page_id", "content_hash")


def with_ids(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Files (path, content) with the page ids (path, page_id) written into their headers."""
    rows = files.join(ids, "path", "left")
    return rows.select("path", F.when(F.col("page_id").isNotNull(), replace_id("content", "page_id")).otherwise(F.col("content")).alias("content"))
