"""Registered queries of the document engine, each with DuckDB SQL of the same rows where SQL can say it.

``pages`` and ``documents`` are the corpora; the star-schema tables only carry shapes (paging, trees, lookups) that the corpora lack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import construct_queries, function_queries, tool_queries, tree_queries
from docspark.functions import columns as c
from docspark.operators import anonymize, blocks, convert, links, publish, relational, sitemap, split
from docspark.sources.pages import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(tool_queries.QUERIES | construct_queries.QUERIES | function_queries.QUERIES | tree_queries.QUERIES)
ORACLE_SQL: dict[str, str] = dict(tool_queries.ORACLE_SQL | construct_queries.ORACLE_SQL | function_queries.ORACLE_SQL | tree_queries.ORACLE_SQL)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _title() -> Column:
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages")


_T = "regexp_extract(html, '<title>([^<]*)</title>', 1)"

# ---- scans, projections, predicates ----


@query(f"SELECT page_id, {_T} AS title, length(html) AS n FROM pages")
def page_title(spark, d):
    return _pages(spark, d).select("page_id", _title().alias("title"), F.length("html").cast("long").alias("n"))


@query("SELECT page_id, url, html FROM pages WHERE page_id = 7")
def page_by_id(spark, d):
    return _pages(spark, d).filter("page_id = 7")


_LINKS = """SELECT page_id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS tag
 FROM (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*\\bhref="[^"]*"[^>]*>[^<]*</a>') AS m FROM pages)"""


@query(f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(tag, 'href="([^"]*)"', 1) AS href,
 trim(regexp_replace(regexp_replace(tag, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS label FROM ({_LINKS})""")
def page_links(spark, d):
    return links.page_links(_pages(spark, d))


@query(f"""SELECT page_id, label, arg_max(href, pos) AS href FROM (SELECT page_id, pos, regexp_extract(tag, 'href="([^"]*)"', 1) AS href,
 trim(regexp_replace(tag, '<[^>]+>', '', 'g')) AS label FROM ({_LINKS})) WHERE label <> '' AND trim(href) <> '' GROUP BY ALL""")
def view_link_map(spark, d):
    return links.view_map(links.page_links(_pages(spark, d)))


@query("""SELECT lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/.*$', '')) AS host, count(*) AS n FROM pages GROUP BY 1""")
def hosts_counted(spark, d):
    return _pages(spark, d).groupBy(c.authority("url").alias("host")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, source FROM documents WHERE lower(lang) = 'de' AND n_chars > 1000")
def predicate_pushdown(spark, d):
    return read_table(spark, d, "documents").filter((F.lower("lang") == "de") & (F.col("n_chars") > 1000)).select("doc_id", "lang", "source")


# ---- scalar functions ----


@query(f"""SELECT page_id, CASE WHEN trim(s) = '' THEN 'page' ELSE s END AS folder FROM (SELECT page_id,
 regexp_replace(regexp_replace(trim({_T}), '[<>:"/\\\\|?*\\x00-\\x1F]', '_', 'g'), '[. ]+$', '') AS s FROM pages)""")
def sanitize_folder(spark, d):
    return _pages(spark, d).select("page_id", c.safe_folder(_title()).alias("folder"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def html_escape(spark, d):
    return read_table(spark, d, "documents").select("doc_id", c.html_escape("text").alias("escaped"))


@query("SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def storage_attribute(spark, d):
    return _pages(spark, d).select("page_id", c.storage_attribute("url").alias("escaped"))


@query("SELECT doc_id, '<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' AS p FROM documents")
def xml_paragraph(spark, d):
    return read_table(spark, d, "documents").select("doc_id", c.xml_paragraph("text").alias("p"))


@query("SELECT doc_id, '<![CDATA[' || replace(text, ']]>', ']]]]><![CDATA[>') || ']]>' AS wrapped FROM documents")
def cdata_wrap(spark, d):
    return read_table(spark, d, "documents").select("doc_id", c.cdata("text").alias("wrapped"))


@query(r"SELECT doc_id, regexp_replace(text, '([\\`*_\[\]<])', '\\\1', 'g') AS escaped FROM documents")
def markdown_escape(spark, d):
    return read_table(spark, d, "documents").select("doc_id", c.markdown_escape("text").alias("escaped"))


@query(r"SELECT doc_id, replace(text, '|', '\|') AS adoc, replace(replace(text, '|', '\|'), chr(10), '<br>') AS md FROM documents")
def cell_escape(spark, d):
    return read_table(spark, d, "documents").select("doc_id", c.adoc_cell("text").alias("adoc"), c.markdown_cell("text").alias("md"))


@query("""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10)) AS quoted,
 array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN x ELSE '  ' || x END), chr(10)) AS indented FROM documents""")
def quote_and_indent(spark, d):
    return read_table(spark, d, "documents").select("doc_id", c.quote_lines("text").alias("quoted"), c.indent_lines("text", "  ").alias("indented"))


@query("SELECT doc_id, sha256(text) AS hash, sha256(source) || '-attachment-hash' AS key FROM documents")
def content_hash(spark, d):
    return read_table(spark, d, "documents").select("doc_id", c.content_hash("text").alias("hash"), c.attachment_key("source").alias("key"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS n, length(text) - length(replace(text, chr(10), '')) >= 10 AS long FROM documents")
def newline_threshold(spark, d):
    return read_table(spark, d, "documents").select("doc_id", c.newlines("text").cast("long").alias("n"), split.is_long("text", 10).alias("long"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS words FROM documents")
def parse_keywords(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.array_join(c.parse_keywords("text"), "|").alias("words"))


@query("""SELECT page_id, nullif(regexp_extract(url || '&pageId=' || page_id, 'pageId=(\\d+)', 1), '') AS id,
 regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS server,
 regexp_replace(regexp_replace(lower(trim(url)), '^.*?://', ''), '/.*$', '') AS authority,
 CASE WHEN lower(url) LIKE '%bitbucket%' OR lower(url) LIKE '%stash%' THEN 'BITBUCKET' WHEN lower(url) LIKE '%jira%' THEN 'JIRA' ELSE 'CONFLUENCE' END AS kind FROM pages""")
def url_parts(spark, d):
    whole = F.concat("url", F.lit("&pageId="), F.col("page_id").cast("string"))
    return _pages(spark, d).select("page_id", c.page_id(whole).alias("id"), c.server_url("url").alias("server"), c.authority("url").alias("authority"), c.service_kind("url").alias("kind"))


@query("""SELECT page_id, 'S' || (page_id % 7) AS space, 'P' || (page_id % 5) AS project FROM pages""")
def space_and_project_keys(spark, d):
    n = F.col("page_id")
    path = F.concat(F.lit("https://w/display/S"), (n % 7).cast("string"), F.lit("/T?x=1"))
    named = F.concat(F.lit("https://w/x?spaceKey=S"), (n % 7).cast("string"), F.lit("&y=2"))
    issue = F.concat(F.lit("https://j/browse/P"), (n % 5).cast("string"), F.lit("-"), (n + 1).cast("string"))
    return _pages(spark, d).select("page_id", c.space_key(F.when(n % 2 == 0, path).otherwise(named)).alias("space"), c.project_key(issue).alias("project"))


@query("""SELECT p_partkey, (SELECT name FROM (VALUES ('aqua',0,191,191),('black',0,0,0),('blue',0,0,191),('fuchsia',191,0,191),('gray',96,96,96),('green',0,96,0),('lime',0,191,0),
 ('maroon',96,0,0),('navy',0,0,96),('olive',96,96,0),('purple',96,0,96),('red',191,0,0),('silver',144,144,144),('teal',0,96,96),('white',191,191,191),('yellow',191,191,0)) v(name,r,g,b)
 ORDER BY (v.r-p_partkey%256)*(v.r-p_partkey%256)+(v.g-(p_partkey*7)%256)*(v.g-(p_partkey*7)%256)+(v.b-(p_partkey*13)%256)*(v.b-(p_partkey*13)%256), name LIMIT 1) AS colour FROM part""")
def nearest_colour(spark, d):
    k = F.col("p_partkey")
    return read_table(spark, d, "part").select("p_partkey", c.nearest_colour((k % 256).cast("int"), (k * 7 % 256).cast("int"), (k * 13 % 256).cast("int")).alias("colour"))


@query("SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'machinery' THEN 'tip' WHEN 'building' THEN 'note' WHEN 'household' THEN 'warning' ELSE 'info' END AS macro FROM customer")
def admonition_map(spark, d):
    names = {"MACHINERY": "TIP", "BUILDING": "caution", "HOUSEHOLD": "Important"}
    given = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), F.upper("c_mktsegment")), F.lit("NOTE"))
    return read_table(spark, d, "customer").select("c_custkey", c.macro_of_admonition(given).alias("macro"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'js' WHEN 1 THEN 'py' WHEN 2 THEN 'sql' ELSE NULL END AS language FROM part")
def code_language(spark, d):
    given = F.element_at(F.array(F.lit("JSON"), F.lit("python"), F.lit("Sql"), F.lit("brainfold")), F.col("p_size") % 4 + 1)
    return read_table(spark, d, "part").select("p_partkey", c.code_language(given).alias("language"))


@query("SELECT doc_id, 'text ~ \"' || replace(replace(source, '\\', '\\\\'), '\"', '\\\"') || '\" and space.key = \"' || lang || '\"' AS clause FROM documents")
def search_clause(spark, d):
    return read_table(spark, d, "documents").select("doc_id", c.search_clause("text", "~", "source", "lang").alias("clause"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_path(spark, d):
    return read_table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query()
def plain_title(spark, d):
    return _pages(spark, d).select("page_id", c.plain_title(_title()).alias("title"))


# ---- headers, ids, sections ----


@query("""SELECT doc_id, '= ' || source || chr(10) || ':confluency-id: ' || doc_id || chr(10) || ':keywords: ' || lang || ', ' || source || chr(10) || ':toc: macro' || chr(10) ||
 ':imagesdir: ./attache' || chr(10) || chr(10) || text || chr(10) AS content FROM documents""")
def adoc_header(spark, d):
    attributes = {"confluency-id": F.col("doc_id").cast("string"), "confluency-url": F.lit(None).cast("string")}
    content = c.header(F.col("source"), attributes, F.array("lang", "source"), F.col("text"), "adoc")
    return read_table(spark, d, "documents").select("doc_id", content.alias("content"))


@query("""SELECT doc_id, '---' || chr(10) || 'confluency-id: ' || doc_id || chr(10) || 'tags:' || chr(10) || '  - ' || lang || chr(10) || '---' || chr(10) || chr(10) || '# ' || source || chr(10) || chr(10) ||
 text || chr(10) AS content FROM documents""")
def markdown_front_matter(spark, d):
    content = c.header(F.col("source"), {"confluency-id": F.col("doc_id").cast("string")}, F.array("lang"), F.col("text"), "md")
    return read_table(spark, d, "documents").select("doc_id", content.alias("content"))


@query("SELECT doc_id, '= ' || source || chr(10) || ':confluency-id: ' || (doc_id + 1) || chr(10) || text AS content FROM documents")
def write_back_id(spark, d):
    rows = read_table(spark, d, "documents").withColumn("first", c.insert_id(F.concat(F.lit("= "), "source", F.lit("\n"), "text"), F.lit("9")))
    return rows.select("doc_id", c.replace_id("first", (F.col("doc_id") + 1).cast("string")).alias("content"))


@query("""SELECT doc_id, CAST(part AS INTEGER) AS part, CASE WHEN part = 0 THEN 'index.md' ELSE part || '_' || part || '.md' END AS file FROM
 (SELECT doc_id, unnest(range(0, 1 + len(string_split(text, chr(10))))) AS part FROM documents)""")
def section_numbering(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("## "), (i + 1).cast("string"), F.lit("\n"), x))
    rows = read_table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    return split.sections(rows, form="md").select("doc_id", "part", "file")


@query("""SELECT doc_id, CAST(part AS INT) AS part, title, file, content FROM (
 SELECT doc_id, 0 AS part, NULL AS title, 'index.adoc' AS file, 'intro' || chr(10) || chr(10) || 'include::1_One.adoc[]' || chr(10) || chr(10) || 'include::2_Two.adoc[]' AS content FROM documents
 UNION ALL SELECT doc_id, 1, 'One', '1_One.adoc', ':imagesdir: ./attache' || chr(10) || '== One' || chr(10) || text FROM documents
 UNION ALL SELECT doc_id, 2, 'Two', '2_Two.adoc', ':imagesdir: ./attache' || chr(10) || '== Two' || chr(10) || 'end' FROM documents)""")
def split_adoc(spark, d):
    text = F.concat(F.lit("intro\n== One\n"), "text", F.lit("\n== Two\nend"))
    return split.sections(read_table(spark, d, "documents").select("doc_id", text.alias("text")), form="adoc")


# ---- joins, aggregations, windows, recursion ----


@query("""SELECT p.page_id, l.label, coalesce(t.url, 'http://mock') AS url FROM (SELECT page_id, label FROM (SELECT page_id, trim(regexp_replace(tag, '<[^>]+>', '', 'g')) AS label FROM (""" + _LINKS + f""")) GROUP BY ALL) l
 JOIN pages p USING (page_id) LEFT JOIN (SELECT {_T} AS title, min(url) AS url FROM pages GROUP BY 1) t ON t.title = l.label""")
def link_resolution(spark, d):
    pages = _pages(spark, d)
    wanted = links.page_links(pages).select("page_id", F.lit("page").alias("kind"), F.col("label").alias("key"), F.lit(None).cast("string").alias("space")).distinct()
    search = pages.select(_title().alias("title"), F.lit(None).cast("string").alias("space"), "url", F.col("url").alias("rank"))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    out = links.resolve(
        wanted, empty("kind string, key string, space string, title string, url string"), empty("title string, path string"), empty("page_id long, label string, href string"), search,
        empty("user_key string, title string, url string"), empty("page_id long, name string, title string, url string"),
    )
    return links.rendered(out).select("page_id", F.col("key").alias("label"), "url")


@query("""SELECT a.page_id, a.anchor, b.page_id AS target FROM (SELECT page_id, page_id % 50 AS anchor FROM pages) a
 LEFT JOIN (SELECT page_id % 60 AS anchor, min(page_id) AS page_id FROM pages GROUP BY 1) b ON a.anchor = b.anchor AND a.page_id <> b.page_id""")
def anchor_theta_join(spark, d):
    pages = _pages(spark, d)
    declared = pages.groupBy((F.col("page_id") % 60).alias("anchor")).agg(F.min("page_id").alias("path"))
    found = links.anchor_links(pages.select(F.col("page_id").alias("path"), (F.col("page_id") % 50).alias("anchor")), declared)
    return found.select(F.col("path").alias("page_id"), "anchor", "target")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Is In N' WHEN 1 THEN ' HOLDS n' ELSE 'nothing' END || p_size AS wanted,
 'T' || CASE WHEN p_partkey % 3 = 1 AND p_size % 2 = 1 AND p_size - 1 IN (SELECT n_nationkey FROM nation) THEN p_size - 1 WHEN p_partkey % 3 < 2 AND p_size IN (SELECT n_nationkey FROM nation) THEN p_size END AS type FROM part""")
def link_type_join(spark, d):
    # an odd nation's outward label is also that of the nation before it, which comes first
    types = read_table(spark, d, "nation").selectExpr("concat('T', n_nationkey) AS name", "concat('is in n', n_nationkey) AS inward", "concat('holds n', n_nationkey) AS outward", "n_nationkey AS ord")
    more = types.filter("ord % 2 = 0").selectExpr("name", "inward", "concat('Holds N', ord + 1) AS outward", "ord")
    wanted = read_table(spark, d, "part").selectExpr("p_partkey", "concat(element_at(array('Is In N', ' HOLDS n', 'nothing'), CAST(p_partkey % 3 + 1 AS INT)), p_size) AS wanted")
    found = relational.link_types(wanted.select("wanted").distinct(), types.unionByName(more))
    return wanted.join(found, "wanted").select("p_partkey", "wanted", "type")


@query("""SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'JIRA' WHEN 1 THEN 'CONFLUENCE' ELSE 'BITBUCKET' END AS kind,
 CASE page_id % 3 WHEN 0 THEN 'j2' WHEN 1 THEN 'c1' ELSE 'c1' END AS host FROM pages""")
def endpoint_route(spark, d):
    endpoints = spark.createDataFrame([("c1", "CONFLUENCE", False, 0), ("j1", "JIRA", False, 1), ("j2", "JIRA", True, 2)], "host string, kind string, is_primary boolean, ord int")
    kind = F.element_at(F.array(F.lit("JIRA"), F.lit("CONFLUENCE"), F.lit("BITBUCKET")), (F.col("page_id") % 3 + 1).cast("int"))
    return relational.route(_pages(spark, d).select(F.col("page_id").alias("id"), kind.alias("kind")), endpoints)


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 1 OR n_chars % 5 = 0")
def unchanged_anti(spark, d):
    docs = read_table(spark, d, "documents").withColumn("hash", c.content_hash("text"))
    stored = docs.filter("doc_id % 3 <> 1").select("doc_id", F.when(F.col("n_chars") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return relational.changed(docs, stored, "doc_id", "hash").select("doc_id")


@query("""SELECT CASE WHEN doc_id % 3 = 1 THEN 'created' WHEN n_chars % 5 = 0 THEN 'updated' ELSE 'skipped' END AS action, count(*) AS n,
 sum(CASE WHEN doc_id % 3 = 1 THEN 1 WHEN n_chars % 5 = 0 THEN 8 ELSE 7 END) AS numbers FROM documents GROUP BY 1""")
def publish_actions(spark, d):
    docs = read_table(spark, d, "documents").withColumn("hash", c.content_hash("text"))
    stored = docs.filter("doc_id % 3 <> 1").select("doc_id", F.lit(7).alias("number"), F.when(F.col("n_chars") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return relational.actions(docs, stored, "doc_id", "hash").groupBy("action").agg(F.count("*").alias("n"), F.sum("number").alias("numbers"))


@query("""SELECT count(*) FILTER (doc_id % 4 = 0) AS created, count(*) FILTER (doc_id % 4 = 1) AS updated, count(*) FILTER (doc_id % 4 = 2) AS skipped, count(*) FILTER (doc_id % 4 = 3) AS failed,
 count(*) FILTER (doc_id % 4 = 3) AS parsed FROM documents""")
def status_counters(spark, d):
    kinds = F.array(*(F.lit(x) for x in ("created", "updated", "skipped", "failed")))
    rows = read_table(spark, d, "documents").select(F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("action"))
    return relational.summary(rows).select("created", "updated", "skipped", "failed", relational.failed_of(F.col("line")).cast("long").alias("parsed"))


@query("SELECT source, arg_min(doc_id, doc_id) AS first_doc, arg_max(doc_id, doc_id) AS last_doc FROM documents GROUP BY source")
def first_and_last_wins(spark, d):
    docs = read_table(spark, d, "documents").select("source", "doc_id", F.col("doc_id").alias("o"))
    first = relational.first_wins(docs, ["source"], "doc_id", "o").withColumnRenamed("doc_id", "first_doc")
    return first.join(relational.last_wins(docs, ["source"], "doc_id", "o").withColumnRenamed("doc_id", "last_doc"), "source")


@query("""SELECT l_orderkey, max(w) AS width FROM (SELECT l_orderkey, l_linenumber % 3 AS row_no, sum(CAST(l_quantity AS INTEGER) % 4 + 1) AS w FROM lineitem GROUP BY ALL) GROUP BY 1""")
def table_width(spark, d):
    cells = read_table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("row_no"), (F.col("l_quantity").cast("int") % 4 + 1).alias("colspan"))
    return relational.table_width(cells, ["l_orderkey"]).withColumn("width", F.col("width").cast("long"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 200")
def page_window(spark, d):
    return relational.page(read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 200, 5000).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS BIGINT) AS page_no FROM orders")
def offset_pager(spark, d):
    return relational.numbered_pages(read_table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", "page_no")


@query(f"""WITH t AS (SELECT page_id, CASE WHEN lower({_T}) = 'the' THEN 1 WHEN lower({_T}) LIKE 'the%' THEN 2 WHEN lower(html) LIKE '%the%' THEN 3 END AS tier FROM pages)
 SELECT page_id, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def search_tiers(spark, d):
    title = F.lower(_title())
    return relational.first_tier(_pages(spark, d), [title == "the", title.startswith("the"), F.lower("html").contains("the")]).select("page_id", "tier")


@query("""WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS parent_id, 'n' || n_nationkey AS child_id, n_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_name FROM customer),
 t(id, title, path, depth) AS (SELECT 'r' || r_regionkey, r_name, r_name, 0 FROM region UNION ALL SELECT e.child_id, e.title, t.path || '/' || e.title, t.depth + 1 FROM t JOIN e ON e.parent_id = t.id)
 SELECT id, title, path, depth FROM t""")
def sitemap_closure(spark, d):
    nation, region = read_table(spark, d, "nation"), read_table(spark, d, "region")
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    edges = nation.select(key("r", "n_regionkey").alias("parent_id"), key("n", "n_nationkey").alias("child_id"), F.col("n_name").alias("title"))
    edges = edges.unionByName(read_table(spark, d, "customer").select(key("n", "c_nationkey").alias("parent_id"), key("c", "c_custkey").alias("child_id"), F.col("c_name").alias("title")))
    return sitemap.closure(edges, region.select(key("r", "r_regionkey").alias("id"), F.col("r_name").alias("title")), depth=4)


@query("""SELECT DISTINCT array_to_string(parts[1:i], '/') AS folder, i AS depth FROM (SELECT string_split(source || '/' || lang || '/' || doc_id, '/') AS parts, unnest([1, 2]) AS i FROM documents)""")
def folder_tree(spark, d):
    return sitemap.folder_tree(read_table(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '../' || lang || '/' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS path FROM documents""")
def relative_cross_link(spark, d):
    other = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("/x"))).otherwise(F.concat("lang", F.lit("/y")))
    base = F.concat("source", F.lit("/"), F.lit("a"))
    target = F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.lit("a")), F.lit("/"), F.col("doc_id").cast("string"))
    return read_table(spark, d, "documents").withColumn("_o", other).select("doc_id", links.cross_path(base, target).alias("path"))


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user
 FROM conversations""")
def carried_level(spark, d):
    rows = read_table(spark, d, "conversations").select(F.col("conv_id").alias("page_id"), F.lit(0).alias("parent_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", "heading").otherwise("p").alias("kind"), (F.col("turn") + 1).alias("level"), "role")
    out = relational.heading_levels(rows)
    return out.select(F.col("page_id").alias("conv_id"), F.col("ord").alias("turn"), "role", F.when(F.col("under") > 0, F.col("under") - 1).alias("last_user"))


@query("""SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS thread, count(*) AS n FROM conversations GROUP BY conv_id""")
def comment_threads(spark, d):
    rows = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.count("*").alias("n"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("thread"), "n")


@query("""SELECT doc_id, max(CASE WHEN v = 1 THEN source END) AS old_text, max(CASE WHEN v = 2 THEN lang END) AS new_text FROM documents, (VALUES (1), (2)) t(v) GROUP BY doc_id""")
def version_pair(spark, d):
    docs = read_table(spark, d, "documents")
    rows = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("version"), F.col("source").alias("text")), F.struct(F.lit(2).alias("version"), F.col("lang").alias("text")))).alias("v"))
    return relational.version_pair(rows.select("doc_id", "v.version", "v.text"), "doc_id", 1, 2)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ',x' ELSE lang END AS labels FROM documents")
def label_union(spark, d):
    from docspark.sources.sinks import add_labels

    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.array("lang").alias("labels"))
    more = docs.filter("page_id % 2 = 0").select("page_id", F.array_union("labels", F.array(F.lit("x"))).alias("labels"))
    return add_labels(docs, more).select(F.col("page_id").alias("doc_id"), F.array_join("labels", ",").alias("labels"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE source END AS source FROM documents")
def upsert_rows(spark, d):
    from docspark.sources.sinks import upsert

    docs = read_table(spark, d, "documents").select("doc_id", "source")
    return upsert(docs, docs.filter("doc_id % 10 = 0").withColumn("source", F.lit("new")), ["doc_id"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_write(spark, d):
    from docspark.sources.sinks import last_write as last

    return last(read_table(spark, d, "events"), ["user_id"], "event_type", "event_id")


# ---- documents: where there is no SQL form, tests hold them against expected texts ----


@query()
def html_to_markdown(spark, d):
    return convert.to_text(_pages(spark, d), form="md", options=blocks.Options(container_tags=frozenset(("article", "nav", "footer"))))


@query()
def html_to_adoc(spark, d):
    return convert.to_text(_pages(spark, d), form="adoc")


@query()
def blocks_exploded(spark, d):
    return convert.block_rows(_pages(spark, d).drop("url"))


@query()
def adoc_to_storage(spark, d):
    files = read_table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".adoc")).alias("path"), F.concat(F.lit("= T\n\n== H\n\n"), "text").alias("content"))
    return publish.to_storage(files).drop("content")


@query()
def anonymize_text(spark, d):
    return anonymize.anonymize_adoc(read_table(spark, d, "documents").select("doc_id", "text"))


@query()
def anonymize_pages(spark, d):
    return anonymize.anonymize_html(_pages(spark, d))


@query("SELECT event_id, props FROM events")
def anonymize_events(spark, d):
    return anonymize.anonymize_json(read_table(spark, d, "events").select("event_id", "props"), text="props")


@query("SELECT page_id, 'files/include_file_1' AS path, repeat(url || chr(10), 11) || url AS content FROM pages")
def page_files(spark, d):
    storage = F.concat(F.lit('<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA['), F.repeat(F.concat("url", F.lit("\n")), 12), F.lit("]]></ac:plain-text-body></ac:structured-macro>"))
    return convert.files_of(_pages(spark, d).select("page_id", storage.alias("html")))


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: every page's title and Markdown, with a hash of it."""
    made = convert.to_text(_pages(spark, "/root/testdata/sf0.001"), form="md", options=blocks.Options(container_tags=frozenset(("article", "nav", "footer"))))
    return made.select("page_id", "url", "title", "text", c.content_hash("text").alias("sha"))
