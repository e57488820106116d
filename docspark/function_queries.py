"""Registered queries of scans, functions, joins, plans and bundles on rows that are built from the driver's tables, each with SQL of the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import columns as c
from docspark.functions import tables
from docspark.functions.pure import ALIASES, LANGUAGES
from docspark.operators import anonymize, convert, links, relational, sitemap
from docspark.plans import bundles, export, requests
from docspark.shared import dealt
from docspark.sources import config, pages, sinks
from docspark.sources.pages import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple], names: str) -> str:
    show = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"


def _customers(spark, d, **made: str) -> DataFrame:
    return read_table(spark, d, "customer").selectExpr("c_custkey", *(f"{v} AS {k}" for k, v in made.items()))


# ---- scans ----


@query("""SELECT c_custkey, ord, kind, CASE kind WHEN 'page' THEN lower(c_mktsegment) WHEN 'user' THEN 'u' || c_custkey ELSE key END AS key, space FROM customer,
 (VALUES (0, 'page', NULL, 'S'), (1, 'user', NULL, NULL), (2, 'attachment', 'f.png', NULL)) v(ord, kind, key, space)""")
def link_extraction(spark, d):
    link = "'<ac:link><ri:{}/></ac:link>'"
    page = "'<p><ac:link><ri:page ri:content-title=\"' || lower(c_mktsegment) || '\" ri:space-key=\"S\"/></ac:link>'"
    user = "'<ac:link><ri:user ri:userkey=\"u' || c_custkey || '\"/></ac:link>'"
    file = link.format('attachment ri:filename="f.png"')
    return convert.link_rows(_customers(spark, d, html=f"concat({page}, {user}, {file}, {user}, '</p>')"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || '|' || source END AS labels FROM documents")
def label_scan(spark, d):
    good = F.concat(F.lit('{"results":[{"name":" '), "lang", F.lit('"},{"label":"'), "source", F.lit('"},{"name":" "},{"id":1}]}'))
    rows = read_table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, good).otherwise("no JSON").alias("json"))
    return pages.labels_of(rows).select("doc_id", F.array_join("labels", "|").alias("labels"))


@query("SELECT 'S' || c_custkey AS key, c_name AS name FROM customer WHERE c_custkey % 4 <> 0")
def space_scan(spark, d):
    key = "CASE WHEN c_custkey % 4 <> 0 THEN '\"S' || c_custkey || '\"' ELSE 'null' END"
    return pages.spaces_of(_customers(spark, d, json=f"""concat('{{"results":[{{"key":', {key}, ',"name":"', c_name, '"}}]}}')"""))


@query("SELECT 'k' || c_custkey AS user_key, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS title, CASE WHEN c_custkey % 5 <> 0 THEN 'http://w/display/~n' || c_custkey END AS url FROM customer")
def user_lookup(spark, d):
    body = """concat('{"userKey":"k', c_custkey, '","username":"n', c_custkey, '","displayName":"', c_name, '"}')"""
    rows = _customers(spark, d, user_key="concat('k', c_custkey)", json=body, status="CASE WHEN c_custkey % 5 = 0 THEN 404 ELSE 200 END")
    return pages.users_of(rows, base="http://w")


@query("""SELECT 't' || n_nationkey % 5 AS title, 'd' || max(n_nationkey) AS url FROM nation WHERE n_nationkey < 20 GROUP BY 1""")
def attachment_scan(spark, d):
    body = """concat('{"results":[{"title":"t', n_nationkey % 5, '","_links":{"download":"d', n_nationkey, '"}}],"_links":{', CASE WHEN n_nationkey = 19 THEN '' ELSE concat('"next":"p', n_nationkey + 1, '"') END, '}}')"""
    responses = read_table(spark, d, "nation").selectExpr("concat('p', n_nationkey) AS url", f"{body} AS json")
    return pages.attachments_of(pages.followed(responses, responses.select("url").filter("url = 'p0'")))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS page_id, c_name AS title, 'http://w/x/' || c_custkey AS url, 'v' || c_nationkey AS version_when, '<p>' || lower(c_mktsegment) || '</p>' AS storage, NULL AS view,
 'S' AS space, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS author FROM customer""")
def page_metadata(spark, d):
    author = """CASE WHEN c_custkey % 2 = 0 THEN concat(',"history":{"createdBy":{"displayName":"', c_mktsegment, '"}}') ELSE '' END"""
    body = f"""concat('{{"id":"', c_custkey, '","extra":[1],"title":"', c_name, '","version":{{"when":"v', c_nationkey, '"}},"space":{{"key":"S"}},"body":{{"storage":{{"value":"<p>', lower(c_mktsegment),
 '</p>"}}}},"_links":{{"base":"http://w","webui":"/x/', c_custkey, '"}}', {author}, '}}')"""
    return pages.pages_from_json(_customers(spark, d, json=body)).drop("attachments", "created")


@query("SELECT c_name AS title, 'S' AS space, 'http://w/' || c_custkey AS url FROM customer")
def search_hits(spark, d):
    body = """concat('{"results":[{"title":"', c_name, '","space":{"key":"S"},"_links":{"webui":"/', c_custkey, '"}}],"size":1}')"""
    return pages.search_hits(_customers(spark, d, json=body), base="http://w")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN 'a' END AS items FROM customer")
def value_or_list(spark, d):
    rows = _customers(spark, d, json="""CASE c_custkey % 3 WHEN 0 THEN '{"x":["a","b"]}' WHEN 1 THEN '{"x":"a"}' ELSE '{}' END""")
    return rows.select("c_custkey", F.array_join(pages.as_list("json", "$.x"), "|").alias("items"))


@query("""SELECT n_nationkey, o AS ord, CASE WHEN o = 0 THEN 'h-' || lower(n_name) WHEN o = 1 THEN 'n' || n_nationkey END AS host, CASE WHEN o = 1 THEN NULL WHEN n_regionkey = 0 THEN 'JIRA' ELSE 'CONFLUENCE' END AS kind
 FROM nation, (VALUES (0), (1), (2)) v(o)""")
def config_scan(spark, d):
    """Endpoints of configurations in which names of the environment stand; a name that is not set is empty, and so null."""
    rows = read_table(spark, d, "nation").selectExpr("n_nationkey", """concat('{"port": 1, "endpoints": [{"host": "h-', lower(n_name), '", "kind": "${', IF(n_regionkey = 0, 'FIRST', 'SECOND'), '}"}, {"host": "n', n_nationkey,
 '", "kind": "${UNSET}"}, {"kind": "${', IF(n_regionkey = 0, 'FIRST', 'SECOND'), '}", "host": " "}]}') AS json""")
    return config.endpoints_of(rows, {"FIRST": "JIRA", "SECOND": "CONFLUENCE"}).select("n_nationkey", "ord", "host", "kind")


# ---- functions ----


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'jira_x' WHEN 1 THEN 'confluence_x' ELSE 'other' END AS name FROM part WHERE p_size % 4 <> 2")
def tool_filter(spark, d):
    rows = read_table(spark, d, "part").selectExpr("p_partkey", "element_at(array('jira_x', 'confluence_x', 'bitbucket_x', 'other'), p_size % 4 + 1) AS name")
    return relational.enabled_tools(rows, ["JIRA", "CONFLUENCE"])


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Title ' || lang ELSE 'n' || doc_id || '.x' END AS title FROM documents")
def file_titles(spark, d):
    rows = read_table(spark, d, "documents").selectExpr("doc_id", r"CASE WHEN doc_id % 2 = 0 THEN concat('text\n== Title `', lang, '`  \n= Other') ELSE 'no title' END AS content", "concat('a/n', doc_id, '.x.adoc') AS path")
    return rows.select("doc_id", c.file_title("content", "path").alias("title"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 < 2 THEN 'md' ELSE 'adoc' END AS form FROM part")
def output_formats(spark, d):
    rows = read_table(spark, d, "part").selectExpr("p_partkey", "element_at(array('MD', ' Markdown ', 'asciidoc', NULL), p_size % 4 + 1) AS name")
    return rows.select("p_partkey", c.output_format("name").alias("form"))


_LANGUAGE_NAMES = [(k.upper(), v if v in LANGUAGES else None) for k, v in ALIASES.items()] + [(x, ALIASES.get(x, x) if ALIASES.get(x, x) in LANGUAGES else None) for x in LANGUAGES] + [("klingon", None)]


@query(f"SELECT p_partkey, x.name, x.language FROM part JOIN ({_values([(i, *r) for i, r in enumerate(_LANGUAGE_NAMES)], 'i, name, language')}) x ON x.i = p_partkey % {len(_LANGUAGE_NAMES)}")
def code_languages(spark, d):
    names = F.array(*(F.lit(n) for n, _ in _LANGUAGE_NAMES))
    rows = read_table(spark, d, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % len(_LANGUAGE_NAMES) + 1).cast("int")).alias("name"))
    return rows.select("p_partkey", "name", c.code_language("name").alias("language"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'py' WHEN c_custkey % 4 = 0 THEN 'json' WHEN c_custkey % 4 = 1 THEN 'xml' END AS language, CASE WHEN c_custkey % 4 = 0 THEN 'json' ELSE 'yaml' END AS spec FROM customer""")
def inferred_languages(spark, d):
    rows = _customers(spark, d, language="CASE WHEN c_custkey % 3 = 0 THEN 'py' END", text="element_at(array('{\"a\": 1}', '<a/>', 'a: 1', ' {'), CAST(c_custkey % 4 + 1 AS INT))")
    return rows.select("c_custkey", c.infer_language("language", "text").alias("language"), c.spec_language("text").alias("spec"))


_ADMONITIONS = [
    ("warning", "WARNING", "note", "WARNING"), ("tip", "TIP", "tip", "TIP"), ("note", "NOTE", "info", "NOTE"), ("info", "NOTE", "info", "NOTE"),
    ("caution", "NOTE", "note", "CAUTION"), ("important", "NOTE", "warning", "IMPORTANT"), ("other", "NOTE", "info", "NOTE"),
]


@query(f"SELECT p_partkey, x.name, x.admonition, x.macro, x.alert FROM part JOIN ({_values([(i, *r) for i, r in enumerate(_ADMONITIONS)], 'i, name, admonition, macro, alert')}) x ON x.i = p_partkey % {len(_ADMONITIONS)}")
def admonition_maps(spark, d):
    names = F.array(*(F.lit(r[0]) for r in _ADMONITIONS))
    rows = read_table(spark, d, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % len(_ADMONITIONS) + 1).cast("int")).alias("name"))
    return rows.select("p_partkey", "name", c.admonition_of_macro("name").alias("admonition"), c.macro_of_admonition("name").alias("macro"), c.alert_of_admonition("name").alias("alert"))


@query("""SELECT DISTINCT part FROM (SELECT 'color: rgb(' || c_nationkey || ',0,0)' AS part FROM customer UNION ALL SELECT 'color:' || lower(c_mktsegment) FROM customer)""")
def colour_styles(spark, d):
    html = """concat('<p style="margin:0; color: rgb(', c_nationkey, ',0,0)"><b style=\\'color:', lower(c_mktsegment), '; x:y\\'>b</b></p>')"""
    return c.colour_parts(_customers(spark, d, html=html), "html").select(F.col("part"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'navy' END AS name FROM part")
def colour_names(spark, d):
    rows = read_table(spark, d, "part").selectExpr("p_partkey", "element_at(array('color:rgb(190,2,3)', 'color: NAVY', 'color:black'), p_size % 3 + 1) AS style")
    return rows.select("p_partkey", c.style_colour("style").alias("name"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size + 1 WHEN 1 THEN 40 END AS width FROM part")
def column_widths(spark, d):
    rows = read_table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_size % 3 = 0 THEN concat('x: y; width : ', p_size, '.6px') END AS style", "CASE p_size % 3 WHEN 1 THEN '40px' ELSE '0' END AS width")
    return rows.select("p_partkey", c.column_width("style", "width").alias("width"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE ' **' || c_mktsegment || ' $x**  ' END AS text FROM customer")
def emphasis_hoist(spark, d):
    return _customers(spark, d, text="CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE concat(' ', c_mktsegment, ' $x  ') END").select("c_custkey", c.emphasis("**", "text").alias("text"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'img/a.png' WHEN 1 THEN 'b/a.png' ELSE 'http:a' END AS path, CASE c_custkey % 3 WHEN 0 THEN 'a.png' WHEN 1 THEN 'b/a.png' ELSE 'http:a' END AS bare FROM customer")
def image_paths(spark, d):
    rows = _customers(spark, d, name="element_at(array('a.png', 'b/a.png', 'http:a'), CAST(c_custkey % 3 + 1 AS INT))")
    return rows.select("c_custkey", c.image_path("name", "img").alias("path"), c.image_path("name", " ").alias("bare"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'S ' || c_nationkey END AS space, CASE WHEN c_custkey % 2 = 0 THEN 'My ' || c_mktsegment || '/ü' END AS title FROM customer")
def display_urls(spark, d):
    rows = _customers(spark, d, url="CASE WHEN c_custkey % 2 = 0 THEN concat('http://w/display/S%20', c_nationkey, '/My+', c_mktsegment, '%2F%C3%BC?x=1') ELSE 'http://w/pages/7' END")
    return rows.select("c_custkey", c.display_space("url").alias("space"), c.display_title("url").alias("title"))


@query("SELECT doc_id, url_encode(lang || ' ü') || '/' || url_encode(source || '&') AS path FROM documents")
def encoded_paths(spark, d):
    return read_table(spark, d, "documents").select("doc_id", c.encode_path(F.concat("lang", F.lit(" ü/"), "source", F.lit("&"))).alias("path"))


@query("SELECT c_custkey, lower(c_mktsegment) || ' & <' || c_nationkey || '> a_b' AS title FROM customer")
def plain_titles(spark, d):
    return _customers(spark, d, title="concat(' <b>', lower(c_mktsegment), '</b> &amp; *&lt;', c_nationkey, '&gt;* a_b ')").select("c_custkey", c.plain_title("title").alias("title"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a/' || lang WHEN 1 THEN lang || '/x' ELSE 'a/b/' || source END AS path FROM documents")
def normal_paths(spark, d):
    target = "CASE doc_id % 3 WHEN 0 THEN concat('./../', lang) WHEN 1 THEN concat('../../../', lang, '/x') ELSE source END"
    return read_table(spark, d, "documents").selectExpr("doc_id", f"{target} AS t").select("doc_id", c.normal_path(F.lit("a/b"), "t").alias("path"))


# ---- files, sections, tables ----


@query("""SELECT c_custkey, 0 AS table_no, CAST(r AS INT) AS row_no, CAST(k AS INT) AS cell_no, CAST(cs AS INT) AS colspan, 1 AS rowspan, head AS header, false AS rich, CASE t WHEN 'x' THEN lower(c_mktsegment) ELSE t END AS text FROM customer,
 (VALUES (0, 0, 1, true, 'A'), (0, 1, 1, true, 'x'), (1, 0, 2, false, 'x')) v(r, k, cs, head, t)""")
def table_cells(spark, d):
    html = "concat('<table><tr><th>A</th><th>', lower(c_mktsegment), '</th></tr><tr><td colspan=\"2\">', lower(c_mktsegment), '</td></tr></table>')"
    return convert.cell_rows(_customers(spark, d, html=html))


@query(ORACLE_SQL["table_cells"])
def lateral_cells(spark, d):
    """``table_cells`` from SQL."""
    html = "concat('<table><tr><th>A</th><th>', lower(c_mktsegment), '</th></tr><tr><td colspan=\"2\">', lower(c_mktsegment), '</td></tr></table>')"
    tables.register(spark)
    return spark.sql("SELECT c_custkey, c.* FROM {rows}, LATERAL cells(html) c", rows=dealt(_customers(spark, d, html=html)))


@query("""SELECT c_custkey, node_id, parent_id, ord, depth, kind, level, CASE WHEN kind IN ('heading', 'paragraph') THEN c_name ELSE '' END AS text FROM customer,
 (VALUES (0, -1, 0, 0, 'heading', 2), (1, -1, 1, 0, 'admonition', NULL), (2, 1, 0, 1, 'paragraph', NULL)) v(node_id, parent_id, ord, depth, kind, level)""")
def lateral_blocks(spark, d):
    html = "concat('<h2>', c_name, '</h2><ac:structured-macro ac:name=\"info\"><ac:rich-text-body><p>', c_name, '</p></ac:rich-text-body></ac:structured-macro>')"
    tables.register(spark)
    return spark.sql("SELECT c_custkey, b.* FROM {rows}, LATERAL blocks(html, 'adoc') b", rows=dealt(_customers(spark, d, html=html)))


@query("""SELECT 'f' || doc_id || '.adoc' AS path, CASE WHEN doc_id % 5 = 1 THEN ':confluency-id: 7' ELSE 'none' END AS id FROM documents WHERE doc_id % 5 <> 0""")
def ignore_filter(spark, d):
    content = r"concat('= T\n', CASE WHEN doc_id % 5 = 0 THEN ':confluency-id:  IGNORE \n' WHEN doc_id % 5 = 1 THEN ':confluency-id: 7\n' ELSE '' END, 'text')"
    rows = read_table(spark, d, "documents").selectExpr("concat('f', doc_id, '.adoc') AS path", f"{content} AS content")
    found = F.regexp_extract("content", "(?m)^(:confluency-id:.*)$", 1)
    return export.publishable(rows).select("path", F.when(found != "", found).otherwise("none").alias("id"))


@query("""SELECT anchor, min(path) AS path FROM (SELECT 'a' || doc_id % 10 AS anchor, 'f' || doc_id || '.adoc' AS path FROM documents UNION ALL SELECT 'b' || doc_id % 4, 'f' || doc_id || '.adoc' FROM documents
 UNION ALL SELECT 'c' || doc_id, 'f' || doc_id || '.adoc' FROM documents) GROUP BY 1""")
def anchors_declared(spark, d):
    content = "concat('x [[a', doc_id % 10, ',text]] [#b', doc_id % 4, '.role] anchor:c', doc_id, '[] [[a', doc_id % 10, ']]')"
    return links.anchors(read_table(spark, d, "documents").selectExpr("concat('f', doc_id, '.adoc') AS path", f"{content} AS content"))


@query("""SELECT 'd' || c_custkey || '/' || f AS path, CASE f WHEN 'two.adoc' THEN '<p>see <ac:link ac:anchor="here' || c_custkey || '"><ri:page ri:content-title="One ' || c_custkey ||
 '"/><ac:link-body>there</ac:link-body></ac:link> and <ac:link><ri:page ri:content-title="One ' || c_custkey || '"/><ac:link-body>that</ac:link-body></ac:link></p>'
 ELSE '<ac:structured-macro ac:name="anchor"><ac:parameter ac:name="">here' || c_custkey || '</ac:parameter></ac:structured-macro><p>text</p>' END AS storage FROM customer, (VALUES ('one.adoc'), ('two.adoc')) v(f)""")
def publish_cross_links(spark, d):
    """Titles of other files and the files of anchors come by joins."""
    one = r"concat('= One ', c_custkey, '\n\n[[here', c_custkey, ']]\ntext')"
    two = r"concat('= Two\n\nsee <<here', c_custkey, ',there>> and xref:one.adoc[that]')"
    files = _customers(spark, d, f="explode(array('one.adoc', 'two.adoc'))").select(F.expr("concat('d', c_custkey, '/', f) AS path"), F.expr(f"CASE f WHEN 'one.adoc' THEN {one} ELSE {two} END AS content"))
    return export.publish_files(files).select("path", "storage")


# ---- joins, trees, plans ----


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'C' WHEN 5 THEN 'U' || c_custkey WHEN 6 THEN 'F' WHEN 7 THEN NULL ELSE CASE c_custkey % 8 WHEN 4 THEN 'nowhere' ELSE 'k' || c_custkey % 8 END END AS title,
 CASE c_custkey % 8 WHEN 0 THEN 'http://c' WHEN 1 THEN 'tree/k1#x' WHEN 2 THEN 'http://v/' || c_custkey WHEN 3 THEN 'http://s' WHEN 5 THEN 'http://u/' || c_custkey WHEN 6 THEN 'http://f/' || c_custkey END AS url,
 c_custkey % 8 = 1 AS local FROM (SELECT * FROM customer WHERE c_custkey % 8 <> 4 AND c_custkey % 8 <> 1) UNION ALL SELECT c_custkey, 'k1#x', 'tree/k1#x', true FROM customer WHERE c_custkey % 8 = 1
 UNION ALL SELECT c_custkey, NULL, NULL, false FROM customer WHERE c_custkey % 8 = 4""")
def link_tiers(spark, d):
    """Every tier of the cascade: cached, the tree, the page's view, search, nothing, users, attachments, nothing."""
    kind = "CASE c_custkey % 8 WHEN 5 THEN 'user' WHEN 6 THEN 'attachment' WHEN 7 THEN 'user' ELSE 'page' END"
    key = "CASE c_custkey % 8 WHEN 1 THEN 'k1#x' WHEN 5 THEN concat('u', c_custkey) WHEN 6 THEN 'f.png' WHEN 7 THEN 'gone' ELSE concat('k', c_custkey % 8) END"
    wanted = _customers(spark, d, page_id="c_custkey", kind=kind, key=key, space="CAST(NULL AS STRING)")
    one = spark.range(1)
    cached = one.selectExpr("'page' AS kind", "'k0' AS key", "CAST(NULL AS STRING) AS space", "'C' AS title", "'http://c' AS url")
    view = _customers(spark, d, page_id="c_custkey", label="'k2'", href="concat('http://v/', c_custkey)").drop("c_custkey")
    search = one.selectExpr("'k3' AS title", "CAST(NULL AS STRING) AS space", "'http://s' AS url", "1 AS rank").unionByName(one.selectExpr("'k3' AS title", "CAST(NULL AS STRING) AS space", "'http://late' AS url", "2 AS rank"))
    users = _customers(spark, d, user_key="concat('u', c_custkey)", title="concat('U', c_custkey)", url="concat('http://u/', c_custkey)").drop("c_custkey")
    files = _customers(spark, d, page_id="c_custkey", name="'f.png'", title="'F'", url="concat('http://f/', c_custkey)").drop("c_custkey")
    return links.resolve(wanted, cached, one.selectExpr("'k1' AS title", "'tree/k1' AS path"), view, search, users, files).select("c_custkey", "title", "url", "local")


@query("""SELECT c_custkey, kind, CASE kind WHEN 'page' THEN CASE WHEN c_custkey % 2 = 0 THEN 'k' END WHEN 'attachment' THEN 'F' END AS title,
 CASE kind WHEN 'page' THEN CASE WHEN c_custkey % 2 = 0 THEN 'http://v/' || c_custkey END WHEN 'attachment' THEN 'http://f' END AS url FROM customer, (VALUES ('page'), ('user'), ('attachment')) v(kind)""")
def local_links(spark, d):
    wanted = _customers(spark, d, page_id="c_custkey", kind="explode(array('page', 'user', 'attachment'))").withColumns({"key": F.lit("k"), "space": F.lit(None).cast("string")})
    view = _customers(spark, d, page_id="c_custkey", label="'k'", href="concat('http://v/', c_custkey)").filter("c_custkey % 2 = 0").drop("c_custkey")
    files = _customers(spark, d, page_id="c_custkey", name="'k'", title="'F'", url="'http://f'").drop("c_custkey")
    return links.resolve_local(wanted, view, files).select("c_custkey", "kind", "title", "url")


# index files stand in some folders; a run of them from a file's folder up, with no gap, leads to the root
_ROOT_FILES = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id % 3 || '/s' || doc_id % 5 || '/t' || doc_id % 7 ELSE 'r' || doc_id % 3 || '/s' || doc_id % 5 END
 || CASE WHEN doc_id % 11 = 0 THEN '/index.adoc' ELSE '/' || source || doc_id || '.adoc' END AS path FROM documents
 UNION ALL SELECT -1 - doc_id, 'r' || doc_id % 2 || '/index.adoc' FROM documents"""


@query(f"""WITH f AS ({_ROOT_FILES}), g AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM f), i AS (SELECT DISTINCT folder FROM g WHERE path LIKE '%/index.adoc'),
 h AS (SELECT DISTINCT folder, regexp_replace(folder, '/[^/]*$', '') AS p1, split_part(folder, '/', 1) AS p2, length(folder) - length(replace(folder, '/', '')) AS n FROM g)
SELECT g.doc_id, CASE WHEN n = 0 OR p1 NOT IN (SELECT folder FROM i) THEN g.folder WHEN n = 1 THEN p1 WHEN p2 IN (SELECT folder FROM i) THEN p2 ELSE p1 END AS root FROM g JOIN h USING (folder)""")
def root_search(spark, d):
    docs = read_table(spark, d, "documents")
    low = "'r' || doc_id % 3 || '/s' || doc_id % 5"
    files = docs.selectExpr("doc_id", f"CASE WHEN doc_id % 2 = 0 THEN {low} || '/t' || doc_id % 7 ELSE {low} END || CASE WHEN doc_id % 11 = 0 THEN '/index.adoc' ELSE '/' || source || doc_id || '.adoc' END AS path")
    files = files.unionByName(docs.selectExpr("-1 - doc_id AS doc_id", "'r' || doc_id % 2 || '/index.adoc' AS path"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files.withColumn("folder", folder).join(sitemap.publish_roots(files), "folder").select("doc_id", "root")


@query("SELECT 'a' || c_nationkey AS path, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def path_collisions(spark, d):
    return sitemap.collisions(_customers(spark, d, path="concat('a', c_nationkey)"))


_TREE = """WITH RECURSIVE e AS (SELECT CAST(c_custkey // 8 AS VARCHAR) AS parent_id, CAST(c_custkey AS VARCHAR) AS page_id, c_name AS title, c_custkey AS k FROM customer WHERE c_custkey > 0),
 t(page_id, title, path, parent_id) AS (SELECT '0', (SELECT c_name FROM customer WHERE c_custkey = 0), (SELECT c_name FROM customer WHERE c_custkey = 0), CAST(NULL AS VARCHAR)
 UNION ALL SELECT e.page_id, e.title, t.path || '/' || e.title, t.page_id FROM t JOIN e ON e.parent_id = t.page_id)"""


@query(f"""{_TREE} SELECT t.page_id, t.path || '/index.md' AS path, '---' || chr(10) || 'confluency-id: ' || t.page_id || chr(10) || 'confluency-version: v' || chr(10) || '---' || chr(10) || chr(10) || '# ' || t.title || chr(10) || chr(10) ||
 CASE WHEN p.path IS NULL THEN 'top' ELSE '[' || p.title || '](../index.md)' END ||
 coalesce((SELECT chr(10) || chr(10) || string_agg('- [' || k.title || '](' || k.title || '/index.md)', chr(10) ORDER BY CAST(k.page_id AS INT)) FROM t k WHERE k.parent_id = t.page_id), '') || chr(10) AS content
 FROM t LEFT JOIN t p ON p.page_id = t.parent_id""")
def export_links_and_children(spark, d):
    """Each page links to its parent and lists its children; both are paths as seen from its own folder."""
    up = read_table(spark, d, "customer").selectExpr("c_custkey AS up", "c_name AS up_name")
    rows = read_table(spark, d, "customer").join(up, F.expr("up = c_custkey div 8 AND c_custkey > 0"), "left")
    link = "CASE WHEN up IS NULL THEN '<p>top</p>' ELSE concat('<p><ac:link><ri:page ri:content-title=\"', up_name, '\"/></ac:link></p>') END"
    made = rows.selectExpr("CAST(c_custkey AS STRING) AS page_id", "c_name AS title", "'v' AS version_when", f"concat({link}, '<ac:structured-macro ac:name=\"children\"/>') AS storage")
    edges = rows.filter("up IS NOT NULL").selectExpr("CAST(up AS STRING) AS parent_id", "CAST(c_custkey AS STRING) AS child_id", "c_name AS title", "CAST(c_custkey AS INT) AS ord")
    return export.export_tree(made, edges, "0", form="md").select("page_id", "path", "content")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS page_id, c_name || '/index.adoc' AS path FROM customer WHERE c_custkey % 3 <> 0""")
def export_skips_unchanged(spark, d):
    rows = _customers(spark, d, page_id="CAST(c_custkey AS STRING)", title="c_name", version_when="concat('v', c_nationkey)", storage="'<p>x</p>'").drop("c_custkey")
    state = rows.selectExpr("page_id", "CASE WHEN CAST(page_id AS INT) % 3 = 0 THEN version_when ELSE 'old' END AS version_when")
    edges = spark.createDataFrame([], "parent_id string, child_id string, title string, ord int")
    return export.export_tree(rows, edges, state=state).select("page_id", "path")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS page_id, c_name || '/' || file AS path FROM customer, (VALUES ('index.adoc'), ('1_One.adoc'), ('2_Two.adoc'), ('files/include_file_1')) v(file)""")
def export_splits_long_pages(spark, d):
    code = "<ac:structured-macro ac:name=\"code\"><ac:plain-text-body><![CDATA[', repeat('x\\n', 30), ']]></ac:plain-text-body></ac:structured-macro>"
    rows = _customers(spark, d, page_id="CAST(c_custkey AS STRING)", title="c_name", storage=f"concat('<h1>One</h1><p>a</p><h1>Two</h1>{code}')").drop("c_custkey")
    return export.export_tree(rows, spark.createDataFrame([], "parent_id string, child_id string, title string"), lines=10).select("page_id", "path")


@query("SELECT CAST(doc_id AS VARCHAR) AS page_id, CASE WHEN doc_id % 3 = 0 THEN 'created' WHEN doc_id % 3 = 1 THEN 'skipped' ELSE 'updated' END AS action, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN 4 ELSE 5 END AS INT) AS number FROM documents")
def publish_versions(spark, d):
    made = read_table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("page_id"), F.col("text").alias("storage"))
    hash_ = F.when(F.col("page_id").cast("int") % 3 == 1, c.content_hash("storage")).otherwise("old")
    remote = made.filter("CAST(page_id AS INT) % 3 <> 0").select("page_id", F.lit(4).alias("number"), hash_.alias("content_hash"))
    return export.publish_plan(made, remote)


# ---- bundles, sinks, replies ----

_FILES = ("source/storage.html", "source/view.html", "source/page.json", "source/links.json", "attache/x.png", "notes.txt")


@query("SELECT count(*) * 2 AS html, count(*) * 2 AS json, count(*) AS attachment FROM customer")
def bundle_counts(spark, d):
    files = _customers(spark, d, file=f"explode(array{_FILES})").select(F.concat(F.col("c_custkey").cast("string"), F.lit("/"), "file").alias("path"), F.encode(F.lit('{"a":"<p>x</p>"}'), "UTF-8").alias("bytes"))
    return bundles.counted(bundles.anonymized_export(files), bundles.EXPORT_KINDS)


@query("SELECT 't/' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '.png' ELSE '.ADOC' END AS path, CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE 'adoc' END AS kind FROM customer")
def import_bundle(spark, d):
    rows = _customers(spark, d, path="concat('t/', c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '.png' ELSE '.ADOC' END)", bytes="CAST(c_mktsegment AS BINARY)")
    return bundles.anonymized_import(rows).select("path", "kind")


@query("SELECT 'source/' || c_custkey || '.' || k AS path, CASE k WHEN 'storage.html' THEN '<p>' || c_mktsegment || '</p>' WHEN 'json' THEN '{\"page_id\":\"' || c_custkey || '\",\"storage\":\"<p>' || c_mktsegment || '</p>\"}' END AS content FROM customer, (VALUES ('storage.html'), ('json')) v(k)")
def debug_sink(spark, d):
    return sinks.debug_files(_customers(spark, d, page_id="CAST(c_custkey AS STRING)", storage="concat('<p>', c_mktsegment, '</p>')").drop("c_custkey"))


@query("""SELECT 'r' || c_custkey || '/report.txt' AS path, 'title: ' || c_name || chr(10) || CASE WHEN c_custkey % 3 = 1 THEN 'version: ' || c_nationkey || chr(10) ELSE '' END || 'payload: ' || lower(c_mktsegment) || chr(10) AS content FROM customer""")
def bug_report(spark, d):
    """A report of every customer; fields without a value are left out."""
    rows = _customers(spark, d, id="concat('r', c_custkey)", title="c_name", version="element_at(array(' ', CAST(c_nationkey AS STRING), NULL), CAST(c_custkey % 3 + 1 AS INT))", payload="lower(c_mktsegment)")
    return bundles.reports(rows, "id", ["title", "version", "payload"])


_ERROR = """'{"jsonrpc": "2.0", "id": ' || k || ', "error": {"code": -32601, "message": "Method not found: x/' || c_custkey || '"}}'"""
_FAILED = """'{"jsonrpc": "2.0", "id": ' || k || ', "result": {"content": [{"type": "text", "text": "' || m || '"}], "isError": true}}'"""


@query(f"""WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '"a' || c_custkey || '"' END AS k,
 CASE WHEN c_custkey % 7 = 4 THEN 'Unknown tool: no' || c_nationkey WHEN c_custkey % 7 = 5 THEN 'Missing argument: body' END AS m FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 7 = 6 THEN 'jira_get_issue' END AS tool, CASE WHEN c_custkey % 7 = 6 THEN 'K-' || c_custkey END AS issue, CASE c_custkey % 7
 WHEN 0 THEN '{{"jsonrpc": "2.0", "id": ' || k || ', "result": {{}}}}' WHEN 1 THEN '{{"jsonrpc": "2.0", "id": null, "error": {{"code": -32700, "message": "Parse error"}}}}'
 WHEN 2 THEN {_ERROR} WHEN 4 THEN {_FAILED} WHEN 5 THEN {_FAILED} END AS reply FROM q""")
def json_rpc_replies(spark, d):
    """Pings, broken lines, unknown methods, notifications, and calls of unknown tools, without an argument and in order."""
    key = """IF(c_custkey % 2 = 0, CAST(c_custkey AS STRING), concat('"a', c_custkey, '"'))"""
    lines = [
        f"""concat('{{"jsonrpc":"2.0","id":', {key}, ',"method":"ping"}}')""", "concat('{broken ', c_custkey)", f"""concat('{{"id":', {key}, ',"method":"x/', c_custkey, '"}}')""", "'{\"method\":\"notifications/initialized\"}'",
        f"""concat('{{"id":', {key}, ',"method":"tools/call","params":{{"name":"no', c_nationkey, '"}}}}')""",
        f"""concat('{{"id":', {key}, ',"method":"tools/call","params":{{"name":"jira_add_comment","arguments":{{"issueKey":"K-1","body":" "}}}}}}')""",
        f"""concat('{{"id":', {key}, ',"method":"tools/call","params":{{"name":"jira_get_issue","arguments":{{"issueKey":"K-', c_custkey, '"}}}}}}')""",
    ]
    rows = _customers(spark, d, request=f"element_at(array({', '.join(lines)}), CAST(c_custkey % 7 + 1 AS INT))")
    return requests.answered(rows).select("c_custkey", "tool", F.col("arguments")["issueKey"].alias("issue"), "reply")


# ---- anonymised texts keep their form ----

_SKELETON = "regexp_replace({}, '\\p{{L}}{{2,}}', 'x', 'g')"


@query("SELECT doc_id, " + _SKELETON.format("text") + " AS skeleton, 0 AS unchanged FROM documents")
def anonymized_skeleton(spark, d):
    """Every run of letters changes; what stands between them, line by line, does not."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    made = anonymize.anonymize_adoc(docs.withColumn("given", F.col("text")))
    # runs that are to change: those that are no suffix and no name of an attribute, outside of lines of attributes
    runs = lambda x: F.regexp_extract_all(F.regexp_replace(x, r"(?m)^\s*\[.*\]\s*$", ""), F.lit(r"(?<![\p{L}.])\p{L}{2,}(?![\p{L}:])"), F.lit(0))
    same = F.size(F.filter(F.zip_with(runs("given"), runs("text"), lambda a, b: a.eqNullSafe(b)), lambda x: x))
    return made.select("doc_id", F.regexp_replace("text", r"\p{L}{2,}", "x").alias("skeleton"), same.alias("unchanged"))


# fields that tell of someone, a field that does not, and a table of files
_PERSONAL = ("displayName", "username", "userKey", "title", "spaceKey", "url", "body", "fileName")


@query("SELECT event_id, event_type AS kind, user_id AS number, 8 AS changed, 'png' AS suffix, '<p></p>' AS markup FROM events")
def anonymized_records(spark, d):
    """Records of every event: personal fields all change, others stay, markup and file suffixes keep their form."""
    value = lambda k: {"url": "concat('https://w.example/x/', event_type, user_id)", "body": "concat('<p>', event_type, user_id, '</p>')", "fileName": "concat(event_type, user_id, '.png')"}.get(k, "concat(event_type, ' u', user_id)")
    events = read_table(spark, d, "events")
    rows = events.selectExpr("event_id", "to_json(named_struct(" + ", ".join(f"'{k}', {value(k)}" for k in _PERSONAL) + ", 'kind', event_type, 'number', user_id)) AS given").withColumn("json", F.col("given"))
    made = anonymize.anonymize_json(rows, "json")
    old, new = (lambda k: F.get_json_object("given", f"$.{k}")), (lambda k: F.get_json_object("json", f"$.{k}"))
    changed = F.size(F.filter(F.array(*(old(k) != new(k) for k in _PERSONAL)), lambda x: x))
    return made.select(
        "event_id", new("kind").alias("kind"), new("number").cast("long").alias("number"), changed.alias("changed"),
        F.regexp_extract(new("fileName"), r"\.(\w+)$", 1).alias("suffix"), F.regexp_replace(new("body"), "[^<>/p]|p(?=[a-z])|(?<=[a-z])p", "").alias("markup"),
    )


@query("SELECT lang, count(DISTINCT w) AS words, count(DISTINCT w) AS stand_ins, 0 AS unchanged FROM (SELECT lang, unnest(regexp_extract_all(text, '\\p{L}{2,}')) AS w FROM documents) GROUP BY lang")
def distinct_words(spark, d):
    """As many stand-ins as words, over all texts."""
    words = read_table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{2,}"), F.lit(0))).alias("w")).distinct()
    made = anonymize.anonymize_adoc(words.withColumn("new", F.col("w")), "new")
    return made.groupBy("lang").agg(F.countDistinct("w").alias("words"), F.countDistinct("new").alias("stand_ins"), F.count_if(F.col("w") == F.col("new")).alias("unchanged"))


# as in a bundle: columns of keys, names, files and addresses of one table each
_KINDS = {
    "name": "concat('Ann ', initcap(c_mktsegment), ' ', c_name)", "login": "concat(lower(c_mktsegment), '.', c_custkey)", "user_key": "lower(hex(c_custkey))", "title": "concat(c_mktsegment, ' plan ', c_custkey)",
    "space_key": "concat('S', c_custkey)", "issue_key": "concat('PR-', c_custkey)", "anchor": "concat('a', c_custkey)", "file_name": "concat('f', c_custkey, '.drawio.png')", "url": "concat('https://h.example/display/S', c_nationkey, '/P', c_custkey, '?pageId=', c_custkey)",
}


@query("SELECT kind, count(DISTINCT c_custkey) AS given, count(DISTINCT c_custkey) AS stand_ins FROM customer, (VALUES " + ", ".join(f"('{k}')" for k in _KINDS) + ") v(kind) GROUP BY kind")
def distinct_stand_ins(spark, d):
    """As many stand-ins of each kind as values."""
    rows = read_table(spark, d, "customer").selectExpr(
        "explode(map(" + ", ".join(f"'{k}', {v}" for k, v in _KINDS.items()) + ")) AS (kind, given)"
    )
    made = anonymize.stand_ins(rows, "kind", "given")
    return made.groupBy("kind").agg(F.countDistinct("given").alias("given"), F.countDistinct("stand_in").alias("stand_ins"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '.drawio.png' WHEN 1 THEN '.PDF' ELSE '' END AS suffix, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS VARCHAR) AS number FROM customer")
def attachment_file_names(spark, d):
    rows = _customers(spark, d, page_id="c_nationkey", name="concat(c_name, CASE c_custkey % 3 WHEN 0 THEN '.drawio.png' WHEN 1 THEN '.PDF' ELSE '' END)")
    made = anonymize.attachment_names(rows)
    return made.select("c_custkey", F.regexp_extract("name", r"(\.drawio\.png|\.PDF|)$", 1).alias("suffix"), F.regexp_extract("new_name", r"^file_(\d+)", 1).alias("number"))
