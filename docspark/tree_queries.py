"""Registered queries of whole trees of files: transclusion, export and publishing of texts as they are, stand-ins over whole tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import diagrams, includes, split, textindex
from docspark.plans import export
from docspark.sources import sinks
from docspark.sources.pages import read_table
from docspark.shared import cut, dealt, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def png(chunks: tuple[tuple[bytes, bytes], ...]) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in chunks)


# ---- transclusion ----

# each document brings a page and two parts; a notice that all of them include stands beside them
_MAIN = """= T
:kind: parts

[source]
----
include::{kind}/x.txt[lines="2..3;6"]
----

include::parts/x.txt[tag=t]
include::parts/y.txt[]
include::gone.txt[]
include::gone.txt[opts=optional]
include::b.adoc[]
\\include::not.txt[]
"""
_X = "one\n// tag::t[]\ntwo {source}\n// end::t[]\nfive\n{lang}\n"
_Y = "start\ninclude::../../notice.txt[]\ninclude::y.txt[]\ninclude::./x.txt[lines=6]\nend"
_NOTICE = "all rights\n"
_WHOLE = """= T
:kind: parts

[source]
----
// tag::t[]
two {source}
{lang}
----

two {source}
start
all rights
Unresolved directive in d{id}/parts/y.txt - include::y.txt[]
{lang}
end
Unresolved directive in d{id}/a.adoc - include::gone.txt[]
include::b.adoc[]
\\include::not.txt[]
"""


def _filled(template: str, sql: bool = False):
    parts = {"{id}": "CAST(doc_id AS VARCHAR)" if sql else "CAST(doc_id AS STRING)", "{source}": "source", "{lang}": "lang"}
    out = "'" + template.replace("'", "''").replace("\\", "\\" if sql else "\\\\") + "'"
    for mark, column in parts.items():
        out = f"replace({out}, '{mark}', {column})"
    return out


@query(f"SELECT doc_id, {_filled(_WHOLE, sql=True)} AS content FROM documents")
def include_expansion(spark, d):
    docs = read_table(spark, d, "documents")
    file = lambda name, text: docs.selectExpr(f"concat('d', doc_id, '/{name}') AS path", f"{_filled(text)} AS content")
    files = file("a.adoc", _MAIN).unionByName(file("parts/x.txt", _X)).unionByName(file("parts/y.txt", _Y))
    files = files.unionByName(spark.createDataFrame([("notice.txt", _NOTICE)], "path string, content string"))
    made = includes.expanded(files).filter(F.col("path").endswith("/a.adoc"))
    return made.select(F.regexp_extract("path", "^d([0-9]+)/", 1).cast("long").alias("doc_id"), "content")


_LINES = "regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10), 'g')"
_CODE = f"CASE WHEN right({_LINES}, 1) = chr(10) THEN left({_LINES}, length({_LINES}) - 1) ELSE {_LINES} END"


@query(f"""SELECT doc_id, '<h1>' || lang || '</h1><ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[' || replace({_CODE}, ']]>', ']]]]><![CDATA[>')
 || ']]></ac:plain-text-body></ac:structured-macro>' AS storage FROM documents""")
def publish_includes(spark, d):
    """Whole texts as code that a page includes."""
    docs = read_table(spark, d, "documents")
    pages = docs.selectExpr("concat('d', doc_id, '/index.adoc') AS path", r"concat('= T\n\n== ', lang, '\n\n[source,python]\n----\ninclude::files/code.txt[]\n----\n') AS content")
    files = pages.unionByName(docs.selectExpr("concat('d', doc_id, '/files/code.txt') AS path", "text AS content"))
    made = export.publish_files(files)
    return made.select(F.regexp_extract("path", "^d([0-9]+)/", 1).cast("long").alias("doc_id"), "storage")


@query(f"SELECT doc_id, {_CODE} AS code FROM documents WHERE trim({_CODE}, ' ' || chr(9) || chr(10)) <> ''")
def export_publish_round_trip(spark, d):
    """Code of every length, exported to a page's listing or to a file of its own, and published again. A page is named by its text as well, so rows that share an id stay apart."""
    text = F.replace(F.regexp_replace("text", "\r\n?", "\n"), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    storage = F.concat(F.lit('<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA['), text, F.lit("]]></ac:plain-text-body></ac:structured-macro>"))
    one = F.concat_ws("_", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text"))
    pages = read_table(spark, d, "documents").select(one.alias("page_id"), F.concat(F.lit("d"), one).alias("title"), storage.alias("storage"), F.lit("v").alias("version_when"))
    edges = spark.createDataFrame([], "parent_id string, child_id string, title string")
    files = stored(export.export_tree(pages, edges, lines=1 << 30).select("path", "content"))  # as files that are written and read again
    made = export.publish_files(files, deal=False)
    code = F.replace(F.regexp_extract("storage", r"(?s)<!\[CDATA\[(.*)\]\]>", 1), F.lit("]]]]><![CDATA[>"), F.lit("]]>"))
    number = F.nullif(F.regexp_extract("path", "^d(-?[0-9]*)_", 1), F.lit("")).cast("long")
    return made.select(number.alias("doc_id"), code.alias("code")).filter(F.col("code").rlike(r"[^ \t\n]"))  # of blank code nothing is left


# ---- lines and files that others name ----


@query("""SELECT doc_id, part, file, content FROM (
 SELECT doc_id, 0 AS part, 'index.adoc' AS file, 'include::1_' || source || '.adoc[]' AS c FROM documents
 UNION ALL SELECT doc_id, 1, '1_' || source || '.adoc', '== ' || source || chr(10) || '----' || chr(10) || '== ' || lang || chr(10) || '....' || chr(10) || '-----' || chr(10) || '== no' || chr(10) || '----' || chr(10) || 'end' FROM documents
 UNION ALL SELECT doc_id, 2, '2_Two.adoc', '== Two' || chr(10) || '....' || chr(10) || '----' || chr(10) || '== open' FROM documents),
 LATERAL (SELECT CASE WHEN part = 0 THEN chr(10) || c || chr(10) || chr(10) || 'include::2_Two.adoc[]' ELSE ':imagesdir: ./attache' || chr(10) || c END AS content)""")
def split_fences(spark, d):
    """Headings in listings begin no part."""
    docs = read_table(spark, d, "documents")
    text = docs.select("doc_id", F.concat(F.lit("== "), "source", F.lit("\n----\n== "), "lang", F.lit("\n....\n-----\n== no\n----\nend\n== Two\n....\n----\n== open")).alias("text"))
    return split.sections(text, fences=True).select("doc_id", "part", "file", "content")


@query("""SELECT doc_id, 't' || doc_id % 3 || '/a/p' || doc_id || '.adoc' AS path, '<p>see ' || '<ac:link><ri:page ri:content-title="B' || doc_id || '"/><ac:link-body>B' || doc_id || '</ac:link-body></ac:link> and <ac:link ac:anchor="x">'
 || '<ri:page ri:content-title="B' || doc_id || '"/><ac:link-body>B' || doc_id || '</ac:link-body></ac:link> and <code>gone.adoc</code></p>' AS storage FROM documents""")
def publish_file_mentions(spark, d):
    """Files that are named as code, as seen from the page's folder and from the root of its tree."""
    docs = read_table(spark, d, "documents")
    pages = docs.selectExpr("concat('t', doc_id % 3, '/a/p', doc_id, '.adoc') AS path", "concat('see `../b/q', doc_id, '.adoc` and `b/q', doc_id, '.adoc#x` and `gone.adoc`') AS content")
    other = docs.selectExpr("concat('t', doc_id % 3, '/b/q', doc_id, '.adoc') AS path", "concat('= B', doc_id) AS content")
    top = docs.selectExpr("concat('t', doc_id % 3, '/index.adoc') AS path", "'= Top' AS content").distinct()
    made = export.publish_files(pages.unionByName(other).unionByName(top)).filter("path like '%/a/p%'")
    return made.select(F.regexp_extract("path", "p([0-9]+)", 1).cast("long").alias("doc_id"), "path", "storage")


# ---- diagrams and attachments of an export ----

_PNG = png(((b"IHDR", bytes((0, 0, 0, 1, 0, 0, 0, 1, 8, 0, 0, 0, 0))), (b"IDAT", zlib.compress(b"\x00\x00")), (b"IEND", b"")))
_SOURCE = "concat('<mxfile>', source, '</mxfile>')"


def _attached(docs: DataFrame) -> DataFrame:
    """By a document's number: a source and a PNG, a source and an SVG, a picture that is ready, and only a picture, of which no diagram can be made."""
    some = lambda rest, name, data: docs.filter(f"doc_id % 4 = {rest}").selectExpr("CAST(doc_id AS STRING) AS page_id", f"'{name}' AS name", f"{data} AS bytes")
    source = f"CAST({_SOURCE} AS BINARY)"
    out = some(0, "plan", source).unionByName(some(0, "plan.png", f"unhex('{_PNG.hex()}')")).unionByName(some(1, "plan", source))
    out = out.unionByName(some(1, "plan.svg", "CAST('<?xml?><svg content=\"old\" width=\"5\"><g/></svg>' AS BINARY)"))
    return out.unionByName(some(2, "plan.drawio.svg", "CAST(lang AS BINARY)")).unionByName(some(3, "plan.png", f"unhex('{_PNG.hex()}')"))


# the chunk's length, kind, keyword and percent-encoded text, behind signature and header
_CHUNK = "'%3Cmxfile%3E' || source || '%3C%2Fmxfile%3E'"


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'plan.drawio.png' WHEN 3 THEN NULL ELSE 'plan.drawio.svg' END AS file,
 CASE doc_id % 4 WHEN 0 THEN lpad(to_hex(7 + length({_CHUNK})), 8, '0') || hex('tEXtmxfile') || '00' || hex({_CHUNK})
  WHEN 1 THEN hex('<?xml?><svg width="5" content="&lt;mxfile&gt;' || source || '&lt;/mxfile&gt;"><g/></svg>') WHEN 2 THEN hex(lang) END AS shown FROM documents""")
def diagram_assembly(spark, d):
    docs = read_table(spark, d, "documents")
    wanted = docs.select(F.col("doc_id").cast("string").alias("page_id"), F.lit("plan").alias("diagram"))
    made = diagrams.assembled(wanted, _attached(docs))
    # of a picture, the chunk that was put in
    size = F.conv(F.hex(F.substring("bytes", 34, 4)), 16, 10).cast("int")
    shown = F.when(F.col("file") == "plan.drawio.png", F.expr("substring(bytes, 34, 8 + _size)")).otherwise(F.col("bytes"))
    return made.withColumn("_size", size).select(F.col("page_id").cast("long").alias("doc_id"), "file", F.hex(shown).alias("shown"))


@query("""WITH f AS (SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN ['index.adoc', 'attache/plan', 'attache/plan.png', 'attache/plan.drawio.png'] WHEN 1 THEN ['index.adoc', 'attache/plan', 'attache/plan.svg', 'attache/plan.drawio.svg']
 WHEN 2 THEN ['index.adoc', 'attache/plan.drawio.svg'] ELSE ['index.adoc', 'attache/plan.png'] END) AS file FROM documents)
SELECT 'd' || doc_id || '/' || file AS path, CASE WHEN file <> 'index.adoc' THEN NULL WHEN doc_id % 4 = 3 THEN 'Diagram attachment access error: cannot display diagram'
 ELSE 'image::plan.drawio.' || CASE WHEN doc_id % 4 = 0 THEN 'png' ELSE 'svg' END || '[plan]' END AS shown, file = 'index.adoc' AS text FROM f""")
def export_attachments(spark, d):
    docs = read_table(spark, d, "documents")
    macro = '<ac:structured-macro ac:name="drawio"><ac:parameter ac:name="diagramName">plan</ac:parameter></ac:structured-macro>'
    pages = docs.select(F.col("doc_id").cast("string").alias("page_id"), F.concat(F.lit("d"), "doc_id").alias("title"), F.lit(macro).alias("storage"), F.lit("v").alias("version_when"))
    edges = spark.createDataFrame([], "parent_id string, child_id string, title string")
    files = export.export_tree(pages, edges, attached=_attached(docs))
    line = F.regexp_extract("content", r"(?m)^(image::.*|Diagram .*)$", 1)
    return files.select("path", line.alias("shown"), F.col("bytes").isNull().alias("text"))


@query("SELECT CAST(doc_id AS VARCHAR) AS page_id, name FROM documents, (VALUES ('same.txt'), ('new.txt'), ('other.txt')) v(name) WHERE name = 'other.txt' OR name = 'new.txt' AND doc_id % 3 = 0 OR name = 'same.txt' AND text IS DISTINCT FROM text || substr('x', 1, doc_id % 2)")
def attachment_skip(spark, d):
    """Attachments of every document: some are there with the same bytes, some with other bytes, some not at all."""
    docs = read_table(spark, d, "documents").selectExpr("CAST(doc_id AS STRING) AS page_id", "doc_id", "text")
    file = lambda name, text: docs.selectExpr("page_id", f"'{name}' AS name", f"CAST({text} AS BINARY) AS bytes")
    now = file("same.txt", "concat(text, substr('x', 1, CAST(doc_id % 2 AS INT)))").unionByName(file("new.txt", "text")).unionByName(file("other.txt", "text"))
    known = sinks.sent(file("same.txt", "text").unionByName(file("new.txt", "text").filter("CAST(page_id AS LONG) % 3 <> 0")).unionByName(file("other.txt", "concat(text, 'y')")))
    return sinks.unsent(now, known).select("page_id", "name")


# ---- substring search by an index ----

_SOUGHT = ("er the", "he", "and the ", " on", "the and of", "nothing at all")


@query(" UNION ALL ".join(f"SELECT '{q}' AS query, doc_id FROM documents WHERE contains(lower(text), '{q}')" for q in _SOUGHT))
def indexed_search(spark, d):
    """The same rows as a scan of all texts, from the index alone."""
    index = stored(textindex.indexed(dealt(read_table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text"))
    terms = cut(textindex.vocabulary(index))
    out = None
    for q in _SOUGHT:
        found = textindex.matches(index, terms, q).select(F.lit(q).alias("query"), F.col("id").alias("doc_id"))
        out = found if out is None else out.unionByName(found)
    return out
