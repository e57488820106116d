"""Diagrams put together from attachments, byte by byte; attachments and sources in exports; links of one page."""

import struct
import zlib
from urllib.parse import unquote

from docspark.operators import diagrams
from docspark.plans import catalog, export
from docspark.tree_queries import png

HEAD, DATA, END = (b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\x00\x01\x02")), (b"IEND", b"")
PLAIN = png((HEAD, DATA, END))
XML = "<mxfile><diagram name='ü &'>x</diagram></mxfile>"
MACRO = '<p>a</p><ac:structured-macro ac:name="drawio"><ac:parameter ac:name="diagramName">{}</ac:parameter></ac:structured-macro>'


def test_source_in_a_png():
    made = diagrams.in_png(PLAIN, XML)
    kinds = [k for k, _ in diagrams.chunks(made)]
    assert kinds == [b"IHDR", b"tEXt", b"IDAT", b"IEND"]
    body = dict(diagrams.chunks(made))[b"tEXt"]
    assert body.isascii() and b" " not in body and unquote(body.split(b"\0")[1].decode()) == XML
    # a second source takes the place of the first; all else stays
    again = diagrams.in_png(made, "<mxfile/>")
    assert [k for k, _ in diagrams.chunks(again)] == kinds and dict(diagrams.chunks(again))[b"IDAT"] == DATA[1]
    assert diagrams.carries(made) == ".drawio.png" and diagrams.carries(PLAIN) is None
    for broken in (PLAIN[:-3], PLAIN[:20], PLAIN.replace(b"IDAT", b"IDAX"), b"", b"\x89PNG"):
        assert diagrams.in_png(broken, XML) is None and diagrams.carries(broken) is None


def test_source_in_an_svg():
    made = diagrams.in_svg(b'<?xml version="1.0"?>\n<SVG width="1" content="old &lt;" height="2"><g content="mine"/></SVG>', '<a b="c">&')
    assert made == b'<?xml version="1.0"?>\n<SVG width="1" height="2" content="&lt;a b=&quot;c&quot;&gt;&amp;"><g content="mine"/></SVG>'
    assert diagrams.in_svg(b"<svg/>", "x") == b'<svg content="x"/>' and diagrams.in_svg(b"<p/>", "x") is None
    assert diagrams.carries(b'<svg content="&lt;mxfile"/>') == ".drawio.svg" and diagrams.carries(b"<svg/>") is None


def test_what_is_taken_first():
    carrying, raw = diagrams.in_png(PLAIN, XML), XML.encode()
    svg = b"<svg></svg>"
    asks = {
        (b"r", None, raw, PLAIN, svg): ("d.drawio.png", b"r"), (None, b"s", raw, PLAIN, svg): ("d.drawio.svg", b"s"), (None, None, raw, PLAIN, svg): ("d.drawio.png", carrying),
        (None, None, raw, None, svg): ("d.drawio.svg", diagrams.in_svg(svg, XML)), (None, None, raw, b"broken", svg): ("d.drawio.svg", diagrams.in_svg(svg, XML)),
        (None, None, raw, None, None): None, (None, None, carrying, None, None): ("d.drawio.png", carrying), (None, None, None, carrying, None): ("d.drawio.png", carrying),
        (None, None, None, PLAIN, svg): None, (None, None, b"no", None, b'<svg content="mxfile">'): ("d.drawio.svg", b'<svg content="mxfile">'), (None,) * 5: None,
    }
    for found, want in asks.items():
        assert diagrams.assemble("d", list(found)) == want


def test_tables_of_diagrams(spark):
    wanted = spark.createDataFrame([("1", "d"), ("1", "d"), ("2", "d"), ("3", "none"), ("4", None)], "page_id string, diagram string")
    files = [("1", "d", XML.encode()), ("1", "d.png", PLAIN), ("1", "d.png", PLAIN + b"z"), ("2", "d.drawio.png", b"x"), ("2", "d", None), ("9", "none", b"y")]
    attached = spark.createDataFrame([(p, n, None if b is None else bytearray(b)) for p, n, b in files], "page_id string, name string, bytes binary")
    got = {(r.page_id, r.diagram): (r.file, r.bytes and bytes(r.bytes)) for r in diagrams.assembled(wanted, attached).collect()}
    assert got == {("1", "d"): ("d.drawio.png", diagrams.in_png(PLAIN, XML)), ("2", "d"): ("d.drawio.png", b"x"), ("3", "none"): (None, None), ("4", None): (None, None)}
    assert diagrams.assembled(wanted.limit(0), attached).count() == 0


def test_export_with_files(spark):
    pages = spark.createDataFrame([("1", "A", MACRO.format("d"), "v"), ("2", "B", MACRO.format("gone"), "v")], "page_id string, title string, storage string, version_when string")
    edges = spark.createDataFrame([("1", "2", "B")], "parent_id string, child_id string, title string")
    attached = spark.createDataFrame([("1", "d", bytearray(XML.encode())), ("1", "d.png", bytearray(PLAIN)), ("1", "note.pdf", bytearray(b"p")), ("7", "x", bytearray(b"q"))], "page_id string, name string, bytes binary")
    tools = catalog.Catalog(spark, {"pages": pages, "edges": edges, "attachment_bytes": attached})
    call = lambda **more: {r.path: r for r in tools.call("confluence_export_tree_to_adoc", {"pageId": "1", "targetDir": "o", **more}).collect()}
    got = call(debug=True)
    assert {p for p, r in got.items() if "bytes" in r and r.bytes is not None} == {"o/A/attache/d", "o/A/attache/d.png", "o/A/attache/d.drawio.png", "o/A/attache/note.pdf"}
    assert "image::d.drawio.png[d]" in got["o/A/index.adoc"].content and "cannot display diagram" in got["o/A/B/index.adoc"].content
    assert got["o/A/source/storage.html"].content == MACRO.format("d") and '"page_id":"2"' in got["o/A/B/source/page.json"].content
    # without attachments nobody looks, and the name is a guess
    assert "image::gone.drawio.png[gone]" in call(includeAttachments="false")["o/A/B/index.adoc"].content
    assert not any("source" in p for p in call())


def test_links_of_one_page(spark):
    link = '<p><ac:link><ri:page ri:content-title="B"/></ac:link> <ac:link><ri:user ri:userkey="u"/></ac:link></p>'
    pages = spark.createDataFrame([("1", "A", link, "http://w/1", '<a href="http://v/B">B</a>'), ("2", "B", "", "http://w/2", "")], "page_id string, title string, storage string, url string, view string")
    users = spark.createDataFrame([("u", "Ann", "http://w/u")], "user_key string, title string, url string")
    tools = catalog.Catalog(spark, {"pages": pages, "users": users})
    text = lambda **more: tools.call("confluence_get_page", {"pageId": "1", "format": "md", **more}).first().text
    assert text() == "[B](http://v/B) [Ann](http://w/u)"
    assert text(fast=True).startswith("[B](http://v/B) [") and "http://mock" in text(fast="true")
    assert catalog.Catalog(spark, {"pages": pages.drop("view")}).call("confluence_get_page", {"pageId": "1", "format": "adoc"}).first().text.startswith("link:http://w/2[B]")
    assert export.with_links(pages.select("page_id", "storage"), pages, "md").count() == 2
