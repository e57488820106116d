"""Conversion rules, one construct at a time, against texts written by hand."""

import json

import pytest
from docspark.functions import pure
from docspark.operators import anonymize, blocks, convert, dom, publish, writers


def both(markup, **options):
    tree, state = blocks.convert(markup, blocks.Options(**options))
    return writers.AsciiDoc()(tree), writers.Markdown("attache")(tree), state


def macro(name, body="", **params):
    p = "".join(f'<ac:parameter ac:name="{k}">{v}</ac:parameter>' for k, v in params.items())
    return f'<ac:structured-macro ac:name="{name}">{p}{body}</ac:structured-macro>'


def rich(x):
    return f"<ac:rich-text-body>{x}</ac:rich-text-body>"


def plain(x):
    return f"<ac:plain-text-body><![CDATA[{x}]]></ac:plain-text-body>"


@pytest.mark.parametrize(
    ("markup", "adoc", "md"),
    [
        ("<h2>A <b>b</b></h2>", "=== A **b**", "### A **b**"),
        ("<h6>deep</h6>", "====== deep", "###### deep"),
        ("<p>a\n  b&amp;c</p>", "a b&c", "a b&c"),
        ("<p>&nbsp;</p>", "", ""),
        ("<p><strong>x&nbsp;</strong>y</p>", "**x **y", "**x** y"),
        ("<p><u>u</u><em>e</em><code>a*b</code></p>", "[.underline]##u##__e__`a*b`", "<u>u</u>*e*`a*b`"),
        ('<p><a href="http://x">t]</a></p>', "link:http://x[t\\]]", "[t\\\\]](http://x)"),
        ("<p>a<br/>b</p>", "a +\nb", "a\\\nb"),
        ('<p><span style="color:rgb(190,2,3);">r</span></p>', "[.red]##r##", '<span style="color: red">r</span>'),
        ("<ol><li>a<ul><li>b</li></ul></li><li>c</li></ol>", ". a\n** b\n. c", "1. a\n   - b\n2. c"),
        ("<div><p>a</p><p>b</p></div>", "a\n\nb", "a\n\nb"),
        ("<section>flat <b>text</b></section>", "flat text", "flat text"),
        ('<img src="a/b.png"/>', "image::b.png[]", "![](attache/b.png)"),
        ('<ac:image ac:width="10"><ri:attachment ri:filename="p.png"/></ac:image>', "image::p.png[width=10]", '<img src="attache/p.png" alt="" width="10">'),
        ("<p><ac:emoticon ac:name=\"tick\"/></p>", "✅", "✅"),
        ("<p><time datetime=\"2024-01-02\"/></p>", "2024-01-02", "2024-01-02"),
        (macro("toc"), "toc::[]", ""),
        (macro("anchor", **{"": "here"}), "[#here]", '<a id="here"></a>'),
        (macro("warning", rich("<p>w</p>"), title="T"), ".T\n[WARNING]\n====\nw\n====", "> [!WARNING]\n> **T**\n> w"),
        (macro("panel", rich("<p>w</p>")), "****\nw\n****", "> w"),
        (macro("code", plain("{1}\n </p>")), "[source, json]\n----\n{1}\n </p>\n----", "```json\n{1}\n </p>\n```"),
        (macro("plantuml", plain("a->b")), '[plantuml, format="png"]\n----\na->b\n----', "```plantuml\na->b\n```"),
        (macro("expand", rich("<p>x</p>"), title="More"), "== More\n\nx", "## More\n\nx"),
        (macro("status", colour="Green", title="OK"), "[.status-green]#OK#", "`OK`"),
        (macro("jira", key="AB-1"), "link:https://jira.example.com/browse/AB-1[]", "<https://jira.example.com/browse/AB-1>"),
        (macro("ui-step", rich("<p>s</p>")), "---\n\ns", "---\n\ns"),
        (macro("numberedheadings", rich("<p>s</p>")), ":sectnums:\n\ns", "s"),
        (macro("nobody-knows", rich("<p>kept</p>")), "kept", "kept"),
        (macro("attachments", rich("<p>dropped</p>")), "", ""),
        ('<p><ac:link ac:anchor="a"><ac:plain-text-link-body><![CDATA[t]]></ac:plain-text-link-body></ac:link></p>', "<<a, t>>", "[t](#a)"),
    ],
)
def test_construct(markup, adoc, md):
    assert both(markup)[:2] == (adoc, md)


def test_task_list():
    task = "<ac:task><ac:task-status>{}</ac:task-status><ac:task-body>{}</ac:task-body></ac:task>"
    markup = "<ac:task-list>" + task.format("complete", "a") + task.format("incomplete", "b") + "</ac:task-list>"
    assert both(markup)[:2] == ("* [x] a\n* [ ] b", "- [x] a\n- [ ] b")


def test_tables():
    simple = "<table><tr><th>A</th><th>B</th></tr><tr><td>1|2</td><td>3</td></tr></table>"
    adoc, md, _ = both(simple)
    assert adoc == '[cols="1a,1a"]\n|===\n|A |B\n\n|1\\|2\n|3\n\n|==='
    assert md == "| A | B |\n| --- | --- |\n| 1\\|2 | 3 |"
    spans = '<table><colgroup><col style="width: 20.4px"/><col width="30px"/></colgroup><tbody><tr><td colspan="2" rowspan="2">x</td></tr><tr><th>h</th><td><ul><li>l</li></ul></td></tr></tbody></table>'
    adoc, md, _ = both(spans)
    assert adoc == '[cols="20a,30a"]\n|===\n2.2+|x\n\nh|h\na|* l\n\n|==='
    assert '<td colspan="2" rowspan="2">x</td>' in md and "<td><ul><li>l</li></ul></td>" in md


def test_links_resolve_and_fall_back():
    link = '<p><ac:link><ri:page ri:content-title="P" ri:space-key="S"/></ac:link></p>'
    assert both(link)[0] == "link:http://mock[LinksPage[title=P, space=S\\]]"
    assert both(link, links={("page", "P", "S"): ("P", "../P/index.adoc")})[0] == "link:../P/index.adoc[P]"
    user = '<p><ac:link><ri:user ri:userkey="u1"/></ac:link></p>'
    assert both(user, links={("user", "u1", None): ("Ann", "http://u")})[0] == "link:http://u[Ann]"


def test_long_code_goes_to_a_file():
    adoc, _, state = both(macro("code", plain("x\n" * 12)), in_memory=False)
    assert adoc == "[source]\n----\ninclude::files/include_file_1[]\n----"
    assert [p for p, _ in state.files] == ["files/include_file_1"]


def test_broken_markup():
    root = dom.parse("<p><b>one<br><p>two</p><ul><li>x<li>y</ul>")
    assert [e.name for e in dom.body(root)] == ["p", "p", "ul"]
    assert both("<p>a<p>b")[0] == "a\n\nb"
    assert both(None)[:2] == ("", "") and both("")[:2] == ("", "")
    assert both("<script>var t='</p>';</script><p>t</p>")[0] == "t"


def test_rows(spark):
    df = spark.createDataFrame([(1, "<h1>H</h1><p>x</p><ul><li>a</li></ul>"), (2, None)], "page_id int, html string")
    got = [tuple(r) for r in convert.block_rows(df).orderBy("page_id", "node_id").collect()]
    assert [(g[0], g[5], g[7]) for g in got] == [(1, "heading", "H"), (1, "paragraph", "x"), (1, "list", ""), (1, "item", "a")]
    links = spark.createDataFrame([(1, '<ac:link><ri:page ri:content-title="P"/></ac:link><ac:link><ri:page ri:content-title="P"/></ac:link>')], "page_id int, html string")
    assert [(r.kind, r.key) for r in convert.link_rows(links).collect()] == [("page", "P")]
    cells = spark.createDataFrame([(1, "<table><tr><th>A</th></tr><tr><td colspan='2'>b</td></tr></table>")], "page_id int, html string")
    assert [(r.row_no, r.colspan, r.header, r.text) for r in convert.cell_rows(cells).orderBy("row_no").collect()] == [(0, 1, True, "A"), (1, 2, False, "b")]


@pytest.mark.parametrize(
    ("source", "storage"),
    [
        ("= T\n\n== A\n\ntext *b* _i_ `c`", "<h1>A</h1><p>text <strong>b</strong> <em>i</em> <code>c</code></p>"),
        ("* a\n** b\n* c", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
        (". a\n. b", "<ol><li>a</li><li>b</li></ol>"),
        ("t:: d", "<dl><dt>t</dt><dd>d</dd></dl>"),
        ("[source,python]\n----\na < b\n----", '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[a < b]]></ac:plain-text-body></ac:structured-macro>'),
        ("WARNING: hot", '<ac:structured-macro ac:name="note"><ac:rich-text-body><p>hot</p></ac:rich-text-body></ac:structured-macro>'),
        ("[.text-center]\nmid", '<p style="text-align: center;">mid</p>'),
        ("image::a/b.png[alt,10]", '<ac:image ac:alt="alt" ac:width="10" ac:custom-width="true"><ri:attachment ri:filename="b.png"/></ac:image>'),
        ("https://x.y[l]", '<p><a href="https://x.y">l</a></p>'),
        ("|===\n|A |B\n\n|1\n|2\n|===", "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"),
        ("toc::[]", '<ac:structured-macro ac:name="toc"><ac:parameter ac:name="maxLevel">2</ac:parameter></ac:structured-macro>'),
        ("a < b & c", "<p>a &lt; b &amp; c</p>"),
    ],
)
def test_publish(source, storage):
    assert publish.render(source)[0] == storage


def test_round_trip_of_admonitions():
    """A warning comes back as a note, as it does in the reference behaviour."""
    adoc = both(macro("warning", rich("<p>w</p>")))[0]
    assert 'ac:name="note"' in publish.render(adoc)[0]


def test_cross_document_links():
    c = publish.Context("a/x.adoc", {"b/y.adoc": "Why"}, {"here": "b/y.adoc"})
    assert publish.inline("<<here,see>>", c).startswith('<ac:link ac:anchor="here"><ri:page ri:content-title="Why"/>')
    assert publish.inline("xref:../b/y.adoc#p[l]", c).startswith('<ac:link ac:anchor="p"><ri:page ri:content-title="Why"/>')


def test_anonymizer():
    a, b = anonymize.Anonymizer("k"), anonymize.Anonymizer("k")
    adoc = "= Secret plan\n:author: John\n[source, java]\nfile.adoc: see Secret"
    assert a.adoc(adoc) == b.adoc(adoc) != anonymize.Anonymizer("other").adoc(adoc)
    out = a.adoc(adoc)
    assert "Secret" not in out and "John" not in out and "[source, java]" in out and ":author:" in out and ".adoc" in out
    html = '<p title="Bob">Ann <ac:link><ri:user ri:userkey="abc12345"/></ac:link></p>' + macro("code", plain("int Secret;"), language="java")
    out = a.html(html)
    assert "Ann" not in out and "abc12345" not in out and "Bob" not in out and "Secret" not in out and ">java<" in out and "<![CDATA[" in out
    out = json.loads(a.json(json.dumps({"title": "My page", "author": "Ann", "n": 1, "url": "http://h/x?pageId=77", "attachment": {"a.png": {"title": "q"}}})))
    assert out["n"] == 1 and out["author"] != "Ann" and "77" not in out["url"] and next(iter(out["attachment"])).endswith(".png")
    assert a.file_name("x.drawio.png").endswith(".drawio.png") and a.json("not json") != "not json"


def test_pure():
    assert pure.safe_folder(" a/b:c. ") == "a_b_c" and pure.safe_folder(None) == "page" and pure.safe_folder("..") == "page"
    assert pure.nearest_colour("color: red") == "red" and pure.nearest_colour("color:black") is None and pure.nearest_colour("color:rgb(1, 2, 3)") is None
    assert pure.relative_path("a/b", "a/c/d") == "../c/d" and pure.code_language("JSON") == "js" and pure.code_language("x") is None
