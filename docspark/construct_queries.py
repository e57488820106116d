"""Registered queries of the document rules, one construct each: markup around a word of every customer's row, and what it is to print as.

The expected texts are written by hand and their SQL only puts the word in; ``{x}`` stands for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import blocks, convert, publish
from docspark.shared import dealt
from docspark.sources.pages import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WORD = "lower(c_mktsegment)"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str) -> Column:
    return F.replace(F.lit(template), F.lit("{x}"), F.lower("c_mktsegment"))


def _sql(template: str) -> str:
    return f"replace({_literal(template)}, '{{x}}', {WORD})"


def construct(name: str, markup: str, adoc: str, md: str, **options) -> None:
    """A construct of storage markup or HTML in both output formats."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = dealt(read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")).select("c_custkey", _filled(markup).alias("html"))
        return convert.to_texts(rows, "html", {"adoc": None, "md": "attache"}, blocks.Options(**options), deal=False)

    QUERIES[f"block_{name}"] = run
    ORACLE_SQL[f"block_{name}"] = f"SELECT c_custkey, {_sql(adoc)} AS adoc, {_sql(md)} AS md FROM customer"


def published(name: str, source: str, storage: str) -> None:
    """A construct of AsciiDoc as storage markup."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = read_table(spark, d, "customer").select("c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit(".adoc")).alias("path"), _filled(source).alias("content"))
        return publish.to_storage(rows).select("c_custkey", "storage")

    QUERIES[f"publish_{name}"] = run
    ORACLE_SQL[f"publish_{name}"] = f"SELECT c_custkey, {_sql(storage)} AS storage FROM customer"


def macro(name: str, body: str = "", **params: str) -> str:
    p = "".join(f'<ac:parameter ac:name="{k}">{v}</ac:parameter>' for k, v in params.items())
    return f'<ac:structured-macro ac:name="{name}">{p}{body}</ac:structured-macro>'


def rich(x: str) -> str:
    return f"<ac:rich-text-body>{x}</ac:rich-text-body>"


def plain(x: str) -> str:
    return f"<ac:plain-text-body><![CDATA[{x}]]></ac:plain-text-body>"


construct("paragraph", "<p>a\n  {x}&amp;c</p><p>&nbsp;</p><p>end</p>", "a {x}&c\n\nend", "a {x}&c\n\nend")
construct("headings", "<h1>{x}</h1><h2>A <b>{x}</b></h2><h6>deep</h6>", "== {x}\n\n=== A **{x}**\n\n====== deep", "## {x}\n\n### A **{x}**\n\n###### deep")
construct("lists", "<ol><li>{x}<ul><li>b</li></ul></li><li>c</li></ol>", ". {x}\n** b\n. c", "1. {x}\n   - b\n2. c")
construct(
    "task_list", "<ac:task-list><ac:task><ac:task-status>complete</ac:task-status><ac:task-body>{x}</ac:task-body></ac:task><ac:task><ac:task-status>incomplete</ac:task-status><ac:task-body>b</ac:task-body></ac:task></ac:task-list>",
    "* [x] {x}\n* [ ] b", "- [x] {x}\n- [ ] b",
)
construct(
    "table", "<table><tr><th>A</th><th>{x}</th></tr><tr><td>1|2</td><td>{x}</td></tr></table>", '[cols="1a,1a"]\n|===\n|A |{x}\n\n|1\\|2\n|{x}\n\n|===', "| A | {x} |\n| --- | --- |\n| 1\\|2 | {x} |",
)
construct("divisions", "<div><p>{x}</p><p>b</p></div>", "{x}\n\nb", "{x}\n\nb")
construct("layout", "<ac:layout><ac:layout-section><ac:layout-cell><p>{x}</p></ac:layout-cell></ac:layout-section></ac:layout>", "{x}", "{x}")
construct("inline_marks", "<p><u>{x}</u><em>e</em><code>a*b</code><strong>x&nbsp;</strong>y</p>", "[.underline]##{x}##__e__`a*b`**x\u00a0**y", "<u>{x}</u>*e*`a*b`**x**\u00a0y")
construct("line_break", "<p>{x}<br/>b</p>", "{x} +\nb", "{x}\\\nb")
construct("external_link", '<p><a href="http://h/{x}">t]</a></p>', "link:http://h/{x}[t\\]]", "[t\\\\]](http://h/{x})")
construct("colour", '<p><span style="color:rgb(190,2,3);">{x}</span></p>', "[.red]##{x}##", '<span style="color: red">{x}</span>')
construct("colours_off", '<p><span style="color:rgb(190,2,3);">{x}</span></p>', "{x}", "{x}", colours=False)
construct("ac_link", '<p><ac:link ac:anchor="{x}"><ac:plain-text-link-body><![CDATA[t]]></ac:plain-text-link-body></ac:link></p>', "<<{x}, t>>", "[t](#{x})")
construct("ac_link_unresolved", '<p><ac:link><ri:page ri:content-title="{x}" ri:space-key="S"/></ac:link></p>', "link:http://mock[LinksPage[title={x}, space=S\\]]", "[LinksPage\\[title={x}, space=S\\\\]](http://mock)")
construct("ac_link_resolved", '<p><ac:link><ri:page ri:content-title="P" ri:space-key="S"/></ac:link> {x}</p>', "link:../P/index.adoc[P] {x}", "[P](../P/index.adoc) {x}", links={("page", "P", "S"): ("P", "../P/index.adoc")})
construct("ac_image", '<ac:image ac:width="10"><ri:attachment ri:filename="{x}.png"/></ac:image>', "image::{x}.png[width=10]", '<img src="attache/{x}.png" alt="" width="10">')
construct("img", '<img src="a/{x}.png"/>', "image::{x}.png[]", "![](attache/{x}.png)")
construct("time_and_comments", '<p><time datetime="2024-01-02"/> <ac:inline-comment-marker ac:ref="r">{x}</ac:inline-comment-marker></p>', "2024-01-02 {x}", "2024-01-02 {x}")
construct("placeholder", "<p>{x}</p><ac:placeholder>none</ac:placeholder>", "{x}", "{x}")
construct("emoticon", '<p>{x} <ac:emoticon ac:name="tick"/></p>', "{x} ✅", "{x} ✅")
construct("anchor", macro("anchor", **{"": "{x}"}), "[#{x}]", '<a id="{x}"></a>')
construct("children", macro("children") + "<p>{x}</p>", "* link:K/index.adoc[Kid]\n\n{x}", "- [Kid](K/index.adoc)\n\n{x}", children=(("Kid", "K/index.adoc"),))
construct("code", macro("code", plain('{"a": "{x}"}\n </p>')), '[source, json]\n----\n{"a": "{x}"}\n </p>\n----', '```json\n{"a": "{x}"}\n </p>\n```')
construct("plantuml", macro("plantuml", plain("a->{x}")), '[plantuml, format="png"]\n----\na->{x}\n----', "```plantuml\na->{x}\n```")
construct("expand", macro("expand", rich("<p>{x}</p>"), title="More"), "== More\n\n{x}", "## More\n\n{x}")
construct("warning", macro("warning", rich("<p>{x}</p>"), title="T"), ".T\n[WARNING]\n====\n{x}\n====", "> [!WARNING]\n> **T**\n> {x}")
construct("info", macro("info", rich("<p>{x}</p>")), "[NOTE]\n====\n{x}\n====", "> [!NOTE]\n> {x}")
construct("tip", macro("tip", rich("<p>{x}</p>")), "[TIP]\n====\n{x}\n====", "> [!TIP]\n> {x}")
construct("panel", macro("panel", rich("<p>{x}</p>")), "****\n{x}\n****", "> {x}")
construct("status", macro("status", colour="Green", title="{x}"), "[.status-green]#{x}#", "`{x}`")
construct("jira", macro("jira", key="AB-1") + "<p>{x}</p>", "link:https://jira.example.com/browse/AB-1[]\n\n{x}", "<https://jira.example.com/browse/AB-1>\n\n{x}")
construct("steps", macro("ui-steps", rich(macro("ui-step", rich("<p>{x}</p>")))), "---\n\n{x}", "---\n\n{x}")
construct("numbered_headings", macro("numberedheadings", rich("<p>{x}</p>")), ":sectnums:\n\n{x}", "{x}")
construct("unknown_macro", macro("nobody-knows", rich("<p>{x}</p>")), "{x}", "{x}")
construct("dropped_macros", macro("attachments", rich("<p>no</p>")) + macro("contentbylabel", rich("<p>no</p>")) + "<p>{x}</p>", "{x}", "{x}")
construct("toc", macro("toc") + "<p>{x}</p>", "toc::[]\n\n{x}", "{x}")
construct("broken_markup", "<p>{x}<p>b", "{x}\n\nb", "{x}\n\nb")
construct("scripts", "<script>var t='</p>';</script><p>{x}</p>", "{x}", "{x}")

published("section", "= T\n\n== {x}\n\ntext *b* _i_ `c`", "<h1>{x}</h1><p>text <strong>b</strong> <em>i</em> <code>c</code></p>")
published("lists", "* {x}\n** b\n* c", "<ul><li>{x}<ul><li>b</li></ul></li><li>c</li></ul>")
published("ordered_list", ". {x}\n. b", "<ol><li>{x}</li><li>b</li></ol>")
published("description_list", "t:: {x}", "<dl><dt>t</dt><dd>{x}</dd></dl>")
published("listing", "[source,python]\n----\na < {x}\n----", '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[a < {x}]]></ac:plain-text-body></ac:structured-macro>')
published("admonition", "WARNING: {x}", '<ac:structured-macro ac:name="note"><ac:rich-text-body><p>{x}</p></ac:rich-text-body></ac:structured-macro>')
published("alignment", "[.text-center]\n{x}", '<p style="text-align: center;">{x}</p>')
published("image", "image::a/{x}.png[alt,10]", '<ac:image ac:alt="alt" ac:width="10" ac:custom-width="true"><ri:attachment ri:filename="{x}.png"/></ac:image>')
published("link", "https://x.y[{x}]", '<p><a href="https://x.y">{x}</a></p>')
published("table", "|===\n|A |{x}\n\n|1\n|2\n|===", "<table><thead><tr><th>A</th><th>{x}</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>")
published("toc", "toc::[]\n\n{x}", '<ac:structured-macro ac:name="toc"><ac:parameter ac:name="maxLevel">2</ac:parameter></ac:structured-macro><p>{x}</p>')
published("escapes", "{x} < b & c", "<p>{x} &lt; b &amp; c</p>")
published("callouts", "[source]\n----\na <1>\n----\n<1> {x}\n<.> b *c*", '<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[a <1>]]></ac:plain-text-body></ac:structured-macro><ol><li>{x}</li><li>b <strong>c</strong></li></ol>')
published("conditionals", ":a: 1\n\nifdef::a[]\n{x}\nifndef::a[]\nno\nendif::[]\nendif::[]\n\nifdef::b[no]\nifeval::[{a} >= 1]\nyes\nendif::[]", "<p>{x}</p><p>yes</p>")
published("footnotes", "a footnote:[{x}] b footnote:n[two] c footnote:n[]", "<p>a <sup>[1]</sup> b <sup>[2]</sup> c <sup>[2]</sup></p><hr/><p>[1] {x}</p><p>[2] two</p>")
