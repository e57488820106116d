"""Plans, tools, sources, sinks and streams on small tables."""

import json

import pytest
from docspark.functions import columns as c
from docspark.operators import links, relational, sitemap, split
from docspark.plans import catalog, export
from docspark.sources import pages, rest, sinks
from docspark.streaming import incremental
from pyspark.sql import functions as F


def test_split(spark):
    df = spark.createDataFrame([(1, "intro\n== A\nx\n== B\ny\n"), (2, "== only"), (3, "none"), (4, None), (5, "")], "id int, text string")
    got = {(r.id, r.part): (r.file, r.content) for r in split.sections(df).collect()}
    assert got[1, 0] == ("index.adoc", "intro\n\ninclude::1_A.adoc[]\n\ninclude::2_B.adoc[]")
    assert got[1, 1] == ("1_A.adoc", ":imagesdir: ./attache\n== A\nx")
    assert got[2, 0][1] == "\ninclude::1_only.adoc[]" and got[3, 0] == ("index.adoc", "none") and got[5, 0] == ("index.adoc", "")
    assert not any(k[0] == 4 for k in got)


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b", "B/1"), ("b", "c", "C"), ("c", "a", "A"), ("a", "c", "C")], "parent_id string, child_id string, title string")
    roots = spark.createDataFrame([("a", "A")], "id string, title string")
    got = {r.id: (r.path, r.depth) for r in sitemap.closure(edges, roots).collect()}
    assert got == {"a": ("A", 0), "b": ("A/B_1", 1), "c": ("A/C", 1)}


def test_closure_of_a_deep_tree(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1), "K") for i in range(64)], "parent_id string, child_id string, title string")
    got = {r.id: r.depth for r in sitemap.closure(edges, spark.createDataFrame([("0", "R")], "id string, title string")).collect()}
    assert got == {str(i): i for i in range(65)}


def test_cross_path(spark):
    df = spark.createDataFrame([("a/b", "a/c/d"), ("a", "a/x"), ("", "q"), ("p/q", "r")], "a string, b string")
    assert [r[0] for r in df.select(links.cross_path(F.col("a"), F.col("b"))).collect()] == ["../c/d", "x", "q", "../../r"]


def test_columns(spark):
    df = spark.createDataFrame([(" a<b>: *bold* &amp; x ",)], "t string")
    assert df.select(c.plain_title("t")).first()[0] == "a: bold & x"
    one = spark.range(1)
    assert one.select(c.emphasis("**", F.lit(" x y "))).first()[0] == " **x y** " and one.select(c.emphasis("**", F.lit("  "))).first()[0] == "  "
    assert one.select(c.style_colour(F.lit("color:rgb(190,1,1)"))).first()[0] == "red"
    assert one.select(c.column_width(F.lit("width: 20.5px"), F.lit(None).cast("string"))).first()[0] == 21
    assert one.select(c.display_title(F.lit("http://h/display/S/My%20page?x"))).first()[0] == "My page"
    assert one.select(c.file_title(F.lit("x\n== The `t`\n"), F.lit("a/b.c.adoc"))).first()[0] == "The t"
    assert one.select(c.file_title(F.lit("x"), F.lit("a/b.c.adoc"))).first()[0] == "b.c"
    assert one.select(c.encode_path(F.lit("a b/ü"))).first()[0] == "a%20b/%C3%BC"


@pytest.fixture
def tables(spark):
    make = spark.createDataFrame
    return {
        "issues": make([("A-1", "one", "ann", None), ("A-2", "two", None, None)], "issue_key string, summary string, assignee string, epic_key string"),
        "issue_links": make([("1", "Blocks", "A-1", "A-2")], "link_id string, type string, inward string, outward string"),
        "link_types": make([("Blocks", "is blocked by", "blocks", 0)], "name string, inward string, outward string, ord int"),
        "pages": make([("1", "Root", "<p>x</p>", "S", "v1"), ("2", "Kid", "<p>some words</p>", "S", "v1")], "page_id string, title string, storage string, space string, version_when string"),
        "edges": make([("1", "2", "Kid", 0)], "parent_id string, child_id string, title string, ord int"),
        "page_labels": make([("1", ["a"])], "page_id string, labels array<string>"),
        "templates": make([("Bug", "body", ""), ("", "x", "")], "issue_type string, body string, workflow string"),
        "page_versions": make([("1", 1, "old"), ("1", 2, "new")], "page_id string, version int, text string"),
    }


def test_tools(spark, tables):
    assert len(catalog.ALL) == 75
    assert sum(n.startswith("jira_") for n in catalog.ALL) == 42 and sum(n.startswith("bitbucket_") for n in catalog.ALL) == 10
    tools = catalog.Catalog(spark, tables)
    assert tools.call("jira_get_issue", {"issueKey": "A-1"}).first().summary == "one"
    assert tools.call("jira_search", {"jql": "assignee is null"}).count() == 1
    assert tools.call("jira_assign_issue", {"issueKey": "A-2", "username": "bob"}).filter("assignee = 'bob'").count() == 1
    made = tools.call("jira_create_issue", {"projectKey": "A", "issueType": "Bug", "summary": "new", "assignee": "ann", "links": [{"type": "blocks", "issue": "A-1"}, {"type": "blocks"}]}).first()
    assert made.key == "A-3" and made.warnings == ["project_key: no such field", "issue_type: no such field", "link: type and issue are needed"]
    assert tools.tables["issues"].filter("issue_key = 'A-3' and summary = 'new' and assignee = 'ann'").count() == 1 and tools.tables["issue_links"].filter("inward = 'A-3' and outward = 'A-1'").count() == 1
    with pytest.raises(catalog.ToolError):
        tools.call("jira_create_issue", {"issueType": "Bug", "summary": "new"})
    for bad in ([], [{"projectKey": "A", "summary": "no type"}], ["x"]):
        with pytest.raises(catalog.ToolError):
            tools.call("jira_batch_create_issues", {"issues": bad})
    tools = catalog.Catalog(spark, tables)
    assert tools.call("jira_delete_issue", {"issueKey": "A-1"}).count() == 1
    assert tools.call("jira_link_issues", {"inwardIssue": "A-2", "outwardIssue": "A-3", "type": "IS BLOCKED BY"}).filter("type = 'Blocks'").count() == 2
    with pytest.raises(catalog.ToolError):
        tools.call("jira_link_issues", {"inwardIssue": "x", "outwardIssue": "y", "type": "zzz"})
    assert tools.call("confluence_search", {"query": "Kid"}).collect()[0].page_id == "2"
    assert tools.call("confluence_search", {"query": "some words"}).collect()[0].tier == 3
    assert tools.call("confluence_add_labels", {"pageId": "1", "labels": ["a", "b"]}).first().labels == ["a", "b"]
    assert tools.call("confluence_get_page", {"pageId": "1", "format": "md"}).first().text == "x"
    assert tools.call("confluence_get_page_diff", {"pageId": "1", "fromVersion": 1}).first().new_text == "new"
    assert tools.call("jira_list_templates").count() == 1
    with pytest.raises(catalog.ToolError):
        tools.call("jira_get_issue", {})


def test_json_rpc(spark, tables):
    tools = catalog.Catalog(spark, tables, kinds=["CONFLUENCE"])
    listed = json.loads(tools.respond('{"id":1,"method":"tools/list"}'))
    assert len(listed["result"]["tools"]) == 23
    called = json.loads(tools.respond('{"id":2,"method":"tools/call","params":{"name":"confluence_get_labels","arguments":{"pageId":"1"}}}'))
    assert not called["result"]["isError"] and '"labels":["a"]' in called["result"]["content"][0]["text"]
    assert json.loads(tools.respond('{"id":3,"method":"tools/call","params":{"name":"jira_list_team"}}'))["result"]["isError"]
    assert tools.respond('{"method":"x"}') is None and json.loads(tools.respond("nope"))["error"]["code"] == -32700


def test_tools_without_paging_give_all_rows(spark, tables):
    kids = spark.createDataFrame([("1", str(i), f"Kid {i}", i) for i in range(130)], "parent_id string, child_id string, title string, ord int")
    projects = spark.createDataFrame([(f"P{i}",) for i in range(130)], "project_key string")
    tools = catalog.Catalog(spark, tables | {"edges": kids, "projects": projects, "spaces": projects, "page_comments": kids.withColumnRenamed("parent_id", "page_id")})
    assert [r.ord for r in tools.call("confluence_get_child_pages", {"pageId": "1"}).collect()] == list(range(130))
    assert tools.call("jira_list_projects").count() == 130
    assert tools.call("confluence_list_spaces").count() == 50 and tools.call("confluence_list_spaces", {"start": 100, "limit": 99}).count() == 30
    call = '{"id":2,"method":"tools/call","params":{"name":"confluence_get_comments","arguments":{"pageId":"1"}}}'
    assert len(json.loads(json.loads(tools.respond(call))["result"]["content"][0]["text"])) == 130


def test_export_skips_unchanged(spark, tables):
    every = export.export_tree(tables["pages"], tables["edges"], root="1", form="md")
    assert {r.path for r in every.collect()} == {"Root/index.md", "Root/Kid/index.md"}
    state = spark.createDataFrame([("1", "v1"), ("2", "v0")], "page_id string, version_when string")
    assert [r.page_id for r in export.export_tree(tables["pages"], tables["edges"], root="1", state=state).collect()] == ["2"]


def test_publish_plan(spark):
    made = spark.createDataFrame([("1", "same"), ("2", "new"), ("3", "x")], "page_id string, storage string")
    remote = made.filter("page_id <> '3'").select("page_id", F.lit(4).alias("number"), F.when(F.col("page_id") == "1", c.content_hash("storage")).otherwise("old").alias("content_hash"))
    got = {r.page_id: (r.action, r.number) for r in export.publish_plan(made, remote).collect()}
    assert got == {"1": ("skipped", 4), "2": ("updated", 5), "3": ("created", 1)}
    files = spark.createDataFrame([("a", "= T\nx"), ("b", "y")], "path string, content string")
    got = {r.path: r.content for r in export.with_ids(files, spark.createDataFrame([("a", "7")], "path string, page_id string")).collect()}
    assert got == {"a": "= T\n:confluency-id: 7\nx", "b": "y"}


def test_paging_bounds():
    assert [relational.clamp_limit(x) for x in (None, 0, 7, 1000)] == [50, 1, 7, 100] and relational.clamp_start(-3) == 0


def test_json_pages(spark):
    text = json.dumps({"id": "5", "title": "T", "extra": 1, "version": {"when": "w"}, "body": {"storage": {"value": "<p/>"}}, "_links": {"webui": "/x"}})
    row = pages.pages_from_json(spark.createDataFrame([(text,), ("broken",), (None,)], "json string")).orderBy(F.desc("page_id")).first()
    assert (row.page_id, row.title, row.url, row.version_when, row.storage, row.author) == ("5", "T", "/x", "w", "<p/>", None)
    hits = spark.createDataFrame([('{"results":[{"title":"A","space":{"key":"S"},"_links":{"webui":"/a"}}]}',)], "json string")
    assert tuple(pages.search_hits(hits, base="http://h").first()) == ("A", "S", "http://h/a")


def test_paged_source(spark, tmp_path):
    for start, n in ((0, 2), (2, 1)):
        (tmp_path / f"{start}.json").write_text(json.dumps({"results": [{"id": start + i, "title": "t"} for i in range(n)]}))
    spark.dataSource.register(rest.PagedJson)
    assert {r.id for r in spark.read.format("paged_json").option("pagesize", 2).load(str(tmp_path)).collect()} == {"0", "1", "2"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a/x.adoc", "1"), ("b.adoc", "2")], "path string, content string")
    sinks.write_files(df, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.content) for r in pages.read_adoc(spark, str(tmp_path)).collect()} == {("x.adoc", "1"), ("b.adoc", "2")}
    assert sinks.archive(df)[:2] == b"PK"
    log = spark.createDataFrame([("k", "1", 1), ("k", None, 2), ("m", "3", 1)], "k string, v string, o int")
    assert [tuple(r) for r in sinks.last_write(log, ["k"], "v", "o").collect()] == [("m", "3")]


def test_attachments_that_are_there_stay(spark):
    attached = spark.createDataFrame([("1", "a.png", bytearray(b"x")), ("1", "b.png", bytearray(b"y")), ("2", "a.png", bytearray(b"x")), ("1", "n", None)], "page_id string, name string, bytes binary")
    assert {(r.page_id, r.name) for r in sinks.unsent(attached, sinks.sent(attached.limit(0))).collect()} == {("1", "a.png"), ("1", "b.png"), ("2", "a.png")}
    known = sinks.sent(attached.filter("page_id = '1'"))
    changed = attached.filter("name <> 'b.png'").unionByName(spark.createDataFrame([("1", "b.png", bytearray(b"z"))], attached.schema))
    assert {(r.page_id, r.name) for r in sinks.unsent(changed, known).collect()} == {("1", "b.png"), ("2", "a.png")}


def test_stream_converts_only_what_changed(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    write = lambda rows: spark.createDataFrame(rows, "page_id string, html string").write.mode("append").parquet(source)
    write([("1", "<p>a</p>"), ("2", "<p>b</p>")])
    incremental.convert_stream(spark, source, target, state).awaitTermination()
    write([("1", "<p>a</p>"), ("2", "<p>c</p>")])
    incremental.convert_stream(spark, source, target, state).awaitTermination()
    assert spark.read.parquet(target).count() == 3
    assert {r.page_id: r.text for r in incremental.latest(spark, target).collect()} == {"1": "a", "2": "c"}


def test_stream_follows_a_page_that_returns_to_an_earlier_text(spark, tmp_path):
    """A, B, A; a late version is passed over; a stream that has nothing new gives nothing."""
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "page_id string, html string, version int"
    batches = ([("1", "<p>a</p>", 1)], [("1", "<p>b</p>", 2), ("1", "<p>old</p>", 1)], [("1", "<p>a</p>", 3)], [("1", "<p>a</p>", 4)], [("1", "<p>late</p>", 2), ("2", None, None)], [])
    for rows in batches:
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        incremental.convert_stream(spark, source, target, state, schema, order="version").awaitTermination()
        now = {r.page_id: r.text for r in incremental.latest(spark, target).collect()}
        assert now["1"] == (rows[0][1][3] if rows and "late" not in rows[0][1] else "a")
    assert sorted((r.page_id, r.change) for r in spark.read.parquet(target).collect()) == [("1", 1), ("1", 2), ("1", 3), ("2", 1)]
    assert {(r.page_id, r.change) for r in incremental.current(spark, state).collect()} == {("1", 3), ("2", 1)}


def test_numbered_pages_of_skewed_rows(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id", "repeat('x', 200) AS wide")
    got = [(r.k, r.id, r.place, r.page_no) for r in relational.numbered_pages(df, ["k", "id"], 64).collect()]
    want = sorted((0 if i % 3 == 0 else i, i) for i in range(5000))
    assert sorted(got) == [(k, i, n, n // 64) for n, (k, i) in enumerate(want)]


def test_closure_of_many_paths(spark):
    """Layers that are linked fully have 6 ** 8 paths and 48 pages."""
    edges = spark.createDataFrame([(f"{a}.{i}", f"{a + 1}.{j}", f"P{j}") for a in range(8) for i in range(6) for j in range(6)], "parent_id string, child_id string, title string")
    got = sitemap.closure(edges, spark.createDataFrame([("0.0", "R")], "id string, title string")).collect()
    assert len(got) == 1 + 8 * 6 and max(r.depth for r in got) == 8 and {r.path for r in got if r.depth == 2} == {f"R/P0/P{j}" for j in range(6)}


def test_queries_of_issues(spark, tables):
    tools = catalog.Catalog(spark, tables)
    keys = lambda q: [r.issue_key for r in tools.call("jira_search", {"jql": q}).collect()]
    assert keys('summary ~ "one" ORDER BY issue_key') == ["A-1"] and keys("order by key desc") == ["A-2", "A-1"]
    assert keys("key in (A-1, 'a-2') and not assignee is empty") == ["A-1"] and keys('text ~ "TWO" or assignee = ANN') == ["A-1", "A-2"]
    for bad in ("1 = 1", "summary like '%'", "summary = 'a' drop", "(key = 1", "nothing = 1", "key"):
        with pytest.raises(catalog.ToolError):
            tools.call("jira_search", {"jql": bad})


def test_tools_read_typed_arguments_and_lists(spark, tables):
    issues = spark.createDataFrame([("A-1", ["x"], 1, None), ("A-2", None, 2, "A-1")], "issue_key string, labels array<string>, points int, parent_key string")
    tools = catalog.Catalog(spark, tables | {"issues": issues})
    assert tools.call("jira_create_issue", {"projectKey": "B", "issueType": "Bug", "summary": "s", "labels": ["a", "b"]}).first().key == "B-1"
    made = tools.tables["issues"]
    assert [r.labels for r in made.filter("size(labels) = 2").collect()] == [["a", "b"]]
    assert tools.call("jira_update_issue", {"issueKey": "A-1", "fields": {"labels": ["q"], "points": "7"}}).filter("labels[0] = 'q' and points = 7").count() == 1
    with pytest.raises(catalog.ToolError):
        tools.call("jira_delete_issue", {"issueKey": "A-1"})
    with pytest.raises(catalog.ToolError):
        tools.call("jira_search", {"jql": "key = 1", "maxResults": "many"})


def test_files_stay_in_their_folder_and_apart(spark, tmp_path):
    for rows in ([("a", "1"), ("a", "2")], [("../x", "1")], [("/x", "1")], [(None, "1")]):
        with pytest.raises(ValueError, match="paths"):
            sinks.write_files(spark.createDataFrame(rows, "path string, content string"), str(tmp_path))
    sinks.write_files(spark.createDataFrame([("a/b", bytearray(b"\x00\xff")), ("a/b", bytearray(b"\x00\xff"))], "path string, content binary"), str(tmp_path))
    assert (tmp_path / "a/b").read_bytes() == b"\x00\xff"


def test_bundles(spark):
    files = [("s/storage.html", b"<p>Secret words</p>"), ("s/page.json", b'{"title":"Secret","n":1}'), ("s/attache/plan.pdf", b"x"), ("s/other.txt", b"x")]
    from docspark.plans import bundles

    made = bundles.anonymized_export(spark.createDataFrame([(p, bytearray(b)) for p, b in files], "path string, bytes binary"))
    got = {r.path: bytes(r.bytes) for r in made.collect()}
    assert len(got) == 3 and not any(b"Secret" in b for b in got.values()) and not any("plan" in p for p in got) and all(p.startswith("s/") for p in got)
    assert bundles.counted(made, bundles.EXPORT_KINDS).first().asDict() == {"html": 1, "json": 1, "attachment": 1}
    assert bundles.report_archive(spark, bundles.bug_report({"a": "b"}, lambda: spark.range(2)))[:2] == b"PK"


def test_anonymised_urls():
    from docspark.operators.anonymize import Anonymizer

    a = Anonymizer("k")
    out = a.url("https://wiki.corp.com:8443/display/~jdoe/Secret+Page?pageId=12345&spaceKey=ABC#top")
    assert not any(x in out for x in ("corp", "jdoe", "Secret", "12345", "ABC", "top")) and "/display/~" in out and "pageId=" in out and out == a.url("https://wiki.corp.com:8443/display/~jdoe/Secret+Page?pageId=12345&spaceKey=ABC#top")
    made = json.loads(a.json('{"displayName":"Jane Doe","userKey":"8a7f","title":"My plan","when":"2023-02-03","webui":"/display/X/My","value":"<p>Plan</p>","n":3,"x":"kept"}'))
    assert made["n"] == 3 and made["x"] == "kept" and "Plan" not in made["value"] and made["value"].startswith("<p>")
    assert not {"Jane Doe", "8a7f", "My plan", "2023-02-03", "/display/X/My"} & set(map(str, made.values()))
