"""Transclusion, page trees by doubling, publish roots, and stand-ins that are one to one."""

import itertools
import pathlib
import random
import string
from collections import Counter

import duckdb
from docspark import tree_queries
from docspark.operators import convert, includes, sitemap
from docspark.operators.anonymize import Anonymizer
from docspark.operators.standins import StandIns
from docspark.plans import export
from docspark.shared import shared_folder
from hypothesis import given, settings
from hypothesis import strategies as st


def whole(spark, files, **more):
    df = spark.createDataFrame([(*r, "kept") for r in files.items()], "path string, content string, root string").repartition(3)
    return {r.path: r.content for r in includes.expanded(df, **more).collect()}


def test_nested_includes_from_each_files_folder(spark):
    files = {"a/m.adoc": "x\ninclude::p/one.txt[]\ny", "a/p/one.txt": "1\ninclude::q/two.txt[]\n", "a/p/q/two.txt": "2\ninclude::../../../top.txt[]", "top.txt": "t\r\nu\n\n", "plain.adoc": "no include::x.txt[] here"}
    got = whole(spark, files)
    assert got["a/m.adoc"] == "x\n1\n2\nt\nu\n\ny" and got["plain.adoc"] == files["plain.adoc"] and got["a/p/one.txt"] == "1\n2\nt\nu\n\n"


def test_circles_and_depth_end(spark, monkeypatch):
    files = {"m.adoc": "include::a.txt[]\n", "a.txt": "a\ninclude::b.txt[]\n", "b.txt": "b\ninclude::a.txt[]\n"}
    assert whole(spark, files)["m.adoc"] == "a\nb\nUnresolved directive in b.txt - include::a.txt[]\n"
    chain = {f"c{i}.txt": f"{i}\ninclude::c{i + 1}.txt[]\n" for i in range(6)}
    monkeypatch.setattr(includes, "DEPTH", 3)
    assert whole(spark, chain | {"m.adoc": "include::c0.txt[]"})["m.adoc"].startswith("0\n1\n2\nUnresolved directive in c2.txt")


def test_missing_optional_escaped_and_pages(spark):
    text = "include::gone.txt[]\ninclude::gone.txt[opts=optional]\n\\include::gone.txt[]\ninclude::other.adoc[]\ninclude::OTHER.ADOC[leveloffset=1]\n include::gone.txt[]\nend"
    got = whole(spark, {"d/m.adoc": text, "d/none.adoc": None, "d/empty.adoc": ""})
    assert got["d/m.adoc"] == "Unresolved directive in d/m.adoc - include::gone.txt[]\n" + "\n".join(text.split("\n")[2:])
    assert got["d/none.adoc"] is None and got["d/empty.adoc"] == ""


def test_lines_tags_and_attributes(spark):
    x = "1\n2\n# tag::a[]\n4\n# tag::b[]\n6\n# end::b[]\n8\n# end::a[]\n10"
    asks = {"lines=2": "2\n", "lines=1..2;10": "1\n2\n10\n", 'lines="9..,1"': "1\n# end::a[]\n10\n", "lines=9..-1": "# end::a[]\n10\n", "tag=a": "4\n6\n8\n", "tags=a;!b": "4\n8\n", "tags=**": "1\n2\n4\n6\n8\n10\n",
            "tags=*": "4\n6\n8\n", "tags=!a": "1\n2\n10\n", "tag=none": "", "indent=2,lines=1..2": "  1\n  2\n", "lines=99": ""}
    got = whole(spark, {f"m{i}.adoc": f":dir: sub\ninclude::{{dir}}/x.txt[{a}]\n" for i, a in enumerate(asks)} | {"sub/x.txt": x, "h.adoc": "include::h.txt[leveloffset=+1]", "h.txt": "= A\n== B\ntext"})
    assert [got[f"m{i}.adoc"] for i in range(len(asks))] == [f":dir: sub\n{want}" for want in asks.values()]
    assert got["h.adoc"] == "== A\n=== B\ntext\n"


def test_an_empty_tree_and_equal_paths(spark):
    assert includes.expanded(spark.createDataFrame([], "path string, content string")).count() == 0
    df = spark.createDataFrame([("a.adoc", "include::x.txt[]"), ("x.txt", "b"), ("x.txt", "a"), ("long.adoc", "w " * 200_000 + "\ninclude::x.txt[]\n")], "path string, content string")
    got = {r.path: r.content for r in includes.expanded(df).filter("path like '%.adoc'").collect()}
    assert got["a.adoc"] == "a\n" and got["long.adoc"] == "w " * 200_000 + "\na\n"


def test_exported_code_is_published_as_it_was(spark):
    """Code that goes to a file of its own, that holds fences or directives, and short code."""
    codes = ["\n".join(f"line {i}" for i in range(40)), "a\n----\nb", "\n".join(["-----", *"abcdefghijkl", "----"]), "include::x.txt[]\nb", "x"]
    storage = [f'<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[{c}]]></ac:plain-text-body></ac:structured-macro>' for c in codes]
    pages = spark.createDataFrame([(str(i), f"P{i}", s, "v") for i, s in enumerate(storage)], "page_id string, title string, storage string, version_when string")
    files = export.export_tree(pages, spark.createDataFrame([], "parent_id string, child_id string, title string"), lines=10**6).select("path", "content")
    made = {r.path: r.storage for r in export.publish_files(files).collect()}
    assert len(made) == len(codes) and all(f"<![CDATA[{c}]]>" in made[f"P{i}/index.adoc"] for i, c in enumerate(codes))


# ---- page trees


def brute_closure(edges, roots):
    found = {}
    for i, t in roots:
        found[i] = min(found.get(i, (t, 0)), (t, 0))
    level = dict(found)
    while level:
        below = {}
        for p, c, t in edges:
            if p in level and c not in found:
                way = (f"{level[p][0]}/{t}", level[p][1] + 1)
                below[c] = min(below.get(c, way), way)
        found |= below
        level = below
    return found


def test_closure_is_brute_force(spark):
    """Trees with circles, loose ends, repeated edges and roots inside; and graphs whose pages have several parents."""
    rng = random.Random(2)
    for several in (False, True):
        edges = [(f"p{rng.randrange(i)}", f"p{i}", f"t{i}") for i in range(1, 80)] + [("c0", "c1", "x"), ("c1", "c0", "y"), ("lost", "l1", "z"), ("p3", "p3", "self")]
        edges = [e for e in edges if e[1] != "p3"] + [("p2", "p3", "t3"), ("p2", "p3", "s3")]
        if several:
            edges += [(f"p{rng.randrange(80)}", f"p{rng.randrange(80)}", "again") for _ in range(40)]
        roots = [("p0", "R"), ("p0", "Q"), ("p7", "inside")]
        got = sitemap.closure(spark.createDataFrame(edges, "parent_id string, child_id string, title string"), spark.createDataFrame(roots, "id string, title string")).collect()
        assert {r.id: (r.path, r.depth) for r in got} == brute_closure(edges, roots) and len({r.id for r in got}) == len(got)


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(sitemap, "cut", lambda df, f=sitemap.cut: rounds.append(1) or f(df))
    edges = spark.range(1, 10_001).selectExpr("CAST(id - 1 AS STRING) AS parent_id", "CAST(id AS STRING) AS child_id", "'' AS title")
    roots = spark.createDataFrame([("0", "")], "id string, title string")
    got = sitemap.closure(edges, roots, paths=False).selectExpr("count(*) AS n", "max(depth) AS d", "sum(depth) AS s").first()
    assert (got.n, got.d, got.s) == (10_001, 10_000, 50_005_000) and len(rounds) <= 17
    assert sitemap.closure(edges, roots, depth=3, paths=False).count() == 4 and sitemap.closure(edges, roots, depth=0).count() == 1


def test_publish_roots(spark):
    def brute(folder, files):
        root = folder
        for _ in range(10):
            if root == "":
                break
            up = root.rpartition("/")[0]
            if (f"{up}/" if up else "") + "index.adoc" not in files:
                break
            root = up
        return root

    deep = "/".join("abcdefghijklmnop")
    files = ["a/index.adoc", "a/b/x.adoc", "a/b/c/y.adoc", "a/b/c/index.adoc", "z/y/x/w.adoc", "z/index.adoc", "top.adoc", "index.adoc", "q/w.adoc", f"{deep}/f.adoc", "a/INDEX.adoc"]
    files += [deep[: 2 * i + 1] + "/index.adoc" for i in range(16)]
    for some in (files, [f for f in files if f != "index.adoc"]):
        got = {r.folder: r.root for r in sitemap.publish_roots(spark.createDataFrame([(f,) for f in some], "path string")).collect()}
        assert got == {f: brute(f, set(some)) for f in {x.rpartition("/")[0] for x in some}}


# ---- stand-ins


def test_short_words_and_numbers_are_permuted():
    s = StandIns(b"k")
    words = ["".join(x) for n in (1, 2, 3) for x in itertools.product(string.ascii_lowercase, repeat=n)]
    made = {s.word(w) for w in words}
    assert len(made) == len(words) and all(s.word(w) != w for w in words) and all(x.isalpha() and x.islower() for x in made)
    numbers = [str(i) for i in range(1100)] + [f"0{i}" for i in range(100)]
    made = {s.shape("n", x) for x in numbers}
    assert len(made) == len(numbers) and sorted(map(len, made)) == sorted(map(len, numbers)) and {x for x in numbers if len(x) == 2} == {x for x in made if len(x) == 2}


VALUES = st.one_of(st.text(max_size=12), st.text("abAB09-./~é", max_size=6), st.from_regex(r"\A[a-z]{1,3}(\.png|\.drawio\.png|\.PDF)?\Z"))


@settings(max_examples=60, deadline=None)
@given(st.lists(VALUES, unique=True, min_size=2, max_size=60))
def test_different_values_have_different_stand_ins(values):
    a = Anonymizer("k")
    for kind in ("name", "login", "user_key", "space_key", "anchor", "base_name", "file_name", "slug"):
        assert len({getattr(a, kind)(v) for v in values}) == len(values), kind
    runs = {v for v in values if v.isalpha()}
    assert len({a.of.word(v) for v in runs}) == len(runs)


def test_long_words_and_keys():
    a, b, other = Anonymizer("k"), Anonymizer("k"), Anonymizer("l")
    long = ["x" * n for n in range(60, 200)] + ["y" * n for n in range(60, 200)]
    assert len({a.of.word(x) for x in long}) == len(long)
    assert a.name("Ann Lee") == b.name("Ann Lee") != other.name("Ann Lee")
    assert a.issue_key("DEV-12").startswith(a.space_key("DEV") + "-") and a.file_name("x.drawio.png")[:-11] == a.base_name("x")
    # a segment never turns into one of another kind
    assert all(a._segment(s) not in ("wiki", "browse") and not a._segment(s).endswith(".png") for s in ("abcd", "efgh", "qwerty", "a.bcd", "x.jpk"))


def test_json_by_fields():
    import json

    a = Anonymizer("k")
    made = json.loads(a.json(json.dumps({"space": {"name": "Team"}, "list": [{"displayName": "Ann"}, "plain"], "attachment": {"a.png": {"download": "/x/a.png"}}, "self": "http://h/rest/api/5", "n": None, "b": True, "other": "as it is", "html": "<p>Bob</p>"})))
    assert made["space"]["name"] == a.title("Team") and made["list"] == [{"displayName": a.name("Ann")}, "plain"] and made["attachment"] == {a.file_name("a.png"): {"download": a.url("/x/a.png")}}
    assert made["n"] is None and made["b"] is True and made["other"] == "as it is" and "Bob" not in made["html"] and json.loads(a.json('"x"')) == "x"


def test_round_trip_of_odd_texts(spark, tmp_path):
    """White space at the ends, lines like directives or fences, blank and null texts, ids that are shared, negative or null: the rows of the SQL."""
    long = "\n".join(f"line {i}" for i in range(30))
    odd = ["", " \n\t", None, " ", " a ", "\n\na", "a\n", "a\n\n", "\ta\r\n\r\n", "\n" + long + "\n\n", " {" + long, "x\ninclude::x.txt[]\n" + long, "x\n\\include::x.txt[]\ny", "\\\\include::x.txt[]\n" + long,
           "ifdef::a[]\nx\nendif::[]", long + "\nifeval::[1 == 2]\nx", "\\ifndef::a[x]", "---- \nx", "x include::x.txt[]\n", long + "\u0085include::x.txt[]", "]]>" + long + "]]>\n", "w" * 60_000, ":a: b\n{a}"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(4, "other"), (4, "other"), (4, long), (4, long + "."), (-7, "minus"), (None, "none"), (None, long)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in tree_queries.QUERIES["export_publish_round_trip"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(tree_queries.ORACLE_SQL["export_publish_round_trip"]).fetchall()
    assert Counter(got) == Counter(want) and len(want) == len(rows) - 3


def test_round_trip_moves_texts_few_times(spark, tmp_path):
    """Bytes shuffled and kept in the shared folder are a small multiple of the texts, which compression makes hardly smaller."""
    draw = random.Random(5)
    text = lambda n: "\n".join("".join(draw.choices(string.ascii_letters + string.digits, k=80)) for _ in range(n))
    rows = [(i, text(8 if i % 2 else 300)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    context = spark.sparkContext._jsc.sc()
    shared = pathlib.Path(shared_folder(spark))

    def moved() -> int:
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite() + sum(x.stat().st_size for x in shared.rglob("*") if x.is_file())

    before, limit = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where sides are large
    try:
        made = tree_queries.QUERIES["export_publish_round_trip"](spark, str(tmp_path))
        made.write.format("noop").mode("overwrite").save()
        grown = moved() - before
        assert {tuple(r) for r in made.collect()} == set(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert grown < 4.5 * sum(len(t) for _, t in rows)


def test_links_are_looked_for_where_they_may_be(spark):
    """Pages whose markup holds no tag of a link are left out before they are parsed; names in any case, users of profiles and diagrams are found as before."""
    user = '<ac:structured-macro ac:name="profile"><ac:parameter ac:name="user"><RI:USER ri:userkey="k"/></ac:parameter></ac:structured-macro>'
    drawn = '<ac:structured-macro ac:name="drawio"><ac:parameter ac:name="diagramName">plan</ac:parameter></ac:structured-macro>'
    marks = ["<p>x</p>", None, '<AC:Link><ri:page ri:content-title="A"/></AC:Link>', user, drawn, "<![CDATA[<ac:link>]]>"]
    df = spark.createDataFrame(list(enumerate(marks)), "id int, html string")
    for diagrams in (False, True):
        got = {tuple(r) for r in convert.link_rows(df, diagrams=diagrams).collect()}
        assert got == {(i, *x) for i, m in enumerate(marks) for x in convert.link_tuples(m, diagrams)} and len(got) == 2 + diagrams
