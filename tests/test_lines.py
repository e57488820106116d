"""Fences, conditions, callouts and footnotes of AsciiDoc."""

import random
import re

import pytest
from docspark.operators import lines, publish, split
from pyspark.sql import functions as F

SOME = ["----", "-----", "....", "```", "```python", "~~~", "++++", "////", "== a", "x", "", "----  ", "---"]


def brute(text):
    out, open_, since = [], "", 0
    for i, line in enumerate(text.split("\n")):
        fence = line.rstrip()
        if not re.match(r"^(-{4,}|\.{4,}|\+{4,}|/{4,}|```.*|~~~.*)$", fence):
            continue
        if not open_:
            open_, since = fence, i
        elif open_ == fence or open_[:3] in ("```", "~~~") and open_[:3] == fence:
            out.append((since, i))
            open_ = ""
    return out + ([(since, text.count("\n"))] if open_ else [])


def test_spans_are_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["\n".join(rng.choice(SOME) for _ in range(n)) for n in [*range(1, 40)] * 4] + ["", "----", "x\n" * 3000 + "----\n" * 601]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    for size in (128, 2):
        monkeypatch.setattr(lines, "BLOCK", size)
        some = df if size == 128 else df.filter(F.length("t") < 400)
        got = {r.i: [tuple(x) for x in r.s] for r in some.select("i", lines.verbatim(F.split("t", "\n")).alias("s")).collect()}
        assert got and all(got[i] == brute(texts[i]) for i in got)


def test_split_with_fences(spark):
    df = spark.createDataFrame([(1, "== A\n----\n== not\n----\n== B\n"), (2, "## x\n```\n## y\n```"), (3, None), (4, "----\n== open")], "id int, text string")
    assert {(r.id, r.file) for r in split.sections(df, fences=True).collect()} == {(1, "index.adoc"), (1, "1_A.adoc"), (1, "2_B.adoc"), (2, "index.adoc"), (4, "index.adoc")}
    got = {(r.id, r.part): r.content for r in split.sections(df, form="md", fences=True).collect()}
    assert got[2, 1] == "## x\n```\n## y\n```" and (2, 2) not in got
    assert {r.file for r in split.sections(df.filter("id = 1")).collect()} == {"index.adoc", "1_A.adoc", "2_not.adoc", "3_B.adoc"}


@pytest.mark.parametrize(
    ("source", "storage"),
    [
        ("ifdef::a[x]\nifndef::a[y]", "<p>y</p>"),
        (":a:\nifdef::a,b[one]\n\nifdef::a+b[no]\n\nifndef::a,b[no]\n\nend", "<p>one</p><p>end</p>"),
        (":a: 2\n\nifeval::[{a} > 10]\nno\nendif::[]\nifeval::[\"{a}\" == \"2\"]\nyes\nendif::[]", "<p>yes</p>"),
        ("ifdef::x[]\n:b: 1\nifdef::y[]\nno\nendif::y[]\nno\nendif::x[]\nifdef::b[no]\n\nend", "<p>end</p>"),
        (":a:\n:!a:\n\nifdef::a[no]\n\nend\nendif::[]", "<p>end</p>"),
        ("ifeval::[nonsense]\nno\nendif::[]\nok", "<p>ok</p>"),
        ("<1> a\nb\n<2> c\n+\n----\nd\n----", '<ol><li>a b</li><li>c<ac:structured-macro ac:name="noformat"><ac:plain-text-body><![CDATA[d]]></ac:plain-text-body></ac:structured-macro></li></ol>'),
        ("a footnote:[x \\] *y*]", "<p>a <sup>[1]</sup></p><hr/><p>[1] x ] <strong>y</strong></p>"),
        ("|===\n|a footnote:[n]\n|===", "<table><tbody><tr><td>a <sup>[1]</sup></td></tr></tbody></table><hr/><p>[1] n</p>"),
    ],
)
def test_published(source, storage):
    assert publish.render(source)[0] == storage


def test_mentions_of_files():
    c = publish.Context(path="r/a/p.adoc", root="r", titles={"r/b.adoc": "B", "r/a/c.adoc": "C & D"})
    out = publish.render("`b.adoc` `c.adoc#x` `d.adoc` `c.adoc and more`", c)[0]
    assert out == '<p><ac:link><ri:page ri:content-title="B"/><ac:link-body>B</ac:link-body></ac:link> <ac:link ac:anchor="x"><ri:page ri:content-title="C &amp; D"/><ac:link-body>C &amp; D</ac:link-body></ac:link> <code>d.adoc</code> <code>c.adoc and more</code></p>'
