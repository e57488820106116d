"""Paged listings with pushed filters, files written in two phases, and table functions in SQL."""

import json

import pytest
from docspark.functions import tables
from docspark.operators import convert
from docspark.sources import rest, sinks
from pyspark.sql import functions as F


def listing(folder, n, size):
    for start in range(0, n, size):
        items = [{"id": i, "title": f"t{i % 7}", "more": i} for i in range(start, min(n, start + size))]
        (folder / f"{start}.json").write_text(json.dumps({"results": items}))


@pytest.mark.parametrize("n", [0, 1, 5, 16, 33, 64])
def test_all_pages_are_read(spark, tmp_path, n):
    listing(tmp_path, n, 2)
    (tmp_path / "1000.json").write_text("behind a gap")
    spark.dataSource.register(rest.PagedJson)
    df = spark.read.format("paged_json").option("pagesize", 2).option("pages", 3).load(str(tmp_path))
    assert sorted(int(r.id) for r in df.collect()) == list(range(n)) and df.rdd.getNumPartitions() == max(1, -(-(-(-n // 2)) // 3))


def test_filters_reach_the_source(spark, tmp_path, capsys):
    listing(tmp_path, 40, 4)
    (tmp_path / "8.json").write_text("broken, and never opened")
    spark.dataSource.register(rest.PagedJson)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        df = spark.read.format("paged_json").option("pagesize", 4).option("pages", 1).option("pushdown", "true").load(str(tmp_path)).filter("start >= 12 and start < 24 and title = 't3' and length(json) > 1")
        assert sorted(r.id for r in df.collect()) == ["17"]
        df.explain("formatted")
        plan = capsys.readouterr().out
        pushed = plan.split("PushedFilters: ")[1].split("\n")[0]
        assert all(x in pushed for x in ("start", "12", "24", "title", "t3")) and "length" not in pushed
        assert df.rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", False)


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    (tmp_path / "kept.txt").write_text("before")
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("d/f"), "id").alias("path"), F.when(F.col("id") == 39, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("content"))
    spark.dataSource.register(rest.FileTree)
    with pytest.raises(Exception, match="no"):
        rows.write.format("file_tree").mode("append").save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["kept.txt"]
    with pytest.raises(Exception, match="leads elsewhere"):
        spark.createDataFrame([("ok", "1"), ("../x", "2")], "path string, content string").write.format("file_tree").mode("append").save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["kept.txt"]
    sinks.write_files(rows.filter("path <> 'd/f39'"), str(tmp_path))
    sinks.write_files(spark.createDataFrame([("kept.txt", "after"), ("d/f1", None)], "path string, content string"), str(tmp_path))
    assert (tmp_path / "kept.txt").read_text() == "after" and len(list((tmp_path / "d").iterdir())) == 39 and (tmp_path / "d/f1").read_text() == "" and not list(tmp_path.glob(".staging*"))


def test_table_functions(spark):
    pages = spark.createDataFrame([(1, "<h1>A</h1><table><tr><td>x</td></tr></table><p>see <ac:link><ri:page ri:content-title='T'/></ac:link></p>"), (2, None), (3, "")], "page_id int, html string")
    tables.register(spark)
    sql = lambda text: sorted(tuple(r) for r in spark.sql(text, pages=pages).collect())
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    some = pages.filter("html is not null")
    assert sql("SELECT page_id, b.* FROM {pages}, LATERAL blocks(html) b") == rows(convert.block_rows(some))
    assert sql("SELECT page_id, l.* FROM {pages}, LATERAL links(html) l") == rows(convert.link_rows(some))
    assert sql("SELECT page_id, c.* FROM {pages}, LATERAL cells(html) c") == rows(convert.cell_rows(some))
    assert spark.sql("SELECT b.* FROM {pages}, LATERAL blocks(html, NULL) b", pages=pages).columns == ["node_id", "parent_id", "ord", "depth", "kind", "level"]
    assert sql("SELECT kind, count(*) FROM {pages}, LATERAL blocks(html, 'adoc') b WHERE page_id = 1 GROUP BY kind")[0][0] == "cell"
    for bad in ("blocks(page_id)", "blocks(html, 'pdf')", "blocks(html, html)", "links(html, page_id = 1)"):
        with pytest.raises(Exception, match="must be|unknown form"):
            spark.sql(f"SELECT * FROM {{pages}}, LATERAL {bad}", pages=pages)
