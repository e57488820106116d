"""Stages in Python run on all cores, however few partitions their rows come in, and give what they gave before."""

import re

import pyarrow as pa
import pytest
from docspark import queries
from docspark.operators import anonymize, convert, publish, writers
from docspark.operators.standins import StandIns
from docspark.shared import dealt
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAGES = {
    "anonymize_json": lambda df: anonymize.anonymize_json(df, "text"),
    "anonymize_adoc": lambda df: anonymize.anonymize_adoc(df.selectExpr("id", "concat(text, repeat(' long', 300)) AS text")),
    "to_storage": lambda df: publish.to_storage(df.selectExpr("concat(id, '.adoc') AS path", "text AS content")),
    "to_texts": lambda df: convert.to_texts(df, "text"),
    "stand_ins": lambda df: anonymize.stand_ins(df.selectExpr("'login' AS kind", "text AS value")),
}


@pytest.mark.parametrize("name", STAGES)
def test_all_cores_take_part(spark, name):
    rows = spark.range(2000, numPartitions=1).selectExpr("id", "concat('u', id) AS text")
    made = STAGES[name](rows).select(F.spark_partition_id().alias("at")).groupBy("at").count().collect()
    assert sum(r["count"] for r in made) >= 2000
    assert len(made) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in made) < 1000


def test_dealt_keeps_rows(spark):
    rows = spark.range(300, numPartitions=1).selectExpr("id % 3 AS k", "CAST(NULL AS STRING) AS t")
    made = dealt(rows)
    assert made.columns == ["k", "t"] and {r.k: r["count"] for r in made.groupBy("k").count().collect()} == {0: 100, 1: 100, 2: 100}
    assert dealt(rows.limit(0)).count() == 0


def test_equal_records_are_made_once_a_task(spark):
    """A record that comes often is in one task, which remembers it; nulls, blanks and long texts go anywhere."""
    texts = ['{"title": "Some plan"}', None, " ", '{"title": "' + "x " * 3000 + '"}']
    rows = spark.range(400, numPartitions=1).select("id", F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 4 + 1).cast("int")).alias("json"))
    made = anonymize.anonymize_json(rows).select("id", "json", F.spark_partition_id().alias("at")).collect()
    one = anonymize.Anonymizer()
    assert len(made) == 400 and all(r.json == (texts[r.id % 4] if r.id % 4 in (1, 2) else one.json(texts[r.id % 4])) for r in made)
    places = {i: len({r.at for r in made if r.id % 4 == i}) for i in range(4)}
    assert places[0] == 1 and places[1] > 4 and places[3] > 4


def test_stand_ins_of_before():
    """Values under a key that other tables were made with."""
    s = StandIns(b"42")
    made = [s.shape("login", "ann.12"), s.shape("login", "0" * 300)[:12], s.words("Ann Lee 7"), s.hexadecimal("user", "ff01"), s.shape("file", "é")]
    assert made == ["kju.87", "065399988996", "Borjel Danpi 7", "677c", "ø3f6f"]


@pytest.mark.parametrize("name", ["lateral_cells", "lateral_blocks", "export_splits_long_pages"])
def test_queries_take_all_cores(spark, name):
    made = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("at")).groupBy("at").count().collect()
    assert len(made) >= spark.sparkContext.defaultParallelism


@pytest.fixture
def made(monkeypatch) -> list:
    """The writers that are made from now on, on the driver."""
    out, init = [], writers.Writer.__init__
    monkeypatch.setattr(writers.Writer, "__init__", lambda self: out.append(self) or init(self))
    return out


@pytest.fixture
def stages(monkeypatch) -> list:
    """What each stage of ``convert`` that is planned from now on does with a page."""
    out, mapped = [], convert._mapped
    monkeypatch.setattr(convert, "_mapped", lambda df, html, fields, make, *given: out.append(make) or mapped(df, html, fields, make, *given))
    return out


def test_a_stage_makes_its_writers_once(spark, made, stages):
    """Not for each page, as making them costs more than printing a short page; and a page leaves nothing to the next."""
    pages = ["<p>x <code>a_b</code></p>", "<ol><li>" * 9 + "y", None, "<table><tr><td>", "<p>x <code>a_b</code></p>"]
    df = spark.createDataFrame([], "html string")
    convert.to_text(df), convert.to_texts(df)
    assert len(made) == 3
    one, both = ([make(p) for p in pages] for make in stages)
    assert one[0] == one[4] == [(None, "x `a_b`")] and one[2] == [(None, "")]
    assert both[0] == both[4] == [("x `a_b`", "x `a_b`")] and both[2] == [("", "")]
    assert len(made) == 3


@pytest.mark.parametrize("name", ["block_headings", "block_steps", "block_ac_link_unresolved", "block_colours_off", "block_task_list", "block_code"])
def test_constructs_take_all_cores_and_make_no_writer_a_row(spark, made, stages, name):
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select("*", F.spark_partition_id().alias("at")).collect()
    assert len({r.at for r in rows}) >= spark.sparkContext.defaultParallelism
    assert stages[0]("<p>x</p>") == stages[0]("<p>x</p>") == [("x", "x")] and len(made) == 2


@pytest.fixture
def here(spark, monkeypatch):
    """A stage of ``convert`` run in this process over pages as one batch: the rows, and the pages that it made."""

    def run_here(pages: list, given: tuple[str, ...] = ()) -> tuple[list, list]:
        class Rows:
            def mapInArrow(self, run, kinds):  # noqa: N802
                names = ["id", "html", *given]
                batch = pa.RecordBatch.from_pylist([dict(zip(names, (i, *([p] * (1 + len(given)))), strict=True)) for i, p in enumerate(pages)], schema=pa.schema([("id", pa.int64()), *((n, pa.string()) for n in names[1:])]))
                return [row for part in run(iter([batch])) for row in part.to_pylist()]

        called: list = []
        monkeypatch.setattr(convert, "dealt", lambda df: Rows())
        df = spark.createDataFrame([], ", ".join(["id long", "html string", *(f"{g} string" for g in given)]))
        return convert._mapped(df, "html", T.StructType.fromDDL("text string"), lambda p, *_: called.append(p) or [(p,)] * (2 if p == "b" else p != "none"), given), called

    return run_here


def test_equal_pages_of_a_slice_are_made_once(here):
    """Each row still has all rows of its page, in order; no more than a slice is remembered, and nothing where rows bring values along."""
    pages = ["a", "b", None, "none"] * 100
    rows, called = here(pages)
    assert [(r["id"], r["text"]) for r in rows] == [(i, p) for i, p in enumerate(pages) for _ in range(2 if p == "b" else p != "none")]
    assert called == ["a", "b", None, "none"] * 2
    rows, called = here(pages, ("links",))
    assert called == pages and len(rows) == 400
    assert here([str(i) for i in range(300)])[1] == [str(i) for i in range(300)]


@pytest.mark.parametrize("name", ["block_steps", "block_ac_link_unresolved", "block_colours_off", "block_task_list", "block_code"])
def test_constructs_move_narrow_rows(spark, name):
    """Markup is put together after the rows are dealt, once, so that one core of a compact file does not build and write it all."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    moved = re.findall(r"Repartition\w*[^\n]*\n(.*)", plan, re.DOTALL)
    assert plan.count("Repartition") == 1 and "replace(" in plan and "replace(" not in moved[0]
