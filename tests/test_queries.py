"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the others run and give rows."""

import duckdb
import pytest
from docspark import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order] and [tuple(repr(r[i]) for i in order) for r in values])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    result = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_filters_reach_the_scan(spark, capsys):
    queries.predicate_pushdown(spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(n_chars,1000)" in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_keywords_of_all_texts(spark, tmp_path):
    texts = {1: "a, b,, c ", 2: "long, " * 5000 + "end", 3: "no count, x", 4: None, 5: ""}
    rows = [(i, t, None if i == 3 else len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.words for r in queries.parse_keywords(spark, str(tmp_path)).collect()}
    assert got == {i: "|".join(x.strip(" ") for x in (t or "").split(",") if x.strip(" ")) for i, t in texts.items()}
