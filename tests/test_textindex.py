"""Substring search by the index gives what a scan gives."""

import random

import pytest
from docspark.operators import textindex
from docspark.plans import catalog
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abÄ1_") for _ in range(rng.randint(1, 3)))
    out = ["".join(word() + rng.choice([" ", "  ", ", ", "-", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    return [*out, None, "", " - ", "AB ab", "<p>ab</p>", "ab " * 30_000]


def test_matches_are_those_of_a_scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    index = textindex.indexed(df, "i", "t").cache()
    terms = textindex.vocabulary(index).cache()
    rng = random.Random(5)
    whole = [t for t in texts if t]
    asks = ["a", "ab", " ", "-", "", "ab ab", "B", "ä", "</", "zzz", ", a", "a,"]
    for _ in range(25):
        t = rng.choice(whole)
        at = rng.randrange(len(t))
        asks.append(t[at : at + rng.randint(1, 9)])
    for q in asks:
        got = sorted(r.id for r in textindex.matches(index, terms, q).collect())
        assert got == [i for i, t in enumerate(texts) if t is not None and q.lower() in t.lower()], repr(q)


def test_search_reads_the_index(spark):
    pages = spark.createDataFrame([("1", "Root", "<p>x</p>"), ("2", "Kid", "<p>Some words</p>")], "page_id string, title string, storage string")
    index = textindex.indexed(pages, "page_id", "storage")
    tools = catalog.Catalog(spark, {"pages": pages, "page_index": index, "page_terms": textindex.vocabulary(index)})
    found = tools.call("confluence_search", {"query": "ome word"}).collect()
    assert [(r.page_id, r.tier) for r in found] == [("2", 3)] and tools.call("confluence_search", {"query": "Kid"}).first().tier == 1
    assert textindex.matches(index.limit(0), textindex.vocabulary(index.limit(0)), "a b").count() == 0


def test_a_common_word_is_in_many_partitions(spark, tmp_path, monkeypatch):
    from docspark import tree_queries

    spark.range(400, numPartitions=1).selectExpr("id AS doc_id", "repeat('and the ', 300) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    seen, vocabulary = [], textindex.vocabulary
    monkeypatch.setattr(textindex, "vocabulary", lambda index: seen.append(index) or vocabulary(index))
    assert {r.query: r["count"] for r in tree_queries.indexed_search(spark, str(tmp_path)).groupBy("query").count().collect()} == {"he": 400, "and the ": 400}
    shares = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) >= 4 and max(shares) < sum(shares) / 2


def test_two_words_need_no_counting(spark):
    index = textindex.indexed(spark.createDataFrame([(1, "one two, three"), (2, "two one")], "i int, t string"), "i", "t").cache()
    found = textindex.matches(index, textindex.vocabulary(index), "ne two")
    assert [r.id for r in found.collect()] == [1] and "start" not in found._jdf.queryExecution().toString()
