"""Merkle manifests, WARC archives and closed itemsets: against DuckDB SQL on the given tables and against brute force on small ones."""

import gzip
import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from docspark.llm import itemsets, merkle, queries, warc
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def same_as_sql(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != SMALL else ''}')")
    df = queries.QUERIES[name](spark, folder)
    result = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in names) for r in df.collect())
    assert got == sorted(tuple(map(repr, r)) for r in result.fetchall())
    return got


@pytest.mark.parametrize(("name", "table"), [("op11_merkle", "documents"), ("op12_warc", "pages"), ("op13_itemsets", "sale_lines")])
def test_query_is_its_sql(spark, name, table):
    assert same_as_sql(spark, name, SMALL, [table])


# ---- Merkle manifests


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def tree(leaves):
    """Levels from the leaves up, and the nodes beside each leaf's way."""
    rows = [list(leaves)]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][i : i + 8]) for i in range(0, len(rows[-1]), 8)])
    ways = []
    for i in range(len(leaves)):
        way, at = "", i
        for row in rows[:-1]:
            run = at // 8 * 8
            way += "".join(x for j, x in enumerate(row[run : run + 8], run) if j != at)
            at //= 8
        ways.append(way)
    return rows[-1][0], ways


def documents(n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i * 10**6, -i, i << 40]), rng.choice(["Some Text", "", None, "ÄÖ é " * 3]), rng.choice(["en", "de", None, "", "é"]), "s", rng.choice([1, None])) for i in range(n)]
    rows = list({r[0]: r for r in rows}.values())
    rows += [(None, "x", "en", "s", 1), (None, None, None, None, None), rows[0], rows[0], (rows[0][0], "other", rows[0][2], "s", 1), (10**15, "Long " * 100_000, "en", "s", 3)]
    rng.shuffle(rows)
    return rows


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    made, groups = [], {}
    for d, text, lang, source, n in rows:
        leaf = lambda t: h(*map(field, (d, source, lang, n, t)))  # noqa: B023, E731
        lower = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        now = lower if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else text
        groups.setdefault(lang, []).append((d is not None, d or 0, leaf(text), leaf(now), d))
    order = sorted(groups, key=lambda x: b"" if x is None else b"+" + x.encode())
    found = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, above = tree([found[g][0] for g in order])
    for g, more in zip(order, above, strict=True):
        for (_, _, leaf, now, d), way in zip(sorted(groups[g], key=lambda x: x[:3]), found[g][1], strict=True):
            made.append((d, leaf, found[g][0], root, h(way + more), leaf == now))
    return made


@pytest.mark.parametrize(("n", "cell_rows"), [(1, 1 << 16), (90, 1 << 16), (700, 1 << 16), (700, 1)])
def test_manifest_is_brute_force(spark, tmp_path, monkeypatch, n, cell_rows):
    """Also with every cell of the histogram parted by leaves."""
    monkeypatch.setattr(merkle, "CELL_ROWS", cell_rows)
    rows = documents(n)
    schema = "doc_id long, text string, lang string, source string, n_chars long, _g string, leaf string"
    spark.createDataFrame([(*r, "x", "y") for r in rows], schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    # a row whose tampering changes nothing verifies; others do not
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got), key=key) == sorted(brute_manifest(rows), key=key)
    assert all((r.folded_root == r.root) == r.verified for r in got)


def test_manifest_of_nothing_and_one(spark):
    df = spark.createDataFrame([(7, "a", "en")], "doc_id long, root string, lang string")
    assert merkle.manifest(df.limit(0), merkle.leaf(F.col("doc_id"))).count() == 0
    (r,) = merkle.manifest(df, merkle.leaf(F.col("doc_id"))).collect()
    assert (r.leaf, r.subroot, r.root, r.path) == (h("1:7"), h("1:7"), h("1:7"), [])


def test_many_groups(spark):
    rows = [(i, f"g{i:04}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, lang string").repartition(4)
    got = {r.doc_id: r for r in merkle.manifest(df, merkle.leaf(F.col("doc_id"))).select("doc_id", "root", merkle.proof(F.col("path")).alias("p")).collect()}
    root, ways = tree([h(f"{len(str(i))}:{i}") for i in range(600)])
    assert {r.root for r in got.values()} == {root} and all(got[i].p == h(w) for i, w in enumerate(ways))


# ---- WARC


def pages_of():
    rng = random.Random(4)
    big = ["B" * 1000, "é" * 600, "C" * 999, "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 40 + "\r"]
    rows = [(i, f"http://h{i % 3}.example/p/{i}?q=a b", rng.choice([*big, None, "", "x\n" * 700, f"own {i} " * 300])) for i in range(90)]
    rows += [(200, None, "B" * 1000), (201, "no url\r\nat all", "\r\n\r\n"), (202, "http://x.example", "L" * 3_000_000), (None, "http://y.example/#f", "B" * 1000), (203, "", "\r")]
    return rows


def brute_pages(rows):
    kept = {}
    for d, _, html in rows:
        p = (html or "").encode()
        kept[p] = max(kept.get(p, -(10**9)), -(10**9) + 1 if d is None else d)
    out = []
    for d, _, html in rows:
        p = (html or "").encode()
        again = len(p) >= 1000 and kept[p] != d
        out.append((d, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", kept[p] if again else None))
    return out


@pytest.mark.parametrize("ids", [True, False])
def test_archives_round_trip(spark, tmp_path, ids):
    rows = [r for r in pages_of() if ids or r[0] is not None]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op12_warc(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_pages(rows), key=key)


def test_captures_are_whole(spark, tmp_path):
    rows = [r for r in pages_of() if r[0] is not None]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"{tmp_path}/w")
    found = warc.records(spark, f"{tmp_path}/w")
    assert found.count() == 3 * len(rows) and found.filter("not complete").count() == 0
    stored = {r.capture.record_id: r for r in warc.captures(found).collect()}
    assert len(stored) == len(rows) and all(len(r.requests) == len(r.metadata) == 1 for r in stored.values())
    html = {d: t or "" for d, _, t in rows}
    for r in stored.values():
        d = r.metadata[0].page_id
        if r.capture.type == "response":
            assert bytes(r.capture.payload).decode() == html[d] and r.capture.payload_digest == r.capture.declared
        else:
            assert bytes(stored[r.capture.refers_to].capture.payload).decode() == html[d]
    target = {r.metadata[0].page_id: (r.capture.uri, bytes(r.requests[0].payload)) for r in stored.values()}
    assert target[4] == ("http://h1.example/p/4?q=a%20b", b"") and target[201][0] == "no%20url%0D%0Aat%20all" and target[200][0] is None


def test_equal_ids_and_equal_payloads(spark, tmp_path):
    rows = [(1, "u", "D" * 2000)] * 3 + [(0, "u", "D" * 2000), (None, None, "D" * 2000), (None, None, "E" * 2000), (None, None, "E" * 2000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op12_warc(spark, str(tmp_path)).collect()
    known = lambda x: -1 if x is None else x
    told = sorted((known(r.page_id), r.record_type, known(r.refers_to)) for r in got)
    assert told == [(-1, "response", -1), (-1, "revisit", -1), (-1, "revisit", 1), (0, "revisit", 1), (1, "response", -1), (1, "revisit", 1), (1, "revisit", 1)]


def test_archives_of_others(spark, tmp_path):
    """A member for each record, folded and strange headers, links from the capture, an orphan, an archive that breaks off."""
    a = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\nWARC-Concurrent-To: <urn:q>\r\nwarc-concurrent-to:\r\n <urn:m>\r\nContent-Type: application/http\r\nContent-Length: 30\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\npayld\r\n\r\n\r\n"
    q = b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:q>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    m = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:m>\r\nContent-Type: application/warc-fields\r\nContent-Length: 12\r\n\r\npage-id: 5\r\n\r\n\r\n"
    lost = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:o>\r\nWARC-Concurrent-To: <urn:none>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    broken = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:z>\r\nContent-Length: 300\r\n\r\nonly this"
    (tmp_path / "w").mkdir()
    (tmp_path / "w/one.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(q))
    (tmp_path / "w/two.warc.gz").write_bytes(gzip.compress(m) + gzip.compress(lost) + gzip.compress(broken))
    got = {r.record_id: r for r in warc.captures(warc.records(spark, f"{tmp_path}/w")).collect()}
    assert set(got) == {"<urn:a>", "<urn:z>", "<urn:none>"} and got["<urn:none>"].capture is None
    assert bytes(got["<urn:a>"].capture.payload) == b"payld" and [x.page_id for x in got["<urn:a>"].metadata] == [5] and len(got["<urn:a>"].requests) == 1
    assert not got["<urn:z>"].capture.complete and got["<urn:z>"].requests is None


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op12_warc(spark, str(tmp_path)).count() == 0


# ---- itemsets


def brute_itemsets(baskets, least):
    items = sorted({i for b in baskets for i in b})
    support, level = {}, [()]
    while level:
        found = []
        for z in level:
            for i in items:
                if not z or i > z[-1]:
                    n = sum(set(z) | {i} <= b for b in baskets)
                    if n >= least:
                        support[(*z, i)] = n
                        found.append((*z, i))
        level = found
    out = {}
    for z, s in support.items():
        if any(support.get(tuple(sorted({*z, i}))) == s for i in items if i not in z):
            continue
        rules = [(c, support[x], support[(c,)]) for c in z if (x := tuple(i for i in z if i != c))]
        out[z] = (s, [r for r in rules if 100 * s >= 10 * r[1] and s * len(baskets) > r[1] * r[2]])
    return out


def check_itemsets(spark, tmp_path, lines, monkeypatch=None):
    baskets = {}
    for b, i in lines:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    df = spark.createDataFrame([(b, i, "x", 1) for b, i in lines], "sale_id long, item_id long, flag string, w int").repartition(3)
    folder = tmp_path / "t"
    df.write.parquet(f"{folder}/sale_lines.parquet")
    got = queries.op13_itemsets(spark, str(folder)).collect()
    want = brute_itemsets(list(baskets.values()), max(8, -(-len(baskets) // 5000)))
    assert {tuple(map(int, r["items"].split(","))): r.support for r in got} == {z: s for z, (s, _) in want.items()} and len(got) == len(want)
    for r in got:
        _, rules = want[tuple(map(int, r["items"].split(",")))]
        told = ";".join(f"{c}:{a}:{s}" for c, a, s in sorted(rules))
        best = min(((a, c) for c, a, _ in rules), default=(0, None))[1]
        assert (r.n_items, r.n_rules, r.best_item, r.rules_sha256) == (len(r["items"].split(",")), len(rules), best, hashlib.sha256(told.encode()).hexdigest())
    return want


def sales(seed, n=160, items=14, everywhere=False):
    rng, lines = random.Random(seed), []
    for b in range(n):
        basket = {rng.randrange(items) for _ in range(rng.randint(1, 5))}
        if 0 in basket:
            basket |= {1, 2}
        if rng.random() < 0.25:
            basket |= {5, 6, 7, 8}
        if everywhere:
            basket.add(99)
        lines += [(b, i) for i in basket for _ in range(rng.choice((1, 1, 2)))]
    return lines


@pytest.mark.parametrize(("seed", "everywhere"), [(1, False), (2, True), (3, False)])
def test_itemsets_are_brute_force(spark, tmp_path, seed, everywhere):
    lines = [*sales(seed, everywhere=everywhere), (None, 1), (3, None), (None, None), (-5, 1000), (-5, 99)] if not everywhere else sales(seed, everywhere=True)
    check_itemsets(spark, tmp_path, lines)


def test_large_baskets_are_set_aside(spark, tmp_path, monkeypatch):
    """Baskets that hold nearly everything give no candidates, but count."""
    monkeypatch.setattr(itemsets, "SMALL", 4)
    lines = sales(5, 120, 20)
    lines += [(1000 + b, i) for b in range(3) for i in range(20) if (i + b) % 7]
    want = check_itemsets(spark, tmp_path, lines)
    found = itemsets.frequent(spark.createDataFrame(lines, "sale_id long, item_id long"), "sale_id", "item_id")[0]
    assert itemsets.Baskets(found, 8).weight > 0 and any(len(z) > 2 for z in want)


def test_items_that_repeat_in_few_baskets(spark, tmp_path):
    lines = [(b, i) for b, i in itertools.product(range(12), (1, 2))] + [(0, 50)] * 40 + [(b, 60) for b in range(7)]
    assert set(check_itemsets(spark, tmp_path, lines)) == {(1, 2)}


def test_no_itemsets(spark, tmp_path):
    assert check_itemsets(spark, tmp_path, [(1, 2), (2, 2)]) == {}
    df = spark.createDataFrame([], "sale_id long, item_id long")
    closed, made, support, total = itemsets.closed_sets(df)
    assert itemsets.with_rules(closed, made, support, total).count() == 0 and total == 0
