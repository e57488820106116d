"""N-gram join, components, vector searches, chat repair and the pipeline against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from docspark.llm import ann, chat, components, maxscore, ngram_join, queries
from docspark.llm.textvec import utf8
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
ODD = [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, "w " * 30_000), (905, " \t\n")]


def sets_of(texts, width):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    return out


def brute(rows, width, percent):
    """(n_shingles, component_id) of each row, by comparing all pairs."""
    sets = sets_of([t for _, t in rows], width)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
            parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return [(k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed, n=220, passage=True):
    """Near copies of a few texts at all similarities about the threshold, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    shared, bases, rows = [word() for _ in range(30)], [[word() for _ in range(rng.randint(5, 90))] for _ in range(6)], []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 90))]
        for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w + shared if passage and rng.random() < 0.4 else w)))
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_similar_is_brute_force(spark, seed, width, percent):
    rows = corpus(seed) + ODD + [(0, corpus(seed)[0][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    got = sorted(tuple(r)[:3] for r in ngram_join.similar(df, width, percent).collect())
    assert got == sorted(brute(rows, width, percent))


def test_long_lists_in_blocks_of_pairs(spark, monkeypatch):
    """The same with blocks so small that lists are dealt into many."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = corpus(7, 160, passage=False)
    got = sorted(tuple(r)[:3] for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70).collect())
    assert got == sorted(brute(rows, 3, 70))


def test_similar_of_nothing(spark):
    for rows in ([], [(1, None)], [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")]):
        got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and all(r.component_id == 3 for r in got if r.n_shingles)


def test_tree_rules_out_no_link():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 62, rng.integers(5, 300), dtype=np.uint64)) for _ in range(8)]
    items = []
    for _ in range(150):
        b = base[rng.integers(8)]
        keep = b[rng.random(len(b)) > rng.choice((0.0, 0.05, 0.1, 0.3))]
        items.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, rng.integers(0, 6), dtype=np.uint64)])))
    at = np.concatenate([[0], np.cumsum([len(x) for x in items])])
    tree = ngram_join.SignatureTree(ngram_join.signatures(np.concatenate(items), at), np.diff(at))
    found = set()
    for x, y in tree.pairs(80):
        found |= {tuple(sorted((int(tree.order[a]), int(tree.order[b])))) for a, b in zip(x, y, strict=True)}
    for i, j in itertools.combinations(range(len(items)), 2):
        both = len(np.intersect1d(items[i], items[j]))
        if 100 * both >= 80 * (len(items[i]) + len(items[j]) - both) and both:
            assert (i, j) in found
    assert len(found) < 150 * 149 / 2


def test_groups_hold_the_pairs():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64)) for _ in range(12)]
    items = [np.unique(np.concatenate([b[rng.random(60) > 0.05], rng.integers(0, 1 << 62, 2, dtype=np.uint64)])) for b in base for _ in range(4)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in items])])
    group = ngram_join.partners(np.arange(48), ngram_join.signatures(np.concatenate(items), at), np.diff(at), 50)
    assert all(len(set(group[k : k + 4])) == 1 and group[k] >= 0 for k in range(0, 48, 4))
    same = ngram_join.partners(np.arange(48) // 4, ngram_join.signatures(np.concatenate(items), at), np.diff(at), 50)
    assert (same == -1).all()


def test_prefixes_of_linked_sets_meet():
    texts = [t for _, t in corpus(9, 60)]
    values, at = ngram_join.sets(*utf8(pa.array(texts)), 2)
    level = np.random.default_rng(2).integers(0, 3, 1 << ngram_join.SKETCH_BITS).astype(np.uint8)
    tokens, owner = ngram_join.prefixes(values, at, level, 75)
    own = [set(tokens[owner == i].tolist()) for i in range(len(texts))]
    full = [set(values[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if full[i] and 100 * len(full[i] & full[j]) >= 75 * len(full[i] | full[j]):
            assert own[i] & own[j]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- vectors ----

BAD = [(9000, None), (9050, []), (9100, [1.0, None, 2.0] + [0.0] * 5), (9150, [float("nan")] * 8), (9200, [float("inf")] * 8), (None, [1.0] * 8), (9250, [1.0, 2.0])]


def vectors(spark, n=700, dim=8, copies=60):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[::11] = x[0]
    x[1:copies:3] = x[1]
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(n)]
    return rows, spark.createDataFrame([(i, v, "x", "y") for i, v in rows + rows[:5] + BAD], "vec_id long, embedding array<float>, ids string, score string")


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 200)
    rows, df = vectors(spark)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    hits = 0
    asked = [i for i, _ in rows if i % 50 == 0]
    assert set(got) == set(asked)
    for q in asked:
        score = x @ x[q]
        want = [j for j in np.lexsort((np.arange(len(x)), -np.round(score, 12))) if j != q][:5]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(score[v] - s) < 1e-12 for _, v, s in found)
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
        hits += len(set(want) & {v for _, v, _ in found})
    assert hits / (5 * len(asked)) >= 0.9


def test_nearest_of_zero_and_few(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (50, [1.0, 0.0]), (51, [1.0, 0.0]), (52, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(50, 1, 51, 1.0), (50, 2, 52, 1.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32))
    from docspark.llm.vectors import Shard

    shard = Shard({"vecs": x.tobytes(), "dim": 32, "ids": np.arange(1500).tobytes(), "ends": np.arange(1501, dtype=np.int32).tobytes(), "extra": ann.build(x)})
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    hits = sum(len(set(np.argsort(-(u @ u[i]))[:6]) & set(ids)) for i, (_, ids) in enumerate(ann.finder(5)(shard, x[:100])))
    assert hits / 600 >= 0.95


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 150)
    rows, df = vectors(spark)
    got = {}
    for r in maxscore.top_k(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)).astype(np.int64)
    for q in range(0, len(rows), 20):
        score = x @ x[q]
        want = [int(j) for j in np.lexsort((np.arange(len(x)), -score)) if j != q][:20]
        assert sorted(got[q]) == [(k + 1, j, int(score[j])) for k, j in enumerate(want)]
    assert set(got) == set(range(0, len(rows), 20)) and maxscore.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_op8_small(spark):
    x = {r.vec_id: np.floor(64 * np.array(r.embedding, dtype=np.float64)).astype(np.int64) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    got = {}
    for r in queries.op8_maxscore(spark, SMALL).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (k for k in x if k % 20 == 0):
        best = sorted((-int(v @ x[q]), k) for k, v in x.items() if k != q)[:20]
        assert sorted(got[q]) == [(i + 1, k, -s) for i, (s, k) in enumerate(best)]


# ---- chat ----


def cheapest(roles):
    """The least cost over all new roles, merges and single insertions, by trying all."""
    best = float("inf")
    for new in itertools.product((1, 2, 3), repeat=len(roles)):
        cost, state = 0.0, chat.NONE
        for old, n in zip(roles, new, strict=True):
            step = chat.STEPS.get((state, n))
            if step is None:
                cost = float("inf")
                break
            cost += step[0] + chat.relabel_cost(old, n)
            state = n
        best = min(best, cost + chat.end_cost(state))
    return best


def test_repair_is_cheapest_and_legal(spark):
    rng = random.Random(8)
    names = ["user", "assistant", "system", "tool", None, "User "]
    convs = {i: [rng.choice(names) for _ in range(rng.randint(1, 6))] for i in range(120)}
    rows = [(i, t, r, f"t{t}") for i, rs in convs.items() for t, r in enumerate(rs)]
    rng.shuffle(rows)
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for i, roles in convs.items():
        own = sorted((r for r in got if r.conv_id == i), key=lambda r: (r.block, r.at))
        assert {r.conv_cost for r in own} == {cheapest([chat.role_number(r) for r in roles])}
        assert [r.turn for r in own if r.turn is not None] == list(range(len(roles)))
        turns = [chat.ROLES.index(r.new_role) + 1 for r in own if "merge" not in r.action and r.action != "end"]
        assert all(p in chat.LEGAL for p in itertools.pairwise([chat.NONE, *turns])) and turns[-1] == chat.ASSISTANT
        assert own[-1].action == "end"


def test_blocks_give_what_the_whole_gives(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "x"]), f"t{t}") for t in range(700)] + [(None, None, None, None), (None, 1, "user", "q"), (2, 5, "user", "a <| b"), (2, 5, "user", "a <| b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string")
    many = chat.repair(df).collect()
    monkeypatch.setattr(chat, "BLOCK", 1 << 40)
    whole = chat.repair(df).collect()
    assert {(r.conv_id, r.conv_cost) for r in many} == {(r.conv_id, r.conv_cost) for r in whole}
    text = {r.conv_id: r.rendered for r in chat.conversations(chat.repair(df)).collect()}
    assert text[2] == "<|user|>\na <\\| b\na <\\| b<|end|>\n<|assistant|>\n<|end|>\n"
    assert chat.repair(df.limit(0)).count() == 0


def test_many_turns_with_one_number(spark, monkeypatch):
    """A hot number, or none at all, is cut into parts, which give what the whole gives."""
    rng = random.Random(10)
    rows = [(1, 3, rng.choice(["user", "assistant", None]), f"t{rng.randrange(50)}") for _ in range(400)] + [(None, None, rng.choice(["user", "x"]), "n") for _ in range(300)]
    rows += [(1, t, "user", f"u{t}") for t in range(40)] + [(1, 500, "assistant", "long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    whole = chat.repair(df).collect()
    monkeypatch.setattr(chat, "BLOCK", 16)
    many = chat.repair(df).collect()
    parts = chat.parted(df.withColumns({"block": F.coalesce(F.floor(F.col("turn") / 16), F.lit(-1)), "o": F.xxhash64("text")})).groupBy("conv_id", "block", "part").count().collect()
    assert max(r["count"] for r in parts) <= 64 and sum(r["count"] for r in parts) == len(rows)
    in_order = lambda found: [(r.conv_id is None, r.turn, r.role, r.text) for r in sorted(found, key=lambda r: (r.conv_id or 0, r.block, r.at)) if r.action not in ("insert", "end")]
    assert in_order(many) == in_order(whole) and {(r.conv_id, r.conv_cost) for r in many} == {(r.conv_id, r.conv_cost) for r in whole}
    assert len({(r.conv_id, r.block, r.at) for r in many}) == len(many)


def test_op3_as_registered(spark):
    """The registered query against the cheapest repair of each conversation, found by trying all for short ones and by one pass over whole ones."""
    given = {}
    for r in sorted(spark.read.parquet(f"{SMALL}/conversations.parquet").collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.turn is not None, r.turn or 0, r.role or "")):
        given.setdefault(r.conv_id, []).append(r)
    got = {}
    for r in queries.op3_chat_repair(spark, SMALL).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == set(given)
    for conv, turns in given.items():
        roles = [chat.role_number(r.role) for r in turns]
        costs = {chat.NONE: 0.0}
        for old in roles:
            costs = {b: min(c + s[0] for a, c in costs.items() if (s := chat.between(a, b))) + chat.relabel_cost(old, b) for b in (1, 2, 3) if any(chat.between(a, b) for a in costs)}
        best = min(c + chat.end_cost(s) for s, c in costs.items())
        assert {r.conv_cost for r in got[conv]} == {best} and (len(roles) > 6 or cheapest(roles) == best)
        assert sum(r.action not in ("insert", "end") for r in got[conv]) == len(turns)


def test_op1_as_registered(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op1_ngram_join(spark, SMALL).collect())) == sorted(brute(docs, 4, 85))


def test_huge_and_tiny_vectors(spark):
    rows = [(0, [1e200, 1e200, 0.0]), (1, [1e200, 0.0, 0.0]), (2, [3e-200, 3e-200, 1e-200]), (3, [1.0, 1.0, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [0.0, 0.0, 0.0]), (6, None), (7, [1.0, None, 2.0]), (8, [1.0, 1.0]), (None, [1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 9)) for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(3, 1.0), (2, round(6 / 38**0.5, 9)), (1, round(0.5**0.5, 9))]
    small = [(r.query_id, r.vec_id, r.score) for r in maxscore.top_k(df.filter("vec_id > 1"), F.col("vec_id") == 3).orderBy("rank").collect()]
    assert small == [(3, 2, 0), (3, 5, 0)]
    # components beyond a long are the nearest long
    assert [(r.vec_id, r.score) for r in maxscore.top_k(df, F.col("vec_id") == 3).orderBy("rank").collect()] == [(0, 2**63 - 1), (1, 2**63 - 1), (2, 0), (5, 0)]


@pytest.mark.parametrize("size", [1e3, 2e7, 2.0**31, 1e15])
def test_scores_of_large_components_are_exact(spark, monkeypatch, size):
    """Against whole numbers of any length, with vectors of all sizes in one shard; scores beyond a long are the nearest long."""
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 120)
    rng = random.Random(int(size))
    some = lambda: [rng.uniform(-1, 1) * (size if rng.random() < 0.7 else 1) for _ in range(6)]
    rows = [(i, some() if rng.random() < 0.5 else [rng.uniform(-1, 1) for _ in range(6)]) for i in range(260)]
    rows += [(260, [1.0, 2.0]), (280, [2e7, 1.0]), (282, [3.0, 1.0]), (300, []), (301, []), (302, [])]
    terms = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    got = {}
    for r in maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    clip = lambda x: max(1 - 2**63, min(2**63 - 1, x))
    for q in range(0, 301, 20):
        others = [(clip(sum(a * b for a, b in zip(terms[q], v, strict=True))), -i) for i, v in terms.items() if i != q and len(v) == len(terms[q])]
        assert sorted(got.get(q, [])) == [(k, -i, s) for k, (s, i) in enumerate(sorted(others, reverse=True)[:7], 1)]
    assert {(q, v) for q in (300,) for _, v, _ in got[q]} == {(300, 301), (300, 302)}
    assert sorted(got[260])[0][1] == 280


def test_searches_leave_the_session_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    assert maxscore.top_k(df, F.col("vec_id") == 0).count() and ann.nearest(df, F.col("vec_id") == 0).count() and spark.conf.get(name) == before


def test_levels_follow_counts_above_the_noise():
    rng = np.random.default_rng(2)
    for mean in (0.3, 5, 1200):
        counts = rng.poisson(mean, 1 << 14)
        counts[:40] += np.int64(np.geomspace(10, 10**6, 40))
        level, excess = ngram_join.graded(counts)
        order = np.argsort(counts, kind="stable")
        assert (np.diff(level[order].astype(int)) >= 0).all() and (np.diff(excess) >= 0).all() and (excess >= 1).all()
        far = np.flatnonzero(counts > 50 * mean + 1000)
        assert (np.abs(np.log2(excess[level[far]] / counts[far])) < 1).all()


def test_a_group_of_near_copies_in_many_blocks(spark, monkeypatch):
    """One component, whatever the size of a block; nothing is lost beside it."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(20)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{rng.randint(0, 10**6)}" for _ in range(60))) for i in range(100)]
    got = {r.doc_id: r.component_id for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), width=5, percent=80).collect()}
    assert got == {i: c for i, _, c in brute(rows, 5, 80)} and {got[i] for i in range(400)} == {0}


def test_one_row_of_each_component(spark):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, long, "a"), (2, long + " end", "b"), (2, other, "c"), (3, "own words here", "d"), (3, "own words here", "e"), (4, other + " x", "f"), (4, other + " y", "g"), (None, long, "h"), (None, "alone", "i"), (None, None, "j"), (5, "", "k"), (5, "", "l")]
    docs = spark.createDataFrame([(i, t, m, 0, 0, 0) for i, t, m in rows], "doc_id long, text string, mark string, n int, root int, stays int")
    found = ngram_join.similar(docs, 5, 80)
    got = sorted(r.mark for r in ngram_join.one_of_each(docs, found).collect())
    assert [m for m in got if m not in "de"] == list("acijkl") and sum(m in "de" for m in got) == 1


# ---- the pipeline ----


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "pii", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = p.quality_filter(spark, docs, SMALL).cache()
    kept = {r.doc_id for r in good.collect()}
    assert all(k in kept for k, q in labels.items() if q == 1) and good.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = p.near_duplicates(spark, good, SMALL).cache()
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)}) and one.columns == docs.columns
    clean = p.pii_sanitisation(spark, one, SMALL).cache()
    assert clean.count() == one.count() and clean.columns == docs.columns
    from tests.llm.test_text_ops import base_pii, check_packing, library_ids

    before = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id]) == (not base_pii(before[r.doc_id]))
    packed = p.sequence_packing(spark, clean, SMALL).collect()
    check_packing(packed, library_ids({r.doc_id: r.text for r in clean.collect()}), 2048)
    assert {r.doc_id for r in packed} == set(before)


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline as p

    rows = [(i, t, "en", "s", 1) for i, t in ODD + [(906, "a b c d e f g"), (906, "a b c d e f g"), (907, "a b c d e f g"), (None, "a b c d e f g"), (None, None)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = p.near_duplicates(spark, docs, SMALL)
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted(["900", "901", "902", "904", "905", "906", "None"])
    out = p.sequence_packing(spark, p.pii_sanitisation(spark, one, SMALL), SMALL)
    assert out.count() >= 8
    assert p.near_duplicates(spark, docs.limit(0), SMALL).count() == 0


def test_pipeline_of_nothing_and_of_clashing_names(spark):
    """Columns named like those of the stages are kept through all but the last; very long texts pass; no rows give no rows."""
    import corpus_pipeline as p

    more = {"_score": "'a'", "node": "1", "th": "'b'", "root": "2", "_row": "'c'", "_text": "'d'", "ids": "3"}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).selectExpr("*", *(f"{v} AS {k}" for k, v in more.items()))
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.repeat(F.col("text"), 300)}))
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in p.STAGES[:-1]:
            now = stage(spark, now, SMALL).cache()
            assert now.columns == docs.columns, name
            assert {(r["_score"], r.node, r.root) for r in now.collect()} <= {("a", 1, 2)}, name
        packed = p.STAGES[-1][1](spark, now, SMALL)
        assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in now.collect()} and (some is docs) == (packed.count() > 0)
