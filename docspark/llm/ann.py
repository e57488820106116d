"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard, results merged.

Within a shard the nodes are ordered by their drawn top layer, highest first, so layer l is the graph on the first n_l nodes and is
stored as one flat array of neighbours, n_l rows of a fixed width, -1 where a row has fewer. Graphs are built in batches: a batch
searches the graph so far with a beam, adds near members of the batch itself, picks neighbours that are not nearer to each other
than to the node, and links back. Beams of all queries of a block advance together.

Scores are cosines of the original vectors in double precision.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part; vectors are compared with those of
the same length only; equal vectors score alike, and ties go to the lesser id; repeated rows with one id are one candidate;
null ids take no part; fewer candidates than k give them all; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Shard, search, usable

SHARD_ROWS = 16384
M = 16
EF_BUILD = 48
EF_SEARCH = 128
BATCH = 512


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two below their greatest component, which is exact and keeps squares of huge and tiny ones in range."""
    return np.ldexp(x, 1 - np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def beam(points: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` most similar nodes that a best-first walk finds for each query, most similar first; -1 where there are fewer."""
    nq, n = len(queries), len(graph)
    row = np.arange(nq)
    ids = np.full((nq, ef), -1, dtype=np.int32)
    sims = np.full((nq, ef), -np.inf, dtype=np.float32)
    done = np.ones((nq, ef), dtype=bool)
    seen = np.zeros((nq, n), dtype=bool)
    ids[:, 0], done[:, 0] = start, False
    sims[:, 0] = np.einsum("qd,qd->q", queries, points[start])
    seen[row, start] = True
    live = row
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        at = open_.argmax(axis=1)
        more = open_[np.arange(len(live)), at] > -np.inf
        live, at = live[more], at[more]
        if not len(live):
            break
        done[live, at] = True
        near = graph[ids[live, at]]
        new = (near >= 0) & ~seen[live[:, None], near]
        q, c = np.nonzero(new)
        seen[live[q], near[q, c]] = True
        s = np.full(near.shape, -np.inf, dtype=np.float32)
        s[q, c] = np.einsum("qd,qd->q", queries[live[q]], points[near[q, c]])
        all_s = np.concatenate([sims[live], s], axis=1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        sims[live] = np.take_along_axis(all_s, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], axis=1), top, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    sims = np.take_along_axis(sims, order, 1)
    return np.where(np.isfinite(sims), np.take_along_axis(ids, order, 1), -1), sims


def chosen(points: np.ndarray, nodes: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """At most ``width`` of each node's candidates (-1: none), spread out: one is passed over if it is nearer to a chosen one.

    Where that leaves fewer than half, the nearest that were passed over follow, so that vectors of one direction don't stand apart from all others.
    """
    out = np.full((len(nodes), width), -1, dtype=np.int32)
    for at in range(0, len(nodes), 256):
        node, cand = nodes[at : at + 256], ids[at : at + 256]
        vec = points[cand]
        sim = np.einsum("nd,ncd->nc", points[node], vec)
        bad = (cand < 0) | (cand == node[:, None])
        sim[bad] = -np.inf
        order = np.argsort(-sim, axis=1, kind="stable")
        order = order[:, : 2 * width]
        sim, cand = np.take_along_axis(sim, order, 1), np.take_along_axis(cand, order, 1)
        vec = np.take_along_axis(vec, order[:, :, None], 1)
        among = vec @ vec.transpose(0, 2, 1)
        closest = np.full(sim.shape, -np.inf, dtype=np.float32)
        count = np.zeros(len(node), dtype=np.int64)
        repeat = np.zeros(sim.shape, dtype=bool)
        for most, spread in ((width, True), (width // 2, False)):
            for c in range(cand.shape[1]):
                take = np.isfinite(sim[:, c]) & (count < most) & ~repeat[:, c]
                rows = np.flatnonzero(take & (sim[:, c] > closest[:, c]) if spread else take)
                out[at + rows, count[rows]] = cand[rows, c]
                count[rows] += 1
                closest[rows] = np.maximum(closest[rows], among[rows, c])
                repeat[rows] |= cand[rows] == cand[rows, c][:, None]
    return out


def layer_graph(points: np.ndarray, n: int, width: int, upper: list[np.ndarray]) -> np.ndarray:
    """The graph on the first ``n`` points."""
    graph = np.full((n, width), -1, dtype=np.int32)
    have = min(n, 2 * width)
    first = np.arange(have)
    graph[:have] = chosen(points, first, np.tile(first.astype(np.int32), (have, 1)), width)
    while have < n:
        batch = np.arange(have, min(n, have + min(BATCH, have)))
        start = descend(points, upper, points[batch])
        start = np.where(start < have, start, 0)
        ids, _ = beam(points, graph[:have], points[batch], start, EF_BUILD)
        own = points[batch] @ points[batch].T
        near = np.argsort(-own, axis=1)[:, : min(len(batch), width)]
        graph[batch] = chosen(points, batch, np.concatenate([ids, batch[near].astype(np.int32)], axis=1), width)
        to = graph[batch].reshape(-1)
        frm = np.repeat(batch, width)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        target, begin, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(begin, count)
        back = np.full((len(target), int(count.max())), -1, dtype=np.int32)
        back[np.repeat(np.arange(len(target)), count), place] = frm
        back[(back[:, :, None] == graph[target][:, None, :]).any(axis=2)] = -1  # linked already
        # lists with room take the links as they are, full ones choose anew
        held, more = (graph[target] >= 0).sum(axis=1), (back >= 0).sum(axis=1)
        room = held + more <= width
        r, c = np.nonzero((back >= 0) & room[:, None])
        nth = np.cumsum(back >= 0, axis=1)[r, c] - 1
        graph[target[r], held[r] + nth] = back[r, c]
        full = ~room
        if full.any():
            graph[target[full]] = chosen(points, target[full], np.concatenate([graph[target[full]], back[full]], axis=1), width)
        have = int(batch[-1]) + 1
    return graph


def descend(points: np.ndarray, upper: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """The most similar node that a greedy walk down the upper layers finds; ``upper`` has the top layer first."""
    at = np.zeros(len(queries), dtype=np.int64)
    for graph in upper:
        ids, _ = beam(points, graph, queries, at, 1)
        at = ids[:, 0].astype(np.int64)
    return at


def build(vecs: np.ndarray) -> bytes:
    """Order of the nodes and every layer's flat neighbour array, top layer first."""
    n = len(vecs)
    draw = np.random.default_rng(n).random(n)
    top = np.floor(-np.log(1 - draw) / np.log(M)).astype(np.int64)
    order = np.argsort(-top, kind="stable")
    points = unit(vecs)[order]
    layers: list[np.ndarray] = []
    for level in range(int(top.max()), -1, -1):
        size = int((top >= level).sum())
        if size > 1 or level == 0:
            layers.append(layer_graph(points, size, 2 * M if level == 0 else M, list(layers)))
    out = io.BytesIO()
    np.savez(out, order=order, **{f"layer{i}": x for i, x in enumerate(layers)})
    return out.getvalue()


def finder(k: int):
    def find(shard: Shard, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not hasattr(shard, "layers"):
            stored = np.load(io.BytesIO(shard.extra))
            shard.order = stored["order"]
            shard.layers = [stored[f"layer{i}"] for i in range(len(stored.files) - 1)]
            shard.points = unit(shard.vecs)[shard.order]
            shard.scaled = scaled(shard.vecs)
            shard.norms = np.sqrt((shard.scaled * shard.scaled).sum(axis=1))
        q, original = unit(queries), scaled(queries)
        ids, _ = beam(shard.points, shard.layers[-1], q, descend(shard.points, shard.layers[:-1], q), EF_SEARCH)
        for i, row in enumerate(ids):
            at = shard.order[row[row >= 0][: 2 * k + 2]]
            score = (shard.scaled[at] * original[i]).sum(axis=1) / (shard.norms[at] * np.sqrt((original[i] * original[i]).sum()))
            lens = shard.ends[at + 1] - shard.ends[at]
            who = np.concatenate([shard.ids_of(x) for x in at]) if len(at) else np.zeros(0, dtype=np.int64)
            score = np.repeat(score, lens)
            best = np.lexsort((who, -score))[: k + 1]
            yield score[best], who[best]

    return find


def nearest(df: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` holds, against all other rows."""
    rows = df.filter(is_query.isNotNull() & F.col(key).isNotNull() & usable(F.col(vector)) & F.exists(vector, lambda x: x != 0))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), is_query.alias("q")).distinct()
    return search(rows, F.col("q"), k, SHARD_ROWS, build, finder(k), "double")
