"""Exact top-k by integer inner product with MaxScore, per shard and merged.

Each component is a term; its posting list is a column of the shard's matrix, with the column's greatest and least value as the
bounds of what it can add to a score. For a query the k-th best score so far is the threshold: first that of the vectors at the
heads of the strongest terms' lists. Terms whose bounds together stay below it are non-essential. Essential lists are traversed
for all vectors; the rest are probed, strongest first, only for vectors whose partial score and remaining bounds still
reach the threshold, which rises on the way. A vector that ties with the threshold stays, so the result is exact.

Scores are exact integers. Where a product of double components could be rounded, bounds are widened by the rounding error of their own vectors,
and what is left is scored again in whole numbers of any length.

Defined results: vectors that are null or hold a null or non-finite component take no part; zero and empty vectors do; vectors meet those of the
same length only, empty ones each other with score 0; ties go to the lesser id; repeated rows with one id are one candidate; null ids take no part; fewer
candidates than k give them all; an empty table gives no rows; other columns are not carried. Components beyond a long are the nearest long, and so are scores, which then tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Shard, blob, search, usable

SHARD_ROWS = 8192
STEP = 8
HEADS = 4
#: Sums of whole numbers up to this are exact in doubles.
EXACT = 2.0**53
LONG = 2**63 - 1
#: A little below the greatest long.
TOP = 2.0**63 * (1 - 2.0**-40)


def build(vecs: np.ndarray) -> bytes:
    """The heads of every column: the vectors with its greatest and its least values."""
    order = np.argsort(vecs, axis=0, kind="stable").astype(np.int32)
    n = min(len(vecs), 32)
    return blob(np.stack([order[:n], order[::-1][:n]]))


def threshold(scores: np.ndarray, sizes: np.ndarray, need: int) -> float:
    """The score that ``need`` ids reach, or less than any if there are fewer; ``sizes`` are the classes' numbers of ids. Scores beyond a long all tie, so it is none above."""
    order = np.argsort(-scores, kind="stable")
    have = np.cumsum(sizes[order])
    at = int(np.searchsorted(have, need))
    return min(scores[order[at]], TOP) if at < len(have) else -np.inf


def is_exact(shard: Shard, q: np.ndarray) -> bool:
    return np.abs(q).sum() * shard.greatest <= EXACT


def top(shard: Shard, q: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Every class that can be among the best ``need`` ids, and its score up to rounding."""
    n, dim = shard.vecs.shape
    most = np.maximum(q * shard.high, q * shard.low)
    strength = most - np.minimum(q * shard.high, q * shard.low)
    order = np.argsort(-strength, kind="stable")
    # what rounding can add to a score, or take from it: none, where all sums are exact
    exact = is_exact(shard, q)
    slack = None if exact else (dim + 2) * 2.0**-50 * np.linalg.norm(q) * shard.norms
    of = (lambda at: 0.0) if exact else (lambda at: slack[at])
    loose, most_slack = (0.0, 0.0) if exact else ((dim + 2) * 2.0**-50 * np.abs(most).sum(), slack.max())
    heads = np.unique(np.concatenate([shard.heads[int(q[d] > 0), :, d] for d in order[:HEADS]]))
    least = threshold(shard.vecs[heads] @ q - of(heads), shard.sizes[heads], need)
    # what terms from place i on can still add
    rest = np.append(np.cumsum(most[order][::-1])[::-1] + loose, 0.0)
    essential = STEP
    while essential < dim and rest[essential] + most_slack >= least:
        essential += STEP
    terms = order[:essential]
    part = shard.columns[terms].T @ q[terms]
    alive = np.arange(n)
    at = min(essential, dim)
    while True:
        keep = part + rest[at] + of(alive) >= least
        alive, part = alive[keep], part[keep]
        if at == dim or not len(alive):
            return alive, part
        if len(alive) > 4 * need:  # the threshold rises by the best partial scores' vectors
            look = alive[np.argpartition(-part, 2 * need)[: 2 * need]]
            least = max(least, threshold(shard.vecs[look] @ q - of(look), shard.sizes[look], need))
        terms = order[at : at + STEP]
        part = part + shard.vecs[np.ix_(alive, terms)] @ q[terms]
        at = min(at + STEP, dim)


def whole(x: np.ndarray) -> list:
    """Doubles without fractions as numbers of any length; what a long can't hold is the nearest one."""
    return [max(-LONG - 1, min(LONG, int(v))) for v in x.tolist()]


def scores(shard: Shard, at: np.ndarray, q: np.ndarray, rounded: np.ndarray) -> np.ndarray:
    """The exact scores of classes ``at``, as longs."""
    if is_exact(shard, q):
        return rounded.astype(np.int64)
    terms = whole(q)
    exact = [sum(a * b for a, b in zip(terms, whole(v), strict=True)) for v in shard.vecs[at]]
    return np.array([max(-LONG, min(LONG, x)) for x in exact], dtype=np.int64)


def finder(k: int):
    def find(shard: Shard, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not hasattr(shard, "columns"):
            n, dim = shard.vecs.shape
            shard.columns, shard.sizes = np.ascontiguousarray(shard.vecs.T), np.diff(shard.ends)
            if dim:
                shard.high, shard.low = shard.vecs.max(axis=0), shard.vecs.min(axis=0)
                shard.heads = np.frombuffer(shard.extra, dtype=np.int32).reshape(2, -1, dim)
                shard.greatest, shard.norms = np.abs(shard.vecs).max(), np.linalg.norm(shard.vecs, axis=1)
        for q in queries:
            at, score = top(shard, q, k + 1) if len(q) else (np.arange(len(shard.vecs)), np.zeros(len(shard.vecs)))
            score = scores(shard, at, q, score) if len(q) else score.astype(np.int64)
            lens = shard.sizes[at]
            who = np.concatenate([shard.ids_of(x) for x in at]) if len(at) else np.zeros(0, dtype=np.int64)
            score = np.repeat(score, lens)
            best = np.lexsort((who, -score))[: k + 1]
            yield score[best], who[best]

    return find


def top_k(df: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", key: str = "vec_id", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` holds; components are floor(scale * x)."""
    rows = df.filter(is_query.isNotNull() & F.col(key).isNotNull() & usable(F.col(vector)))
    terms = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = rows.select(F.col(key).cast("long").alias("id"), terms.alias("vec"), is_query.alias("q")).distinct()
    return search(rows, F.col("q"), k, SHARD_ROWS, build, finder(k), "long")
