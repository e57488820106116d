"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Features of a text are hashed n-grams of two word sequences: the words (one and two in a row) and their shapes (one to
three in a row; a shape tells case, length, first and last character and whether the word repeats the one before). Each n-gram's
value is its share of the text's n-grams of that family, so a text's length does not move its score.

Training takes at most ``TRAIN_ROWS`` labelled documents, those with the least hash of their id, which is a documented bound of
the fit and no bound of the scoring: every text is scored whole. The model is ``2 ** BITS`` numbers, whatever the table's size.

Defined results: a null or empty text scores by the bias alone; texts of any length are scored whole; repeated rows score alike; rows whose label is null are not
learned from; without any labels every score is 0.5; other columns are kept, and one named like an output column is
replaced by it; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import put
from .common import bounded_batches
from .textvec import SLICE_BYTES, mix, slice_hashes, slices, utf8, words

BITS = 18
TRAIN_ROWS = 8_000
EPOCHS = 2
THRESHOLD = 0.3
SCALE = 8.0

_U = np.uint64
#: (sequence, words in a row)
FAMILIES = (("word", 1), ("word", 2), ("shape", 1), ("shape", 2), ("shape", 3))


def shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A small number for the form of each word."""
    first, last = KIND[raw[starts]], KIND[raw[ends - 1]]
    upper = np.concatenate([[0], np.cumsum(KIND[raw] == 1)])
    caps = (upper[ends] - upper[starts]) * 2 > (ends - starts)
    long = np.digitize(ends - starts, (2, 4, 9, 17, 33))
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[before[:-1][before[:-1] < len(starts)]] = False
    return ((((first * 8 + last) * 2 + caps) * 6 + long) * 2 + same).astype(np.uint64)


# 0 lower case, 1 upper case, 2 digit, 3 sentence marks, 4 quotes and brackets, 5 other ASCII, 6 not ASCII.
KIND = np.full(256, 5, dtype=np.int64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 6
KIND[[ord(c) for c in ".,;:?"]] = 3
KIND[[ord(c) for c in "\"'()[]{}<>"]] = 4


def features(raw: np.ndarray, off: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family, the feature of every n-gram and how many lie before each text (n + 1)."""
    starts, ends, before = words(raw, off)
    hashes = slice_hashes(raw, starts, ends)
    sequences = {"word": hashes, "shape": mix(shapes(raw, starts, ends, hashes, before)) if len(starts) else hashes}
    out = []
    n = np.diff(before)
    for f, (name, width) in enumerate(FAMILIES):
        count = np.maximum(n - width + 1, 0)
        at = np.repeat(before[:-1], count) + _within(count)
        acc = np.full(len(at), f + 1, dtype=np.uint64)
        for k in range(width):
            acc = mix(acc + sequences[name][at + k])
        out.append(((acc >> _U(64 - bits)).astype(np.int64), np.concatenate([[0], np.cumsum(count)])))
    return out


def _within(count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probabilities: the logistic function of each text's sparse dot product with the weights."""
        total = np.full(len(off) - 1, self.bias)
        for index, before in features(raw, off):
            run = np.concatenate([[0.0], np.cumsum(self.weights[index], dtype=np.float64)])
            n = np.diff(before)
            total += SCALE * (run[before[1:]] - run[before[:-1]]) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(raw: np.ndarray, off: np.ndarray, labels: np.ndarray, **options) -> Model:
    """``fit_parts`` of one part."""
    return fit_parts([(raw, off, labels)], **options)


def fit_parts(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, bits: int = BITS) -> Model:
    """FTRL-proximal over the texts of all parts (bytes, offsets, labels), one at a time, in the order given."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    for _ in range(epochs):
        for y, index, value in (x for part in parts for x in samples(*part, bits)):
            index, at = np.unique(index, return_inverse=True)
            value = np.bincount(at, value, len(index)) if len(index) else value
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(value @ w + bias, -40, 40)))
            g = (p - y) * value
            z[index] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[index] += g * g
            d = p - y
            bias_z += d - (np.sqrt(bias_n + d * d) - np.sqrt(bias_n)) / alpha * bias
            bias_n += d * d
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return Model(w.astype(np.float32), float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2)))


def samples(raw: np.ndarray, off: np.ndarray, labels: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Label, features and values of each text; features are made for a slice of texts at a time."""
    at = 0
    while at < len(labels):
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, side="right")) - 1)
        found = features(raw[off[at] : off[to]], off[at : to + 1] - off[at], bits)
        for i in range(to - at):
            index = np.concatenate([ids[b[i] : b[i + 1]] for ids, b in found])
            yield int(labels[at + i]), index, np.concatenate([np.full(m := int(b[i + 1] - b[i]), SCALE / max(m, 1)) for _, b in found])
        at = to


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out.

    The chosen ids are at most ``rows``, so they may be broadcast to the documents, and the fit runs in one task on an executor.
    """
    bounded_batches(docs.sparkSession)
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~F.coalesce(held_out(key), F.lit(True)))
    chosen = chosen.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key").limit(rows)
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")
    sample = sample.select(F.xxhash64("_key").alias("o"), "_key", "text", "_label").orderBy("o", "_key", "text").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # batches stay apart, so that texts of more than 2 GB together keep their offsets
        parts = [(*utf8(b.column("text")), b.column("_label").to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        model = fit_parts(parts)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], type=pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    fitted = sample.coalesce(1).mapInArrow(run, "weights binary, bias double").collect()
    if not fitted:
        return Model(np.zeros(1 << BITS, dtype=np.float32), 0.0)
    return Model(np.frombuffer(fitted[0].weights, dtype=np.float32), fitted[0].bias)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out``, the probability of label 1. The model goes to the executors as a broadcast of fixed size."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield put(part, out, pa.array(shared.value.scores(*utf8(part.column(text)))))

    schema = T.StructType([*(f for f in df.schema if f.name.lower() != out.lower()), T.StructField(out, T.DoubleType())])
    return df.mapInArrow(run, schema)
