"""Byte-level BPE encoding and decoding over whole columns.

Pre-tokenisation runs on arrays and not on a regex: each code point has a class, each class is a function on the states of
a small automaton, and the functions' composition is associative. All functions that can arise form a finite monoid, whose
product table is computed once; a blocked scan over that table gives the state before every code point and so the slice
boundaries. Slices then go through pair merging, once per distinct slice, and are gathered back as flat id arrays with
the offsets of every text.

Defined results: a null or empty text has no ids; a text of any length is encoded whole, as a slice of its own if need be; repeated rows get the same ids; other input columns are kept, and one
named like an output column is replaced by it; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches
from .textvec import ragged, slices, utf8

# Symbols of the automaton. A white-space code point is "mid" when the next one is white space or the text
# ends there, else it is the last of its run; "pair" letters are r and v before e, and l before l.
MID, LAST_SPACE, LAST_OTHER, LETTER, SINGLE, PAIR, DIGIT, APOSTROPHE, OTHER = range(9)
# States, by what the open token is.
CLOSED, IN_LETTERS, IN_DIGITS, IN_OTHER, IN_SPACE, AFTER_SPACE, AFTER_APOSTROPHE, IN_CONTRACTION = range(8)
# Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_SPACE_CLASS = MID
BLOCK = 512


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after ``symbol``, and whether a token begins at it."""
    if symbol == MID:
        return IN_SPACE, state != IN_SPACE
    if symbol == LAST_SPACE:
        return AFTER_SPACE, True
    if symbol == LAST_OTHER:
        return CLOSED, True
    if symbol in (LETTER, SINGLE, PAIR):
        if state == IN_CONTRACTION or state == AFTER_APOSTROPHE and symbol == SINGLE:
            return CLOSED, False
        if state == AFTER_APOSTROPHE and symbol == PAIR:
            return IN_CONTRACTION, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == DIGIT:
        return IN_DIGITS, state not in (IN_DIGITS, AFTER_SPACE)
    joins = state in (IN_OTHER, AFTER_SPACE, AFTER_APOSTROPHE)
    return (AFTER_APOSTROPHE if symbol == APOSTROPHE and not joins else IN_OTHER), not joins


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, product table, end state by element and state, next state and boundary by state and symbol).

    Symbols 9 to 17 are 0 to 8 at the start of a text: they act alike from every state.
    """
    after = np.zeros((8, 18), dtype=np.uint8)
    begins = np.zeros((8, 18), dtype=bool)
    for state in range(8):
        for symbol in range(9):
            after[state, symbol], begins[state, symbol] = step(state, symbol)
            after[state, symbol + 9], begins[state, symbol + 9] = step(CLOSED, symbol)[0], True
    found = {tuple(range(8)): 0}
    generators = []
    for symbol in range(18):
        f = tuple(int(x) for x in after[:, symbol])
        found.setdefault(f, len(found))
        generators.append(found[f])
    todo = list(found)
    while todo:
        f = todo.pop()
        for symbol in range(18):
            g = tuple(int(after[s, symbol]) for s in f)
            if g not in found:
                found[g] = len(found)
                todo.append(g)
    maps = np.array(list(found), dtype=np.uint8)
    size = len(maps)
    product = np.zeros((size, size), dtype=np.uint16)
    for i, f in enumerate(maps):
        for j, g in enumerate(maps):
            product[i, j] = found[tuple(int(x) for x in g[f])]
    return np.array(generators, dtype=np.uint16), product, maps, after, begins


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """A class for every code point: MID for white space, LETTER, DIGIT or OTHER by general category."""
    kind = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[WHITE_SPACE] = _SPACE_CLASS
    out[0x27] = APOSTROPHE
    return out


def symbols(points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """The automaton's symbol of each code point; ``text_start`` marks the first code point of each text."""
    table = classes()
    cls = table[points]
    n = len(points)
    last = np.ones(n, dtype=bool)
    last[:-1] = text_start[1:]
    space = cls == _SPACE_CLASS
    next_space = np.ones(n, dtype=bool)
    next_space[:-1] = space[1:] | last[:-1]
    ends = space & ~next_space
    out = cls.copy()
    out[ends] = LAST_OTHER
    out[ends & (points == 0x20)] = LAST_SPACE
    after_mark = np.zeros(n, dtype=bool)
    after_mark[1:] = (cls[:-1] == APOSTROPHE) & ~text_start[1:]
    for i in np.flatnonzero(after_mark):
        c = points[i]
        if c in (0x73, 0x74, 0x6D, 0x64):
            out[i] = SINGLE
        elif c in (0x72, 0x76, 0x6C) and not last[i] and points[i + 1] == (0x6C if c == 0x6C else 0x65):
            out[i] = PAIR
    out[text_start] += 9
    return out


def boundaries(symbol: np.ndarray) -> np.ndarray:
    """Whether a token begins at each code point, by a blocked scan of composed transition functions."""
    of_symbol, product, maps, after, begins = automaton()
    n = len(symbol)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, MID, dtype=np.uint8)
    padded[:n] = symbol
    grid = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    width = product.shape[0]
    flat = product.reshape(-1)
    elements = of_symbol[grid]
    total = elements[0]
    for k in range(1, BLOCK):
        total = flat[total.astype(np.intp) * width + elements[k]]
    state = np.zeros(blocks, dtype=np.uint8)
    now = CLOSED
    for b, f in enumerate(total.tolist()):
        state[b] = now
        now = int(maps[f, now])
    out = np.empty((BLOCK, blocks), dtype=bool)
    after_flat, begins_flat = after.reshape(-1), begins.reshape(-1)
    for k in range(BLOCK):
        at = state.astype(np.intp) * 18 + grid[k]
        out[k] = begins_flat[at]
        state = after_flat[at]
    return out.T.reshape(-1)[:n]


def pretokenize(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the slices' starts, and how many slices lie before each text (n + 1)."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(len(off), dtype=np.int64)
    first_bytes = np.flatnonzero((raw & 0xC0) != 0x80)
    if len(first_bytes) == len(raw):
        points = raw.astype(np.uint32)
    else:
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    text_start = np.zeros(len(points) + 1, dtype=bool)
    text_start[np.searchsorted(first_bytes, off[:-1])] = True
    starts = first_bytes[boundaries(symbols(points, text_start[:-1]))]
    return starts, np.searchsorted(starts, off)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of least rank is merged, the leftmost first, until none has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) <= 48:
        scores = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        while True:
            best, at = None, -1
            for i, r in enumerate(scores):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = ranks.get(parts[at] + parts[at + 1])
    after = [*range(1, len(parts)), -1]
    before = [-1, *range(len(parts) - 1)]
    heap = [(r, i, p) for i in range(len(parts) - 1) if (r := ranks.get(p := parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if parts[i] else -1
        if j < 0 or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, b""
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (r := ranks.get(p := parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (r, left, p))
    return [ranks[p] for p in parts if p]


class SliceEncoder:
    """Ids of text columns; distinct slices are encoded once and kept. Beyond ``kept`` of them, only those of the last texts stay."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], kept: int = 150_000):
        self.encode, self.kept = encode, kept
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])

    def _look_up(self, distinct: list[bytes]) -> np.ndarray:
        if len(self.index) > self.kept:
            old, ids, ends = self.index, self.ids, self.ends
            self._clear()
            for w in distinct:
                if (i := old.get(w)) is not None:
                    self.index[w] = len(self.ends) - 1
                    self.ids.extend(ids[ends[i] : ends[i + 1]])
                    self.ends.append(len(self.ids))
        get = self.index.get
        out = [get(w, -1) for w in distinct]
        missing = [i for i, x in enumerate(out) if x < 0]
        if missing:
            for i, ids in zip(missing, self.encode([distinct[i] for i in missing]), strict=True):
                out[i] = self.index[distinct[i]] = len(self.ends) - 1
                self.ids.extend(ids)
                self.ends.append(len(self.ids))
        return np.array(out, dtype=np.int64)

    def column(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many lie before each text (n + 1)."""
        starts, before = pretokenize(raw, off)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(off), dtype=np.int64)
        ends = np.append(starts, len(raw)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = column.dictionary_encode()
        which = self._look_up(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        bounds = np.array(self.ends, dtype=np.int64)
        lens = np.diff(bounds)[which]
        ids = np.array(self.ids, dtype=np.int32)[ragged(bounds[which], lens)]
        return ids, np.concatenate([[0], np.cumsum(lens)])[before]


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def rank_encoder(path: str) -> SliceEncoder:
    ranks = read_ranks(path)
    return SliceEncoder(lambda words: [merge(w, ranks) for w in words])


@lru_cache(maxsize=2)
def id_bytes(path: str) -> pa.Array:
    """The bytes of every id; an id without a token has none."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, type=pa.binary())


def put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with the column last, in place of one of that name."""
    keep = [i for i, n in enumerate(batch.schema.names) if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], names=[*(batch.schema.names[i] for i in keep), name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name.lower() != name.lower()), T.StructField(name, kind)])


def encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: the ids of ``text`` by the rank file ``vocabulary``, which every executor can open."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, text):
                ids, before = encoder.column(*utf8(part.column(text)))
                yield put(part, out, pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(ids)))

    return df.mapInArrow(run, _schema(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = id_bytes(vocabulary)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 1024):
                part = batch.slice(at, 1024)
                column = part.column(ids)
                ends = column.offsets.to_numpy()
                flat = tokens.take(column.values.slice(ends[0], ends[-1] - ends[0])) if len(column) else tokens.slice(0, 0)
                if flat.null_count:
                    flat = flat.fill_null(b"")
                starts = np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, dtype=np.int32)
                cuts = np.ascontiguousarray(starts[ends - ends[0]] if len(column) else starts)
                data = flat.buffers()[2] if len(flat) else None
                yield put(part, out, pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(cuts), data or pa.py_buffer(b"")]))

    return df.mapInArrow(run, _schema(df, out, T.BinaryType()))
