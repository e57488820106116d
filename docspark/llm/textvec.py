"""Array primitives over the UTF-8 buffer of an Arrow string column.

Everything works on whole texts in slices of at most ``max_bytes`` (a longer single text is a slice of its own), so the
memory of a task follows the slice and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_P = int(0x9E3779B97F4A7C15) | 1
_PINV = pow(_P, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[32, *range(9, 14)]] = False

_pow: np.ndarray = np.ones(1, dtype=np.uint64)
_inv: np.ndarray = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n; grown by doubling and kept for the worker's life."""
    global _pow, _inv
    while len(_pow) < n:
        m = len(_pow)
        _pow = np.concatenate([_pow, _pow * _U(pow(_P, m, 1 << 64))])
        _inv = np.concatenate([_inv, _inv * _U(pow(_PINV, m, 1 << 64))])
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``max_bytes``."""
    if not batch.num_rows:
        return
    text = batch.column(column)
    if text.type not in (pa.string(), pa.large_string()):
        yield batch
        return
    ends = offsets_of(text)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + max_bytes, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def offsets_of(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    return np.frombuffer(text.buffers()[1], dtype=kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the column and the n + 1 offsets into them; a null counts as an empty text."""
    if text.null_count:
        text = text.fill_null("")
    off = offsets_of(text) if len(text) else np.zeros(1, dtype=np.int64)
    data = text.buffers()[2] if len(text) else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and how many words lie before each text (n + 1)."""
    w = IS_WORD[raw]
    if not len(w):
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(off), dtype=np.int64)
    first = np.zeros(len(w) + 1, dtype=bool)
    first[off[:-1]] = True
    begin = w.copy()
    begin[1:] &= ~w[:-1] | first[1:-1]
    starts = np.flatnonzero(begin)
    end = np.empty(len(w), dtype=bool)
    end[-1] = w[-1]
    end[:-1] = w[:-1] & (~w[1:] | first[1:-1])
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def slice_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte slice; the same bytes give the same hash wherever they stand.

    A running sum of byte * P**i, whose difference over a slice is divided by P**start (P is odd, so it has an inverse).
    """
    p, inv = _powers(len(raw) + 1)
    run = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * p[: len(raw)], out=run[1:])
    return mix((run[ends] - run[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words in each text, and how many lie before each text (n + 1).

    A text with fewer words but at least one gives its whole sequence as one shingle, which never equals one of ``width``.
    """
    n = np.diff(before)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_before = np.concatenate([[0], np.cumsum(count)])
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64), out_before
    a = _U(0xD6E8FEB86659FD93)
    total = int(out_before[-1])
    at = np.repeat(before[:-1] - out_before[:-1], count) + np.arange(total)
    padded = np.concatenate([hashes, np.zeros(width, dtype=np.uint64)])
    acc = np.zeros(total, dtype=np.uint64)
    for k in range(width):
        acc = acc * a + padded[at + k]
    acc = mix(acc)
    short = np.flatnonzero((n > 0) & (n < width))
    for i in short:
        x = 0
        for h in hashes[before[i] : before[i + 1]]:
            x = (x * int(a) + int(h)) & (1 << 64) - 1
        acc[out_before[i]] = mix(np.array([x ^ (0x5851F42D4C957F2D * int(n[i]) & (1 << 64) - 1)], dtype=np.uint64))[0]
    return acc, out_before


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    total = int(lens.sum())
    out = np.cumsum(lens) - lens
    return np.repeat(starts - out, lens) + np.arange(total)


def u64(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs with the same bits."""
    return pa.array(x.view(np.int64))
