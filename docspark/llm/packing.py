"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Every document is encoded, its end id is added, and documents longer than the capacity are cut into full pieces, of which
the first holds the remainder. The pieces (not the texts) are dealt evenly into groups of about ``group_pieces``; each group
streams its pieces, longest first, through a bounded-space online best-fit: at most ``open_bins`` sequences are open, kept by
free space, with a bitset of the free spaces that occur, so the tightest fit is one bit search. When a new sequence is needed
and the bound is reached, the fullest one closes. A piece that fills a sequence never opens one.

Defined results: a null or empty text is the end id alone; a very long text is encoded whole and cut into as many pieces as it takes;
the key is a number (other keys raise, as the cast does); repeated rows are packed as often as they occur; pieces of equal length come by id and piece; null ids stay
null; an empty table gives no pieces; other input columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut
from .textvec import slices

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 1 << 15
OPEN_BINS = 4096

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


class FileTokenizer:
    """Ids by a tokenizer file, as the ``tokenizers`` library gives them without special tokens of its own making.

    Strings of the file's added tokens in a text are those tokens, as the library has it. A file that holds a plain byte-level BPE, whose
    merges come in the order of their ids, is read as ranks, which tiktoken merges several times faster to the same ids; other files, and
    texts that tiktoken refuses (white space in a row by the hundred thousand), go to the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        with open(path, encoding="utf-8") as f:
            ranks, added = plain_ranks(json.load(f))
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def byte_of_mark() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_ranks(spec: dict) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and added tokens of a tokenizer file; no ranks where it is more than a byte-level BPE with merges in the order of their ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    simple = model.get("type") == "BPE" and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
    simple &= split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    simple &= not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    simple &= not any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not simple:
        return {}, added
    vocab, mark = model["vocab"], byte_of_mark()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    single = {t for t in vocab if len(t) == 1}
    rising = all(x < y for x, y in zip([-1, *made], made, strict=False))
    whole = len(single) == 256 and single == set(mark) and {t for t in vocab if t not in added} == single | {a + b for a, b in merges}
    if not (rising and whole):
        return {}, added
    return {bytes(mark[c] for c in t): i for t, i in vocab.items() if t not in added}, added


@lru_cache(maxsize=1)
def file_tokenizer(path: str) -> FileTokenizer:
    return FileTokenizer(path)


def pieces(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: key as doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = file_tokenizer(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for part in slices(batch, "text"):
                made = [np.concatenate([encoder.ids(t), end]) if t else end for t in part.column("text").to_pylist()]
                total = np.array([len(x) for x in made], dtype=np.int64)
                full = np.concatenate(made).astype("<u4", copy=False)
                base = np.cumsum(total) - total
                count = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = total - (count - 1) * capacity
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                at = base[row] + start
                view = memoryview(full).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                out = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, type=pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(full)).astype(np.int32)), pa.array(full.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=[*PIECES.names, *["ids"] * with_ids])

    schema = T.StructType([*PIECES, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if with_ids else PIECES
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class BestFit:
    """Bounded-space online best-fit. ``place`` takes a length and gives the sequence's number and the offset in it."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open, self.made = 0, 0, 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.made
            self.made += 1
            if length < space and self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        left = space - length
        if left:
            self.free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - space


def pack(made: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, open_bins: int = OPEN_BINS) -> DataFrame:
    """``made`` (pieces with a length of 1 to the capacity) with sequence_id and offset.

    sequence_id is the group's number times 2**32 plus a count. The groups' number follows the count of pieces, and what a
    group leaves unfilled is a few sequences.
    """
    # the number that a piece has in the written table tells repeated rows apart, so that they spread over the groups too
    made = cut(made.withColumn("_row", F.monotonically_increasing_id()))
    groups = max(1, -(-made.count() // group_pieces))
    dealt = made.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_row"), F.lit(groups))).drop("_row")
    dealt = dealt.repartition(groups, "_group").sortWithinPartitions("_group", F.desc("length"), "doc_id", "piece", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, BestFit(capacity, open_bins)
        for batch in batches:
            numbers, offsets = [], []
            for g, length in zip(batch.column("_group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, bins = g, BestFit(capacity, open_bins)
                number, offset = bins.place(length)
                numbers.append((g << 32) + number)
                offsets.append(offset)
            keep = [n for n in batch.schema.names if n != "_group"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(numbers, type=pa.int64()), pa.array(offsets, type=pa.int64())], names=[*keep, "sequence_id", "offset"])

    schema = T.StructType([*made.drop("_row").schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.mapInArrow(run, schema)
