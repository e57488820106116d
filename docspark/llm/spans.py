"""Spans of pattern matches, by DataFrame functions alone.

``find`` gives the leftmost non-overlapping matches of a pattern with their places in code points. The matches come from
``regexp_extract_all`` and the gaps between them from ``split`` by the same pattern, so a running sum of lengths gives the
places. The sum runs in two steps, over blocks and inside each, so that a text with very many matches stays near linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def none() -> Column:
    return F.array().cast(SPAN)


def find(text: Column, pattern: str, kind: int = 0) -> Column:
    """Array of (start, kind, end, match) by start; ``text`` is not null."""

    def one(x: Column, start: Column) -> Column:
        return F.struct((start + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (start + x["gap"] + x["len"]).alias("end"), x["match"].alias("match"))

    def inside(block: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none().alias("out"))
        return F.aggregate(
            block,
            first,
            lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"), F.concat(acc["out"], F.array(one(x, acc["at"]))).alias("out")),
            lambda acc: acc["out"],
        )

    def places(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(pairs) / BLOCK).cast("int") - 1), lambda i: F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)))

        def summed(cut: Column) -> Column:
            sums = F.transform(cut, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
            starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
            return F.flatten(F.zip_with(cut, F.slice(starts, F.lit(1), F.size(cut)), inside))

        return let(blocks, summed)

    def matched(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("match")))
        return F.when(F.size(found) == 0, none()).otherwise(let(pairs, places))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), matched)


def ordered(*arrays: Column) -> Column:
    """All spans by start, then kind."""
    return F.array_sort(F.concat(*arrays))


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _rewritten(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """``text`` with the array of strings ``put(s, at)`` in place of each span; ``at`` is the end of all spans before it.

    Spans come by start. Blocks of them work on their own stretch of the text, so a text with very many spans stays near linear.
    """

    def inside(block: Column, start: Column) -> Column:
        end = F.greatest(start, F.array_max(F.transform(block, lambda s: s["end"])))

        def fold(part: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                kept = F.when(s["start"] > acc["at"], F.substring(part, acc["at"] - start + 1, s["start"] - acc["at"])).otherwise("")
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(kept), put(s, acc["at"])).alias("out"))

            first = F.struct(start.alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(block, first, step, lambda acc: F.array_join(acc["out"], ""))

        return let(F.substring(text, start + 1, end - start), fold)

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(spans) / BLOCK).cast("int") - 1), lambda i: F.slice(spans, i * BLOCK + 1, F.lit(BLOCK)))

    def joined(cut: Column) -> Column:
        ends = F.transform(cut, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
        starts = F.aggregate(ends, F.array(F.lit(0)), lambda a, e: F.concat(a, F.array(F.greatest(F.element_at(a, -1), e))))
        return let(starts, lambda at: F.concat(F.array_join(F.zip_with(cut, F.slice(at, F.lit(1), F.size(cut)), inside), ""), F.substring(text, F.element_at(at, -1) + 1, F.length(text))))

    return F.when(F.size(spans) == 0, text).otherwise(let(blocks, joined))


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """``text`` with each span replaced; a span that overlaps an earlier one only extends what is taken out."""
    return _rewritten(text, spans, lambda s, at: F.array(F.when(s["start"] >= at, by(s)).otherwise("")))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark``, one character, in place of every character of the spans, so that all places stay."""
    return _rewritten(text, spans, lambda s, at: F.array(F.repeat(F.lit(mark), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)))))
