"""Where the lines of a text stand: an automaton over its fence lines, run in the JVM.

A fence line opens a verbatim block unless one is open, and the line that opened a block is the only one that closes it, so the state is the open fence. Only lines that may be fences
take part. They go in blocks: one fold over the blocks carries the state from each to the next, and each block's spans are then found on their own, so a text with very many fences stays near linear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
# The lines that open blocks whose text is taken as it is.
FENCE = r"^(-{4,}|\.{4,}|\+{4,}|/{4,}|```.*|~~~.*)\s*$"
SPANS = "array<struct<first:int,last:int>>"


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def closes(state: Column, fence: Column) -> Column:
    """Whether a fence line ends the block that ``state`` opened; a fence of backticks or tildes may be opened with a language."""
    return (state == fence) | (F.substring(state, 1, 3).isin("```", "~~~") & (F.substring(state, 1, 3) == fence))


def moved(state: Column, fence: Column) -> Column:
    return F.when(state == "", fence).when(closes(state, fence), "").otherwise(state)


def verbatim(lines: Column) -> Column:
    """The spans (first, last) of line numbers, from 0, of an array of lines that lie in verbatim blocks, fences included; one that is never closed goes on to the end."""
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.rtrim(x).alias("fence"))), lambda m: m["fence"].rlike(FENCE))

    def spans(marks: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(marks) / BLOCK).cast("int") - 1), lambda i: F.slice(marks, i * BLOCK + 1, F.lit(BLOCK)))
        start = lambda state, since: F.struct(state.alias("open"), since.alias("since"))

        def over(acc: Column, m: Column) -> Column:
            now = moved(acc["open"], m["fence"])
            return start(now, F.when((acc["open"] == "") & (now != ""), m["at"]).otherwise(acc["since"]))

        def entered(acc: Column, block: Column) -> Column:
            out = F.aggregate(block, F.element_at(acc, -1), over)
            return F.concat(acc, F.array(out))

        def inside(block: Column, entry: Column) -> Column:
            first = F.struct(entry["open"].alias("open"), entry["since"].alias("since"), F.array().cast(SPANS).alias("out"))

            def one(acc: Column, m: Column) -> Column:
                now = start(acc["open"], acc["since"])
                nxt = over(now, m)
                ended = (acc["open"] != "") & (nxt["open"] == "")
                out = F.when(ended, F.concat(acc["out"], F.array(F.struct(acc["since"].alias("first"), m["at"].alias("last"))))).otherwise(acc["out"])
                return F.struct(nxt["open"].alias("open"), nxt["since"].alias("since"), out.alias("out"))

            return F.aggregate(block, first, one, lambda acc: acc["out"])

        def all_(states: Column) -> Column:
            closed = F.flatten(F.zip_with(blocks, F.slice(states, F.lit(1), F.size(blocks)), inside))
            last = F.element_at(states, -1)
            rest = F.when(last["open"] != "", F.array(F.struct(last["since"].alias("first"), (F.size(lines) - 1).alias("last")))).otherwise(F.array().cast(SPANS))
            return F.concat(closed, rest)

        return let(F.aggregate(blocks, F.array(start(F.lit(""), F.lit(-1))), entered), all_)

    return let(marks, lambda m: F.when(F.size(m) == 0, F.array().cast(SPANS)).otherwise(spans(m)))


def within(at: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: at.between(s["first"], s["last"]))


def marked(text: Column, prefix: str, mark: str = "\u0000") -> Column:
    """``text`` with ``mark`` before each line that begins with ``prefix`` and lies in a verbatim block."""

    def done(lines: Column) -> Column:
        return let(verbatim(lines), lambda spans: F.array_join(F.transform(lines, lambda x, i: F.when(x.startswith(prefix) & within(i, spans), F.concat(F.lit(mark), x)).otherwise(x)), "\n"))

    return F.when(text.contains(prefix), let(F.split(text, "\n"), done)).otherwise(text)
