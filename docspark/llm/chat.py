"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns by turns, the assistant last. Each turn keeps its role or is
relabelled; a turn with the role of the one before is merged into it; where one turn is missing, an empty one is inserted. Dynamic
programming over the automaton of legal turns finds the cheapest repair; every turn is a 4 x 4 matrix of costs from the last role to the
next, and matrices combine by (min, +), which is associative. So a conversation is cut into blocks by its turn numbers, and a block of very many turns with the same
numbers into parts, by a sort of such turns over ranges: parts give
their matrices, these give each part's entry and exit states, and parts are then repaired on their own. A
conversation of any length is spread over tasks; only its parts' matrices, 16 numbers a part, come together.

The result has one row per repaired turn in place of one long text, and its ``rendered`` pieces, joined in the order of (block, at), are the
conversation's training text; ``conversations`` joins them for conversations of ordinary length.

Defined results: a null or unknown role is relabelled at a lower cost; a null text is empty and kept; turns come by number, nulls
first, then by role and text, which may be of any length; repeated rows are turns of their own and merge; rows with a null conversation id are one
conversation; other columns are not carried; an empty table gives an empty table. Markers in a text are escaped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, on_group, shuffle_partitions
from .vectors import grouped

ROLES = ("system", "user", "assistant")
# States are the last turn's role, or none.
NONE, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {(NONE, SYSTEM), (NONE, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
MERGE, INSERT, RELABEL, NAME = 1.0, 2.0, 3.5, 1.5
BLOCK = 256
INFINITE = float("inf")

RESULT = "conv_id long, block long, at long, turn long, role string, new_role string, action string, text string, rendered string, conv_cost double"


def between(a: int, b: int) -> tuple[float, int | None] | None:
    """Cost of role b after state a, and the role to insert; None if no repair with one insertion or merge is legal."""
    if (a, b) in LEGAL:
        return 0.0, None
    if a == b:
        return MERGE, None
    for x in (USER, ASSISTANT):
        if (a, x) in LEGAL and (x, b) in LEGAL:
            return INSERT, x
    return None


STEPS = {(a, b): s for a in range(4) for b in (SYSTEM, USER, ASSISTANT) if (s := between(a, b)) is not None}


def role_number(role: str | None) -> int:
    return 1 + ROLES.index(r) if (r := (role or "").strip().lower()) in ROLES else NONE


def relabel_cost(role: int, new: int) -> float:
    return 0.0 if role == new else NAME if role == NONE else RELABEL


def turn_matrix(role: int) -> list[list[float]]:
    """Costs from each last role to each next one over one turn."""
    return [[STEPS[a, b][0] + relabel_cost(role, b) if (a, b) in STEPS else INFINITE for b in range(4)] for a in range(4)]


def end_cost(state: int) -> float:
    """A conversation ends with an assistant's turn; what lacks is inserted."""
    return {NONE: 0.0, ASSISTANT: 0.0, USER: INSERT, SYSTEM: 2 * INSERT}[state]


MATRICES = [turn_matrix(r) for r in range(4)]


def combined(x: list[list[float]], y: list[list[float]]) -> list[list[float]]:
    return [[min(x[a][k] + y[k][b] for k in range(4)) for b in range(4)] for a in range(4)]


def path(matrices: list[list[list[float]]], entry: int, exit_: int | None) -> tuple[list[int], float]:
    """The cheapest states after each matrix, from ``entry`` to ``exit_`` or, where that is None, to the cheapest end; and the cost."""
    costs = [[0.0 if s == entry else INFINITE for s in range(4)]]
    for m in matrices:
        costs.append([min(costs[-1][a] + m[a][b] for a in range(4)) for b in range(4)])
    if exit_ is None:
        exit_ = min(range(4), key=lambda s: (costs[-1][s] + end_cost(s), -s))
        cost = costs[-1][exit_] + end_cost(exit_)
    else:
        cost = costs[-1][exit_]
    states = [exit_]
    for m, before in zip(reversed(matrices), reversed(costs[:-1]), strict=True):
        states.append(min(range(4), key=lambda a: (before[a] + m[a][states[-1]], a)))  # noqa: B023
    return states[::-1][1:], cost


def escaped(text: str | None) -> str:
    return (text or "").replace("<|", "<\\|")


def repaired(turns: list[tuple], entry: int, exit_: int, last: bool) -> Iterator[tuple]:
    """(turn, role, new_role, action, text, rendered) of a block's turns and of those inserted."""
    roles = [role_number(t[1]) for t in turns]
    states, _ = path([MATRICES[r] for r in roles], entry, exit_)
    now = entry

    def opened(state: int, role: int) -> str:
        return ("" if state == NONE else "<|end|>\n") + f"<|{ROLES[role - 1]}|>\n"

    for (turn, role, text), number, new in zip(turns, roles, states, strict=True):
        _, missing = STEPS[now, new]
        if missing is not None:
            yield None, None, ROLES[missing - 1], "insert", "", opened(now, missing)
            now = missing
        merged = now == new
        action = ("merge" if merged else "keep") if number == new else "relabel and merge" if merged else "relabel"
        yield turn, role, ROLES[new - 1], action, text or "", ("\n" if merged else opened(now, new)) + escaped(text)
        now = new
    if last:
        while now in (SYSTEM, USER):
            yield None, None, ROLES[now], "insert", "", opened(now, now + 1)
            now += 1
        yield None, None, None, "end", "", "<|end|>\n"


def block_states(matrices: DataFrame, parts: int) -> DataFrame:
    """(conv_id, block, part, entry, exit, last, conv_cost) of every part of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), rows in grouped(batches, ["conv_id"]):
            flat = rows.column("m").to_pylist()
            states, cost = path([[m[4 * a : 4 * a + 4] for a in range(4)] for m in flat], NONE, None)
            n = len(flat)
            out = [pa.array([conv] * n, pa.int64()), *(rows.column(c).combine_chunks() for c in ("block", "part"))]
            out += [pa.array([NONE, *states[:-1]], pa.int32()), pa.array(states, pa.int32()), pa.array([False] * (n - 1) + [True]), pa.array([cost] * n)]
            yield pa.RecordBatch.from_arrays(out, names=["conv_id", "block", "part", "entry", "exit", "last", "conv_cost"])

    dealt = matrices.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block", "part")
    return dealt.mapInArrow(run, "conv_id long, block long, part long, entry int, exit int, last boolean, conv_cost double")


def block_matrices(turns: DataFrame, parts: int) -> DataFrame:
    """(conv_id, block, part, m: 16 costs) of every part of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list] = {}
        for (conv, block, part), rows in grouped(batches, KEY):
            roles = tuple(role_number(r) for r in rows.column("role").to_pylist())
            m = kept.get(roles)
            if m is None:
                m = MATRICES[roles[0]]
                for r in roles[1:]:
                    m = combined(m, MATRICES[r])
                if len(kept) < 4096:
                    kept[roles] = m
            at = [pa.array([x], pa.int64()) for x in (conv, block, part)]
            yield pa.RecordBatch.from_arrays([*at, pa.array([[x for line in m for x in line]], pa.list_(pa.float64()))], names=[*KEY, "m"])

    dealt = turns.select(*KEY, *ORDER).repartition(parts, *KEY).sortWithinPartitions(*KEY, *ORDER)
    return dealt.mapInArrow(run, "conv_id long, block long, part long, m array<double>")


#: A part of a block, and the order of its turns.
KEY = ["conv_id", "block", "part"]
ORDER = ["turn", "role", "o"]


def parted(turns: DataFrame) -> DataFrame:
    """``turns`` with ``part``: 0, but in blocks of more than 4 * BLOCK turns, which only repeated numbers make, the number of the run of BLOCK turns."""
    same = ["conv_id", "block"]
    full = turns.groupBy(*same).agg(F.count("*").alias("n")).filter(F.col("n") > 4 * BLOCK)
    total = full.agg(F.sum("n")).first()[0]
    if not total:
        return turns.withColumn("part", F.lit(0).cast("long"))
    marked = cut(on_group(turns, full, same, "left", F.col("r.n").alias("n")))
    many = marked.filter("n is not null").drop("n").withColumn("_u", F.monotonically_increasing_id())
    many = numbered(many, same, [*ORDER, "text", "_u"], total).withColumn("part", F.floor(F.col("_at") / BLOCK)).drop("_at", "_u")
    return marked.filter("n is null").drop("n").withColumn("part", F.lit(0).cast("long")).unionByName(many)


def repair(df: DataFrame) -> DataFrame:
    """Repaired turns of ``df`` (conv_id, turn, role, text), by (conv_id, block, at); see RESULT."""
    parts = shuffle_partitions(df.sparkSession)
    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = parted(turns.withColumns({"block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))), "o": F.xxhash64("text")}))
    states = block_states(block_matrices(turns, parts), parts)
    both = turns.alias("t").join(states.alias("s"), F.col("t.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("t.block") == F.col("s.block")) & (F.col("t.part") == F.col("s.part")))
    state = ["entry", "exit", "last", "conv_cost"]
    # a broadcast of the states leaves turns where they were read, so a part's turns are brought together here
    rows = both.select("t.*", *(f"s.{c}" for c in state)).repartition(parts, *KEY).sortWithinPartitions(*KEY, *ORDER, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for (conv, block, part, entry, exit_, last, cost), found in grouped(batches, [*KEY, *state]):
            given = list(zip(*(found.column(c).to_pylist() for c in ("turn", "role", "text")), strict=True))
            # parts make fewer turns than this
            first = part * 4 * BLOCK
            held += [(conv, block, first + i, *row, cost) for i, row in enumerate(repaired(given, entry, exit_, last))]
            if len(held) >= 2048:
                yield made(held)
                held = []
        if held:
            yield made(held)

    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.float64()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, RESULT)


def conversations(repaired_turns: DataFrame) -> DataFrame:
    """(conv_id, rendered): whole conversations, for those that fit a row."""
    pieces = F.array_sort(F.collect_list(F.struct("block", "at", "rendered")))
    return repaired_turns.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda p: p["rendered"]), "").alias("rendered"))
