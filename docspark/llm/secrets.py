"""Secret scans: assignments, access keys, hexadecimal runs, and strings of high entropy. DataFrame functions only.

The method: candidates are whole runs of 20 or more token characters. Each belongs to the narrowest of the character classes hex,
alphanumeric and base64; a window of 20 characters slides over it, and the window's Shannon entropy is kept up to date from
the counts of its characters as one enters and one leaves. A candidate whose highest window entropy reaches its class's
threshold is a secret, unless the allow-list knows it. Matches of the plain patterns are taken out first, and what is left of a run is a candidate of its own.

Defined results: a null or empty text has no spans; texts and runs of any length are read whole; repeated rows get the same spans; all other columns are kept, and one
named like the output column is replaced by it; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

KINDS = ("assign", "access", "hex", "entropy")
BASE = 3

# The patterns of the plain kinds.
KEYWORDS = r"(?:password|passwd|secret|token|api_?key)"
ASSIGN = rf"(?i:{KEYWORDS})[\"']?\x20*+[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]++"
ASSIGN_VALUE = rf"^(?i:{KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

WINDOW = 20
# Each class's characters and the bits a window of them must reach.
CLASSES = {"hex": ("0-9a-f", 3.0), "alphanumeric": ("0-9A-Za-z", 3.6), "base64": ("0-9A-Za-z+/_=-", 3.7)}
#: The characters of candidates.
ALPHABET = string.digits + string.ascii_letters + "+/_=-"
# Candidates that are not secrets.
ALLOWED = (
    r"^(?!.*[A-Z][a-z][A-Z])[A-Za-z_=/+-]+$",  # words; most random letters of both cases have one small letter between capitals
    r"^[0-9_=/+-]+$",  # numbers
    r"(?i)example|placeholder|sample|dummy|x{6,}",
    r"(?i)0123456789|abcdefghij|qwerty",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any ``window`` characters in a row of ``ALPHABET``; null for shorter values.

    With counts c of a window's characters the entropy is log2(window) - sum(c * log2(c)) / window. The counts are kept: a step takes one character
    from them and adds one, and the sum changes by one term for each, so a step costs the same in a value of any length.
    """
    weight = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))
    term = lambda n: F.element_at(weight, n + 1) - F.element_at(weight, n)  # noqa: E731  # of the n-th of a character

    def over(codes: Column) -> Column:
        def move(acc: Column, i: Column) -> Column:
            new = F.element_at(codes, i)
            gone = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(0)
            counts = F.transform(acc["counts"], lambda c, at: c + (at + 1 == new).cast("int") - (at + 1 == gone).cast("int"))
            left = F.when(gone > 0, term(F.element_at(acc["counts"], F.greatest(gone, F.lit(1))))).otherwise(0.0)
            added = term(F.element_at(acc["counts"], new) - (gone == new).cast("int") + 1)
            total = acc["sum"] - left + added
            return spans.let(total, lambda s: F.struct(counts.alias("counts"), s.alias("sum"), F.when(i >= window, F.least(acc["best"], s)).otherwise(acc["best"]).alias("best")))

        first = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), first, move, lambda acc: acc["best"])

    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.when(F.length(value) >= window, math.log2(window) - spans.let(codes, over) / window)


def secret_like(value: Column) -> Column:
    """Whether a candidate's entropy reaches the threshold of its class and no allow-list pattern holds."""
    need = F.lit(CLASSES["base64"][1])
    for name in ("alphanumeric", "hex"):
        need = F.when(value.rlike(f"^[{CLASSES[name][0]}]+$"), CLASSES[name][1]).otherwise(need)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    return F.when(allowed, False).otherwise(window_entropy(value) >= need)


def base_spans(text: Column) -> Column:
    value = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN_VALUE, 1)) >= 6
    assign = F.when(text.rlike(f"(?i){KEYWORDS}"), F.filter(spans.find(text, ASSIGN, 0), value)).otherwise(spans.none())
    access = F.when(F.contains(text, F.lit("AKIA")), spans.find(text, ACCESS, 1)).otherwise(spans.none())
    hexes = F.when(text.rlike(HEX), spans.find(text, HEX, 2)).otherwise(spans.none())
    return spans.ordered(assign, access, hexes)


def entropy_spans(text: Column, base: Column) -> Column:
    """Secrets by entropy in what the plain spans leave of a text; a run that a plain span cuts is what stands on either side of it."""
    free = spans.masked(text, base, " ")
    return F.when(text.rlike(CANDIDATE), spans.let(free, lambda t: F.filter(spans.find(t, CANDIDATE, BASE), lambda s: secret_like(s["match"])))).otherwise(spans.none())


def scan(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``df`` with ``out``: a struct of ``base`` and ``all``, the spans (start, kind, end, match) by start, kinds as in KINDS."""
    value = F.coalesce(F.col(text), F.lit(""))
    found = spans.let(
        base_spans(value),
        lambda base: spans.let(entropy_spans(value, base), lambda more: F.struct(base.alias("base"), spans.ordered(base, more).alias("all"))),
    )
    return df.withColumn(out, found)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every secret in ``text`` replaced by its kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    # the row travels as one column, so that no name of its own can clash
    rows = scan(df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("_text")), "_text", "_found")
    found = F.col("_found.all")
    new = F.when(F.size(found) == 0, F.col("_text")).otherwise(spans.replaced(F.col("_text"), found, lambda s: F.element_at(names, s["kind"] + 1)))
    return rows.select(*((new if c == text else F.col("_row")[c]).alias(c) for c in df.columns))
