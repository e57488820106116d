"""Transclusion: include directives of AsciiDoc files are replaced by what they name, by joins of (file, target), a round a level of nesting.

A directive stands alone on a line, in a listing as well as outside of one. Files that end in ``.adoc`` are pages of their own and are left to the reader of the blocks; all
others are put in place. Only files with such directives are taken apart: into the texts between directives and the directives, numbered by their place, an
array of numbers that a nested piece goes on with. A directive is joined with the file at its target, as seen from the folder of the file that the directive stands in, its text is cut by
``lines`` or ``tag``, indented, and searched for directives itself. The names of the files above a piece travel with it, so a file that would
include itself is told of and not expanded. Where nothing is found, a line says so, unless the directive is optional.

Defined results: a null content is empty; a path that occurs twice counts once, with its least content; a directive behind a backslash is text; pieces nest up to ``DEPTH`` levels, deeper ones are told of as
unresolved; files of an empty table give no rows; other columns are kept.
"""

from __future__ import annotations

import re
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.columns import normal_path
from docspark.operators.lines import let
from docspark.shared import cut

DEPTH = 64
# The directive of a file that is no page, with the end of its line, and the marks of a tagged region.
DIRECTIVE = r"(?dm)^include::(?![^\[\n]*\.[aA][dD][oO][cC]\[)[^\[\n]*[^\s\[]\[[^\n]*\][ \t]*(?:\n|\z)"
TAG = re.compile(r"\b(tag|end)::([^\s\[\]]+)\[\](?=\s|$)")


def attributes_of(text: str) -> dict[str, str]:
    """Named values of a directive's brackets; a value in quotes may hold commas."""
    return {k: q or v.strip() for k, q, v in re.findall(r'([\w-]+)\s*=\s*(?:"([^"]*)"|([^,"]*))', text)}


def chosen_lines(lines: list[str], ranges: str) -> list[str]:
    """By numbers from 1: ``3``, ``2..5``, ``7..`` and ``7..-1`` to the end, parted by commas or semicolons."""
    kept: set[int] = set()
    for part in re.split("[,;]", ranges):
        if m := re.fullmatch(r"\s*(\d+)\s*(?:(\.\.)\s*(-?\d*)\s*)?", part):
            first, last = int(m.group(1)), m.group(3) if m.group(2) else m.group(1)
            end = len(lines) if last in ("", "-1") else int(last)
            kept.update(range(first, min(end, len(lines)) + 1))
    return [x for i, x in enumerate(lines, 1) if i in kept]


def tagged_lines(lines: list[str], tags: list[str]) -> list[str]:
    """The lines of tagged regions: by name, ``*`` for all regions, ``**`` for all lines, with ``!`` before what is left out."""
    wanted = {t.lstrip("!"): not t.startswith("!") for t in tags}
    everything = wanted.pop("**", None)
    regions = wanted.pop("*", None)
    # where only regions are left out, the rest is in
    base = everything if everything is not None else not any(wanted.values()) and not regions and bool(wanted or regions is False)
    out, open_, now = [], [], base
    for line in lines:
        if m := TAG.search(line):
            if m.group(1) == "tag":
                open_.append((m.group(2), now))
                now = wanted.get(m.group(2), now if regions is None else regions)
            elif open_ and m.group(2) in [x for x, _ in open_]:
                while open_:
                    name, now = open_.pop()
                    if name == m.group(2):
                        break
        elif now:
            out.append(line)
    return out


def included(content: str, given: str) -> str:
    """What stands for a directive: the chosen lines of a file, each with its end."""
    named = attributes_of(given)
    lines = re.split(r"\r\n|\r|\n", content)
    if lines[-1] == "":
        lines.pop()
    if "lines" in named:
        lines = chosen_lines(lines, named["lines"])
    elif tags := named.get("tags", named.get("tag")):
        lines = tagged_lines(lines, [t.strip() for t in re.split("[,;]", tags) if t.strip()])
    if named.get("indent", "").isdigit():
        margin = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
        lines = [" " * int(named["indent"]) + x[margin:] if x.strip() else "" for x in lines]
    if re.fullmatch(r"[+-]?\d+", shift := named.get("leveloffset", "")):
        level = lambda m: "=" * max(1, len(m.group(1)) + int(shift)) + m.group(2)
        lines = [re.sub(r"^(={1,6})(\s+\S.*)$", level, x) for x in lines]
    return "".join(x + "\n" for x in lines)


def included_texts(content: pd.Series, given: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else included(c, g) for c, g in zip(content, given, strict=True)], dtype=object)


def pieces(text: Column) -> Column:
    """Array of (text, directive): a text and the directive behind it; the last has none."""
    found = F.regexp_extract_all(text, F.lit(DIRECTIVE), F.lit(0))
    return F.zip_with(F.split(text, DIRECTIVE, -1), found, lambda t, d: F.struct(F.coalesce(t, F.lit("")).alias("text"), d.alias("directive")))


def named_attributes(text: Column) -> Column:
    """A map of a file's attribute entries; of several of one name the last counts."""
    entries = F.regexp_extract_all(text, F.lit(r"(?dm)^:[\w-]+:[ \t]+[^\n]*$"), F.lit(0))
    pair = lambda e: F.struct(F.regexp_extract(e, r"^:([\w-]+):", 1).alias("k"), F.regexp_replace(e, r"^:[\w-]+:[ \t]+|[ \t\r]+$", "").alias("v"))
    last = lambda pairs: F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(let(F.transform(entries, pair), last))


def with_attributes(text: Column, known: Column) -> Column:
    """``text`` with references to attributes replaced by their values; unknown ones stay."""
    return F.aggregate(F.map_entries(known), text, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def expanded(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``files`` with the directives in ``content`` replaced by what they name."""
    rest, new = parted(files, path, content)
    return rest.unionByName(new)


def parted(files: DataFrame, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """``files`` that hold no directives, as they are, and those that do, with what these name in their place.

    Of the files that are included only those that may be asked for take part in the joins, and the text of a round that is the last is not written.
    """
    text = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), "\r\n?", "\n")
    has = F.coalesce(F.col(content), F.lit("")).rlike(r"(?m)^include::")
    page = F.lower("target").endswith(".adoc")
    source = files.select(normal_path(F.lit(""), path).alias("target"), F.coalesce(F.col(content), F.lit("")).alias("found"))
    # what may hold directives of its own, wherever in a line: an indent may be taken away
    deep = source.filter(F.contains("found", F.lit("include::"))).select("target").distinct()
    work = files.filter(has).select(F.col(path).alias("root"), text.alias("text")).distinct()
    now = work.groupBy("root").agg(F.min("text").alias("text")).withColumn("known", named_attributes(F.col("text")))
    now = now.select("root", F.array().cast("array<int>").alias("at"), F.array(normal_path(F.lit(""), "root")).alias("chain"), "known", "text")
    included_text = F.pandas_udf(included_texts, T.StringType())
    done: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        parts = now.select("root", "at", "chain", "known", F.posexplode(pieces(F.col("text"))).alias("n", "p"))
        parts = cut(parts.select("root", F.concat("at", F.array("n")).alias("at"), "chain", "known", "p.text", "p.directive"))
        done.append(parts.select("root", "at", "text"))
        asked = parts.filter("directive is not null")
        folder = F.regexp_extract(F.element_at("chain", -1), "^(.*)/[^/]*$", 1)
        name = with_attributes(F.regexp_extract("directive", r"^include::([^\[]*)\[", 1), F.col("known"))
        given = F.regexp_extract("directive", r"\[(.*)\][ \t]*\n?$", 1)
        asked = asked.select("root", "at", "chain", "known", "directive", normal_path(folder, name).alias("target"), given.alias("given"), name.alias("name"))
        told_of = asked.agg(F.count("*").alias("n"), F.bool_or(page).alias("pages")).first()
        if not told_of.n:
            break
        # only an attribute may name a page
        sources = (source if told_of.pages else source.filter(~page)).groupBy("target").agg(F.min("found").alias("found"))
        circle = F.array_contains("chain", F.col("target")) | F.lit(depth == DEPTH)
        both = asked.join(sources, "target", "left").withColumn("found", F.when(~circle, F.col("found")))
        told = F.when(F.col("given").rlike(r"\bopt(s|ions)\s*=\s*\"?[^,\"]*\boptional\b"), "").otherwise(
            F.concat(F.lit("Unresolved directive in "), F.element_at("chain", -1), F.lit(" - "), F.regexp_replace("directive", r"[ \t]*\n?$", ""), F.lit("\n"))
        )
        # a piece's text comes in front of what its directive stands for
        below = F.concat("at", F.array(F.lit(0))).alias("at")
        lines = included_text(F.regexp_replace("found", "\r\n?", "\n"), "given")
        if asked.join(deep, "target", "left_semi").isEmpty():
            done.append(both.select("root", below, told.alias("_told"), lines.alias("_lines")).select("root", "at", F.coalesce("_lines", "_told").alias("text")))
            break
        done.append(both.filter("found is null").select("root", below, told.alias("text")))
        now = both.filter("found is not null").select("root", "at", F.concat("chain", F.array("target")).alias("chain"), "known", lines.alias("text"))
    pieces_of = done[0]
    for more in done[1:]:
        pieces_of = pieces_of.unionByName(more)
    whole = pieces_of.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
    whole = whole.select(F.col("root").alias("_root"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("_whole"))
    new = files.filter(has).join(whole, F.col(path) == F.col("_root"), "left")
    new = new.select(*(F.coalesce("_whole", F.col(content)).alias(c) if c == content else F.col(c) for c in files.columns))
    return files.filter(~has), new
