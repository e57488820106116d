"""Table functions for SQL: the blocks, links and table cells of a page's markup, for a lateral join.

``register`` makes them known to a session: ``SELECT page_id, b.* FROM pages, LATERAL blocks(html) b``. Each says in ``analyze`` what columns its arguments ask for: ``blocks(html, 'adoc')`` has its text as
AsciiDoc, ``blocks(html, NULL)`` has no text column, and ``links(html, TRUE)`` also has diagrams. A null markup has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from docspark.operators import blocks, convert, writers


def schema(ddl: str, without: tuple[str, ...] = ()) -> T.StructType:
    kinds = {"int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", ")) if n not in without])


def constant(argument: AnalyzeArgument | None, default, what: str):
    """An argument that decides on the columns and so must be the same for all rows."""
    if argument is None:
        return default
    if not argument.isConstantExpression:
        raise ValueError(f"{what} must be a constant")
    return argument.value


def check_markup(argument: AnalyzeArgument) -> None:
    if not isinstance(argument.dataType, (T.StringType, T.NullType)):
        raise ValueError("markup must be a string")


class Blocks:
    @staticmethod
    def analyze(markup: AnalyzeArgument, form: AnalyzeArgument | None = None) -> AnalyzeResult:
        check_markup(markup)
        name = constant(form, "md", "the form")
        if name not in (None, "md", "adoc"):
            raise ValueError(f"unknown form {name}")
        return AnalyzeResult(schema(convert.BLOCK, () if name else ("text",)))

    def __init__(self):
        self.options = blocks.Options()
        self.shows = {"md": writers.Markdown(), "adoc": writers.AsciiDoc()}

    def eval(self, markup: str, form: str | None = "md") -> Iterator[tuple]:
        if markup is not None:
            rows = convert.block_tuples(markup, self.options, self.shows[form or "md"])
            yield from rows if form else (r[:-1] for r in rows)


class Links:
    @staticmethod
    def analyze(markup: AnalyzeArgument, diagrams: AnalyzeArgument | None = None) -> AnalyzeResult:
        check_markup(markup)
        constant(diagrams, False, "whether there are diagrams")
        return AnalyzeResult(schema(convert.LINK))

    def eval(self, markup: str, diagrams: bool = False) -> Iterator[tuple]:
        if markup is not None:
            yield from convert.link_tuples(markup, bool(diagrams))


class Cells:
    @staticmethod
    def analyze(markup: AnalyzeArgument) -> AnalyzeResult:
        check_markup(markup)
        return AnalyzeResult(schema(convert.CELL))

    def __init__(self):
        self.show = writers.Markdown()

    def eval(self, markup: str) -> Iterator[tuple]:
        if markup is not None:
            yield from convert.cell_tuples(markup, self.show)


def register(spark: SparkSession) -> None:
    for name, made in (("blocks", Blocks), ("links", Links), ("cells", Cells)):
        spark.udtf.register(name, F.udtf(made))
