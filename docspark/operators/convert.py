"""Conversion of page tables: one narrow Arrow stage a document, no shuffle. Trees stay inside it and leave as text or flat rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.shared import dealt

from . import blocks, dom, writers

BLOCK = "node_id int, parent_id int, ord int, depth int, kind string, level int, text string"
LINK = "ord int, kind string, key string, space string"
CELL = "table_no int, row_no int, cell_no int, colspan int, rowspan int, header boolean, rich boolean, text string"


def _mapped(df: DataFrame, html: str, fields: T.StructType, make, given: tuple[str, ...] = (), deal: bool = True) -> DataFrame:
    """``df`` without ``html`` and ``given``, with ``fields`` that ``make(markup, *values of given)`` gives for each row: any number of rows.

    Rows are dealt over all cores where the caller has not dealt them, and taken in slices of 256. Of equal pages in a slice one is made, unless rows bring values of their own along.
    """
    keep = [c for c in df.columns if c not in (html, *given) and c not in fields.names]
    kinds = T.StructType([*(df.schema[c] for c in keep), *fields])
    arrow = [T_to_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, which, once = [], [], make if given else cache(make)
                for i, values in enumerate(zip(*(part.column(c).to_pylist() for c in (html, *given)), strict=True)):
                    made = once(*values)
                    rows += made
                    which += [i] * len(made)
                take = pa.array(which, type=pa.int32())
                columns = [pa.array(list(x), type=k) for x, k in zip(zip(*rows, strict=True), arrow, strict=True)] if rows else [pa.array([], type=k) for k in arrow]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in keep), *columns], names=[*keep, *fields.names])

    return (dealt(df) if deal else df).mapInArrow(run, kinds)


def T_to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def to_text(
    df: DataFrame, html: str = "html", form: str = "md", options: blocks.Options | None = None, images: str | None = None, links: str | None = None, children: str | None = None, deal: bool = True
) -> DataFrame:
    """Adds ``title`` (of the head, or null) and ``text``, the body in AsciiDoc or Markdown; and ``files`` (path, content) where options set some aside.

    ``links`` names a column of the page's resolved links, an array of (kind, key, space, title, url), and ``children`` one of (title, url); a row brings its own
    along and both are left out of the result. ``deal`` is False where the rows are dealt already.
    """
    options, show = options or blocks.Options(), writers.writer(form, images)

    def make(markup: str | None, *values) -> list[tuple]:
        own = dict(zip(given, values, strict=True))
        mine = options
        if given:
            known = {(x["kind"], x["key"], x["space"]): (x["title"], x["url"]) for x in own.get(links) or ()}
            mine = replace(options, links={**options.links, **known}, children=tuple((x["title"], x["url"]) for x in own.get(children) or ()) or options.children)
        root = dom.parse(markup)
        title = root.first("title")
        state = blocks.State(mine)
        text = show(blocks.build(dom.body(root), state))
        row = (title.text() if title else None, text)
        return [row if options.in_memory else (*row, [{"path": p, "content": c} for p, c in state.files])]

    given = tuple(c for c in (links, children) if c)
    files = "" if options.in_memory else ", files array<struct<path:string,content:string>>"
    return _mapped(df, html, T.StructType.fromDDL(f"title string, text string{files}"), make, given, deal)


def to_texts(df: DataFrame, html: str = "html", forms: dict[str, str | None] | None = None, options: blocks.Options | None = None, deal: bool = True) -> DataFrame:
    """Adds a column for each of ``forms``, named like the form; the values are folders of images, or None. A page is parsed once for all of them.

    ``deal`` is False where the rows are dealt already, as by a caller that makes wide markup of narrow rows.
    """
    options, forms = options or blocks.Options(), forms or {"adoc": None, "md": "attache"}
    shows = [writers.writer(f, images) for f, images in forms.items()]

    def make(markup: str | None) -> list[tuple]:
        tree = blocks.build(dom.body(dom.parse(markup)), blocks.State(options))
        return [tuple(show(tree) for show in shows)]

    return _mapped(df, html, T.StructType.fromDDL(", ".join(f"`{f}` string" for f in forms)), make, (), deal)


def files_of(df: DataFrame, html: str = "html", options: blocks.Options | None = None) -> DataFrame:
    """One row per file that long code blocks are written to: ``path``, ``content``."""
    options = options or blocks.Options(in_memory=False)

    def make(markup: str | None) -> list[tuple]:
        return blocks.convert(markup, options)[1].files

    return _mapped(df, html, T.StructType.fromDDL("path string, content string"), make)


def block_tuples(markup: str | None, options: blocks.Options, show: writers.Writer) -> list[tuple]:
    out: list[tuple] = []

    def add(nodes: list, parent: int, depth: int) -> None:
        for i, n in enumerate(nodes):
            me = len(out)
            text = n.text or (show.run(n.kids) if n.kind in ("paragraph", "heading") else "")
            out.append((me, parent, i, depth, n.kind, n.a.get("level"), text))
            if n.kind in ("container", "admonition", "sidebar", "table", "row", "list"):
                add(n.kids, me, depth + 1)
            elif n.kind == "item":
                out[me] = (*out[me][:-1], show.run(n.kids))
                add(n.a["below"], me, depth + 1)
            elif n.kind == "cell":
                if n.a["rich"]:
                    add(n.kids, me, depth + 1)
                else:
                    out[me] = (*out[me][:-1], show.run(n.kids))

    add(blocks.convert(markup, options)[0], -1, 0)
    return out


def block_rows(df: DataFrame, html: str = "html", options: blocks.Options | None = None) -> DataFrame:
    """The block tree as rows in document order: node_id, parent_id (-1 on top), ord among siblings, depth, kind, level, text."""
    options, show = options or blocks.Options(), writers.Markdown()
    return _mapped(df, html, T.StructType.fromDDL(BLOCK), lambda markup: block_tuples(markup, options, show))


def link_tuples(markup: str | None, diagrams: bool = False) -> list[tuple]:
    return [(i, *key) for i, key in enumerate(blocks.links_of(dom.parse(markup), diagrams))]


def link_rows(df: DataFrame, html: str = "html", diagrams: bool = False, deal: bool = True) -> DataFrame:
    """One row per distinct link key of a page; with ``diagrams`` also one per diagram, of that kind. Pages without the tags that links and diagrams are made of are neither moved nor parsed.

    ``deal`` is False where the rows are dealt already.
    """
    some = df.filter(F.col(html).rlike(rf"(?iu)<(?:ac:link|ri:user{'|ac:structured-macro' if diagrams else ''})"))
    return _mapped(some, html, T.StructType.fromDDL(LINK), lambda markup: link_tuples(markup, diagrams), (), deal)


def cell_tuples(markup: str | None, show: writers.Writer) -> list[tuple]:
    found: list[tuple] = []

    def visit(nodes: list) -> None:
        for n in nodes:
            if n.kind == "table":
                t = len({x[0] for x in found})
                for r, row in enumerate(n.kids):
                    for c, cell in enumerate(row.kids):
                        head = cell.a["header"] or r < n.a["leading"]
                        text = show(cell.kids) if cell.a["rich"] else show.run(cell.kids)
                        found.append((t, r, c, cell.a["colspan"], cell.a["rowspan"], head, cell.a["rich"], text))
            elif n.kind in ("container", "admonition", "sidebar"):
                visit(n.kids)
            elif n.kind == "list":
                for item in n.kids:
                    visit(item.a["below"])

    visit(blocks.convert(markup)[0])
    return found


def cell_rows(df: DataFrame, html: str = "html") -> DataFrame:
    """One row per table cell: table, row and cell numbers, spans, header, text."""
    show = writers.Markdown()
    return _mapped(df, html, T.StructType.fromDDL(CELL), lambda markup: cell_tuples(markup, show))
