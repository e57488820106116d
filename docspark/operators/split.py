"""Cutting a long document into files at its top headings. One ``split`` a row; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.columns import newlines

from .lines import marked

LONG = 700


def is_long(text: Column | str, lines: int = LONG) -> Column:
    return newlines(text) >= lines


def sections(df: DataFrame, text: str = "text", form: str = "adoc", images: str = "attache", fences: bool = False, whole: Column | None = None) -> DataFrame:
    """``df`` without ``text``, a row per part: part (0: the root), title, file, content.

    A part begins at a line with ``== `` (AsciiDoc) or ``## `` (Markdown), in code fences too unless ``fences`` says that these are to be seen. The root keeps what is before the first
    one and a reference to each part. A null text gives no rows. A row where ``whole`` is true stays as it is, as a root.
    """
    mark, extension = ("== ", "adoc") if form == "adoc" else ("## ", "md")
    body = F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"\n\z", "")
    if fences:
        body = marked(body, mark)
    # a text that begins with a heading has an empty part before it
    pieces = F.split(F.when(body.startswith(mark), F.concat(F.lit("\n"), body)).otherwise(body), rf"\n(?={mark})")
    if fences:
        pieces = F.transform(pieces, lambda x: F.replace(x, F.lit("\x00"), F.lit("")))
    if whole is not None:
        pieces = F.when(whole, F.array(text)).otherwise(pieces)
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, pieces.alias("_pieces")).select(*keep, "_pieces", F.posexplode("_pieces").alias("part", "_own"))
    titled = lambda x: F.substring(F.regexp_extract(x, r"\A([^\n]*)", 1), len(mark) + 1, 1 << 30)
    named = lambda n, t: F.concat(n.cast("string"), F.lit("_"), t, F.lit(f".{extension}"))

    def reference(piece: Column, i: Column) -> Column:
        file = named(i + 1, titled(piece))
        link = F.concat(F.lit("include::"), file, F.lit("[]")) if form == "adoc" else F.concat(F.lit("- ["), titled(piece), F.lit("]("), file, F.lit(")"))
        return F.concat(F.lit("\n"), link)

    links = F.transform(F.slice("_pieces", F.lit(2), F.size("_pieces")), reference)
    preface = F.when(F.length("_own") > 0, F.array("_own")).otherwise(F.array().cast("array<string>"))
    root = F.array_join(F.concat(preface, links), "\n")
    part = F.concat(F.lit(f":imagesdir: ./{images}\n"), F.col("_own")) if form == "adoc" else F.col("_own")
    is_root = F.col("part") == 0
    title = F.when(~is_root, titled(F.col("_own")))
    file = F.when(is_root, f"index.{extension}").otherwise(named(F.col("part"), title))
    return rows.select(*keep, "part", title.alias("title"), file.alias("file"), F.when(is_root, root).otherwise(part).alias("content"))
