"""Scalar functions on columns: names, escapes, attributes, URLs, colours. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pure import ALIASES, LANGUAGES, PALETTE

# Fixed value: the header attribute that ties a document to its page.
ID_ATTRIBUTE = ":confluency-id:"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


# ---- names and titles ----


def safe_folder(title: Column | str) -> Column:
    trimmed = F.regexp_replace(F.coalesce(_c(title), F.lit("")), r"^\s+|\s+$", "")
    name = F.regexp_replace(F.regexp_replace(trimmed, r'[<>:"/\\|?*\x00-\x1F]', "_"), "[. ]+$", "")
    return F.when(F.trim(name) == "", "page").otherwise(name)


def plain_title(title: Column | str) -> Column:
    """Without tags, entities and constrained inline marks."""
    text = F.regexp_replace(F.coalesce(_c(title), F.lit("")), "<[^>]+>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#8217;", "’"), ("&#8230;", "…"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"(?U)(?<!\p{Alnum})([`*_#~^])(?=\S)(.+?)(?<=\S)\1(?!\p{Alnum})", "$2"))


def file_title(content: Column | str, path: Column | str) -> Column:
    """The first heading's plain text, else the file's name without its extension."""
    heading = F.regexp_extract(_c(content), r"(?m)^=+\s+(.+?)\s*$", 1)
    name = F.element_at(F.split(_c(path), "/"), -1)
    stem = F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")
    return F.when(heading != "", plain_title(heading)).otherwise(stem)


def output_format(name: Column | str) -> Column:
    return F.when(F.lower(F.trim(_c(name))).isin("md", "markdown"), "md").otherwise("adoc")


# ---- escapes ----


def html_escape(text: Column | str) -> Column:
    out = _c(text)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def storage_text(text: Column | str) -> Column:
    return html_escape(F.coalesce(_c(text), F.lit("")))


def storage_attribute(text: Column | str) -> Column:
    return F.replace(storage_text(text), F.lit('"'), F.lit("&quot;"))


def xml_paragraph(text: Column | str) -> Column:
    return F.concat(F.lit("<p>"), storage_text(text), F.lit("</p>"))


def cdata(text: Column | str) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(_c(text), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def markdown_escape(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"([\\`*_\[\]<])", r"\\$1")


def adoc_cell(text: Column | str, mark: str = "|") -> Column:
    return F.replace(_c(text), F.lit(mark), F.lit("\\" + mark))


def markdown_cell(text: Column | str) -> Column:
    return F.replace(F.replace(_c(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def quote_lines(text: Column | str) -> Column:
    return F.array_join(F.transform(F.split(_c(text), "\n"), lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")


def indent_lines(text: Column | str, indent: str) -> Column:
    return F.array_join(F.transform(F.split(_c(text), "\n"), lambda x: F.when(x == "", x).otherwise(F.concat(F.lit(indent), x))), "\n")


def emphasis(mark: str, text: Column | str) -> Column:
    """White space at the edges stays outside the marks; blank text is left as it is."""
    blank = r"[\s ​﻿]"
    return F.regexp_replace(_c(text), rf"(?s)^({blank}*)({blank[:1]}^{blank[1:]}(?:.*{blank[:1]}^{blank[1:]})?)({blank}*)$", rf"$1{_literal(mark)}$2{_literal(mark)}$3")


def _literal(mark: str) -> str:
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def image_path(target: Column | str, folder: str | None) -> Column:
    target = _c(target)
    if not folder or not folder.strip():
        return target
    return F.when(target.rlike("[/:]"), target).otherwise(F.concat(F.lit(f"{folder}/"), target))


# ---- attributes of documents ----


def parse_keywords(text: Column | str) -> Column:
    parts = F.transform(F.split(F.coalesce(_c(text), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def insert_id(content: Column | str, page_id: Column | str) -> Column:
    """The id attribute after the first title line, else on top."""
    lines = F.split(_c(content), "\n")
    at = F.array_position(F.transform(lines, lambda x: x.startswith("= ")), True)
    return F.array_join(F.array_insert(lines, at.cast("int") + 1, F.concat(F.lit(f"{ID_ATTRIBUTE} "), _c(page_id))), "\n")


def replace_id(content: Column | str, page_id: Column | str) -> Column:
    """The first id attribute with a new value; inserted where there is none."""
    lines = F.split(_c(content), "\n")
    at = F.array_position(F.transform(lines, lambda x: x.startswith(ID_ATTRIBUTE)), True)
    new = F.concat(F.lit(f"{ID_ATTRIBUTE} "), _c(page_id))
    return F.when(at > 0, F.array_join(F.transform(lines, lambda x, i: F.when(i + 1 == at, new).otherwise(x)), "\n")).otherwise(insert_id(content, page_id))


def content_hash(text: Column | str) -> Column:
    return F.sha2(_c(text), 256)


def attachment_key(name: Column | str) -> Column:
    return F.concat(F.sha2(_c(name), 256), F.lit("-attachment-hash"))


def newlines(text: Column | str) -> Column:
    return F.length(_c(text)) - F.length(F.replace(_c(text), F.lit("\n"), F.lit("")))


def header(title: Column, attributes: dict[str, Column], labels: Column, body: Column, form: str, images: str = "attache") -> Column:
    """A document's header and body: AsciiDoc attributes or YAML front matter; blank values are left out."""
    line = ":{}: " if form == "adoc" else "{}: "
    parts = [F.when(F.trim(v) != "", F.concat(F.lit(line.format(k)), v, F.lit("\n"))) for k, v in attributes.items()]
    attrs = F.concat_ws("", *parts)
    if form == "adoc":
        words = F.when(F.size(labels) > 0, F.concat(F.lit(":keywords: "), F.array_join(labels, ", "), F.lit("\n"))).otherwise("")
        return F.concat(F.lit("= "), title, F.lit("\n"), attrs, words, F.lit(f":toc: macro\n:imagesdir: ./{images}\n\n"), body, F.lit("\n"))
    tags = F.when(F.size(labels) > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform(labels, lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), ""))).otherwise("")
    front = F.concat(attrs, tags)
    return F.concat(F.when(front == "", "").otherwise(F.concat(F.lit("---\n"), front, F.lit("---\n\n"))), F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n"))


# ---- code, admonitions, colours ----


def code_language(name: Column | str) -> Column:
    lower = F.lower(_c(name))
    mapped = F.coalesce(F.element_at(_map(ALIASES), lower), lower)
    return F.when(mapped.isin(*LANGUAGES), mapped)


def infer_language(language: Column | str, text: Column | str) -> Column:
    text = _c(text)
    return F.coalesce(_c(language), F.when(text.startswith("{"), "json").when(text.startswith("<"), "xml"))


def spec_language(text: Column | str) -> Column:
    return F.when(_c(text).startswith("{"), "json").otherwise("yaml")


def admonition_of_macro(name: Column | str) -> Column:
    return F.when(_c(name) == "warning", "WARNING").when(_c(name) == "tip", "TIP").otherwise("NOTE")


def macro_of_admonition(name: Column | str) -> Column:
    lower = F.lower(_c(name))
    return F.when(lower == "tip", "tip").when(lower.isin("caution", "warning"), "note").when(lower == "important", "warning").otherwise("info")


def alert_of_admonition(name: Column | str) -> Column:
    upper = F.upper(_c(name))
    return F.when(upper.isin("TIP", "WARNING", "CAUTION", "IMPORTANT"), upper).otherwise("NOTE")


def nearest_colour(r: Column, g: Column, b: Column) -> Column:
    """The palette's name nearest by squared distance; ties go by name."""
    palette = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(x).alias("r"), F.lit(y).alias("g"), F.lit(z).alias("b")) for n, (x, y, z) in PALETTE.items()))
    square = lambda x: x * x
    far = F.transform(palette, lambda p: F.struct((square(r - p["r"]) + square(g - p["g"]) + square(b - p["b"])).alias("d"), p["name"].alias("name")))
    return F.array_min(far)["name"]


def style_colour(style: Column | str) -> Column:
    """The palette's name of a ``color:`` style part; none for black."""
    value = F.trim(F.regexp_replace(F.trim(_c(style)), "^color:", ""))
    part = lambda i: F.regexp_extract(value, r"^rgb\((\d{1,3}),(\d{1,3}),(\d{1,3})\)$", i)
    rgb = [F.when(part(i) != "", part(i).cast("int")) for i in (1, 2, 3)]
    near = F.when(F.greatest(*rgb) <= 255, nearest_colour(*rgb))
    name = F.when(value.startswith("rgb("), near).otherwise(F.lower(value))
    return F.when(name.isin(*(n for n in PALETTE if n != "black")), name)


def colour_parts(df: DataFrame, html: str) -> DataFrame:
    """(part) of the ``color`` parts of all elements' styles, each once."""
    styles = F.regexp_extract_all(F.col(html), F.lit(r"""\bstyle\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1))
    parts = F.flatten(F.transform(styles, lambda s: F.transform(F.split(F.substring(s, F.lit(2), F.length(s) - 2), ";"), lambda p: F.trim(p))))
    return df.select(F.explode(F.array_distinct(F.filter(parts, lambda p: p.startswith("color")))).alias("part")).distinct()


def column_width(style: Column | str, width: Column | str) -> Column:
    """Whole pixels of a column, from its style or its width attribute; none if not above 0."""
    styled = F.regexp_extract(F.coalesce(_c(style), F.lit("")), r"width\s*:\s*(\d+(?:\.\d+)?)", 1)
    plain = F.regexp_replace(F.coalesce(_c(width), F.lit("")), "[^0-9.]", "")
    value = F.floor(F.coalesce(F.when(styled != "", styled), plain).try_cast("double") + 0.5).cast("int")
    return F.when(value > 0, value)


# ---- URLs and keys ----


def _first(*found: Column) -> Column:
    return F.coalesce(*(F.when(x != "", x) for x in found))


def page_id(url: Column | str) -> Column:
    return _first(F.regexp_extract(_c(url), r"pageId=(\d+)", 1))


def display_space(url: Column | str) -> Column:
    return F.try_url_decode(_first(F.regexp_extract(_c(url), r"/display/([^/?#]+)/[^/?#]+", 1)))


def display_title(url: Column | str) -> Column:
    return F.try_url_decode(_first(F.regexp_extract(_c(url), r"/display/[^/?#]+/([^/?#]+)", 1)))


def space_key(value: Column | str) -> Column:
    """The space of a URL's query, else of its path, else the value itself."""
    text = F.trim(F.coalesce(_c(value), F.lit("")))
    query = F.regexp_extract(text, r"[?&]spaceKey=([^&#]+)", 1)
    path = F.regexp_extract(text, r"/(?:display|spaces)/([^/?#]+)", 1)
    return F.coalesce(F.try_url_decode(_first(query, path)), text)


def project_key(value: Column | str) -> Column:
    """The project of a URL's query, else of its path, else the value; an issue key gives its project."""
    text = F.trim(F.coalesce(_c(value), F.lit("")))
    query = F.regexp_extract(text, r"[?&]projectKey=([^&#]+)", 1)
    path = F.regexp_extract(text, r"/(?:browse|projects)/([^/?#]+)", 1)
    return F.regexp_replace(F.coalesce(F.try_url_decode(_first(query, path)), text), r"^([A-Za-z][A-Za-z0-9_]*)-\d+$", "$1")


def authority(url: Column | str) -> Column:
    """Host and port in lower case, without scheme and path."""
    text = F.lower(F.trim(F.coalesce(_c(url), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(text, "^.*?://", ""), "/.*$", "")


def service_kind(host: Column | str) -> Column:
    lower = F.lower(F.coalesce(_c(host), F.lit("")))
    code = lower.contains("bitbucket") | lower.contains("stash")
    return F.when(code, "BITBUCKET").when(lower.contains("jira"), "JIRA").otherwise("CONFLUENCE")


def server_url(url: Column | str) -> Column:
    """Scheme and authority."""
    return _first(F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))


def normal_path(folder: Column | str, target: Column | str) -> Column:
    """A path as seen from a folder, without ``.`` and ``..``; those above the top are dropped."""
    parts = F.filter(F.split(F.concat_ws("/", _c(folder), _c(target)), "/"), lambda x: ~x.isin("", "."))
    up = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def encode_path(path: Column | str) -> Column:
    """A path with each segment URL-encoded."""
    return F.array_join(F.transform(F.split(_c(path), "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/")


# ---- search strings ----


def search_clause(field: str, operator: str, text: Column | str, space: Column | str | None = None) -> Column:
    quoted = F.replace(F.replace(_c(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    clause = F.concat(F.lit(f'{field} {operator} "'), quoted, F.lit('"'))
    if space is None:
        return clause
    return F.when(F.trim(_c(space)) != "", F.concat(clause, F.lit(' and space.key = "'), _c(space), F.lit('"'))).otherwise(clause)
