"""Structure-preserving anonymisation of AsciiDoc, storage markup and JSON.

Stand-ins depend on a key, the kind and the value alone, so the same value gets the same stand-in in every partition and run with the key, without any
state. Those of words, names, logins, keys, titles, files, anchors and addresses are one to one (``standins``), so what two anonymised tables could be joined on they still can, and no file takes
another's name. Running prose in markup and dates are drawn by a keyed hash and may coincide.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.shared import dealt

from .dom import Element, Raw, parse, serialize
from .standins import StandIns

WORDS = (
    "amber anchor basin beacon birch bridge brook canyon cedar cinder cliff cloud cobalt coral crater creek delta dune ember fern field fjord flint forest "
    "garden glacier grove harbor hazel heath island ivory juniper lagoon lantern ledge linen maple marble meadow mesa moss oasis orchard pebble pine "
    "plateau prairie quartz ravine reed ridge river saffron sage shore silver slate spring spruce summit thicket timber tundra valley willow"
).split()
# Suffixes that a file name keeps, and macro parameters that stay.
SUFFIXES = (".drawio.png", ".drawio", ".png", ".jpeg", ".jpg", ".gif", ".svg", ".puml", ".json", ".xml", ".pdf", ".docx", ".xlsx")
KEPT_PARAMETERS = frozenset(("language", "start-numbering-with"))
#: Path segments and file endings of a URL that tell the kind of a page and nothing of its owner.
ROUTES = frozenset("display spaces pages viewpage.action browse projects repos wiki rest api content download attachments label issue search".split())
# The fields of the format's records, by what they hold.
FIELDS = {
    "url": "url href base self link webui tinyui download",
    "user_key": "userkey accountid",
    "login": "username",
    "name": "displayname fullname",
    "title": "title content-title name",
    "space_key": "space spacekey space-key",
    "file_name": "filename",
    "date": "date datetime when created lastmodified friendlywhen",
}
#: Fields of other records.
MORE_FIELDS = {"name": "author owner", "login": "email", "date": "modified updated"}
KIND_OF = {field: kind for table in (FIELDS, MORE_FIELDS) for kind, fields in table.items() for field in fields.split()}
# The field whose object's names are files; lines of block attributes, which stay; attribute entries, whose names stay.
FILES_BY_NAME = "attachment"
ATTRIBUTES_LINE = re.compile(r"\s*\[.*\]\s*")
ENTRY_LINE = re.compile(r"(:!?[\w.-]+:)(.*)")
#: Signs of a text that a task remembers when it has changed it, and of all that it remembers.
SHORT = 1 << 10
REMEMBERED = 1 << 25
# letter runs that are not file suffixes, attribute names or parts of a longer run
RUN = re.compile(r"(?<![^\W\d_])(?<!\.)[^\W\d_]{2,}(?![^\W\d_])(?!:)")


class Anonymizer:
    def __init__(self, key: str = "42"):
        self.key = key.encode()
        self.of = StandIns(self.key)

    def draw(self, kind: str, value: str, n: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{kind}\0{value}".encode("utf-8", "surrogatepass"), hashlib.sha256)[:8], "big") % n

    def phrase(self, kind: str, value: str, count: int) -> str:
        return " ".join(WORDS[self.draw(kind, f"{value}\0{i}", len(WORDS))] for i in range(count))

    # generators, each one to one; null stays null

    def name(self, v: str) -> str:
        return self.of.words(v)

    title = name

    def login(self, v: str) -> str:
        return self.of.shape("login", v)

    def user_key(self, v: str) -> str:
        return self.of.hexadecimal("user", v)

    def space_key(self, v: str) -> str:
        return self.of.shape("space", v)

    def issue_key(self, v: str) -> str:
        """The key of the project, as elsewhere, and another number."""
        project, dash, number = v.partition("-")
        return self.space_key(project) + dash + self.of.shape("issue", number)

    def anchor(self, v: str) -> str:
        return self.of.shape("anchor", v)

    def base_name(self, v: str) -> str:
        return self.of.shape("file", v)

    def file_name(self, v: str) -> str:
        """Another name with the same suffix."""
        n = len(suffix_of(v))
        base, suffix = v[: len(v) - n], v[len(v) - n :]
        return self.of.within("file", base, lambda x: len(suffix_of(x + suffix)) == n) + suffix if base.strip() else v

    def date(self, v: str) -> str:
        day = datetime.date(2019, 1, 1) + datetime.timedelta(days=self.draw("date", v, 3650))
        return day.isoformat()

    def url(self, v: str) -> str:
        """Component by component: the host, every path segment that is no route, every value of the query and the fragment."""
        try:
            at = urlsplit(v)
        except ValueError:
            return self.slug(v)
        host = f"{self.of.shape('host', at.hostname)}.example" if at.hostname else ""
        path = "/".join(self._segment(x) for x in at.path.split("/"))
        query = urlencode([(k, self.slug(x)) for k, x in parse_qsl(at.query, keep_blank_values=True)])
        return urlunsplit((at.scheme, host, path, query, self.anchor(at.fragment) if at.fragment else ""))

    def _segment(self, v: str) -> str:
        if segment_kind(v) == "route":
            return v
        if segment_kind(v) == "user":
            return "~" + self.login(v[1:])
        return self.file_name(v) if segment_kind(v) == "file" else self.of.within("slug", v, lambda x: segment_kind(x) == "other")

    def slug(self, v: str) -> str:
        return self.of.shape("slug", v)

    # texts

    def scrub(self, text: str) -> str:
        """Every run of two letters and more by another, the same for the same run."""
        words = self.of.known_words
        return RUN.sub(lambda m: words[m[0]], text)

    def inline(self, text: str) -> str:
        """As many words as there were; white space at the edges stays."""
        core = text.strip()
        if not core:
            return text
        at = text.index(core)
        return text[:at] + self.phrase("inline", core, len(core.split())).capitalize() + text[at + len(core) :]

    def lines(self, text: str) -> str:
        return "\n".join(self.phrase("line", x.strip(), len(x.split())) if x.strip() else x for x in text.split("\n"))

    def adoc(self, text: str) -> str:
        """Block attribute lines stay; of attribute entries the value is scrubbed, of other lines all words."""
        out = []
        for line in text.split("\n"):
            if not ATTRIBUTES_LINE.fullmatch(line):
                entry = ENTRY_LINE.fullmatch(line)
                line = entry.group(1) + self.scrub(entry.group(2)) if entry else self.scrub(line)
            out.append(line)
        return "\n".join(out)

    # markup

    def html(self, markup: str) -> str:
        return self.tree(parse(markup))

    def tree(self, root: Element) -> str:
        """``html`` of markup that is parsed already; the tree is changed."""
        self._texts(root, self.inline)
        stack = root.elements()
        while stack:
            e = stack.pop()
            if e.name == "ac:structured-macro":
                for k in e.elements():
                    if k.name == "ac:parameter":
                        self._parameter(e.get("ac:name"), k)
                    elif k.name == "ac:plain-text-body":
                        self._texts(k, self.lines)
                        stack += k.elements()
                    else:
                        stack.append(k)
                continue
            self._attributes(e)
            if e.name not in ("script", "style"):
                self._texts(e, self.inline)
            stack += e.elements()
        return serialize(root)

    @staticmethod
    def _texts(e: Element, by: Callable[[str], str]) -> None:
        e.kids = [Raw(by(k)) if isinstance(k, Raw) else by(k) if isinstance(k, str) else k for k in e.kids]

    def _attributes(self, e: Element) -> None:
        rules: dict[str, Callable[[str], str]] = {
            "ri:user": {"ri:userkey": self.user_key},
            "ri:page": {"ri:content-title": self.title, "ri:space-key": self.space_key},
            "ri:attachment": {"ri:filename": self.file_name},
            "ri:url": {"ri:value": self.url},
            "a": {"href": self.url},
            "img": {"src": lambda v: "/".join([*v.split("/")[:-1], self.file_name(v.split("/")[-1])])},
            "time": {"datetime": self.date},
        }.get(e.name, {})
        for name, by in {**rules, "ac:anchor": self.anchor, "alt": self.inline, "title": self.inline}.items():
            if e.attrs.get(name):
                e.attrs[name] = by(e.attrs[name])

    def _parameter(self, macro: str, p: Element) -> None:
        name, value = p.get("ac:name"), p.whole_text()
        if name in KEPT_PARAMETERS:
            return
        if p.elements():  # a reference and not a text
            for e in p.walk():
                self._attributes(e)
                self._texts(e, self.inline)
            return
        by = self.inline
        if (macro, name) == ("jira", "key"):
            by = self.issue_key
        elif macro in ("drawio", "inc-drawio") and name == "diagramName":
            by = self.base_name
        elif macro == "anchor":
            by = self.anchor
        p.kids = [by(value)] if value else []

    # JSON

    def json(self, text: str) -> str:
        try:
            found = [json.loads(text)]
        except ValueError:
            return self.scrub(text)
        # places whose values are still to be seen, each with the name of the field that it belongs to
        open_: list[tuple] = [(found, 0, "")]
        while open_:
            box, at, field = open_.pop()
            value = box[at]
            if isinstance(value, str):
                box[at] = self._field(field, value) if value.strip() else value
            elif isinstance(value, list):
                open_ += [(value, i, field) for i in range(len(value))]
            elif isinstance(value, dict):
                box[at] = {self.file_name(k) if field == FILES_BY_NAME else k: v for k, v in value.items()}
                open_ += [(box[at], new, k.lower()) for new, k in zip(box[at], value, strict=True)]
        return json.dumps(found[0], ensure_ascii=False)

    def _field(self, field: str, text: str) -> str:
        """By what the value is where it shows that, else by the field's name."""
        if (root := markup_tree(text)) is not None:
            return self.tree(root)
        kind = KIND_OF.get(field) or ("url" if urlsplit_or_none(text) else None)
        return getattr(self, kind)(text) if kind else text


def suffix_of(name: str) -> str:
    low = name.lower()
    return next(s for s in SUFFIXES if low.endswith(s)) if low.endswith(SUFFIXES) else ""


def segment_kind(v: str) -> str:
    return "route" if not v or v.lower() in ROUTES else "user" if v[0] == "~" else "file" if suffix_of(v) else "other"


def markup_tree(text: str) -> Element | None:
    """The tree of a text in which the engine's own parser finds an element."""
    root = parse(text) if "<" in text and ">" in text else None
    return root if root is not None and root.elements() else None


def urlsplit_or_none(text: str):
    try:
        at = urlsplit(text)
    except ValueError:
        return None
    return at if at.scheme and at.netloc and not text.strip().count(" ") else None


def _column(df: DataFrame, text: str, by: Callable[[Anonymizer], Callable[[str], str]], key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, made, size = by(Anonymizer(key)), {}, 0

        def change(x: str) -> str:
            """Short texts that come again are made once, as long as the task remembers them."""
            nonlocal size
            if len(x) > SHORT:
                return make(x)
            found = made.get(x)
            if found is None:
                found = make(x)
                size += len(x) + len(found)
                if size > REMEMBERED:
                    made.clear()
                    size = len(x) + len(found)
                made[x] = found
            return found

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                i = part.schema.names.index(text)
                values = pa.array([change(x) if x and x.strip() else x for x in part.column(i).to_pylist()], type=part.schema.field(i).type)
                yield part.set_column(i, text, values)

    return dealt(df, F.when(F.length(text) <= SHORT, F.col(text))).mapInArrow(run, df.schema)


def anonymize_adoc(df: DataFrame, text: str = "text", key: str = "42") -> DataFrame:
    return _column(df, text, lambda a: a.adoc, key)


def anonymize_html(df: DataFrame, text: str = "html", key: str = "42") -> DataFrame:
    return _column(df, text, lambda a: a.html, key)


def anonymize_json(df: DataFrame, text: str = "json", key: str = "42") -> DataFrame:
    return _column(df, text, lambda a: a.json, key)


def stand_ins(df: DataFrame, kind: str = "kind", value: str = "value", key: str = "42") -> DataFrame:
    """``df`` with ``stand_in`` for each value, by a kind of KINDS; null for other kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Anonymizer(key)
        for batch in batches:
            pairs = zip(batch.column(kind).to_pylist(), batch.column(value).to_pylist(), strict=True)
            made = [getattr(a, k)(v) if k in KINDS and v is not None else None for k, v in pairs]
            yield batch.append_column("stand_in", pa.array(made, type=pa.string()))

    return dealt(df).mapInArrow(run, T.StructType([*df.schema, T.StructField("stand_in", T.StringType())]))


#: What ``stand_ins`` makes.
KINDS = ("name", "login", "user_key", "title", "space_key", "issue_key", "anchor", "base_name", "file_name", "date", "url", "slug")


def attachment_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``new_name``: file_N and the kept suffix; N by the order of distinct base names within ``page_id``."""
    from pyspark.sql import Window as W

    suffix = F.regexp_extract(F.lower(name), "(" + "|".join(re.escape(s) for s in SUFFIXES) + ")$", 1)
    rows = df.withColumn("_base", F.substring(F.col(name), F.lit(1), F.length(name) - F.length(suffix)))
    number = F.dense_rank().over(W.partitionBy("page_id").orderBy("_base"))
    return rows.withColumn("new_name", F.concat(F.lit("file_"), number.cast("string"), suffix)).drop("_base")
