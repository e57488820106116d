"""A tolerant element tree for wiki storage markup and ordinary web pages.

It repairs what corpora hold: tags without an end, rows without a table body, formatting that runs past its paragraph, and
CDATA sections, whose text is kept as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
FORMATTING = frozenset("a b big code em font i s small strike strong tt u".split())
# tags that end an open paragraph
BLOCKS = frozenset("address article aside blockquote center details dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TRANSPARENT = frozenset(("html", "body"))
#: an open tag (key) ends when one of these begins, unless a tag of the last set lies between
ENDED_BY = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",)),
    "th": (("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",)),
    "tr": (("tr", "tbody", "thead", "tfoot"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "colgroup": (("tr", "tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
SPACE = re.compile(r"[ \t\n\r\f]+")
CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.DOTALL)


class Raw(str):
    """Text of a CDATA section."""

    __slots__ = ()


class Element:
    __slots__ = ("name", "attrs", "kids")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.kids = name, attrs or {}, []

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def elements(self) -> list[Element]:
        return [k for k in self.kids if isinstance(k, Element)]

    def walk(self) -> Iterator[Element]:
        """This element and all below it, in document order; not by recursion, so any depth will do."""
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += [k for k in reversed(e.kids) if isinstance(k, Element)]

    def all(self, name: str) -> list[Element]:
        return [e for e in self.walk() if e.name == name]

    def first(self, name: str) -> Element | None:
        return next((e for e in self.walk() if e.name == name), None)

    def whole_text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.kids)
        return "".join(out)

    def text(self) -> str:
        """Text with white space run together and blocks set apart; CDATA as it is."""
        out: list[str] = []

        def space() -> None:
            if out and not out[-1].endswith((" ", "\n")):
                out.append(" ")

        stack: list = [self]
        while stack:
            node = stack.pop()
            if node is None:
                space()
            elif isinstance(node, Raw):
                out.append(node)
            elif isinstance(node, str):
                plain = SPACE.sub(" ", node)
                out.append(plain[1:] if plain[:1] == " " and (not out or out[-1].endswith(" ")) else plain)
            else:
                if node.name == "br" or node.name in BLOCKS or node.name in ("li", "td", "th", "tr"):
                    space()
                    stack.append(None)
                stack += reversed(node.kids)
        return "".join(out).strip(" \t\n\r")


class _Builder(HTMLParser):
    def __init__(self, raw: list[str]):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.open, self.raw, self.again = [self.root], raw, []

    def _pop(self, at: int) -> None:
        """Close everything from place ``at`` on; formatting that was open goes on in what follows."""
        self.again += [(e.name, e.attrs) for e in self.open[at:] if e.name in FORMATTING]
        del self.open[at:]

    def _reopen(self) -> None:
        for name, attrs in self.again:
            e = Element(name, dict(attrs))
            self.open[-1].kids.append(e)
            self.open.append(e)
        self.again = []

    def _end_implied(self, name: str) -> None:
        if name in BLOCKS:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].name == "p":
                    self._pop(i)
                    break
                if self.open[i].name not in FORMATTING and self.open[i].name != "span":
                    break
        for i in range(len(self.open) - 1, 0, -1):
            ends, stops = ENDED_BY.get(self.open[i].name, ((), ()))
            if name in ends:
                kept = self.again
                self._pop(i)
                self.again = kept
            elif self.open[i].name in ("table", "ul", "ol", "dl") or self.open[i].name in stops:
                break

    def handle_starttag(self, tag: str, attrs: list, empty: bool = False) -> None:
        if tag.startswith("x-cdata-"):
            self.open[-1].kids.append(Raw(self.raw[int(tag[8:])]))
            return
        if tag in TRANSPARENT:
            return
        if self.open[-1].name == "head" and tag not in ("title", "meta", "style", "script", "link", "base", "noscript"):
            self.open.pop()
        self._end_implied(tag)
        if tag == "tr" and self.open[-1].name == "table":
            body = Element("tbody")
            self.open[-1].kids.append(body)
            self.open.append(body)
        if tag not in BLOCKS and tag not in ("li", "td", "th", "tr", "tbody", "thead", "tfoot", "col", "colgroup") and self.again:
            self._reopen()
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].kids.append(e)
        if tag not in VOID and not empty:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag: str) -> None:
        if tag.startswith("x-cdata-") or tag in TRANSPARENT:
            return
        if tag in FORMATTING and any(n == tag for n, _ in self.again):
            at = max(i for i, (n, _) in enumerate(self.again) if n == tag)
            del self.again[at]
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                self._pop(i + 1)
                self.open.pop()
                if tag not in FORMATTING and tag not in ("p", "span") and not self.open[-1].name.startswith("ac:"):
                    pass
                return
            if self.open[i].name in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data: str) -> None:
        if self.again and data.strip():
            self._reopen()
        if data:
            self.open[-1].kids.append(data)


def parse(markup: str | None) -> Element:
    """The tree of a page or fragment. Its root's children are the body's; a ``head`` element may be among them."""
    raw: list[str] = []

    def keep(m: re.Match) -> str:
        raw.append(m.group(1))
        return f"<x-cdata-{len(raw) - 1}></x-cdata-{len(raw) - 1}>"

    builder = _Builder(raw)
    builder.feed(CDATA.sub(keep, markup or ""))
    builder.close()
    return builder.root


def body(root: Element) -> list[Element]:
    """The body's child elements."""
    return [e for e in root.elements() if e.name not in ("head", "title", "meta", "link", "base", "style", "script")]


def serialize(node: Element | str, text: Callable[[str], str] = str) -> str:
    """Markup of the tree; empty elements of the wiki's own names are self-closed."""
    if isinstance(node, Raw):
        return f"<![CDATA[{node}]]>"
    if isinstance(node, str):
        return node.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    inner = "".join(k if node.name in RAW and isinstance(k, str) else serialize(k) for k in node.kids)
    if node.name == "#root":
        return inner
    attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in node.attrs.items())
    if node.name in VOID:
        return f"<{node.name}{attrs}>"
    if not inner and ":" in node.name:
        return f"<{node.name}{attrs} />"
    return f"<{node.name}{attrs}>{inner}</{node.name}>"
