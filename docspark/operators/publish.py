"""The publish direction: a subset of AsciiDoc to storage markup.

The subset: header and attributes, sections, paragraphs with alignment roles, nested lists, task and description lists, tables with widths, spans and
AsciiDoc cells, listings, diagrams, admonitions, examples, sidebars, quotes, verses, images, the table of contents, includes, anchors, cross
references, links and inline formatting. Includes of pages become macros; those of other files are put in place by ``includes``. Full AsciiDoc is not claimed.
"""

from __future__ import annotations

import html
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docspark.functions.pure import DIRECTIVE_LINE, code_language
from docspark.shared import dealt

ALIGN = {f"text-{k}": f"text-align: {k};" for k in ("left", "right", "center", "justify")}
ADMONITIONS = {"NOTE": "info", "TIP": "tip", "CAUTION": "note", "WARNING": "note", "IMPORTANT": "warning"}
FENCES = {"----": "listing", "....": "literal", "====": "example", "****": "sidebar", "____": "quote", "++++": "pass", "--": "open", "```": "listing"}


def text(s: str | None) -> str:
    return html.escape(s or "", quote=False)


def attr(s: str | None) -> str:
    return text(s).replace('"', "&quot;")


def cdata(s: str) -> str:
    return "<![CDATA[" + s.replace("]]>", "]]]]><![CDATA[>") + "]]>"


def parameter(name: str, value: str | None) -> str:
    return f'<ac:parameter ac:name="{attr(name)}">{text(value)}</ac:parameter>' if value is not None and value.strip() else ""


def macro(name: str, parameters: str, plain: str | None = None, rich: str | None = None) -> str:
    body = "" if plain is None else f"<ac:plain-text-body>{cdata(plain)}</ac:plain-text-body>"
    body += "" if rich is None else f"<ac:rich-text-body>{rich}</ac:rich-text-body>"
    return f'<ac:structured-macro ac:name="{attr(name)}">{parameters}{body}</ac:structured-macro>'


def anchor(name: str) -> str:
    return f'<ac:structured-macro ac:name="anchor"><ac:parameter ac:name="">{text(name)}</ac:parameter></ac:structured-macro>'


def image(file: str, alt: str | None, title: str | None, width: str | None, height: str | None, inline: bool = False) -> str:
    named = (("ac:alt", alt), ("ac:title", title), ("ac:width", width), ("ac:height", height))
    attrs = ' ac:inline="true"' * inline + "".join(f' {k}="{attr(v)}"' for k, v in named if v and v.strip())
    attrs += ' ac:custom-width="true"' if (width or height) and not inline else ""
    source = f'<ri:url ri:value="{attr(file)}"/>' if inline and "://" in file else f'<ri:attachment ri:filename="{attr(file.split("/")[-1])}"/>'
    return f"<ac:image{attrs}>{source}</ac:image>"


def to_page(title: str, place: str | None, body: str, space: str | None = None) -> str:
    a = f' ac:anchor="{attr(place)}"' if place and place.strip() else ""
    s = f' ri:space-key="{attr(space)}"' if space and space.strip() else ""
    return f'<ac:link{a}><ri:page ri:content-title="{attr(title)}"{s}/><ac:link-body>{body}</ac:link-body></ac:link>'


@dataclass
class Context:
    """What references need: titles of other files, the files that declare anchors, this file."""

    path: str = ""
    titles: dict[str, str] = field(default_factory=dict)
    anchors: dict[str, str] = field(default_factory=dict)
    plantuml: str = "plantuml"
    attributes: dict[str, str] = field(default_factory=dict)
    images: list[str] = field(default_factory=list)
    root: str = ""
    notes: list[str] = field(default_factory=list)
    named_notes: dict[str, int] = field(default_factory=dict)

    def known(self, target: str) -> str | None:
        """The title of another file, as seen from this one's folder, else from the root of its tree."""
        here, top = (posixpath.normpath(posixpath.join(x, target)) for x in (posixpath.dirname(self.path), self.root))
        return self.titles.get(here) or self.titles.get(top) or self.titles.get(target)

    def other(self, target: str) -> str:
        return self.known(target) or re.sub(r"\.[^.]*$", "", target.split("/")[-1])

    def note(self, name: str | None, body: str) -> int:
        """The number of a footnote; one that has a name and no text is that of before."""
        if name and not body and name in self.named_notes:
            return self.named_notes[name]
        self.notes.append(body)
        if name:
            self.named_notes[name] = len(self.notes)
        return len(self.notes)


# ---- inline ----

_MARKS = (("**", "strong"), ("__", "em"), ("``", "code"), ("##", "mark"), ("*", "strong"), ("_", "em"), ("`", "code"), ("^", "sup"), ("~", "sub"))
_INLINE = re.compile(
    r"(?P<pass>\+\+\+(?P<raw>.*?)\+\+\+)|(?P<note>footnote:(?P<nid>[\w-]*)\[(?P<ntext>(?:\\\]|[^\]])*)\])|(?P<image>image:(?P<img>[^\s:\[][^\s\[]*)\[(?P<imga>[^\]]*)\])|(?P<xref><<(?P<xid>[^,>]+)(?:,\s*(?P<xtext>[^>]*))?>>)"
    r"|(?P<xmacro>xref:(?P<xfile>[^\[\s]+)\[(?P<xlabel>[^\]]*)\])|(?P<anchor>\[\[(?P<aid>[\w:.\-]+)(?:,[^\]]*)?\]\]|anchor:(?P<aid2>[\w:.\-]+)\[[^\]]*\])"
    r"|(?P<link>(?:link:(?P<target>[^\s\[]+)|(?P<url>https?://[^\s\[\]<>]+))(?:\[(?P<label>(?:\\\]|[^\]])*)\])?)"
    r"|(?P<role>\[\.(?P<rname>[\w-]+)\](?P<rmark>##?)(?P<rtext>.+?)(?P=rmark))|(?P<br> \+\n)"
)


def inline(source: str, c: Context) -> str:
    """Markup of one run of text."""
    source = re.sub(r"\{([\w-]+)\}", lambda m: c.attributes.get(m.group(1), m.group(0)), source)
    held: list[str] = []

    def keep(markup: str) -> str:
        held.append(markup)
        return f"\x00{len(held) - 1}\x00"

    def one(m: re.Match) -> str:
        g = m.groupdict()
        if g["pass"]:
            return keep(g["raw"])
        if g["note"]:
            body = g["ntext"].replace("\\]", "]")
            return keep(f"<sup>[{c.note(g['nid'] or None, inline(body, c) if body else '')}]</sup>")
        if g["image"]:
            c.images.append(g["img"])
            return keep(image(g["img"], g["imga"].split(",")[0] or None, None, None, None, inline=True))
        if g["xref"] or g["xmacro"]:
            target = g["xid"] or g["xfile"]
            label = g["xtext"] if g["xref"] else g["xlabel"]
            file, _, place = target.partition("#")
            if ".adoc" in file:
                title = c.other(file)
                return keep(to_page(title, place, inline(label, c) if label else text(title)))
            place = place or file
            home = c.anchors.get(place)
            body = inline(label, c) if label else text(place)
            if home and home != c.path:
                return keep(to_page(c.other(home), place, body))
            return keep(f'<ac:link ac:anchor="{attr(place)}"><ac:link-body>{body}</ac:link-body></ac:link>')
        if g["anchor"]:
            return keep(anchor(g["aid"] or g["aid2"]))
        if g["link"]:
            target = g["target"] or g["url"]
            label = (g["label"] or "").replace("\\]", "]")
            body = inline(label, c) if label else text(target)
            if g["target"] and "://" not in target and not target.startswith(("mailto:", "/", "#")):
                if target.endswith(".adoc"):
                    return keep(to_page(c.other(target), None, body))
                c.images.append(target)
                return keep(f'<ac:link><ri:attachment ri:filename="{attr(target.split("/")[-1])}"/><ac:link-body>{body}</ac:link-body></ac:link>')
            return keep(f'<a href="{attr(target)}">{body}</a>')
        if g["role"]:
            body = inline(g["rtext"], c)
            return keep(f"<u>{body}</u>" if g["rname"] == "underline" else f'<span class="{attr(g["rname"])}">{body}</span>')
        return keep("<br/>")

    def mentioned(m: re.Match) -> str:
        """A file that is named as code, where there is such a file."""
        title = c.known(html.unescape(m.group(1)))
        return m.group() if title is None else to_page(title, m.group(2) and html.unescape(m.group(2)), text(title))

    out = text(_INLINE.sub(one, source))
    for mark, tag in _MARKS:
        m = re.escape(mark)
        if len(mark) == 2 or mark in "^~":
            out = re.sub(rf"{m}(?=\S)(.+?)(?<=\S){m}", rf"<{tag}>\1</{tag}>", out, flags=re.DOTALL)
        else:
            out = re.sub(rf"(?<![\w{m}]){m}(?=\S)(.+?)(?<=\S){m}(?![\w{m}])", rf"<{tag}>\1</{tag}>", out, flags=re.DOTALL)
    out = re.sub(r"(?i)<code>([^<>#\x00]+\.adoc)(?:#([^<>\x00]+))?</code>", mentioned, out)
    while "\x00" in out:
        out = re.sub(r"\x00(\d+)\x00", lambda m: held[int(m.group(1))], out)
    return out.replace("\n", " ")


# ---- blocks ----

_LIST = re.compile(r"^\s*(?P<mark>\*{1,6}|-|\.{1,6}|\d+\.)\s+(?P<text>.*)$")
_CALLOUT = re.compile(r"^<(?:\d+|\.)>\s+(?P<text>.*)$")
_CONDITION = re.compile(r"^(ifdef|ifndef|ifeval|endif)::([^\[\s]*)\[(.*)\]\s*$")
_TERM = re.compile(r"^(?P<term>[^\s:|].*?)::(?:\s+(?P<text>.*))?$")


@dataclass
class Block:
    """Attributes and title that lines above a block set."""

    style: str = ""
    named: dict[str, str] = field(default_factory=dict)
    positional: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    options: set[str] = field(default_factory=set)
    id: str | None = None
    title: str | None = None


def attribute_line(line: str, b: Block) -> None:
    parts = re.findall(r'(?:([\w-]+)\s*=\s*)?(?:"([^"]*)"|([^,"]*))(?:,|$)', line)
    for n, (name, quoted, bare) in enumerate(parts):
        value = quoted or bare.strip()
        if name:
            b.named[name] = value
            if name in ("options", "opts"):
                b.options |= set(value.split(","))
            elif name == "role":
                b.roles += value.split()
        elif value or n == 0:
            if n == 0:
                head = re.match(r"[^.#%]*", value).group()
                b.style = head or b.style
                for kind, x in re.findall(r"([.#%])([^.#%]+)", value):
                    if kind == ".":
                        b.roles.append(x)
                    elif kind == "#":
                        b.id = x
                    else:
                        b.options.add(x)
            b.positional.append(value)


def unescaped(line: str) -> str:
    """A line whose backslash keeps it from being a directive, without it; of several backslashes one is taken."""
    return line[1:] if line.startswith("\\") and DIRECTIVE_LINE.match(line) else line


class Reader:
    """Storage markup of the lines of a document or a cell."""

    def __init__(self, lines: list[str], c: Context):
        self.lines, self.at, self.c = lines, 0, c

    def more(self) -> bool:
        return self.at < len(self.lines)

    def header(self) -> None:
        while self.more() and not self.lines[self.at].strip():
            self.at += 1
        if self.more() and re.match(r"= \S", self.lines[self.at]):
            self.c.attributes["doctitle"] = self.lines[self.at][2:].strip()
            self.at += 1
        while self.more() and (m := re.match(r"^:(!?)([\w-]+)(!?):(?:\s+(.*))?$", self.lines[self.at])):
            self._set(m)
            self.at += 1

    def _set(self, m: re.Match) -> None:
        if m.group(1) or m.group(3):
            self.c.attributes.pop(m.group(2), None)
        else:
            self.c.attributes[m.group(2)] = (m.group(4) or "").strip()

    def blocks(self, until: str | None = None) -> str:
        out, b = [], Block()
        while self.more():
            line = self.lines[self.at]
            if until is not None and line.rstrip() == until:
                self.at += 1
                break
            if not line.strip() or line.startswith("//") and not line.startswith("////"):
                self.at += 1
            elif m := re.match(r"^:(!?)([\w-]+)(!?):(?:\s+(.*))?$", line):
                self._set(m)
                self.at += 1
            elif m := re.match(r"^\[\[([\w:.\-]+)(?:,.*)?\]\]\s*$", line):
                b.id = m.group(1)
                self.at += 1
            elif m := re.match(r"^\[(.*)\]\s*$", line):
                attribute_line(m.group(1), b)
                self.at += 1
            elif re.match(r"^\.[^\s.]", line):
                b.title = line[1:].strip()
                self.at += 1
            else:
                out.append(self.block(line, b))
                b = Block()
        return "".join(out)

    def block(self, line: str, b: Block) -> str:
        c = self.c
        if m := re.match(r"^(={1,6})\s+(.+)$", line):
            self.at += 1
            level = min(max(len(m.group(1)) - 1, 1), 6)
            mark = "" if b.style == "discrete" or not b.id else anchor(b.id)
            style = next((f' style="{ALIGN[r]}"' for r in b.roles if r in ALIGN), "")
            return f"<h{level}{style}>{mark}{inline(m.group(2).strip(), c)}</h{level}>"
        place = anchor(b.id) if b.id else ""
        if line.startswith("////"):
            self.fenced("////")
            return ""
        fence = line.rstrip()
        if fence.startswith("```"):
            b.style, b.positional = "source", ["source", fence[3:].strip()]
            fence = "```"
        kind = FENCES.get(fence) or (FENCES.get(fence[:4]) if len(set(fence)) == 1 and len(fence) > 4 else None)
        if kind:
            return place + self.delimited(line.rstrip(), fence, kind, b)
        if re.match(r"^[|!,]===\s*$", line):
            return place + self.table(line.strip(), b)
        if line.strip() in ("'''", "---", "***"):
            self.at += 1
            return place + "<hr/>"
        if m := re.match(r"^image::([^\[]+)\[(.*)\]\s*$", line):
            self.at += 1
            a = Block()
            attribute_line(m.group(2), a)
            size = [*a.positional, "", "", ""]
            c.images.append(m.group(1))
            alt = a.named.get("alt") or (m.group(2).split(",")[0] if a.positional and a.positional[0] else None)
            shown = image(m.group(1), alt, b.title or a.named.get("title"), a.named.get("width") or size[1] or None, a.named.get("height") or size[2] or None)
            link = a.named.get("link") or b.named.get("link")
            return place + (f'<a href="{attr(link)}">{shown}</a>' if link else shown)
        if re.match(r"^toc::\[\]", line):
            self.at += 1
            depth = c.attributes.get("toclevels", "").strip()
            return f'<ac:structured-macro ac:name="toc"><ac:parameter ac:name="maxLevel">{depth if depth.isdigit() else 2}</ac:parameter></ac:structured-macro>'
        if m := re.match(r"^include::([^\[]+)\[.*\]\s*$", line):
            self.at += 1
            if m.group(1).lower().endswith(".adoc"):
                title = c.other(m.group(1))
                link = f'<ac:link><ri:page ri:content-title="{attr(title)}"/></ac:link>'
                shown = f'<ac:structured-macro ac:name="include"><ac:parameter ac:name="">{link}</ac:parameter></ac:structured-macro>'
                return f"<h2>{to_page(title, None, text(title))}</h2>{shown}"
            return f"<p>Unresolved directive - {text(line.strip())}</p>"  # of a file alone; a tree's are put in place before it is read
        if _CALLOUT.match(line):
            return place + self.callouts()
        if _LIST.match(line):
            return place + self.list(b)
        if _TERM.match(line):
            return place + self.terms()
        return place + self.paragraph(b)

    def fenced(self, fence: str) -> list[str]:
        self.at += 1
        begin = self.at
        while self.more() and self.lines[self.at].rstrip() != fence:
            self.at += 1
        found = self.lines[begin : self.at]
        self.at += 1
        return [unescaped(x) for x in found]

    def inside(self, lines: list[str]) -> str:
        return Reader(lines, self.c).blocks()

    def delimited(self, line: str, fence: str, kind: str, b: Block) -> str:
        body = self.fenced(fence if fence == "```" else line)
        source = "\n".join(body)
        title = parameter("title", b.title)
        if kind in ("listing", "literal"):
            if b.style.lower() == "plantuml":
                return macro(self.c.plantuml, "", plain=source)
            if b.style.lower() == "source":
                language = code_language(b.named.get("language") or (b.positional[1] if len(b.positional) > 1 else None))
                lines = "linenums" in b.options or "linenums" in b.named or "linenums" in b.positional
                more = parameter("linenumbers", "true" if lines else None) + parameter("firstline", b.named.get("start")) + parameter("collapse", b.named.get("collapse"))
                return macro("code", parameter("language", language) + title + more, plain=source)
            return macro("noformat", title, plain=source)
        if kind == "pass":
            return source
        if b.style.upper() in ADMONITIONS:
            return macro(ADMONITIONS[b.style.upper()], title, rich=self.inside(body))
        if b.style == "verse":
            return f"<pre>{inline(source, self.c)}</pre>" + self.credit(b)
        if kind == "quote" or b.style == "quote":
            return f"<blockquote>{self.inside(body)}{self.credit(b)}</blockquote>"
        if kind == "example":
            return macro("expand" if "collapsible" in b.options else "tip", title, rich=self.inside(body))
        if kind == "sidebar":
            return macro("panel", title, rich=self.inside(body))
        return self.inside(body)

    @staticmethod
    def credit(b: Block) -> str:
        who = b.named.get("attribution") or (b.positional[1] if len(b.positional) > 1 else "")
        where = b.named.get("citetitle") or (b.positional[2] if len(b.positional) > 2 else "")
        both = ", ".join(x for x in (who, where) if x)
        return f"<p>— {text(both)}</p>" if both else ""

    def paragraph(self, b: Block) -> str:
        begin = self.at
        while self.more() and (line := self.lines[self.at]).strip() and (self.at == begin or not self.breaks(line)):
            self.at += 1
        body = "\n".join(unescaped(x) for x in self.lines[begin : self.at])
        if (m := re.match(r"^(NOTE|TIP|CAUTION|WARNING|IMPORTANT): ", body)) or b.style.upper() in ADMONITIONS:
            name = m.group(1) if m else b.style.upper()
            return macro(ADMONITIONS[name], parameter("title", b.title), rich=f"<p>{inline(body[m.end() :] if m else body, self.c)}</p>")
        if b.style == "quote":
            return f"<blockquote><p>{inline(body, self.c)}</p>{self.credit(b)}</blockquote>"
        if b.style == "verse":
            return f"<pre>{inline(body, self.c)}</pre>" + self.credit(b)
        if body.startswith(" "):
            return macro("noformat", parameter("title", b.title), plain=body)
        style = next((f' style="{ALIGN[r]}"' for r in b.roles if r in ALIGN), "")
        return f"<p{style}>{inline(body, self.c)}</p>"

    @staticmethod
    def breaks(line: str) -> bool:
        return line.rstrip() in FENCES or bool(re.match(r"^(\[.*\]\s*$|[|!]===|image::|include::|//)", line))

    def list(self, b: Block) -> str:
        """Items by their marks: an unknown mark opens a list inside the item before, a known one goes back to its list."""
        marks: list[str] = []
        out: list[str] = []
        tag = lambda m: "ol" if m[0] == "." or m[0].isdigit() else "ul"
        norm = lambda m: "1." if m[0].isdigit() else m
        while self.more() and (m := _LIST.match(self.lines[self.at])):
            mark = norm(m.group("mark"))
            if mark in marks:
                while marks[-1] != mark:
                    out.append(f"</li></{tag(marks.pop())}>")
                out.append("</li>")
            else:
                marks.append(mark)
                out.append(f"<{tag(mark)}>")
            self.at += 1
            lines = [m.group("text")]
            while self.more() and (line := self.lines[self.at]).strip() and not _LIST.match(line) and line.strip() != "+" and not self.breaks(line):
                lines.append(line.strip())
                self.at += 1
            item = "\n".join(lines)
            box = re.match(r"^\[([ xX*])\]\s+", item)
            out.append("<li>" + (("☑ " if box.group(1) != " " else "☐ ") + inline(item[box.end() :], self.c) if box else inline(item, self.c)))
            out.append(self.attached())
            if self.more() and not self.lines[self.at].strip() and self.at + 1 < len(self.lines) and _LIST.match(self.lines[self.at + 1]):
                self.at += 1
        out += [f"</li></{tag(m)}>" for m in reversed(marks)]
        return "".join(out)

    def callouts(self) -> str:
        """The notes to a listing's marks, as an ordered list."""
        out = []
        while self.more() and (m := _CALLOUT.match(self.lines[self.at])):
            self.at += 1
            lines = [m.group("text")]
            while self.more() and (line := self.lines[self.at]).strip() and not _CALLOUT.match(line) and line.strip() != "+" and not self.breaks(line):
                lines.append(line.strip())
                self.at += 1
            text_of = "\n".join(lines)
            out.append(f"<li>{inline(text_of, self.c)}{self.attached()}</li>")
        return f"<ol>{''.join(out)}</ol>"

    def attached(self) -> str:
        """Blocks joined to an item by a line with ``+``."""
        out = []
        while self.more() and self.lines[self.at].strip() == "+":
            self.at += 1
            b = Block()
            while self.more() and (m := re.match(r"^\[(.*)\]\s*$", self.lines[self.at])):
                attribute_line(m.group(1), b)
                self.at += 1
            if self.more() and re.match(r"^\.[^\s.]", self.lines[self.at]):
                b.title = self.lines[self.at][1:].strip()
                self.at += 1
            if self.more():
                out.append(self.block(self.lines[self.at], b))
        return "".join(out)

    def terms(self) -> str:
        out = []
        while self.more() and (m := _TERM.match(self.lines[self.at])):
            self.at += 1
            lines = [m.group("text")] if m.group("text") else []
            while self.more() and (line := self.lines[self.at]).strip() and not _TERM.match(line) and line.strip() != "+" and not self.breaks(line):
                lines.append(line.strip())
                self.at += 1
            out.append(f"<dt>{inline(m.group('term'), self.c)}</dt>")
            body = (inline("\n".join(lines), self.c) if lines else "") + self.attached()
            out.append(f"<dd>{body}</dd>" if body else "")
            while self.more() and not self.lines[self.at].strip() and self.at + 1 < len(self.lines) and _TERM.match(self.lines[self.at + 1]):
                self.at += 1
        return f"<dl>{''.join(out)}</dl>"

    def table(self, fence: str, b: Block) -> str:
        body = self.fenced(fence)
        mark = re.escape(fence[0])
        joined = "\n".join(body)
        pattern = re.compile(rf"(?:(?<=\s)|^)(?P<span>(?:\d+)?(?:\.\d+)?\+)?(?P<style>[a-z])?(?<!\\){mark}", re.MULTILINE)
        found = list(pattern.finditer(joined))
        cells = []
        for i, m in enumerate(found):
            content = joined[m.end() : found[i + 1].start() if i + 1 < len(found) else len(joined)]
            cols, _, rows = (m.group("span") or "1.1+").rstrip("+").partition(".")
            cells.append((int(cols or 1), int(rows or 1), m.group("style"), content.strip().replace("\\" + fence[0], fence[0]), joined.count("\n", 0, m.start())))
        spec = b.named.get("cols")
        styles = [re.sub(r"^[\d.<>^*]*", "", s) for s in self.columns(spec)] if spec else []
        if not styles:
            first = [x for x in cells if x[4] == cells[0][4]] if cells else []
            styles = [""] * sum(x[0] for x in first)
        width = max(len(styles), 1)
        rows: list[list[tuple]] = []
        taken: dict[int, int] = {}
        row: list[tuple] = []
        at = r = 0
        for cell in cells:
            while taken.get(at, 0) > 0:
                at += 1
            style = cell[2] or (styles[at] if at < len(styles) else "")
            row.append((*cell[:2], style, cell[3], cell[4], bool(cell[2])))
            for k in range(at, at + cell[0]):
                taken[k] = cell[1]
            at += cell[0]
            while taken.get(at, 0) > 0 and at < width:
                at += 1
            if at >= width:
                rows.append(row)
                row, at, r = [], 0, r + 1
                taken = {k: v - 1 for k, v in taken.items() if v > 1}
        if row:
            rows.append(row)
        head = "header" in b.options or "%header" in b.style
        if not head and len(rows) > 1 and body and body[0].strip() and len({x[4] for x in rows[0]}) == 1:
            line = rows[0][0][4]
            head = line == 0 and len(body) > 1 and not body[1].strip() and rows[1][0][4] > 1
        foot = "footer" in b.options
        parts = [("thead", rows[:1] if head else []), ("tbody", rows[head : len(rows) - foot]), ("tfoot", rows[len(rows) - foot :] if foot else [])]
        size = b.named.get("width")
        out = [f'<table style="width: {attr(size)};">' if size else "<table>"]
        out.append(f"<caption>{inline(b.title, self.c)}</caption>" if b.title else "")
        for tag, some in parts:
            if some:
                out.append(f"<{tag}>" + "".join("<tr>" + "".join(self.cell(x, tag == "thead") for x in cs) + "</tr>" for cs in some) + f"</{tag}>")
        return "".join(out) + "</table>"

    @staticmethod
    def columns(spec: str) -> list[str]:
        out = []
        for part in re.split("[,;]", spec):
            m = re.match(r"\s*(?:(\d+)\*)?(.*?)\s*$", part)
            out += [m.group(2)] * int(m.group(1) or 1)
        return out

    def cell(self, x: tuple, head: bool) -> str:
        cols, rows, style, content, _, _ = x
        tag = "th" if head or style == "h" else "td"
        spans = (f' colspan="{cols}"' if cols > 1 else "") + (f' rowspan="{rows}"' if rows > 1 else "")
        if style == "a" and not head:
            body = Reader(content.split("\n"), self.c).blocks()
            only = re.fullmatch(r"<p>((?:(?!</?p>).)*)</p>", body, re.DOTALL)
            body = body if not only else f"<p>{only.group(1)}</p>"
        elif style in ("l", "m"):
            body = f"<code>{text(content)}</code>"
        else:
            body = inline(content, self.c)
        return f"<{tag}{spans}>{body}</{tag}>"


def holds(kind: str, names: str, given: str, attributes: dict[str, str]) -> bool:
    """Whether a condition is true: of several names one (comma) or all (plus) must be set; two values are compared as numbers where both are, else as texts."""
    if kind == "ifeval":
        m = re.fullmatch(r"\s*(.+?)\s*(==|!=|<=|>=|<|>)\s*(.+?)\s*", re.sub(r"\{([\w-]+)\}", lambda x: attributes.get(x.group(1), ""), given))
        if m is None:
            return False
        a, b = (x.strip("\"'") for x in m.group(1, 3))
        if all(re.fullmatch(r"-?\d+(\.\d+)?", x) for x in (a, b)):
            a, b = float(a), float(b)
        return {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[m.group(2)]
    found = [n in attributes for n in re.split("[,+]", names) if n]
    some = all(found) if "+" in names else any(found)
    return some if kind == "ifdef" else not some


def conditioned(lines: list[str], known: dict[str, str]) -> list[str]:
    """The lines whose conditions are true. Attributes count from the line that sets them on; an end without a beginning is dropped."""
    attributes, open_, out = dict(known), [], []
    for line in lines:
        if m := _CONDITION.match(line):
            kind, names, given = m.groups()
            if kind == "endif":
                open_ = open_[:-1]
            elif kind != "ifeval" and given:
                if all(open_) and holds(kind, names, given, attributes):
                    out.append(given)
            else:
                open_.append(all(open_) and holds(kind, names, given, attributes))
        elif all(open_):
            if m := re.match(r"^:(!?)([\w-]+)(!?):(?:\s+(.*))?$", line):
                if m.group(1) or m.group(3):
                    attributes.pop(m.group(2), None)
                else:
                    attributes[m.group(2)] = (m.group(4) or "").strip()
            out.append(line)
    return out


def render(source: str, c: Context | None = None) -> tuple[str, dict[str, str], list[str]]:
    """Storage markup, the header's attributes, and the files to attach. Footnotes stand at the end."""
    c = c or Context()
    lines = re.split(r"\r\n|\r|\n", source or "")
    r = Reader(conditioned(lines, c.attributes) if source and "::" in source else lines, c)
    r.header()
    body = r.blocks()
    notes = "".join(f"<p>[{i}] {x}</p>" for i, x in enumerate(c.notes, 1))
    return body + (f"<hr/>{notes}" if notes else ""), c.attributes, list(dict.fromkeys(c.images))


def to_storage(files: DataFrame, titles: str | None = None, declared: str | None = None, path: str = "path", content: str = "content", root: str | None = None, deal: bool = True) -> DataFrame:
    """``files`` with storage, title, page_id and attachments.

    ``root`` names a column of the folder from which targets are seen as well; ``titles`` and ``declared`` name columns that a row brings along and that are left out of the result: maps from the files that it refers to, to their titles, and
    from the anchors that it refers to, to the files that declare them. ``deal`` is False where the rows are dealt already.
    """
    given = [c for c in (titles, declared, root) if c]
    keep = [c for c in files.columns if c not in given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            empty = [None] * batch.num_rows
            maps = [batch.column(c).to_pylist() if c else empty for c in (titles, declared, root)]
            for p, s, t, d, top in zip(batch.column(path).to_pylist(), batch.column(content).to_pylist(), *maps, strict=True):
                body, attributes, images = render(s, Context(p or "", dict(t or {}), dict(d or {}), root=top or ""))
                made.append((body, attributes.get("doctitle"), attributes.get("confluency-id"), images))
            columns = list(zip(*made, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(list(x), type=k) for x, k in zip(columns, kinds, strict=True))], names=[*keep, "storage", "title", "page_id", "attachments"])

    schema = T.StructType([*(files.schema[c] for c in keep), *T.StructType.fromDDL("storage string, title string, page_id string, attachments array<string>")])
    return (dealt(files) if deal else files).mapInArrow(run, schema)
