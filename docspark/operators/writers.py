"""AsciiDoc and Markdown text of block trees. A writer is a table from a node's kind to the rule that prints it."""

from __future__ import annotations

import re
from collections.abc import Callable

from docspark.functions.pure import DIRECTIVE_LINE

from .blocks import EDGE, Node

ALERTS = frozenset(("TIP", "WARNING", "CAUTION", "IMPORTANT"))
# Marks of admonitions inside table cells.
ALERT_MARKS = {"TIP": "💡", "WARNING": "⚠️", "CAUTION": "⚠️", "IMPORTANT": "❗"}


class Writer:
    """Blocks are joined by one blank line; what prints as nothing is left out."""

    def __init__(self):
        self.rules: dict[str, Callable[[Node], str]] = {n[3:]: getattr(self, n) for n in dir(self) if n.startswith("on_")}

    def __call__(self, blocks: list[Node]) -> str:
        return "\n\n".join(s for s in map(self.one, blocks) if s)

    def one(self, n: Node) -> str:
        return self.rules[n.kind](n)

    def run(self, nodes: list[Node]) -> str:
        return "".join(map(self.one, nodes))

    def on_paragraph(self, n: Node) -> str:
        return self.run(n.kids)

    def on_container(self, n: Node) -> str:
        return self(n.kids)

    def on_rule(self, n: Node) -> str:
        return "---"

    def on_text(self, n: Node) -> str:
        return n.text


def capped(level: int) -> str:
    """Levels print one deeper, at most six."""
    return min(level + 1, 6)


def listed(code: str) -> str:
    """Code without the end of its last line, which the closing fence's own line stands for."""
    return code[:-1] if code.endswith("\n") else code


class AsciiDoc(Writer):
    def on_heading(self, n: Node) -> str:
        return "=" * capped(n.a["level"]) + " " + self.run(n.kids)

    def on_list(self, n: Node, depth: int = 1) -> str:
        lines = []
        for item in n.kids:
            lines.append(("." if n.a["ordered"] else "*") * depth + " " + self.run(item.kids))
            lines += [self.on_list(b, depth + 1) if b.kind == "list" else "+\n" + self.one(b) for b in item.a["below"]]
        return "\n".join(lines)

    def on_tasks(self, n: Node) -> str:
        return "\n".join(f"* [{'x' if t.a['done'] else ' '}] {self.run(t.kids)}" for t in n.kids)

    @staticmethod
    def _title(title: str | None) -> str:
        return f".{title}\n" if title and title.strip() else ""

    def on_code(self, n: Node) -> str:
        language = n.a["language"]
        head = '[plantuml, format="png"]' if language == "plantuml" else f"[source, {language}]" if language else "[source]"
        inside = f"include::{n.a['path']}[]" if n.a["path"] is not None else DIRECTIVE_LINE.sub(r"\\\g<0>", listed(n.text))
        # longer than any line of dashes in the code
        fence = "-" * max([4, *(len(x) + 1 for x in re.findall(r"(?m)(?:^|(?<=\r))(-{4,})[^\S\r\n]*(?=[\r\n]|\Z)", n.text or ""))])
        return f"{self._title(n.a['title'])}{head}\n{fence}\n{inside}\n{fence}"

    def on_figure(self, n: Node, mark: str = "image::") -> str:
        a = n.a
        named = [f"{k}={a[k]}" for k in ("alt", "width", "height") if a.get(k)]
        inside = ",".join(named) if a.get("width") or a.get("height") else a.get("alt") or ""
        return f"{self._title(a.get('caption'))}{mark}{a['target']}[{inside}]"

    def on_image(self, n: Node) -> str:
        return self.on_figure(Node("figure", a=n.a | {"caption": None}), "image:")

    def on_anchor(self, n: Node) -> str:
        return f"[#{n.text}]"

    def on_toc(self, n: Node) -> str:
        return "toc::[]"

    def on_sectnums(self, n: Node) -> str:
        return ":sectnums:" + (f"\n:sectnumslevels: {n.a['levels']}" if n.a["levels"] else "")

    def on_include(self, n: Node) -> str:
        return f"include::{n.text}/index.adoc[]"

    def on_admonition(self, n: Node) -> str:
        return f"{self._title(n.a['title'])}[{n.a['name']}]\n====\n{self(n.kids)}\n===="

    def on_sidebar(self, n: Node) -> str:
        return f"{self._title(n.a['title'])}****\n{self(n.kids)}\n****"

    def on_table(self, n: Node, mark: str = "|") -> str:
        head, rest = n.kids[: n.a["leading"]], n.kids[n.a["leading"] :]
        lines = [f'[cols="{n.a["cols"]}"]', f"{mark}==="]
        lines += [" ".join(self._cell(c, mark) for c in r.kids) for r in head]
        lines += [""] * bool(head)
        for r in rest:
            lines += [*(self._cell(c, mark) for c in r.kids), ""]
        return "\n".join([*lines, f"{mark}==="])

    def _cell(self, c: Node, mark: str) -> str:
        cols, rows = c.a["colspan"], c.a["rowspan"]
        span = (str(cols) if cols > 1 else "") + (f".{rows}" if rows > 1 else "")
        span += "+" if span else ""
        if c.a["rich"]:
            return f"{span}a{mark}" + "\n\n".join(self.on_table(b, "!") if b.kind == "table" else self.one(b) for b in c.kids)
        return span + "h" * c.a["header"] + mark + self.run(c.kids).replace(mark, "\\" + mark)

    def on_bold(self, n: Node) -> str:
        return f"**{self.run(n.kids)}**"

    def on_italic(self, n: Node) -> str:
        return f"__{self.run(n.kids)}__"

    def on_underline(self, n: Node) -> str:
        return f"[.underline]##{self.run(n.kids)}##"

    def on_mono(self, n: Node) -> str:
        return f"`{self.run(n.kids)}`"

    def on_coloured(self, n: Node) -> str:
        return f"[.{n.a['colour']}]##{self.run(n.kids)}##"

    def on_link(self, n: Node) -> str:
        label = self.run(n.kids)
        if all(k.kind == "text" for k in n.kids):
            label = label.replace("]", "\\]")
        return f"link:{n.a['url']}[{label}]"

    def on_cross(self, n: Node) -> str:
        return f"<<{n.a['anchor']}, {n.text}>>"

    def on_status(self, n: Node) -> str:
        role = f"status-{n.a['colour'].lower()}" if n.a["colour"] is not None else "status"
        return f"[.{role}]#{n.text}#"

    def on_break(self, n: Node) -> str:
        return " +\n"


def _lines(text: str) -> list[str]:
    out = re.split(r"\r\n|\n|\r", text)
    return out[:-1] if out and out[-1] == "" else out


class Markdown(Writer):
    """GitHub's dialect; tables that it can't hold are printed as HTML."""

    def __init__(self, images: str | None = None):
        self.images = images if images and images.strip() else None
        super().__init__()

    def on_heading(self, n: Node) -> str:
        return "#" * capped(n.a["level"]) + " " + self.run(n.kids)

    def on_list(self, n: Node, indent: str = "") -> str:
        out = []
        for i, item in enumerate(n.kids, 1):
            mark = f"{i}." if n.a["ordered"] else "-"
            deeper = indent + " " * (len(mark) + 1)
            text = f"{indent}{mark} {self.run(item.kids)}"
            for b in item.a["below"]:
                text += "\n" + self.on_list(b, deeper) if b.kind == "list" else "\n\n" + "\n".join(deeper + x if x else x for x in _lines(self.one(b)))
            out.append(text)
        return "\n".join(out)

    def on_tasks(self, n: Node) -> str:
        return "\n".join(f"- [{'x' if t.a['done'] else ' '}] {self.run(t.kids)}" for t in n.kids)

    @staticmethod
    def escape(text: str) -> str:
        return re.sub(r"([\\`*_\[\]<])", r"\\\1", text)

    def _title(self, title: str | None) -> str:
        return f"**{self.escape(title)}**" if title and title.strip() else ""

    def on_code(self, n: Node) -> str:
        title = self._title(n.a["title"])
        return (f"{title}\n\n" if title else "") + f"```{n.a['language'] or ''}\n{listed(n.text)}\n```"

    def on_figure(self, n: Node) -> str:
        a = n.a
        target, caption = a["target"], (a.get("caption") or "").strip() and a["caption"]
        if self.images and not re.search("[/:]", target):
            target = f"{self.images}/{target}"
        text = caption or a.get("alt") or ""
        sizes = "".join(f' {k}="{a[k]}"' for k in ("width", "height") if (a.get(k) or "").strip())
        if sizes:
            return f'<img src="{target}" alt="{text}"{sizes}>'
        return f"![{text}]({target})" + (f"\n\n*{self.escape(caption)}*" if caption else "")

    def on_image(self, n: Node) -> str:
        return self.on_figure(Node("figure", a=n.a | {"caption": None}))

    def on_anchor(self, n: Node) -> str:
        return f'<a id="{n.text}"></a>'

    def on_toc(self, n: Node) -> str:
        return ""

    on_sectnums = on_toc

    def on_include(self, n: Node) -> str:
        return f"[{n.text}]({n.text}/index.md)"

    @staticmethod
    def _quoted(text: str) -> str:
        return "\n".join(f"> {x}" if x else ">" for x in _lines(text))

    def on_admonition(self, n: Node) -> str:
        name = (n.a["name"] or "").upper()
        parts = [f"[!{name if name in ALERTS else 'NOTE'}]", self._title(n.a["title"]), self(n.kids)]
        return self._quoted("\n".join(p for p in parts if p))

    def on_sidebar(self, n: Node) -> str:
        return self._quoted("\n".join(p for p in (self._title(n.a["title"]), self(n.kids)) if p))

    def on_table(self, n: Node) -> str:
        cells = [c.a for r in n.kids for c in r.kids]
        plain = n.a["leading"] <= 1 and not any(c["colspan"] > 1 or c["rowspan"] > 1 or c["rich"] for c in cells)
        return self._pipes(n) if plain else self._html(n)

    def _pipes(self, n: Node) -> str:
        rows = [[self.run(c.kids).replace("|", "\\|").replace("\n", "<br>") for c in r.kids] for r in n.kids]
        if not n.a["leading"]:
            rows.insert(0, [])
        width = max([1, *map(len, rows)]) if any(rows) else 1
        line = lambda cells: "|" + "".join(f" {c} |" for c in [*cells, *[""] * (width - len(cells))])
        return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])

    def _html(self, n: Node) -> str:
        out = ["<table>"]
        for i, r in enumerate(n.kids):
            out.append("  <tr>")
            for c in r.kids:
                tag = "th" if c.a["header"] or i < n.a["leading"] else "td"
                spans = "".join(f' {k}="{c.a[k]}"' for k in ("colspan", "rowspan") if c.a[k] > 1)
                inside = "<br>".join(map(self._as_html, c.kids)) if c.a["rich"] else self.run(c.kids)
                out.append(f"    <{tag}{spans}>{inside}</{tag}>")
            out.append("  </tr>")
        return "\n".join([*out, "</table>"])

    def _as_html(self, n: Node) -> str:
        """A block inside a cell, where Markdown's own blocks don't work."""
        join = lambda kids: "<br>".join(map(self._as_html, kids))
        if n.kind == "table":
            return self._html(n)
        if n.kind == "list":
            tag = "ol" if n.a["ordered"] else "ul"
            return f"<{tag}>" + "".join(f"<li>{self.run(i.kids)}</li>" for i in n.kids) + f"</{tag}>"
        if n.kind == "admonition":
            return ALERT_MARKS.get((n.a["name"] or "").upper(), "📝") + " " + join(n.kids)
        if n.kind == "container":
            return join(n.kids)
        if n.kind == "code":
            text = n.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            return f"<pre><code>{text}</code></pre>"
        if n.kind in ("paragraph", "figure"):
            return self.one(n)
        return self.one(n).replace("\n", "<br>")

    def on_text(self, n: Node) -> str:
        return self.escape(n.text)

    def _marked(self, mark: str, n: Node) -> str:
        """White space at the edges goes outside the marks."""
        text = self.run(n.kids)
        core = text.strip(EDGE)
        if not core:
            return text
        at = len(text) - len(text.lstrip(EDGE))
        return text[:at] + mark + core + mark + text[at + len(core) :]

    def on_bold(self, n: Node) -> str:
        return self._marked("**", n)

    def on_italic(self, n: Node) -> str:
        return self._marked("*", n)

    def on_underline(self, n: Node) -> str:
        return f"<u>{self.run(n.kids)}</u>"

    def on_mono(self, n: Node) -> str:
        return f"`{self._plain(n.kids)}`"

    def _plain(self, nodes: list[Node]) -> str:
        nested = ("bold", "italic", "mono", "underline")
        return "".join(k.text if k.kind == "text" else self._plain(k.kids) if k.kind in nested else self.one(k) for k in nodes)

    def on_coloured(self, n: Node) -> str:
        return f'<span style="color: {n.a["colour"]}">{self.run(n.kids)}</span>'

    def on_link(self, n: Node) -> str:
        label = self.run(n.kids)
        return "[{}]({})".format(label.replace("]", "\\]"), n.a["url"]) if label else f"<{n.a['url']}>"

    def on_cross(self, n: Node) -> str:
        return f"[{self.escape(n.text)}](#{n.a['anchor']})"

    def on_status(self, n: Node) -> str:
        return f"`{n.text}`"

    def on_break(self, n: Node) -> str:
        return "\\\n"


def writer(form: str, images: str | None = None) -> Writer:
    return Markdown(images) if output_format(form) == "md" else AsciiDoc()


def output_format(name: str | None) -> str:
    return "md" if (name or "").strip().lower() in ("md", "markdown") else "adoc"
