"""From an element tree to a format-neutral block tree.

A block or an inline is a ``Node``: a kind, a text, attributes and children. Tags and macros have their builders in two registries; a tag
without one becomes a paragraph of its text, a macro without one is unwrapped if it has a body and dropped otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from docspark.functions.pure import DIRECTIVE_LINE, nearest_colour, safe_folder

from .dom import Element, Raw, SPACE, parse

EDGE = " \t\n\r\f\v\u00a0\u200b\ufeff\x1c\x1d\x1e\x1f"
# Macros that make a table cell hold blocks.
BLOCK_MACROS = frozenset(
    "note warning info tip panel code expand details plantuml drawio inc-drawio toc numberedheadings swagger open-api".split()
)
SILENT_MACROS = frozenset(("expandall", "detailssummary", "contentbylabel", "attachments"))
# Pictures of named emoticons.
EMOTICONS = {
    "tick": "✅", "check": "✅", "cross": "❌", "warning": "⚠️", "information": "ℹ️", "question": "❓", "thumbs-up": "👍",
    "thumbs-down": "👎", "plus": "➕", "minus": "➖", "yellow-star": "⭐", "star_yellow": "⭐",
}


@dataclass
class Node:
    kind: str
    text: str = ""
    kids: list[Node] = field(default_factory=list)
    a: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Options:
    """What a conversion may depend on besides the page: resolved links, direct children, names and limits."""

    links: dict = field(default_factory=dict)  # (kind, key, space) -> (title, url)
    children: tuple = ()  # (title, url)
    attachments: str = "attache"
    files: str | None = "files"
    colours: bool = True
    inline_lines: int = 10
    in_memory: bool = True
    issue_url: str = "https://jira.example.com/browse/"
    missing_url: str = "http://mock"
    bare_text: bool = False
    container_tags: frozenset = frozenset()


@dataclass
class State:
    """A conversion under way: options, heading level, table depth, files written so far."""

    options: Options
    level: int = 0
    depth: int = 0
    files: list = field(default_factory=list)
    numbers: dict = field(default_factory=dict)

    def below(self, level: int | None = None, deeper: int = 0) -> State:
        return State(self.options, self.level if level is None else level, self.depth + deeper, self.files, self.numbers)

    def number(self, what: str) -> int:
        self.numbers[what] = self.numbers.get(what, 0) + 1
        return self.numbers[what]


TAGS: dict[str, Callable[[Element, State], list[Node]]] = {}
MACROS: dict[str, Callable[[str, dict, Element | None, State], list[Node]]] = {}


def tags(*names: str):
    return lambda f: TAGS.update(dict.fromkeys(names, f)) or f


def macros(*names: str):
    return lambda f: MACROS.update(dict.fromkeys(names, f)) or f


# ---- blocks ----


def build(elements: Iterable[Element], state: State) -> list[Node]:
    """Blocks of sibling elements; a heading sets the level of those after it."""
    out, level = [], state.level
    for e in elements:
        out += block(e, state.below(level))
        if re.fullmatch(r"h[1-6]", e.name):
            level = int(e.name[1])
    return out


def block(e: Element, state: State) -> list[Node]:
    make = TAGS.get(e.name)
    if make is None and e.name in state.options.container_tags:
        make = container
    if make is not None:
        return make(e, state)
    text = e.text()
    return [Node("paragraph", kids=[Node("text", text)])] if text.strip(EDGE) else []


def paragraph(content: list[Node]) -> list[Node]:
    if len(content) == 1 and content[0].kind == "image":
        return [Node("figure", a=content[0].a | {"caption": None})]
    return [Node("paragraph", kids=content)] if content else []


@tags("p", "time", "ac:inline-comment-marker")
def _paragraph(e: Element, state: State) -> list[Node]:
    return paragraph(inline([e] if e.name != "p" else e.kids, state))


@tags("h1", "h2", "h3", "h4", "h5", "h6")
def _heading(e: Element, state: State) -> list[Node]:
    return [Node("heading", kids=inline(e.kids, state), a={"level": int(e.name[1])})]


@tags("ul", "ol")
def _list(e: Element, state: State) -> list[Node]:
    items = []
    for li in (k for k in e.elements() if k.name == "li"):
        own, below = [], []
        for k in li.kids:
            if isinstance(k, Element) and k.name in ("ul", "ol", "table"):
                below += block(k, state)
            else:
                own.append(k)
        items.append(Node("item", kids=inline(own, state), a={"below": below}))
    return [Node("list", kids=items, a={"ordered": e.name == "ol"})]


@tags("ac:task-list")
def _tasks(e: Element, state: State) -> list[Node]:
    items = []
    for task in e.all("ac:task"):
        status, text = task.first("ac:task-status"), task.first("ac:task-body")
        done = status is not None and status.text().lower() == "complete"
        items.append(Node("task", kids=inline(text.kids, state) if text else [], a={"done": done}))
    return [Node("tasks", kids=items)] if items else []


@tags("div", "ac:layout", "ac:layout-section", "ac:layout-cell")
def container(e: Element, state: State) -> list[Node]:
    kids: list[Node] = []
    if state.options.bare_text:
        for k in e.kids:
            if isinstance(k, str):
                kids += paragraph(inline([k], state))
            else:
                kids += build([k], state)
    else:
        kids = build(e.elements(), state)
    return [Node("container", kids=kids)]


@tags("ac:link")
def _link(e: Element, state: State) -> list[Node]:
    return paragraph(link(e, state))


@tags("ac:image")
def _image(e: Element, state: State) -> list[Node]:
    shown = image(e)
    caption = e.first("ac:caption")
    text = caption.text() if caption else ""
    return [Node("figure", a=shown.a | {"caption": text or None, "alt": None if text else shown.a["alt"]})]


@tags("img")
def _img(e: Element, state: State) -> list[Node]:
    return [Node("figure", a=image(e).a | {"caption": None})]


@tags("ac:placeholder")
def _nothing(e: Element, state: State) -> list[Node]:
    return []


# ---- tables ----


def _cells(row: Element) -> list[Element]:
    return [k for k in row.elements() if k.name in ("td", "th")]


def _span(cell: Element, name: str) -> int:
    value = cell.get(name).strip()
    return int(value) if value.isdigit() and int(value) > 0 else 1


def column_width(col: Element) -> int | None:
    """Pixels from the style, else the number in ``width``; None if there is none above 0."""
    found = re.search(r"width\s*:\s*(\d+(?:\.\d+)?)", col.get("style"))
    value = found.group(1) if found else re.sub(r"[^0-9.]", "", col.get("width"))
    try:
        width = int(float(value) + 0.5)
    except ValueError:
        return None
    return width if width > 0 else None


@tags("table")
def _table(e: Element, state: State) -> list[Node]:
    rows = [r for part in e.elements() if part.name in ("thead", "tbody", "tfoot") for r in part.elements() if r.name == "tr"]
    if state.depth > 1:  # a table in a table in a table is shown as text
        lines = [" | ".join(c.text() for c in _cells(r)) for r in rows]
        return [Node("code", "\n".join([lines[0] if lines else "", "", *lines[1:]]), a={"language": "text", "title": None, "path": None})]
    heads = [bool(_cells(r)) and all(c.name == "th" for c in _cells(r)) for r in rows]
    leading = heads.index(False) if False in heads else len(heads)
    if leading and leading == len(rows):
        leading -= 1
    count = max([1, *(sum(_span(c, "colspan") for c in _cells(r)) for r in rows)])
    cols = [column_width(c) for group in e.elements() if group.name == "colgroup" for c in group.elements() if c.name == "col"]
    widths = cols if len(cols) == count and None not in cols else [1] * count
    made = [Node("row", kids=[_cell(c, state, i < leading) for c in _cells(r)]) for i, r in enumerate(rows)]
    return [Node("table", kids=made, a={"cols": ",".join(f"{w}a" for w in widths), "leading": leading})]


def _cell(c: Element, state: State, in_head: bool) -> Node:
    below = [x for k in c.elements() for x in k.walk()]
    rich = (
        any(x.name in ("table", "ul", "ol") for x in below)
        or sum(k.name == "p" for k in c.elements()) > 1
        or any(x.name == "ac:structured-macro" and x.get("ac:name") in BLOCK_MACROS for x in below)
    )
    a = {"colspan": _span(c, "colspan"), "rowspan": _span(c, "rowspan"), "header": c.name == "th" and not in_head, "rich": rich}
    return Node("cell", kids=build(c.elements(), state.below(deeper=1)) if rich else inline(c.kids, state), a=a)


# ---- inline ----


def inline(nodes: Iterable, state: State) -> list[Node]:
    """Inlines of nodes, without white space and breaks at the edges."""
    out: list[Node] = []
    for n in nodes:
        _add(out, n, state)
    for at, strip in ((0, str.lstrip), (-1, str.rstrip)):
        while out and (out[at].kind == "break" or out[at].kind == "text"):
            text = strip(out[at].text, EDGE)
            if out[at].kind == "text" and text:
                out[at] = Node("text", text)
                break
            out.pop(at)
    return out


def _children(e: Element, state: State) -> list[Node]:
    out: list[Node] = []
    for n in e.kids:
        _add(out, n, state)
    return out


WRAPS = {"i": "italic", "em": "italic", "u": "underline", "code": "mono", "tt": "mono", "strong": "bold", "b": "bold"}


def _add(out: list[Node], n: Element | str, state: State) -> None:
    if isinstance(n, str):
        text = n if isinstance(n, Raw) else SPACE.sub(" ", n)
        if text:
            out.append(Node("text", text))
        return
    name = n.name
    if name in WRAPS:
        out.append(Node(WRAPS[name], kids=_children(n, state)))
    elif name == "span" and state.options.colours and (colour := _colour(n.get("style"))):
        out.append(Node("coloured", kids=_children(n, state), a={"colour": colour}))
    elif name == "a":
        out.append(Node("link", kids=_children(n, state), a={"url": n.get("href")}))
    elif name == "br":
        out.append(Node("break"))
    elif name == "ac:link":
        out += link(n, state)
    elif name in ("ac:image", "img"):
        out.append(image(n))
    elif name == "time":
        if n.get("datetime"):
            out.append(Node("text", n.get("datetime")))
    elif name == "ac:emoticon":
        if shown := emoticon(n):
            out.append(Node("text", shown))
    elif name == "ac:placeholder":
        pass
    elif name == "ac:structured-macro":
        kind, params = n.get("ac:name"), parameters(n)
        if kind == "jira":
            out.append(Node("link", a={"url": f"{state.options.issue_url}{inner(params.get('key'))}"}))
        elif kind == "profile":
            user = n.first("ri:user")
            out += user_link(user.get("ri:userkey") if user else "", state)
        elif kind == "status" and (badge := status(params)):
            out.append(badge)
    else:
        out += _children(n, state)


def _colour(style: str) -> str | None:
    for part in style.split(";"):
        if part.startswith("color:") and (colour := nearest_colour(part)):
            return colour
    return None


def emoticon(e: Element) -> str:
    """The fallback text, else the code point, else the picture of the name, else the short name."""
    if e.get("ac:emoji-fallback"):
        return e.get("ac:emoji-fallback")
    if re.fullmatch(r"[0-9a-fA-F]{1,6}", e.get("ac:emoji-id")) and int(e.get("ac:emoji-id"), 16) < 0x110000:
        return chr(int(e.get("ac:emoji-id"), 16))
    return EMOTICONS.get(e.get("ac:name")) or e.get("ac:emoji-shortname")


def image(e: Element) -> Node:
    if e.name == "img":
        target, size = re.split(r"[/\\]", e.get("src").rstrip("/\\"))[-1], (None, None)
    else:
        file = e.first("ri:attachment")
        target, size = file.get("ri:filename") if file else "", (e.get("ac:width") or None, e.get("ac:height") or None)
    return Node("image", a={"target": target, "alt": e.text() or None, "width": size[0], "height": size[1]})


# ---- links ----


def link_key(e: Element) -> tuple[str, str, str | None] | None:
    """(kind, key, space) of what an ``ac:link`` points to: a user, else a page, else an attachment."""
    if user := e.first("ri:user"):
        return "user", user.get("ri:userkey"), None
    if page := e.first("ri:page"):
        texts = [x.text() for x in e.all("ac:plain-text-link-body")]
        title = " ".join(texts) if any(t.strip() for t in texts) else page.get("ri:content-title")
        anchor = e.get("ac:anchor")
        return "page", f"{title}#{anchor}" if anchor else title, page.get("ri:space-key")
    if file := e.first("ri:attachment"):
        return "attachment", file.get("ri:filename"), None
    return None


def describe(key: tuple[str, str, str | None]) -> str:
    """The label of a link that is not resolved."""
    kind, name, space = key
    fields = {"page": f"title={name}, space={space or ''}", "user": f"userKey={name}", "attachment": f"fileName={name}"}[kind]
    return f"Links{kind.capitalize()}[{fields}]"


def _resolved(key: tuple[str, str, str | None], state: State) -> Node:
    hit = state.options.links.get(key)
    if hit is None:
        return Node("link", kids=[Node("text", describe(key))], a={"url": state.options.missing_url})
    title, url = hit
    if key[0] == "attachment":
        url = f"{state.options.attachments}/{title}"
    return Node("link", kids=[Node("text", title)], a={"url": url})


def user_link(user_key: str, state: State) -> list[Node]:
    return [_resolved(("user", user_key, None), state)] if user_key.strip() else []


def link(e: Element, state: State) -> list[Node]:
    key = link_key(e)
    if key is not None:
        return [_resolved(key, state)]
    body = e.first("ac:plain-text-link-body")
    return [Node("cross", body.text(), a={"anchor": e.get("ac:anchor")})] if body else []


def links_of(root: Element, diagrams: bool = False) -> list[tuple[str, str, str | None]]:
    """Distinct link keys of a page, in order; with ``diagrams`` also the diagrams that it shows."""
    out: dict[tuple, None] = {}
    for e in root.walk():
        if diagrams and e.name == "ac:structured-macro" and e.get("ac:name") in ("drawio", "inc-drawio") and (name := diagram_name(parameters(e))):
            out["diagram", name, None] = None
        key = link_key(e) if e.name == "ac:link" else None
        if e.name == "ac:structured-macro" and e.get("ac:name") == "profile" and (user := e.first("ri:user")) and user.get("ri:userkey").strip():
            key = "user", user.get("ri:userkey"), None
        if key is not None:
            out[key] = None
    return list(out)


# ---- macros ----


def parameters(e: Element) -> dict[str, Element]:
    out: dict[str, Element] = {}
    for k in e.elements():
        if k.name == "ac:parameter":
            out.setdefault(k.get("ac:name"), k)
    return out


def inner(parameter: Element | None) -> str | None:
    return None if parameter is None else parameter.whole_text()


def _present(parameter: Element | None) -> str | None:
    value = inner(parameter)
    return None if value is None or not value.strip() or value == "null" else value


@tags("ac:structured-macro")
def _macro(e: Element, state: State) -> list[Node]:
    name = e.get("ac:name")
    bodies = {k.name: k for k in reversed(e.elements())}
    body = bodies.get("ac:rich-text-body") or bodies.get("ac:plain-text-body")
    make = MACROS.get(name)
    if make is not None:
        return make(name, parameters(e), body, state)
    return [] if name in SILENT_MACROS else _inside(body, state)


def _inside(body: Element | None, state: State) -> list[Node]:
    return build(body.elements(), state) if body is not None else []


def _titled(params: dict, body: Element | None, state: State) -> list[Node]:
    title = inner(params.get("title"))
    head = [Node("heading", kids=[Node("text", title)], a={"level": state.level + 1})] if title else []
    return head + _inside(body, state)


@macros("expandall", "detailssummary", "contentbylabel", "attachments")
def _silent(name, params, body, state):
    return []


@macros("details")
def _details(name, params, body, state):
    return _inside(body, state)


@macros("expand", "ui-expand", "excerpt", "ui-tab")
def _expand(name, params, body, state):
    return _titled(params, body, state)


@macros("ui-steps")
def _steps(name, params, body, state):
    return _inside(body, state)


@macros("ui-step", "ui-tabs")
def _step(name, params, body, state):
    return [Node("rule"), *_inside(body, state)]


@macros("anchor")
def _anchor(name, params, body, state):
    value = (inner(params.get("")) or next((inner(p) for p in params.values()), "") or "").strip()
    return [Node("anchor", value)] if value else []


@macros("children")
def _child_list(name, params, body, state):
    items = [Node("item", kids=[Node("link", kids=[Node("text", t)], a={"url": u})], a={"below": []}) for t, u in state.options.children]
    return [Node("list", kids=items, a={"ordered": False})] if items else []


def _store(text: str, file: str, state: State, always: bool = False) -> str | None:
    if state.options.in_memory or not always and text.count("\n") <= state.options.inline_lines:
        return None
    path = f"{state.options.files}/{file}" if state.options.files else file
    state.files.append((path, text))
    return path


def code_text(body: Element | None) -> str:
    """The text of a code macro: of one in CDATA every character, white space at its ends too."""
    if body is None:
        return ""
    raw = [k for k in body.kids if isinstance(k, Raw)]
    if raw and all(isinstance(k, Raw) or isinstance(k, str) and not k.strip() for k in body.kids):
        return "".join(raw)
    return body.text()


def _store_code(text: str, file: str, state: State) -> str | None:
    """Where long code goes; code with lines that a file's reader would take for directives stays in the page, where they are escaped.

    The end of the last line is left out, unless an empty line is the last.
    """
    text = text[:-1] if text.endswith("\n") and not text.endswith("\n\n") else text
    return None if DIRECTIVE_LINE.search(text) else _store(text, file, state)


@macros("code")
def _code(name, params, body, state):
    text = code_text(body)
    title, language = _present(params.get("title")), inner(params.get("language"))
    if language is None:
        language = {"{": "json", "<": "xml"}.get(text.lstrip(" \t\n\r")[:1])
    file = (title or "include_file") + f"_{state.number('code')}" + (f".{language}" if language else "")
    return [Node("code", text, a={"language": language, "title": title, "path": _store_code(text, file, state)})]


@macros("plantuml")
def _plantuml(name, params, body, state):
    text = body.text() if body is not None else ""
    title = _present(params.get("title"))
    file = f"{title or 'plantuml'}_{state.number('plantuml')}.puml"
    return [Node("code", text, a={"language": "plantuml", "title": title, "path": _store_code(text, file, state)})]


@macros("swagger", "open-api")
def _swagger(name, params, body, state):
    text = body.whole_text().strip() if body is not None else ""
    if not text:
        return []
    language = "json" if text.startswith("{") else "yaml"
    path = _store(text, f"swagger_{state.number('swagger')}.{language}", state, always=True)
    if path is None:
        return [Node("code", text, a={"language": language, "title": None, "path": None})]
    return [Node("paragraph", kids=[Node("link", kids=[Node("text", "OpenAPI спецификация (swagger)")], a={"url": path})])]


# Fixed value: what stands for a diagram that nothing can be shown of.
NO_DIAGRAM = "Diagram attachment access error: cannot display diagram"


def diagram_name(params: dict) -> str:
    return (_present(params.get("diagramName")) or _present(params.get("diagramDisplayName")) or "").strip()


@macros("drawio", "inc-drawio")
def _drawio(name, params, body, state):
    """The file that was found for the diagram, where someone looked; else the name that it would have."""
    diagram = diagram_name(params)
    if not diagram:
        return []
    if ("diagram", diagram, None) in state.options.links:
        file = state.options.links["diagram", diagram, None][1]
        if file is None:
            return paragraph([Node("text", NO_DIAGRAM)])
    else:
        file = f"{diagram if diagram.endswith('.drawio') else f'{diagram}.drawio'}.png"
    return [Node("figure", a={"target": file, "alt": diagram, "width": None, "height": None, "caption": None})]


@macros("include", "excerpt-include")
def _include(name, params, body, state):
    target = next((e for p in params.values() if (e := p.first("ac:link"))), None)
    if target is None:
        return []
    page = target.first("ri:page")
    title = page.get("ri:content-title") if page else ""
    if name == "include" and title.strip():
        return [Node("include", safe_folder(title))]
    return paragraph(link(target, state))


@macros("jira")
def _jira(name, params, body, state):
    return [Node("paragraph", kids=[Node("link", a={"url": f"{state.options.issue_url}{inner(params.get('key'))}"})])]


@macros("numberedheadings")
def _numbered(name, params, body, state):
    return [Node("sectnums", a={"levels": _present(params.get("start-numbering-with"))}), *_inside(body, state)]


@macros("note", "info", "tip", "warning")
def _admonition(name, params, body, state):
    kind = {"warning": "WARNING", "tip": "TIP"}.get(name, "NOTE")
    return [Node("admonition", kids=_inside(body, state), a={"name": kind, "title": inner(params.get("title"))})]


@macros("panel")
def _panel(name, params, body, state):
    return [Node("sidebar", kids=_inside(body, state), a={"title": inner(params.get("title"))})]


@macros("profile")
def _profile(name, params, body, state):
    user = params["user"].first("ri:user") if "user" in params else None
    return paragraph(user_link(user.get("ri:userkey") if user else "", state))


def status(params: dict) -> Node | None:
    colour, title = _present(params.get("colour")), _present(params.get("title"))
    text = title or colour
    return Node("status", text, a={"colour": colour}) if text else None


@macros("status")
def _status(name, params, body, state):
    badge = status(params)
    return [Node("paragraph", kids=[badge])] if badge else []


@macros("toc")
def _toc(name, params, body, state):
    return [Node("toc")]


def convert(markup: str | None, options: Options | None = None) -> tuple[list[Node], State]:
    """Blocks of a page or fragment, and the conversion's end state with the files it set aside."""
    from .dom import body

    state = State(options or Options())
    root = parse(markup)
    return build(body(root), state), state
