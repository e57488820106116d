"""Rules on single values that both the document converters (Python) and tests use. Column forms are in ``columns``."""

from __future__ import annotations

import re

# The palette of named colours.
PALETTE = {
    "aqua": (0, 191, 191), "black": (0, 0, 0), "blue": (0, 0, 191), "fuchsia": (191, 0, 191), "gray": (96, 96, 96), "green": (0, 96, 0),
    "lime": (0, 191, 0), "maroon": (96, 0, 0), "navy": (0, 0, 96), "olive": (96, 96, 0), "purple": (96, 0, 96), "red": (191, 0, 0),
    "silver": (144, 144, 144), "teal": (0, 96, 96), "white": (191, 191, 191), "yellow": (191, 191, 0),
}
# Languages of the code macro, and other names of them.
LANGUAGES = (
    "actionscript3 applescript bash c# cpp css coldfusion delphi diff erl groovy xml java jfx js matlab php perl text powershell py ruby rust sql sass "
    "scala toml vb yml"
).split()
ALIASES = {
    "actionscript": "actionscript3", "as": "actionscript3", "osascript": "applescript", "sh": "bash", "zsh": "bash", "csharp": "c#", "cs": "c#",
    "hpp": "cpp", "cc": "cpp", "hh": "cpp", "c++": "cpp", "h++": "cpp", "cxx": "cpp", "hxx": "cpp", "dpr": "delphi", "dfm": "delphi",
    "pas": "delphi", "pascal": "delphi", "patch": "diff", "erlang": "erl", "html": "xml", "xhtml": "xml", "rss": "xml", "atom": "xml",
    "xjb": "xml", "xsd": "xml", "xsl": "xml", "plist": "xml", "svg": "xml", "jsp": "java", "javascript": "js", "jsx": "js", "json": "js",
    "pl": "perl", "pm": "perl", "plaintext": "text", "txt": "text", "ps": "powershell", "ps1": "powershell", "python": "py", "gyp": "py",
    "rb": "ruby", "gemspec": "ruby", "podspec": "ruby", "thor": "ruby", "irb": "ruby", "rs": "rust", "vbnet": "vb", "vbscript": "vb",
    "vbs": "vb", "yaml": "yml",
}
# The beginning of a line that is a directive wherever it stands, or is kept from being one by backslashes.
DIRECTIVE_LINE = re.compile(r"(?m)(?:^|(?<=\r))\\*(?=include::|(?:ifdef|ifndef|ifeval|endif)::[^\[\s]*\[[^\r\n]*\][^\S\r\n]*(?:[\r\n]|\Z))")


def nearest_colour(style: str) -> str | None:
    """The palette's name for ``color: name`` or ``color: rgb(r,g,b)``; none for black and what isn't a colour. Ties go by name."""
    value = style.strip().removeprefix("color:").strip()
    if value.startswith("rgb("):
        found = re.fullmatch(r"rgb\((\d{1,3}),(\d{1,3}),(\d{1,3})\)", value)
        if not found or any(int(x) > 255 for x in found.groups()):
            return None
        rgb = tuple(map(int, found.groups()))
        name = min(sorted(PALETTE), key=lambda k: sum((a - b) ** 2 for a, b in zip(PALETTE[k], rgb, strict=True)))
    else:
        name = value.lower()
    return name if name in PALETTE and name != "black" else None


def safe_folder(title: str | None) -> str:
    """A title as a folder's name."""
    name = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", (title or "").strip())
    name = re.sub(r"[. ]+$", "", name)
    return name if name.strip() else "page"


def code_language(name: str | None) -> str | None:
    lower = (name or "").lower()
    lower = ALIASES.get(lower, lower)
    return lower if lower in LANGUAGES else None


def relative_path(base: str, target: str) -> str:
    """``target`` as seen from folder ``base``; both are slash-separated and relative to one root."""
    a, b = [x for x in base.split("/") if x], [x for x in target.split("/") if x]
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    return "/".join([".."] * (len(a) - same) + b[same:])
