"""Issue searches: a small part of the query language, as conditions on a table of issues. What is outside it is an error and never run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of fields that the issue table has under another name.
FIELDS = {"key": "issue_key", "issuekey": "issue_key", "issue": "issue_key", "project": "project_key", "issuetype": "issue_type", "type": "issue_type", "epic link": "epic_key", "fixversion": "fix_versions"}
TEXT = ("summary", "description")
TOKEN = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|(!=|!~|>=|<=|[=~<>(),])|([^\s"'=~<>!(),]+))""")


class SearchError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, value): word, text or sign."""
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise SearchError(f"Can't read the query at: {text[at:at + 20]}")
        quoted = m.group(1) if m.group(1) is not None else m.group(2)
        out.append(("text", re.sub(r"\\(.)", r"\1", quoted)) if quoted is not None else ("sign", m.group(3)) if m.group(3) else ("word", m.group(4)))
        at = m.end()
    return out


class Reader:
    """Recursive descent: or, and, not, brackets, comparisons, order by."""

    def __init__(self, text: str, df: DataFrame):
        self.left, self.df = tokens(text), df

    def word(self, *names: str) -> bool:
        """Takes the words if they come next."""
        if [v.lower() for k, v in self.left[: len(names)] if k == "word"] == list(names):
            del self.left[: len(names)]
            return True
        return False

    def sign(self, value: str) -> bool:
        if self.left[:1] == [("sign", value)]:
            del self.left[0]
            return True
        return False

    def take(self, what: str) -> str:
        if not self.left or self.left[0][0] == "sign":
            raise SearchError(f"The query lacks a {what}")
        return self.left.pop(0)[1]

    def column(self, name: str) -> str:
        found = FIELDS.get(name.lower(), re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower())
        if found not in self.df.columns:
            raise SearchError(f"Unknown field: {name}")
        return found

    def either(self) -> Column:
        out = self.both()
        while self.word("or"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.word("and"):
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.word("not"):
            return ~F.coalesce(self.one(), F.lit(False))
        if self.sign("("):
            out = self.either()
            if not self.sign(")"):
                raise SearchError("The query lacks a closing bracket")
            return out
        return self.comparison()

    def values(self) -> list[str]:
        if not self.sign("("):
            raise SearchError("A list begins with a bracket")
        out = [self.take("value")]
        while self.sign(","):
            out.append(self.take("value"))
        if not self.sign(")"):
            raise SearchError("The query lacks a closing bracket")
        return out

    def comparison(self) -> Column:
        name = self.take("field")
        if name.lower() == "text":
            if not self.sign("~"):
                raise SearchError("text is searched with ~")
            value = self.take("value").lower()
            parts = [F.lower(c).contains(value) for c in TEXT if c in self.df.columns]
            out = F.lit(False)
            for p in parts:
                out = out | F.coalesce(p, F.lit(False))
            return out
        c = F.col(self.column(name))
        same = lambda v: F.lower(c.cast("string")) == v.lower()
        if self.word("is", "not", "empty") or self.word("is", "not", "null"):
            return c.isNotNull()
        if self.word("is", "empty") or self.word("is", "null"):
            return c.isNull()
        if self.word("not", "in"):
            return ~F.lower(c.cast("string")).isin(*(v.lower() for v in self.values()))
        if self.word("in"):
            return F.lower(c.cast("string")).isin(*(v.lower() for v in self.values()))
        if self.sign("="):
            return same(self.take("value"))
        if self.sign("!="):
            return ~same(self.take("value"))
        if self.sign("~"):
            return F.lower(c.cast("string")).contains(self.take("value").lower())
        if self.sign("!~"):
            return ~F.lower(c.cast("string")).contains(self.take("value").lower())
        for sign, by in ((">=", c.__ge__), ("<=", c.__le__), (">", c.__gt__), ("<", c.__lt__)):
            if self.sign(sign):
                return by(F.lit(self.take("value")).try_cast(self.df.schema[self.column(name)].dataType))
        raise SearchError(f"No comparison after {name}")

    def order(self) -> list[Column]:
        out = []
        if self.word("order", "by"):
            while True:
                c = F.col(self.column(self.take("field")))
                down = self.word("desc")
                if not down:
                    self.word("asc")
                out.append(c.desc() if down else c.asc())
                if not self.sign(","):
                    break
        return out


def search(df: DataFrame, query: str) -> tuple[DataFrame, list[Column]]:
    """The rows of ``df`` for which the query holds, and the order that it asks for."""
    reader = Reader(query, df)
    rows = df if not reader.left or [v.lower() for _, v in reader.left[:2]] == ["order", "by"] else df.filter(reader.either())
    order = reader.order()
    if reader.left:
        raise SearchError(f"Can't read the query at: {reader.left[0][1]}")
    return rows, order
