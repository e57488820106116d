"""Data sources in Python: a reader of paged JSON listings, and a writer of trees of files in two phases.

``paged_json`` reads what a server recorded, ``<folder>/<start>.json`` with ``{"results": [...]}`` of one page. It stands where a live reader would: the pager's rules (page size, stop at the first page that
is not there) are the same, and no server is called. A partition is a range of pages. The number of pages is found by doubling and halving, not by listing the folder. Filters on ``start`` drop pages
before they are opened, those on ``id`` and ``title`` drop items before they are written out again. Spark pushes filters to Python sources only where the session says so
(``spark.sql.python.filterPushdown.enabled``), and refuses a reader that takes some where it does not, so the option ``pushdown`` asks for it.

``file_tree`` writes each row (path, content: text or bytes) as a file. Tasks write into a staging folder beside the files; when all have ended, their files are moved into place, and when the job fails the staging
folder goes, so an aborted write leaves nothing. Attempts of a task have folders of their own, and only those that ended are moved. The folder must be one that all machines share.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Row
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringStartsWith,
    WriterCommitMessage,
)

#: Pages to a partition.
RANGE = 16


class Pages(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


def test_of(f: Filter) -> tuple[str, Callable[[object], bool]] | None:
    """The column of a filter and what its values must be; None for filters that the source leaves to Spark."""
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    known = {
        EqualTo: lambda v: v == f.value, In: lambda v: v in f.value, IsNotNull: lambda v: v is not None, StringStartsWith: lambda v: v.startswith(f.value), StringContains: lambda v: f.value in v,
        GreaterThan: lambda v: v > f.value, GreaterThanOrEqual: lambda v: v >= f.value, LessThan: lambda v: v < f.value, LessThanOrEqual: lambda v: v <= f.value,
    }
    by = known.get(type(f))
    return (column, by) if column in ("start", "id", "title") and by else None


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.size, self.range = options["path"], int(options.get("pagesize", 100)), int(options.get("pages", RANGE))
        self.tests: list[tuple[str, Callable[[object], bool]]] = []

    def page(self, n: int) -> Path:
        return Path(self.folder) / f"{n * self.size}.json"

    def count(self) -> int:
        """Pages from the first on without a gap: a bound by doubling, then the last by halving."""
        if not self.page(0).exists():
            return 0
        low, high = 0, 1
        while self.page(high).exists():
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.page(middle).exists() else (low, middle)
        return high

    def wanted(self, n: int) -> bool:
        return all(by(n * self.size) for column, by in self.tests if column == "start")

    def partitions(self) -> list[Pages]:
        n = self.count()
        out = [Pages(a, min(a + self.range, n)) for a in range(0, n, self.range)]
        return [p for p in out if any(self.wanted(i) for i in range(p.first, p.end))] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for n in range(partition.first, partition.end):
            if not self.wanted(n):
                continue
            for item in json.loads(self.page(n).read_text("utf-8")).get("results", []):
                one = {"id": None if item.get("id") is None else str(item["id"]), "title": item.get("title")}
                if all(one[c] is not None and by(one[c]) for c, by in self.tests if c != "start"):
                    yield n * self.size, one["id"], one["title"], json.dumps(item, ensure_ascii=False)


class FilteredReader(PagedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if (test := test_of(f)) is None:
                yield f
            else:
                self.tests.append(test)


class PagedJson(DataSource):
    """``spark.dataSource.register(PagedJson)``, then ``spark.read.format("paged_json").option("pagesize", 100).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "start long, id string, title string, json string"

    def reader(self, schema) -> PagedReader:
        return (FilteredReader if str(self.options.get("pushdown", "")).lower() == "true" else PagedReader)(self.options)


@dataclass
class Staged(WriterCommitMessage):
    """Where an attempt of a task has put its files."""

    folder: str


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.stage = str(Path(self.folder) / f".staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Staged:
        own = Path(self.stage) / uuid.uuid4().hex
        own.mkdir()  # fails where the job has been aborted meanwhile
        for path, content in iterator:
            if path is None or path.startswith("/") or ".." in path.replace("\\", "/").split("/"):
                raise ValueError(f"a path that leads elsewhere: {path}")
            file = own / path
            for folder in reversed(file.relative_to(own).parents):
                (own / folder).mkdir(exist_ok=True)
            file.write_bytes(bytes(content) if isinstance(content, (bytes, bytearray)) else (content or "").encode())
        return Staged(str(own))

    def commit(self, messages: list[Staged | None]) -> None:
        for m in messages:
            for folder, _, names in os.walk(m.folder) if m else ():
                target = Path(self.folder) / Path(folder).relative_to(m.folder)
                target.mkdir(parents=True, exist_ok=True)
                for name in names:
                    os.replace(Path(folder) / name, target / name)
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """Drops what is staged, also of attempts that were lost; tasks that still run find their folder gone and end."""
        for _ in range(100):
            shutil.rmtree(self.stage, ignore_errors=True)
            if not Path(self.stage).exists():
                break
            time.sleep(0.1)


class FileTree(DataSource):
    """``spark.dataSource.register(FileTree)``, then ``df.write.format("file_tree").mode("append").save(folder)``; a file that is there is replaced."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        made = TreeWriter(self.options)
        Path(made.stage).mkdir(parents=True)
        return made
