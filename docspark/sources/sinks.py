"""Sinks: files of converted pages, upserts of stored tables, archives."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.columns import attachment_key

from .rest import FileTree


def write_files(df: DataFrame, folder: str, path: str = "path", content: str = "content") -> None:
    """Each row's text or bytes as a file below ``folder``, a shared one; written by the executors.

    Different contents for one path, and paths that lead out of the folder, are errors and nothing is written; a write that fails on the way leaves nothing either.
    """
    rows = df.select(F.col(path).alias("path"), F.col(content).alias("content")).distinct()
    parts = F.split("path", r"[/\\\\]")
    bad = rows.groupBy("path").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col("path").isNull() | F.col("path").startswith("/") | F.array_contains(parts, ".."))
    if found := bad.select("path").limit(5).collect():
        raise ValueError("paths that several files share or that lead elsewhere: " + ", ".join(str(r.path) for r in found))

    spark = df.sparkSession
    spark.dataSource.register(FileTree)
    rows.write.format("file_tree").mode("append").save(folder)


def debug_files(pages: DataFrame, links: DataFrame | None = None, folder: str = "source") -> DataFrame:
    """(path, content) of what a page was made from: its storage markup, its rendered view, the whole row as JSON and its links."""
    at = F.concat(F.lit(f"{folder}/"), "page_id")
    kinds = [("storage.html", F.col("storage"))] + ([("view.html", F.col("view"))] if "view" in pages.columns else []) + [("json", F.to_json(F.struct(*pages.columns)))]
    files = F.array(*(F.struct(F.concat(at, F.lit(f".{k}")).alias("path"), v.alias("content")) for k, v in kinds))
    out = pages.select(F.explode(files).alias("f")).select("f.*").filter("content is not null")
    if links is None:
        return out
    rows = links.select("page_id", F.to_json(F.struct(*(c for c in links.columns if c != "page_id"))).alias("j"))
    told = rows.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("j")), "\n").alias("content"))
    return out.unionByName(told.select(F.concat(at, F.lit(".links.json")).alias("path"), "content"))


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``changes`` in place of those with the same keys, and the new ones added."""
    return stored.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def sent(attached: DataFrame) -> DataFrame:
    """(page_id, key, value): the properties by which attachments (page_id, name, bytes) that were sent are known again."""
    return attached.filter("bytes is not null").select("page_id", attachment_key("name").alias("key"), F.sha2("bytes", 256).alias("value"))


def unsent(attached: DataFrame, properties: DataFrame) -> DataFrame:
    """``attached`` without what its page has already, by the hash that is kept for the name."""
    rows = attached.filter("bytes is not null").withColumns({"_key": attachment_key("name"), "_value": F.sha2("bytes", 256)})
    known = properties.select("page_id", F.col("key").alias("_key"), F.col("value").alias("_value")).distinct()
    return rows.join(known, ["page_id", "_key", "_value"], "left_anti").select(*attached.columns)


def deleted(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def last_write(log: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """A key-value table from its writes: the last by ``order``; a null value is a delete."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(value), order).alias("_v")).select(*keys, F.col(f"_v.{value}").alias(value)).filter(F.col(value).isNotNull())


def add_labels(stored: DataFrame, more: DataFrame) -> DataFrame:
    """(page_id, labels): stored labels and the new ones, each once, in order."""
    both = stored.alias("s").join(more.alias("m"), "page_id", "full")
    empty = F.array().cast("array<string>")
    return both.select("page_id", F.array_union(F.coalesce("s.labels", empty), F.coalesce("m.labels", empty)).alias("labels"))


def archive(files: DataFrame, path: str = "path", content: str = "content") -> bytes:
    """A zip of a report's few files; for what fits the driver."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for row in files.select(path, content).orderBy(path).toLocalIterator():
            z.writestr(row[0], bytes(row[1]) if isinstance(row[1], (bytes, bytearray)) else row[1] or "")
    return out.getvalue()
