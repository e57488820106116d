"""Anonymised bundles of an export or of a tree of sources, and bug reports: tables of files, counts, archives."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.anonymize import anonymize_adoc, anonymize_html, anonymize_json
from docspark.operators.attachments import anonymize_attachments
from docspark.sources.sinks import archive

# The files of an export's ``source`` folder that go into a bundle.
PAGES = ("storage.html", "view.html")
RECORDS = ("page.json", "links.json")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def export_kind(path: Column) -> Column:
    """html, json or attachment; null for what stays out."""
    folder = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    kind = F.when(_name(path).isin(*PAGES), "html").when(_name(path).isin(*RECORDS), "json")
    return F.when(folder == "attache", "attachment").otherwise(kind)


def _texts(files: DataFrame, kind: str, by: Callable[..., DataFrame], key: str) -> DataFrame:
    rows = files.filter(F.col("kind") == kind).select("path", "kind", F.decode("bytes", "UTF-8").alias("_text"))
    return by(rows, "_text", key).select("path", "kind", F.encode("_text", "UTF-8").alias("bytes"))


def anonymized_export(files: DataFrame, key: str = "42") -> DataFrame:
    """(path, kind, bytes) of an export's files (path, bytes): pages and records with their names, attachments with new ones; others stay out."""
    rows = files.withColumn("kind", export_kind(F.col("path"))).filter("kind is not null")
    parts = F.split("path", "/")
    own = rows.filter("kind = 'attachment'").select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("_folder"), "kind", _name(F.col("path")).alias("_name"), "bytes")
    attached = anonymize_attachments(own, "_name", "bytes", key).select(F.concat_ws("/", "_folder", "_name").alias("path"), "kind", "bytes")
    return _texts(rows, "html", anonymize_html, key).unionByName(_texts(rows, "json", anonymize_json, key)).unionByName(attached)


def anonymized_import(files: DataFrame, key: str = "42") -> DataFrame:
    """(path, kind, bytes) of a tree of sources (path, bytes): AsciiDoc texts are anonymised, other files become stand-ins; all keep their paths."""
    rows = files.withColumn("kind", F.when(F.lower("path").endswith(".adoc"), "adoc").otherwise("other"))
    other = anonymize_attachments(rows.filter("kind = 'other'").withColumn("_name", _name(F.col("path"))), "_name", "bytes", key).select("path", "kind", "bytes")
    return _texts(rows, "adoc", anonymize_adoc, key).unionByName(other)


def counted(bundle: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row with the number of files of each kind."""
    return bundle.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


EXPORT_KINDS, IMPORT_KINDS = ("html", "json", "attachment"), ("adoc", "other")


#: Rows that a report may hold; a larger payload is a table of its own and not part of one.
PAYLOAD_ROWS = 10_000


def payload_lines(df: DataFrame) -> str:
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(PAYLOAD_ROWS + 1).collect()
    if len(rows) > PAYLOAD_ROWS:
        raise ValueError(f"more than {PAYLOAD_ROWS} rows")
    return "\n".join(r.j for r in rows)


def bug_report(fields: dict[str, str | None], payload: Callable[[], DataFrame] | None = None) -> dict[str, str]:
    """The files of a report: ``report.txt`` with every field that has a value, and ``payload.jsonl`` of a small table. A payload that fails is told of and nothing more."""
    lines = [f"{k}: {v}" for k, v in fields.items() if v and str(v).strip()]
    out = {}
    if payload is not None:
        try:
            out["payload.jsonl"] = payload_lines(payload())
        except Exception as e:
            lines.append(f"payload: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    return {"report.txt": "\n".join(lines) + "\n", **out}


def reports(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """(path, content) of a report of every row: a line for each field that has a value."""
    lines = F.array(*(F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"), F.lit("\n"))) for c in fields))
    return df.select(F.concat(F.col(name), F.lit("/report.txt")).alias("path"), F.array_join(F.filter(lines, lambda x: x.isNotNull()), "").alias("content"))


def report_archive(spark, files: dict[str, str]) -> bytes:
    return archive(spark.createDataFrame(list(files.items()), "path string, content string"))


def summary_json(counts: DataFrame) -> str:
    """A bundle's counts as one line."""
    return json.dumps(counts.first().asDict())
