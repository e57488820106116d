"""Incremental conversion of a growing folder: a file stream with state by page, so that only what changed is converted and a batch costs its own size.

The state of a page is the hash and the version of what it has now and the number of its changes. A page is passed on where its hash is another one than it has now, so a page that returns to an earlier text is
converted again; a version below the one that it has came late and is passed over. Rows without a version are taken as they come. State and results are committed together by the stream's checkpoint: a batch that is
run again gives the same rows once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docspark.operators.convert import to_text

STATE = "hash string, version double, change long"


def newest(frames: Iterator[pd.DataFrame]) -> tuple[float | None, str, str | None] | None:
    """(version, hash, text) of the row that wins: the greatest version, then the greatest hash; rows without a version are below all others."""
    best = None
    for frame in frames:
        for text, version in zip(frame["html"], frame["version"], strict=True):
            text = None if text is None or text != text else text
            row = (float("-inf") if version is None or version != version else float(version), hashlib.sha256((text or "").encode()).hexdigest(), text)
            best = row if best is None or row[:2] > best[:2] else best
    return best


def passed_on(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    found = newest(frames)
    if found is None:
        return
    version, digest, text = found
    now = state.get if state.exists else (None, float("-inf"), 0)
    known = version == float("-inf")
    if not known and version < now[1] or digest == now[0]:
        # late or unchanged; a later version of the same text counts as seen
        if digest == now[0] and version > now[1]:
            state.update((digest, version, now[2]))
        return
    state.update((digest, max(version, now[1]), now[2] + 1))
    yield pd.DataFrame({"page_id": [key[0]], "html": [text], "hash": [digest], "change": [now[2] + 1]})


def changed_pages(pages: DataFrame, order: str | None = None) -> DataFrame:
    """The rows of a stream (page_id, html) that change their page: page_id, html, hash, and change, the number of the page's changes. ``order`` names its version, a number or time."""
    version = F.col(order).cast("double") if order else F.lit(None).cast("double")
    rows = pages.select("page_id", "html", version.alias("version"))
    result = "page_id string, html string, hash string, change long"
    return rows.groupBy("page_id").applyInPandasWithState(passed_on, result, STATE, "append", GroupStateTimeout.NoTimeout)


def convert_stream(
    spark: SparkSession, source: str, target: str, state: str, schema: str = "page_id string, html string", form: str = "md", order: str | None = None
) -> StreamingQuery:
    """Convert pages that arrive as Parquet files in ``source``; ``target`` is a table in a shared folder, and ``state`` the stream's checkpoint."""
    pages = spark.readStream.schema(schema).parquet(source)
    made = to_text(changed_pages(pages, order), "html", form)
    return made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).option("path", target).trigger(availableNow=True).start()


def current(spark: SparkSession, state: str) -> DataFrame:
    """(page_id, hash, change): what each page has now, from the stream's state."""
    rows = spark.read.format("statestore").load(state)
    value = "value.groupState" if "groupState" in rows.schema["value"].dataType.names else "value"
    return rows.select("key.page_id", f"{value}.hash", f"{value}.change")


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The last conversion of every page."""
    rows = spark.read.parquet(target)
    return rows.groupBy("page_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "page_id")), "change").alias("r")).select("page_id", "r.*")
