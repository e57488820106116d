"""JSON-RPC requests as a table: what is wrong with them, and which tool each calls, by a join with the table of tools.

Each line is read once. Lines that are no JSON, unknown methods, unknown tools and missing arguments get their replies here; a call that can be made gets its tool and arguments and no reply. A
notification has neither.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import ALL

# The protocol's error numbers.
NOT_JSON, NO_METHOD = -32700, -32601


def reply(key: Column, body: str, value: Column) -> Column:
    return F.concat(F.lit('{"jsonrpc": "2.0", "id": '), key, F.lit(f', "{body}": '), value, F.lit("}"))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def error(number: int, text: Column) -> Column:
    return F.concat(F.lit(f'{{"code": {number}, "message": '), quoted(text), F.lit("}"))


def failed(text: Column) -> Column:
    return F.concat(F.lit('{"content": [{"type": "text", "text": '), quoted(text), F.lit('}], "isError": true}'))


def answered(requests: DataFrame, line: str = "request", enabled: Iterable[str] | None = None) -> DataFrame:
    """``requests`` with tool, arguments (a map) and reply."""
    spark = requests.sparkSession
    names = set(ALL if enabled is None else enabled)
    tools = spark.createDataFrame([(t.name, list(t.required)) for t in ALL.values() if t.name in names], "_known string, _required array<string>")
    v = F.try_parse_json(line)
    part = lambda path, kind: F.try_variant_get(v, path, kind)
    rows = requests.withColumns({
        "_bad": v.isNull() | ~F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT"), "_id": F.to_json(part("$.id", "variant")), "_method": part("$.method", "string"),
        "_name": part("$.params.name", "string"), "arguments": F.coalesce(F.from_json(F.to_json(part("$.params.arguments", "variant")), "map<string,string>"), F.create_map().cast("map<string,string>")),
    })
    rows = rows.join(F.broadcast(tools), F.col("_name") == F.col("_known"), "left")  # one row a tool
    call = F.col("_method") == "tools/call"
    missing = F.array_except("_required", F.map_keys(F.map_filter("arguments", lambda k, v: F.coalesce(F.trim(v) != "", F.lit(False)))))
    says = F.when(F.col("_known").isNull(), F.concat(F.lit("Unknown tool: "), F.coalesce("_name", F.lit("")))).when(F.size(missing) > 0, F.concat(F.lit("Missing argument: "), F.array_join(missing, ", ")))
    made = (
        F.when(F.col("_bad"), reply(F.lit("null"), "error", error(NOT_JSON, F.lit("Parse error"))))
        .when(F.col("_id").isNull(), None)
        .when(F.col("_method") == "ping", reply(F.col("_id"), "result", F.lit("{}")))
        .when(call & says.isNotNull(), reply(F.col("_id"), "result", failed(says)))
        .when(~F.coalesce(F.col("_method").isin("ping", "initialize", "tools/list", "tools/call"), F.lit(False)), reply(F.col("_id"), "error", error(NO_METHOD, F.concat(F.lit("Method not found: "), F.coalesce("_method", F.lit("None"))))))
    )
    valid = call & says.isNull() & F.col("_id").isNotNull() & ~F.col("_bad")
    return rows.select(*requests.columns, F.when(valid, F.col("_known")).alias("tool"), F.when(valid, F.col("arguments")).alias("arguments"), made.alias("reply"))
