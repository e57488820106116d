"""Configuration: a JSON text, then the environment, then arguments; later ones win. ``${NAME}`` in a value is taken from the environment."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Settings that the environment or an argument may give.
SETTINGS = {"bindHost": "127.0.0.1", "port": 8080, "transport": "stdio", "defaultJiraProject": None, "defaultConfluenceSpace": None}
LISTS = ("endpoints", "team", "templates")


def expanded(value, env: dict[str, str]):
    """``value`` with every ``${NAME}`` replaced; names that are not set are empty."""
    if isinstance(value, str):
        return re.sub(r"\$\{([^}]*)\}", lambda m: env.get(m.group(1), ""), value)
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    return [expanded(v, env) for v in value] if isinstance(value, list) else value


def variable(name: str, prefix: str = "DOCSPARK_") -> str:
    """The environment's name of a setting: bindHost is DOCSPARK_BIND_HOST."""
    return prefix + re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).upper()


def read_config(text: str | None, env: dict[str, str] | None = None, argv: list[str] | None = None) -> dict:
    """All settings, and the lists of endpoints, team members and templates. Arguments are ``--name=value`` or ``--name value``."""
    env = env or {}
    given = expanded(json.loads(text), env) if text and text.strip() else {}
    out = SETTINGS | {k: given.get(k) or [] for k in LISTS} | {k: v for k, v in given.items() if v is not None}
    out |= {k: env[variable(k)] for k in SETTINGS if env.get(variable(k), "").strip()}
    words = iter(argv or [])
    for word in words:
        name, joined, value = word.removeprefix("--").partition("=")
        if word.startswith("--") and name in SETTINGS:
            out[name] = value if joined else next(words, None)
    out["port"] = int(out["port"])
    return out


def rows_of(config: dict, name: str, columns: tuple[str, ...]) -> list[tuple]:
    """A configured list as rows, missing fields null and blank ones too, for a small table."""
    return [tuple(x.get(c) if x.get(c) not in ("", None) else None for c in columns) for x in config.get(name) or []]


def expanded_text(text: Column, env: dict[str, str]) -> Column:
    """``expanded`` for a column."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{([^}]*)\}"), F.lit(1)))
    known = F.create_map(*(F.lit(x) for pair in env.items() for x in pair)).cast("map<string,string>")
    return F.aggregate(names, text, lambda t, n: F.replace(t, F.concat(F.lit("${"), n, F.lit("}")), F.coalesce(F.try_element_at(known, n), F.lit(""))))


def endpoints_of(df: DataFrame, env: dict[str, str], json: str = "json") -> DataFrame:
    """``df`` without ``json``, with ord, host and kind of every endpoint of a table of configurations; blank fields are null."""
    found = F.from_json(F.col(json), "endpoints array<struct<host:string,kind:string>>")["endpoints"]
    rows = df.select(*(c for c in df.columns if c != json), F.posexplode(found).alias("ord", "_e"))
    value = lambda c: F.nullif(F.trim(expanded_text(F.col(f"_e.{c}"), env)), F.lit(""))
    return rows.withColumns({"host": value("host"), "kind": value("kind")}).drop("_e")
