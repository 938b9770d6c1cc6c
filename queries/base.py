"""Registration of queries and the SQL beside them."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from queries.views import VIEWS, Tables
from quillwork.session import configure

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = (
    "sources", "upkeep", "filters", "joins", "aggregates", "sequences", "sorts", "sets",
    "functions", "streams", "extensions", "compositions",
)


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame`, with SQL over the tables and named views."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = with_views(sql)
        return fn

    return register


def rounded(expr: str, digits: int) -> str:
    """SQL that rounds by the binary value of a double, ties to the even digit."""
    s = f"{10**digits}::DOUBLE"
    big = "(x * 134217729::DOUBLE)"
    high = f"({big} - ({big} - x))"
    n = f"floor(x * {s})"
    gap = f"(({high} * (2 * {s}) - (2 * {n} + 1)) + (x - {high}) * (2 * {s}))"
    up = f"CASE WHEN {gap} > 0 OR ({gap} = 0 AND {n} % 2 <> 0) THEN {n} + 1 ELSE {n} END / {s}"
    return f"list_transform([{expr}], lambda x: {up})[1]"


def with_views(sql: str) -> str:
    """Put the views a statement names, and those they name, in front of it."""
    needed: list[str] = []

    def need(text: str, inside: str = "") -> None:
        for view in VIEWS:
            named = re.search(rf"\b(?:FROM|JOIN)\s+{view}\b", text)
            if named and view != inside and view not in needed:
                need(VIEWS[view], view)
                needed.append(view)

    need(sql)
    if not needed:
        return sql
    heads = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in needed)
    if sql.lstrip().startswith("WITH "):
        return f"WITH RECURSIVE {heads},\n{sql.lstrip().removeprefix('WITH ')}"
    return f"WITH RECURSIVE {heads}\n{sql}"


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"queries.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(configure(spark), sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
