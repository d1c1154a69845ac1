"""Registered queries: one Spark callable per inventory id and, where SQL can say it, an oracle."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Name a SQL relation which oracles may use like a table."""
    VIEWS[name] = sql.strip()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def with_views(sql: str) -> str:
    """Prefix a statement with the CTEs of all views it mentions, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    sql = sql.strip()
    visit(sql)
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order]
    if not ctes:
        return sql
    if sql[:5].lower() == "with ":
        return "WITH " + ",\n".join(ctes) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + sql


def oracles() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLES.items()}


def load() -> None:
    import importlib.util
    for part in (
        "views", "scans", "projections", "cleaning", "joins", "resampling", "windows", "sorting",
        "scalars", "labels", "lags", "evaluation", "trading", "checks", "fits", "jobs",
    ):
        if importlib.util.find_spec(f"{__name__}.{part}"):
            importlib.import_module(f"{__name__}.{part}")
