"""Registry of runnable queries and their reference SQL."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadvane.session import configure, scratch_folder
from leadvane.sources.bindings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def scratch(t: Tables) -> str:
    """A new folder below the shared checkpoint folder."""
    return scratch_folder(t.spark)


def view(name: str, sql: str) -> None:
    """Declare a named common table expression that oracles may use."""
    VIEWS[name] = sql


def _used(sql: str, seen: list[str]) -> None:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _used(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)


def with_views(sql: str) -> str:
    """``sql`` with a WITH clause holding every declared view it uses, in dependency order."""
    names: list[str] = []
    _used(sql, names)
    if not names:
        return sql
    views = "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    head, own = sql.strip(), ""
    if head.upper().startswith("WITH "):
        own, head = ", " + head[5:], ""
    return views + own + "\n" + head


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its oracle (None: rows-only check)."""
    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(configure(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def oracles() -> dict[str, str]:
    """Reference SQL of every query that has one, complete with the views it uses."""
    return {name: with_views(sql) for name, sql in ORACLES.items()}
