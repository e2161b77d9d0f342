"""Registry of (query, SQL) pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.inputs import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables``; ``sql`` may use the CTEs of ``inputs``.

    ``sql`` is a SELECT, or further CTEs "a AS (...), b AS (...)" and a SELECT after "==".
    """

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            more, _, body = sql.rpartition("==")
            ctes = CTES + (f",\n{more.strip()}" if more.strip() else "")
            SQL[name] = f"WITH RECURSIVE {ctes}\n{body.strip()}"
        return fn

    return wrap
