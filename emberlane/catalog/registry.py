"""Registration of queries together with their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlane.catalog.views import VIEWS, Tables, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix the SQL with definitions of the views it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    definitions = ", ".join(f"{v} AS ({view_sql(v)})" for v in used)
    body = sql.strip()
    if not definitions:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {definitions}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {definitions}, {body[5:]}"
    return f"WITH {definitions} {body}"


def query(name: str, sql: str | None = None):
    """Register a function of the input tables; ``sql`` gives the same rows in DuckDB."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register
