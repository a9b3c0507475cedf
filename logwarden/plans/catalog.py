"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.plans.derived import ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Widen integers and round doubles so that results compare across engines."""
    columns = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int"):
            col = col.cast("bigint")
        elif kind in ("float", "double"):
            col = F.round(col.cast("double"), 6) + F.lit(0.0)
        columns.append(col.alias(name))
    return df.select(*columns)


def query(name: str, tables: tuple = (), sql: str | None = None):
    """Register a query; ``tables`` are the derived tables its SQL refers to."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plain(build(spark, sf_dir))
        if sql is not None:
            head = f"WITH {ctes(*tables)}\n" if tables else ""
            ORACLES[name] = head + sql.strip()
        return build

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    from logwarden.plans import (  # noqa: F401
        detect_queries,
        ingest_queries,
        metric_queries,
        respond_queries,
        stream_queries,
    )
