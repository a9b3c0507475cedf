"""Newest-first reads and last-write-wins views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (default, maximum) row counts of the reads.
INCIDENT_LIMITS = (20, 100)
RCA_LIMITS = (10, 50)
HISTORY_LIMITS = (15, 50)
RCA_VIEW = 50
CONSOLE_LINES = 100


Decode = Callable[[DataFrame], DataFrame]


def _newest(entries: DataFrame, order: str, count: int | None, limits: tuple[int, int], decode: Decode | None) -> DataFrame:
    """The newest raw entries, decoded only then: older ones are not parsed."""
    default, most = limits
    count = default if count is None else count
    if not 1 <= count <= most:
        raise ValueError(f"count must be between 1 and {most}")
    newest = entries.orderBy(F.desc(order)).limit(count)
    return newest if decode is None else decode(newest)


def recent_incidents(entries: DataFrame, count: int | None = None, order: str = "stream_id", decode: Decode | None = None) -> DataFrame:
    return _newest(entries, order, count, INCIDENT_LIMITS, decode)


def recent_rca(entries: DataFrame, count: int | None = None, order: str = "stream_id", decode: Decode | None = None) -> DataFrame:
    return _newest(entries, order, count, RCA_LIMITS, decode)


def recent_history(entries: DataFrame, count: int | None = None, order: str = "stream_id", decode: Decode | None = None) -> DataFrame:
    return _newest(entries, order, count, HISTORY_LIMITS, decode)


def latest_rca(df: DataFrame, order: str = "rca_id") -> DataFrame:
    """Of the newest 50 reports the last per incident, oldest incident first."""
    newest = df.orderBy(F.desc(order)).limit(RCA_VIEW)
    rest = [c for c in df.columns if c != "incident_id"]
    return (
        newest.groupBy("incident_id")
        .agg(F.min(order).alias("_first"), F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
        .orderBy("_first")
        .select("incident_id", "_row.*")
        .select(*df.columns)
    )


def console_tail(logs: DataFrame, order: str = "stream_id", lines: int = CONSOLE_LINES) -> DataFrame:
    """The newest lines, shown oldest first."""
    return logs.orderBy(F.desc(order)).limit(lines).orderBy(order)
