"""Per-service context: the newest rows, and the last K rows up to each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logwarden.operators.ordering import order_splits, with_bucket
from logwarden.schemas import CONTEXT_RING, CONTEXT_WINDOW


def ring_buffer(
    logs: DataFrame, keep: int = CONTEXT_RING, key: str = "service_name", order: str = "stream_id"
) -> DataFrame:
    """Newest ``keep`` rows per service; each task sends on at most that many per service."""
    newest = W.partitionBy(key).orderBy(F.desc(order))
    ranked = logs.withColumn("_n", F.row_number().over(newest))
    return ranked.filter(F.col("_n") <= keep).drop("_n")


def context_frames(
    logs: DataFrame,
    frame: Column,
    window_size: int = CONTEXT_WINDOW,
    key: str = "service_name",
    order: str = "stream_id",
    name: str = "context_window",
    splits: list[float] | None = None,
) -> DataFrame:
    """Add the last ``window_size`` frames of the row's service, oldest first, own row last.

    A service may hold any share of the rows, so rows are windowed per (service,
    order bucket). The last rows of earlier buckets, at most ``window_size`` - 1
    per service, are carried into each bucket first. ``splits`` are the bucket
    boundaries (``order_splits``), computed from ``logs`` when not given.
    """
    if window_size < 1:
        raise ValueError("window_size must be at least 1")
    rows = logs.withColumn("_frame", frame)
    if splits is None:
        splits = order_splits(logs, order)
    if not splits or window_size == 1:
        return _window(rows, window_size, [key], order, name).drop("_frame")
    back = window_size - 1
    placed = with_bucket(rows, order, splits)
    cell = W.partitionBy(key, "_bucket").orderBy(F.desc(order))
    tails = (
        placed.select(key, "_bucket", order, "_frame")
        .withColumn("_n", F.row_number().over(cell))
        .filter(F.col("_n") <= back)
        .groupBy(key, "_bucket")
        .agg(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_frame").alias("f"))).alias("_tail"))
        .withColumn("_tail", F.array_sort("_tail", lambda a, b: F.when(a["o"] < b["o"], -1).otherwise(1)))
    )
    # One row per (service, bucket that has rows); the last `back` of those before
    # a bucket always hold its carried rows.
    earlier = W.partitionBy(key).orderBy("_bucket").rowsBetween(-back, -1)
    carried = (
        tails.withColumn("_all", F.flatten(F.collect_list("_tail").over(earlier)))
        .filter(F.size("_all") > 0)
        .select(key, "_bucket", F.explode(F.slice("_all", -F.least(F.size("_all"), F.lit(back)), back)).alias("_c"))
        .select(key, "_bucket", F.col("_c.o").alias(order), F.col("_c.f").alias("_frame"))
    )
    both = placed.withColumn("_own", F.lit(True)).unionByName(
        carried.withColumn("_own", F.lit(False)), allowMissingColumns=True
    )
    framed = _window(both, window_size, [key, "_bucket"], order, name)
    return framed.filter("_own").drop("_own", "_bucket", "_frame")


def _window(rows: DataFrame, window_size: int, keys: list[str], order: str, name: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    slots = [F.lag("_frame", i).over(w) for i in range(window_size - 1, 0, -1)]
    return rows.withColumn(name, F.filter(F.array(*slots, F.col("_frame")), lambda x: x.isNotNull()))


def buffer_sizes(logs: DataFrame, keep: int = CONTEXT_RING, key: str = "service_name") -> DataFrame:
    return logs.groupBy(key).agg(F.least(F.count(F.lit(1)), F.lit(keep)).alias("frames"))


def known_services(logs: DataFrame, key: str = "service_name") -> DataFrame:
    return logs.select(key).distinct().orderBy(key)


def total_frames(logs: DataFrame, keep: int = CONTEXT_RING, key: str = "service_name") -> DataFrame:
    return buffer_sizes(logs, keep, key).agg(F.coalesce(F.sum("frames"), F.lit(0)).alias("total_frames"))


def clear_services(
    logs: DataFrame, clears: DataFrame, key: str = "service_name", order: str = "stream_id"
) -> DataFrame:
    """Drop the rows of a service at or before its last clear (service, cleared_at)."""
    last = clears.groupBy(key).agg(F.max("cleared_at").alias("_cleared"))
    return (
        logs.join(last, key, "left")
        .filter(F.col("_cleared").isNull() | (F.col(order) > F.col("_cleared")))
        .drop("_cleared")
    )


def clear_outcome(logs: DataFrame, clears: DataFrame, key: str = "service_name") -> DataFrame:
    """Whether each service asked to be cleared was known."""
    known = logs.select(key).distinct().withColumn("_known", F.lit(True))
    return clears.select(key).distinct().join(known, key, "left").select(
        key, F.coalesce("_known", F.lit(False)).alias("cleared")
    )


def explode_frames(incidents: DataFrame) -> DataFrame:
    """One row per context frame."""
    return incidents.select(
        "incident_id", F.posexplode("context_window").alias("position", "frame")
    ).select("incident_id", "position", "frame.*")
