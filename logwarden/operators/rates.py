"""Event counts per tumbling or sliding window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "*"


def _with_total(counts: DataFrame, key: str) -> DataFrame:
    """Add a row per window over all keys, from the counts already made."""
    return (
        counts.groupingSets([[F.col("window_start"), F.col(key)], [F.col("window_start")]], "window_start", key)
        .agg(F.when(F.grouping(key) == 1, F.lit(ALL)).otherwise(F.col(key)).alias("_key"), F.sum("n").alias("n"))
        .select("window_start", F.col("_key").alias(key), "n")
    )


def event_rate(
    events: DataFrame, key: str, time: str = "timestamp", width: str = "1 minute", with_total: bool = True
) -> DataFrame:
    """(window_start, key, n) per tumbling window; key ``*`` is the total."""
    counts = events.groupBy(F.window(time, width)["start"].alias("window_start"), key).agg(
        F.count(F.lit(1)).alias("n")
    )
    return _with_total(counts, key) if with_total else counts


def sliding_rate(
    events: DataFrame,
    key: str,
    time: str = "timestamp",
    width_s: int = 60,
    step_s: int = 10,
    with_total: bool = True,
) -> DataFrame:
    """Counts per window of ``width_s`` seconds starting every ``step_s`` seconds.

    Rows are counted per step first; only those counts are copied into the
    windows that cover them.
    """
    if width_s % step_s:
        raise ValueError("width_s must be a multiple of step_s")
    steps = events.groupBy(F.window(time, f"{step_s} seconds")["start"].alias("_step"), key).agg(
        F.count(F.lit(1)).alias("n")
    )
    shifts = F.array(*[F.lit(i * step_s) for i in range(width_s // step_s)])
    placed = steps.withColumn("_shift", F.explode(shifts)).withColumn(
        "window_start", F.col("_step") - F.make_dt_interval(secs=F.col("_shift").cast("decimal(18,6)"))
    )
    counts = placed.groupBy("window_start", key).agg(F.sum("n").alias("n"))
    return _with_total(counts, key) if with_total else counts
