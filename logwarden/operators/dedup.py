"""Repeated signatures (service, template)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.sources.tables import materialised

SIGNATURE = ("service_name", "normalized_message")


def first_ids(events: DataFrame, order: str = "stream_id") -> DataFrame:
    """First id and size of each signature, combined before the shuffle."""
    return events.groupBy(*SIGNATURE).agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("n"))


def flag_duplicates(events: DataFrame, order: str = "stream_id") -> DataFrame:
    """Add is_duplicate: true for all but the first event of its signature.

    The join is on the unique id, so a signature of any size stays spread out. Events are
    written once before, so that their messages are masked once.
    """
    events = materialised(events, "signatures")
    firsts = first_ids(events, order).select(F.col("first_id").alias(order), F.lit(True).alias("_first"))
    return events.join(firsts, order, "left").withColumn("is_duplicate", F.col("_first").isNull()).drop("_first")


def keep_first(events: DataFrame, order: str = "stream_id") -> DataFrame:
    """First event of each signature: rows are combined before the shuffle, nothing is joined."""
    rest = [c for c in events.columns if c not in SIGNATURE]
    firsts = events.groupBy(*SIGNATURE).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return firsts.select(*SIGNATURE, "_row.*").select(*events.columns)


def call_reduction(anomalies: DataFrame, order: str = "stream_id") -> DataFrame:
    """Share of analyser calls saved by asking once per signature, in percent."""
    return first_ids(anomalies, order).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("anomalies"), F.count(F.lit(1)).alias("signatures")
    ).withColumn(
        "reduction_pct",
        F.when(
            F.col("anomalies") > 0, (F.col("anomalies") - F.col("signatures")) / F.col("anomalies") * 100.0
        ).otherwise(F.lit(0.0)),
    )
