"""Event-time rates and signature deduplication on streams.

Both need a watermark: rows later than ``delay`` behind the newest event time
are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELAY = "2 minutes"


def rate(
    events: DataFrame, key: str, time: str = "timestamp", width: str = "1 minute",
    slide: str | None = None, delay: str = DELAY,
) -> DataFrame:
    """Running (window_start, key, n) for the update or append output mode."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return (
        events.withWatermark(time, delay)
        .groupBy(window.alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), key, "n")
    )


def distinct_signatures(
    events: DataFrame, time: str = "timestamp", delay: str = DELAY, salts: int | None = None
) -> DataFrame:
    """First event of each (service, template) within the delay.

    A signature may fill a micro-batch, so its rows are first reduced per salt,
    spread over the tasks (as many as shuffle partitions), and the survivors per signature.
    """
    salts = salts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["service_name", "normalized_message"]
    salted = events.withWatermark(time, delay).withColumn("_salt", F.pmod(F.xxhash64(time), F.lit(salts)))
    return salted.dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt").dropDuplicatesWithinWatermark(keys)
