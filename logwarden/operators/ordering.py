"""Total order over a table without sorting it in one task.

Rows are placed in contiguous buckets of the order column. Boundaries come from
approximate quantiles, so buckets hold about the same number of rows whatever
the distribution of keys; results never depend on where the boundaries fall.
:func:`numbered` leaves the buckets to Spark's range partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logwarden.session import scratch_path

ROWS_PER_BUCKET = 2_000_000
#: Spark numbers rows by partition in the upper bits and by their place in it in these.
PLACE_BITS = 33


def stream_position(stream_id: Column) -> Column:
    """Sortable BIGINT of a ``<milliseconds>-<sequence>`` id or of a plain number."""
    parts = F.split(stream_id.cast("string"), "-")
    millis = parts[0].cast("bigint")
    seq = F.coalesce(F.get(parts, 1).cast("bigint"), F.lit(0))
    return F.when(F.size(parts) > 1, F.shiftleft(millis, 20) + seq).otherwise(millis)


def bucket_count(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, math.ceil(rows / rows_per_bucket))


def order_splits(df: DataFrame, order: str, buckets: int | None = None) -> list[float]:
    """Inner bucket boundaries, one number per ``ROWS_PER_BUCKET`` rows. NULL and NaN set none."""
    values = df.select(F.col(order).cast("double").alias("v")).filter(~F.isnan("v"))
    if buckets is None:
        buckets = bucket_count(values.count())
    if buckets <= 1:
        return []
    points = [i / buckets for i in range(1, buckets)]
    row = values.agg(F.percentile_approx("v", points, max(10_000, 10 * buckets)).alias("q")).first()
    return sorted(set(row["q"] or []))


def with_bucket(df: DataFrame, order: str, splits: list[float], name: str = "_bucket") -> DataFrame:
    """Add the bucket number; it grows with the order column.

    NULL comes before every number and NaN behind, as in Spark's own order. The bucket
    is found by halving steps over the boundaries.
    """
    if not splits:
        return df.withColumn(name, F.lit(0))
    edges = F.array(*[F.lit(float(x)) for x in splits])
    steps = [1 << b for b in reversed(range(len(splits).bit_length()))]

    def step_on(at: Column, step: Column) -> Column:
        fits = (at + step <= len(splits)) & (F.get(edges, at + step - 1) <= F.col(order).cast("double"))
        return F.when(fits, at + step).otherwise(at)

    return df.withColumn(name, F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step_on))


def numbered(df: DataFrame, *order: str | Column, name: str = "row_index") -> DataFrame:
    """Add the zero-based position of every row in the given order.

    Spark places rows in ranges of the order and sorts each range; ranges are written
    with the place of each row in its range, so that nothing is placed twice. A row's
    position is that place plus the sizes of the ranges before it: one row per range
    is added up and sent to the rows. Rows that tie are numbered in some order; a hot
    key is split over ranges if the order goes on with columns that differ in it.
    """
    at, part = f"_{name}_at", f"_{name}_part"
    spark = df.sparkSession
    path = scratch_path(spark, "numbered")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn(part, F.shiftright(at, PLACE_BITS))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    # One row per range partition of the shuffle, whatever the table.
    return rows.join(F.broadcast(offsets), part).withColumn(name, F.col("_offset") + place).drop(at, part, "_offset")


def row_index(df: DataFrame, order: str, name: str = "row_index") -> DataFrame:
    """Zero-based position in the order of a unique column."""
    return numbered(df, order, name=name)
