"""Histograms, bucket quantiles, and exact percentiles without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logwarden.operators.ordering import order_splits, with_bucket
from logwarden.schemas import RCA_BUCKETS

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def _bucket_counts(value: Column, bounds) -> list[Column]:
    return [F.count_if(value <= F.lit(float(b))) for b in bounds]


def histogram(df: DataFrame, column: str, keys: tuple = (), bounds=RCA_BUCKETS) -> DataFrame:
    """Rows (keys, le, cumulative, total, sum); ``le`` is text, the last one +Inf."""
    value = F.col(column)
    names = [f"{b:g}" for b in bounds] + ["+Inf"]
    wide = df.groupBy(*keys).agg(
        F.array(*_bucket_counts(value, bounds), F.count(value)).alias("_cells"),
        F.count(value).alias("total"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"),
    )
    labelled = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("le"), F.col("_cells").alias("n"))
    return wide.withColumn("_b", F.explode(labelled)).select(
        *keys, F.col("_b.le").alias("le"), F.col("_b.n").alias("cumulative"), "total", "sum"
    )


def _bucket_quantile(cells: Column, total: Column, q: float, bounds) -> Column:
    """Linear inside the first bucket that reaches the rank; the top finite bound beyond."""
    rank = total * F.lit(q)
    answer = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low = F.lit(float(bounds[i - 1]) if i else 0.0)
        high = F.lit(float(bounds[i]))
        before = cells[i - 1] if i else F.lit(0)
        inside = low + (high - low) * (rank - before) / F.nullif(cells[i] - before, F.lit(0))
        answer = F.when(cells[i] >= rank, F.coalesce(inside, low)).otherwise(answer)
    return F.when(total > 0, answer)


def histogram_quantiles(
    df: DataFrame, column: str, keys: tuple = (), bounds=RCA_BUCKETS, quantiles=QUANTILES
) -> DataFrame:
    """Quantiles estimated from the histogram, one column each; NULL without values.

    Keys are column names or (name, Column) pairs.
    """
    value = F.col(column)
    named = {k if isinstance(k, str) else k[0]: F.col(k) if isinstance(k, str) else k[1] for k in keys}
    wide = df.groupBy(*[c.alias(n) for n, c in named.items()]).agg(
        F.array(*_bucket_counts(value, bounds)).alias("_cells"), F.count(value).alias("total")
    )
    columns = [
        _bucket_quantile(F.col("_cells"), F.col("total"), q, bounds).alias(name)
        for name, q in quantiles.items()
    ]
    return wide.select(*named, "total", *columns)


def exact_percentiles(
    df: DataFrame, column: str, quantiles: dict[str, float], buckets: int | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation, 0.0 for an empty table.

    NULL is no value; NaN ranks above every number.

    Equal values are counted first, so a value of any frequency is one row. The
    distinct values are ranked per order bucket, and bucket totals give each
    bucket its offset; no task holds more than one bucket.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    placed = with_bucket(counts, "v", order_splits(counts, "v", buckets))
    totals = placed.groupBy("_bucket").agg(F.sum("n").alias("_n"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy()).alias("_total"),
    )
    running = W.partitionBy("_bucket").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        placed.withColumn("_up_to", F.sum("n").over(running))
        .join(offsets, "_bucket")
        .withColumn("_up_to", F.col("_up_to") + F.col("_offset"))
    )
    picks = []
    for name, q in quantiles.items():
        position = (F.col("_total") - 1) * F.lit(q)
        picks += [
            F.min(F.when(F.col("_up_to") > F.floor(position), F.col("v"))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_up_to") > F.ceil(position), F.col("v"))).alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_w_{name}"),
        ]
    chosen = ranked.agg(*picks)
    return chosen.select(
        *[
            F.coalesce(
                F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}"), F.lit(0.0)
            ).alias(n)
            for n in quantiles
        ]
    )
