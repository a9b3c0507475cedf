"""Forests that are refitted as rows come in: each version learns from the newest rows before it.

Row ``i`` (in id order) is scored by version ``i // every``, which is fitted on the ``newest`` rows
before row ``version * every``. Versions and scores follow from the ids alone, so batch and
stream agree whatever the sizes of files. All versions of a run are fitted in one job and
applied in one job, as forests per version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions.scoring import anomaly_score
from logwarden.operators import service_forests
from logwarden.operators.ordering import row_index

EVERY = 1000
NEWEST = 1000


def versioned(rows: DataFrame, every: int = EVERY, at: str = "row_index") -> DataFrame:
    """Add ``version``, by which each row is scored; 0 means before the first fit."""
    return rows.withColumn("version", F.floor(F.col(at) / every))


def training_rows(rows: DataFrame, first: int, last: int, every: int = EVERY, newest: int = NEWEST, at: str = "row_index") -> DataFrame:
    """Each row once per version from ``first`` to ``last`` that learns from it, with ``fit_version``.

    A row belongs to at most ``newest / every`` versions, rounded up.
    """
    low = F.greatest(F.floor(F.col(at) / every) + 1, F.lit(max(first, 1)))
    high = F.least(F.floor((F.col(at) + newest) / every), F.lit(last))
    versions = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("fit_version", F.explode(versions))


def fit_versions(rows: DataFrame, first: int, last: int, every: int = EVERY, newest: int = NEWEST, key: str = "stream_id") -> DataFrame:
    """Node tables of the versions ``first`` to ``last``; ``rows`` hold row_index, the key and ``vector``."""
    chosen = training_rows(rows, first, last, every, newest)
    named = chosen.select(F.col("fit_version").cast("string").alias("version"), key, "vector")
    return service_forests.fit(named, key, "version", min_rows=service_forests.MIN_ROWS)


def score_versions(rows: DataFrame, nodes: DataFrame, every: int = EVERY, key: str = "stream_id") -> DataFrame:
    """(key, version, anomaly_score) of rows with row_index; 0.0 before the first version."""
    named = versioned(rows, every).withColumn("version", F.col("version").cast("string"))
    scored = service_forests.score(named, nodes, None, "version", key)
    return scored.select(key, F.col("version").cast("bigint").alias("version"), F.coalesce(anomaly_score(F.col("raw_score")), F.lit(0.0)).alias("anomaly_score"))


def rolling_scores(vectors: DataFrame, every: int = EVERY, newest: int = NEWEST, key: str = "stream_id") -> DataFrame:
    """(key, version, anomaly_score) of every row of a table with the key and ``vector``."""
    rows = row_index(vectors.select(key, "vector"), key)
    if min(every, newest) < service_forests.MIN_ROWS:
        raise ValueError(f"a version needs at least {service_forests.MIN_ROWS} rows")
    last = rows.agg(F.max("row_index")).first()[0]
    nodes = fit_versions(rows, 1, 0 if last is None else last // every, every, newest, key)
    return score_versions(rows, nodes, every, key)
