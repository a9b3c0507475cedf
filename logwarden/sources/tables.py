"""Append-only streams and keyed tables kept as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.schemas import STREAM_RETENTION
from logwarden.session import scratch_path


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch so that a replay replaces it instead of adding to it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def materialised(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below the shared folder and read again, for plans that use it more than once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def newest(df: DataFrame, keep: int = STREAM_RETENTION, order: str = "stream_id") -> DataFrame:
    """Rows of the ``keep`` highest ids (ids are unique).

    The cut-off is found on the id column alone; whole rows are then filtered in
    place, and the filter can be pushed into the scan.
    """
    cutoff = df.select(order).orderBy(F.desc(order)).limit(keep).agg(F.min(order))
    return df.filter(F.col(order) >= cutoff.scalar())


def after(df: DataFrame, cursor, order: str = "stream_id") -> DataFrame:
    """Entries past a read cursor."""
    return df.filter(F.col(order) > F.lit(cursor))


def advance_cursor(df: DataFrame, order: str = "stream_id") -> DataFrame:
    return df.agg(F.max(order).alias("cursor"))


def latest_by_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Last write per key, aggregated on the map side before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
        .select(key, "_row.*")
        .select(*df.columns)
    )


def upsert(table: DataFrame, changes: DataFrame, key: str, seq: str, deleted: Column | None = None) -> DataFrame:
    """Merge changes into a keyed table; keys whose last change is a delete go."""
    merged = latest_by_key(table.unionByName(changes), key, seq)
    return merged if deleted is None else merged.filter(~deleted)


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_semi")
