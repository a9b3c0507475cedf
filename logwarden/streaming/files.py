"""Micro-batch folders: written once per batch, safe to replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.sources.tables import write_batch


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def batch_done(spark: SparkSession, path: str, batch_id: int) -> bool:
    return exists(spark, f"{path}/batch_id={batch_id}/_SUCCESS")


def write_once(df: DataFrame, path: str, batch_id: int, gauge: str | None = None) -> None:
    """Write a micro-batch unless an earlier attempt at it was committed.

    A batch id always covers the same input, so a committed folder is kept and
    downstream readers never see its files replaced. With a ``gauge`` (an SQL aggregate of
    the batch's rows) the running total of the output is kept beside it, see ``totals``.
    """
    spark = df.sparkSession
    if not batch_done(spark, path, batch_id):
        write_batch(df, path, batch_id)
    if gauge is not None:
        _add_total(spark, df.schema, path, batch_id, gauge)


LENGTHS = "stream STRING, batch BIGINT, added BIGINT, total BIGINT"


def _lengths(path: str) -> tuple[str, str]:
    base, name = path.rsplit("/", 1)
    return f"{base}/_lengths/{name}", name


def _add_total(spark: SparkSession, schema, path: str, batch_id: int, gauge: str) -> None:
    """The total behind a batch: that behind the batch before, and what the batch's own folder adds.

    No other folder is read, so a gauge costs the same however long a stream has run.
    """
    at, name = _lengths(path)
    if batch_done(spark, at, batch_id):
        return
    added = spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id}").agg(F.expr(gauge)).first()[0]
    before = 0
    if batch_id > 0 and batch_done(spark, at, batch_id - 1):
        before = spark.read.schema(LENGTHS).parquet(f"{at}/batch_id={batch_id - 1}").first()["total"]
    row = spark.createDataFrame([(name, batch_id, added, before + added)], LENGTHS)
    write_batch(row.coalesce(1), at, batch_id)


def totals(spark: SparkSession, base: str) -> DataFrame:
    """(stream, total) of every output that has a gauge, from the newest total of each."""
    known = read_all(spark, f"{base}/_lengths", LENGTHS)
    return known.groupBy("stream").agg(F.max_by("total", "batch").alias("total"))


def read_stream(
    spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Everything written below a stage's folder, from the beginning."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def read_all(spark: SparkSession, path: str, schema) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def make_folder(spark: SparkSession, path: str) -> None:
    """Create a folder that a downstream stage may read before anything is in it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
