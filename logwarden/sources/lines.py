"""Text and JSON log sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.text import strip
from logwarden.operators.validation import validate_json

# What a line without these keys is attributed to.
DEFAULT_SERVICE = "target-app"
HOST = "docker-target-app"
ENVIRONMENT = "production"


def read_json_events(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """One JSON event per line, validated; see ``accepted`` and ``rejected``."""
    return validate_json(spark.read.text(path), "value", now)


def stream_json_events(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, now: Column | None = None
) -> DataFrame:
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return validate_json(reader.text(path), "value", now)


def parse_lines(lines: DataFrame, column: str = "value", now: Column | None = None) -> DataFrame:
    """JSON objects become fields with defaults, other text an INFO message, blanks go.

    Columns of ``lines`` other than ``column`` are kept.
    """
    default_time = (F.current_timestamp() if now is None else now).cast("string")
    stripped = strip(F.col(column))
    doc = lines.withColumn("_line", stripped).filter(F.col("_line") != "").withColumn(
        "_doc", F.try_parse_json("_line")
    )
    doc = doc.withColumn("_object", F.coalesce(F.schema_of_variant("_doc").startswith("OBJECT"), F.lit(False)))

    def pick(path: str, default: Column) -> Column:
        given = F.expr(f"schema_of_variant(try_variant_get(_doc, '$.{path}', 'variant'))").isNotNull()
        value = F.expr(f"try_variant_get(_doc, '$.{path}', 'string')")
        return F.when(F.col("_object") & given, value).otherwise(default).alias(path)

    rest = [c for c in lines.columns if c != column]
    return doc.select(
        *rest,
        pick("service", F.lit(DEFAULT_SERVICE)).alias("service_name"),
        pick("level", F.lit("INFO")),
        pick("message", F.col("_line")),
        pick("timestamp", default_time),
        F.lit(HOST).alias("host"),
        F.lit(ENVIRONMENT).alias("environment"),
    )
