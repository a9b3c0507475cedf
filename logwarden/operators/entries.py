"""Stream entries: flat string maps and their typed rows.

An entry row is (stream_id, fields MAP<STRING, STRING>); a key that is absent
takes its default, a key that is present is used as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import strip
from logwarden.schemas import ANOMALY_THRESHOLD, FRAMES


def _field(name: str, default: str | None = None) -> Column:
    value = F.col("fields").getItem(name)
    return value if default is None else F.coalesce(value, F.lit(default))


def _number(name: str, default: float) -> Column:
    return F.coalesce(_field(name).try_cast("double"), F.lit(default))


def _json_map(name: str) -> Column:
    return F.coalesce(
        F.from_json(_field(name, "{}"), "map<string,string>"),
        F.create_map().cast("map<string,string>"),
    )


def iso_text(ts: Column) -> Column:
    """ISO-8601 in UTC; microseconds appear only when they are not zero."""
    micros = F.unix_micros(ts.cast("timestamp"))
    # Wall clock without a zone, counted from the epoch: the session's zone plays no part.
    since = F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))
    clock = (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since).cast("string")
    fraction = F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0")
    return F.concat(
        F.replace(F.substring(clock, 1, 19), F.lit(" "), F.lit("T")),
        F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.lit("+00:00"),
    )


def to_entry(logs: DataFrame) -> DataFrame:
    """Typed event to (stream_id, fields)."""
    fields = F.create_map(
        F.lit("service_name"), F.col("service_name"),
        F.lit("timestamp"), iso_text(F.col("timestamp")),
        F.lit("level"), F.col("level"),
        F.lit("message"), F.col("message"),
        F.lit("metadata"), F.coalesce(F.to_json("metadata"), F.lit("{}")),
    )
    return logs.select("stream_id", fields.alias("fields"))


def fields_from_columns(df: DataFrame, id_column: str, names: list[str]) -> DataFrame:
    """Flat string columns to an entry; NULL means the key is absent."""
    pairs = [x for name in names for x in (F.lit(name), F.col(name))]
    fields = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return df.select(F.col(id_column).alias("stream_id"), fields.alias("fields"))


def parse_entries(entries: DataFrame) -> DataFrame:
    """Entry to log row; rows with a blank service or message are dropped."""
    return entries.select(
        "stream_id",
        strip(_field("service_name", "")).alias("service_name"),
        _field("timestamp", "").alias("timestamp"),
        F.upper(_field("level", "INFO")).alias("level"),
        strip(_field("message", "")).alias("message"),
        _json_map("metadata").alias("metadata"),
    ).filter((F.col("service_name") != "") & (F.col("message") != ""))


def decode_incidents(entries: DataFrame) -> DataFrame:
    context = F.coalesce(
        F.from_json(_field("context_window", "[]"), FRAMES), F.array().cast(FRAMES)
    )
    size = F.when(_field("context_window_size").isNull(), F.lit(0)).otherwise(
        F.coalesce(_field("context_window_size").try_cast("int"), F.size("context_window"))
    )
    return (
        entries.withColumn("context_window", context)
        .select(
            F.col("stream_id").alias("incident_id"),
            _field("stream_id", "").alias("source_stream_id"),
            _field("service_name", "unknown").alias("service_name"),
            _field("timestamp", "").alias("timestamp"),
            _field("level", "UNKNOWN").alias("level"),
            _field("raw_message", "").alias("raw_message"),
            _field("normalized_message", "").alias("normalized_message"),
            _number("anomaly_score", 0.0).alias("anomaly_score"),
            _number("anomaly_threshold", ANOMALY_THRESHOLD).alias("anomaly_threshold"),
            size.alias("context_window_size"),
            "context_window",
            _json_map("metadata").alias("metadata"),
            _number("detected_at", 0.0).alias("detected_at"),
        )
    )


def decode_rca(entries: DataFrame) -> DataFrame:
    return entries.select(
        F.col("stream_id").alias("rca_id"),
        _field("incident_id", "unknown").alias("incident_id"),
        _field("service_name", "unknown").alias("service_name"),
        _field("timestamp", "").alias("timestamp"),
        _field("level", "UNKNOWN").alias("level"),
        _field("raw_message", "").alias("raw_message"),
        _field("normalized_message", "").alias("normalized_message"),
        _number("anomaly_score", 0.0).alias("anomaly_score"),
        _field("root_cause", "").alias("root_cause"),
        _field("suggested_fix", "").alias("suggested_fix"),
        _field("risk_level", "LOW").alias("risk_level"),
        _field("impact_analysis", "").alias("impact_analysis"),
        _number("generation_time_s", 0.0).alias("generation_time_s"),
        _number("analyzed_at", 0.0).alias("analyzed_at"),
    )


def decode_history(entries: DataFrame) -> DataFrame:
    return entries.select(
        F.col("stream_id").alias("execution_id"),
        _field("incident_id", "unknown").alias("incident_id"),
        _field("service_name", "unknown").alias("service_name"),
        _field("action_id", "").alias("action_id"),
        _field("risk_level", "LOW").alias("risk_level"),
        _field("target_command", "").alias("target_command"),
        _field("execution_type", "").alias("execution_type"),
        _field("status", "UNKNOWN").alias("status"),
        _field("stdout", "").alias("stdout"),
        _field("stderr", "").alias("stderr"),
        _number("duration_s", 0.0).alias("duration_s"),
        _field("executed_by", "System").alias("executed_by"),
        _number("timestamp", 0.0).alias("timestamp"),
    )


def decode_pending(hash_rows: DataFrame) -> DataFrame:
    """(key, value JSON) to pending rows; text that is not a JSON object is skipped."""
    doc = hash_rows.withColumn("_doc", F.try_parse_json("value")).filter(
        F.schema_of_variant("_doc").startswith("OBJECT")
    )

    def text(name: str) -> Column:
        return F.expr(f"try_variant_get(_doc, '$.{name}', 'string')")

    has_id = F.expr("schema_of_variant(try_variant_get(_doc, '$.incident_id', 'variant'))").isNotNull()
    return doc.select(
        F.when(has_id, text("incident_id")).otherwise(F.col("key")).alias("incident_id"),
        text("service_name").alias("service_name"),
        text("action_id").alias("action_id"),
        text("risk_level").alias("risk_level"),
        text("target_command").alias("target_command"),
    )


def encode_incidents(incidents: DataFrame) -> DataFrame:
    """Typed incident to its flat entry: score %.6f, threshold %.4f, nested parts as JSON."""
    fields = F.create_map(
        F.lit("stream_id"), F.col("source_stream_id").cast("string"),
        F.lit("service_name"), F.col("service_name"),
        F.lit("timestamp"), F.col("timestamp").cast("string"),
        F.lit("level"), F.col("level"),
        F.lit("raw_message"), F.col("raw_message"),
        F.lit("normalized_message"), F.col("normalized_message"),
        F.lit("anomaly_score"), F.format_string("%.6f", F.col("anomaly_score")),
        F.lit("anomaly_threshold"), F.format_string("%.4f", F.col("anomaly_threshold")),
        F.lit("context_window_size"), F.col("context_window_size").cast("string"),
        F.lit("context_window"), F.to_json("context_window"),
        F.lit("metadata"), F.coalesce(F.to_json("metadata"), F.lit("{}")),
        F.lit("detected_at"), F.col("detected_at").cast("string"),
    )
    return incidents.select(F.col("incident_id").alias("stream_id"), fields.alias("fields"))
