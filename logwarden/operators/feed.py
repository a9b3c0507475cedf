"""One typed event feed over all streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions import policy


def _field(name: str, default: str = "") -> Column:
    return F.coalesce(F.col("fields").getItem(name), F.lit(default))


def _incident_id() -> Column:
    return F.coalesce(F.col("fields").getItem("incident_id"), F.col("stream_id").cast("string"))


def rca_summary(entries: DataFrame) -> DataFrame:
    """Seven report fields; the entry id stands in for a missing incident id."""
    return entries.select(
        F.col("stream_id"),
        _incident_id().alias("incident_id"),
        _field("service_name").alias("service_name"),
        _field("raw_message").alias("raw_message"),
        F.coalesce(_field("anomaly_score", "0.0").try_cast("double"), F.lit(0.0)).alias("anomaly_score"),
        _field("root_cause").alias("root_cause"),
        _field("suggested_fix").alias("suggested_fix"),
        _field("risk_level", "LOW").alias("risk_level"),
    )


def _events(kind: str, entries: DataFrame, **data: Column) -> DataFrame:
    body = F.to_json(F.struct(*[c.alias(n) for n, c in data.items()]))
    return entries.select(
        F.lit(kind).alias("type"), F.col("stream_id").cast("string").alias("id"), body.alias("data")
    )


def telemetry_events(entries: DataFrame) -> DataFrame:
    return _events(
        "telemetry", entries, service_name=_field("service_name", "unknown"),
        level=_field("level", "INFO"), message=_field("message"),
    )


def anomaly_events(entries: DataFrame) -> DataFrame:
    return _events(
        "anomaly", entries, incident_id=F.col("stream_id").cast("string"), service_name=_field("service_name")
    )


def rca_events(entries: DataFrame) -> DataFrame:
    summary = rca_summary(entries)
    return _events("rca", summary, **{c: F.col(c) for c in summary.columns if c != "stream_id"})


def pending_events(entries: DataFrame) -> DataFrame:
    """Approval cards of high-risk reports, with the feed's own command rules."""
    high = entries.filter(_field("risk_level", "LOW").isin("HIGH", "CRITICAL"))
    return _events(
        "pending_remediation", high, incident_id=_incident_id(), service_name=_field("service_name"),
        risk_level=_field("risk_level", "LOW"), target_command=policy.feed_command(_field("suggested_fix")),
    )


def run_events(entries: DataFrame) -> DataFrame:
    return _events(
        "remediation_run", entries, incident_id=_field("incident_id"), service_name=_field("service_name"),
        execution_type=_field("execution_type"), status=_field("status"),
    )


def live_feed(telemetry: DataFrame, incidents: DataFrame, rca: DataFrame, history: DataFrame) -> DataFrame:
    """All streams as (type, id, data JSON)."""
    parts = [
        telemetry_events(telemetry), anomaly_events(incidents), rca_events(rca),
        pending_events(rca), run_events(history),
    ]
    return reduce(DataFrame.unionByName, parts)
