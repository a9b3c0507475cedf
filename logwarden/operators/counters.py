"""Counters, gauges and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions import policy
from logwarden.schemas import HIGH_SEVERITY


def _count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def stream_lengths(streams: dict[str, DataFrame]) -> DataFrame:
    """(stream, length) for each named stream, zero for an empty one."""
    parts = [df.agg(_count("length")).select(F.lit(name).alias("stream"), "length") for name, df in streams.items()]
    return reduce(DataFrame.unionByName, parts)


def dashboard_counts(logs: DataFrame, incidents: DataFrame, history: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: total_logs, total_anomalies, total_remediations, pending_approvals."""
    streams = {
        "total_logs": logs,
        "total_anomalies": incidents,
        "total_remediations": history,
        "pending_approvals": pending.select("incident_id").distinct(),
    }
    lengths = stream_lengths(streams)
    return lengths.agg(
        *[F.max(F.when(F.col("stream") == name, F.col("length"))).alias(name) for name in streams]
    )


def log_counter(logs: DataFrame) -> DataFrame:
    return logs.groupBy("service_name", "level").agg(_count())


def severity_counter(logs: DataFrame) -> DataFrame:
    """Per display class, with the share that is high severity."""
    return logs.groupBy(policy.severity_class(F.col("level")).alias("severity")).agg(
        _count(), F.count_if(F.col("level").isin(*HIGH_SEVERITY)).alias("high")
    )


def anomaly_counter(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("service_name").agg(_count())


def rca_counter(requests: DataFrame) -> DataFrame:
    """Requests by service and status (success or error)."""
    return requests.groupBy("service_name", "status").agg(_count())


def remediation_counter(history: DataFrame, pending: DataFrame) -> DataFrame:
    """Executed automatic actions plus held ones; decisions are not counted again."""
    auto = history.filter(F.col("execution_type") == policy.AUTO).select("execution_type", "status")
    held = pending.select(F.lit("MANUAL_APPROVE").alias("execution_type"), F.lit("PENDING").alias("status"))
    return auto.unionByName(held).groupBy("execution_type", "status").agg(_count())


def gauge_max(samples: DataFrame) -> DataFrame:
    """Highest sample per gauge (name, value)."""
    return samples.groupBy("name").agg(F.max("value").alias("value"))


def counter_sum(counters: DataFrame, column: str = "n") -> DataFrame:
    return counters.agg(F.coalesce(F.sum(column), F.lit(0)).alias("total"))


def incident_stats(entries: DataFrame, sample: int = 100) -> DataFrame:
    """Rows (scope, name, n, average_score) over the newest ``sample`` entries.

    ``total`` counts the whole stream. Entries are (stream_id, fields); a missing
    score counts as 0, an unreadable one is left out of the average.
    """
    fields = F.col("fields")
    newest = entries.orderBy(F.desc("stream_id")).limit(sample)
    cells = newest.select(
        F.coalesce(fields["service_name"], F.lit("unknown")).alias("service"),
        F.coalesce(fields["level"], F.lit("UNKNOWN")).alias("level"),
        F.coalesce(fields["anomaly_score"], F.lit("0")).try_cast("double").alias("score"),
    )
    scope = (
        F.when(F.grouping("service") == 0, "service").when(F.grouping("level") == 0, "level").otherwise("sample")
    )
    grouped = cells.groupingSets([[F.col("service")], [F.col("level")], []], "service", "level").agg(
        scope.alias("scope"), _count(), F.avg("score").alias("_mean")
    )
    total = entries.agg(_count()).select(
        F.lit("total").alias("scope"), F.lit("all").alias("name"), "n", F.lit(None).cast("double").alias("average_score")
    )
    return grouped.select(
        "scope",
        F.coalesce("service", "level", F.lit("all")).alias("name"),
        "n",
        F.when(F.col("scope") == "sample", F.round(F.coalesce("_mean", F.lit(0.0)), 4)).alias("average_score"),
    ).unionByName(total)


def worker_rollup(messages: DataFrame) -> DataFrame:
    """Totals of the detection worker from per-message rows.

    Columns: batch_id, embedded, acked, is_anomaly, published (booleans), embed_s.
    """
    embedded = F.count_if("embedded")
    seconds = F.sum(F.when(F.col("embedded"), F.col("embed_s")))
    return messages.agg(
        F.count_distinct(F.when(F.col("embedded"), F.col("batch_id"))).alias("batches"),
        embedded.alias("embedded"),
        F.count_if(~F.col("embedded")).alias("failed"),
        F.count_if("acked").alias("acked"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.count_if("published").alias("incidents"),
        F.coalesce(seconds / F.when(embedded > 0, embedded) * 1000.0, F.lit(0.0)).alias("avg_embed_ms"),
    )


def rca_rollup(requests: DataFrame) -> DataFrame:
    """consumed, generated, failures, avg_latency_ms over generated reports."""
    ok = F.col("status") == "success"
    return requests.agg(
        _count("consumed"),
        F.count_if(ok).alias("generated"),
        F.count_if(~ok).alias("failures"),
        F.coalesce(F.avg(F.when(ok, F.col("seconds"))) * 1000.0, F.lit(0.0)).alias("avg_latency_ms"),
    )


def remediation_rollup(planned: DataFrame) -> DataFrame:
    """consumed, auto, gated, failures of the planned actions."""
    result = policy.action_result(F.col("target_command"))
    auto = F.col("execution_type") == policy.AUTO
    return planned.agg(
        _count("consumed"),
        F.count_if(auto).alias("auto"),
        F.count_if(F.col("execution_type") == policy.GATE).alias("gated"),
        F.count_if(auto & (result["returncode"] != 0)).alias("failures"),
    )


def throughput(requests: DataFrame, ok: Column, time: Column) -> DataFrame:
    """Successes per second between the first and the last event, 0 when they coincide."""
    micros = F.unix_micros(time)
    elapsed = (F.max(micros) - F.min(micros)) / 1e6
    done = F.count_if(ok)
    return requests.agg(
        done.alias("successes"),
        elapsed.alias("elapsed_s"),
        F.coalesce(done / F.when(elapsed > 0, elapsed), F.lit(0.0)).alias("per_second"),
    )
