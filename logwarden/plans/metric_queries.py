"""Queries over counters, rates, histograms and percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.functions import policy
from logwarden.operators import counters, quantiles, rates, remediation
from logwarden.plans import derived
from logwarden.plans.catalog import query
from logwarden.plans.ingest_queries import incident_entries, time_text
from logwarden.plans.respond_queries import _PLANNED, planned

_BOUNDS = (0.5, 1, 2, 5, 10, 20, 30, 60)
_TIME = "'%Y-%m-%dT%H:%M:%S.%f'"


@query(
    "severity_counts",
    ("logs",),
    """SELECT CASE WHEN level IN ('ERROR','CRITICAL','WARNING') THEN level ELSE 'OTHER' END AS severity, count(*) AS n,
              count(*) FILTER (level IN ('ERROR', 'CRITICAL')) AS high FROM logs GROUP BY ALL""",
)
def severity_counts(spark, sf_dir):
    return counters.severity_counter(derived.logs(spark, sf_dir))


@query("log_counter", ("logs",), "SELECT service_name, level, count(*) AS n FROM logs GROUP BY ALL")
def log_counter(spark, sf_dir):
    return counters.log_counter(derived.logs(spark, sf_dir))


@query("anomaly_counter", ("incidents",), "SELECT service_name, count(*) AS n FROM incidents GROUP BY ALL")
def anomaly_counter(spark, sf_dir):
    return counters.anomaly_counter(derived.table(spark, sf_dir, "incidents"))


@query("rca_counters", ("rca",), "SELECT service_name, status, count(*) AS n FROM rca GROUP BY ALL")
def rca_counters(spark, sf_dir):
    return counters.rca_counter(derived.table(spark, sf_dir, "rca"))


@query(
    "remediation_counters",
    ("rca",),
    f""", {_PLANNED} SELECT 'AUTO_EXECUTE' AS execution_type, 'SUCCESS' AS status, count(*) AS n FROM planned
        WHERE execution_type = 'AUTO_EXECUTE' UNION ALL SELECT 'MANUAL_APPROVE', 'PENDING', count(*) FROM pending""",
)
def remediation_counters(spark, sf_dir):
    p = planned(spark, sf_dir)
    return counters.remediation_counter(
        remediation.auto_history(p, F.lit(0.0), policy.action_result), remediation.pending_actions(p)
    )


@query(
    "stream_lengths",
    ("logs", "rca"),
    """SELECT 'logs' AS stream, count(*) AS length FROM logs UNION ALL SELECT 'rca', count(*) FROM rca""",
)
def stream_lengths(spark, sf_dir):
    return counters.stream_lengths(
        {"logs": derived.logs(spark, sf_dir), "rca": derived.table(spark, sf_dir, "rca")}
    )


@query(
    "dashboard_counts",
    ("logs", "rca"),
    f""", {_PLANNED} SELECT (SELECT count(*) FROM logs) AS total_logs, (SELECT count(*) FROM incidents) AS total_anomalies,
        (SELECT count(*) FROM planned WHERE execution_type = 'AUTO_EXECUTE') AS total_remediations,
        (SELECT count(DISTINCT incident_id) FROM pending) AS pending_approvals""",
)
def dashboard_counts(spark, sf_dir):
    p = planned(spark, sf_dir)
    return counters.dashboard_counts(
        derived.logs(spark, sf_dir), derived.table(spark, sf_dir, "incidents"),
        remediation.auto_history(p, F.lit(0.0), policy.action_result), remediation.pending_actions(p),
    )


@query(
    "incident_stats",
    ("incident_entries",),
    """, n AS (SELECT coalesce(service_name, 'unknown') AS s, coalesce(level, 'UNKNOWN') AS l,
                  try_cast(coalesce(anomaly_score, '0') AS DOUBLE) AS score FROM incident_entries ORDER BY entry_id DESC LIMIT 100)
       SELECT 'total' AS scope, 'all' AS name, count(*) AS n, CAST(NULL AS DOUBLE) AS average_score FROM incident_entries
       UNION ALL SELECT 'sample', 'all', count(*), round(avg(score), 4) FROM n
       UNION ALL SELECT 'service', s, count(*), NULL FROM n GROUP BY s
       UNION ALL SELECT 'level', l, count(*), NULL FROM n GROUP BY l""",
)
def incident_stats(spark, sf_dir):
    return counters.incident_stats(incident_entries(spark, sf_dir))


def _messages(spark, sf_dir):
    logs = derived.logs(spark, sf_dir)
    failed = F.col("stream_id") % 97 == 0
    return logs.select(
        F.floor(F.col("stream_id") / 32).alias("batch_id"),
        (~failed).alias("embedded"),
        (~failed & (F.col("stream_id") % 89 != 0)).alias("acked"),
        (F.col("score") > 0.55).alias("is_anomaly"),
        ((F.col("score") > 0.55) & (F.col("stream_id") % 83 != 0)).alias("published"),
        (F.col("k") / 1000.0).alias("embed_s"),
    )


@query(
    "worker_rollup",
    ("logs",),
    """SELECT count(DISTINCT stream_id // 32) FILTER (stream_id % 97 <> 0) AS batches,
              count(*) FILTER (stream_id % 97 <> 0) AS embedded, count(*) FILTER (stream_id % 97 = 0) AS failed,
              count(*) FILTER (stream_id % 97 <> 0 AND stream_id % 89 <> 0) AS acked,
              count(*) FILTER (score > 0.55) AS anomalies,
              count(*) FILTER (score > 0.55 AND stream_id % 83 <> 0) AS incidents,
              round(avg(k) FILTER (stream_id % 97 <> 0), 6) AS avg_embed_ms FROM logs""",
)
def worker_rollup(spark, sf_dir):
    return counters.worker_rollup(_messages(spark, sf_dir))


@query(
    "rca_rollup",
    ("rca",),
    """SELECT count(*) AS consumed, count(*) FILTER (status = 'success') AS generated,
              count(*) FILTER (status <> 'success') AS failures,
              round(avg(k) FILTER (status = 'success') * 1000.0, 6) AS avg_latency_ms FROM rca""",
)
def rca_rollup(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "rca").withColumn("seconds", F.col("k").cast("double"))
    return counters.rca_rollup(rows)


@query(
    "remediation_rollup",
    ("rca",),
    f""", {_PLANNED} SELECT count(*) AS consumed, count(*) FILTER (execution_type = 'AUTO_EXECUTE') AS auto,
        count(*) FILTER (execution_type = 'WEBHOOK_GATE') AS gated, CAST(0 AS BIGINT) AS failures FROM planned""",
)
def remediation_rollup(spark, sf_dir):
    return counters.remediation_rollup(planned(spark, sf_dir))


@query(
    "panel_gauges",
    ("logs",),
    "SELECT service_name AS name, max(k) AS value FROM logs GROUP BY ALL",
)
def panel_gauges(spark, sf_dir):
    return counters.gauge_max(
        derived.logs(spark, sf_dir).select(F.col("service_name").alias("name"), F.col("k").alias("value"))
    )


@query("panel_total", ("rca",), "SELECT count(*) AS total FROM rca")
def panel_total(spark, sf_dir):
    return counters.counter_sum(counters.rca_counter(derived.table(spark, sf_dir, "rca")))


_CELLS = ", ".join(f"count(*) FILTER (value <= {b}) AS c{i}" for i, b in enumerate(_BOUNDS))


@query(
    "latency_histogram",
    (),
    f"""WITH h AS (SELECT {_CELLS}, count(*) AS total, round(sum(value), 6) AS sum FROM events)
    """
    + " UNION ALL ".join(f"SELECT '{b:g}' AS le, c{i} AS cumulative, total, sum FROM h" for i, b in enumerate(_BOUNDS))
    + " UNION ALL SELECT '+Inf', total, total, sum FROM h",
)
def latency_histogram(spark, sf_dir):
    return quantiles.histogram(derived.read(spark, sf_dir, "events"), "value")


def _sql_quantile(q: float) -> str:
    text = "CASE"
    for i, b in enumerate(_BOUNDS):
        low = _BOUNDS[i - 1] if i else 0
        before = f"c{i - 1}" if i else "0"
        text += (
            f" WHEN c{i} >= total * {q} THEN {low} + ({b} - {low}) * (total * CAST({q} AS DOUBLE) - {before}) / (c{i} - {before})"
        )
    return f"round(CAST({text} ELSE {_BOUNDS[-1]} END AS DOUBLE), 6)"


_QUANTILES = ", ".join(f"{_sql_quantile(q)} AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99))


@query(
    "histogram_quantile",
    (),
    f"WITH h AS (SELECT {_CELLS}, count(*) AS total FROM events) SELECT total, {_QUANTILES} FROM h",
)
def histogram_quantile(spark, sf_dir):
    return quantiles.histogram_quantiles(derived.read(spark, sf_dir, "events"), "value")


@query(
    "latency_quantiles_5m",
    (),
    f"""WITH h AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS w, {_CELLS}, count(*) AS total FROM events GROUP BY w)
        SELECT strftime(w, {_TIME}) AS window_start, total, {_QUANTILES} FROM h""",
)
def latency_quantiles_5m(spark, sf_dir):
    events = derived.read(spark, sf_dir, "events").withColumn(
        "window_start", F.window(F.col("ts").cast("timestamp"), "5 minutes")["start"]
    )
    out = quantiles.histogram_quantiles(events, "value", ("window_start",))
    return out.withColumn("window_start", time_text("window_start"))


@query(
    "latency_percentiles",
    (),
    """SELECT round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events""",
)
def latency_percentiles(spark, sf_dir):
    return quantiles.exact_percentiles(
        derived.read(spark, sf_dir, "events"), "value", {"p95": 0.95, "p99": 0.99}, buckets=8
    )


@query(
    "throughput",
    ("logs",),
    """, t AS (SELECT count(*) FILTER (level <> 'ERROR') AS successes,
                  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS elapsed_s FROM logs)
       SELECT successes, round(CAST(elapsed_s AS DOUBLE), 6) AS elapsed_s, round(CAST(successes / elapsed_s AS DOUBLE), 6) AS per_second FROM t""",
)
def throughput(spark, sf_dir):
    return counters.throughput(derived.logs(spark, sf_dir), F.col("level") != "ERROR", F.col("timestamp"))


def _rate_sql(source: str, key: str, width: str) -> str:
    return f""", c AS (SELECT time_bucket(INTERVAL '{width}', ts) AS w, {key} AS key, count(*) AS n FROM {source} GROUP BY ALL)
        SELECT strftime(w, {_TIME}) AS window_start, key, n FROM c
        UNION ALL SELECT strftime(w, {_TIME}), '*', CAST(sum(n) AS BIGINT) FROM c GROUP BY w"""


def _shown(df, key):
    return df.select(time_text("window_start").alias("window_start"), F.col(key).alias("key"), "n")


@query("log_rate", ("logs",), _rate_sql("logs", "service_name", "1 minute"))
def log_rate(spark, sf_dir):
    return _shown(rates.event_rate(derived.logs(spark, sf_dir), "service_name"), "service_name")


@query(
    "log_rate_sliding",
    ("logs",),
    f""", s AS (SELECT time_bucket(INTERVAL '10 seconds', ts) AS b, service_name AS key FROM logs),
    c AS (SELECT b - to_seconds(10 * i) AS w, key, count(*) AS n FROM s, range(6) r(i) GROUP BY ALL)
    SELECT strftime(w, {_TIME}) AS window_start, key, n FROM c
    UNION ALL SELECT strftime(w, {_TIME}), '*', CAST(sum(n) AS BIGINT) FROM c GROUP BY w""",
)
def log_rate_sliding(spark, sf_dir):
    return _shown(rates.sliding_rate(derived.logs(spark, sf_dir), "service_name"), "service_name")


@query("anomaly_rate", ("incidents",), _rate_sql("incidents", "service_name", "1 minute"))
def anomaly_rate(spark, sf_dir):
    return _shown(rates.event_rate(derived.table(spark, sf_dir, "incidents"), "service_name", "ts"), "service_name")


@query("daily_trend", ("incidents",), _rate_sql("incidents", "service_name", "1 day"))
def daily_trend(spark, sf_dir):
    """Anomalies per service and day: the historical trend."""
    return _shown(rates.event_rate(derived.table(spark, sf_dir, "incidents"), "service_name", "ts", "1 day"), "service_name")


@query(
    "remediation_rate",
    ("rca",),
    ", kinds AS (SELECT ts, CASE WHEN risk_level IN ('HIGH','CRITICAL') THEN 'WEBHOOK_GATE' ELSE 'AUTO_EXECUTE' END AS kind FROM rca)"
    + _rate_sql("kinds", "kind", "5 minutes"),
)
def remediation_rate(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "rca").withColumn("kind", policy.execution_type(F.col("risk_level")))
    return _shown(rates.event_rate(rows, "kind", "ts", "5 minutes"), "kind")
