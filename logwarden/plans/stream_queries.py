"""Streaming queries, drained over the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.operators import detection, remediation
from logwarden.operators.templates import add_template
from logwarden.operators.validation import validate_json
from logwarden.plans import derived
from logwarden.plans.catalog import query
from logwarden.plans.ingest_queries import SQL_CHAIN, time_text
from logwarden.plans.respond_queries import _DECIDED, sample_analyser
from logwarden.schemas import INCIDENTS, LOGS, PENDING, RCA
from logwarden.session import scratch_path
from logwarden.sources.tables import latest_by_key
from logwarden.streaming import approvals, files, keyed, stages, windows


def _ingest(spark, sf_dir):
    """All JSON lines of the events, validated and written by the ingest stage."""
    base = scratch_path(spark, "ingest")
    lines = derived.stream(spark, sf_dir, "json_lines", spread=True)
    stages.start_ingest(validate_json(lines, "line"), base, True).awaitTermination()
    return base


@query(
    "stream_ingest",
    ("json_lines",),
    """SELECT 'accepted' AS outcome, count(*) AS n, CAST(sum(stream_id) AS BIGINT) AS ids FROM json_lines
       WHERE stream_id % 40 NOT BETWEEN 7 AND 12
       UNION ALL SELECT 'rejected', count(*), CAST(sum(stream_id) AS BIGINT) FROM json_lines
       WHERE stream_id % 40 BETWEEN 7 AND 12""",
)
def stream_ingest(spark, sf_dir):
    base = _ingest(spark, sf_dir)
    good = files.read_all(spark, f"{base}/telemetry", LOGS).withColumn("outcome", F.lit("accepted"))
    bad = files.read_all(spark, f"{base}/rejected", LOGS).withColumn("outcome", F.lit("rejected"))
    both = good.unionByName(bad)
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("stream_id").alias("ids"))


@query(
    "ingest_ids",
    ("json_lines",),
    """, t AS (SELECT CASE WHEN stream_id % 40 BETWEEN 7 AND 12 THEN 'rejected' ELSE 'telemetry' END AS outcome FROM json_lines)
       SELECT outcome, count(*) AS n, count(*) AS ids, (SELECT count(*) - 1 FROM t) AS last FROM t GROUP BY outcome""",
)
def ingest_ids(spark, sf_dir):
    """Lines that carry no ids: each output's rows and ids, and the last id given, counted from zero without gaps."""
    base = scratch_path(spark, "ids")
    lines = derived.stream(spark, sf_dir, "json_lines").select("line")
    stages.start_ingest(validate_json(lines, "line").drop("line"), base, True).awaitTermination()
    read = [files.read_all(spark, f"{base}/{n}", "stream_id BIGINT").withColumn("outcome", F.lit(n)) for n in ("telemetry", "rejected")]
    both = read[0].unionByName(read[1])
    last = both.agg(F.max("stream_id")).scalar()
    counted = both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("stream_id").alias("ids"))
    return counted.withColumn("last", last)


def _upserted(spark, df, keys):
    """Drain an update-mode aggregate; the last batch wins per key."""
    base = scratch_path(spark, "updates")

    def handle(batch, batch_id):
        files.write_once(batch.withColumn("batch", F.lit(batch_id)), f"{base}/out", batch_id)

    writer = df.writeStream.outputMode("update").foreachBatch(handle)
    writer.option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/out")
    keyed = written.withColumn("_key", F.struct(*keys))
    return latest_by_key(keyed, "_key", "batch").drop("_key", "batch")


@query(
    "stream_log_rate",
    ("logs",),
    """SELECT strftime(time_bucket(INTERVAL '1 minute', ts), '%Y-%m-%dT%H:%M:%S.%f') AS window_start, service_name,
              count(*) AS n FROM logs GROUP BY ALL""",
)
def stream_log_rate(spark, sf_dir):
    counts = windows.rate(derived.stream(spark, sf_dir, "logs"), "service_name", "ts")
    out = _upserted(spark, counts, ["window_start", "service_name"])
    return out.withColumn("window_start", time_text("window_start"))


@query(
    "stream_dedup",
    ("logs",),
    SQL_CHAIN + " SELECT DISTINCT service_name, normalized_message FROM chain",
)
def stream_dedup(spark, sf_dir):
    base = scratch_path(spark, "dedup")
    templated = add_template(derived.stream(spark, sf_dir, "logs")).select("ts", "service_name", "normalized_message")
    first = windows.distinct_signatures(templated, "ts")
    (
        first.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(f"{base}/out").select("service_name", "normalized_message")


@query(
    "stream_approvals",
    ("rca", "decisions"),
    f""", {_DECIDED} SELECT d.decision_id, d.incident_id, d.decision,
        d.decision_id IN (SELECT decision_id FROM effective) AND p.incident_id IS NOT NULL AS found,
        CASE WHEN d.decision_id IN (SELECT decision_id FROM effective) THEN p.target_command END AS target_command
        FROM decisions d LEFT JOIN pending p ON d.incident_id = p.incident_id""",
)
def stream_approvals(spark, sf_dir):
    base = scratch_path(spark, "approvals")
    held = remediation.plan_actions(derived.stream(spark, sf_dir, "rca"))
    outcomes = approvals.decision_outcomes(
        remediation.pending_actions(held), derived.stream(spark, sf_dir, "decisions")
    )
    (
        outcomes.writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(f"{base}/out").select("decision_id", "incident_id", "decision", "found", "target_command")


@query("stream_detect")
def stream_detect(spark, sf_dir):
    """Ingest and detect: the model trains itself once enough vectors are stored."""
    base = _ingest(spark, sf_dir)
    telemetry = files.read_stream(spark, f"{base}/telemetry", LOGS)
    stages.detect_available(telemetry, base, detected_at=F.lit(0.0))
    found = files.read_all(spark, f"{base}/incidents", INCIDENTS)
    return found.select("incident_id", "service_name", "normalized_message", "anomaly_score", "context_window_size")


@query(
    "detect_parity",
    ("logs",),
    "SELECT concat('incident-', CAST(stream_id AS VARCHAR)) AS incident_id, CAST('' AS VARCHAR) AS only_in FROM logs WHERE false",
)
def detect_parity(spark, sf_dir):
    """Incidents that batch and streaming detection don't agree on: none, without a model given to either."""
    logs = derived.logs(spark, sf_dir).select("stream_id", "service_name", "timestamp", "level", "message", "metadata")
    base = scratch_path(spark, "parity")
    logs.write.parquet(f"{base}/in")
    rows = spark.readStream.schema(logs.schema).parquet(f"{base}/in")
    stages.detect_available(rows, base, threshold=0.45, detected_at=F.lit(0.0))
    streamed = files.read_all(spark, f"{base}/incidents", INCIDENTS).select("incident_id", F.round("anomaly_score", 6).alias("score"))
    whole = spark.read.schema(logs.schema).parquet(f"{base}/in")
    batch = detection.detect(whole, threshold=0.45, detected_at=F.lit(0.0)).select(
        "incident_id", F.round("anomaly_score", 6).alias("score")
    )
    return (
        batch.exceptAll(streamed).select("incident_id", F.lit("batch").alias("only_in"))
        .unionByName(streamed.exceptAll(batch).select("incident_id", F.lit("stream").alias("only_in")))
    )


@query(
    "stream_response",
    ("incidents",),
    """, r AS (SELECT incident_id, CASE WHEN message LIKE '%denied%' THEN 'HIGH' ELSE 'LOW' END AS risk_level
             FROM incidents WHERE message NOT LIKE '%Heartbeat%')
       SELECT incident_id, CASE risk_level WHEN 'LOW' THEN 'history' ELSE 'pending' END AS stream,
              CASE risk_level WHEN 'LOW' THEN 'mock-remediation restart_daemon' ELSE 'mock-remediation complex_mitigation' END
              AS target_command FROM r
       UNION ALL SELECT incident_id, 'failed', NULL FROM incidents WHERE message LIKE '%Heartbeat%'""",
)
def stream_response(spark, sf_dir):
    """Incidents through analysis and remediation, stage by stage."""
    base = scratch_path(spark, "response")
    _respond(spark, sf_dir, base)

    def outcome(name):
        rows = files.read_all(spark, f"{base}/{name}", "incident_id STRING, target_command STRING")
        return rows.select("incident_id", F.lit(name.removeprefix("rca_")).alias("stream"), "target_command")

    return outcome("history").unionByName(outcome("pending")).unionByName(outcome("rca_failed"))


def _respond(spark, sf_dir, base):
    """The derived incidents through analysis and remediation."""
    inc = derived.stream(spark, sf_dir, "incidents", spread=True)
    shaped = inc.select(
        "incident_id", F.col("stream_id").cast("string").alias("source_stream_id"), "service_name",
        time_text("ts").alias("timestamp"), "level", F.col("message").alias("raw_message"),
        F.lit("").alias("normalized_message"), F.col("score").alias("anomaly_score"),
        F.lit(0.55).alias("anomaly_threshold"), F.lit(0).alias("context_window_size"),
        F.expr("from_json('[]', 'array<struct<timestamp:string,level:string,message:string>>')").alias("context_window"),
    )
    stages.start_analyse(shaped, base, sample_analyser, F.lit(0.0), True, backoff_s=0.0).awaitTermination()
    reports = files.read_stream(spark, f"{base}/rca", RCA)
    stages.start_remediate(reports, base, F.lit(0.0), True).awaitTermination()


@query(
    "stream_gauges",
    ("json_lines", "incidents", "decisions"),
    """, r AS (SELECT incident_id, CASE WHEN message LIKE '%denied%' THEN 'HIGH' ELSE 'LOW' END AS risk_level
             FROM incidents WHERE message NOT LIKE '%Heartbeat%'),
       n AS (SELECT (SELECT count(*) FROM json_lines WHERE stream_id % 40 NOT BETWEEN 7 AND 12) AS telemetry, (SELECT count(*) FROM r) AS rca,
                    (SELECT count(*) FROM r WHERE risk_level = 'LOW') AS automatic, (SELECT count(*) FROM r WHERE risk_level = 'HIGH') AS held,
                    (SELECT count(*) FROM r WHERE risk_level = 'HIGH' AND incident_id IN (SELECT incident_id FROM decisions)) AS decided)
       SELECT stream, length, length AS recounted FROM (
         SELECT 'telemetry' AS stream, telemetry AS length FROM n UNION ALL SELECT 'incidents', 0 FROM n UNION ALL SELECT 'rca', rca FROM n
         UNION ALL SELECT 'history', automatic + decided FROM n UNION ALL SELECT 'pending', held - decided FROM n)""",
)
def stream_gauges(spark, sf_dir):
    """Gauges that batches leave behind, beside a count of everything the stages have written."""
    base = _ingest(spark, sf_dir)
    _respond(spark, sf_dir, base)
    pending = files.read_stream(spark, f"{base}/pending", PENDING)
    stages.start_decide(pending, derived.stream(spark, sf_dir, "decisions"), base, True).awaitTermination()
    counted = stages.stage_lengths(spark, base).withColumnRenamed("length", "recounted")
    return stages.gauges(spark, base).join(counted, "stream")


@query("stream_chain")
def stream_chain(spark, sf_dir):
    """All stages in a row, and how many rows each one has written."""
    base = scratch_path(spark, "chain")
    lines = derived.stream(spark, sf_dir, "json_lines")
    stages.drain(
        spark, validate_json(lines, "line"), base, sample_analyser, detected_at=F.lit(0.0)
    )
    return stages.stage_lengths(spark, base)


@query(
    "stream_context",
    ("logs",),
    """, r AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY stream_id) AS n FROM logs)
       SELECT concat('incident-', CAST(i.stream_id AS VARCHAR)) AS incident_id, i.service_name, i.score AS anomaly_score,
              CAST(least(i.n, 5) AS BIGINT) AS context_window_size,
              (SELECT string_agg(concat(CAST(c.stream_id AS VARCHAR), ' ', c.level, ' ', c.message), chr(10) ORDER BY c.n) FROM r c
               WHERE c.service_name = i.service_name AND c.n BETWEEN i.n - 4 AND i.n) AS context
       FROM r i WHERE i.score > 0.55""",
)
def stream_context(spark, sf_dir):
    """Context of anomalous rows from the rows that batches hand on, over several micro-batches."""
    base = scratch_path(spark, "context")
    rows = derived.logs(spark, sf_dir).select(
        "stream_id", "service_name", "timestamp", "level", "message", "metadata",
        F.lit("").alias("normalized_message"), F.col("score").alias("anomaly_score"),
    )
    # Ids grow from batch to batch: ranges of ids in files that are read one at a time.
    third = rows.agg(F.max("stream_id")).first()[0] // 3 + 1
    for part in range(3):
        rows.filter(F.floor(F.col("stream_id") / third) == part).write.parquet(f"{base}/in/part={part}")
        stream = files.read_stream(spark, f"{base}/in", keyed.SCORED)
        stages.start_context(stream, base, detected_at=F.lit(0.0), available_now=True).awaitTermination()
    found = files.read_all(spark, f"{base}/incidents", INCIDENTS)
    shown = F.transform("context_window", lambda f: F.concat_ws(" ", f["stream_id"], f["level"], f["message"]))
    return found.select("incident_id", "service_name", "anomaly_score", "context_window_size", F.array_join(shown, "\n").alias("context"))


_HELD = """SELECT incident_id, service_name, 'restart_daemon' AS action_id, 'HIGH' AS risk_level, concat('run ', service_name) AS target_command,
           CAST(1700000000 + stream_id AS DOUBLE) AS held_at FROM incidents"""
# Each held action gets an early, a late or no decision, and some two; times are in whole seconds.
_ASKED = """SELECT incident_id, stream_id * 10 AS decision_id, CASE WHEN stream_id % 2 = 0 THEN 'approve' ELSE 'deny' END AS decision,
            CAST(1700000000 + stream_id + CASE stream_id % 5 WHEN 0 THEN 30 WHEN 1 THEN 60 WHEN 2 THEN 61 ELSE 90 END AS DOUBLE) AS decided_at
            FROM incidents WHERE stream_id % 5 < 4
            UNION ALL SELECT incident_id, stream_id * 10 + 1, 'approve', CAST(1700000000 + stream_id + 45 AS DOUBLE) FROM incidents WHERE stream_id % 3 = 0
            UNION ALL SELECT concat(incident_id, '-none'), stream_id * 10 + 2, 'deny', CAST(1700000000 + stream_id AS DOUBLE) FROM incidents WHERE stream_id % 7 = 0"""


@query(
    "stream_expiry",
    ("incidents",),
    f""", held AS ({_HELD}), asked AS ({_ASKED}),
       first AS (SELECT a.incident_id, min(decision_id) AS decision_id FROM asked a JOIN held h ON a.incident_id = h.incident_id AND decided_at <= held_at + 60 GROUP BY a.incident_id),
       newest AS (SELECT greatest((SELECT max(held_at) FROM held), (SELECT max(decided_at) FROM asked)) AS at)
       SELECT a.incident_id, CAST(a.decision_id AS BIGINT) AS decision_id, a.decision, a.decided_at, f.decision_id IS NOT NULL AS found,
              CASE WHEN f.decision_id IS NOT NULL THEN h.target_command END AS target_command
       FROM asked a LEFT JOIN first f ON a.incident_id = f.incident_id AND a.decision_id = f.decision_id LEFT JOIN held h ON a.incident_id = h.incident_id
       UNION ALL
       SELECT h.incident_id, NULL, 'expired', held_at + 60, TRUE, h.target_command FROM held h, newest
       WHERE h.incident_id NOT IN (SELECT incident_id FROM first) AND held_at + 60 <= newest.at - 600""",
)
def stream_expiry(spark, sf_dir):
    """Decisions in time, decisions too late, and actions that expire undecided."""
    base = scratch_path(spark, "expiry")
    incidents = derived.table(spark, sf_dir, "incidents")
    for name, sql in (("held", _HELD), ("asked", _ASKED)):
        spark.sql(sql.replace("FROM incidents", "FROM {incidents}"), incidents=incidents).write.parquet(f"{base}/{name}")

    def source(name):
        return spark.readStream.schema(spark.read.parquet(f"{base}/{name}").schema).parquet(f"{base}/{name}")

    stages.start_decide(source("held"), source("asked"), base, True, ttl_s=60.0).awaitTermination()
    return files.read_all(spark, f"{base}/decided", approvals.OUTCOME).select(
        "incident_id", "decision_id", "decision", "decided_at", "found", "target_command"
    )
