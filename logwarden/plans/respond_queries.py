"""Queries over reports, remediation, approvals and the recent views."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from logwarden.functions import policy
from logwarden.operators import dedup, entries, feed, rca, recent, remediation, risk_rules
from logwarden.operators.templates import add_template
from logwarden.plans import derived
from logwarden.plans.catalog import query
from logwarden.plans.ingest_queries import SQL_CHAIN, history_entries, incident_entries, rca_entries, time_text


def typed_incidents(spark, sf_dir):
    inc = derived.table(spark, sf_dir, "incidents")
    frame = F.struct(time_text("ts").alias("timestamp"), "level", "message")
    # Every seventh incident has no context.
    none = F.array().cast("array<struct<timestamp:string,level:string,message:string>>")
    return inc.select(
        "incident_id", "service_name", time_text("ts").alias("timestamp"), "level",
        F.col("message").alias("raw_message"), F.lit("").alias("normalized_message"),
        F.col("score").alias("anomaly_score"),
        F.when(F.col("stream_id") % 7 == 0, none).otherwise(F.array(frame, frame)).alias("context_window"),
    )


@query(
    "prompt_text",
    ("incidents",),
    """, l AS (SELECT *, concat('[', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '] ', level, ' - ', message) AS line FROM incidents)
       SELECT incident_id, CASE WHEN stream_id % 7 = 0 THEN 'No preceding log history.'
              ELSE concat(line, chr(10), line) END AS context FROM l""",
)
def prompt_text(spark, sf_dir):
    return typed_incidents(spark, sf_dir).select("incident_id", rca.context_text(F.col("context_window")).alias("context"))


@query(
    "rca_validate",
    ("rca",),
    """, r AS (SELECT rca_id, stream_id, root_cause, suggested_fix, impact_analysis,
              CASE WHEN stream_id % 13 = 0 THEN 'json' WHEN stream_id % 17 = 0 THEN 'suggested_fix'
                   WHEN risk_level = 'BOGUS' THEN 'risk_level' END AS report_error, risk_level FROM rca)
       SELECT rca_id, report_error, CASE WHEN report_error IS NULL THEN root_cause END AS root_cause,
              CASE WHEN report_error IS NULL THEN risk_level END AS risk_level FROM r""",
)
def rca_validate(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "rca")
    full = F.to_json(F.struct("root_cause", "suggested_fix", "risk_level", "impact_analysis"))
    partial = F.to_json(F.struct("root_cause", "risk_level", "impact_analysis"))
    text = (
        F.when(F.col("stream_id") % 13 == 0, F.lit("no json"))
        .when(F.col("stream_id") % 17 == 0, partial)
        .otherwise(full)
    )
    reports = rows.select("rca_id", text.alias("report"))
    return rca.validate_report(reports).select("rca_id", "report_error", "root_cause", "risk_level")


def sample_analyser():
    """A stand-in analyser: valid, invalid and failing answers, decided by the message."""

    def analyse(service: str, message: str, prompt: str) -> str:
        if "Heartbeat" in message:
            raise TimeoutError("no answer")
        risk = "HIGH" if "denied" in message else "LOW"
        return json.dumps(
            {"root_cause": f"cause in {service}", "suggested_fix": "restart pod", "risk_level": risk,
             "impact_analysis": f"{len(prompt)} characters read"}
        )

    return analyse


@query(
    "rca_enrich",
    ("incidents",),
    """SELECT incident_id, service_name, CASE WHEN message LIKE '%Heartbeat%' THEN 'error' ELSE 'success' END AS status,
              CAST(CASE WHEN message LIKE '%Heartbeat%' THEN 3 ELSE 1 END AS BIGINT) AS attempts,
              CASE WHEN message LIKE '%Heartbeat%' THEN 'TimeoutError: no answer' END AS error FROM incidents""",
)
def rca_enrich(spark, sf_dir):
    asked = rca.enrich(typed_incidents(spark, sf_dir), sample_analyser, backoff_s=0.0)
    return asked.select("incident_id", "service_name", "status", "attempts", "error")


@query(
    "rca_insights",
    ("incidents",),
    """SELECT concat('rca-', incident_id) AS rca_id, incident_id, concat('cause in ', service_name) AS root_cause,
              CASE WHEN message LIKE '%denied%' THEN 'HIGH' ELSE 'LOW' END AS risk_level, message AS raw_message
       FROM incidents WHERE message NOT LIKE '%Heartbeat%'""",
)
def rca_insights(spark, sf_dir):
    asked = rca.enrich(typed_incidents(spark, sf_dir), sample_analyser, backoff_s=0.0)
    return rca.insights(asked, F.lit(0.0)).select("rca_id", "incident_id", "root_cause", "risk_level", "raw_message")


def odd_analyser():
    """Answers that two JSON readers could judge differently, decided by the message's length."""

    def analyse(service: str, message: str, prompt: str) -> str:
        report = {"root_cause": "c", "suggested_fix": "f", "risk_level": "LOW", "impact_analysis": "i"}
        text = json.dumps(report)
        return {
            1: text[:-1] + ', "risk_level": "LOW"}', 2: text[:-1] + ', "extra": NaN}', 3: f"[{text}]",
            4: json.dumps(report | {"risk_level": "HUGE"}), 5: json.dumps(report | {"root_cause": None}), 6: "",
        }.get(len(message) % 8, text)

    return analyse


@query(
    "rca_outcomes",
    ("incidents",),
    """SELECT incident_id, CASE WHEN length(message) % 8 IN (0, 7) THEN 'insight' ELSE 'failure' END AS outcome,
              strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS seen_at FROM incidents""",
)
def rca_outcomes(spark, sf_dir):
    """Every incident is an insight or a failure, exactly one, with its time to the microsecond."""
    incidents = typed_incidents(spark, sf_dir)
    seen = derived.table(spark, sf_dir, "incidents").select("incident_id", F.col("ts").alias("timestamp"))
    incidents = incidents.drop("timestamp").join(seen, "incident_id")
    asked = rca.enrich(incidents, odd_analyser, max_attempts=1, backoff_s=0.0)
    both = rca.insights(asked, F.lit(0.0)).select("incident_id", F.lit("insight").alias("outcome"), "timestamp").unionByName(
        rca.failures(asked).select("incident_id", F.lit("failure").alias("outcome"), "timestamp")
    )
    return both.select("incident_id", "outcome", time_text("timestamp").alias("seen_at"))


_RISK = "CASE WHEN risk_level IN ('LOW','MEDIUM','HIGH','CRITICAL') THEN risk_level ELSE 'LOW' END"
_PLANNED = f"""
    known AS (SELECT rca_id, incident_id, service_name, root_cause, suggested_fix, stream_id, k, {_RISK} AS risk_level,
              lower(suggested_fix) AS fix FROM rca),
    planned AS (SELECT *, concat('remediate-', lower(risk_level)) AS action_id,
              CASE WHEN risk_level IN ('LOW','MEDIUM') THEN 'AUTO_EXECUTE' ELSE 'WEBHOOK_GATE' END AS execution_type,
              concat('mock-remediation ', CASE
                WHEN risk_level IN ('LOW','MEDIUM') THEN
                  CASE WHEN contains(fix, 'cache') OR contains(fix, 'redis') THEN 'clear_cache'
                       WHEN contains(fix, 'restart') THEN 'restart_daemon' ELSE 'benign_routine' END
                ELSE CASE WHEN contains(fix, 'scale') THEN 'scale_up'
                       WHEN contains(fix, 'infrastructure') OR contains(fix, 'db') OR contains(fix, 'pool')
                       THEN 'modify_db_pool' ELSE 'complex_mitigation' END END) AS target_command
              FROM known),
    pending AS (SELECT incident_id, service_name, action_id, risk_level, target_command FROM planned
                WHERE execution_type = 'WEBHOOK_GATE'),
    result AS (SELECT *, concat('[MOCK_HEALING] Executed action: ', string_split(target_command, ' ')[2]) AS stdout
               FROM planned)
"""


def planned(spark, sf_dir):
    return remediation.plan_actions(derived.table(spark, sf_dir, "rca"))


@query(
    "policy_matrix",
    ("rca",),
    f", {_PLANNED} SELECT rca_id, risk_level, action_id, execution_type, target_command FROM planned",
)
def policy_matrix(spark, sf_dir):
    return planned(spark, sf_dir).select("rca_id", "risk_level", "action_id", "execution_type", "target_command")


@query(
    "policy_feed_variant",
    ("rca",),
    """SELECT rca_id, concat('mock-remediation ', CASE WHEN contains(lower(suggested_fix), 'scale') THEN 'scale_up'
              WHEN contains(lower(suggested_fix), 'db') THEN 'modify_db_pool' ELSE 'complex_mitigation' END) AS target_command
       FROM rca WHERE risk_level IN ('HIGH', 'CRITICAL')""",
)
def policy_feed_variant(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "rca").filter(F.col("risk_level").isin("HIGH", "CRITICAL"))
    return rows.select("rca_id", policy.feed_command(F.col("suggested_fix")).alias("target_command"))


@query(
    "action_result",
    ("logs",),
    """, c AS (SELECT stream_id, CASE stream_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'mock-remediation'
                  WHEN 2 THEN concat('mock-remediation  act', CAST(k AS VARCHAR)) ELSE concat('run job', CAST(k AS VARCHAR)) END AS command, k FROM logs)
       SELECT stream_id, CAST(CASE stream_id % 4 WHEN 0 THEN -1 ELSE 0 END AS BIGINT) AS returncode,
              CASE stream_id % 4 WHEN 0 THEN '' WHEN 1 THEN '[MOCK_HEALING] Executed action: benign'
                   WHEN 2 THEN concat('[MOCK_HEALING] Executed action: act', CAST(k AS VARCHAR))
                   ELSE concat('Custom command: ', command) END AS stdout,
              CASE stream_id % 4 WHEN 0 THEN 'Empty command' ELSE '' END AS stderr FROM c""",
)
def action_result(spark, sf_dir):
    k, kind = F.col("k").cast("string"), F.col("stream_id") % 4
    command = (
        F.when(kind == 0, F.lit("  "))
        .when(kind == 1, F.lit("mock-remediation"))
        .when(kind == 2, F.concat(F.lit("mock-remediation  act"), k))
        .otherwise(F.concat(F.lit("run job"), k))
    )
    rows = derived.logs(spark, sf_dir).select("stream_id", policy.action_result(command).alias("r"))
    return rows.select("stream_id", "r.*")


@query(
    "auto_history",
    ("rca",),
    f""", {_PLANNED} SELECT concat('auto-', rca_id) AS execution_id, incident_id, service_name, action_id, risk_level,
        target_command, execution_type, 'SUCCESS' AS status, stdout, '' AS stderr, CAST(0.0 AS DOUBLE) AS duration_s,
        'System (Auto)' AS executed_by, CAST(k AS DOUBLE) AS "timestamp" FROM result WHERE execution_type = 'AUTO_EXECUTE'""",
)
def auto_history(spark, sf_dir):
    return remediation.auto_history(planned(spark, sf_dir), F.col("k"), policy.action_result)


@query("pending_actions", ("rca",), f", {_PLANNED} SELECT * FROM pending")
def pending_actions(spark, sf_dir):
    return remediation.pending_actions(planned(spark, sf_dir))


@query(
    "notify_outbox",
    ("rca",),
    f""", {_PLANNED} SELECT incident_id, concat('{{"event":"pending_remediation_approval","incident_id":"', incident_id,
        '","service_name":"', service_name, '","risk_level":"', risk_level, '","target_command":"', target_command,
        '","root_cause":"', root_cause, '","suggested_fix":"', suggested_fix, '"}}') AS payload
        FROM planned WHERE execution_type = 'WEBHOOK_GATE'""",
)
def notify_outbox(spark, sf_dir):
    return remediation.notifications(planned(spark, sf_dir))


_DECIDED = f"""{_PLANNED},
    firsts AS (SELECT incident_id, min(decision_id) AS decision_id FROM decisions GROUP BY incident_id),
    effective AS (SELECT d.* FROM decisions d JOIN firsts USING (decision_id))
"""


def held(spark, sf_dir):
    return remediation.pending_actions(planned(spark, sf_dir)), derived.table(spark, sf_dir, "decisions")


@query(
    "approve",
    ("rca", "decisions"),
    f""", {_DECIDED} SELECT concat('approve-', p.incident_id) AS execution_id, p.incident_id, p.service_name, p.action_id,
        p.risk_level, p.target_command, 'WEBHOOK_GATE' AS execution_type, 'SUCCESS' AS status,
        concat('[MOCK_HEALING] Executed action: ', string_split(p.target_command, ' ')[2]) AS stdout, '' AS stderr,
        CAST(0.0 AS DOUBLE) AS duration_s, 'Operator (Approved)' AS executed_by, e.decided_at AS "timestamp"
        FROM pending p JOIN effective e ON p.incident_id = e.incident_id WHERE e.decision = 'approve'""",
)
def approve(spark, sf_dir):
    return remediation.approve(*held(spark, sf_dir), policy.action_result)


@query(
    "deny",
    ("rca", "decisions"),
    f""", {_DECIDED} SELECT concat('deny-', p.incident_id) AS execution_id, p.incident_id, p.service_name, p.action_id,
        p.risk_level, p.target_command, 'WEBHOOK_GATE' AS execution_type, 'ABORTED' AS status, '' AS stdout,
        'Mitigation Aborted by Operator' AS stderr, CAST(0.0 AS DOUBLE) AS duration_s,
        'Operator (Denied)' AS executed_by, e.decided_at AS "timestamp"
        FROM pending p JOIN effective e ON p.incident_id = e.incident_id WHERE e.decision = 'deny'""",
)
def deny(spark, sf_dir):
    return remediation.deny(*held(spark, sf_dir))


@query(
    "unknown_decision",
    ("rca", "decisions"),
    f""", {_DECIDED} SELECT decision_id, incident_id,
        concat('Nothing is held for incident ', incident_id) AS error FROM decisions
        WHERE decision_id NOT IN (SELECT decision_id FROM effective WHERE incident_id IN (SELECT incident_id FROM pending))""",
)
def unknown_decision(spark, sf_dir):
    return remediation.unknown_decisions(*held(spark, sf_dir))


@query(
    "pending_after",
    ("rca", "decisions"),
    f", {_PLANNED} SELECT * FROM pending WHERE incident_id NOT IN (SELECT incident_id FROM decisions)",
)
def pending_after(spark, sf_dir):
    return remediation.pending_after(*held(spark, sf_dir))


@query(
    "incident_lineage",
    ("rca", "incidents"),
    f""", {_PLANNED}, outcome AS (SELECT incident_id, concat('auto-', rca_id) AS execution_id, execution_type,
        'SUCCESS' AS status FROM planned WHERE execution_type = 'AUTO_EXECUTE')
        SELECT i.incident_id, i.service_name, round(i.score, 6) AS anomaly_score, r.rca_id, r.risk_level,
               r.suggested_fix, o.execution_id, o.execution_type, o.status
        FROM incidents i LEFT JOIN rca r ON i.incident_id = r.incident_id AND r.status = 'success'
        LEFT JOIN outcome o ON i.incident_id = o.incident_id""",
)
def incident_lineage(spark, sf_dir):
    inc = derived.table(spark, sf_dir, "incidents").withColumnRenamed("score", "anomaly_score")
    reports = derived.table(spark, sf_dir, "rca").filter(F.col("status") == "success")
    return remediation.lineage(inc, reports, remediation.auto_history(planned(spark, sf_dir), F.lit(0.0), policy.action_result))


@query(
    "incident_recent",
    ("incident_entries",),
    """SELECT entry_id AS incident_id, coalesce(service_name, 'unknown') AS service_name, raw_message
       FROM incident_entries ORDER BY entry_id DESC LIMIT 20""",
)
def incident_recent(spark, sf_dir):
    rows = recent.recent_incidents(incident_entries(spark, sf_dir), decode=entries.decode_incidents)
    return rows.select("incident_id", "service_name", "raw_message")


@query(
    "rca_recent",
    ("rca_entries",),
    """SELECT entry_id AS rca_id, root_cause, coalesce(risk_level, 'LOW') AS risk_level
       FROM rca_entries ORDER BY entry_id DESC LIMIT 10""",
)
def rca_recent(spark, sf_dir):
    rows = recent.recent_rca(rca_entries(spark, sf_dir), decode=entries.decode_rca)
    return rows.select("rca_id", "root_cause", "risk_level")


@query(
    "history_recent",
    ("history_entries",),
    """SELECT entry_id AS execution_id, execution_type, coalesce(status, 'UNKNOWN') AS status
       FROM history_entries ORDER BY entry_id DESC LIMIT 15""",
)
def history_recent(spark, sf_dir):
    rows = recent.recent_history(history_entries(spark, sf_dir), decode=entries.decode_history)
    return rows.select("execution_id", "execution_type", "status")


@query(
    "rca_latest",
    ("rca",),
    """, n AS (SELECT rca_id, service_name AS incident_id, root_cause FROM rca ORDER BY rca_id DESC LIMIT 50),
       r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY rca_id DESC) AS n FROM n)
       SELECT rca_id, incident_id, root_cause FROM r WHERE n = 1""",
)
def rca_latest(spark, sf_dir):
    # One incident per service here, so that several reports share one.
    rows = derived.table(spark, sf_dir, "rca").select("rca_id", F.col("service_name").alias("incident_id"), "root_cause")
    return recent.latest_rca(rows)


@query(
    "console_tail",
    ("logs",),
    "SELECT stream_id, service_name, level, message FROM logs ORDER BY stream_id DESC LIMIT 100",
)
def console_tail(spark, sf_dir):
    return recent.console_tail(derived.logs(spark, sf_dir).select("stream_id", "service_name", "level", "message"))


@query(
    "rca_summary",
    ("rca_entries",),
    """SELECT entry_id AS stream_id, coalesce(incident_id, entry_id) AS incident_id, coalesce(service_name, '') AS service_name,
              raw_message, round(CAST(anomaly_score AS DOUBLE), 6) AS anomaly_score, root_cause, suggested_fix,
              coalesce(risk_level, 'LOW') AS risk_level FROM rca_entries""",
)
def rca_summary(spark, sf_dir):
    return feed.rca_summary(rca_entries(spark, sf_dir))


@query(
    "live_feed",
    ("log_entries", "incident_entries", "rca_entries", "history_entries"),
    """SELECT 'telemetry' AS type, CAST(stream_id AS VARCHAR) AS id, concat('{"service_name":"', coalesce(service_name, 'unknown'),
              '","level":"', coalesce(level, 'INFO'), '","message":"', message, '"}') AS data FROM log_entries
       UNION ALL SELECT 'anomaly', entry_id, concat('{"incident_id":"', entry_id, '","service_name":"',
              coalesce(service_name, ''), '"}') FROM incident_entries
       UNION ALL SELECT 'rca', entry_id, concat('{"incident_id":"', coalesce(incident_id, entry_id), '","risk_level":"',
              coalesce(risk_level, 'LOW'), '"}') FROM rca_entries
       UNION ALL SELECT 'pending_remediation', entry_id, concat('{"incident_id":"', coalesce(incident_id, entry_id),
              '","service_name":"', coalesce(service_name, ''), '","risk_level":"', risk_level, '","target_command":"mock-remediation ',
              CASE WHEN contains(lower(suggested_fix), 'scale') THEN 'scale_up'
                   WHEN contains(lower(suggested_fix), 'db') THEN 'modify_db_pool' ELSE 'complex_mitigation' END, '"}')
              FROM rca_entries WHERE risk_level IN ('HIGH', 'CRITICAL')
       UNION ALL SELECT 'remediation_run', entry_id, concat('{"incident_id":"', coalesce(incident_id, ''), '","service_name":"',
              service_name, '","execution_type":"', execution_type, '","status":"', coalesce(status, ''), '"}')
              FROM history_entries""",
)
def live_feed(spark, sf_dir):
    flat = derived.table(spark, sf_dir, "log_entries")
    telemetry = entries.fields_from_columns(flat, "stream_id", ["service_name", "message", "level"])
    events = feed.live_feed(
        telemetry, incident_entries(spark, sf_dir), rca_entries(spark, sf_dir), history_entries(spark, sf_dir)
    )
    # Score text differs between engines; of the report events two fields are compared.
    picked = F.concat(
        F.lit('{"incident_id":"'), F.get_json_object("data", "$.incident_id"),
        F.lit('","risk_level":"'), F.get_json_object("data", "$.risk_level"), F.lit('"}'),
    )
    return events.withColumn("data", F.when(F.col("type") == "rca", picked).otherwise(F.col("data")))


@query(
    "severity_badges",
    ("rca",),
    """SELECT rca_id, CASE WHEN level IN ('ERROR','CRITICAL','WARNING') THEN level ELSE 'OTHER' END AS severity,
              CASE WHEN risk_level = 'BOGUS' THEN 'OTHER' ELSE risk_level END AS badge,
              CAST(CASE risk_level WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END AS BIGINT) AS rank
       FROM rca""",
)
def severity_badges(spark, sf_dir):
    risk = F.col("risk_level")
    return derived.table(spark, sf_dir, "rca").select(
        "rca_id", policy.severity_class(F.col("level")).alias("severity"),
        policy.risk_badge(risk).alias("badge"), policy.risk_rank(risk).alias("rank"),
    )


def templated(spark, sf_dir):
    return add_template(derived.logs(spark, sf_dir)).select("stream_id", "service_name", "normalized_message", "score")


@query(
    "dedup_signature",
    ("logs",),
    SQL_CHAIN
    + """ SELECT stream_id, row_number() OVER (PARTITION BY service_name, normalized_message ORDER BY stream_id) > 1
          AS is_duplicate FROM chain""",
)
def dedup_signature(spark, sf_dir):
    return dedup.flag_duplicates(templated(spark, sf_dir)).select("stream_id", "is_duplicate")


@query(
    "dedup_keep_first",
    ("logs",),
    SQL_CHAIN
    + " SELECT min(stream_id) AS stream_id, service_name, normalized_message FROM chain GROUP BY service_name, normalized_message",
)
def dedup_keep_first(spark, sf_dir):
    return dedup.keep_first(templated(spark, sf_dir)).select("stream_id", "service_name", "normalized_message")


@query(
    "llm_reduction",
    ("logs",),
    SQL_CHAIN
    + """ SELECT count(*) AS anomalies, count(DISTINCT concat(service_name, ':', normalized_message)) AS signatures,
          round((count(*) - count(DISTINCT concat(service_name, ':', normalized_message))) * 100.0 / count(*), 6) AS reduction_pct
          FROM chain JOIN (SELECT stream_id, score FROM logs) s USING (stream_id) WHERE score > 0.55""",
)
def llm_reduction(spark, sf_dir):
    return dedup.call_reduction(templated(spark, sf_dir).filter(F.col("score") > 0.55))


_TIERS = (
    (1, "restart_service", "low", 0.85, None, "LOW"), (2, "scale_up", None, 0.80, None, "LOW"),
    (3, "restart_service", "high", None, None, "MEDIUM"), (4, "drain_connections", None, 0.75, None, "MEDIUM"),
    (5, "failover_database", None, None, None, "HIGH"), (6, "rollback_deployment", "production", None, None, "HIGH"),
    # Overlaps, a range with both ends, a rule for any action, one that is never first.
    (7, "restart_service", None, 0.10, 0.60, "MEDIUM"), (8, "restart_service", "low", 0.30, 0.50, "HIGH"),
    (9, None, "low", 0.55, 0.70, "LOW"), (10, None, None, 0.95, None, "CRITICAL"), (11, "scale_up", None, 0.80, None, "HIGH"),
)
_TIER_VALUES = ", ".join(
    "(" + ", ".join("NULL" if x is None else repr(x) for x in rule) + ")" for rule in _TIERS
)
_ACTIONS = """SELECT stream_id,
              CASE stream_id % 7 WHEN 0 THEN 'restart_service' WHEN 1 THEN 'scale_up' WHEN 2 THEN 'restart_service'
                   WHEN 3 THEN 'drain_connections' WHEN 4 THEN 'failover_database' WHEN 5 THEN 'rollback_deployment' END AS action,
              CASE user_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'production' END AS criticality,
              CASE WHEN stream_id % 13 = 0 THEN NULL ELSE CAST(stream_id % 101 AS DOUBLE) / 100 END AS confidence FROM logs"""


@query(
    "risk_tiers",
    ("logs",),
    f""", acts AS ({_ACTIONS}),
       rules(priority, action, criticality, above, up_to, tier) AS (VALUES {_TIER_VALUES}),
       met AS (SELECT stream_id, r.priority, r.tier, row_number() OVER (PARTITION BY stream_id ORDER BY r.priority, r.tier) AS n
               FROM acts a JOIN rules r ON (r.action IS NULL OR r.action = a.action) AND (r.criticality IS NULL OR r.criticality = a.criticality)
                    AND (r.above IS NULL OR a.confidence > r.above) AND (r.up_to IS NULL OR a.confidence <= r.up_to))
       SELECT a.stream_id, m.tier AS risk_tier, CAST(m.priority AS BIGINT) AS risk_rule FROM acts a LEFT JOIN met m ON a.stream_id = m.stream_id AND n = 1""",
)
def risk_tiers(spark, sf_dir):
    logs = derived.table(spark, sf_dir, "logs")
    acts = spark.sql(_ACTIONS.replace("FROM logs", "FROM {logs}"), logs=logs)
    rules = spark.createDataFrame(_TIERS, risk_rules.RULES)
    return risk_rules.assign(acts, rules).select("stream_id", "risk_tier", "risk_rule")
