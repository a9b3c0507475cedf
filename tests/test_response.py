import json

import pytest
from pyspark.sql import functions as F

from logwarden.functions import policy
from logwarden.operators import rca, recent, remediation


def test_policy(spark):
    cases = [
        ("LOW", "Flush the Cache", "AUTO_EXECUTE", "clear_cache"),
        ("MEDIUM", "restart cache", "AUTO_EXECUTE", "clear_cache"),
        ("MEDIUM", "Restart", "AUTO_EXECUTE", "restart_daemon"),
        ("BOGUS", "scale", "AUTO_EXECUTE", "benign_routine"),
        ("HIGH", "scale the db", "WEBHOOK_GATE", "scale_up"),
        ("CRITICAL", "bigger POOL", "WEBHOOK_GATE", "modify_db_pool"),
        ("CRITICAL", None, "WEBHOOK_GATE", "complex_mitigation"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "risk string, fix string")
    got = df.select(
        policy.execution_type(F.col("risk")), policy.target_command(F.col("risk"), F.col("fix"))
    ).collect()
    assert [tuple(r) for r in got] == [(c[2], f"mock-remediation {c[3]}") for c in cases]
    feed = spark.createDataFrame([("bigger pool",), ("db",)], "fix string").select(policy.feed_command(F.col("fix")))
    assert [r[0].split()[1] for r in feed.collect()] == ["complex_mitigation", "modify_db_pool"]


def test_reports_are_strict(spark):
    good = {"root_cause": "a", "suggested_fix": "b", "risk_level": "LOW", "impact_analysis": "c"}
    texts = [
        json.dumps(good), json.dumps(good | {"risk_level": "VERY_HIGH"}), json.dumps(good | {"root_cause": 3}),
        json.dumps({k: v for k, v in good.items() if k != "impact_analysis"}), "x", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "report string")
    errors = [r["report_error"] for r in rca.validate_report(df).collect()]
    assert errors == [None, "risk_level", "root_cause", "impact_analysis", "json", "json"]
    assert [rca._read(t)[0] for t in texts[:5]] == errors[:5]


def test_analyser_is_retried(spark):
    def load():
        calls = {}

        def analyse(service, message, prompt):
            calls[message] = calls.get(message, 0) + 1
            if message == "never" or (message == "later" and calls[message] < 3):
                raise RuntimeError("busy")
            if message == "bad":
                return "{}"
            return json.dumps({"root_cause": prompt, "suggested_fix": "f", "risk_level": "HIGH", "impact_analysis": ""})

        return analyse

    context = "array<struct<timestamp:string,level:string,message:string>>"
    df = spark.createDataFrame(
        [("1", "s", "first", [("t", "INFO", "m")]), ("2", "s", "later", []), ("3", "s", "never", []), ("4", "s", "bad", [])],
        f"incident_id string, service_name string, raw_message string, context_window {context}",
    )
    df = df.withColumns({c: F.lit("") for c in ("timestamp", "level", "normalized_message")}).withColumn("anomaly_score", F.lit(0.7))
    out = rca.enrich(df, load, backoff_s=0.0).cache()
    rows = {r["incident_id"]: r for r in out.collect()}
    assert [(rows[i]["status"], rows[i]["attempts"]) for i in "1234"] == [
        ("success", 1), ("success", 3), ("error", 3), ("error", 3)
    ]
    assert rows["3"]["error"] == "RuntimeError: busy" and "risk_level" not in rows["4"]["error"]
    assert rows["1"]["context_window"][0]["message"] == "m"
    made = {r["incident_id"]: r for r in rca.insights(out, F.lit(1.0)).collect()}
    assert set(made) == {"1", "2"} and "[t] INFO - m" in made["1"]["root_cause"]
    assert "No preceding log history." in made["2"]["root_cause"]
    assert rca.failures(out).count() == 2


def test_decisions(spark):
    pending = spark.createDataFrame(
        [(i, "s", "remediate-high", "HIGH", "mock-remediation scale_up") for i in ("a", "b", "c")],
        "incident_id string, service_name string, action_id string, risk_level string, target_command string",
    )
    decisions = spark.createDataFrame(
        [(1, "a", "approve", 5.0), (2, "a", "deny", 6.0), (3, "b", "deny", 7.0), (4, "x", "approve", 8.0)],
        "decision_id bigint, incident_id string, decision string, decided_at double",
    )
    approved = remediation.approve(pending, decisions, policy.action_result).collect()
    assert [(r["incident_id"], r["status"], r["stdout"], r["timestamp"]) for r in approved] == [
        ("a", "SUCCESS", "[MOCK_HEALING] Executed action: scale_up", 5.0)
    ]
    assert [(r["status"], r["stdout"]) for r in remediation.approve(pending, decisions).collect()] == [("PLANNED", "")]
    denied = remediation.deny(pending, decisions).collect()
    assert [(r["incident_id"], r["status"], r["stderr"]) for r in denied] == [("b", "ABORTED", "Mitigation Aborted by Operator")]
    assert sorted(r["decision_id"] for r in remediation.unknown_decisions(pending, decisions).collect()) == [2, 4]
    assert [r["incident_id"] for r in remediation.pending_after(pending, decisions).collect()] == ["c"]


def test_read_limits(spark):
    df = spark.range(200).select(F.format_string("i%03d", "id").alias("stream_id"))
    assert recent.recent_incidents(df).count() == 20
    assert recent.recent_incidents(df, 100).first()[0] == "i199"
    for bad in (0, 101):
        with pytest.raises(ValueError):
            recent.recent_incidents(df, bad)
    decoded = recent.recent_incidents(df, 3, decode=lambda rows: rows.select(F.upper("stream_id").alias("x")))
    assert {r["x"] for r in decoded.collect()} == {"I199", "I198", "I197"}


def test_frames_without_message_show_the_raw_one(spark):
    frame = "array<struct<timestamp:string,level:string,message:string,raw_message:string>>"
    df = spark.createDataFrame([("s", "m", [("t", None, None, "raw")])], f"service_name string, raw_message string, context_window {frame}")
    assert "[t] UNKNOWN - raw" in rca.with_prompt(df).first()["prompt"]
