"""From RCA rows to executed, pending, approved and denied actions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions import policy

# Actors, outcomes and the event name of the outbox.
BY_SYSTEM = "System (Auto)"
BY_APPROVAL = "Operator (Approved)"
BY_DENIAL = "Operator (Denied)"
ABORTED = "ABORTED"
PLANNED = "PLANNED"
ABORT_TEXT = "Mitigation Aborted by Operator"
OUTBOX_EVENT = "pending_remediation_approval"

# Takes the command and gives the struct (returncode, stdout, stderr) of its run.
Outcome = Callable[[Column], Column]

PENDING_COLUMNS = ("incident_id", "service_name", "action_id", "risk_level", "target_command")


def _now() -> Column:
    return F.unix_micros(F.current_timestamp()) / 1e6


def plan_actions(rca: DataFrame) -> DataFrame:
    """Add action_id, execution_type and target_command; unknown risks count as LOW."""
    risk = policy.known_risk(F.col("risk_level"))
    return rca.withColumns(
        {
            "action_id": policy.action_id(F.col("risk_level")),
            "execution_type": policy.execution_type(F.col("risk_level")),
            "target_command": policy.target_command(F.col("risk_level"), F.col("suggested_fix")),
            "risk_level": risk,
        }
    )


def _history(rows: DataFrame, execution_id: Column, kind: str, status: Column, stdout: Column,
             stderr: Column, duration: Column, by: str, at: Column) -> DataFrame:
    return rows.select(
        execution_id.alias("execution_id"),
        "incident_id", "service_name", "action_id", "risk_level", "target_command",
        F.lit(kind).alias("execution_type"),
        status.alias("status"),
        stdout.alias("stdout"),
        stderr.alias("stderr"),
        duration.alias("duration_s"),
        F.lit(by).alias("executed_by"),
        at.cast("double").alias("timestamp"),
    )


def _executed(
    rows: DataFrame, execution_id: Column, kind: str, by: str, at: Column, outcome: Outcome | None
) -> DataFrame:
    if outcome is None:
        return _history(rows, execution_id, kind, F.lit(PLANNED), F.lit(""), F.lit(""), F.lit(0.0), by, at)
    done = rows.withColumn("_result", outcome(F.col("target_command")))
    result = F.col("_result")
    return _history(
        done, execution_id, kind, policy.execution_status(result), result["stdout"],
        result["stderr"], F.lit(0.0), by, at,
    )


def auto_history(
    planned: DataFrame, executed_at: Column | None = None, outcome: Outcome | None = None
) -> DataFrame:
    """History rows of the actions that need no approval.

    ``outcome`` maps a command to the struct (returncode, stdout, stderr) of its run.
    Nothing is executed here: without it the status is ``PLANNED`` and the output empty.
    """
    auto = planned.filter(F.col("execution_type") == policy.AUTO)
    key = F.concat(F.lit("auto-"), F.col("rca_id").cast("string"))
    return _executed(auto, key, policy.AUTO, BY_SYSTEM, _now() if executed_at is None else executed_at, outcome)


def gated(planned: DataFrame) -> DataFrame:
    return planned.filter(F.col("execution_type") == policy.GATE)


def pending_actions(planned: DataFrame) -> DataFrame:
    """Actions held for approval; they have no history row yet."""
    return gated(planned).select(*PENDING_COLUMNS)


def notifications(planned: DataFrame) -> DataFrame:
    """Outbox payload per held action."""
    body = F.struct(
        F.lit(OUTBOX_EVENT).alias("event"),
        "incident_id", "service_name", "risk_level", "target_command", "root_cause", "suggested_fix",
    )
    return gated(planned).select("incident_id", F.to_json(body).alias("payload"))


def first_decisions(decisions: DataFrame) -> DataFrame:
    """The decision that takes effect per incident: the earliest by decision_id."""
    return decisions.groupBy("incident_id").agg(
        F.min_by(F.struct("decision_id", "decision", "decided_at"), "decision_id").alias("_d")
    ).select("incident_id", "_d.*")


def _decided(pending: DataFrame, decisions: DataFrame, wanted: str) -> DataFrame:
    effective = first_decisions(decisions).filter(F.col("decision") == wanted)
    return effective.join(pending, "incident_id")


def approve(pending: DataFrame, decisions: DataFrame, outcome: Outcome | None = None) -> DataFrame:
    """History rows of approved actions; ``timestamp`` is the time of the decision, ``outcome`` as above."""
    key = F.concat(F.lit("approve-"), F.col("incident_id").cast("string"))
    return _executed(
        _decided(pending, decisions, "approve"), key, policy.GATE, BY_APPROVAL, F.col("decided_at"), outcome
    )


def deny(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """History rows of denied actions."""
    key = F.concat(F.lit("deny-"), F.col("incident_id").cast("string"))
    return _history(
        _decided(pending, decisions, "deny"), key, policy.GATE, F.lit(ABORTED), F.lit(""),
        F.lit(ABORT_TEXT), F.lit(0.0), BY_DENIAL, F.col("decided_at"),
    )


def unknown_decisions(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that find no pending entry: never held, or already decided."""
    effective = first_decisions(decisions).join(pending.select("incident_id"), "incident_id", "left_semi")
    missed = decisions.join(effective.select("decision_id"), "decision_id", "left_anti")
    return missed.select(
        "decision_id",
        "incident_id",
        F.concat(F.lit("Nothing is held for incident "), F.col("incident_id").cast("string")).alias("error"),
    )


def pending_after(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    return pending.join(decisions.select("incident_id").distinct(), "incident_id", "left_anti")


def lineage(incidents: DataFrame, rca: DataFrame, history: DataFrame) -> DataFrame:
    """Every incident with its reports and the outcome of their actions.

    An incident has few reports, so the left side is the one that may be skewed, and
    adaptive execution splits it.
    """
    reports = rca.select("incident_id", "rca_id", "risk_level", "suggested_fix")
    outcomes = history.select("incident_id", "execution_id", "execution_type", "status")
    base = incidents.select("incident_id", "service_name", "anomaly_score")
    return base.join(reports, "incident_id", "left").join(outcomes, "incident_id", "left")
