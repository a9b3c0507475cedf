"""Pending approvals as keyed state: held until the first decision arrives.

State is kept per shard of incident ids, not per id: a call into Python then has thousands of
rows, and its cost doesn't count for each action.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOME = (
    "incident_id STRING, decision_id BIGINT, decision STRING, decided_at DOUBLE, found BOOLEAN, "
    "service_name STRING, action_id STRING, risk_level STRING, target_command STRING"
)
#: What a held action consists of.
HELD = ("service_name", "action_id", "risk_level", "target_command")
#: Groups of incident ids that share one value of the state.
SHARDS = 512
_STATE = "held STRING"
_NAMES = [part.split()[0] for part in OUTCOME.split(", ")]


def shard(incident_id: str = "incident_id") -> Column:
    """The shard of an incident id."""
    return F.pmod(F.xxhash64(incident_id), F.lit(SHARDS)).cast("int")


def to_text(held: pd.DataFrame) -> str:
    """Held actions as the text that the state keeps."""
    return json.dumps(held.astype(object).where(held.notna(), None).to_numpy().tolist())


def from_text(text: str, names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(json.loads(text), columns=names, dtype=object)


def outcomes_of(asked: pd.DataFrame, held: pd.DataFrame | None = None) -> pd.DataFrame:
    """Outcome rows of decisions, which find the action of their incident in ``held`` (one each), if any."""
    if held is None or held.empty:
        out = asked.assign(found=False, **dict.fromkeys(HELD))
    else:
        out = asked.merge(held[["incident_id", *HELD]], on="incident_id", how="left", indicator="found")
        out["found"] = out["found"] == "both"
    return out[_NAMES].astype({"decision_id": "Int64", "decided_at": "float64"})


def decision_outcomes(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per decision; ``found`` is false when nothing is held under its id.

    Within a micro-batch held actions are seen before decisions, and decisions
    in the order of decision_id. The first decision releases the action.
    """
    held = pending.select("incident_id", *HELD).withColumn("decision_id", F.lit(None).cast("bigint"))
    asked = decisions.select("incident_id", "decision_id", "decision", "decided_at")
    events = held.unionByName(asked, allowMissingColumns=True).select(
        shard().alias("shard"), "incident_id", *HELD, "decision_id", "decision", "decided_at"
    )
    names = ["incident_id", *HELD]

    def resolve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Only the earliest decision can find an action, so the others are
        # passed on as they come and an incident with any number of them needs no memory.
        held = from_text(state.get[0], names) if state.exists else pd.DataFrame(columns=names, dtype=object)
        best = None
        for rows in batches:
            asked = rows["decision_id"].notna()
            if not asked.all():
                held = pd.concat([held, rows.loc[~asked, names]]).drop_duplicates("incident_id", keep="last")
            if not asked.any():
                continue
            asked = rows.loc[asked, ["incident_id", "decision_id", "decision", "decided_at"]]
            asked = asked.astype({"decision_id": "int64"})
            if best is not None:
                asked = pd.concat([best, asked])
            asked = asked.sort_values("decision_id", kind="stable")
            later = asked.duplicated("incident_id")
            best = asked[~later]
            yield outcomes_of(asked[later])
        if best is not None:
            yield outcomes_of(best, held)
            held = held[~held["incident_id"].isin(best["incident_id"])]
        if len(held):
            state.update((to_text(held),))
        elif state.exists:
            state.remove()

    return events.groupBy("shard").applyInPandasWithState(
        resolve, OUTCOME, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def history_of(outcomes: DataFrame, outcome=None) -> DataFrame:
    """History rows of the decisions that found an action."""
    from logwarden.operators import remediation

    found = outcomes.filter("found")
    held = found.select("incident_id", "service_name", "action_id", "risk_level", "target_command")
    taken = found.select("incident_id", "decision_id", "decision", "decided_at")
    return remediation.approve(held, taken, outcome).unionByName(remediation.deny(held, taken))
