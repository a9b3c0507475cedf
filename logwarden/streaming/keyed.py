"""Held actions with an expiry as keyed state in Spark's state store, by shard of incident ids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logwarden.streaming.approvals import HELD, OUTCOME, from_text, outcomes_of, shard, to_text

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCORED = (
    "stream_id BIGINT, service_name STRING, timestamp TIMESTAMP, level STRING, message STRING, "
    "metadata MAP<STRING, STRING>, normalized_message STRING, anomaly_score DOUBLE"
)
SCORED_NAMES = (
    "stream_id", "service_name", "timestamp", "level", "message", "metadata", "normalized_message", "anomaly_score"
)
#: An action without a time never expires, and a decision without one is in time for such an action alone.
NEVER_MS = 1 << 61
#: Events that come this much after the newest one are dropped by the watermark.
LATENESS = "10 minutes"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, which keyed state needs and which spills to local disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class HeldActions(StatefulProcessor):
    """An action is held until its first decision in time, or until its time is over.

    A key of the state is a shard of incidents, with one timer, for the action that ends first.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "held STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self._held()
        new = best = None
        for part in rows:
            asked = part["decision_id"].notna()
            if not asked.all():
                actions = part.loc[~asked, ["incident_id", *HELD, "at_ms"]]
                actions = actions.assign(order=actions["target_command"].fillna(""))
                new = actions if new is None else pd.concat([new, actions])
                # Of an action that comes several times the latest counts.
                new = new.sort_values(["at_ms", "order"], kind="stable").drop_duplicates("incident_id", keep="last")
            if asked.any():
                asked = part.loc[asked, ["incident_id", "decision_id", "decision", "decided_at", "at_ms"]]
                best, passed_over = self._passed_over(asked if best is None else pd.concat([best, asked]))
                yield outcomes_of(passed_over)
        held = old
        if new is not None:
            new = new.drop(columns="order").assign(expires_ms=new["at_ms"] + self.ttl_ms)
            held = pd.concat([old[~old["incident_id"].isin(new["incident_id"])], new])
        if best is not None:
            # Of those in time the one with the smallest id releases the action.
            ends = held[["incident_id", "expires_ms"]].astype({"expires_ms": "int64"})
            timed = best.merge(ends, on="incident_id", how="left")
            in_time = timed["at_ms"] <= timed["expires_ms"].fillna(-(1 << 62))
            first = timed[in_time].sort_values("decision_id", kind="stable").drop_duplicates("incident_id")
            yield outcomes_of(timed.drop(first.index))
            yield outcomes_of(first, held)
            held = held[~held["incident_id"].isin(first["incident_id"])]
        self._keep(held)

    @staticmethod
    def _passed_over(asked: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The decisions that could be the first one in time, whenever that ends, and the others.

        They are those with no decision before them in time that has a smaller id, few of many.
        """
        asked = asked.astype({"decision_id": "int64", "at_ms": "int64"})
        asked = asked.sort_values(["at_ms", "decision_id"], kind="stable", ignore_index=True)
        before = asked.groupby("incident_id", dropna=False)["decision_id"].cummin()
        open_ = (asked["decision_id"] <= before) & ~asked.assign(least=before).duplicated(["incident_id", "least"])
        return asked[open_], asked[~open_]

    def _held(self) -> pd.DataFrame:
        text = self.state.get()[0] if self.state.exists() else "[]"
        return from_text(text, ["incident_id", *HELD, "at_ms", "expires_ms"])

    def _keep(self, held: pd.DataFrame) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held.empty:
            self.state.clear()
            return
        self.state.update((to_text(held),))
        ends = held.loc[held["at_ms"] < NEVER_MS, "expires_ms"]
        if len(ends):
            self.handle.registerTimer(int(ends.min()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = (held["at_ms"] < NEVER_MS) & (held["expires_ms"] <= until)
        gone = held[over]
        undecided = gone[["incident_id"]].assign(
            decision_id=None, decision="expired", decided_at=gone["expires_ms"].astype("float64") / 1000.0
        )
        yield outcomes_of(undecided, gone)
        self._keep(held[~over])

    def close(self) -> None:
        pass


def expiring_outcomes(pending: DataFrame, decisions: DataFrame, ttl_s: float, lateness: str = LATENESS) -> DataFrame:
    """One row per decision and one per action that expired undecided; ``found`` says that it ended an action.

    ``pending`` has ``held_at``, decisions have ``decided_at``, both in epoch seconds. A decision
    up to ``ttl_s`` after that releases the action; of several the one with the smallest id
    does. Later ones find nothing. An action expires once no event that could still decide it is
    expected: the newest event is more than ``lateness`` past its end. An action that comes
    again takes the place of the one that is held, and its time starts anew.
    """
    use_rocksdb(pending.sparkSession)
    none = {"decision_id": "bigint", "decision": "string", "decided_at": "double"}
    held = pending.select("incident_id", *HELD, *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.col("held_at").alias("at"))
    asked = decisions.select("incident_id", *[F.lit(None).cast("string").alias(c) for c in HELD], *none, F.col("decided_at").alias("at"))
    events = held.unionByName(asked).withColumn("event_time", F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint")))
    at_ms = F.coalesce(F.floor(F.nanvl("at", F.lit(None).cast("double")) * 1000).cast("bigint"), F.lit(NEVER_MS))
    events = events.withColumns({"at_ms": at_ms, "shard": shard()}).drop("at").withWatermark("event_time", lateness)
    return events.groupBy("shard").transformWithStateInPandas(
        HeldActions(int(ttl_s * 1000)), OUTCOME, "Append", "EventTime"
    )
