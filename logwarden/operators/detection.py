"""Scores per event, the training gate, and incident rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.scoring import anomaly_score, check_threshold, is_anomaly
from logwarden.operators import context, forest, vectors
from logwarden.operators.entries import iso_text
from logwarden.operators.ordering import order_splits
from logwarden.operators.templates import add_template
from logwarden.schemas import ANOMALY_THRESHOLD, CONTEXT_WINDOW, MICRO_BATCH, TRAIN_THRESHOLD
from logwarden.sources.tables import materialised


def gate_rows(batch_size: int = MICRO_BATCH, threshold: int = TRAIN_THRESHOLD) -> tuple[int, int]:
    """(rows stored when training starts, rows of earlier batches, which stay unscored)."""
    trained = math.ceil(threshold / batch_size) * batch_size
    return trained, trained - batch_size


def gate_state(
    stored: DataFrame, batch_size: int = MICRO_BATCH, threshold: int = TRAIN_THRESHOLD
) -> DataFrame:
    """Whether the gate has opened, on how many rows, and how many rows precede it."""
    trained, cold = gate_rows(batch_size, threshold)
    n = F.count(F.lit(1))
    opened = n >= threshold
    return stored.agg(
        n.alias("stored"),
        opened.alias("is_open"),
        F.when(opened, F.least(n, F.lit(trained))).otherwise(F.lit(0)).cast("bigint").alias("train_rows"),
        F.when(opened, F.lit(cold)).otherwise(n).cast("bigint").alias("cold_rows"),
    )


def baseline_ids(
    stored: DataFrame, batch_size: int = MICRO_BATCH, threshold: int = TRAIN_THRESHOLD, order: str = "stream_id"
) -> tuple | None:
    """(last id that trains, first id that is scored) once enough rows are stored, else None.

    Both follow from the smallest ids alone, so they don't depend on how rows came in.
    """
    trained, cold = gate_rows(batch_size, threshold)
    ids = [row[0] for row in stored.select(order).orderBy(order).limit(trained).collect()]
    return (ids[-1], ids[cold]) if len(ids) >= threshold else None


def train_baseline(
    logs: DataFrame,
    encoder=None,
    batch_size: int = MICRO_BATCH,
    threshold: int = TRAIN_THRESHOLD,
    order: str = "stream_id",
    **options,
):
    """(model, first scored id) from the rows stored when the gate opens, or (None, None).

    The ids that open the gate are found on the id column alone; the training
    rows are then read by a filter the scan can use.
    """
    ids = baseline_ids(logs, batch_size, threshold, order)
    if ids is None:
        return None, None
    first = add_template(logs.filter(F.col(order) <= F.lit(ids[0])))
    return forest.fit(vectors.encode(first, encoder=encoder), order, **options), ids[1]


def score_templates(templated: DataFrame, model, encoder=None) -> DataFrame:
    """(normalized_message, anomaly_score), computed once per distinct template."""
    distinct = templated.select("normalized_message").distinct()
    scored = forest.score(vectors.encode(distinct, encoder=encoder), model)
    return scored.select("normalized_message", anomaly_score(F.col("raw_score")).alias("anomaly_score"))


def score_events(templated: DataFrame, model, encoder=None) -> DataFrame:
    """Add anomaly_score to every event; 0.0 everywhere without a model."""
    if model is None:
        return templated.withColumn("anomaly_score", F.lit(0.0))
    templated = materialised(templated, "templates")  # masked once, read for templates and rows
    return templated.join(score_templates(templated, model, encoder), "normalized_message", "left")


def frame_struct() -> Column:
    """The log frame kept as context."""
    return F.struct(
        F.col("service_name"),
        iso_text(F.col("timestamp")).alias("timestamp"),
        F.col("level"),
        F.col("message"),
        F.col("stream_id").cast("string").alias("stream_id"),
        F.col("metadata"),
    )


def incident_rows(flagged: DataFrame, threshold: float, detected_at: Column | None = None) -> DataFrame:
    """Incident frames from events that carry score and context."""
    when = F.unix_micros(F.current_timestamp()) / 1e6 if detected_at is None else detected_at
    return flagged.select(
        F.concat(F.lit("incident-"), F.col("stream_id").cast("string")).alias("incident_id"),
        F.col("stream_id").cast("string").alias("source_stream_id"),
        "service_name",
        iso_text(F.col("timestamp")).alias("timestamp"),
        "level",
        F.col("message").alias("raw_message"),
        "normalized_message",
        "anomaly_score",
        F.lit(threshold).alias("anomaly_threshold"),
        F.size("context_window").alias("context_window_size"),
        "context_window",
        "metadata",
        when.alias("detected_at"),
    )


def incidents_from_scores(
    scored: DataFrame,
    threshold: float = ANOMALY_THRESHOLD,
    window_size: int = CONTEXT_WINDOW,
    detected_at: Column | None = None,
    splits: list[float] | None = None,
) -> DataFrame:
    """Events with anomaly_score to incident frames, each with its service's last rows."""
    framed = context.context_frames(scored, frame_struct(), window_size, splits=splits)
    return incident_rows(framed.filter(is_anomaly(F.col("anomaly_score"), threshold)), threshold, detected_at)


def detect(
    logs: DataFrame,
    model=None,
    encoder=None,
    threshold: float = ANOMALY_THRESHOLD,
    window_size: int = CONTEXT_WINDOW,
    batch_size: int = MICRO_BATCH,
    train_threshold: int = TRAIN_THRESHOLD,
    detected_at: Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Logs to incidents in one plan: template, vector, score, filter, context.

    Without a model the baseline is trained on the rows stored when the gate
    opens, and rows of earlier batches keep score 0.0.
    """
    check_threshold(threshold)
    templated = add_template(logs)
    first_id = None
    if model is None:
        model, first_id = train_baseline(logs, encoder, batch_size, train_threshold)
    if model is None:
        scored = templated.withColumn("anomaly_score", F.lit(0.0))
    else:
        templated = materialised(templated, "templates")
        # Only anomalous templates are joined back, usually few.
        anomalous = score_templates(templated, model, encoder).filter(
            is_anomaly(F.col("anomaly_score"), threshold)
        )
        scored = templated.join(anomalous, "normalized_message", "left")
        if first_id is not None:
            scored = scored.withColumn(
                "anomaly_score",
                F.when(F.col("stream_id") >= F.lit(first_id), F.col("anomaly_score")).otherwise(F.lit(0.0)),
            )
    splits = order_splits(logs, "stream_id", buckets)
    return incidents_from_scores(scored, threshold, window_size, detected_at, splits)
