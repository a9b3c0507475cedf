"""The chained stages: ingest, detect, analyse, remediate.

Each stage is one streaming query with its own checkpoint. It reads the folder
the stage before it writes. A batch is acknowledged by its checkpoint commit,
after its outputs are written; a replayed batch writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logwarden.functions.scoring import check_threshold, is_anomaly
from logwarden.operators import context, detection, forest, rca, remediation, vectors
from logwarden.operators.templates import add_template
from logwarden.operators.validation import accepted, rejected
from logwarden.schemas import (
    ANOMALY_THRESHOLD,
    CONTEXT_RING,
    CONTEXT_WINDOW,
    HISTORY,
    INCIDENTS,
    LOGS,
    PENDING,
    RCA,
    TRAIN_THRESHOLD,
    VECTOR_DIM,
)
from logwarden.streaming import approvals, keyed
from logwarden.streaming.files import (
    batch_done,
    make_folder,
    read_all,
    read_stream,
    totals,
    write_once,
)

# Micro-batch interval of a running stage; tests and drains use available_now.
INTERVAL = "500 milliseconds"

# What a stage's output is measured by.
ROWS = "count(1)"

VECTORS = (
    "stream_id BIGINT, service_name STRING, log_level STRING, timestamp TIMESTAMP, "
    "raw_message STRING, normalized_msg STRING, vector ARRAY<FLOAT>"
)
STORED = VECTORS + ", metadata MAP<STRING, STRING>"


def start_batches(
    df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], available_now: bool
) -> StreamingQuery:
    """Run ``handle`` on every micro-batch, over what has arrived or at intervals."""
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": INTERVAL}
    return writer.trigger(**trigger).start()


def placed(batch: DataFrame) -> DataFrame:
    """Add ``_at``: the row's partition and its place in it. What is numbered must be written with it."""
    return batch.withColumn("_at", F.monotonically_increasing_id())


def with_ids(written: DataFrame, batch_id: int) -> DataFrame:
    """Turn the ``_at`` of a written micro-batch into ``stream_id``: unique, without gaps inside the batch, and
    above those of earlier batches.

    A row's number is its place in its partition plus the sizes of the partitions before it. The
    batch's number makes up the upper bits. All of it follows from what was written, so
    outputs agree and a replay under other partition sizes gives the same ids.
    """
    parts = written.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    numbered = parts.join(F.broadcast(starts), "_part")  # one row per partition
    first = F.lit(batch_id << 40).cast("bigint")
    return numbered.withColumn("stream_id", first + F.col("_start") + F.col("_row")).drop("_at", "_part", "_row", "_start")


def start_ingest(validated: DataFrame, base: str, available_now: bool = False) -> StreamingQuery:
    """Validated events to ``telemetry`` and ``rejected``; ids are assigned here unless they carry them.

    Rows without ids are written to ``received`` before they are numbered; others are
    kept while both outputs are written, so that no line is parsed for each of them.
    """
    spark = validated.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        if "stream_id" not in batch.columns:
            given = placed(batch)
            write_once(given, f"{base}/received", batch_id)
            batch = with_ids(spark.read.schema(given.schema).parquet(f"{base}/received/batch_id={batch_id}"), batch_id)
        else:
            batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write_once(accepted(batch), f"{base}/telemetry", batch_id, ROWS)
            write_once(rejected(batch), f"{base}/rejected", batch_id)
        finally:
            batch.unpersist()

    make_folder(validated.sparkSession, f"{base}/telemetry")
    return start_batches(validated, f"{base}/_checkpoints/ingest", handle, available_now)


def start_detect(
    logs: DataFrame,
    base: str,
    encoder=None,
    threshold: float = ANOMALY_THRESHOLD,
    train_threshold: int = TRAIN_THRESHOLD,
    available_now: bool = False,
    dim: int = VECTOR_DIM,
) -> StreamingQuery:
    """Logs to ``scored``; keeps ``vectors`` and ``model`` below ``base``. ``start_context`` goes on from there.

    Rows whose vector has not ``dim`` components go to ``vectors_rejected`` as well. They
    neither train nor are scored, but stay in the context of others. Scores up to the
    threshold are not kept apart: they are 0.0.

    The forest is trained once, when ``train_threshold`` vectors are stored, on the rows
    with the smallest ids, and the same ids as in batch stay unscored. Batches before
    that raise no incidents.
    """
    check_threshold(threshold)
    spark = logs.sparkSession
    columns = ("stream_id", "service_name", "timestamp", "level", "message", "metadata")

    def trained(batch_id: int):
        model = forest.load(spark, f"{base}/model")
        if model is not None:
            return model
        stored, _ = vectors.split_by_dim(read_all(spark, f"{base}/vectors", VECTORS), dim)
        ids = detection.baseline_ids(stored, threshold=train_threshold)
        if ids is None:
            return None
        model = forest.fit(stored.filter(F.col("stream_id") <= F.lit(ids[0])))
        model.first_id = ids[1]
        forest.save(spark, model, f"{base}/model", 1)
        return model

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch_done(spark, f"{base}/scored", batch_id):
            return
        own = batch.select(*columns)
        encoded = vectors.encode(add_template(own), encoder=encoder).select(
            "stream_id", "service_name", F.col("level").alias("log_level"), "timestamp",
            F.col("message").alias("raw_message"), F.col("normalized_message").alias("normalized_msg"), "vector",
            "metadata",
        )
        write_once(encoded, f"{base}/vectors", batch_id)
        # Everything below reads what was written, so no row is masked twice.
        kept = spark.read.schema(STORED).parquet(f"{base}/vectors/batch_id={batch_id}")
        rows = kept.select(
            "stream_id", "service_name", "timestamp", F.col("log_level").alias("level"),
            F.col("raw_message").alias("message"), "metadata", F.col("normalized_msg").alias("normalized_message"),
        )
        usable, unusable = vectors.split_by_dim(kept, dim)
        write_once(unusable, f"{base}/vectors_rejected", batch_id)
        model = trained(batch_id)

        if model is None:
            scored = rows.withColumn("anomaly_score", F.lit(0.0))
        else:
            known = usable.groupBy(F.col("normalized_msg").alias("normalized_message")).agg(
                F.any_value("vector").alias("vector")
            )
            scores = forest.score(known, model).select(
                "normalized_message",
                detection.anomaly_score(F.col("raw_score")).alias("anomaly_score"),
            )
            scored = rows.join(
                scores.filter(is_anomaly(F.col("anomaly_score"), threshold)), "normalized_message", "left"
            )
            if model.first_id is not None:
                late = F.col("stream_id") >= F.lit(model.first_id)
                scored = scored.withColumn("anomaly_score", F.when(late, F.col("anomaly_score")).otherwise(F.lit(0.0)))
        scored = scored.withColumn("anomaly_score", F.coalesce("anomaly_score", F.lit(0.0)))
        write_once(scored.select(*keyed.SCORED_NAMES), f"{base}/scored", batch_id)

    make_folder(spark, f"{base}/scored")
    return start_batches(logs, f"{base}/_checkpoints/detect", handle, available_now)


def start_context(
    scored: DataFrame, base: str, threshold: float = ANOMALY_THRESHOLD, window_size: int = CONTEXT_WINDOW,
    detected_at: Column | None = None, available_now: bool = False,
) -> StreamingQuery:
    """Scored rows to ``incidents`` with the last rows of their service.

    Ids of a service grow from one micro-batch to the next. A batch reads the newest rows of
    each service that the batch before it left in ``ring`` and leaves the same behind, so no older
    folder is read. Its rows are windowed as in batch: a service of any size is many tasks.
    """
    check_threshold(threshold)
    if window_size < 1:
        raise ValueError("window_size must be at least 1")
    spark = scored.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        own = batch.select(*keyed.SCORED_NAMES)
        known = own.withColumn("_new", F.lit(True))
        if batch_id > 0 and batch_done(spark, f"{base}/ring", batch_id - 1):
            ring = spark.read.schema(keyed.SCORED).parquet(f"{base}/ring/batch_id={batch_id - 1}")
            known = ring.withColumn("_new", F.lit(False)).unionByName(known)
        framed = context.context_frames(known, detection.frame_struct(), window_size)
        flagged = framed.filter(F.col("_new") & is_anomaly(F.col("anomaly_score"), threshold))
        write_once(detection.incident_rows(flagged, threshold, detected_at), f"{base}/incidents", batch_id, ROWS)
        kept = context.ring_buffer(known.drop("_new"), max(CONTEXT_RING, window_size))
        write_once(kept, f"{base}/ring", batch_id)

    make_folder(spark, f"{base}/incidents")
    return start_batches(scored, f"{base}/_checkpoints/context", handle, available_now)


def detect_available(
    logs: DataFrame, base: str, threshold: float = ANOMALY_THRESHOLD, window_size: int = CONTEXT_WINDOW,
    detected_at: Column | None = None, max_files_per_trigger: int | None = None, **options,
) -> None:
    """Run detection and context over what has arrived, then stop."""
    start_detect(logs, base, threshold=threshold, available_now=True, **options).awaitTermination()
    scored = read_stream(logs.sparkSession, f"{base}/scored", keyed.SCORED, max_files_per_trigger)
    start_context(scored, base, threshold, window_size, detected_at, True).awaitTermination()


def start_analyse(
    incidents: DataFrame,
    base: str,
    make_analyser: Callable,
    analyzed_at: Column | None = None,
    available_now: bool = False,
    **options,
) -> StreamingQuery:
    """Incidents to ``rca``; unanswered ones to ``rca_failed``.

    Answers are written before anything is derived from them, so a lost executor
    never makes the two outputs disagree.
    """
    spark = incidents.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        asked = rca.enrich(batch, make_analyser, **options)
        write_once(asked, f"{base}/rca_requests", batch_id)
        answers = spark.read.schema(asked.schema).parquet(f"{base}/rca_requests/batch_id={batch_id}")
        write_once(rca.insights(answers, analyzed_at), f"{base}/rca", batch_id, ROWS)
        write_once(rca.failures(answers), f"{base}/rca_failed", batch_id)

    make_folder(spark, f"{base}/rca")
    return start_batches(incidents, f"{base}/_checkpoints/analyse", handle, available_now)


def start_remediate(
    reports: DataFrame, base: str, executed_at: Column | None = None, available_now: bool = False,
    outcome: remediation.Outcome | None = None,
) -> StreamingQuery:
    """Reports to ``history`` (automatic actions), ``pending`` and ``outbox``; see ``auto_history``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        planned = remediation.plan_actions(batch)
        write_once(remediation.auto_history(planned, executed_at, outcome), f"{base}/history", batch_id, ROWS)
        write_once(remediation.pending_actions(planned), f"{base}/pending", batch_id, ROWS)
        write_once(remediation.notifications(planned), f"{base}/outbox", batch_id)

    make_folder(reports.sparkSession, f"{base}/pending")
    return start_batches(reports, f"{base}/_checkpoints/remediate", handle, available_now)


def start_decide(
    pending: DataFrame, decisions: DataFrame, base: str, available_now: bool = False,
    outcome: remediation.Outcome | None = None, ttl_s: float | None = None,
) -> StreamingQuery:
    """Decisions on held actions to ``decided`` and ``history_decided``.

    The first decision releases an action; outcomes are written before history is
    derived from them. With ``ttl_s`` actions expire that long after their ``held_at``, see
    ``keyed.expiring_outcomes``.
    """
    spark = pending.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_once(batch, f"{base}/decided", batch_id, "count_if(found)")
        outcomes = spark.read.schema(approvals.OUTCOME).parquet(f"{base}/decided/batch_id={batch_id}")
        write_once(approvals.history_of(outcomes, outcome), f"{base}/history_decided", batch_id, ROWS)

    make_folder(spark, f"{base}/decided")
    if ttl_s is None:
        outcomes = approvals.decision_outcomes(pending, decisions)
    else:
        outcomes = keyed.expiring_outcomes(pending, decisions, ttl_s)
    return start_batches(outcomes, f"{base}/_checkpoints/decide", handle, available_now)


def open_actions(spark: SparkSession, base: str) -> DataFrame:
    """Held actions that no decision has released."""
    decided = read_all(spark, f"{base}/decided", approvals.OUTCOME).filter("found").select("incident_id")
    return read_all(spark, f"{base}/pending", PENDING).join(decided, "incident_id", "left_anti")


def drain(
    spark: SparkSession,
    validated: DataFrame,
    base: str,
    make_analyser: Callable,
    max_files_per_trigger: int | None = None,
    decisions: DataFrame | None = None,
    **detect_options,
) -> None:
    """Run all stages over what has arrived, one after the other, then stop.

    The last one, which needs a stream of decisions, is left out without it.
    """
    start_ingest(validated, base, True).awaitTermination()

    def source(name: str, schema: str) -> DataFrame:
        return read_stream(spark, f"{base}/{name}", schema, max_files_per_trigger)

    detect_available(source("telemetry", LOGS), base, max_files_per_trigger=max_files_per_trigger, **detect_options)
    start_analyse(
        source("incidents", INCIDENTS), base, make_analyser, available_now=True, backoff_s=0.0
    ).awaitTermination()
    start_remediate(source("rca", RCA), base, available_now=True).awaitTermination()
    if decisions is not None:
        start_decide(source("pending", PENDING), decisions, base, True).awaitTermination()


def gauges(spark: SparkSession, base: str) -> DataFrame:
    """(stream, length) of every stage, from the totals that each batch leaves: no output is counted again.

    The same numbers as :func:`stage_lengths`, where an action is not held twice.
    """
    known = totals(spark, base)
    amount = F.when(F.col("stream") == "decided", -F.col("total")).otherwise(F.col("total"))
    name = (
        F.when(F.col("stream") == "history_decided", "history").when(F.col("stream") == "decided", "pending").otherwise(F.col("stream"))
    )
    names = spark.createDataFrame([(s,) for s in ("telemetry", "incidents", "rca", "history", "pending")], "stream STRING")
    summed = known.groupBy(name.alias("stream")).agg(F.sum(amount).alias("length"))
    return names.join(summed, "stream", "left").select("stream", F.coalesce("length", F.lit(0)).alias("length"))


def stage_lengths(spark: SparkSession, base: str) -> DataFrame:
    """(stream, length) of every stage output: the periodic gauges.

    ``pending`` counts the actions that are still held, ``history`` automatic and decided ones.
    """
    from logwarden.operators.counters import stream_lengths

    schemas = {"telemetry": LOGS, "incidents": INCIDENTS, "rca": RCA, "history": HISTORY}
    streams = {name: read_all(spark, f"{base}/{name}", s) for name, s in schemas.items()}
    streams["history"] = streams["history"].unionByName(read_all(spark, f"{base}/history_decided", HISTORY))
    return stream_lengths(streams | {"pending": open_actions(spark, base)})
