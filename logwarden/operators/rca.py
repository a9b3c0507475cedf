"""Root-cause reports: prompt, analyser calls, validation, insight rows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.schemas import RISKS

# Retry policy, report fields, text used without context.
MAX_ATTEMPTS = 3
FIRST_BACKOFF_S = 1.0
REPORT_FIELDS = ("root_cause", "suggested_fix", "risk_level", "impact_analysis")
NO_HISTORY = "No preceding log history."

# Takes (service_name, raw_message, prompt) and returns the report as JSON text.
Analyser = Callable[[str, str, str], str]


def context_text(window: Column, raw: bool = False) -> Column:
    """One ``[time] LEVEL - message`` line per frame; with ``raw``, frames without a message show ``raw_message``."""
    lines = F.transform(
        window,
        lambda f: F.concat(
            F.lit("["),
            F.coalesce(f["timestamp"], F.lit("")),
            F.lit("] "),
            F.coalesce(f["level"], F.lit("UNKNOWN")),
            F.lit(" - "),
            F.coalesce(f["message"], *([f["raw_message"]] if raw else []), F.lit("")),
        ),
    )
    return F.when(F.size(F.coalesce(window, F.array())) > 0, F.array_join(lines, "\n")).otherwise(
        F.lit(NO_HISTORY)
    )


def prompt_text(service: Column, message: Column, window: Column, raw: bool = False) -> Column:
    return F.concat(
        F.lit("Find the root cause of an anomaly in a microservice.\nService: "),
        F.coalesce(service, F.lit("unknown")),
        F.lit("\nAnomalous message: "),
        F.coalesce(message, F.lit("")),
        F.lit("\nLog lines before it:\n"),
        context_text(window, raw),
        F.lit(
            "\nAnswer with one JSON object holding the strings root_cause, suggested_fix, "
            "impact_analysis and risk_level (LOW, MEDIUM, HIGH or CRITICAL), and nothing else."
        ),
    )


def with_prompt(incidents: DataFrame) -> DataFrame:
    raw = "raw_message" in incidents.schema["context_window"].dataType.elementType.names
    return incidents.withColumn(
        "prompt", prompt_text(F.col("service_name"), F.col("raw_message"), F.col("context_window"), raw)
    )


def validate_report(df: DataFrame, column: str = "report") -> DataFrame:
    """Add the four report fields and ``report_error`` (NULL when the report is valid)."""
    doc = df.withColumn("_doc", F.try_parse_json(column))

    def kind(name: str) -> Column:
        return F.expr(f"schema_of_variant(try_variant_get(_doc, '$.{name}', 'variant'))")

    def text(name: str) -> Column:
        return F.expr(f"try_variant_get(_doc, '$.{name}', 'string')")

    is_object = F.coalesce(F.schema_of_variant("_doc").startswith("OBJECT"), F.lit(False))
    problem = F.when(~is_object, F.lit("json"))
    for name in REPORT_FIELDS:
        problem = problem.when(F.coalesce(kind(name) != "STRING", F.lit(True)), F.lit(name))
    problem = problem.when(~text("risk_level").isin(*RISKS), F.lit("risk_level"))
    valid = problem.isNull()
    return doc.withColumns(
        {name: F.when(valid, text(name)) for name in REPORT_FIELDS} | {"report_error": problem}
    ).drop("_doc")


def _no_repeats(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _no_constant(name: str):
    raise ValueError(name)


def _read(text) -> tuple[str | None, tuple]:
    """(problem, report fields) of an answer, by the rules of ``validate_report``.

    JSON is taken strictly: a repeated key, NaN or Infinity make it invalid.
    """
    nothing = (None,) * len(REPORT_FIELDS)
    try:
        report = json.loads(text.strip(), object_pairs_hook=_no_repeats, parse_constant=_no_constant)
    except (ValueError, AttributeError, RecursionError):
        return "json", nothing
    if not isinstance(report, dict):
        return "json", nothing
    for name in REPORT_FIELDS:
        if not isinstance(report.get(name), str):
            return name, nothing
    if report["risk_level"] not in RISKS:
        return "risk_level", nothing
    return None, tuple(report[name] for name in REPORT_FIELDS)


def _ask(analyse: Analyser, request: tuple, attempts: int, backoff: float) -> tuple:
    """(report, report fields, attempts used, error, seconds); invalid reports are retried as well."""
    started = time.monotonic()
    error = None
    for attempt in range(1, attempts + 1):
        try:
            report = analyse(*request)
            error, fields = _read(report)
            if error is None:
                return report, *fields, attempt, None, time.monotonic() - started
            error = f"invalid report: {error}"
        except Exception as failure:  # any analyser failure is retried, the last is kept
            error = f"{type(failure).__name__}: {failure}"
        if attempt < attempts:
            time.sleep(backoff)
            backoff *= 2.0
    return None, *(None,) * len(REPORT_FIELDS), attempts, error, time.monotonic() - started


def enrich(
    incidents: DataFrame,
    make_analyser: Callable[[], Analyser],
    max_attempts: int = MAX_ATTEMPTS,
    backoff_s: float = FIRST_BACKOFF_S,
    tasks: int | None = None,
) -> DataFrame:
    """Call the analyser for each incident; adds the report, its fields, attempts, status, error, seconds.

    ``make_analyser`` runs once per task. ``tasks`` spreads slow calls evenly. The answer
    is judged once, here: ``status`` is ``success`` for a valid report and ``error`` for
    anything else. Incident columns pass through as Arrow data, unchanged.
    """
    prompted = with_prompt(incidents)
    if tasks:
        prompted = prompted.repartition(tasks, "incident_id")
    own = [f for f in incidents.schema.fields if f.name != "incident_id"]
    packed = prompted.select(
        "incident_id", "service_name", "raw_message", "prompt", F.struct(*[f"`{f.name}`" for f in own]).alias("_payload")
    )
    added = (
        [(n, pa.string(), T.StringType()) for n in ("report", *REPORT_FIELDS)]
        + [("attempts", pa.int32(), T.IntegerType()), ("error", pa.string(), T.StringType()), ("seconds", pa.float64(), T.DoubleType())]
    )
    schema = T.StructType(
        [packed.schema["incident_id"], packed.schema["_payload"]]
        + [T.StructField(n, kind) for n, _, kind in added]
    )

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyse = make_analyser()
        for batch in batches:
            asked = zip(*(batch.column(n).to_pylist() for n in ("service_name", "raw_message", "prompt")))
            answers = [_ask(analyse, request, max_attempts, backoff_s) for request in asked]
            columns = [pa.array([a[k] for a in answers], type=kind) for k, (_, kind, _) in enumerate(added)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("incident_id"), batch.column("_payload"), *columns],
                names=["incident_id", "_payload", *[n for n, _, _ in added]],
            )

    answered = packed.mapInArrow(call, schema)
    status = F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("error"))
    return answered.select(
        "incident_id", *[F.col("_payload")[f.name].alias(f.name) for f in own],
        "report", *REPORT_FIELDS, "attempts", status.alias("status"), "error", "seconds",
    )


def insights(enriched: DataFrame, analyzed_at: Column | None = None) -> DataFrame:
    """RCA rows of the incidents that were answered; latency to three decimals."""
    when = F.unix_micros(F.current_timestamp()) / 1e6 if analyzed_at is None else analyzed_at
    return enriched.filter(F.col("status") == "success").select(
        F.concat(F.lit("rca-"), F.col("incident_id").cast("string")).alias("rca_id"),
        "incident_id", "service_name", "timestamp", "level", "raw_message", "normalized_message",
        "anomaly_score", "root_cause", "suggested_fix", "risk_level", "impact_analysis",
        F.round("seconds", 3).alias("generation_time_s"),
        when.alias("analyzed_at"),
    )


def failures(enriched: DataFrame) -> DataFrame:
    """The other incidents: those without a valid report, kept for another try."""
    return enriched.filter(~F.col("status").eqNullSafe("success")).drop("report", *REPORT_FIELDS)
