"""Accept or reject log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import strip
from logwarden.schemas import LEVELS, MESSAGE_MAX, SERVICE_NAME_MAX

# Fixed value: rejection reasons.
REASONS = ("service_name", "message", "level", "timestamp", "metadata")


def _errors(checks: dict[str, Column]) -> Column:
    flagged = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.filter(F.array(*flagged), lambda reason: reason.isNotNull())


def _clean_service(raw: Column) -> Column:
    return F.lower(strip(raw))


def _length_between(col: Column, upper: int) -> Column:
    return F.length(col).between(1, upper)


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 with or without offset (UTC when naive); epoch numbers too."""
    # A naive time is read without a zone and then taken as UTC, whatever the session's zone.
    zoned = text.rlike(r"(?i)(?:[0-9](?:z|[+-][0-9]{1,2}(?::?[0-9]{2})?)|[ 0-9][a-z]+(?:/[a-z_]+)*)\s*$")
    naive = F.concat(text.try_cast("timestamp_ntz").cast("string"), F.lit("Z"))
    # A date has its own dashes: only what follows a time can be an offset.
    dated = text.rlike(r"^\s*[+-]?[0-9]{4,7}(?:-[0-9]{1,2}){0,2}\s*$")
    instant = F.when(zoned & ~dated, F.try_to_timestamp(text)).otherwise(F.try_to_timestamp(naive))

    def from_number(n: Column) -> Column:
        # Fixed value: numbers above this are milliseconds.
        seconds = F.when(F.abs(n) > 2e10, n / 1000).otherwise(n)
        micros = F.timestamp_micros((seconds * 1_000_000).cast("bigint"))
        return F.when(n.isNotNull(), micros).otherwise(instant)

    # Bound as a lambda variable, the number is parsed once per row. No number holds a colon,
    # and a text that is not one costs an exception.
    number = F.when(~text.contains(":"), text.try_cast("double"))
    return F.get(F.transform(F.array(number), from_number), F.lit(0))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row, whatever refers to them.

    A filter on a plain column is moved below it, where the expression is run a second time
    and all its uses multiply. What a generator puts out stays where it is.
    """
    made = df.withColumns(columns)
    row = F.struct(*[F.col(name) for name in columns])
    rest = [F.col(f"`{c}`") for c in df.columns]
    out = made.select(*rest, F.explode(F.array(row)).alias("_once"))
    return out.select(*rest, *[F.col(f"_once.{name}") for name in columns])


def validate(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Normalise typed events and add ``errors`` (empty when the row is accepted).

    NULL level, timestamp and metadata mean "not given" and take their defaults.
    Columns other than the five event fields pass through.
    """
    given = F.col("timestamp")
    is_text = dict(events.dtypes)["timestamp"] == "string"
    cleaned = {
        "_checked_service": _clean_service(F.col("service_name")),
        "_checked_message": strip(F.col("message")),
        "_checked_time": parse_timestamp(given) if is_text else given.cast("timestamp"),
    }
    service, message, parsed = (F.col(name) for name in cleaned)
    level = F.coalesce(F.col("level"), F.lit("INFO"))
    default_time = F.current_timestamp() if now is None else now
    when = F.when(given.isNull(), default_time).otherwise(parsed)
    checks = {
        "service_name": _length_between(service, SERVICE_NAME_MAX),
        "message": _length_between(message, MESSAGE_MAX),
        "level": level.isin(*LEVELS),
        "timestamp": given.isNull() | parsed.isNotNull(),
    }
    return once(events, cleaned).withColumns(
        {
            "errors": _errors(checks),
            "service_name": service,
            "message": message,
            "level": level,
            "timestamp": when,
            "metadata": F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")),
        }
    ).drop(*cleaned)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") == 0).drop("errors")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") > 0)


def validate_json(lines: DataFrame, column: str = "value", now: Column | None = None) -> DataFrame:
    """Parse and check one JSON event per row, with its value types.

    A string field given as a number, an explicit null, or a metadata value that
    is not a string rejects the row, as does text that is not a JSON object.
    """
    names = ("service_name", "message", "level", "timestamp")
    doc = lines.withColumn("_doc", F.try_parse_json(column))

    def kind(path: str) -> Column:
        return F.expr(f"schema_of_variant(try_variant_get(_doc, '$.{path}', 'variant'))")

    # Each field and its type are taken from the document once.
    got = doc.withColumns(
        {f"_k_{n}": kind(n) for n in names}
        | {f"_t_{n}": F.expr(f"try_variant_get(_doc, '$.{n}', 'string')") for n in names}
        | {
            "_values": F.expr("try_variant_get(_doc, '$.metadata', 'map<string,variant>')"),
            "_given": kind("metadata").isNotNull(),
        }
    )
    texts = {n: F.when(F.col(f"_k_{n}") == "STRING", F.col(f"_t_{n}")) for n in names}
    time_ok = F.col("_k_timestamp").rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*)$")
    clean = once(
        got,
        {
            "_service": _clean_service(texts["service_name"]),
            "_message": strip(texts["message"]),
            "_level": F.when(F.col("_k_level").isNull(), F.lit("INFO")).otherwise(texts["level"]),
            "_time": F.when(time_ok, parse_timestamp(F.col("_t_timestamp"))),
            "_meta_ok": F.forall(F.map_values("_values"), lambda v: F.schema_of_variant(v) == "STRING"),
        },
    )
    default_time = F.current_timestamp() if now is None else now
    no_time = F.col("_k_timestamp").isNull()
    checks = {
        "service_name": _length_between(F.col("_service"), SERVICE_NAME_MAX),
        "message": _length_between(F.col("_message"), MESSAGE_MAX),
        "level": F.col("_level").isin(*LEVELS),
        "timestamp": no_time | F.col("_time").isNotNull(),
        "metadata": ~F.col("_given") | F.col("_meta_ok"),
    }
    return clean.select(
        *lines.columns,
        F.col("_service").alias("service_name"),
        F.when(no_time, default_time).otherwise(F.col("_time")).alias("timestamp"),
        F.col("_level").alias("level"),
        F.col("_message").alias("message"),
        F.coalesce(
            F.transform_values("_values", lambda k, v: v.cast("string")),
            F.create_map().cast("map<string,string>"),
        ).alias("metadata"),
        F.when(F.col("_doc").isNull(), F.array(F.lit("json"))).otherwise(_errors(checks)).alias("errors"),
    )
