import datetime as dt

from pyspark.sql import functions as F

from logwarden.operators.validation import accepted, rejected, validate, validate_json
from logwarden.sources.lines import parse_lines


def test_typed_events(spark):
    rows = [
        (1, " Auth　", "INFO", " hi ", "2024-01-15T12:34:56.789Z", None),
        (2, " ", "INFO", "m", "2024-01-15T12:34:56", None),
        (3, "a", "VERBOSE", "m", "2024-01-15 12:34:56+05:30", None),
        (4, "a", None, "\t\n", "nope", {"k": "v"}),
        (5, "s" * 65, "ERROR", "x" * 4097, None, None),
        (6, "s" * 64, "ERROR", "x" * 4096, "1718000000", None),
    ]
    df = spark.createDataFrame(
        rows, "id int, service_name string, level string, message string, timestamp string, metadata map<string,string>"
    )
    out = validate(df, now=F.lit("2024-02-02").cast("timestamp"))
    errors = {r["id"]: r["errors"] for r in out.collect()}
    assert errors == {
        1: [], 2: ["service_name"], 3: ["level"], 4: ["message", "timestamp"],
        5: ["service_name", "message"], 6: [],
    }
    good = {r["id"]: r for r in accepted(out).collect()}
    assert good[1]["service_name"] == "auth" and good[1]["message"] == "hi" and good[1]["metadata"] == {}
    assert good[1]["timestamp"] == dt.datetime(2024, 1, 15, 12, 34, 56, 789000)
    assert good[6]["timestamp"] == dt.datetime.fromtimestamp(1718000000, dt.UTC).replace(tzinfo=None)
    assert rejected(out).count() == 4


def test_json_events_check_value_types(spark):
    lines = [
        '{"service_name":"A","message":"m","metadata":{"a":"1"}}',
        '{"service_name":"a","message":"m","metadata":{"a":1}}',
        '{"service_name":"a","message":"m","metadata":null}',
        '{"service_name":"a","message":7}',
        '{"service_name":"a","message":"m","timestamp":1718000000}',
        '{"service_name":"a","message":"m","timestamp":null}',
        "[]",
        "{broken",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, value string")
    errors = {r["id"]: r["errors"] for r in validate_json(df).collect()}
    assert errors == {
        0: [], 1: ["metadata"], 2: ["metadata"], 3: ["message"], 4: [], 5: ["timestamp"],
        6: ["service_name", "message"], 7: ["json"],
    }


def test_lines(spark):
    lines = ['{"service":"x","message":"m","level":"ERROR"}', '{"level":"WARNING"} ', "5", " plain ", "", "  \t"]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, value string")
    got = {r["id"]: (r["service_name"], r["level"], r["message"]) for r in parse_lines(df).collect()}
    assert got == {
        0: ("x", "ERROR", "m"),
        1: ("target-app", "WARNING", '{"level":"WARNING"}'),
        2: ("target-app", "INFO", "5"),
        3: ("target-app", "INFO", "plain"),
    }


def test_session_zone_plays_no_part(spark):
    """Naive times are UTC and written times end in +00:00 under any session zone."""
    from logwarden.operators.entries import iso_text
    from logwarden.operators.validation import parse_timestamp

    texts = [
        "2024-01-15", "2024-01-15T00:00:00", "2024-01-15 00:00:00.123456", "2024-03-10T02:30:00", "2024-11-03T01:30:00Z",
        "2024-11-03T05:30:00+00:00", "2024-01-15T00:00:00+02:00", "2024-01-15T00:00:00 Europe/Berlin", "1705276800",
        "1705276800123", "nonsense", "2024-13-01", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    seen = {}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            seen[name] = [r[0] for r in df.select(iso_text(parse_timestamp(F.col("t")))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert seen["UTC"] == seen["America/New_York"] == seen["Asia/Kolkata"]
    assert seen["UTC"] == [
        "2024-01-15T00:00:00+00:00", "2024-01-15T00:00:00+00:00", "2024-01-15T00:00:00.123456+00:00",
        "2024-03-10T02:30:00+00:00", "2024-11-03T01:30:00+00:00", "2024-11-03T05:30:00+00:00", "2024-01-14T22:00:00+00:00",
        "2024-01-14T23:00:00+00:00", "2024-01-15T00:00:00+00:00", "2024-01-15T00:00:00.123000+00:00", None, None, None,
    ]
