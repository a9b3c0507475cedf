"""Lines of several formats."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logwarden.operators import validation
from logwarden.sources.formats import parse_formats

NOW = "2024-06-15 00:00:00"
AT = datetime(2024, 6, 15)
HOST = "docker-target-app"
CASES = {
    r'level=warn msg="he said \"hi\" \\ there\n" service=api dur=5ms dur=6ms': (
        "logfmt", "api", "WARNING", 'he said "hi" \\ there\n', AT, HOST, {"dur": "6ms"}),
    "ts=1700000000 app=x lvl=fatal empty= path=a.b/c-d": (
        "logfmt", "x", "CRITICAL", None, datetime(2023, 11, 14, 22, 13, 20), HOST, {"empty": "", "path": "a.b/c-d"}),
    "a=b and more": ("text", "target-app", "INFO", None, AT, HOST, {}),
    'msg="open': ("text", "target-app", "INFO", None, AT, HOST, {}),
    'a="x"y': ("text", "target-app", "INFO", None, AT, HOST, {}),
    "9a=b": ("text", "target-app", "INFO", None, AT, HOST, {}),
    '<34>1 2003-10-11T22:14:15.003Z box su 77 ID47 [ex@1 a="1" b="x\\]y"][q@2 z="\\"w\\\\"] ﻿root [x][y] "failed"\\': (
        "rfc5424", "su", "CRITICAL", 'root [x][y] "failed"\\', datetime(2003, 10, 11, 22, 14, 15, 3000), "box",
        {"ex@1.a": "1", "ex@1.b": "x]y", "q@2.z": '"w\\', "pid": "77"}),
    "<165>1 - - - - - -": ("rfc5424", "target-app", "INFO", "", AT, HOST, {}),
    "<191>1 - h app - - [only@1] done": ("rfc5424", "app", "DEBUG", "done", AT, "h", {}),
    "<192>1 - - - - - - x": ("text", "target-app", "INFO", None, AT, HOST, {}),
    "<9999999999999>1 - - - - - - x": ("text", "target-app", "INFO", None, AT, HOST, {}),
    "<34>1 - h a - - [bad x] m": ("text", "target-app", "INFO", None, AT, HOST, {}),
    "<13>Feb  5 17:32:18 10.0.0.99 myproc[8710]: hello world": (
        "rfc3164", "myproc", "INFO", "hello world", datetime(2024, 2, 5, 17, 32, 18), "10.0.0.99", {"pid": "8710"}),
    "Dec 31 23:00:00 h p: late: yes": ("rfc3164", "p", "INFO", "late: yes", datetime(2023, 12, 31, 23), "h", {}),
    "Feb 31 17:32:18 h p: x": ("text", "target-app", "INFO", None, AT, HOST, {}),
    "<250>Feb  5 17:32:18 h p: x": ("text", "target-app", "INFO", None, AT, HOST, {}),
    '{"service":"s","level":"err","msg":"m","x":1,"y":null}': ("json", "s", "ERROR", "m", AT, HOST, {"x": "1"}),
    '{"a":': ("text", "target-app", "INFO", None, AT, HOST, {}),
    "[1, 2]": ("text", "target-app", "INFO", None, AT, HOST, {}),
    "stand-in \u0001=x": ("text", "target-app", "INFO", None, AT, HOST, {}),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, f"  {line} ") for i, line in enumerate(CASES)] + [(98, "   "), (99, None)]
    df = spark.createDataFrame(rows, "i int, value string")
    return {r["i"]: r for r in parse_formats(df, now=F.lit(NOW).cast("timestamp")).collect()}


def test_every_format(parsed):
    names = ("format", "service_name", "level", "message", "timestamp", "host", "metadata")
    assert len(parsed) == len(CASES)
    for i, (line, want) in enumerate(CASES.items()):
        want = tuple(line if n == "message" and w is None else w for n, w in zip(names, want))
        assert tuple(parsed[i][n] for n in names) == want, line


def test_long_lines_and_validation(spark):
    long_pairs = 'msg="' + 'a\\"' * 100_000 + '" ' + "k=v " * 20_000
    elements = "<34>1 - h a - - " + '[e@1 a="1"]' * 20_000 + " m"
    df = spark.createDataFrame([(long_pairs,), (elements,), ("Jan 15 " * 50_000,), ("=" * 100_000,)], "value string")
    got = parse_formats(df, now=F.lit(NOW).cast("timestamp"))
    assert [r["format"] for r in got.collect()] == ["logfmt", "rfc5424", "text", "text"]
    some = spark.createDataFrame([("service=API level=info msg=ok",), ("level=loud msg=no",)], "value string")
    checked = validation.validate(parse_formats(some)).collect()
    assert [(r["service_name"], r["errors"]) for r in checked] == [("api", []), ("target-app", ["level"])]
