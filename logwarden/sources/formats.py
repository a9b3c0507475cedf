"""Lines in several formats: JSON objects, logfmt pairs, syslog of both RFCs, plain text.

All of it is column expressions. Patterns have no repeated groups, so a line of any length
takes no deep recursion: escaped characters are set aside before a quoted value is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import strip
from logwarden.operators.validation import parse_timestamp
from logwarden.sources.lines import DEFAULT_SERVICE, ENVIRONMENT, HOST

#: Characters that stand for an escaped backslash, quote, bracket, for two adjacent brackets and between groups.
BACKSLASH, QUOTE, BRACKET, ADJACENT, SPLIT = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
KEY = r"[A-Za-z_][A-Za-z0-9_./-]*"
PAIR = rf'({KEY})=("[^"]*"|[^\s"]*)(?:\s+|$)'
PARAM = r'\s+([^\s="\]]+)="([^"]*)"'
RFC5424 = r"(?s)^<([0-9]{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|\[[^\]]*\])(?: (.*))?$"
RFC3164 = (
    r"(?s)^(?:<([0-9]{1,3})>)?(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +([0-9]{1,2}) "
    r"([0-9]{2}:[0-9]{2}:[0-9]{2}) (\S+) ([^\s\[\]:]+)(?:\[([^\]\s]*)\])?: ?(.*)$"
)
# Keys that hold the parts of an event, the first given one counts.
SERVICE_KEYS = ("service", "service_name", "app", "logger")
LEVEL_KEYS = ("level", "lvl", "severity")
MESSAGE_KEYS = ("msg", "message")
TIME_KEYS = ("time", "ts", "timestamp")
# Other names of levels, and the level of each syslog severity.
LEVEL_NAMES = {
    "WARN": "WARNING", "ERR": "ERROR", "FATAL": "CRITICAL", "PANIC": "CRITICAL", "EMERG": "CRITICAL",
    "ALERT": "CRITICAL", "CRIT": "CRITICAL", "NOTICE": "INFO", "TRACE": "DEBUG",
}
SEVERITIES = ("CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARNING", "INFO", "INFO", "DEBUG")
HIGHEST_PRIORITY = 191


def _protected(line: Column) -> Column:
    """Escapes set aside, so that a quote ends a value and a bracket an element."""
    out = F.replace(line, F.lit("\\\\"), F.lit(BACKSLASH))
    return F.replace(F.replace(out, F.lit('\\"'), F.lit(QUOTE)), F.lit("\\]"), F.lit(BRACKET))


def _original(text: Column) -> Column:
    """What was set aside, as it stood in the line."""
    out = F.replace(F.replace(text, F.lit(BRACKET), F.lit("\\]")), F.lit(ADJACENT), F.lit("]["))
    return F.replace(F.replace(out, F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\"))


def _value(text: Column) -> Column:
    """What an escaped value means."""
    out = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    out = F.replace(F.replace(out, F.lit(BRACKET), F.lit("]")), F.lit(ADJACENT), F.lit("]["))
    return F.replace(F.replace(out, F.lit(QUOTE), F.lit('"')), F.lit(BACKSLASH), F.lit("\\"))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _groups(text: Column, pattern: str, many: int) -> Column:
    """The groups of a pattern that matches the whole text, from one match; null where it doesn't."""
    split = F.split(F.regexp_replace(text, pattern, SPLIT.join(f"${k}" for k in range(1, many + 1))), SPLIT)
    return _bound(split, lambda g: F.when(F.size(g) == many, g))


def _last_wins(pairs: Column) -> Column:
    """A map of (key, value) pairs; the last value of a repeated key counts."""
    def build(p: Column) -> Column:
        last = lambda k: F.element_at(F.filter(p, lambda x: x["key"] == k), -1)["value"]
        distinct = F.array_distinct(F.transform(p, lambda x: x["key"]))
        return F.map_from_arrays(distinct, F.transform(distinct, last))

    return _bound(pairs, build)


def _pairs(text: Column, pattern: str, key, value) -> Column:
    """Keys and values of all matches of a pattern, through the given functions."""
    keys, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(keys, values, lambda k, v: F.struct(key(k).alias("key"), value(v).alias("value")))


def _event(form: str, service: Column, level: Column, message: Column, when: Column, host: Column, metadata: Column) -> Column:
    return F.struct(
        F.lit(form).alias("format"), service.alias("service_name"), level.alias("level"), message.alias("message"),
        when.alias("timestamp"), host.alias("host"), metadata.alias("metadata"),
    )


def _named(form: str, fields: Column) -> Column:
    """An event whose parts are named by keys."""
    taken = F.array(*[F.lit(k) for k in SERVICE_KEYS + LEVEL_KEYS + MESSAGE_KEYS + TIME_KEYS])

    def build(m: Column) -> Column:
        first = lambda keys: F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys])
        rest = F.map_filter(m, lambda k, v: ~F.array_contains(taken, k))
        time = parse_timestamp(first(TIME_KEYS))
        return _event(form, first(SERVICE_KEYS), _level(first(LEVEL_KEYS)), first(MESSAGE_KEYS), time, F.lit(None).cast("string"), rest)

    return _bound(fields, lambda m: F.when(m.isNotNull(), build(m)))


def _json(line: Column) -> Column:
    fields = F.transform_values(F.expr("try_cast(_doc AS map<string,variant>)"), lambda k, v: v.cast("string"))
    is_object = F.schema_of_variant("_doc").startswith("OBJECT")
    return F.when(is_object, _named("json", F.map_filter(fields, lambda k, v: v.isNotNull())))


def _logfmt(line: Column, safe: Column) -> Column:
    bare = lambda v: F.when(v.startswith('"'), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    whole = (safe != "") & line.contains("=") & (F.regexp_replace(safe, PAIR, "") == "")
    pairs = _pairs(safe, PAIR, lambda k: k, lambda v: _value(bare(v)))
    return F.when(whole, _named("logfmt", _last_wins(pairs)))


def _with_pid(fields: Column, pid: Column) -> Column:
    return F.when(pid.isNull(), fields).otherwise(F.map_concat(F.map_filter(fields, lambda k, v: k != "pid"), F.create_map(F.lit("pid"), pid)))


def _rfc5424(safe: Column) -> Column:
    none = F.create_map().cast("map<string,string>")

    def params(element: Column) -> Column:
        name = F.regexp_extract(element, r"^\S+", 0)
        return _pairs(element, PARAM, lambda k: F.concat(name, F.lit("."), k), _value)

    def build(g: Column) -> Column:
        data = F.get(g, 6)
        elements = F.split(F.regexp_replace(data, r"^\[|\]$", ""), ADJACENT)
        whole = (data == "-") | F.forall(elements, lambda e: F.regexp_replace(e, PARAM, "").rlike(r'^[^\s="\]]+\s*$'))
        fields = F.when(data == "-", none).otherwise(_last_wins(F.flatten(F.transform(elements, params))))
        body = F.regexp_replace(_original(F.get(g, 7)), r"^\x{FEFF}", "")
        event = _event(
            "rfc5424", _given(F.get(g, 3)), _severity(F.get(g, 0)), body, parse_timestamp(_given(F.get(g, 1))),
            _given(F.get(g, 2)), _with_pid(fields, _given(F.get(g, 4))),
        )
        return F.when((F.get(g, 0).cast("int") <= HIGHEST_PRIORITY) & whole, event)

    tail = F.replace(safe, F.lit("]["), F.lit(ADJACENT))
    return F.when(safe.startswith("<"), _bound(_groups(tail, RFC5424, 8), build))


def _rfc3164(line: Column, now: Column) -> Column:
    none = F.create_map().cast("map<string,string>")

    def build(g: Column) -> Column:
        ok = F.coalesce(F.get(g, 0).try_cast("int") <= HIGHEST_PRIORITY, F.lit(True))

        def event(when: Column) -> Column:
            made = _event("rfc3164", F.get(g, 5), _severity(F.get(g, 0)), F.get(g, 7), when, F.get(g, 4), _with_pid(none, _given(F.get(g, 6))))
            return F.when(ok & when.isNotNull(), made)

        return _bound(_recent(F.get(g, 1), F.get(g, 2), F.get(g, 3), now), event)

    return _bound(_groups(line, RFC3164, 8), lambda g: F.when(g.isNotNull(), build(g)))


def _level(text: Column) -> Column:
    name = F.upper(text)
    known = F.create_map(*[F.lit(x) for pair in LEVEL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def _severity(priority: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), priority.try_cast("int") % 8)


def _given(text: Column) -> Column:
    return F.nullif(F.nullif(text, F.lit("-")), F.lit(""))


def _recent(month: Column, day: Column, clock: Column, now: Column) -> Column:
    """The time of a date without a year: in the year of ``now``, or before if that is over a day ahead."""
    def of(year: Column) -> Column:
        text = F.concat_ws(" ", year.cast("string"), month, day.cast("int").cast("string"), clock)
        return F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss"))

    year = F.year(now)
    this = of(year)
    return F.when(this.isNull() | (this > now + F.expr("INTERVAL 1 DAY")), F.coalesce(of(year - 1), this)).otherwise(this)


def parse_formats(lines: DataFrame, column: str = "value", now: Column | None = None) -> DataFrame:
    """Add format, service_name, level, message, timestamp, host, environment and metadata to each line.

    ``format`` is ``json``, ``logfmt``, ``rfc5424``, ``rfc3164`` or ``text``. A line is of a format
    only if all of it is: pairs with anything between them, an unclosed quote, a broken
    element, a priority above 191 or an impossible date leave it raw text, with the line as
    message and defaults elsewhere. Times that are not given, or can't be read, are ``now``.
    Keys that name no part of an event go to ``metadata``; of a repeated key the last counts.
    Blank and null lines go. Other columns are kept.
    """
    instant = F.current_timestamp() if now is None else now
    line, safe = F.col("_line"), F.col("_safe")
    df = lines.withColumn("_line", strip(F.col(column))).filter(F.col("_line") != "")
    # A line that holds a stand-in itself is never read as pairs or elements.
    clean = ~line.rlike(f"[{BACKSLASH}-{SPLIT}]")
    df = df.withColumns({
        "_safe": F.when(clean, _protected(line)).otherwise(F.lit("")),
        "_doc": F.when(line.startswith("{"), F.try_parse_json(line)),
    })
    syslog = F.when(clean, F.coalesce(_rfc5424(safe), _rfc3164(line, instant)))
    df = df.withColumn("_event", F.coalesce(_json(line), _logfmt(line, safe), syslog))
    event = F.col("_event")
    kept = [c for c in lines.columns if c != column]
    return df.select(
        *kept,
        F.coalesce(event["format"], F.lit("text")).alias("format"),
        F.coalesce(event["service_name"], F.lit(DEFAULT_SERVICE)).alias("service_name"),
        F.coalesce(event["level"], F.lit("INFO")).alias("level"),
        F.coalesce(event["message"], line).alias("message"),
        F.coalesce(event["timestamp"], instant).alias("timestamp"),
        F.coalesce(event["host"], F.lit(HOST)).alias("host"),
        F.lit(ENVIRONMENT).alias("environment"),
        F.coalesce(event["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"),
    )
