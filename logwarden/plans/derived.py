"""Log-shaped tables derived from the events table.

Each table is one SELECT that Spark and any ANSI engine evaluate alike, built
from integers and strings only. Faulty rows are planted by CASE so that every
branch of the decoders is exercised; no row is left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ID10 = "lpad(CAST(stream_id AS STRING), 10, '0')"


def _word(words: str, step: int) -> str:
    """SQL for one of the words, picked by the event's number."""
    n = len(words.split())
    return f"split_part('{words}', ' ', CAST(((stream_id - stream_id % {step}) / {step}) % {n} + 1 AS INT))"


# Sentences are put together from these, which gives thousands of templates: one holds a
# third of the rows, most others a few.
_PARTS = {
    "@first": _word("quiet amber brisk coral dusty early faint green heavy ivory jolly keen lunar mossy noble ochre", 8),
    "@second": _word("harbor lantern meadow orchard pebble quarry ribbon saddle tunnel valley willow zephyr anchor", 128),
    "@third": _word("stalled resumed drained rotated trimmed flushed paused merged split queued parked", 1664),
}

TABLES = {
    "base": """
        SELECT event_id AS stream_id, concat('svc-', CAST(user_id % 8 AS STRING)) AS service_name,
               ts, user_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
               CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'CRITICAL'
                    WHEN event_type = 'error' THEN 'ERROR'
                    WHEN event_type = 'purchase' THEN 'WARNING'
                    WHEN event_type = 'signup' THEN 'DEBUG' ELSE 'INFO' END AS level,
               CAST(user_id % 61 - 30 AS DOUBLE) / 100 AS raw
        FROM events""",
    "logs": """
        SELECT stream_id, service_name, ts, user_id, value, k, level, raw,
               1.0e0 / (1.0e0 + exp(raw * 6)) AS score,
               CASE WHEN stream_id % 3 = 0 THEN 'Heartbeat of the scheduler arrived' ELSE CASE stream_id % 8
               WHEN 0 THEN concat(@first, ' ', @second, ' denied entry to account 7d444840-9dc0-11d1-b245-',
                    lpad(CAST(stream_id AS STRING), 12, '0'), ' from 172.16.', CAST(k % 250 AS STRING), '.',
                    CAST(stream_id % 250 AS STRING))
               WHEN 1 THEN concat('The ', @second, ' report took ', CAST(k AS STRING), 'ms and held ',
                    CAST(k % 16 + 1 AS STRING), '.25GB while it ', @third)
               WHEN 2 THEN concat('Store /srv/shelf', CAST(user_id % 5 AS STRING), '/', @first, '.idx is at ',
                    CAST(k AS STRING), '% and ', @third)
               WHEN 3 THEN concat(@first, ' gate bound to port=', CAST(9000 + k AS STRING), ' and ', @third,
                    ' in round ', CAST(k % 5 AS STRING))
               WHEN 4 THEN concat('Prüfung ', @second, ' ', @third, ' – délai dépassé für ', @first)
               WHEN 5 THEN concat('Sent ', @second, ' to https://hooks.example.net/in/', CAST(stream_id AS STRING),
                    '?key=zz and told ops', CAST(user_id AS STRING), '@example.org that it ', @third)
               WHEN 6 THEN concat('Since 2023-11-05T06:07:', lpad(CAST(k % 60 AS STRING), 2, '0'),
                    'Z peer 2001:0db8:1c2d:0000:0000:9f3e:0417:', lpad(CAST(k AS STRING), 4, '0'), ' ', @second, ' ',
                    @third, ' build 5ca1ab1e0ddba1', lpad(CAST(stream_id AS STRING), 10, '0'))
               ELSE concat('Nov 05 06:07:', lpad(CAST(k % 60 AS STRING), 2, '0'), ' runner  trace 0x',
                    lpad(CAST(k AS STRING), 4, '0'), ' tag 9b1d', lpad(CAST(k AS STRING), 6, '0'), ' mark_',
                    CAST(1700000000 + stream_id AS STRING), '  unit_id=', CAST(stream_id AS STRING), ' batch 2',
                    lpad(CAST(stream_id AS STRING), 7, '0'), ' link c:d ', @third)
               END
               END AS message
        FROM base""",
    # Four in fifty rows are rejected, others need trimming or defaults.
    "logs_raw": """
        SELECT stream_id,
               CASE stream_id % 50 WHEN 0 THEN '   ' WHEN 25 THEN concat('  ', upper(service_name), ' ')
                    ELSE service_name END AS service_name,
               CASE stream_id % 50 WHEN 20 THEN 'VERBOSE' WHEN 21 THEN NULL WHEN 22 THEN 'info' ELSE level END AS level,
               CASE stream_id % 50 WHEN 10 THEN '  ' WHEN 40 THEN repeat('x', 5000) WHEN 41 THEN NULL
                    ELSE concat(' ', message, '  ') END AS message,
               CASE stream_id % 50 WHEN 30 THEN 'not-a-time' ELSE CAST(ts AS STRING) END AS time_text, k
        FROM logs""",
    "json_lines": """
        SELECT stream_id,
               CASE stream_id % 40
               WHEN 7 THEN 'not json'
               WHEN 8 THEN '[1, 2]'
               WHEN 9 THEN concat('{"service_name": 5, "message": "m', CAST(k AS STRING), '"}')
               WHEN 10 THEN concat('{"service_name": "', service_name, '", "message": "m", "metadata": {"k": ',
                    CAST(k AS STRING), '}}')
               WHEN 11 THEN concat('{"service_name": "', service_name, '", "message": "m", "level": null}')
               WHEN 12 THEN concat('{"service_name": "', service_name, '"}')
               WHEN 13 THEN concat('{"service_name": "', upper(service_name), '", "message": " m', CAST(k AS STRING), ' "}')
               ELSE concat('{"service_name": "', service_name, '", "level": "', level, '", "message": "', message,
                    '", "metadata": {"k": "', CAST(k AS STRING), '"}}') END AS line
        FROM logs""",
    "lines": """
        SELECT stream_id,
               CASE stream_id % 6
               WHEN 0 THEN concat('  ', message, ' ')
               WHEN 1 THEN concat('{"service": "', service_name, '", "level": "', level, '", "message": "', message, '"}')
               WHEN 2 THEN concat('{"level": "', level, '", "request_id": "', CAST(k AS STRING), '"} ')
               WHEN 3 THEN concat('{"service": "', service_name, '", ')
               WHEN 4 THEN '   '
               ELSE concat('[', CAST(k AS STRING), ', 2]') END AS line
        FROM logs""",
    # Whole and broken lines of each format; a third is plain text.
    "format_lines": """
        SELECT stream_id, service_name, level, k, CASE stream_id % 18
               WHEN 0 THEN concat('level=', lower(level), ' service=', service_name, ' msg="', message, '" took=', CAST(k AS STRING), 'ms took=', CAST(k + 1 AS STRING), 'ms')
               WHEN 1 THEN concat('ts=2024-05-01T10:00:', lpad(CAST(k % 60 AS STRING), 2, '0'), 'Z lvl=warn msg="said ', chr(92), '"', service_name, chr(92), '" to c:', chr(92), chr(92), 'temp" empty= ')
               WHEN 2 THEN concat('level=info msg="never closed ', CAST(k AS STRING))
               WHEN 3 THEN concat('code=', CAST(k AS STRING), ' and words between=', service_name)
               WHEN 4 THEN concat('<', CAST(k % 192 AS STRING), '>1 2024-05-01T10:00:', lpad(CAST(k % 60 AS STRING), 2, '0'), '.250+02:00 host', CAST(k AS STRING), ' ', service_name, ' ',
                    CAST(stream_id AS STRING), ' ID7 [req@9 id="', CAST(k AS STRING), '" path="a', chr(92), ']b"][org@9 unit="x y"] ', message)
               WHEN 5 THEN concat('<', CAST(k % 192 AS STRING), '>1 - - - - - -')
               WHEN 6 THEN concat('<', CAST(192 + k % 99 AS STRING), '>1 - - ', service_name, ' - - - ', message)
               WHEN 7 THEN concat('<13>1 - - ', service_name, ' - - [broken id=', CAST(k AS STRING), '] ', message)
               WHEN 8 THEN concat('<', CAST(k % 192 AS STRING), '>Nov  5 06:07:', lpad(CAST(k % 60 AS STRING), 2, '0'), ' host', CAST(k AS STRING), ' ', service_name, '[', CAST(stream_id AS STRING), ']: ', message)
               WHEN 9 THEN concat('Jan 15 06:07:08 host ', service_name, ': [x] ', message)
               WHEN 10 THEN concat('Feb 30 06:07:08 host ', service_name, ': ', message)
               WHEN 11 THEN concat('{"service": "', service_name, '", "severity": "err", "msg": "', message, '", "took": ', CAST(k AS STRING), '}')
               WHEN 12 THEN concat('{"service": "', service_name, '", ')
               WHEN 13 THEN '   '
               ELSE message END AS line
        FROM logs""",
    # Four features of each event; one in a hundred rows of a service lies far from the others. One
    # service holds a third of the rows, many have a few.
    "profiles": """
        SELECT stream_id, planted,
               CASE WHEN stream_id % 200 IN (7, 8, 9, 10, 41) THEN concat('rare-', CAST(CAST((stream_id - stream_id % 200) / 200 AS BIGINT) AS STRING))
                    WHEN stream_id % 3 = 0 THEN 'hot'
                    ELSE service_name END AS service_name,
               CAST(stream_id * 7919 % 1009 AS DOUBLE) / 1009 + planted * (4 + stream_id % 7) AS f1,
               CAST(stream_id * 104729 % 2003 AS DOUBLE) / 2003 + planted * (4 + stream_id % 5) AS f2,
               CAST(user_id * 31 % 97 AS DOUBLE) / 97 + planted * 6 AS f3,
               CAST(k AS DOUBLE) / 100 - planted * (5 + stream_id % 3) AS f4
        FROM (SELECT *, CASE WHEN stream_id % 100 = 41 THEN 1 ELSE 0 END AS planted FROM logs) AS l""",
    "log_entries": """
        SELECT stream_id,
               CASE stream_id % 20 WHEN 3 THEN NULL WHEN 4 THEN ' ' ELSE concat(' ', service_name) END AS service_name,
               CASE stream_id % 20 WHEN 5 THEN '' ELSE concat(message, ' ') END AS message,
               CASE stream_id % 20 WHEN 6 THEN NULL ELSE lower(level) END AS level,
               CASE stream_id % 20 WHEN 7 THEN '{bad' WHEN 8 THEN NULL
                    ELSE concat('{"k":"', CAST(k AS STRING), '"}') END AS metadata
        FROM logs""",
    "incidents": f"""
        SELECT concat('inc-', {_ID10}) AS incident_id, stream_id, service_name, ts, level, message,
               score, k, value
        FROM logs WHERE score > 0.55""",
    "incident_entries": """
        SELECT incident_id AS entry_id, CAST(stream_id AS STRING) AS stream_id,
               CASE WHEN stream_id % 11 = 0 THEN NULL ELSE service_name END AS service_name,
               CASE WHEN stream_id % 19 = 0 THEN NULL ELSE level END AS level,
               message AS raw_message,
               CASE WHEN stream_id % 13 = 0 THEN 'n/a' WHEN stream_id % 17 = 0 THEN NULL
                    ELSE printf('%.6f', score) END AS anomaly_score,
               CASE WHEN stream_id % 7 = 0 THEN '?' WHEN stream_id % 3 = 0 THEN NULL ELSE '0.5500' END AS anomaly_threshold,
               CASE WHEN stream_id % 4 = 0 THEN 'x' WHEN stream_id % 5 = 0 THEN NULL ELSE '1' END AS context_window_size,
               CASE WHEN stream_id % 9 = 0 THEN '[{bad'
                    ELSE concat('[{"service_name":"', service_name, '","message":"m', CAST(k AS STRING), '"}]')
                    END AS context_window,
               CASE WHEN stream_id % 6 = 0 THEN 'oops' ELSE concat('{"k":"', CAST(k AS STRING), '"}') END AS metadata,
               CAST(1700000000 + stream_id AS STRING) AS detected_at
        FROM incidents""",
    "rca": f"""
        SELECT concat('rca-', {_ID10}) AS rca_id, incident_id, stream_id, service_name, ts, level,
               message AS raw_message, score AS anomaly_score, value, k,
               concat('cause ', CAST(k AS STRING)) AS root_cause,
               CASE stream_id % 9 WHEN 0 THEN 'Clear transient cache entries' WHEN 1 THEN 'Flush REDIS keys'
                    WHEN 2 THEN 'Restart the pod' WHEN 3 THEN 'Scale out replicas'
                    WHEN 4 THEN 'Resize DB connections' WHEN 5 THEN 'Rebuild Infrastructure'
                    WHEN 6 THEN 'Enlarge the pool' WHEN 7 THEN 'Restart and clear cache'
                    ELSE 'Call an engineer' END AS suggested_fix,
               CASE stream_id % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH'
                    WHEN 3 THEN 'CRITICAL' ELSE 'BOGUS' END AS risk_level,
               concat('impact on ', service_name) AS impact_analysis,
               CASE WHEN stream_id % 12 = 0 THEN 'error' ELSE 'success' END AS status
        FROM incidents""",
    "rca_entries": """
        SELECT rca_id AS entry_id,
               CASE WHEN stream_id % 8 = 0 THEN NULL ELSE incident_id END AS incident_id,
               CASE WHEN stream_id % 11 = 0 THEN NULL ELSE service_name END AS service_name,
               raw_message, printf('%.6f', anomaly_score) AS anomaly_score, root_cause, suggested_fix,
               CASE WHEN stream_id % 10 = 0 THEN NULL ELSE risk_level END AS risk_level,
               CASE WHEN stream_id % 6 = 0 THEN NULL ELSE CAST(k AS STRING) END AS generation_time_s
        FROM rca""",
    "history_entries": f"""
        SELECT concat('run-', {_ID10}) AS entry_id,
               CASE WHEN stream_id % 8 = 0 THEN NULL ELSE incident_id END AS incident_id,
               service_name,
               CASE WHEN stream_id % 3 = 0 THEN 'AUTO_EXECUTE' ELSE 'WEBHOOK_GATE' END AS execution_type,
               CASE WHEN stream_id % 10 = 0 THEN NULL WHEN stream_id % 4 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
               CASE WHEN stream_id % 6 = 0 THEN NULL ELSE 'System (Auto)' END AS executed_by,
               CASE WHEN stream_id % 14 = 0 THEN NULL ELSE CAST(k AS STRING) END AS duration_s
        FROM rca""",
    "pending_hash": """
        SELECT incident_id AS key,
               CASE stream_id % 7 WHEN 0 THEN '{broken' WHEN 1 THEN '[1]'
                    WHEN 2 THEN concat('{"service_name":"', service_name, '","risk_level":"', risk_level, '"}')
                    ELSE concat('{"incident_id":"', incident_id, '-own","service_name":"', service_name,
                         '","risk_level":"', risk_level, '"}') END AS value
        FROM rca""",
    "decisions": f"""
        SELECT stream_id AS decision_id, concat('inc-', {_ID10}) AS incident_id,
               CASE stream_id % 3 WHEN 0 THEN 'approve' ELSE 'deny' END AS decision, CAST(k AS DOUBLE) AS decided_at
        FROM logs WHERE stream_id % 3 <> 2
        UNION ALL
        SELECT 1000000000000 + stream_id AS decision_id, concat('inc-', {_ID10}) AS incident_id,
               CASE stream_id % 3 WHEN 0 THEN 'deny' ELSE 'approve' END AS decision, CAST(k + 1 AS DOUBLE) AS decided_at
        FROM logs WHERE stream_id % 10 = 0""",
    "frames": """
        SELECT conv_id, turn, role, text FROM conversations""",
}

for _part, _sql in _PARTS.items():
    TABLES["logs"] = TABLES["logs"].replace(_part, _sql)

_NEEDS = {
    "base": [], "logs": ["base"], "logs_raw": ["logs"], "json_lines": ["logs"], "lines": ["logs"],
    "format_lines": ["logs"], "profiles": ["logs"], "log_entries": ["logs"], "incidents": ["logs"], "incident_entries": ["incidents"], "rca": ["incidents"],
    "rca_entries": ["rca"], "history_entries": ["rca"], "pending_hash": ["rca"], "decisions": ["logs"], "frames": [],
}


def _closure(names) -> list[str]:
    wanted: set[str] = set()

    def visit(name: str) -> None:
        for need in _NEEDS[name]:
            visit(need)
        wanted.add(name)

    for name in names:
        visit(name)
    return [n for n in TABLES if n in wanted]


def ctes(*names: str) -> str:
    """The named tables and what they are built from, as WITH entries."""
    return ",\n".join(f"{n} AS ({TABLES[n]})" for n in _closure(names))


def _from_view(spark: SparkSession, rows: DataFrame, source: str, name: str) -> DataFrame:
    view = f"{source}_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    df = spark.sql(f"WITH {source} AS (SELECT * FROM {view}),\n{ctes(name)}\nSELECT * FROM {name}")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def _spread(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt to all cores, ahead of costly work on them: a file has as many tasks as row groups, often few."""
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, F.xxhash64(*[f"`{c}`" for c in rows.columns]))


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One derived table as a DataFrame; event time becomes ``timestamp``. ``spread`` deals its rows to all cores."""
    source = "conversations" if name == "frames" else "events"
    rows = read(spark, sf_dir, source)
    return _from_view(spark, _spread(rows) if spread else rows, source, name)


def stream(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One derived table as a stream over the events files; see :func:`table`."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A glob reaches the table whether it is one file or a folder of files.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return _from_view(spark, _spread(events) if spread else events, "events", name)


def logs(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Log rows with timestamp and metadata, plus user_id, value, k, raw and score; see :func:`table`."""
    df = table(spark, sf_dir, "logs", spread)
    return df.withColumn("metadata", F.create_map(F.lit("k"), F.col("k").cast("string"))).withColumnRenamed(
        "ts", "timestamp"
    )


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
