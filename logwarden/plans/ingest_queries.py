"""Queries over sources, validation, entries and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.functions.text import MASKS
from logwarden.operators import entries, templates, validation
from logwarden.plans import derived
from logwarden.plans.catalog import query
from logwarden.sources import formats, lines, tables

_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_SQL_TIME = "'%Y-%m-%dT%H:%M:%S.%f'"


def time_text(col):
    return F.date_format(col, _TIME)


def map_text(col, by=","):
    """A map as sorted ``key=value`` pairs joined by commas."""
    pairs = F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(F.array_sort(pairs), by)


def _raw_events(spark, sf_dir):
    raw = derived.table(spark, sf_dir, "logs_raw", spread=True)
    meta = F.create_map(F.lit("k"), F.col("k").cast("string"))
    return raw.select(
        "stream_id", "service_name", "level", "message", F.col("time_text").alias("timestamp"), meta.alias("metadata")
    )


_CHECKED = """
    checked AS (
      SELECT stream_id, lower(trim(service_name)) AS service_name, trim(message) AS message,
             coalesce(level, 'INFO') AS level, try_cast(time_text AS TIMESTAMP) AS t, k,
             concat_ws(',',
               CASE WHEN length(trim(service_name)) BETWEEN 1 AND 64 THEN NULL ELSE 'service_name' END,
               CASE WHEN length(trim(message)) BETWEEN 1 AND 4096 THEN NULL ELSE 'message' END,
               CASE WHEN coalesce(level, 'INFO') IN ('DEBUG','INFO','WARNING','ERROR','CRITICAL')
                    THEN NULL ELSE 'level' END,
               CASE WHEN try_cast(time_text AS TIMESTAMP) IS NULL THEN 'timestamp' END) AS errors
      FROM logs_raw)
"""


@query(
    "ingest_valid",
    ("logs_raw",),
    f""", {_CHECKED} SELECT stream_id, service_name, level, message, strftime(t, {_SQL_TIME}) AS time,
        concat('k=', CAST(k AS VARCHAR)) AS metadata FROM checked WHERE errors = ''""",
)
def ingest_valid(spark, sf_dir):
    good = validation.accepted(validation.validate(_raw_events(spark, sf_dir)))
    return good.select(
        "stream_id", "service_name", "level", "message", time_text("timestamp").alias("time"),
        map_text(F.col("metadata")).alias("metadata"),
    )


@query(
    "ingest_rejected",
    ("logs_raw",),
    f""", {_CHECKED} SELECT stream_id, errors FROM checked WHERE errors <> ''""",
)
def ingest_rejected(spark, sf_dir):
    bad = validation.rejected(validation.validate(_raw_events(spark, sf_dir)))
    return bad.select("stream_id", F.array_join("errors", ",").alias("errors"))


@query(
    "ingest_json",
    ("json_lines",),
    """, parsed AS (
      SELECT stream_id, stream_id % 40 AS m, line, json_valid(line) AS ok FROM json_lines)
    SELECT stream_id,
           CASE WHEN m = 7 THEN 'json' WHEN m = 8 THEN 'service_name,message' WHEN m = 9 THEN 'service_name'
                WHEN m = 10 THEN 'metadata' WHEN m = 11 THEN 'level' WHEN m = 12 THEN 'message' ELSE '' END AS errors,
           CASE WHEN m IN (7, 8, 9) THEN NULL
                ELSE lower(json_extract_string(CASE WHEN ok THEN line ELSE '{}' END, '$.service_name')) END AS service_name,
           CASE WHEN m IN (7, 8, 12) THEN NULL
                ELSE trim(json_extract_string(CASE WHEN ok THEN line ELSE '{}' END, '$.message')) END AS message,
           CASE WHEN m = 11 THEN NULL ELSE coalesce(
                json_extract_string(CASE WHEN ok THEN line ELSE '{}' END, '$.level'), 'INFO') END AS level
    FROM parsed""",
)
def ingest_json(spark, sf_dir):
    checked = validation.validate_json(derived.table(spark, sf_dir, "json_lines"), "line")
    return checked.select(
        "stream_id", F.array_join("errors", ",").alias("errors"), "service_name", "message", "level"
    )


@query(
    "shipper_parse",
    ("lines",),
    """, kept AS (SELECT stream_id, trim(line) AS line,
             CASE WHEN json_valid(line) THEN line ELSE '[]' END AS doc FROM lines WHERE trim(line) <> ''),
    shaped AS (SELECT stream_id, line, CASE WHEN json_type(doc) = 'OBJECT' THEN doc ELSE '{}' END AS doc FROM kept)
    SELECT stream_id, coalesce(json_extract_string(doc, '$.service'), 'target-app') AS service_name,
           coalesce(json_extract_string(doc, '$.level'), 'INFO') AS level,
           coalesce(json_extract_string(doc, '$.message'), line) AS message,
           'docker-target-app' AS host, 'production' AS environment
    FROM shaped""",
)
def shipper_parse(spark, sf_dir):
    parsed = lines.parse_lines(derived.table(spark, sf_dir, "lines"), "line")
    return parsed.drop("timestamp")


@query(
    "line_formats",
    ("format_lines",),
    r"""
    , given AS (SELECT stream_id, trim(line) AS line,
                  replace(replace(replace(trim(line), '\\', chr(1)), '\"', chr(2)), '\]', chr(3)) AS safe FROM format_lines WHERE trim(line) <> ''),
    parts AS (SELECT *, CASE WHEN json_valid(line) AND line LIKE '{%' THEN line END AS doc,
                CASE WHEN line NOT LIKE '<%' AND safe LIKE '%=%'
                      AND regexp_replace(safe, '[A-Za-z_][A-Za-z0-9_./-]*=("[^"]*"|[^\s"]*)(\s+|$)', '', 'g') = '' THEN 1 END AS pairs,
                regexp_extract(safe, '^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[[^\s="\]]+(?:\s+[^\s="\]]+="[^"]*")*\])+)(?: (.*))?$',
                               ['pri', 'tm', 'host', 'app', 'proc', 'id', 'sd', 'msg']) AS new,
                regexp_extract(line, '^(?:<(\d{1,3})>)?(Jan|Feb|Nov) +(\d{1,2}) (\d\d:\d\d:\d\d) (\S+) ([^\s\[\]:]+)(?:\[([^\]\s]*)\])?: ?(.*)$',
                               ['pri', 'mon', 'day', 'clock', 'host', 'app', 'pid', 'msg']) AS old FROM given),
    dated AS (SELECT *, try_strptime(concat('2024 ', old.mon, ' ', old.day, ' ', old.clock), '%Y %b %d %H:%M:%S') AS this FROM parts),
    known AS (SELECT *, CASE WHEN doc IS NOT NULL THEN 'json' WHEN pairs = 1 THEN 'logfmt'
                WHEN new.app <> '' AND TRY_CAST(new.pri AS INT) <= 191 THEN 'rfc5424'
                WHEN old.app <> '' AND this IS NOT NULL AND coalesce(TRY_CAST(old.pri AS INT), 0) <= 191 THEN 'rfc3164' ELSE 'text' END AS format,
                CASE WHEN this > TIMESTAMP '2024-06-16' THEN this - INTERVAL 1 YEAR ELSE this END AS old_time,
                list_extract(['CRITICAL', 'CRITICAL', 'CRITICAL', 'ERROR', 'WARNING', 'INFO', 'INFO', 'DEBUG'],
                             1 + coalesce(TRY_CAST(coalesce(nullif(new.pri, ''), nullif(old.pri, '')) AS INT), 6) % 8) AS severity FROM dated)
    SELECT stream_id, format,
           CASE format WHEN 'json' THEN json_extract_string(doc, '$.service') WHEN 'rfc5424' THEN coalesce(nullif(new.app, '-'), 'target-app')
                WHEN 'rfc3164' THEN old.app WHEN 'logfmt' THEN coalesce(nullif(regexp_extract(safe, 'service=(\S+)', 1), ''), 'target-app') ELSE 'target-app' END AS service_name,
           CASE format WHEN 'json' THEN 'ERROR' WHEN 'text' THEN 'INFO'
                WHEN 'logfmt' THEN CASE WHEN safe LIKE '%lvl=warn%' THEN 'WARNING' ELSE upper(regexp_extract(safe, 'level=(\S+)', 1)) END
                ELSE severity END AS level,
           CASE format WHEN 'json' THEN json_extract_string(doc, '$.msg') WHEN 'rfc3164' THEN old.msg
                WHEN 'rfc5424' THEN replace(replace(replace(new.msg, chr(3), '\]'), chr(2), '\"'), chr(1), '\\')
                WHEN 'logfmt' THEN replace(replace(regexp_extract(safe, 'msg="([^"]*)"', 1), chr(2), '"'), chr(1), '\') ELSE line END AS message,
           CASE WHEN format = 'rfc5424' THEN coalesce(nullif(new.host, '-'), 'docker-target-app') WHEN format = 'rfc3164' THEN old.host ELSE 'docker-target-app' END AS host,
           CASE WHEN format = 'rfc3164' THEN epoch_ms(old_time) WHEN format = 'rfc5424' AND new.tm <> '-' THEN epoch_ms(TRY_CAST(new.tm AS TIMESTAMPTZ))
                WHEN format = 'logfmt' AND safe LIKE 'ts=%' THEN epoch_ms(TRY_CAST(regexp_extract(safe, 'ts=(\S+)', 1) AS TIMESTAMPTZ))
                ELSE epoch_ms(TIMESTAMP '2024-06-15') END AS at_ms,
           CASE format WHEN 'json' THEN concat('took=', json_extract_string(doc, '$.took'))
                WHEN 'logfmt' THEN CASE WHEN safe LIKE 'ts=%' THEN 'empty=' ELSE concat('took=', list_last(regexp_extract_all(safe, 'took=(\S+)', 1))) END
                WHEN 'rfc5424' THEN CASE WHEN new.sd = '-' THEN CASE WHEN new.proc = '-' THEN '' ELSE concat('pid=', new.proc) END
                     ELSE concat('org@9.unit=', regexp_extract(new.sd, 'unit="([^"]*)"', 1), ';pid=', new.proc, ';req@9.id=', regexp_extract(new.sd, ' id="([^"]*)"', 1),
                                 ';req@9.path=', replace(regexp_extract(new.sd, 'path="([^"]*)"', 1), chr(3), ']')) END
                WHEN 'rfc3164' THEN CASE WHEN old.pid <> '' THEN concat('pid=', old.pid) ELSE '' END ELSE '' END AS metadata
    FROM known""",
)
def line_formats(spark, sf_dir):
    now = F.lit("2024-06-15 00:00:00+00:00").cast("timestamp")
    given = tables.materialised(derived.table(spark, sf_dir, "format_lines").select("stream_id", "line"), "lines")
    parsed = formats.parse_formats(given, "line", now)
    return parsed.select(
        "stream_id", "format", "service_name", "level", "message", "host",
        F.unix_millis("timestamp").alias("at_ms"), map_text(F.col("metadata"), ";").alias("metadata"),
    )


@query(
    "entry_serialize",
    ("logs",),
    """SELECT stream_id, service_name, level, message, concat('{"k":"', CAST(k AS VARCHAR), '"}') AS metadata,
       concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'),
              CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE concat('.', strftime(ts, '%f')) END,
              '+00:00') AS "timestamp"
       FROM logs""",
)
def entry_serialize(spark, sf_dir):
    f = F.col("fields")
    return entries.to_entry(derived.logs(spark, sf_dir)).select(
        "stream_id", *[f[n].alias(n) for n in ("service_name", "level", "message", "metadata", "timestamp")]
    )


@query(
    "entry_parse",
    ("log_entries",),
    """SELECT stream_id, trim(service_name) AS service_name, upper(coalesce(level, 'INFO')) AS level,
              trim(message) AS message,
              CASE WHEN json_valid(metadata) THEN concat('k=', json_extract_string(metadata, '$.k')) ELSE '' END AS metadata
       FROM log_entries WHERE trim(coalesce(service_name, '')) <> '' AND trim(coalesce(message, '')) <> ''""",
)
def entry_parse(spark, sf_dir):
    flat = derived.table(spark, sf_dir, "log_entries")
    packed = entries.fields_from_columns(flat, "stream_id", ["service_name", "message", "level", "metadata"])
    parsed = entries.parse_entries(packed).drop("timestamp")
    return parsed.withColumn("metadata", map_text(F.col("metadata")))


def incident_entries(spark, sf_dir):
    flat = derived.table(spark, sf_dir, "incident_entries")
    names = [c for c in flat.columns if c != "entry_id"]
    return entries.fields_from_columns(flat, "entry_id", names)


def rca_entries(spark, sf_dir):
    flat = derived.table(spark, sf_dir, "rca_entries")
    return entries.fields_from_columns(flat, "entry_id", [c for c in flat.columns if c != "entry_id"])


def history_entries(spark, sf_dir):
    flat = derived.table(spark, sf_dir, "history_entries")
    return entries.fields_from_columns(flat, "entry_id", [c for c in flat.columns if c != "entry_id"])


@query(
    "incident_decode",
    ("incident_entries",),
    """SELECT entry_id AS incident_id, stream_id AS source_stream_id, coalesce(service_name, 'unknown') AS service_name,
              coalesce(level, 'UNKNOWN') AS level, raw_message,
              round(coalesce(try_cast(anomaly_score AS DOUBLE), 0.0), 6) AS anomaly_score,
              coalesce(try_cast(anomaly_threshold AS DOUBLE), 0.55) AS anomaly_threshold,
              CASE WHEN context_window_size IS NULL THEN CAST(0 AS BIGINT)
                   ELSE coalesce(try_cast(context_window_size AS BIGINT),
                        CASE WHEN json_valid(context_window) THEN 1 ELSE 0 END) END AS context_window_size,
              CASE WHEN json_valid(context_window) THEN json_extract_string(context_window, '$[0].message') END AS first_message,
              CASE WHEN json_valid(metadata) THEN concat('k=', json_extract_string(metadata, '$.k')) ELSE '' END AS metadata,
              CAST(detected_at AS DOUBLE) AS detected_at
       FROM incident_entries""",
)
def incident_decode(spark, sf_dir):
    decoded = entries.decode_incidents(incident_entries(spark, sf_dir))
    return decoded.select(
        "incident_id", "source_stream_id", "service_name", "level", "raw_message", "anomaly_score",
        "anomaly_threshold", "context_window_size",
        F.get("context_window", F.lit(0))["message"].alias("first_message"),
        map_text(F.col("metadata")).alias("metadata"), "detected_at",
    )


@query(
    "rca_decode",
    ("rca_entries",),
    """SELECT entry_id AS rca_id, coalesce(incident_id, 'unknown') AS incident_id,
              coalesce(service_name, 'unknown') AS service_name, '' AS "timestamp", 'UNKNOWN' AS level, raw_message,
              '' AS normalized_message, round(CAST(anomaly_score AS DOUBLE), 6) AS anomaly_score, root_cause,
              suggested_fix, coalesce(risk_level, 'LOW') AS risk_level, '' AS impact_analysis,
              coalesce(CAST(generation_time_s AS DOUBLE), 0.0) AS generation_time_s,
              CAST(0.0 AS DOUBLE) AS analyzed_at
       FROM rca_entries""",
)
def rca_decode(spark, sf_dir):
    return entries.decode_rca(rca_entries(spark, sf_dir))


@query(
    "history_decode",
    ("history_entries",),
    """SELECT entry_id AS execution_id, coalesce(incident_id, 'unknown') AS incident_id, service_name,
              '' AS action_id, 'LOW' AS risk_level, '' AS target_command, execution_type,
              coalesce(status, 'UNKNOWN') AS status, '' AS stdout, '' AS stderr,
              coalesce(CAST(duration_s AS DOUBLE), 0.0) AS duration_s,
              coalesce(executed_by, 'System') AS executed_by, CAST(0.0 AS DOUBLE) AS "timestamp"
       FROM history_entries""",
)
def history_decode(spark, sf_dir):
    return entries.decode_history(history_entries(spark, sf_dir))


@query(
    "pending_decode",
    ("pending_hash",),
    """, ok AS (SELECT key, CASE WHEN json_valid(value) THEN value ELSE '[]' END AS value FROM pending_hash)
       SELECT coalesce(json_extract_string(value, '$.incident_id'), key) AS incident_id,
              json_extract_string(value, '$.service_name') AS service_name,
              json_extract_string(value, '$.risk_level') AS risk_level
       FROM ok WHERE json_type(value) = 'OBJECT'""",
)
def pending_decode(spark, sf_dir):
    decoded = entries.decode_pending(derived.table(spark, sf_dir, "pending_hash"))
    return decoded.select("incident_id", "service_name", "risk_level")


@query(
    "incident_encode",
    ("incidents",),
    """SELECT incident_id, printf('%.6f', score) AS anomaly_score, '0.5500' AS anomaly_threshold,
              '1' AS context_window_size,
              concat('[{"service_name":"', service_name, '","level":"', level, '"}]') AS context_window,
              concat('{"k":"', CAST(k AS VARCHAR), '"}') AS metadata
       FROM incidents""",
)
def incident_encode(spark, sf_dir):
    inc = derived.table(spark, sf_dir, "incidents")
    typed = inc.select(
        "incident_id", F.col("stream_id").alias("source_stream_id"), "service_name", F.col("ts").alias("timestamp"),
        "level", F.col("message").alias("raw_message"), F.lit("").alias("normalized_message"),
        F.col("score").alias("anomaly_score"), F.lit(0.55).alias("anomaly_threshold"),
        F.lit(1).alias("context_window_size"), F.array(F.struct("service_name", "level")).alias("context_window"),
        F.create_map(F.lit("k"), F.col("k").cast("string")).alias("metadata"), F.lit(0.0).alias("detected_at"),
    )
    f = F.col("fields")
    names = ("anomaly_score", "anomaly_threshold", "context_window_size", "context_window", "metadata")
    return entries.encode_incidents(typed).select(
        F.col("stream_id").alias("incident_id"), *[f[n].alias(n) for n in names]
    )


@query(
    "stream_retention",
    ("logs",),
    """SELECT stream_id, service_name FROM logs ORDER BY stream_id DESC LIMIT 5000""",
)
def stream_retention(spark, sf_dir):
    return tables.newest(derived.logs(spark, sf_dir), 5000).select("stream_id", "service_name")


@query(
    "tail_since",
    ("logs",),
    """, cur AS (SELECT max(stream_id) AS c FROM logs WHERE level = 'CRITICAL')
       SELECT stream_id, level FROM logs, cur WHERE stream_id > c""",
)
def tail_since(spark, sf_dir):
    logs = derived.logs(spark, sf_dir)
    cursor = tables.advance_cursor(logs.filter(F.col("level") == "CRITICAL")).first()["cursor"]
    return tables.after(logs, cursor).select("stream_id", "level")


@query(
    "keyed_upsert",
    ("logs",),
    """, r AS (SELECT user_id, stream_id, level, message,
                  row_number() OVER (PARTITION BY user_id ORDER BY stream_id DESC) AS n FROM logs)
       SELECT user_id, stream_id, level, message FROM r WHERE n = 1 AND level <> 'DEBUG'""",
)
def keyed_upsert(spark, sf_dir):
    writes = derived.logs(spark, sf_dir).select("user_id", "stream_id", "level", "message")
    old = writes.filter(F.col("level") == "INFO")
    new = writes.filter(F.col("level") != "INFO")
    return tables.upsert(old, new, "user_id", "stream_id", deleted=F.col("level") == "DEBUG")


@query(
    "keyed_lookup",
    ("pending_hash", "decisions"),
    """SELECT key, value FROM pending_hash WHERE key IN (SELECT incident_id FROM decisions)""",
)
def keyed_lookup(spark, sf_dir):
    keys = derived.table(spark, sf_dir, "decisions").select(F.col("incident_id").alias("key"))
    return tables.lookup(derived.table(spark, sf_dir, "pending_hash"), keys, "key")


# ---- templates ---------------------------------------------------------------


def _sql_pattern(mask) -> tuple[str, str]:
    """The masking step for an engine without lookbehind: pattern and replacement."""
    special = {
        "path": (r"(^|\W)(?:/[A-Za-z0-9_.\-]+)+(?:/[A-Za-z0-9_.\-]*)?", r"\1<PATH>"),
        "hex_id": (
            r"(?i)(^|[^_A-Za-z])0x[0-9a-f]{1,15}\b|\b[0-9a-f]{8,15}\b", r"\1<HEX_ID>",
        ),
        "epoch": (r"(^|\D)\d{10,13}(\D|$)", r"\1<TIMESTAMP>\2"),
    }
    if mask.name in special:
        return special[mask.name]
    return mask.pattern.replace("(?iU)", "(?i)").replace("(?U)", ""), mask.label


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_replace(source: str, mask) -> str:
    pattern, label = _sql_pattern(mask)
    return f"regexp_replace({source}, {_quote(pattern)}, {_quote(label)}, 'g')"


def _sql_count(source: str, mask) -> str:
    return f"CAST(len(regexp_extract_all({source}, {_quote(_sql_pattern(mask)[0])})) AS BIGINT)"


def _sql_chain() -> str:
    steps = ["t0 AS (SELECT stream_id, service_name, level, message AS raw, message AS m FROM logs)"]
    kept = ""
    for i, mask in enumerate(MASKS):
        steps.append(
            f"t{i + 1} AS (SELECT stream_id, service_name, level, raw{kept}, {_sql_count('m', mask)} AS n{i}, "
            f"{_sql_replace('m', mask)} AS m FROM t{i})"
        )
        kept += f", n{i}"
    steps.append(
        f"chain AS (SELECT stream_id, service_name, level, raw{kept}, "
        f"trim(regexp_replace(m, ' {{2,}}', ' ', 'g')) AS normalized_message FROM t{len(MASKS)})"
    )
    return ", " + ",\n".join(steps)


SQL_CHAIN = _sql_chain()
_LABELS = list(dict.fromkeys(m.label for m in MASKS))
_SUMS = {lab: " + ".join(f"n{i}" for i, m in enumerate(MASKS) if m.label == lab) for lab in _LABELS}


def _register_masks() -> None:
    for mask in MASKS:

        @query(
            f"mask_{mask.name}",
            ("logs",),
            f"SELECT stream_id, {_sql_replace('message', mask)} AS masked, {_sql_count('message', mask)} AS hits FROM logs",
        )
        def build(spark, sf_dir, mask=mask):
            text = F.col("message")
            return derived.logs(spark, sf_dir).select(
                "stream_id",
                templates.mask_once(text, mask.name).alias("masked"),
                F.regexp_count(text, F.lit(mask.pattern)).alias("hits"),
            )


_register_masks()


@query(
    "collapse_whitespace",
    ("logs_raw",),
    """SELECT stream_id, trim(regexp_replace(message, ' {2,}', ' ', 'g')) AS collapsed FROM logs_raw""",
)
def collapse_whitespace(spark, sf_dir):
    raw = derived.table(spark, sf_dir, "logs_raw", spread=True)
    return raw.select("stream_id", templates.collapse_spaces(F.col("message")).alias("collapsed"))


@query(
    "normalize_full",
    ("logs",),
    SQL_CHAIN
    + f" SELECT stream_id, normalized_message, {' + '.join(f'n{i}' for i in range(len(MASKS)))} AS total_replacements, "
    "normalized_message <> raw AS changed FROM chain",
)
def normalize_full(spark, sf_dir):
    out = templates.normalize(derived.logs(spark, sf_dir, spread=True))
    return out.select("stream_id", "normalized_message", "total_replacements", "changed")


@query(
    "token_counts",
    ("logs",),
    SQL_CHAIN
    + ", cells AS ("
    + " UNION ALL ".join(
        f"SELECT stream_id, {_quote(lab)} AS placeholder, {total} AS n FROM chain" for lab, total in _SUMS.items()
    )
    + ") SELECT stream_id, placeholder, n FROM cells WHERE n > 0",
)
def token_counts(spark, sf_dir):
    out = templates.normalize(derived.logs(spark, sf_dir, spread=True))
    # The outer form adds no filter on the map, which would run the chain twice.
    cells = out.select("stream_id", F.explode_outer("token_counts").alias("placeholder", "n"))
    return cells.filter(F.col("n") > 0)


@query(
    "template_counts",
    ("logs",),
    SQL_CHAIN
    + " SELECT service_name, level, normalized_message, count(*) AS n FROM chain GROUP BY ALL",
)
def template_counts(spark, sf_dir):
    out = templates.add_template(derived.logs(spark, sf_dir).select("service_name", "level", "message"))
    return out.groupBy("service_name", "level", "normalized_message").agg(F.count(F.lit(1)).alias("n"))


@query("document_templates")
def document_templates(spark, sf_dir):
    """Masked whole documents: longer and multilingual text through the same chain."""
    out = templates.normalize(derived.read(spark, sf_dir, "documents"), "text")
    return out.select("doc_id", F.md5("normalized_message").alias("template_md5"), "total_replacements", "changed")
