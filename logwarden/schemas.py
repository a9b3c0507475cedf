"""Row layouts and fixed values shared by all operators."""

# Severity and risk vocabularies.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
HIGH_SEVERITY = ("ERROR", "CRITICAL")
RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
AUTO_RISKS = ("LOW", "MEDIUM")

# Limits and thresholds.
SERVICE_NAME_MAX = 64
MESSAGE_MAX = 4096
TELEMETRY_RETENTION = 100_000
STREAM_RETENTION = 10_000
ANOMALY_THRESHOLD = 0.55
CONTEXT_WINDOW = 5
CONTEXT_RING = 50
TRAIN_THRESHOLD = 128
MICRO_BATCH = 32
VECTOR_DIM = 384
RCA_BUCKETS = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0)

FRAME = (
    "STRUCT<service_name: STRING, timestamp: STRING, level: STRING, message: STRING, "
    "stream_id: STRING, metadata: MAP<STRING, STRING>>"
)
FRAMES = f"ARRAY<{FRAME}>"

LOGS = (
    "stream_id BIGINT, service_name STRING, timestamp TIMESTAMP, level STRING, "
    "message STRING, metadata MAP<STRING, STRING>"
)
INCIDENTS = (
    "incident_id STRING, source_stream_id STRING, service_name STRING, timestamp STRING, "
    "level STRING, raw_message STRING, normalized_message STRING, anomaly_score DOUBLE, "
    f"anomaly_threshold DOUBLE, context_window_size INT, context_window {FRAMES}, "
    "metadata MAP<STRING, STRING>, detected_at DOUBLE"
)
RCA = (
    "rca_id STRING, incident_id STRING, service_name STRING, timestamp STRING, level STRING, "
    "raw_message STRING, normalized_message STRING, anomaly_score DOUBLE, root_cause STRING, "
    "suggested_fix STRING, risk_level STRING, impact_analysis STRING, "
    "generation_time_s DOUBLE, analyzed_at DOUBLE"
)
PENDING = (
    "incident_id STRING, service_name STRING, action_id STRING, risk_level STRING, "
    "target_command STRING"
)
HISTORY = (
    "execution_id STRING, incident_id STRING, service_name STRING, action_id STRING, "
    "risk_level STRING, target_command STRING, execution_type STRING, status STRING, "
    "stdout STRING, stderr STRING, duration_s DOUBLE, executed_by STRING, timestamp DOUBLE"
)
