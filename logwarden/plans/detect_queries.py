"""Queries over vectors, the forest, scores, context and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.functions.scoring import anomaly_score, is_anomaly
from logwarden.functions.vectors import norm
from logwarden.operators import context, detection, forest, rolling, service_forests, vectors
from logwarden.operators.templates import add_template
from logwarden.plans import derived
from logwarden.plans.catalog import query
from logwarden.plans.ingest_queries import time_text
from logwarden.session import scratch_path
from logwarden.sources.tables import materialised

DIM = 64


def store(spark, sf_dir):
    """The embeddings table as stored vectors with service and level."""
    e = derived.read(spark, sf_dir, "embeddings")
    levels = F.array(*[F.lit(x) for x in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")])
    return e.select(
        F.col("vec_id").alias("stream_id"),
        F.concat(F.lit("svc-"), (F.col("label") % 4).cast("string")).alias("service_name"),
        F.element_at(levels, (F.col("label") % 5 + 1).cast("int")).alias("log_level"),
        F.col("embedding").alias("vector"),
        "label",
    )


def centroids(spark, sf_dir):
    """Mean vector of each label: the query vectors."""
    e = derived.read(spark, sf_dir, "embeddings")
    cells = e.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
    return ordered.select(F.col("label").cast("bigint").alias("query_id"), F.col("c.x").alias("vector"))


_STORE = """
    store AS (SELECT vec_id AS stream_id, concat('svc-', CAST(label % 4 AS VARCHAR)) AS service_name,
              CASE label % 5 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'ERROR'
                   ELSE 'CRITICAL' END AS log_level, embedding, label FROM embeddings)
"""
_SIMILAR = """
    cells AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM cells GROUP BY label, pos),
    q AS (SELECT label AS query_id, list(x ORDER BY pos) AS c FROM means GROUP BY label),
    d AS (SELECT query_id, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, c FROM embeddings, q),
    sims AS (SELECT query_id, id, round(list_dot_product(v, c)
               / ((sqrt(list_dot_product(v, v)) + 1e-10) * (sqrt(list_dot_product(c, c)) + 1e-10)), 12) AS similarity FROM d),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims)
"""


@query("embed_messages")
def embed_messages(spark, sf_dir):
    templated = add_template(derived.logs(spark, sf_dir, spread=True))
    encoded = vectors.encode(templated)
    return encoded.select(
        "stream_id", F.size("vector").alias("dim"), F.round(norm(F.col("vector")), 4).alias("norm")
    )


@query(
    "vector_dim_check",
    (),
    f"""WITH {_STORE} SELECT CASE WHEN len(embedding) = 64 AND stream_id % 9 <> 0 THEN 'stored' ELSE 'rejected' END AS outcome,
        count(*) AS n FROM store GROUP BY ALL""",
)
def vector_dim_check(spark, sf_dir):
    # Every ninth vector is cut short to give the check something to reject.
    cut = store(spark, sf_dir).withColumn(
        "vector", F.when(F.col("stream_id") % 9 == 0, F.slice("vector", 1, 60)).otherwise(F.col("vector"))
    )
    good, bad = vectors.split_by_dim(cut, DIM)
    both = good.withColumn("outcome", F.lit("stored")).unionByName(bad.withColumn("outcome", F.lit("rejected")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "vector_index",
    (),
    f"""WITH {_STORE} SELECT stream_id, service_name, row_number() OVER (ORDER BY stream_id) - 1 AS row_index FROM store""",
)
def vector_index(spark, sf_dir):
    return vectors.with_index(store(spark, sf_dir)).select("stream_id", "service_name", "row_index")


@query(
    "vector_norm",
    (),
    """SELECT vec_id AS stream_id,
              round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm
       FROM embeddings""",
)
def vector_norm(spark, sf_dir):
    return vectors.with_norm(store(spark, sf_dir)).select("stream_id", "norm")


@query(
    "vector_topk",
    (),
    f"WITH {_SIMILAR} SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM ranked WHERE rank <= 5",
)
def vector_topk(spark, sf_dir):
    corpus = store(spark, sf_dir).select(F.col("stream_id").alias("id"), "vector")
    return vectors.top_k(corpus, centroids(spark, sf_dir), 5, dim=DIM)


@query(
    "vector_min_similarity",
    (),
    f"""WITH {_SIMILAR} SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM ranked
        WHERE rank <= 40 AND similarity >= 0.3""",
)
def vector_min_similarity(spark, sf_dir):
    corpus = store(spark, sf_dir).select(F.col("stream_id").alias("id"), "vector")
    return vectors.top_k(corpus, centroids(spark, sf_dir), 40, min_similarity=0.3, dim=DIM)


@query(
    "vector_stats",
    (),
    f"""WITH {_STORE}, g AS (
          SELECT 'total' AS scope, 'all' AS name, count(*) AS n FROM store
          UNION ALL SELECT 'service', service_name, count(*) FROM store GROUP BY service_name
          UNION ALL SELECT 'level', log_level, count(*) FROM store GROUP BY log_level)
        SELECT scope, name, n, CAST(64 AS BIGINT) AS dim, round(n * 64 * 4 / 1048576.0, 2) AS memory_mb FROM g""",
)
def vector_stats(spark, sf_dir):
    return vectors.stats(store(spark, sf_dir), DIM)


@query(
    "vector_snapshot",
    (),
    f"""WITH {_STORE} SELECT service_name, log_level, count(*) AS n FROM store GROUP BY ALL""",
)
def vector_snapshot(spark, sf_dir):
    frozen = vectors.snapshot(store(spark, sf_dir), scratch_path(spark, "snapshot"))
    return frozen.groupBy("service_name", "log_level").agg(F.count(F.lit(1)).alias("n"))


@query("forest_scores")
def forest_scores(spark, sf_dir):
    rows = store(spark, sf_dir)
    model = forest.fit(rows)
    return forest.score(rows, model).select(
        "stream_id", "raw_score", anomaly_score(F.col("raw_score")).alias("anomaly_score")
    )


@query(
    "score_sigmoid",
    ("logs",),
    "SELECT stream_id, round(score, 6) AS anomaly_score FROM logs",
)
def score_sigmoid(spark, sf_dir):
    return derived.logs(spark, sf_dir).select("stream_id", anomaly_score(F.col("raw")).alias("anomaly_score"))


@query(
    "threshold_filter",
    ("logs",),
    "SELECT stream_id, service_name, round(score, 6) AS score FROM logs WHERE score > 0.55",
)
def threshold_filter(spark, sf_dir):
    logs = derived.logs(spark, sf_dir)
    return logs.filter(is_anomaly(anomaly_score(F.col("raw")), 0.55)).select("stream_id", "service_name", "score")


@query(
    "cold_start",
    (),
    """SELECT vec_id AS stream_id, CAST(0.0 AS DOUBLE) AS anomaly_score FROM embeddings""",
)
def cold_start(spark, sf_dir):
    untrained = forest.score(store(spark, sf_dir), None)
    return untrained.select("stream_id", anomaly_score(F.col("raw_score")).alias("anomaly_score"))


@query(
    "baseline_gate",
    (),
    """SELECT count(*) AS stored, count(*) >= 128 AS is_open,
              CAST(CASE WHEN count(*) >= 128 THEN 128 ELSE 0 END AS BIGINT) AS train_rows,
              CAST(CASE WHEN count(*) >= 128 THEN 96 ELSE count(*) END AS BIGINT) AS cold_rows FROM embeddings""",
)
def baseline_gate(spark, sf_dir):
    return detection.gate_state(store(spark, sf_dir))


@query(
    "model_diagnostics",
    (),
    """SELECT true AS is_trained, count(*) AS train_sample_count, CAST(64 AS BIGINT) AS train_dim,
              CAST(100 AS BIGINT) AS n_estimators, 'auto' AS contamination, CAST(42 AS BIGINT) AS random_state
       FROM embeddings""",
)
def model_diagnostics(spark, sf_dir):
    return forest.diagnostics(spark, forest.fit(store(spark, sf_dir)))


@query("model_refit")
def model_refit(spark, sf_dir):
    """Fit, publish, refit with another seed, publish: readers get the newest version."""
    rows, path = store(spark, sf_dir), scratch_path(spark, "model")
    for version, seed in enumerate((1, 2), start=1):
        forest.save(spark, forest.fit(rows, seed=seed), path, version)
    return forest.diagnostics(spark, forest.load(spark, path))


@query(
    "context_frame",
    (),
    """SELECT conv_id, turn,
              array_to_string(list(concat(role, ':', CAST(length(text) AS VARCHAR))) OVER w, '|') AS frame,
              CAST(len(list(role) OVER w) AS BIGINT) AS frame_size
       FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def context_frame(spark, sf_dir):
    frame = F.concat(F.col("role"), F.lit(":"), F.length("text").cast("string"))
    framed = context.context_frames(
        derived.table(spark, sf_dir, "frames"), frame, 5, key="conv_id", order="turn"
    )
    return framed.select(
        "conv_id", "turn", F.array_join("context_window", "|").alias("frame"),
        F.size("context_window").alias("frame_size"),
    )


_LOG_FRAMES = """, f AS (
    SELECT stream_id, service_name, score, array_to_string(list(CAST(stream_id AS VARCHAR)) OVER w, ',') AS frame
    FROM logs WINDOW w AS (PARTITION BY service_name ORDER BY stream_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


@query(
    "context_frame_logs",
    ("logs",),
    f"{_LOG_FRAMES} SELECT stream_id, service_name, frame FROM f",
)
def context_frame_logs(spark, sf_dir):
    """Few services, many rows: windowed per order bucket with carried rows."""
    from logwarden.operators.ordering import order_splits

    logs = derived.logs(spark, sf_dir)
    framed = context.context_frames(
        logs.select("stream_id", "service_name"), F.col("stream_id").cast("string"), 5,
        splits=order_splits(logs, "stream_id", 16),
    )
    return framed.select("stream_id", "service_name", F.array_join("context_window", ",").alias("frame"))


@query(
    "ring_buffer",
    ("logs",),
    """, r AS (SELECT service_name, stream_id, level,
               row_number() OVER (PARTITION BY service_name ORDER BY stream_id DESC) AS n FROM logs)
       SELECT service_name, stream_id, level FROM r WHERE n <= 50""",
)
def ring_buffer(spark, sf_dir):
    return context.ring_buffer(derived.logs(spark, sf_dir).select("service_name", "stream_id", "level"))


@query(
    "buffer_sizes",
    (),
    "SELECT conv_id, CAST(least(count(*), 50) AS BIGINT) AS frames FROM conversations GROUP BY conv_id",
)
def buffer_sizes(spark, sf_dir):
    return context.buffer_sizes(derived.table(spark, sf_dir, "frames"), key="conv_id")


@query("known_services", ("logs",), "SELECT DISTINCT service_name FROM logs")
def known_services(spark, sf_dir):
    return context.known_services(derived.logs(spark, sf_dir))


@query(
    "total_frames",
    ("logs",),
    """SELECT CAST(sum(n) AS BIGINT) AS total_frames
       FROM (SELECT least(count(*), 50) AS n FROM logs GROUP BY service_name, level)""",
)
def total_frames(spark, sf_dir):
    logs = derived.logs(spark, sf_dir).select(F.concat("service_name", "level").alias("service_name"))
    return context.total_frames(logs)


@query(
    "clear_service",
    ("logs",),
    """, c AS (SELECT service_name, max(stream_id) AS cleared_at FROM logs WHERE level = 'CRITICAL' GROUP BY service_name)
       SELECT logs.service_name, stream_id FROM logs LEFT JOIN c ON logs.service_name = c.service_name
       WHERE cleared_at IS NULL OR stream_id > cleared_at""",
)
def clear_service(spark, sf_dir):
    logs = derived.logs(spark, sf_dir).select("service_name", "stream_id", "level")
    clears = logs.filter(F.col("level") == "CRITICAL").select("service_name", F.col("stream_id").alias("cleared_at"))
    return context.clear_services(logs, clears).select("service_name", "stream_id")


@query(
    "clear_outcome",
    ("logs",),
    """, asked AS (SELECT DISTINCT concat('svc-', CAST(user_id % 12 AS VARCHAR)) AS service_name FROM logs)
       SELECT service_name, service_name IN (SELECT service_name FROM logs) AS cleared FROM asked""",
)
def clear_outcome(spark, sf_dir):
    logs = derived.logs(spark, sf_dir)
    asked = logs.select(F.concat(F.lit("svc-"), (F.col("user_id") % 12).cast("string")).alias("service_name"))
    return context.clear_outcome(logs, asked)


@query(
    "incident_frames",
    ("logs",),
    f"""{_LOG_FRAMES} SELECT concat('incident-', CAST(f.stream_id AS VARCHAR)) AS incident_id, f.service_name,
           round(f.score, 6) AS anomaly_score, CAST(0.55 AS DOUBLE) AS anomaly_threshold,
           CAST(len(string_split(frame, ',')) AS BIGINT) AS context_window_size, frame AS context_ids,
           message AS raw_message
        FROM f JOIN logs USING (stream_id) WHERE f.score > 0.55""",
)
def incident_frames(spark, sf_dir):
    scored = add_template(derived.logs(spark, sf_dir)).withColumn("anomaly_score", anomaly_score(F.col("raw")))
    incidents = detection.incidents_from_scores(scored, detected_at=F.lit(0.0))
    ids = F.array_join(F.transform("context_window", lambda f: f["stream_id"]), ",")
    return incidents.select(
        "incident_id", "service_name", "anomaly_score", "anomaly_threshold", "context_window_size",
        ids.alias("context_ids"), "raw_message",
    )


@query(
    "context_rows",
    ("logs",),
    """, r AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY stream_id) AS n FROM logs)
       SELECT concat('incident-', CAST(i.stream_id AS VARCHAR)) AS incident_id, i.service_name,
              CAST(c.n - greatest(i.n - 4, 1) AS BIGINT) AS position, CAST(c.stream_id AS VARCHAR) AS stream_id,
              c.level, c.message
       FROM r i JOIN r c ON i.service_name = c.service_name AND c.n BETWEEN i.n - 4 AND i.n WHERE i.score > 0.55""",
)
def context_rows(spark, sf_dir):
    scored = add_template(derived.logs(spark, sf_dir)).withColumn("anomaly_score", anomaly_score(F.col("raw")))
    incidents = detection.incidents_from_scores(scored, detected_at=F.lit(0.0))
    return context.explode_frames(incidents).select(
        "incident_id", "service_name", "position", "stream_id", "level", "message"
    )


@query("detect_incidents")
def detect_incidents(spark, sf_dir):
    """The whole detection plan: templates, vectors, trained forest, threshold, context."""
    found = detection.detect(derived.logs(spark, sf_dir, spread=True), detected_at=F.lit(0.0))
    return found.select(
        "incident_id", "service_name", "normalized_message", "anomaly_score", "context_window_size"
    )


@query("score_events")
def score_events(spark, sf_dir):
    """Every event with its score from a forest trained on all templates."""
    templated = add_template(derived.logs(spark, sf_dir))
    model = forest.fit(vectors.encode(templated))
    return detection.score_events(templated, model).select(
        "stream_id", "service_name", time_text("timestamp").alias("time"), "anomaly_score"
    )


@query(
    "service_outliers",
    ("profiles",),
    """SELECT service_name, CASE WHEN count(*) >= 10 THEN 'own' ELSE 'shared' END AS model, count(*) AS scored,
              CAST(sum(planted) AS BIGINT) AS planted, CASE WHEN sum(planted) > 0 THEN TRUE END AS first
       FROM profiles GROUP BY service_name""",
)
def service_outliers(spark, sf_dir):
    """Per service the model used, its rows, and whether the planted ones score lower than all others."""
    features = F.array(*[F.col(f"f{i}").cast("float") for i in range(1, 5)])
    rows = derived.table(spark, sf_dir, "profiles").select("stream_id", "service_name", "planted", features.alias("vector"))
    rows = materialised(rows, "profiles")
    nodes = materialised(service_forests.fit(rows), "forests")
    scored = service_forests.score(rows, nodes, service_forests.fit_global(rows)).drop("service_name")
    found = rows.join(scored, "stream_id").groupBy("service_name", "model").agg(
        F.count("raw_score").alias("scored"),
        F.sum("planted").alias("planted"),
        F.max(F.when(F.col("planted") == 1, F.col("raw_score"))).alias("of_planted"),
        F.min(F.when(F.col("planted") == 0, F.col("raw_score"))).alias("of_others"),
    )
    return found.select("service_name", "model", "scored", "planted", (F.col("of_planted") < F.col("of_others")).alias("first"))


@query(
    "rolling_outliers",
    ("profiles",),
    """, placed AS (SELECT *, row_number() OVER (ORDER BY stream_id) - 1 AS i FROM profiles),
       v AS (SELECT (i - i % 1500) / 1500 AS version, planted FROM placed)
       SELECT CAST(version AS BIGINT) AS version, count(*) AS scored, CAST(sum(planted) AS BIGINT) AS planted,
              CASE WHEN version = 0 THEN FALSE ELSE TRUE END AS first
       FROM v GROUP BY version""",
)
def rolling_outliers(spark, sf_dir):
    """Per version of a forest refitted every 1500 rows its rows, and whether planted ones score above all others."""
    features = F.array(*[F.col(f"f{i}").cast("float") for i in range(1, 5)])
    rows = materialised(derived.table(spark, sf_dir, "profiles").select("stream_id", "planted", features.alias("vector")), "profiles")
    scored = rolling.rolling_scores(rows, every=1500, newest=1000)
    found = rows.join(scored, "stream_id").groupBy("version").agg(
        F.count(F.lit(1)).alias("scored"),
        F.sum("planted").alias("planted"),
        F.min(F.when(F.col("planted") == 1, F.col("anomaly_score"))).alias("of_planted"),
        F.max(F.when(F.col("planted") == 0, F.col("anomaly_score"))).alias("of_others"),
    )
    return found.select("version", "scored", "planted", (F.col("of_planted") > F.col("of_others")).alias("first"))
