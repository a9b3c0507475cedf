"""Batch and stream agree, and a restart loses and repeats nothing."""

import os
import time

import pytest
from pyspark.sql import functions as F

from logwarden.operators import detection, forest, vectors
from logwarden.operators.templates import add_template
from logwarden.plans import derived
from logwarden.schemas import LOGS
from logwarden.session import scratch_path
from logwarden.sources.lines import stream_json_events
from logwarden.streaming import approvals, files, stages

COLUMNS = ("stream_id", "service_name", "timestamp", "level", "message", "metadata")


def write_files(spark, sf, folder, parts):
    """The derived logs in id order as ``parts`` files with growing modification times."""
    logs = derived.logs(spark, sf).select(*COLUMNS)
    top = logs.agg(F.max("stream_id")).first()[0] + 1
    now = time.time() - 1000
    for i in range(parts):
        piece = logs.filter((F.col("stream_id") * parts / top).cast("int") == i)
        piece.coalesce(1).write.parquet(f"{folder}/part{i}")
        for root, _, names in os.walk(f"{folder}/part{i}"):
            for name in names:
                os.utime(os.path.join(root, name), (now + i * 10, now + i * 10))
    return logs


def shape(df):
    ids = F.array_join(F.transform("context_window", lambda f: f["stream_id"]), ",")
    rows = df.select("incident_id", F.round("anomaly_score", 9).alias("s"), ids.alias("ids")).collect()
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("parts", [1, 4])
def test_detect_matches_batch(spark, sf, parts):
    folder, base = scratch_path(spark, "in"), scratch_path(spark, "out")
    logs = write_files(spark, sf, folder, parts)
    model = forest.fit(vectors.encode(add_template(logs)))
    forest.save(spark, model, f"{base}/model", 1)
    stream = files.read_stream(spark, folder, LOGS, 1)
    stages.detect_available(stream, base, threshold=0.42, detected_at=F.lit(0.0))
    got = shape(files.read_all(spark, f"{base}/incidents", detection_schema()))
    want = shape(detection.detect(logs, model=model, threshold=0.42, detected_at=F.lit(0.0), buckets=3))
    assert got == want and got
    if parts > 1:
        assert len(os.listdir(f"{base}/vectors")) == parts


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_detect_trains_itself_as_in_batch(spark, sf, parts):
    """No model is given: both train on the same first rows, whatever the sizes of the files."""
    folder, base = scratch_path(spark, "in"), scratch_path(spark, "out")
    logs = write_files(spark, sf, folder, parts)
    stream = files.read_stream(spark, folder, LOGS, 1)
    stages.detect_available(stream, base, threshold=0.42, detected_at=F.lit(0.0))
    got = shape(files.read_all(spark, f"{base}/incidents", detection_schema()))
    assert got == shape(detection.detect(logs, threshold=0.42, detected_at=F.lit(0.0))) and got


def test_vectors_of_the_wrong_length_are_set_aside(spark, sf):
    folder, base = scratch_path(spark, "in"), scratch_path(spark, "out")
    logs = write_files(spark, sf, folder, 1)
    stream = files.read_stream(spark, folder, LOGS, 1)
    stages.detect_available(stream, base, threshold=0.42, dim=7)
    assert files.read_all(spark, f"{base}/vectors_rejected", stages.VECTORS).count() == logs.count()
    assert files.read_all(spark, f"{base}/incidents", detection_schema()).count() == 0
    assert forest.load(spark, f"{base}/model") is None


def detection_schema():
    from logwarden.schemas import INCIDENTS

    return INCIDENTS


def test_restart_repeats_nothing(spark, sf):
    folder, base = scratch_path(spark, "in"), scratch_path(spark, "out")
    write_files(spark, sf, folder, 3)

    def run():
        stream = files.read_stream(spark, folder, LOGS, 1)
        stages.detect_available(stream, base, threshold=0.42, detected_at=F.lit(0.0))
        return shape(files.read_all(spark, f"{base}/incidents", detection_schema()))

    first = run()
    assert run() == first and first
    # A batch whose commit was lost is replayed and leaves the same rows.
    commits = f"{base}/_checkpoints/detect/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    os.remove(f"{commits}/{last}")
    crc = f"{commits}/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert run() == first


def test_json_ingest(spark):
    folder, base = scratch_path(spark, "json"), scratch_path(spark, "out")
    os.makedirs(folder)
    with open(f"{folder}/a.txt", "w") as f:
        f.write('{"service_name":"A","message":" x "}\n{"service_name":"A"}\nnope\n')
    events = stream_json_events(spark, folder, 1, now=F.lit("2024-01-01").cast("timestamp"))
    stages.start_ingest(events, base, True).awaitTermination()
    good = files.read_all(spark, f"{base}/telemetry", LOGS).collect()
    assert [(r["service_name"], r["message"], r["level"]) for r in good] == [("a", "x", "INFO")]
    assert files.read_all(spark, f"{base}/rejected", LOGS).count() == 2
    # Lines that come later, equal ones too, get higher ids of their own.
    with open(f"{folder}/b.txt", "w") as f:
        f.write('{"service_name":"A","message":" x "}\n' * 50)
    events = stream_json_events(spark, folder, 1, now=F.lit("2024-01-01").cast("timestamp"))
    stages.start_ingest(events, base, True).awaitTermination()
    ids = [r["stream_id"] for r in files.read_all(spark, f"{base}/telemetry", LOGS).collect()]
    ids += [r["stream_id"] for r in files.read_all(spark, f"{base}/rejected", LOGS).collect()]
    assert sorted(ids) == [0, 1, 2, *range(1 << 40, (1 << 40) + 50)]


def test_approval_state_spans_batches(spark):
    folder, base = scratch_path(spark, "decisions"), scratch_path(spark, "out")
    held_schema = "incident_id string, service_name string, action_id string, risk_level string, target_command string"
    asked_schema = "decision_id bigint, incident_id string, decision string, decided_at double"
    for name in ("held", "asked"):
        os.makedirs(f"{folder}/{name}")

    def put(name, i, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}/b{i}")

    def run():
        out = approvals.decision_outcomes(
            files.read_stream(spark, f"{folder}/held", held_schema),
            files.read_stream(spark, f"{folder}/asked", asked_schema),
        )
        (
            out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
            .trigger(availableNow=True).start().awaitTermination()
        )

    put("held", 0, [("a", "s", "x", "HIGH", "mock-remediation scale_up"), ("b", "s", "x", "HIGH", "c")], held_schema)
    put("asked", 0, [(1, "z", "approve", 1.0)], asked_schema)
    run()
    put("asked", 1, [(3, "a", "deny", 3.0), (2, "a", "approve", 2.0)], asked_schema)
    run()
    put("asked", 2, [(4, "a", "approve", 4.0), (5, "b", "deny", 5.0)], asked_schema)
    run()
    out = spark.read.schema(approvals.OUTCOME).parquet(f"{base}/out")
    found = {r["decision_id"]: r["found"] for r in out.collect()}
    assert found == {1: False, 2: True, 3: False, 4: False, 5: True}
    history = {r["incident_id"]: r["status"] for r in approvals.history_of(out).collect()}
    assert history == {"a": "PLANNED", "b": "ABORTED"}


def test_decisions_release_held_actions(spark):
    folder, base = scratch_path(spark, "decisions"), scratch_path(spark, "out")
    asked_schema = "decision_id bigint, incident_id string, decision string, decided_at double"
    held = [(i, "s", "x", "HIGH", "mock-remediation scale_up") for i in ("a", "b", "c")]
    spark.createDataFrame(held, stages.PENDING).write.parquet(f"{base}/pending/batch_id=0")

    def run():
        pending = files.read_stream(spark, f"{base}/pending", stages.PENDING)
        stages.start_decide(pending, files.read_stream(spark, folder, asked_schema), base, True).awaitTermination()
        return {r["stream"]: r["length"] for r in stages.stage_lengths(spark, base).collect()}

    spark.createDataFrame([(1, "a", "approve", 1.0), (2, "z", "deny", 1.0)], asked_schema).write.parquet(f"{folder}/b0")
    first = run()
    assert (first["pending"], first["history"]) == (2, 1)
    spark.createDataFrame([(3, "a", "deny", 2.0), (4, "b", "deny", 2.0)], asked_schema).write.parquet(f"{folder}/b1")
    second = run()
    assert (second["pending"], second["history"]) == (1, 2)
    assert [r["incident_id"] for r in stages.open_actions(spark, base).collect()] == ["c"]


def test_dedup_spans_batches(spark):
    from logwarden.streaming import windows

    folder, base = scratch_path(spark, "signatures"), scratch_path(spark, "out")
    schema = "timestamp timestamp, service_name string, normalized_message string"
    for i in range(3):
        rows = spark.range(40).select(
            F.timestamp_seconds(F.lit(1_700_000_000 + i) + F.col("id") / 100).alias("timestamp"),
            F.lit("hot").alias("service_name"),
            F.concat(F.lit("t"), F.when(F.col("id") < 30, 0).otherwise(F.col("id") % 3 + i)).alias("normalized_message"),
        )
        rows.coalesce(1).write.parquet(f"{folder}/b{i}")
    first = windows.distinct_signatures(files.read_stream(spark, folder, schema, 1))
    (
        first.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
        .trigger(availableNow=True).start().awaitTermination()
    )
    got = sorted(r["normalized_message"] for r in spark.read.schema(schema).parquet(f"{base}/out").collect())
    assert got == ["t0", "t1", "t2", "t3", "t4"]


def test_held_actions_expire(spark):
    """Actions, decisions in and out of time, several of one action, over two batches."""
    from random import Random

    from logwarden.streaming import approvals

    r = Random(6)
    held = [(f"i{k}", "s", "act", "HIGH", f"cmd{k}", 1000.0 + k) for k in range(40)] + [("timeless", "s", "act", "HIGH", "cmd", None)]
    asked = [(f"i{r.randint(0, 45)}", n, "approve", 1000.0 + r.randint(0, 160)) for n in range(120)]
    asked += [("timeless", 900, "deny", 1e6), (None, 901, "deny", 1.0), ("i1", 902, "deny", None)]
    held_type = "incident_id string, service_name string, action_id string, risk_level string, target_command string, held_at double"
    asked_type = "incident_id string, decision_id bigint, decision string, decided_at double"
    base = scratch_path(spark, "expiry")
    spark.createDataFrame(held, held_type).coalesce(1).write.parquet(f"{base}/held")

    def run(name, rows):
        spark.createDataFrame(rows, asked_type).coalesce(1).write.parquet(f"{base}/asked/{name}")
        streams = [files.read_stream(spark, f"{base}/{n}", t) for n, t in (("held", held_type), ("asked", asked_type))]
        stages.start_decide(*streams, base, True, ttl_s=60.0).awaitTermination()
        return files.read_all(spark, f"{base}/decided", approvals.OUTCOME).collect()

    got = run("a", asked)
    ends = {i: (1e300 if at is None else at + 60) for i, *_, at in held}
    first = {}
    for i, n, _, at in asked:
        if i in ends and (at is not None and at <= ends[i]):
            first[i] = min(n, first.get(i, n))
    assert {(g["incident_id"], g["decision_id"]) for g in got if g["found"] and g["decision_id"] is not None} == set(first.items())
    assert len([g for g in got if g["decision_id"] is not None]) == len(asked)
    # The deciding event at 1e6 lets all others expire; a decision that comes after that finds nothing.
    expired = {g["incident_id"] for g in got if g["decision"] == "expired"}
    assert expired == set(ends) - set(first)
    later = run("b", [(next(iter(expired)), 1_000, "approve", 2e6)])
    assert [g["found"] for g in later if g["decision_id"] == 1_000] == [False]


def test_ids_follow_from_what_was_written(spark, tmp_path):
    """Two reads of a received batch under other split sizes give the same ids to the same rows."""
    given = stages.placed(spark.range(1_000).repartition(5).withColumnRenamed("id", "v"))
    given.write.parquet(str(tmp_path / "in"))
    size, got = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for limit in (size, "200"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
            rows = stages.with_ids(spark.read.schema(given.schema).parquet(str(tmp_path / "in")), 3).collect()
            got.append({(r["v"], r["stream_id"]) for r in rows})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got[0] == got[1] and {i for _, i in got[0]} == set(range(3 << 40, (3 << 40) + 1_000))


def test_held_actions_share_state_by_shard(spark):
    """A value of the state, and a call into Python, holds many actions; null ids are held like others."""
    base = scratch_path(spark, "shards")
    n = 4 * approvals.SHARDS
    ids = spark.range(n).select(F.when(F.col("id") > 0, F.concat(F.lit("i"), "id")).alias("incident_id"), "id")
    ids.select("incident_id", *[F.concat(F.lit(c), "id").alias(c) for c in approvals.HELD]).write.parquet(f"{base}/held/a")
    # Two decisions on every third action in the same batch, the later id first.
    twice = ids.filter("id % 3 = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(0))))
    twice.select((F.col("id") * 2 + F.col("k")).alias("decision_id"), "incident_id", F.lit("deny").alias("decision"),
                 F.lit(1.0).alias("decided_at")).write.parquet(f"{base}/asked/a")
    schemas = {name: spark.read.parquet(f"{base}/{name}/a").schema for name in ("held", "asked")}
    out = approvals.decision_outcomes(*[files.read_stream(spark, f"{base}/{name}", s) for name, s in schemas.items()])
    run = (
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= approvals.SHARDS
    got = spark.read.schema(approvals.OUTCOME).parquet(f"{base}/out").collect()
    assert len(got) == 2 * len(range(0, n, 3))
    want = {2 * i: f"target_command{i}" for i in range(0, n, 3)}
    assert {r["decision_id"]: r["target_command"] for r in got if r["found"]} == want


def test_context_hands_on_rows_without_state(spark):
    """A hot service over three batches: windows as over the whole, few rows handed on, no service sorted as one key."""
    from logwarden.schemas import CONTEXT_RING
    from logwarden.streaming import keyed

    base, n = scratch_path(spark, "context"), 600
    rows = spark.range(n).select(
        F.col("id").alias("stream_id"), F.when(F.col("id") % 7 > 0, "hot").alias("service_name"),
        F.timestamp_seconds("id").alias("timestamp"), F.lit("INFO").alias("level"), F.concat(F.lit("m"), "id").alias("message"),
        F.create_map(F.lit("k"), F.lit("v")).alias("metadata"), F.lit("t").alias("normalized_message"),
        F.when(F.col("id") % 5 == 0, 0.9).otherwise(0.1).alias("anomaly_score"),
    )
    for part in range(3):
        rows.filter(F.floor(F.col("stream_id") / (n // 3)) == part).write.parquet(f"{base}/in/part={part}")
        stream = files.read_stream(spark, f"{base}/in", keyed.SCORED)
        run = stages.start_context(stream, base, detected_at=F.lit(0.0), available_now=True)
        run.awaitTermination()
        assert run.lastProgress["stateOperators"] == []
    shown = F.transform("context_window", lambda f: f["message"])
    found = files.read_all(spark, f"{base}/incidents", detection_schema())
    got = {r[0]: r[1] for r in found.select("incident_id", shown).collect()}
    want = {}
    for kind in (0, 1):
        mine = [i for i in range(n) if (i % 7 > 0) == kind]
        want |= {f"incident-{i}": [f"m{j}" for j in mine[max(0, k - 4) : k + 1]] for k, i in enumerate(mine) if i % 5 == 0}
    assert got == want
    assert spark.read.parquet(f"{base}/ring/batch_id=2").count() == 2 * CONTEXT_RING


def test_expiring_actions_share_state_by_shard(spark):
    """A value of the state and one timer hold many actions; those undecided expire at their own ends."""
    base = scratch_path(spark, "ends")
    n = 3 * approvals.SHARDS
    ids = spark.range(n).select(F.concat(F.lit("i"), "id").alias("incident_id"), "id")
    held = ids.select("incident_id", *[F.concat(F.lit(c), "id").alias(c) for c in approvals.HELD], (1000.0 + F.col("id")).alias("held_at"))
    asked = ids.filter("id % 3 = 0").select(
        "incident_id", F.col("id").alias("decision_id"), F.lit("deny").alias("decision"),
        (1000.0 + F.col("id") + F.when(F.col("id") % 2 == 0, 60).otherwise(61)).alias("decided_at"),
    )
    held.write.parquet(f"{base}/held")
    asked.write.parquet(f"{base}/asked")
    streams = [files.read_stream(spark, f"{base}/{name}", df.schema) for name, df in (("held", held), ("asked", asked))]
    run = stages.start_decide(*streams, base, True, ttl_s=60.0)
    run.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert 0 < max(state) <= 4 * approvals.SHARDS
    got = files.read_all(spark, f"{base}/decided", approvals.OUTCOME).collect()
    assert {r["decision_id"] for r in got if r["found"] and r["decision_id"] is not None} == set(range(0, n, 6))
    newest = max(1000 + n - 1, max(1000 + i + (60 if i % 2 == 0 else 61) for i in range(0, n, 3)))
    over = {(f"i{i}", 1060.0 + i, f"target_command{i}") for i in range(n) if i % 6 and 1060 + i <= newest - 600}
    assert {(r["incident_id"], r["decided_at"], r["target_command"]) for r in got if r["decision"] == "expired"} == over
