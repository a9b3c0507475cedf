"""Work that is done once per row, and spread over tasks, however the input is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.functions.text import MASK_BY_NAME
from logwarden.operators import templates, validation
from logwarden.plans import derived


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_accepted_rows_are_parsed_once(spark):
    rows = spark.range(4).select(
        F.col("id"), F.lit("svc").alias("service_name"), F.lit("INFO").alias("level"),
        F.concat(F.lit("reversed "), F.reverse(F.col("id").cast("string"))).alias("message"),
        F.col("id").cast("string").alias("timestamp"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    plan = _plan(validation.accepted(validation.validate(rows)))
    assert plan.count("reverse(") == 1
    assert plan.count("timestamp_micros(") == 1
    lines = spark.range(4).select(F.concat(F.lit('{"a": '), F.col("id").cast("string"), F.lit("}")).alias("value"))
    plan = _plan(validation.accepted(validation.validate_json(lines)))
    assert plan.count("timestamp_micros(") == 1


def test_numbers_and_times_are_told_apart(spark):
    texts = ["1700000000", "1700000000000", "1e9", " 5 ", "2024-01-01 00:00:00", "2024-01-01", "a:b", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    seen = [r[0] for r in df.select(F.unix_seconds(validation.parse_timestamp(F.col("t")))).collect()]
    assert seen == [1700000000, 1700000000, 1000000000, 5, 1704067200, 1704067200, None, None, None]


def test_numeric_ids_of_every_key_are_masked(spark):
    keys = (
        "user_id uid pid tid txn_id txnid order_id session_id batch_id request_id req_id job_id task_id conn_id "
        "attempt count CODE line Exit status_code fd"
    ).split()
    texts = [f"{k}{sep}7 end" for k in keys for sep in ("=", ": ", " ")] + ["n 123456 end", "round 5", "code5", "id 5"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    mask = MASK_BY_NAME["numeric_id"]
    want = F.regexp_replace("t", mask.pattern, mask.label)
    got = df.select("t", want.alias("want"), templates.template(F.col("t")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert got[-3]["got"] == "round 5" and got[0]["got"] == "<NUM_ID> end"


def test_one_row_group_is_many_tasks(spark, tmp_path):
    events = spark.range(400).select(
        F.col("id").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("bigint").alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(0.5).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows = derived.table(spark, str(tmp_path), "logs", spread=True)
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 400


def test_ingest_parses_a_batch_once(spark, tmp_path):
    from logwarden.streaming import stages

    spark.createDataFrame([('{"service_name": "a", "message": "m"}', 1), ("bad", 2)], "value STRING, stream_id BIGINT").write.parquet(f"{tmp_path}/in")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    lines = spark.readStream.schema("value STRING, stream_id BIGINT").parquet(f"{tmp_path}/in")
    lines = lines.withColumn("value", counted.asNondeterministic()("value"))
    stages.start_ingest(validation.validate_json(lines), f"{tmp_path}/out", True).awaitTermination()
    assert seen.value == 2
    assert spark.read.parquet(f"{tmp_path}/out/telemetry").count() == spark.read.parquet(f"{tmp_path}/out/rejected").count() == 1
