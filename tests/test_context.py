from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logwarden.operators import context
from logwarden.operators.ordering import order_splits, stream_position


def rows():
    """Sparse, dense and hot services; ids with gaps."""
    out = []
    for i in range(900):
        service = "hot" if i % 3 else f"s{(i * 7) % 40}"
        out.append((i * 3 + (i % 2), service, f"m{i}"))
    return out


def expected(data, k):
    seen, out = defaultdict(list), {}
    for sid, service, message in sorted(data):
        seen[service].append(message)
        out[sid] = seen[service][-k:]
    return out


@pytest.mark.parametrize("k", [1, 2, 5, 9])
@pytest.mark.parametrize("buckets", [1, 4, 60])
def test_frames_do_not_depend_on_buckets(spark, k, buckets):
    df = spark.createDataFrame(rows(), "stream_id bigint, service_name string, message string").repartition(7)
    splits = order_splits(df, "stream_id", buckets)
    assert len(splits) == buckets - 1
    out = context.context_frames(df, F.col("message"), k, splits=splits)
    assert {r["stream_id"]: r["context_window"] for r in out.collect()} == expected(rows(), k)


def test_window_size_is_checked(spark):
    with pytest.raises(ValueError):
        context.context_frames(spark.range(1).withColumnRenamed("id", "stream_id"), F.lit(1), 0)


def test_ring_and_sizes(spark):
    df = spark.createDataFrame(rows(), "stream_id bigint, service_name string, message string")
    ring = context.ring_buffer(df, 50)
    hot = sorted(r["stream_id"] for r in ring.filter("service_name = 'hot'").collect())
    assert hot == sorted(r[0] for r in rows() if r[1] == "hot")[-50:]
    assert ring.count() == context.total_frames(df).first()[0]
    plan = ring._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # tasks send on 50 rows per service at most


def test_clear(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (1, "b")], "stream_id bigint, service_name string")
    clears = spark.createDataFrame([("a", 1), ("a", 2), ("z", 9)], "service_name string, cleared_at bigint")
    left = context.clear_services(df, clears)
    assert sorted(tuple(r) for r in left.select("service_name", "stream_id").collect()) == [("a", 3), ("b", 1)]
    assert {r[0]: r[1] for r in context.clear_outcome(df, clears).collect()} == {"a": True, "z": False}


def test_stream_position(spark):
    df = spark.createDataFrame([("1718000000000-0",), ("1718000000000-12",), ("1718000000001-0",), ("7",)], "s string")
    got = [r[0] for r in df.select(stream_position(F.col("s"))).collect()]
    assert got[0] < got[1] < got[2] and got[3] == 7
