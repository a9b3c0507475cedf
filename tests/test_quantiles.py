import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.operators import quantiles
from logwarden.sources.tables import newest


@pytest.mark.parametrize("buckets", [1, 9])
def test_percentiles_match_numpy(spark, buckets):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.exponential(5, 400), np.full(200, 2.5)])  # a third are equal
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    wanted = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    row = quantiles.exact_percentiles(df, "v", wanted, buckets).first()
    for name, q in wanted.items():
        assert row[name] == pytest.approx(np.percentile(values, q * 100), abs=1e-9)


def test_percentiles_of_nothing(spark):
    assert quantiles.exact_percentiles(spark.createDataFrame([], "v double"), "v", {"p95": 0.95}).first()["p95"] == 0.0


def test_bucket_quantiles(spark):
    df = spark.createDataFrame([(0.25,), (0.5,), (1.5,), (100.0,)], "v double")
    row = quantiles.histogram_quantiles(df, "v").first()
    assert row["p50"] == 0.5 and row["p99"] == 60.0
    empty = quantiles.histogram_quantiles(df.filter("v < 0"), "v").first()
    assert empty["p50"] is None
    rows = {r["le"]: r["cumulative"] for r in quantiles.histogram(df, "v").collect()}
    assert rows["0.5"] == 2 and rows["2"] == 3 and rows["60"] == 3 and rows["+Inf"] == 4


def test_newest_filters_in_place(spark):
    df = spark.range(1000).withColumnRenamed("id", "stream_id")
    assert sorted(r[0] for r in newest(df, 10).collect()) == list(range(990, 1000))
    assert newest(df.filter("stream_id < 0"), 10).count() == 0
    assert newest(df, 5000).count() == 1000


def test_nan_and_null_at_any_number_of_buckets(spark):
    values = [float(i) for i in range(99)] + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    one = [tuple(quantiles.exact_percentiles(df, "v", {"p50": 0.5, "p95": 0.95}, buckets=b).first()) for b in (1, 4, 8)]
    assert one[0] == one[1] == one[2] == (49.5, 94.05)
    assert quantiles.histogram_quantiles(df, "v", (("half", (F.col("v") < 50)),)).count() == 3
