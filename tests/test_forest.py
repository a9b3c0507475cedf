import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.functions.scoring import anomaly_score, check_threshold
from logwarden.operators import forest
from logwarden.session import scratch_path


def table(spark, rows=600, dim=6, outliers=3):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.1, size=(rows, dim))
    x[:outliers] = rng.normal(10, 0.5, size=(outliers, dim))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "stream_id bigint, vector array<float>")


def scores(df, model):
    out = forest.score(df, model).withColumn("s", anomaly_score(F.col("raw_score")))
    return {r["stream_id"]: r["s"] for r in out.collect()}


def test_average_path():
    assert forest.average_path(1) == 0 and forest.average_path(2) == 1
    harmonic = sum(1 / i for i in range(1, 256))
    assert abs(forest.average_path(256) - (2 * harmonic - 2 * 255 / 256)) < 0.01


def test_outliers_score_higher_and_partitions_do_not_matter(spark):
    df = table(spark)
    first = forest.fit(df.repartition(1))
    second = forest.fit(df.repartition(8))
    key = ["tree", "node"]
    assert first.nodes.sort_values(key).reset_index(drop=True).equals(second.nodes.sort_values(key).reset_index(drop=True))
    assert first.subsample == 256 and first.nodes["tree"].nunique() == 100
    s = scores(df, first)
    assert all(0 <= v <= 1 for v in s.values())
    assert min(s[i] for i in range(3)) > max(s[i] for i in range(3, 600))


def test_subsamples_are_uniform_without_replacement(spark):
    df = table(spark, 5000, 2, 0)
    drawn = forest._subsamples(df, "stream_id", 5000, 100, 256, 42)
    per_tree = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("stream_id").alias("d")).collect()
    assert len(per_tree) == 100 and all(r["n"] == r["d"] == 256 for r in per_tree)
    used = drawn.select(F.count_distinct("stream_id")).first()[0]
    assert used > 4900


def test_small_and_bad_input(spark):
    with pytest.raises(ValueError):
        forest.fit(table(spark, 9))
    mixed = table(spark, 20).withColumn("vector", F.when(F.col("stream_id") < 2, F.slice("vector", 1, 3)).otherwise(F.col("vector")))
    with pytest.raises(ValueError):
        forest.fit(mixed)
    constant = table(spark, 20).withColumn("vector", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>"))
    assert len(set(scores(constant, forest.fit(constant)).values())) == 1
    for bad in (0.0, 1.01):
        with pytest.raises(ValueError):
            check_threshold(bad)
    check_threshold(1.0)


def test_untrained_and_contamination(spark):
    df = table(spark, 200)
    assert set(scores(df, None).values()) == {0.0}
    model = forest.fit(df, contamination=0.1)
    flagged = sum(1 for v in scores(df, model).values() if v > 0.5)
    assert flagged == 20
    assert forest.diagnostics(spark, None).first()["is_trained"] is False


def test_save_and_reload_newest(spark):
    df, path = table(spark, 100), scratch_path(spark, "model")
    assert forest.load(spark, path) is None
    for version, seed in ((1, 5), (2, 6)):
        forest.save(spark, forest.fit(df, seed=seed), path, version)
    model = forest.load(spark, path)
    assert model.seed == 6 and scores(df, model) == scores(df, forest.fit(df, seed=6))


@pytest.mark.parametrize("rows", [150_000, 300_000])
def test_every_row_can_be_drawn_at_any_size(spark, rows):
    """The subsamples of the trees are independent: together they hold almost 100 x 256 different rows."""
    df = spark.range(rows).select(F.col("id").alias("stream_id"), F.array(F.lit(0.0)).alias("vector"))
    used = forest._subsamples(df, "stream_id", rows, 100, 256, 42).select(F.count_distinct("stream_id")).first()[0]
    expected = rows * (1 - (1 - 256 / rows) ** 100)
    assert abs(used - expected) < 0.02 * expected


def test_lists_grow_the_trees_of_arrays(monkeypatch):
    x = np.random.default_rng(3).normal(size=(256, 4))
    x[:, 1] = np.round(x[:, 1])
    x[:, 3] = 2.0
    called = []
    least = np.minimum

    class Counted:
        reduce = staticmethod(lambda rows: called.append(len(rows)) or least.reduce(rows))

    monkeypatch.setattr(forest.np, "minimum", Counted)
    lists = forest.grow(x, 5, 42, 8)
    assert called and min(called) >= forest.LIST_ROWS  # small nodes cost no array calls
    monkeypatch.setattr(forest, "LIST_ROWS", 0)
    assert lists.equals(forest.grow(x, 5, 42, 8))
