"""Risk rules, forests per service and rolling forests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.operators import forest, risk_rules, rolling, service_forests
from logwarden.streaming.files import read_all
from logwarden.streaming.rolling import start_rolling


def plain_tier(rules, action, criticality, confidence):
    unknown = confidence is None or confidence != confidence
    for priority, a, c, above, up_to, tier in sorted(rules, key=lambda r: (r[0], r[5])):
        fits = a in (None, action) and c in (None, criticality) and (a is None or action is not None)
        fits = fits and (c is None or criticality is not None)
        free = above is None and up_to is None
        if fits and (free or not unknown and (above is None or confidence > above) and (up_to is None or confidence <= up_to)):
            return tier, priority
    return None, None


@pytest.mark.parametrize("limit", [risk_rules.BROADCAST_BYTES, 0])
def test_rules_against_plain_search(spark, monkeypatch, limit):
    monkeypatch.setattr(risk_rules, "BROADCAST_BYTES", limit)
    r = np.random.default_rng(5)
    names, levels = [None, "a", "b", "c"], [None, "x", "y"]
    bound = lambda: None if r.random() < 0.3 else float(r.integers(0, 11)) / 10
    rules = [(int(r.integers(1, 30)), names[r.integers(4)], levels[r.integers(3)], bound(), bound(), f"T{k}") for k in range(40)]
    acts = [(k, names[r.integers(4)], levels[r.integers(3)], [None, float("nan"), *np.arange(0, 1.01, 0.05).tolist()][r.integers(23)]) for k in range(400)]
    df = spark.createDataFrame([(*a, "kept") for a in acts], "i int, action string, criticality string, confidence double, ranges string")
    got = risk_rules.assign(df.repartition(3), spark.createDataFrame(rules, risk_rules.RULES)).collect()
    assert {(g["i"], g["risk_tier"], g["risk_rule"], g["ranges"]) for g in got} == {
        (i, *plain_tier(rules, a, c, v), "kept") for i, a, c, v in acts
    }
    assert len(got) == len(acts)


def test_default_rules_and_none(spark):
    acts = [("restart_service", "low", 0.9), ("restart_service", "low", 0.85), ("restart_service", "high", None),
            ("failover_database", None, None), ("rollback_deployment", "production", 0.1), ("unknown", "low", 0.99)]
    df = spark.createDataFrame(acts, "action string, criticality string, confidence double")
    got = risk_rules.assign(df, risk_rules.default_rules(spark)).collect()
    assert [g["risk_tier"] for g in got] == ["LOW", None, "MEDIUM", "HIGH", "HIGH", None]
    assert [g["risk_tier"] for g in risk_rules.assign(df, spark.createDataFrame([], risk_rules.RULES)).collect()] == [None] * 6


def cloud(n, seed, shift=0.0):
    return np.random.default_rng(seed).normal(size=(n, 3)) + shift


def rows_of(parts):
    out, key = [], 0
    for service, x in parts:
        for v in x:
            out.append((key, service, [float(t) for t in v]))
            key += 1
    return out


SCHEMA = "stream_id bigint, service_name string, vector array<float>"


def test_forests_per_service(spark, monkeypatch):
    monkeypatch.setattr(service_forests, "BLOCK_ROWS", 300)
    parts = [("hot", cloud(2500, 1)), ("hot", cloud(5, 2, 15)), ("far", cloud(200, 3, 15)), ("far", cloud(3, 4)), ("few", cloud(4, 5)), (None, cloud(30, 6))]
    rows = rows_of(parts)
    odd = [(90_000, "hot", [1.0]), (90_001, "hot", None), (90_002, "few", [1.0, float("nan"), 0.0])]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    one = None
    for many in (2, 7):
        nodes = service_forests.fit(df.repartition(many)).cache()
        scored = service_forests.score(df.repartition(many + 1), nodes, service_forests.fit_global(df.filter("size(vector) = 3")))
        got = {r["stream_id"]: r for r in scored.collect()}
        assert len(got) == len(rows) + 3
        assert one is None or one == {k: r["raw_score"] for k, r in got.items() if k != 90_002}
        one = {k: r["raw_score"] for k, r in got.items() if k != 90_002}
    assert {r["service_name"]: r["model"] for r in got.values()} == {"hot": "own", "far": "own", "few": "shared", "": "own"}
    assert got[90_000]["raw_score"] is None and got[90_001]["raw_score"] is None
    hot, far = range(2505), range(2505, 2708)
    # What is usual in one service is an outlier in the other.
    assert sorted(hot, key=lambda k: one[k])[:5] == sorted(range(2500, 2505), key=lambda k: one[k])
    assert set(sorted(far, key=lambda k: one[k])[:3]) == {2705, 2706, 2707}
    assert service_forests.fit(df.limit(0)).count() == 0
    assert {r["model"] for r in service_forests.score(df, nodes.limit(0), None).collect()} == {"none"}
    assert max(r["n"] for r in nodes.groupBy("service_name", "tree").agg(F.count("*").alias("n")).collect()) < 2 * forest.SUBSAMPLE


def test_rolling_batch_and_stream_agree(spark, tmp_path):
    x = cloud(700, 8)
    x[450:] += 12.0  # what is normal changes
    rows = [(k * 3, [float(t) for t in v]) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "stream_id bigint, vector array<float>")
    want = {r["stream_id"]: tuple(r) for r in rolling.rolling_scores(df.repartition(5), every=100, newest=150).collect()}
    assert len(want) == 700 and {r[1] for r in want.values()} == set(range(7))
    assert all(want[k * 3][2] == 0.0 for k in range(100))
    # The shift is an outlier for the versions before it and normal once they have learned it.
    assert want[455 * 3][2] > max(want[k * 3][2] for k in range(100, 400) if k % 7 == 0) - 0.2
    assert np.mean([want[k * 3][2] for k in range(450, 500)]) > np.mean([want[k * 3][2] for k in range(650, 700)]) + 0.1
    for parts in (1, 4, 7):
        source, base = str(tmp_path / f"in{parts}"), str(tmp_path / f"out{parts}")
        for part, chunk in enumerate(np.array_split(np.arange(700), parts)):
            low, high = int(chunk[0]) * 3, int(chunk[-1]) * 3
            df.filter(F.col("stream_id").between(low, high)).coalesce(1).write.parquet(f"{source}/part={part}")
            stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(source)
            start_rolling(stream, base, 100, 150, available_now=True).awaitTermination()  # a restart per file
        got = {r["stream_id"]: tuple(r) for r in read_all(spark, f"{base}/scores", "stream_id bigint, version bigint, anomaly_score double").collect()}
        assert got == want
