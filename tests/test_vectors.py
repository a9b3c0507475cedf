import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.functions.vectors import cosine, l2_normalize, norm
from logwarden.operators import vectors

RNG = np.random.default_rng(7)
CORPUS = RNG.normal(size=(300, 8)).astype(np.float32)
CORPUS[100:200] = CORPUS[100]  # a third of the rows are copies of one vector
QUERIES = np.vstack([RNG.normal(size=(4, 8)), CORPUS[100:101], np.zeros((1, 8))]).astype(np.float32)


def frame(spark, matrix, name):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, vector array<float>")


def brute(k, floor):
    c = CORPUS.astype(float)
    q = QUERIES.astype(float)
    sims = (q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-10)) @ (
        c / (np.linalg.norm(c, axis=1, keepdims=True) + 1e-10)
    ).T
    sims = np.round(sims, 9)
    out = []
    for i, row in enumerate(sims):
        order = sorted((j for j in range(len(row)) if row[j] >= floor), key=lambda j: (-row[j], j))
        out += [(i, j, r) for r, j in enumerate(order[:k], start=1)]
    return sorted(out)


@pytest.mark.parametrize("k,floor", [(1, -1.0), (5, -1.0), (7, 0.4), (400, -1.0)])
@pytest.mark.parametrize("limit", [vectors.BROADCAST_BYTES, 0])
def test_top_k_matches_brute_force(spark, k, floor, limit):
    got = vectors.top_k(
        frame(spark, CORPUS, "id").repartition(5), frame(spark, QUERIES, "query_id"), k, floor,
        dim=8, broadcast_bytes=limit, block_rows=64,
    )
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got.collect()) == brute(k, floor)


def test_top_k_edges(spark):
    corpus = frame(spark, CORPUS, "id")
    with pytest.raises(ValueError):
        vectors.top_k(corpus, frame(spark, QUERIES[:, :5], "query_id"), dim=8)
    assert vectors.top_k(corpus.filter("id < 0"), frame(spark, QUERIES, "query_id"), dim=8).count() == 0
    assert vectors.top_k(corpus, frame(spark, QUERIES, "query_id").filter("query_id < 0"), dim=8).count() == 0


def test_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(
        norm(F.col("a")).alias("n"), cosine(F.col("a"), F.col("b")).alias("c"), l2_normalize(F.col("a")).alias("u")
    ).collect()
    assert rows[0]["n"] == 5.0 and abs(rows[0]["c"] - 0.96) < 1e-9 and np.allclose(rows[0]["u"], [0.6, 0.8])
    assert rows[1]["c"] == 0.0 and rows[1]["u"] == [0.0, 0.0]


def test_dim_split_and_index(spark):
    df = spark.createDataFrame(
        [(i * 10, [1.0] * (3 if i % 4 else 2)) for i in range(50)], "stream_id bigint, vector array<float>"
    )
    good, bad = vectors.split_by_dim(df, 3)
    assert (good.count(), bad.count()) == (37, 13)
    for parts in (1, 3, 6):
        got = vectors.with_index(df.repartition(parts)).collect()
        assert sorted((r["stream_id"], r["row_index"]) for r in got) == [(i * 10, i) for i in range(50)]


def test_encoders(spark):
    df = spark.createDataFrame([("a b a",), ("c",), ("",)], "normalized_message string")
    default = vectors.encode(df, dim=32).collect()
    assert all(len(r["vector"]) == 32 and abs(np.linalg.norm(r["vector"]) - 1) < 1e-6 for r in default)

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    own = vectors.encode(df, encoder=load).collect()
    assert np.allclose(own[1]["vector"], np.array([1.0, 1.0]) / np.sqrt(2))
