"""Text encoding, the vector table, and exact nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logwarden.functions.vectors import EPSILON, has_dim, norm
from logwarden.operators.ordering import row_index
from logwarden.schemas import VECTOR_DIM

Encoder = Callable[[list[str]], np.ndarray]

# Query vectors travel to every task only while they fit in this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 50_000
#: Products of equal vectors may differ behind these digits with their place in a block;
#: ranks use the rounded value so that ties go by id. The floor is tested unrounded.
SIMILARITY_DIGITS = 12
#: Queries that are compared with one batch of the corpus at once.
QUERY_TILE = 1024


def encode(
    df: DataFrame,
    column: str = "normalized_message",
    name: str = "vector",
    encoder: Callable[[], Encoder] | None = None,
    dim: int = VECTOR_DIM,
) -> DataFrame:
    """Add a unit-length ARRAY<FLOAT> of the text.

    ``encoder`` builds a model once per task and maps a batch of texts to a
    matrix; without one, hashed term counts are used, which need no Python.
    """
    if encoder is None:
        words = Tokenizer(inputCol=column, outputCol="_words").transform(df)
        hashed = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf").transform(words)
        unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(hashed)
        return unit.withColumn(name, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for texts in batches:
            matrix = np.asarray(model(texts.fillna("").tolist()), dtype=np.float64)
            length = np.linalg.norm(matrix, axis=1, keepdims=True)
            unit = (matrix / np.where(length > 0, length, 1.0)).astype(np.float32)
            yield pd.Series(list(unit), index=texts.index)

    return df.withColumn(name, run(F.col(column)))


def split_by_dim(vectors: DataFrame, dim: int, column: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Rows that may be stored, and rows whose vector has the wrong shape."""
    ok = has_dim(F.col(column), dim)
    return vectors.filter(ok), vectors.filter(~ok)


def with_norm(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Store the norm next to the vector so that queries need not compute it."""
    return vectors.withColumn("norm", norm(F.col(column)))


def with_index(vectors: DataFrame, order: str = "stream_id") -> DataFrame:
    """Zero-based arrival index."""
    return row_index(vectors, order, "row_index")


def snapshot(vectors: DataFrame, path: str) -> DataFrame:
    """A consistent written copy that later appends do not change."""
    vectors.write.mode("errorifexists").parquet(path)
    return vectors.sparkSession.read.schema(vectors.schema).parquet(path)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + EPSILON)


def _best(queries: np.ndarray, query_ids, corpus: np.ndarray, ids, k: int, floor: float) -> pd.DataFrame:
    """Top k of one corpus block for every query, ties included."""
    unit = _unit_rows(corpus).T
    parts = []
    for start in range(0, len(queries), QUERY_TILE):
        sims = queries[start : start + QUERY_TILE] @ unit
        keep = sims >= floor
        sims = np.round(sims, SIMILARITY_DIGITS)
        if sims.shape[1] > k:
            kth = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
            keep &= sims >= kth
        q, c = np.nonzero(keep)
        parts.append(pd.DataFrame({"query_id": query_ids[start + q], "id": ids[c], "similarity": sims[q, c]}))
    return pd.concat(parts)


def _trim(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    hits = hits.sort_values(["query_id", "similarity", "id"], ascending=[True, False, True])
    return hits[hits.groupby("query_id").cumcount() < k]


def top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    min_similarity: float = -1.0,
    dim: int = VECTOR_DIM,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact cosine top k per query: (query_id, id, similarity, rank from 1).

    ``corpus`` is (id, vector) and ``queries`` (query_id, vector). Every corpus
    partition keeps only its own best k per query, so what is shuffled does not
    grow with the corpus. A query set beyond ``broadcast_bytes`` is matched block
    by block instead; both ways give the same rows. Equal similarities rank by id.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    corpus = corpus.select("id", "vector").filter(has_dim(F.col("vector"), dim))
    queries = queries.select("query_id", "vector")
    shape = queries.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~has_dim(F.col("vector"), dim)).alias("bad")
    ).first()
    if shape["bad"]:
        raise ValueError(f"{shape['bad']} query vectors do not have dimension {dim}")
    types = dict(corpus.dtypes) | dict(queries.dtypes)
    schema = f"query_id {types['query_id']}, id {types['id']}, similarity double"
    if shape["n"] * dim * 8 <= broadcast_bytes:
        hits = _scan(corpus, queries, k, min_similarity, dim, schema)
    else:
        hits = _block_join(corpus, queries, k, min_similarity, dim, schema, shape["n"], block_rows)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scan(corpus, queries, k, floor, dim, schema) -> DataFrame:
    spark = corpus.sparkSession
    held = queries.orderBy("query_id").toPandas()
    ids = held["query_id"].to_numpy()
    matrix = np.stack(held["vector"].to_list()).astype(np.float64) if len(held) else np.zeros((0, dim))
    shared = spark.sparkContext.broadcast((ids, _unit_rows(matrix)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, unit = shared.value
        best = None
        out = None
        for batch in batches:
            if batch.num_rows == 0 or len(query_ids) == 0:
                continue
            block_ids = batch.column("id").to_pandas().to_numpy()
            hits = _best(unit, query_ids, _matrix(batch.column("vector"), dim), block_ids, k, floor)
            best = _trim(hits if best is None else pd.concat([best, hits]), k)
            out = batch.schema.field("id").type
        if best is not None and len(best):
            id_type = pa.int64() if np.issubdtype(best["query_id"].dtype, np.integer) else None
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(best["query_id"].to_numpy(), type=id_type),
                    pa.array(best["id"].to_numpy(), type=out),
                    pa.array(best["similarity"].to_numpy()),
                ],
                names=["query_id", "id", "similarity"],
            )

    return corpus.mapInArrow(scan, schema)


def _block_join(corpus, queries, k, floor, dim, schema, n_queries, block_rows) -> DataFrame:
    query_rows = max(1, min(block_rows, BROADCAST_BYTES // (dim * 8)))
    q_blocks = math.ceil(n_queries / query_rows)
    c_blocks = max(1, math.ceil(corpus.count() / block_rows))
    left = corpus.withColumns(
        {
            "_c": F.pmod(F.xxhash64("id"), F.lit(c_blocks)),
            "_q": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))),
        }
    )
    right = queries.withColumns(
        {
            "_q": F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)),
            "_c": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(c_blocks - 1).cast("bigint"))),
        }
    )

    def match(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if block.empty or wanted.empty:
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        unit = _unit_rows(np.stack(wanted["vector"].to_list()).astype(np.float64))
        parts = []
        for start in range(0, len(block), 4096):
            piece = block.iloc[start : start + 4096]
            matrix = np.stack(piece["vector"].to_list()).astype(np.float64)
            parts.append(
                _best(unit, wanted["query_id"].to_numpy(), matrix, piece["id"].to_numpy(), k, floor)
            )
        return _trim(pd.concat(parts), k)

    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInPandas(match, schema)


def stats(vectors: DataFrame, dim: int = VECTOR_DIM) -> DataFrame:
    """Rows (scope, name, n, dim, memory_mb): the total, then per service and per level.

    One pass over the vectors reduces to (service, level) counts; the three
    groupings are taken from those.
    """
    cells = vectors.groupBy("service_name", "log_level").agg(F.count(F.lit(1)).alias("n"))
    scope = (
        F.when(F.grouping("service_name") == 0, "service")
        .when(F.grouping("log_level") == 0, "level")
        .otherwise("total")
    )
    return cells.groupingSets(
        [[F.col("service_name")], [F.col("log_level")], []], "service_name", "log_level"
    ).agg(scope.alias("scope"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        "scope",
        F.coalesce("service_name", "log_level", F.lit("all")).alias("name"),
        "n",
        F.lit(dim).alias("dim"),
        F.round(F.col("n") * dim * 4 / 1048576.0, 2).alias("memory_mb"),
    )
