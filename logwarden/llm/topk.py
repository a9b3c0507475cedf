"""Exact top-k search by inner product, pruned by segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Segments per vector, coarse to fine.
LEVELS = (1, 2, 4, 8, 16)
#: Query vectors that are sent to the tasks at once, in bytes.
BLOCK_BYTES = 8 << 20
#: Queries and candidates whose bounds are compared at once.
QUERY_TILE, CANDIDATE_TILE = 512, 512
#: Pairs whose vectors are gathered at once.
PAIRS = 1 << 14
#: Share of pairs below which bounds are taken pair by pair.
FEW = 0.1


def integer_vector(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component; null for vectors that hold a null or non-finite one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Statistics:
    """Vectors of one length with means and deviations of their segments.

    With q, c vectors and n, m, s a segment's length, mean and deviation, the squared
    distance is at least the sum of n * ((m_q - m_c)^2 + (s_q - s_c)^2). Each level is kept
    as sqrt(n) * (m, s), so that the bounds of many pairs are one matrix product.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.values = vectors.astype(np.float64)
        self.norms = (self.values**2).sum(1)
        self.levels = []
        for parts in LEVELS:
            if parts <= vectors.shape[1]:
                edges = np.linspace(0, vectors.shape[1], parts + 1).astype(np.int64)
                size = np.diff(edges)
                mean = np.add.reduceat(self.values, edges[:-1], axis=1) / size
                square = np.add.reduceat(self.values**2, edges[:-1], axis=1) / size
                deviation = np.sqrt(np.maximum(square - mean**2, 0))
                self.levels.append(np.hstack([mean * np.sqrt(size), deviation * np.sqrt(size)]))


def _sums(mine: np.ndarray, a: np.ndarray, theirs: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, gathered in runs of a bounded size."""
    out = np.empty(len(a), dtype=mine.dtype)
    for at in range(0, len(a), PAIRS):
        x, y = a[at : at + PAIRS], b[at : at + PAIRS]
        out[at : at + PAIRS] = np.einsum("ij,ij->i", mine[x], theirs[y])
    return out


def survivors(q: Statistics, rows: np.ndarray, c: Statistics, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) whose product may reach ``least`` of the query.

    q.c = (|q|^2 + |c|^2 - distance^2) / 2, so a lower bound of the distance bounds the
    product from above. Levels are taken coarse to fine, each on what the last one left.
    """
    slack = 1e-9 * (q.norms[rows][:, None] + c.norms[None, :]) + 1.0
    alive = np.ones((len(rows), len(c.norms)), dtype=bool)
    pairs = None
    for mine, theirs in zip(q.levels, c.levels):
        if pairs is None:
            lower = q.norms[rows][:, None] + c.norms[None, :] - 2 * (mine[rows] @ theirs.T)
            alive &= (q.norms[rows][:, None] + c.norms[None, :] - lower) / 2 + slack >= least[:, None]
            if alive.mean() < FEW:
                pairs = np.nonzero(alive)
        else:
            a, b = pairs
            both = q.norms[rows[a]] + c.norms[b]
            lower = both - 2 * _sums(mine, rows[a], theirs, b)
            keep = (both - lower) / 2 + slack[a, b] >= least[a]
            pairs = a[keep], b[keep]
    return np.nonzero(alive) if pairs is None else pairs


class Best:
    """The k highest scores of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.full = np.zeros(queries, dtype=np.int64)

    def least(self, rows: np.ndarray) -> np.ndarray:
        worst = self.score[rows, self.k - 1].astype(np.float64)
        return np.where(self.full[rows] >= self.k, worst, -np.inf)

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(row)
        held = np.repeat(touched, self.full[touched])
        slots = np.concatenate([np.arange(n) for n in self.full[touched]]) if len(touched) else held
        row = np.concatenate([held, row])
        ids = np.concatenate([self.id[held, slots], ids])
        scores = np.concatenate([self.score[held, slots], scores])
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, dtype=np.int64)
        at = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        keep = at < self.k
        self.id[row[keep], at[keep]], self.score[row[keep], at[keep]] = ids[keep], scores[keep]
        self.full[touched] = np.bincount(row[keep], minlength=len(self.full))[touched]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in a row, and each list's length."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _by_length(ids: np.ndarray, column: pa.Array):
    """(length, positions, vectors) of the lists of each length."""
    flat, size = _lists(column)
    starts = np.cumsum(size) - size
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield int(n), at, flat[starts[at][:, None] + np.arange(n)[None, :]].astype(np.int64).reshape(len(at), n)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` highest inner products of each query: query_id, rank, vec_id and score.

    ``vectors`` and ``queries`` have an id and an array of longs. Queries go to the tasks
    in blocks of a bounded size, one pass over the vectors each; a task returns the best
    of its rows. A query is compared with the vectors of its own length whose id is
    another. Rows with a null id or vector take no part; a repeated vector row is a
    candidate each time, a repeated query row is one query. Ties go to the smaller id.
    Results are exact; sums of products have to fit in a long.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = asked.where("id IS NOT NULL AND v IS NOT NULL").distinct()
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    best = [_block(rows, dealt.where(F.col("block") == b).drop("block"), b, k) for b in range(blocks)]
    found = best[0]
    for more in best[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _block(rows: DataFrame, asked: DataFrame, number: int, k: int) -> DataFrame:
    table = asked.toArrow().combine_chunks()
    if table.num_rows:
        ids = table.column("id").to_numpy()
        column = table.column("v").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        groups = {n: (at, ids[at], v) for n, at, v in _by_length(ids, column)}
    else:
        groups = {}
    shared = rows.sparkSession.sparkContext.broadcast(groups)

    def work(batches):
        known = {n: (at, ids, Statistics(v), Best(len(ids), k)) for n, (at, ids, v) in shared.value.items()}
        for batch in batches:
            own = batch.column(0).to_numpy()
            for n, at, values in _by_length(own, batch.column(1)):
                if n not in known:
                    continue
                _, ids, q, best = known[n]
                for c0 in range(0, len(at), CANDIDATE_TILE):
                    cand_ids = own[at[c0 : c0 + CANDIDATE_TILE]]
                    cands = Statistics(values[c0 : c0 + CANDIDATE_TILE])
                    for q0 in range(0, len(ids), QUERY_TILE):
                        tile = np.arange(q0, min(q0 + QUERY_TILE, len(ids)))
                        a, b = survivors(q, tile, cands, best.least(tile))
                        other = ids[tile[a]] != cand_ids[b]
                        a, b = tile[a[other]], b[other]
                        best.add(a, cand_ids[b], _sums(q.vectors, a, cands.vectors, b))
        for at, ids, _, best in known.values():
            row, slot = np.nonzero(np.arange(k)[None, :] < best.full[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), number)), pa.array(at[row]), pa.array(ids[row]), pa.array(best.id[row, slot]),
                 pa.array(best.score[row, slot])],
                names=["block", "row", "query_id", "vec_id", "score"],
            )

    return rows.mapInArrow(work, "block long, row long, query_id long, vec_id long, score long")
