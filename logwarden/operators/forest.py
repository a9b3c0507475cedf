"""Isolation forest (Liu, Ting, Zhou 2008): distributed sampling, fitting, scoring."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logwarden.functions.vectors import has_dim

# Forest parameters.
TREES = 100
SUBSAMPLE = 256
SEED = 42
MIN_ROWS = 10
AUTO_OFFSET = -0.5

NODE_SCHEMA = (
    "tree INT, node INT, feature INT, threshold DOUBLE, left INT, right INT, path DOUBLE"
)
_HASH_SPAN = 1 << 62


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def node_arrays(nodes: pd.DataFrame, trees: int) -> tuple:
    """feature, threshold, left, right and path of a node table, each as an array [tree, node]."""
    shape = (trees, int(nodes["node"].max()) + 1)
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    out = []
    for name, kind in (("feature", np.int32), ("threshold", np.float64), ("left", np.int32), ("right", np.int32), ("path", np.float64)):
        cells = np.full(shape, -1 if name == "feature" else 0, dtype=kind)
        cells[at] = nodes[name].to_numpy()
        out.append(cells)
    return tuple(out)


@dataclass
class ForestModel:
    """Node table of a fitted forest; at most trees * (2 * subsample - 1) rows."""

    nodes: pd.DataFrame
    dim: int
    rows: int
    subsample: int
    trees: int = TREES
    seed: int = SEED
    contamination: str = "auto"
    offset: float = AUTO_OFFSET
    #: Smallest id that is scored; those before it only train.
    first_id: int | None = None
    _arrays: tuple | None = field(default=None, repr=False)

    def arrays(self) -> tuple:
        if self._arrays is None:
            self._arrays = node_arrays(self.nodes, self.trees)
        return self._arrays

    def diagnostics(self, spark: SparkSession) -> DataFrame:
        return diagnostics(spark, self)


def hash_unit(*parts: Column) -> Column:
    """Deterministic number in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(*parts), F.lit(_HASH_SPAN)) / F.lit(float(_HASH_SPAN))


def _subsamples(vectors: DataFrame, key: str, rows: int, trees: int, subsample: int, seed: int) -> DataFrame:
    """(tree, draw, vector): a uniform subsample without replacement for each tree.

    Every choice is a hash of the row's key and the tree, at any size of the table, so
    each row can be drawn for each tree and partitioning does not matter. A cut-off on
    the hash lets about twice the subsample of a tree leave the tasks.
    """
    cut = min(1.0, 2.0 * subsample / rows)
    chosen = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: hash_unit(F.col(key), t, F.lit(seed + 1)) < cut,
    )
    drawn = vectors.select(key, "vector", F.explode(chosen).alias("tree")).withColumn(
        "draw", F.xxhash64(key, "tree", F.lit(seed + 1))
    )
    nth = W.partitionBy("tree").orderBy("draw", key)
    return drawn.withColumn("_n", F.row_number().over(nth)).filter(F.col("_n") <= subsample)


#: Nodes of narrow rows that are smaller than this are split as lists, which costs less than calls on tiny arrays.
LIST_ROWS = 24
LIST_DIM = 8


def grow(x: np.ndarray, tree: int, seed: int, limit: int) -> pd.DataFrame:
    """One isolation tree over the rows of x, as a node table."""
    rng = np.random.default_rng([seed, tree])
    lists = LIST_ROWS if x.shape[1] <= LIST_DIM and not np.isnan(x).any() else 0
    feature, threshold, path = [], [], []
    sides: tuple[list, list] = ([], [])
    waiting = [(x, 0, -1, 0)]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        node, size = len(feature), len(rows)
        if parent >= 0:
            sides[side][parent] = node
        sides[0].append(0)
        sides[1].append(0)
        if depth < limit and size > 1:
            if size < lists and not isinstance(rows, list):
                rows = rows.tolist()
            if isinstance(rows, list):
                columns = list(zip(*rows))
                low, high = [min(c) for c in columns], [max(c) for c in columns]
                varying = [f for f, v in enumerate(low) if high[f] > v]
            else:
                low, high = np.minimum.reduce(rows), np.maximum.reduce(rows)
                varying = np.flatnonzero(high > low)
            if len(varying):
                f = int(varying[rng.integers(0, len(varying))])
                least, most = float(low[f]), float(high[f])
                cut = rng.uniform(least, most)
                if cut >= most:
                    cut = least
                if isinstance(rows, list):
                    above, upto = [r for r in rows if not r[f] <= cut], [r for r in rows if r[f] <= cut]
                else:
                    goes_left = rows[:, f] <= cut
                    above, upto = rows[~goes_left], rows[goes_left]
                feature.append(f)
                threshold.append(cut)
                path.append(0.0)
                waiting.append((above, depth + 1, node, 1))
                waiting.append((upto, depth + 1, node, 0))
                continue
        feature.append(-1)
        threshold.append(0.0)
        path.append(depth + average_path(size))
    return pd.DataFrame(
        {"tree": tree, "node": range(len(feature)), "feature": feature, "threshold": threshold, "left": sides[0], "right": sides[1], "path": path}
    )


def fit(
    vectors: DataFrame,
    key: str = "stream_id",
    vector: str = "vector",
    trees: int = TREES,
    subsample: int = SUBSAMPLE,
    seed: int = SEED,
    contamination: float | str = "auto",
) -> ForestModel:
    """Fit on all rows; each tree is built in its own task from its subsample.

    Raises ``ValueError`` for fewer than ten rows or rows of unequal length.
    """
    data = vectors.select(F.col(key), F.col(vector).cast("array<float>").alias("vector"))
    facts = data.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.size("vector")).alias("low"),
        F.max(F.size("vector")).alias("high"),
    ).first()
    rows, dim = facts["rows"], facts["high"]
    if rows < MIN_ROWS:
        raise ValueError(f"need at least {MIN_ROWS} rows to train, got {rows}")
    if facts["low"] != dim or dim < 1:
        raise ValueError("training vectors must all have the same dimension")
    taken = min(subsample, rows)
    limit = max(1, math.ceil(math.log2(taken)))
    drawn = _subsamples(data, key, rows, trees, taken, seed)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", key])
        x = np.stack(group["vector"].to_list()).astype(np.float64)
        return grow(x, int(group["tree"].iloc[0]), seed, limit)

    nodes = drawn.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
    model = ForestModel(nodes, dim, rows, taken, trees, seed, str(contamination))
    if contamination != "auto":
        from logwarden.operators.quantiles import exact_percentiles

        scores = score(data, model).select((F.col("raw_score") + F.lit(AUTO_OFFSET)).alias("v"))
        row = exact_percentiles(scores, "v", {"q": float(contamination)}).first()
        model.offset = row["q"]
    return model


def raw_scores(arrays: tuple, x: np.ndarray, subsample: int, offset: float = AUTO_OFFSET) -> np.ndarray:
    """Raw scores of the rows of ``x`` by the trees of a forest (positive is normal, negative anomalous)."""
    feature, threshold, left, right, path = arrays
    depth = max(1, math.ceil(math.log2(max(2, subsample))))
    scale = average_path(subsample)
    # Nodes of all trees in one row of cells: a leaf leads to itself, by whatever value.
    first = np.arange(feature.shape[0])[:, None] * feature.shape[1]
    own = first + np.arange(feature.shape[1])
    leaf = feature < 0
    left, right = (np.where(leaf, own, first + side).ravel() for side in (left, right))
    feature, threshold, path = np.maximum(feature, 0).ravel(), threshold.ravel(), path.ravel()
    out = np.empty(len(x))
    for start in range(0, len(x), 1024):
        part = x[start : start + 1024]
        base = np.arange(len(part))[:, None] * part.shape[1]
        part = part.ravel()
        at = np.repeat(first.T, len(base), axis=0)
        for _ in range(depth):
            value = part.take(base + feature.take(at))
            at = np.where(value <= threshold.take(at), left.take(at), right.take(at))
        depths = path.take(at).mean(axis=1)
        out[start : start + 1024] = -np.power(2.0, -depths / scale) - offset
    return out


def score(df: DataFrame, model: ForestModel | None, vector: str = "vector", name: str = "raw_score") -> DataFrame:
    """Add the raw score (positive is normal, negative anomalous); NULL without a model."""
    if model is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    shared = df.sparkSession.sparkContext.broadcast(model.arrays())
    dim, offset, subsample = model.dim, model.offset, model.subsample

    @F.arrow_udf("double")
    def raw(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return pa.array(raw_scores(shared.value, x, subsample, offset))

    # Marked so that a filter on the score is not moved below and run a second time.
    raw = raw.asNondeterministic()
    usable = has_dim(F.col(vector), dim)
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    safe = F.when(usable, F.col(vector).cast("array<float>")).otherwise(zero)
    return df.withColumn(name, F.when(usable, raw(safe)))


def diagnostics(spark: SparkSession, model: ForestModel | None) -> DataFrame:
    """One row describing the model, or the untrained state."""
    schema = (
        "is_trained BOOLEAN, train_sample_count BIGINT, train_dim INT, n_estimators INT, "
        "contamination STRING, random_state INT"
    )
    row = (
        (False, 0, 0, TREES, "auto", SEED)
        if model is None
        else (True, model.rows, model.dim, model.trees, model.contamination, model.seed)
    )
    return spark.createDataFrame([row], schema)


META_SCHEMA = (
    "version BIGINT, dim INT, rows BIGINT, subsample INT, trees INT, seed INT, "
    "contamination STRING, offset DOUBLE, first_id BIGINT"
)


def save(spark: SparkSession, model: ForestModel, path: str, version: int) -> None:
    """Write the nodes of a version, then publish it by adding its description.

    Readers see the old version until the description is committed.
    """
    spark.createDataFrame(model.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/nodes/version={version}"
    )
    meta = (
        version, model.dim, model.rows, model.subsample, model.trees, model.seed,
        model.contamination, model.offset, model.first_id,
    )
    spark.createDataFrame([meta], META_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/meta/version_{version}"
    )


def load(spark: SparkSession, path: str) -> ForestModel | None:
    """The newest published version, or None."""
    try:
        meta = (
            spark.read.schema(META_SCHEMA)
            .option("recursiveFileLookup", "true")
            .parquet(f"{path}/meta")
            .orderBy(F.desc("version"))
            .first()
        )
    except AnalysisException as error:  # no model has been written yet
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if meta is None:
        return None
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes/version={meta['version']}").toPandas()
    return ForestModel(
        nodes, meta["dim"], meta["rows"], meta["subsample"], meta["trees"], meta["seed"],
        meta["contamination"], meta["offset"], meta["first_id"],
    )
