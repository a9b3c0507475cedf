"""Isolation forests per service: many baselines fitted and applied in one job each.

A service is described by a capped sample of its rows, drawn by a hash of the row's id, so
that a hot service costs no more than any other and no result depends on partitioning.
Models stay a table; rows meet the nodes of their own service in blocks of bounded size.
Services with too few rows share one forest over all services.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from logwarden.functions.vectors import has_dim
from logwarden.operators import forest
from logwarden.operators.forest import MIN_ROWS, SEED, SUBSAMPLE, TREES
from logwarden.sources.tables import materialised

#: Rows of a service from which its trees draw.
POOL = 2048
#: Groups of trees of a service that are grown in separate tasks.
SLICES = 4
#: Rows of a service that meet a copy of its nodes in one group.
BLOCK_ROWS = 20_000
NODES = "{group} STRING, rows BIGINT, taken INT, dim INT, " + forest.NODE_SCHEMA


def draw(rows: DataFrame, key: str = "stream_id", group: str = "service_name", cap: int = POOL, seed: int = SEED) -> DataFrame:
    """(group, key, rows): up to ``cap`` keys of each group, uniformly, and how many rows the group has.

    Works on the two columns alone. A cut-off on the hash by the group's size leaves about
    twice the cap, of which the smallest hashes are taken; null groups count as one.
    """
    ids = rows.select(F.coalesce(F.col(group), F.lit("")).alias(group), key)
    sizes = ids.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    unit = forest.hash_unit(F.col(key), F.lit(seed))
    near = ids.join(sizes, group).filter(unit * F.col("rows") < 2.0 * cap)
    nth = W.partitionBy(group).orderBy(unit, key)
    return near.withColumn("_n", F.row_number().over(nth)).filter(F.col("_n") <= cap).drop("_n")


def fit(
    vectors: DataFrame, key: str = "stream_id", group: str = "service_name", trees: int = TREES, subsample: int = SUBSAMPLE,
    min_rows: int = MIN_ROWS, cap: int = POOL, seed: int = SEED,
) -> DataFrame:
    """Node table of one forest per group with at least ``min_rows`` rows: group, rows and the node columns.

    Every tree grows on ``subsample`` rows of its group's pool. ``vectors`` has the key (unique in
    its group), the group and ``vector``; vectors whose size is not that of most rows are left out.
    """
    dim = vectors.select(F.size("vector").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    usable = vectors.filter(has_dim(F.col("vector"), dim["d"])) if dim else vectors
    drawn = materialised(draw(usable, key, group, cap, seed).filter(F.col("rows") >= min_rows), "drawn")
    name = F.coalesce(F.col(group), F.lit("")).alias(group)
    rows = usable.select(name, key, F.col("vector").cast("array<float>").alias("vector")).join(drawn, [group, key])
    parts = rows.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(key)
        x = np.stack(batch["vector"].to_list()).astype(np.float64)
        taken = min(subsample, len(x))
        limit = max(1, math.ceil(math.log2(max(2, taken))))
        label, size, part = batch[group].iloc[0], int(batch["rows"].iloc[0]), int(batch["_slice"].iloc[0])
        out = []
        for tree in range(part, trees, SLICES):
            chosen = np.random.default_rng([seed, tree, 1]).choice(len(x), taken, replace=False)
            out.append(forest.grow(x[chosen], tree, seed, limit))
        return pd.concat(out).assign(**{group: label, "rows": size, "taken": taken, "dim": x.shape[1]})

    return parts.groupBy(group, "_slice").applyInPandas(build, NODES.format(group=group))


def fit_global(vectors: DataFrame, key: str = "stream_id", **options) -> forest.ForestModel | None:
    """One forest over all services, for those without their own; None below ten rows."""
    try:
        return forest.fit(vectors.filter(F.col("vector").isNotNull()), key, **options)
    except ValueError:
        return None


def score(
    rows: DataFrame, nodes: DataFrame, shared: forest.ForestModel | None, group: str = "service_name", key: str = "stream_id",
    trees: int = TREES,
) -> DataFrame:
    """(key, group, model, raw_score) of every row: ``own``, ``shared``, or ``none`` with a NULL score.

    Rows of a group are dealt to blocks by a hash of the key, and each block meets a copy of the
    group's nodes: a hot group is as many tasks as it has blocks, and no group is larger
    than about ``BLOCK_ROWS`` rows. A NULL vector or one of another size has no score.
    """
    name = F.coalesce(F.col(group), F.lit(""))
    sizes = rows.groupBy(name.alias(group)).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("_blocks"))
    sized = rows.select(key, name.alias(group), F.col("vector").cast("array<float>").alias("vector")).join(sizes, group)
    dealt = sized.withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks"))).drop("_blocks")
    packed = nodes.groupBy(group).agg(
        F.first("taken").alias("taken"), F.first("dim").alias("dim"),
        F.collect_list(F.struct("tree", "node", "feature", "threshold", "left", "right", "path")).alias("nodes"),
    )
    models = packed.join(sizes, group).withColumn("_block", F.explode(F.expr("sequence(0, _blocks - 1)"))).drop("_blocks")
    spark = rows.sparkSession
    common = spark.sparkContext.broadcast(None if shared is None else (shared.arrays(), shared.subsample, shared.offset, shared.dim))
    kind = dict(rows.dtypes)[key]
    shape = pa.schema([(key, to_arrow_type(rows.schema[key].dataType)), (group, pa.string()), ("model", pa.string()), ("raw_score", pa.float64())])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], f.type) for f in shape], schema=shape)
        arrays, size, offset, dim, used = None, 0, 0.0, 0, "none"
        if right.num_rows:
            table = pa.Table.from_struct_array(right.column("nodes").combine_chunks().flatten()).to_pandas()
            arrays, offset, used = forest.node_arrays(table, trees), forest.AUTO_OFFSET, "own"
            size, dim = right.column("taken")[0].as_py(), right.column("dim")[0].as_py()
        elif common.value is not None:
            (arrays, size, offset, dim), used = common.value, "shared"
        vectors = left.column("vector").to_pylist()
        good = [k for k, v in enumerate(vectors) if arrays is not None and v and len(v) == dim and None not in v]
        out = np.full(len(vectors), np.nan)
        if good:
            out[good] = forest.raw_scores(arrays, np.array([vectors[k] for k in good], dtype=np.float64), size, offset)
        scores = pa.array([None if np.isnan(s) else s for s in out.tolist()], pa.float64())
        return pa.table([left.column(key).cast(shape.field(key).type), left.column(group), pa.array([used] * len(vectors)), scores], schema=shape)

    both = dealt.groupBy(group, "_block").cogroup(models.groupBy(group, "_block"))
    return both.applyInArrow(work, f"{key} {kind}, {group} string, model string, raw_score double")
