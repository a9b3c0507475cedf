"""Rolling refits on a stream: a bounded sample as state, versions handed from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logwarden.operators import rolling, service_forests
from logwarden.operators.ordering import row_index
from logwarden.streaming.files import batch_done, make_folder, write_once
from logwarden.streaming.stages import start_batches

SAMPLE = "row_index BIGINT, stream_id BIGINT, vector ARRAY<FLOAT>"
NODES = service_forests.NODES.format(group="version")


def start_rolling(
    vectors: DataFrame, base: str, every: int = rolling.EVERY, newest: int = rolling.NEWEST, available_now: bool = False
) -> StreamingQuery:
    """(stream_id, version, anomaly_score) of a stream of vectors to ``scores``, as ``rolling.rolling_scores`` has them.

    Ids grow from batch to batch. A batch reads the newest rows and the newest model that
    the batch before it left in ``sample`` and ``model``, fits the versions that its rows complete,
    and leaves the same behind: both are bounded, and no older folder is read. A replayed
    batch finds its own outputs and those of the batch before it unchanged.
    """
    spark = vectors.sparkSession
    if min(every, newest) < service_forests.MIN_ROWS:
        raise ValueError(f"a version needs at least {service_forests.MIN_ROWS} rows")

    def left(name: str, schema: str, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{base}/{name}/batch_id={batch_id}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch_done(spark, f"{base}/scores", batch_id):
            return
        before, model = left("sample", SAMPLE, batch_id - 1), left("model", NODES, batch_id - 1)
        seen = before.agg(F.coalesce(F.max("row_index") + 1, F.lit(0))).first()[0]
        own = row_index(batch.select("stream_id", F.col("vector").cast("array<float>").alias("vector")), "stream_id")
        own = own.select((F.col("row_index") + seen).alias("row_index"), "stream_id", "vector")
        write_once(own, f"{base}/rows", batch_id)
        own = left("rows", SAMPLE, batch_id)
        count = seen + own.count()
        known = before.unionByName(own)
        first, last = seen // every + 1, count // every
        fitted = rolling.fit_versions(known, first, last, every, newest) if first <= last else left("", NODES, -1)
        write_once(fitted, f"{base}/fitted", batch_id)
        fitted = left("fitted", NODES, batch_id)
        scores = rolling.score_versions(own, model.unionByName(fitted), every)
        write_once(known.filter(F.col("row_index") >= count - newest), f"{base}/sample", batch_id)
        current = fitted.filter(F.col("version") == str(last)) if first <= last else model
        write_once(current, f"{base}/model", batch_id)
        write_once(scores, f"{base}/scores", batch_id)

    make_folder(spark, f"{base}/scores")
    return start_batches(vectors, f"{base}/_checkpoints/rolling", handle, available_now)
