"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections import deque

from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: space and the controls from tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
#: A side is sent to every executor only when its rows, counted, take less than this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it again.

    The lineage ends there: a lost executor costs nothing that was computed before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The last values that operators have sent to the executors. What is held here stays in the driver's memory; a value
#: that is not goes from there with the last plan that uses it.
_SHARED: deque[Broadcast] = deque(maxlen=4)


def share(spark: SparkSession, value) -> Broadcast:
    """Send a value of bounded size to the executors; see :func:`release`."""
    sent = spark.sparkContext.broadcast(value)
    _SHARED.append(sent)
    return sent


def release() -> None:
    """Drop the executors' copies of all shared values, once what was computed with them is written.

    The driver keeps them for as long as a plan uses them: one that is run again sends them again.
    """
    while _SHARED:
        _SHARED.pop().unpersist()


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty string."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def private(name: str) -> str:
    """A column name that no input column has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few enough, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def without(docs: DataFrame, id_col: str, key: Column, gone: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of ``docs`` without those of ``gone``, and one each of those that ``again`` names.

    Both have ``id`` and ``key``; a row of ``docs`` has the key that the expression gives.
    Few of them are sent to the rows, more are joined by a shuffle.
    """
    i, k = private("id"), private("key")
    left = docs.withColumn(k, key)

    def same(names: DataFrame):
        names = small(names.select(F.col("id").alias(i), F.col("key").alias(f"{k}_")).distinct(), 80)
        return names, left[id_col].eqNullSafe(names[i]) & (left[k] == names[f"{k}_"])

    left = left.join(*same(gone), "left_anti")
    if not again.isEmpty():
        names, on = same(again)
        left = left.join(names, on, "left_anti").unionByName(left.join(names, on, "left_semi").dropDuplicates([id_col, k]))
    return left.select(*[f"`{c}`" for c in docs.columns])
