"""Exact deduplication by a 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import fold_ascii, small, without, written


def content_hash(text: Column) -> Column:
    """128 bits of content hash."""
    return F.unhex(F.md5(text.cast("binary")))


def _classes(rows: DataFrame, pick) -> DataFrame:
    """One row per distinct text: grouping on the text itself is the comparison of bytes."""
    return rows.groupBy("h", "norm").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def mark_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise=fold_ascii,
    hasher=content_hash,
) -> DataFrame:
    """One row per input row: id, h, keep_id, group_size, kept and text_sha256.

    Rows form a group when their normalised texts have the same bytes. Copies are
    combined before the shuffle, so a group of any size reaches a task as one row
    per task that read it. A row then finds its group by the hash alone where the
    comparison has shown that the hash stands for one text, and by hash and text
    where two texts collide.

    Null text counts as empty. A null id is never picked while the group has another
    one; a group of null ids keeps them. Rows that repeat id and text are all marked
    ``kept`` together; :func:`drop_duplicates` leaves one of them. Other columns are
    not read. An empty table gives an empty result.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    norm = docs.select(F.col(id_col).alias("id"), normalise(F.col(text_col)).alias("norm"))
    rows = norm.withColumn("h", hasher(F.col("norm")))
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    classes = written(_classes(rows, pick).select("h", "keep_id", "group_size", sha), "exact-classes")
    collided = classes.groupBy("h").count().where("count > 1").select("h")
    ids = rows.select("id", "h")
    if collided.isEmpty():
        marked = ids.join(classes, "h")
    else:
        collided = small(written(collided, "exact-collisions"), 64)
        texts = _classes(rows.join(collided, "h", "left_semi"), pick).withColumn("text_sha256", sha)
        marked = (
            ids.join(classes.join(collided, "h", "left_anti"), "h")
            .unionByName(rows.join(collided, "h", "left_semi").join(texts, ["h", "norm"]).drop("norm"))
        )
    return marked.select("id", "h", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=fold_ascii
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that repeat id and text, any one stays.
    """
    marks = written(
        mark_duplicates(docs, id_col, text_col, keep, normalise).select("id", "h", "kept", "group_size"), "exact-marks"
    )
    marks = marks.withColumnRenamed("h", "key")
    again = marks.where("kept AND group_size > 1").groupBy("id", "key").count().where("count > 1")
    return without(docs, id_col, content_hash(normalise(F.col(text_col))), marks.where("NOT kept"), again)
