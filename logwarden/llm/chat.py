"""Chat formatting: collapse logged snapshots of growing conversations, then render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import written
from logwarden.operators.ordering import numbered

#: Turns of one conversation that are ordered, and rendered, together.
PART_TURNS = 256
#: Marks of the chat template; fixed values.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

_HASHES = ("a", "b")


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns under own names. Null text and role count as empty, a null turn as -1."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turn = F.coalesce(F.col(turn_col).cast("long"), F.lit(-1).cast("long"))
    out = turns.select(F.col(conv_col).alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    return out.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("key"),
        "*",
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit("second"), "text", "role").alias("h2"),
    )


def _halves(value: Column) -> list[Column]:
    """A 64-bit value as two sums that can't overflow."""
    return [value.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(value, 32)]


def _digest(sums: str) -> Column:
    """128 bits of the sums of the positioned hashes so far."""
    return F.struct(*[F.xxhash64(*[F.col(f"{sums}{x}{k}") for k in (0, 1)]).alias(x) for x in _HASHES])


def positioned(turns: DataFrame) -> DataFrame:
    """The distinct turns (key, turn, h1, h2) with their position ``pos`` in the conversation and its ``part``.

    All turns are numbered in one order over conversations, by ranges, so neither a long
    conversation nor many turns with one number or none meet in one task.
    """
    rows = turns.groupBy("key", "turn", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    rows = written(numbered(rows, "key", "turn", "h1", "h2", name="at"), "chat-numbered")
    starts = rows.groupBy("key").agg(F.min("at").alias("start"))
    rows = rows.join(starts, "key").withColumn("pos", F.col("at") - F.col("start") + 1).drop("at", "start")
    return written(rows.withColumn("part", F.floor((F.col("pos") - 1) / PART_TURNS)), "chat-turns")


def prefixes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashes of all turn prefixes, and of whole conversations.

    The hash of a prefix is the sum of the hashes of its positioned turns, so it rolls
    along a conversation: within a part by a window, between parts by the sums of the
    parts. A conversation of any length is dealt out by its parts.
    """
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = {"a": F.xxhash64("pos", "h1", "h2"), "b": F.xxhash64("h2", "h1", "pos")}
    values = {f"{x}{k}": v for x in _HASHES for k, v in enumerate(_halves(placed[x]))}
    rows = rows.select("key", "conv_id", "part", "pos", *[v.alias(n) for n, v in values.items()])
    ends = rows.groupBy("key", "part").agg(
        F.min("conv_id").alias("conv_id"), F.max("pos").alias("pos"), *[F.sum(n).alias(n) for n in values]
    )
    base = ends.select("key", "part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"base_{n}") for n in values])
    rolling = Window.partitionBy("key", "part").orderBy("pos")
    running = rows.select("key", "part", "pos", *[F.sum(n).over(rolling).alias(f"in_{n}") for n in values])
    running = running.join(base, ["key", "part"]).select(
        "key", "pos", *[(F.col(f"in_{n}") + F.col(f"base_{n}")).alias(f"to_{n}") for n in values]
    )
    whole = ends.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("pos").alias("n"), *[F.sum(n).alias(f"all_{n}") for n in values]
    )
    running = running.select("key", "pos", _digest("to_").alias("hash")).select("key", "pos", "hash.a", "hash.b")
    whole = whole.select("key", "conv_id", "n", _digest("all_").alias("hash")).select("key", "conv_id", "n", "hash.a", "hash.b")
    return running, whole


def maximal(rows: DataFrame) -> DataFrame:
    """The conversations that are neither a prefix of a longer one nor a copy of an earlier one.

    ``key``, ``conv_id``, ``n`` (turns) and ``copies`` (conversations equal to it).
    """
    running, whole = prefixes(rows)
    first = F.min(F.struct(F.col("conv_id").isNull().alias("last"), "conv_id", "key")).alias("first")
    kept = whole.groupBy("n", "a", "b").agg(first, F.count(F.lit(1)).alias("copies"))
    # A prefix short of its conversation's end belongs to a longer conversation.
    inner = running.join(whole.select("key", "n"), "key").where("pos < n").select(F.col("pos").alias("n"), "a", "b").distinct()
    return kept.join(inner, ["n", "a", "b"], "left_anti").select("first.key", "first.conv_id", "n", "copies")


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, turns, copies and text.

    Turns are taken in order of turn and, where that ties, of a hash of the row; a row
    that repeats another is the same turn. A long conversation gives one row for each
    ``PART_TURNS`` of its turns, in order of ``part``, so no row grows with it.
    Rows with a null id form one conversation. Other columns are not read, and an empty
    table gives an empty result.
    """
    rows = _turns(turns, conv_col, turn_col, role_col, text_col)
    places = positioned(rows)
    kept = written(maximal(places), "chat-kept")
    places = places.drop("conv_id").join(kept, "key")
    said = F.struct("pos", "role", "text")
    parts = (
        rows.drop("conv_id").join(places, ["key", "turn", "h1", "h2"]).groupBy("key", "part")
        .agg(F.first("conv_id").alias("conv_id"), F.first("n").alias("turns"), F.first("copies").alias("copies"),
             F.array_sort(F.collect_set(said)).alias("said"))
    )
    show = F.transform("said", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n")))
    return parts.select("conv_id", "part", "turns", "copies", F.array_join(show, "").alias("text"))
