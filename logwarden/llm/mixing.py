"""Mix sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import private, small, word_count, written

#: Doubles are summed as this, so that sums do not depend on the order of rows.
EXACT = "decimal(30,6)"
#: Rows that one cell of equal documents deals copies to.
CELL_ROWS = 512


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: float) -> DataFrame:
    """Add ``no``, ``weight`` and ``target`` to one row per source (``source``, ``source_size``).

    Sources in code point order, null last, are numbered and take the weights in turn. Their targets
    share the total size by weight; none is above ``cap`` times its size, and what is
    cut is shared again by weight until none is above. One row per source is sorted.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("no", F.row_number().over(order).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(turn, ((F.col("no") - 1) % len(weights) + 1).cast("int")))
    # From the source that reaches its cap first: each is capped if the level that the
    # rest would share, with all earlier ones capped, is above it.
    limit = cap * F.col("source_size")
    by_level = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    ranked = ranked.withColumn("_at", F.row_number().over(by_level)).withColumn(
        "_level",
        (F.sum("source_size").over(all_rows) - F.sum(limit).over(by_level) + limit)
        / (F.sum("weight").over(all_rows) - F.sum("weight").over(by_level) + F.col("weight")),
    )
    free = F.when(limit > F.col("_level") * F.col("weight"), F.struct("_at", "_level"))
    level = F.min(free).over(all_rows)
    target = F.when(level.isNull() | (F.col("_at") < level["_at"]), limit).otherwise(level["_level"] * F.col("weight"))
    return ranked.select("no", "source", "source_size", "weight", target.alias("target"))


def _rate(tilt: Column, z: Column, cap: float) -> Column:
    """Copies expected of a document: exponentially tilted by its size, at most ``cap``."""
    return F.when(tilt * z >= F.log(F.lit(cap)), F.lit(cap)).otherwise(F.exp(tilt * z))


def tilts(cells: DataFrame, sources: DataFrame, cap: float, tolerance: float, max_steps: int) -> DataFrame:
    """The multiplier of each source's token constraint (``no``, ``mean``, ``tilt``).

    Minimising the relative entropy of the rates to one copy each, subject to the tokens
    of each source, has the dual sum(exp(tilt * z)) - tilt * target, z being the size over
    the source's mean size. Newton steps on it are aggregates over cells of equal
    documents. A step that leaves the bracket of the root is replaced by its middle.

    A step is one join on the source's number: what is known of the source goes through
    the aggregate, so the driver builds one small table a step.
    """
    state = written(
        sources.select(
            "no",
            (F.col("source_size") / F.greatest(F.col("docs"), F.lit(1))).alias("mean"),
            (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("full"),
            F.col("target"),
            F.log(F.greatest(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(1e-9))).alias("tilt"),
            F.lit(-1e9).alias("lo"),
            F.lit(1e9).alias("hi"),
            F.lit(False).alias("done"),
        ),
        "mix-state",
    )
    known = [c for c in state.columns if c != "no"]
    open_ = ~F.col("done") & ~F.col("full") & (F.col("mean") > 0)
    for _ in range(max_steps):
        z = F.col("size") / F.when(open_, F.col("mean"))
        rate = _rate(F.col("tilt"), z, cap)
        tokens = F.when(open_, F.col("n") * F.col("size") * rate)
        slope = F.when(open_, F.when(rate < cap, tokens * z).otherwise(0.0))
        sums = (
            cells.join(state, "no")
            .groupBy("no")
            .agg(
                *[F.first(c).alias(c) for c in known],
                *[F.sum(v.cast(EXACT)).cast("double").alias(c) for c, v in (("tokens", tokens), ("slope", slope))],
            )
        )
        error = F.col("tokens") - F.col("target")
        lo = F.when(error < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(error > 0, F.col("tilt")).otherwise(F.col("hi"))
        # A slope of zero is told apart before it divides.
        newton = F.col("tilt") - error / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        step = F.when(inside, newton).otherwise((lo + hi) / 2)
        done = F.col("tokens").isNull() | (F.abs(error) <= tolerance * F.col("target")) | F.col("done")
        state = written(
            sums.select(
                "no", "mean", "full", "target", F.when(done, F.col("tilt")).otherwise(step).alias("tilt"),
                F.when(done, F.col("lo")).otherwise(lo).alias("lo"), F.when(done, F.col("hi")).otherwise(hi).alias("hi"),
                done.alias("done"),
            ),
            "mix-state",
        )
        if state.where("NOT done").isEmpty():
            break
    return state.select("no", "mean", F.when(F.col("full"), F.lit(1e9)).otherwise(F.col("tilt")).alias("tilt"))


def _moved() -> Column:
    """Copies of a cell after the moves of its source."""
    mine = F.filter("moves", lambda x: (x["size"] == F.col("size")) & (x["salt"] == F.col("salt")))
    return F.col("copies") + F.aggregate(mine, F.lit(0).cast("long"), lambda total, x: total + x["move"])


def _settle(cells: DataFrame, sources: DataFrame, cap: int, rounds: int) -> DataFrame:
    """Move the copies of one cell per source and round until the tokens come near the target.

    The largest documents that fit in what is missing (or over) go first, so what is left
    falls below the size of the next. Cells stay as they are written: a round adds at most
    one move to the few that each source keeps, and they are applied at the end.
    """
    state = (
        cells.groupBy("no").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        .join(sources.select("no", "target"), "no")
        .withColumn("moves", F.array().cast("array<struct<size:long,salt:long,move:long>>"))
    )
    state = written(state, "mix-moves")
    for _ in range(rounds):
        now = cells.join(state.withColumn("gap", F.col("target") - F.col("taken")), "no").withColumn("copies", _moved())
        room = F.when(F.col("gap") > 0, F.col("m") * cap - F.col("copies")).otherwise(F.col("copies"))
        # A document moves where that leaves less than it finds: up to twice the gap.
        fits = (F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap")) & (room > 0)
        near = F.struct((-F.abs(F.col("size") - F.abs("gap"))).alias("near"), "size", "salt", room.alias("room"), "gap")
        one = now.groupBy("no").agg(*[F.first(c).alias(c) for c in ("target", "taken", "moves")], F.max(F.when(fits, near)).alias("x"))
        move = (
            F.signum("x.gap") * F.least(F.greatest(F.floor(F.abs("x.gap") / F.col("x.size")), F.lit(1)), F.col("x.room"))
        ).cast("long")
        one = one.withColumn("move", move)
        more = F.concat("moves", F.array(F.struct(F.col("x.size").alias("size"), F.col("x.salt").alias("salt"), "move")))
        state = written(
            one.select(
                "no", (F.col("taken") + F.coalesce(F.col("move") * F.col("x.size"), F.lit(0))).alias("taken"), "target",
                F.when(F.col("x").isNull(), F.col("moves")).otherwise(more).alias("moves"),
            ),
            "mix-moves",
        )
    cells = cells.join(state.select("no", "moves"), "no").withColumn("copies", _moved())
    return written(cells.drop("no", "moves"), "mix-cells")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tolerance: float = 1e-6,
    max_steps: int = 60,
    rounds: int = 8,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies and taken.

    Size is the number of words (null text: 0). Rates from the dual are rounded to whole
    copies, at most ``cap`` of a document: equal documents (source, size and a salt that
    keeps a cell small) share their copies by hash order of the id, and what rounding
    leaves is settled with single cells. The result depends on the rows alone, not on
    their order or partitioning; rows that repeat an id may differ in copies.

    Null sources form one source, ranked last. Documents without words keep one copy; a
    source without words has target 0. An empty table gives an empty result.
    """
    key = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("source "), F.col("source")))
    rows = written(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
        ).withColumn("key", key),
        "mix-rows",
    )
    counts = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    counts = written(counts, "mix-counts")
    sources = source_targets(counts.select("source", "source_size"), weights, float(cap)).withColumn("key", key)
    sources = written(sources.drop("weight").join(counts.select("key", "docs"), "key"), "mix-sources")

    cells = rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")).join(sources.select("key", "no"), "key")
    cells = written(cells, "mix-sizes")
    tilt = tilts(cells, sources, float(cap), tolerance, max_steps)
    rate = _rate(F.col("tilt"), F.col("size") / F.col("mean"), float(cap))
    rated = cells.join(tilt, "no").select(
        "key", "no", "size", F.ceil(F.col("n") / CELL_ROWS).alias("salts"),
        F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate).alias("rate"),
    )
    spread = F.xxhash64(F.col("id").cast("string"), F.lit("mix"))
    rows = rows.join(rated, ["key", "size"]).withColumn("salt", F.pmod(spread, F.col("salts")))
    rows = written(rows.select("id", "key", "no", "size", "salt", "rate"), "mix-salted")
    expected = F.col("m") * F.col("rate")
    # A hash of the cell decides which of its copies above the whole ones is drawn.
    draw = F.pmod(F.xxhash64("key", "size", "salt"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cells = rows.groupBy("key", "no", "size", "salt").agg(F.count(F.lit(1)).alias("m"), F.first("rate").alias("rate"))
    cells = cells.select("key", "no", "size", "salt", "m", F.least(F.floor(expected + draw), F.col("m") * cap).alias("copies"))
    cells = _settle(written(cells, "mix-cells"), sources, cap, rounds)

    turn = Window.partitionBy("key", "size", "salt").orderBy(spread, "id")
    dealt = rows.select("id", "key", "size", "salt", F.row_number().over(turn).alias("at")).join(
        cells, ["key", "size", "salt"]
    )
    each = F.floor(F.col("copies") / F.col("m")) + (F.col("at") <= F.col("copies") % F.col("m")).cast("long")
    out = dealt.withColumn("copies", each).join(
        sources.select("key", "source", "source_size", "target"), "key"
    )
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it has copies.

    Rows that repeat id, source and size each take the smallest number of copies of them.
    """
    text, source = options.get("text_col", "text"), options.get("source_col", "source")
    i, s, z, n = private("id"), private("source"), private("size"), private("copies")
    plan = mix(docs, id_col=id_col, **options)
    plan = plan.groupBy(F.col("id").alias(i), F.col("source").alias(s), F.col("size").alias(z)).agg(
        F.min("copies").cast("int").alias(n)
    )
    plan = small(written(plan.where(F.col(n) > 0), "mix-plan"), 80)
    same = docs[id_col].eqNullSafe(plan[i]) & docs[source].cast("string").eqNullSafe(plan[s])
    joined = docs.join(plan, same & (word_count(docs[text]) == plan[z]))
    copies = joined.withColumn(i, F.explode(F.array_repeat(F.lit(1), F.col(n))))
    return copies.select(*[f"`{c}`" for c in docs.columns])
