"""Risk tiers from a prioritised rule table with wildcards and ranges of confidence.

Rules are resolved once into ranges that don't overlap, per action and criticality or
wildcard of either. A row then meets at most four short lists of ranges by equality and
takes the match of the highest priority: no row is multiplied and nothing is compared
with every rule.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RULES = "priority INT, action STRING, criticality STRING, above DOUBLE, up_to DOUBLE, tier STRING"
# The documented mapping. NULL means any; lower numbers go first.
DEFAULT_RULES = (
    (1, "restart_service", "low", 0.85, None, "LOW"),
    (2, "scale_up", None, 0.80, None, "LOW"),
    (3, "restart_service", "high", None, None, "MEDIUM"),
    (4, "drain_connections", None, 0.75, None, "MEDIUM"),
    (5, "failover_database", None, None, None, "HIGH"),
    (6, "rollback_deployment", "production", None, None, "HIGH"),
)
#: Lists of ranges are sent to every executor up to this size, counted; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
RANGE_BYTES = 64


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, RULES)


def resolve(rules: DataFrame) -> DataFrame:
    """(action, criticality, any_rule, ranges): per pair its ranges that don't overlap, each with its first rule.

    A rule holds for ``above < confidence <= up_to``; a NULL bound is open. ``any_rule`` is the
    first rule without bounds, which also holds where the confidence is unknown. Of rules with
    one priority the tier that sorts first counts. Empty ranges hold nowhere.
    """
    low, high = F.coalesce("above", F.lit(float("-inf"))), F.coalesce("up_to", F.lit(float("inf")))
    by_rule = rules.select("action", "criticality", "priority", "tier", low.alias("low"), high.alias("high")).filter("low < high")
    key = ["action", "criticality"]
    points = by_rule.select(F.col("action").alias("_a"), F.col("criticality").alias("_c"), F.explode(F.array("low", "high")).alias("_from")).distinct()
    ends = points.withColumn("_to", F.lead("_from").over(W.partitionBy("_a", "_c").orderBy("_from"))).filter("_to IS NOT NULL")
    covers = F.expr("action <=> _a AND criticality <=> _c AND low <= _from AND _to <= high")
    first = ends.join(by_rule, covers).groupBy(*key, "_from", "_to").agg(F.min(F.struct("priority", "tier")).alias("rule"))
    piece = F.struct(F.col("_from").alias("low"), F.col("_to").alias("high"), "rule")
    listed = first.groupBy(*key).agg(F.sort_array(F.collect_list(piece)).alias("ranges"))
    unbounded = rules.filter("above IS NULL AND up_to IS NULL").groupBy(
        F.col("action").alias("_a"), F.col("criticality").alias("_c")
    ).agg(F.min(F.struct("priority", "tier")).alias("any_rule"))
    return listed.join(unbounded, F.expr("action <=> _a AND criticality <=> _c"), "left").select(*key, "any_rule", "ranges")


def assign(rows: DataFrame, rules: DataFrame, action: str = "action", criticality: str = "criticality", confidence: str = "confidence") -> DataFrame:
    """Add ``risk_tier`` and ``risk_rule`` (its priority) of the first rule that holds; NULL where none does.

    A NULL action or criticality meets only rules for any. A NULL or NaN confidence meets only
    rules without bounds.
    """
    lists = resolve(rules)
    ranges = lists.agg(F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()[0]
    value = F.col(confidence).cast("double")
    found: list[Column] = []
    out = rows
    for k, (own_action, own_criticality) in enumerate(product((True, False), repeat=2)):
        mine = F.lit(True)
        for column, own in (("action", own_action), ("criticality", own_criticality)):
            mine = mine & (F.col(column).isNotNull() if own else F.col(column).isNull())
        side = lists.filter(mine).select(
            F.col("action").alias(f"_a{k}"), F.col("criticality").alias(f"_c{k}"), F.col("any_rule").alias(f"_any{k}"), F.col("ranges").alias(f"_r{k}")
        )
        side = F.broadcast(side) if ranges * RANGE_BYTES <= BROADCAST_BYTES else side
        on = [F.col(c) == F.col(f"_{c2}{k}") for c, own, c2 in ((action, own_action, "a"), (criticality, own_criticality, "c")) if own]
        out = out.join(side, on or F.lit(True), "left")
        holds = F.get(F.filter(F.col(f"_r{k}"), lambda r: (r["low"] < value) & (value <= r["high"])), 0)["rule"]
        found.append(F.when(value.isNull() | F.isnan(value), F.col(f"_any{k}")).otherwise(holds))
    # The lowest number wins; fields that are NULL are passed over.
    rule = F.array_min(F.filter(F.array(*found), lambda r: r.isNotNull()))
    return out.withColumn("_rule", rule).select(*rows.columns, F.col("_rule")["tier"].alias("risk_tier"), F.col("_rule")["priority"].alias("risk_rule"))
