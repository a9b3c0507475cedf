"""From raw forest output to a score in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: steepness of the score curve.
SIGMOID_SCALE = 6.0


def anomaly_score(raw: Column) -> Column:
    """sigmoid(-6 * raw), clipped; an unscored row (no model) counts as 0.0."""
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(raw * F.lit(SIGMOID_SCALE)))
    return F.coalesce(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def check_threshold(threshold: float) -> float:
    if not 0.0 < threshold <= 1.0:
        raise ValueError(f"threshold must be in (0, 1], got {threshold}")
    return threshold


def is_anomaly(score: Column, threshold: float) -> Column:
    """Strictly above the threshold."""
    return score > F.lit(check_threshold(threshold))
