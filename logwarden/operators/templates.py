"""Mask volatile tokens so that messages collapse to templates."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import DIGIT, MASK_BY_NAME, MASKS, Mask, collapse_spaces


# Placeholder to the steps that write it; several timestamp steps share one.
_STEPS_OF: dict[str, list[int]] = {}
for _i, _mask in enumerate(MASKS):
    _STEPS_OF.setdefault(_mask.label, []).append(_i)


def mask_once(text: Column, name: str) -> Column:
    """Apply a single masking step."""
    mask = MASK_BY_NAME[name]
    return F.regexp_replace(text, mask.pattern, mask.label)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    Each masking step uses its text several times. As plain columns those uses
    multiply whenever the optimizer moves an expression through the steps (a
    filter on the template would grow to 3^16 copies); a lambda variable keeps
    the expression linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _applies(mask: Mask, text: Column, digit: Column, then: Column, otherwise: Column) -> Column:
    if mask.needs is None:
        return then
    return F.when(mask.needs(text, digit), then).otherwise(otherwise)


def template(text: Column) -> Column:
    """The template of a message; an empty string for NULL."""

    def chain(digit: Column) -> Column:
        current = text
        for mask in MASKS:
            current = _bind(current, partial(_masked, mask, digit))
        return _bind(current, collapse_spaces)

    return F.coalesce(_bind(text.rlike(DIGIT), chain), F.lit(""))


def _masked(mask: Mask, digit: Column, text: Column) -> Column:
    return _applies(mask, text, digit, F.regexp_replace(text, mask.pattern, mask.label), text)


def add_template(df: DataFrame, column: str = "message", name: str = "normalized_message") -> DataFrame:
    """Template only: the cheap form, one regex pass per step that can apply."""
    return df.withColumn(name, template(F.col(column)))


def normalization(text: Column) -> Column:
    """Struct (normalized_message, token_counts, total_replacements, changed)."""

    def state(t: Column, digit: Column, counts: Column) -> Column:
        return F.struct(t.alias("text"), digit.alias("digit"), counts.alias("counts"))

    def step(mask: Mask, before: Column) -> Column:
        t, digit = before["text"], before["digit"]

        def replace(n: Column) -> Column:
            after = F.when(n > 0, F.regexp_replace(t, mask.pattern, mask.label)).otherwise(t)
            return state(after, digit, F.concat(before["counts"], F.array(n)))

        count = F.regexp_count(t, F.lit(mask.pattern))
        return _bind(_applies(mask, t, digit, count, F.lit(0)), replace)

    def result(last: Column) -> Column:
        hits = last["counts"]
        sums = [reduce(lambda a, b: a + b, [hits[i] for i in steps]) for steps in _STEPS_OF.values()]
        counts = F.map_from_arrays(F.array(*[F.lit(label) for label in _STEPS_OF]), F.array(*sums))
        return F.struct(
            last["text"].alias("normalized_message"),
            F.map_filter(counts, lambda label, n: n > 0).alias("token_counts"),
            F.aggregate(hits, F.lit(0), lambda acc, n: acc + n).alias("total_replacements"),
            (~last["text"].eqNullSafe(text)).alias("changed"),
        )

    current = state(text, text.rlike(DIGIT), F.array().cast("array<int>"))
    for mask in MASKS:
        current = _bind(current, partial(step, mask))
    clean = _bind(current, lambda s: state(collapse_spaces(s["text"]), s["digit"], s["counts"]))
    return _bind(clean, result)


def normalize(df: DataFrame, column: str = "message") -> DataFrame:
    """Add normalized_message, token_counts, total_replacements and changed."""
    names = ("normalized_message", "token_counts", "total_replacements", "changed")
    out = df.withColumn("_norm", normalization(F.col(column)))
    return out.withColumns({name: F.col("_norm")[name] for name in names}).drop("_norm")
