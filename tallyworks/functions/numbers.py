"""Exact money, rounding and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(column: Column | str, kind: str = "decimal(18,2)") -> Column:
    """An amount as exact decimal: sums then don't depend on the order of the rows."""
    return (F.col(column) if isinstance(column, str) else column).cast(kind)


def rounded(value: Column, digits: int = 1) -> Column:
    """A double rounded half away from zero, as decimal."""
    return F.round(value.cast("decimal(38,10)"), digits).cast(f"decimal(18,{digits})")


def percent_change(now: Column, before: Column, digits: int = 1) -> Column:
    """100 * (now - before) / before; NULL where before is NULL or 0."""
    return rounded(F.lit(100.0) * (now - before).cast("double") / F.nullif(before.cast("double"), F.lit(0.0)), digits)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, half to even; NULL where whole is NULL or 0."""
    return F.bround(part.cast("decimal(24,4)") / F.nullif(whole.cast("decimal(24,4)"), F.lit(0).cast("decimal(24,4)")), digits)


def level_rank(level: Column, order: tuple[str, ...]) -> Column:
    """The place of a level in order, from 1 for the mildest; NULL for others."""
    out = F.when(level == order[0], 1)
    for place, name in enumerate(order[1:], 2):
        out = out.when(level == name, place)
    return out


def rank_level(rank: Column, order: tuple[str, ...]) -> Column:
    """The level at a place of order."""
    return F.try_element_at(F.array(*map(F.lit, order)), rank.cast("int"))


def risk_band(score: Column, has_high_finding: Column) -> Column:
    """The level of a score from 0 to 100; a high finding calls for an investigation whatever the score is."""
    return F.when(has_high_finding | (score >= 75), "REQUIRES_INVESTIGATION").when(score >= 55, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; NULL if either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest_rank(values: Column, percent: float) -> Column:
    """The value at the rank nearest to a percentile of an array, the rank being rounded half to even; NULL for an empty array."""
    ordered = F.array_sort(values)
    place = F.bround(F.lit(percent / 100) * (F.size(values) - 1)).cast("int")
    return F.when(F.size(values) > 0, F.element_at(ordered, F.greatest(place, F.lit(0)) + 1))
