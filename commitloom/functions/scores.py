"""Column functions for sizes, scores, levels, dates and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(ts: Column) -> Column:
    """Monday of the week, as a date."""
    return F.date_trunc("week", ts).cast("date")


def node_size(loc: Column, fan_in: Column) -> Column:
    lines = F.when(F.coalesce(loc, F.lit(0)) == 0, F.lit(1)).otherwise(loc)
    return F.greatest(F.lit(1.0), F.log2(lines + 2) + F.sqrt(F.coalesce(fan_in, F.lit(0))))


def module_size(loc: Column) -> Column:
    return F.greatest(F.lit(2.0), F.log2(loc + 2) * 1.4)


def risk_level(score: Column) -> Column:
    return F.when(score < 30, "low").when(score < 60, "medium").otherwise("high")


def health_tone(health: Column) -> Column:
    return F.when(health >= 75, "ok").when(health >= 50, "warn").otherwise("bad")


def half_up(x: Column) -> Column:
    """Rounding of non-negative numbers to the nearest integer, halves upwards."""
    return F.floor(x + 0.5).cast("int")


def dependency_score(depth: Column, weight: Column) -> Column:
    """Strength with which a change reaches a dependent at ``depth`` hops."""
    return F.lit(1.0) / depth * F.least(F.lit(2.0), F.lit(0.6) + F.log2(weight + 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    safe = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return F.transform(vector, lambda x: x.cast("double") / safe)
