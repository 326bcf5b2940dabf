"""Scalar functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def alpha(half_life: Column | float) -> Column:
    """Smoothing weight of a half-life, at least one step."""
    h = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    return 1 - F.exp(-F.lit(math.log(2)) / F.greatest(h, F.lit(1.0)))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softmax(scores: list[Column], temperature: float) -> list[Column]:
    """Shifted by the maximum, so that no exponential overflows."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp((s - top) / temperature) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def decay(age: Column, half_life: float) -> Column:
    """Growth of a signal's noise with age: 2 ** (age / half life)."""
    return F.pow(F.lit(2.0), age / half_life)


def daily_persistence(monthly: Column) -> Column:
    return F.coalesce(F.pow(F.abs(monthly), F.lit(1.0 / 22)), F.lit(0.5))


def normal_density(x: Column, variance: Column) -> Column:
    return F.exp(-x * x / (2 * variance)) / F.sqrt(2 * F.lit(math.pi) * variance)


def pseudo_value(direction: Column, size: Column, confidence: Column) -> Column:
    """What a qualitative signal says of a factor."""
    return direction * size * confidence


def denormalised(z: Column, mean: Column, variance: Column, floor: float = 0.01) -> Column:
    return z * F.greatest(F.sqrt(variance), F.lit(floor)) + mean


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matrix_vector(rows: Column, x: Column) -> Column:
    """An array of row arrays times an array."""
    return F.transform(rows, lambda r: dot(r, x))


def map_value(m: Column, key: str, default: float = 0.0) -> Column:
    return F.coalesce(F.element_at(m, key), F.lit(default))


def map_argmax(m: Column) -> Column:
    """The first key, in the map's order, of the largest value."""
    return F.element_at(F.map_keys(F.map_filter(m, lambda k, v: v == F.array_max(F.map_values(m)))), 1)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of the rows that hold both, as an aggregate; null where one of them never moves, which corr() takes for an error."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.when(spread > 0, F.greatest(F.least(F.covar_pop(a, b) / spread, F.lit(1.0)), F.lit(-1.0)))
