"""Guarded arithmetic on columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def nan() -> Column:
    return F.lit(NAN)


def div(numerator: Column, denominator: Column) -> Column:
    """The ratio; NaN unless the denominator is above 0, and where either is null."""
    return F.when(denominator > 0, F.coalesce(numerator / denominator, nan())).otherwise(nan())


def div_far(numerator: Column, denominator: Column) -> Column:
    """The ratio; NaN if the denominator is within 1e-9 of 0, and where either is null."""
    return F.when(F.abs(denominator) > 1e-9, F.coalesce(numerator / denominator, nan())).otherwise(nan())


def above(prediction: Column, threshold) -> Column:
    """Whether a prediction is positive. The rule of all metrics: NaN is above no threshold, so it counts as negative in
    cells, flips and curves alike; a null prediction counts as neither, and only in counts of rows."""
    return (prediction > threshold) & ~F.isnan(prediction)


def numbers(values: Sequence[float], kind: str = "double") -> Column:
    """An array of constants as one literal, however many there are; the optimizer makes it a constant."""
    if not len(values):
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def t_quantile(p: float, dof: float) -> float:
    """Quantile of Student's t distribution by bisection on its distribution function."""

    def below(t: float) -> float:
        a, b, x = dof / 2, 0.5, dof / (dof + t * t)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
        tail = front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b
        return 1 - tail / 2 if t > 0 else tail / 2

    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2
