"""Split gains and leaf values as column expressions over node statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to hessians. (Fixed value.)
EPSILON = 1e-6


def effective_gradient(g: Column, sq: Column | None = None, n: Column | None = None, l1: float = 0.0, radius: float = 0.0) -> Column:
    """Gradient sum after the soft threshold l1 + radius * sqrt(n) * std(g)."""
    t = F.lit(float(l1))
    if radius:
        var = F.greatest(sq / n - (g / n) * (g / n), F.lit(0.0))
        t = t + radius * F.sqrt(n.cast("double")) * F.sqrt(var)
    return F.signum(g) * F.greatest(F.abs(g) - t, F.lit(0.0))


def term(g: Column, h: Column, l2: float = 0.0) -> Column:
    return g * g / (h + (l2 + EPSILON))


def leaf_value(g: Column, h: Column, rate: float, l2: float = 0.0) -> Column:
    return -rate * g / (h + (l2 + EPSILON))


def info_side(g: Column, n: Column, mean: float, std: float, smoothing: float) -> Column:
    z = F.abs((g / n - mean) / std)
    return z * F.log1p(z) / smoothing


def balance(nl: Column, nr: Column) -> Column:
    ratio = F.least(nl, nr) / (nl + nr)
    return F.when(ratio < 0.1, -0.5 * (1 - F.exp(-10 * ratio))).otherwise(F.lit(0.0))
