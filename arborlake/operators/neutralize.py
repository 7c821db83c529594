"""Factor neutralisation: v - F (F'WF + ridge I)^-1 F'Wv.

F'WF and F'Wv come from one aggregate of k(k+1)/2 + k sums; the k by k system
is solved on the driver and the projection is a column expression again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (Fixed values.)
RIDGE, FLAT = 1e-6, 1e-6


def exposures(df: DataFrame, factors: list[str], transform: str = "none") -> list[Column]:
    """Factor columns as they are, centred, or standardised (population deviation, 1 where nearly constant)."""
    if transform not in ("none", "center", "standardize"):
        raise ValueError(f"unknown transform {transform}")
    cols = [F.col(f).cast("double") for f in factors]
    bad = df.agg(*(F.count_if(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"b{i}") for i, c in enumerate(cols)), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols))).first()
    for i, f in enumerate(factors):
        if bad[f"b{i}"]:
            raise ValueError(f"factor {f} has values that are missing or not finite")
    if transform == "none" or bad["m0"] is None:
        return cols
    scale = [bad[f"s{i}"] if transform == "standardize" and bad[f"s{i}"] > FLAT else 1.0 for i in range(len(cols))]
    return [(c - bad[f"m{i}"]) / scale[i] for i, c in enumerate(cols)]


def residual(df: DataFrame, value: Column, factors: list[str], weight: Column | None = None, ridge: float = RIDGE, transform: str = "none") -> Column:
    """The part of ``value`` that the factors do not explain, as an expression on ``df``."""
    x, w = exposures(df, factors, transform), weight if weight is not None else F.lit(1.0)
    k = len(x)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sums = df.agg(*(F.sum(w * x[i] * x[j]) for i, j in upper), *(F.sum(w * x[i] * value) for i in range(k))).first()
    if sums[0] is None:
        return value
    gram = np.zeros((k, k))
    for (i, j), s in zip(upper, sums):
        gram[i, j] = gram[j, i] = s
    beta = np.linalg.solve(gram + ridge * np.eye(k), np.array(sums[len(upper) :], float))
    return value - sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))
