"""The automatic training policy: controls that follow the table's size, its targets and how full its bins are."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.operators import binning
from arborlake.plans.boosting import Binner, Params


def target_variance(y: Column, w: Column) -> Column:
    """Weighted population variance, from sums of one pass."""
    mean = F.sum(w * y) / F.sum(w)
    return F.sum(w * y * y) / F.sum(w) - mean * mean


def density(df: DataFrame, binner: Binner) -> float:
    """Share of the (feature, bin) places that some row has."""
    names = [f for f, c in zip(binner.features, binner.categories) if c is None]
    slots = sum(binner.sizes)
    if not slots:
        return 0.0
    binned = df.select(*(binning.bin_by_cuts(F.col(f).cast("double"), list(binner.cuts[binner.features.index(f)])).alias(f) for f in names)) if names else None
    used = sum(len(c) for c in binner.categories if c is not None)
    if binned is not None:
        used += binning.long_form(binned, names).filter("value is not null").distinct().count()
    return used / (len(binner.features) * max(binner.sizes))


def min_rows(n: int) -> int:
    return next((k for limit, k in ((128, 1), (512, 2), (2048, 4), (8192, 8)) if n < limit), 16)


def automatic(p: Params, n: int, features: int, variance: float, filled: float) -> Params:
    """Parameters with the policy's controls where the user left the defaults.

    Small tables: fewer rounds, or ridge, where many features meet few rows.
    Others: rows a leaf, a floor of gains (not for ranking), sampling of rows
    and features. (Limits are fixed values.)
    """
    few_rows_a_feature = features >= 8 and n / max(features, 1) < 64
    if n < 1024:
        rounds = min(p.n_estimators, 96) if few_rows_a_feature and p.n_estimators > 256 and variance > 1 else p.n_estimators
        return replace(p, n_estimators=rounds, lambda_l2=2.0 if few_rows_a_feature and variance > 4 and p.lambda_l2 == 0 else p.lambda_l2)
    floor = 0.0 if p.objective.startswith("rank:") else 0.001 if filled < 0.1 else 0.0001 if n * features >= 65_536 else 0.0
    rows = (0.8 if n >= 16_384 else 0.9) if p.row_subsample == 1 and n >= 2048 else p.row_subsample
    cols = next((v for limit, v in ((256, 0.5), (128, 0.65), (32, 0.8)) if features >= limit), 1.0) if p.col_subsample == 1 else p.col_subsample
    return replace(p, min_data_in_leaf=min(max(min_rows(n), p.min_data_in_leaf), max(n // 2, 1)), min_split_gain=max(floor, p.min_split_gain), row_subsample=rows, col_subsample=cols)


def resolve(df: DataFrame, binner: Binner, label: str, weight: str | None, p: Params) -> Params:
    """``automatic`` for a table and its fitted bins."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    r = df.agg(F.count(F.lit(1)).alias("n"), target_variance(F.col(label).cast("double"), w).alias("v")).first()
    return automatic(p, r.n, len(binner.features), r.v or 0.0, density(df, binner) if r.n >= 1024 else 1.0)


def fingerprint(df: DataFrame, features: list[str], label: str, sample: int = 50) -> dict[str, float]:
    """Structure of a table: spread of features, what squares add to correlations, the largest product's correlation over a small hashed sample, a depth."""
    first = features[:5]
    x, y = [F.col(f).cast("double") for f in features], F.col(label).cast("double")
    spread = [(F.stddev_pop(c) / (F.max(c) - F.min(c) + 1e-10)).alias(f"s{i}") for i, c in enumerate(x)]
    plain = [F.corr(c, y).alias(f"l{i}") for i, c in enumerate(x[:5])] + [F.corr(c * c, y).alias(f"q{i}") for i, c in enumerate(x[:5])]
    r = df.agg(F.count(F.lit(1)).alias("n"), *spread, *plain).first()
    known = lambda v: abs(v) if v is not None and v == v else 0.0
    complexity = sum(known(r[f"s{i}"]) for i in range(len(x))) / max(len(x), 1)
    bent = max([0.0, *(known(r[f"q{i}"]) - known(r[f"l{i}"]) for i in range(len(first)))])
    together = 0.0
    pairs = [(i, j) for i in range(len(first)) for j in range(i + 1, len(first))]
    if len(features) < 100 and r.n > 100 and pairs:
        few = df.select(*x[:5], y.alias("y"), F.xxhash64(*features, label).alias("h")).toDF(*(f"x{i}" for i in range(len(first))), "y", "h").orderBy("h").limit(sample)
        got = few.agg(*(F.corr(F.col(f"x{i}") * F.col(f"x{j}"), F.col("y")).alias(f"p{i}_{j}") for i, j in pairs)).first()
        together = max(known(v) for v in got)
    return {"complexity": complexity, "non_linearity": bent, "interaction_strength": together, "noise_level": 0.1, "suggested_max_depth": 10 if complexity > 0.5 else 8}
