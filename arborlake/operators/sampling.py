"""Deterministic row, feature and tree sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.sources.frames import cut_lineage


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 output function on unsigned 64-bit numbers."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniform(ids: np.ndarray, seed: int, round_index: int) -> np.ndarray:
    """A number in [0, 1) for each row, the same on every machine."""
    key = mixed(np.array([seed * 1_000_003 + round_index], np.int64).view(np.uint64))[0]
    return (mixed(ids.astype(np.int64).view(np.uint64) ^ key) >> np.uint64(11)) / float(1 << 53)


def features_of_round(count: int, rate: float, seed: int, round_index: int) -> np.ndarray:
    k = max(1, int(np.ceil(count * rate)))
    return np.sort(np.argsort(uniform(np.arange(count), seed + 7919, round_index), kind="stable")[:k])


def dropped_trees(n: int, rate: float, most: int, seed: int, round_index: int, weights: list[float] | None = None) -> list[int]:
    """Trees that a DART round leaves out: those under ``rate`` (in proportion to ``weights``, if given), at least one, at most ``most`` of the lowest."""
    if not n:
        return []
    u = uniform(np.arange(n), seed + 104729, round_index)
    limit = np.full(n, rate)
    if weights is not None:
        share = np.abs(np.asarray(weights, float))
        limit = np.minimum(rate * n * share / share.sum(), 1.0) if share.sum() > 0 else np.zeros(n)
    hit = np.flatnonzero(u < limit)
    if not len(hit):
        hit = np.array([int(u.argmin())])
    return sorted(hit[np.argsort(u[hit], kind="stable")][:most].tolist())


#: Cells of a range in one pass of the search for a place in an order, and values that are looked at one by one.
CELLS, FEW_VALUES = 1 << 14, 10_000


def kth(df: DataFrame, value: str, k: int) -> tuple[float, int] | None:
    """(the k-th smallest number of a column, k from 1, and how many are smaller), in passes that count cells of a narrowing range."""
    x = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    low, high, n = x.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n or not 1 <= k <= n:
        return None
    below = 0
    while low < high:
        if n <= FEW_VALUES:
            left = np.sort([r.v for r in x.filter((F.col("v") >= low) & (F.col("v") <= high)).collect()])  # at most FEW_VALUES rows
            at = left[k - below - 1]
            return float(at), below + int((left < at).sum())
        step = (high - low) / CELLS
        inside = x.filter((F.col("v") >= low) & (F.col("v") <= high))
        cell = F.least(F.floor((F.col("v") - low) / step), F.lit(CELLS - 1)) if step > 0 else (F.col("v") > low).cast("long")
        cells = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).orderBy("cell").collect()  # at most CELLS rows
        for r in cells:
            if below + r.n >= k:
                low, high, n = r.a, r.z, r.n
                break
            below += r.n
    return float(low), below


def _least(df: DataFrame, value: str, tie: str, k: int) -> Column | None:
    """The condition that a row is among the k of smallest (value, tie); None if there are none."""
    found = kth(df, value, k)
    if found is None:
        return None
    at, below = found
    last = kth(df.filter(F.col(value) == at), tie, k - below)
    return (F.col(value) < at) | ((F.col(value) == at) & (F.col(tie) <= last[0]))


def smallest_hashes(df: DataFrame, h: Column, tie: str, rate: float) -> DataFrame:
    """Exactly ceil(n rate) rows of smallest (hash, tie), found by counting; ``tie`` is a number that tells rows apart."""
    x = df.withColumn("_h", h)
    hit = _least(cut_lineage(x.select("_h", tie)), "_h", tie, int(np.ceil(df.count() * rate)))
    return df.limit(0) if hit is None else x.filter(hit).drop("_h")


def goss(df: DataFrame, g: str, tie: str, h: Column, top_rate: float, other_rate: float) -> DataFrame:
    """Rows of largest |g| and a hashed sample of the others, with the weight ``amplify`` that keeps sums unbiased.

    Both are found by counting, so no task orders all rows. The weight comes
    from the counts that were reached.
    """
    n = df.count()
    top_n = min(max(int(np.ceil(n * top_rate)), 1), n)
    other_n = min(int(np.ceil(n * other_rate)), n - top_n)
    x = df.withColumn("_g", -F.round(F.abs(F.col(g)), 9)).withColumn("_h", h)
    numbers = cut_lineage(x.select("_g", "_h", tie))
    top = _least(numbers, "_g", tie, top_n)
    if top is None:
        return df.withColumn("amplify", F.lit(1.0)).limit(0)
    rest = x.filter(~top)
    other = _least(numbers.filter(~top), "_h", tie, other_n)
    chosen = rest.filter(other).withColumn("amplify", F.lit((n - top_n) / max(other_n, 1))) if other is not None else None
    first = x.filter(top).withColumn("amplify", F.lit(1.0))
    return (first if chosen is None else first.union(chosen)).drop("_g", "_h")
