"""Feature binning: cuts fitted in distributed passes, applied as projections.

Features are worked on in long form (feature, value). Orders over many values
are cut into ranges by a sketch first, so that a window sees one range of one
feature and its start comes from the sums of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.sources.frames import cut_lineage, small

#: Ranges that the values of one group are ordered in, and values that need none.
RANGES, FEW_VALUES = 64, 1_000_000


def running(counts: DataFrame, by: list[str], value: str, c: str) -> DataFrame:
    """Adds ``past``, the sum of ``c`` over values up to and with each one, and ``total``; one row for each of a group's values."""
    counts = cut_lineage(counts)
    whole = Window.partitionBy(*by)
    if counts.limit(FEW_VALUES + 1).count() <= FEW_VALUES:
        return counts.withColumn("past", F.sum(c).over(whole.orderBy(value))).withColumn("total", F.sum(c).over(whole))
    at = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    bounds = counts.groupBy(*by).agg(F.percentile_approx(value, at, 1000).alias("_bounds"))
    ranged = counts.join(small(bounds), by).withColumn("_range", F.size(F.filter("_bounds", lambda x: x < F.col(value)))).drop("_bounds")
    sums = ranged.groupBy(*by, "_range").agg(F.sum(c).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*by, "_range", before.alias("_before"), F.sum("_sum").over(whole).alias("total"))
    inside = F.sum(c).over(Window.partitionBy(*by, "_range").orderBy(value))
    return ranged.join(small(starts), [*by, "_range"]).withColumn("past", F.col("_before") + inside).drop("_before", "_range")


def long_form(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows (feature, value, kept columns); NaN becomes null."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.nanvl(F.col(f).cast("double"), F.lit(None)).alias("value")) for f in features))
    return df.select(F.explode(pairs).alias("p"), *(keep or [])).select("p.feature", "p.value", *(keep or []))


def quantile_cuts(df: DataFrame, features: list[str], max_bins: int) -> DataFrame:
    """Exact cuts: the distinct sorted[floor(q n / bins)], q = 1 .. bins - 1, with bins = min(max_bins, n).

    Equal values are counted before they are ordered.
    """
    counts = long_form(df, features).filter("value is not null").groupBy("feature", "value").agg(F.count("*").alias("c"))
    ranked = running(counts, ["feature"], "value", "c").withColumnRenamed("total", "n")
    bins = F.least(F.lit(max_bins).cast("long"), F.col("n"))
    # the least q whose position floor(q n / bins) is at or past the value's first place, if it is in its run
    first = F.col("past") - F.col("c")
    q = F.ceil(first * bins / F.col("n"))
    hit = (F.greatest(q, F.lit(1)) <= bins - 1) & (F.floor(F.greatest(q, F.lit(1)) * F.col("n") / bins) < F.col("past"))
    return ranked.filter(hit).select("feature", F.col("value").alias("cut"))


def weighted_cuts(df: DataFrame, features: list[str], weight: str, max_bins: int) -> DataFrame:
    """Weighted cuts: for each q the first value whose running weight exceeds q W / bins.

    There are no more bins than rows, or than the sum of the weights where all
    are whole; thresholds are then whole too.
    """
    w = F.col("_w").cast("double")
    rows = long_form(df.withColumn("_w", F.col(weight)), features, ["_w"]).filter("value is not null and _w > 0")
    sums = rows.groupBy("feature", "value").agg(F.sum(w).alias("c"), F.count("*").alias("m"), F.max((w != F.floor(w)).cast("int")).alias("broken"))
    run = running(sums, ["feature"], "value", "c")
    shape = run.groupBy("feature").agg(F.sum("m").alias("rows"), F.max("broken").alias("broken"), F.max("total").alias("w"))
    run = run.drop("m", "broken").join(small(shape), "feature")
    whole = F.col("broken") == 0
    bins = F.least(F.lit(max_bins).cast("long"), F.when(whole, F.col("w").cast("long")).otherwise(F.col("rows")))
    q = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(max_bins).cast("long")), lambda k: (k >= F.floor((F.col("past") - F.col("c")) * F.col("bins") / F.col("w"))) & (k <= F.ceil(F.col("past") * F.col("bins") / F.col("w"))) & (k > 0) & (k < F.col("bins"))))
    at = run.withColumn("bins", bins).withColumn("whole", whole).withColumn("q", q)
    threshold = F.when(F.col("whole"), F.floor(F.col("q") * F.col("w").cast("long") / F.col("bins")).cast("double")).otherwise(F.col("q") * F.col("w") / F.col("bins"))
    hit = at.filter((F.col("past") - F.col("c") <= threshold) & (F.col("past") > threshold))
    return hit.select("feature", F.col("value").alias("cut")).distinct()


def group_quantile(df: DataFrame, by: list[str], value: Column, q: float, weight: Column | None = None) -> DataFrame:
    """by, value: each group's first value whose running weight reaches q times the whole."""
    rows = df.select(*by, value.cast("double").alias("_value"), (weight.cast("double") if weight is not None else F.lit(1.0)).alias("_w")).filter("_value is not null and _w > 0")
    run = running(rows.groupBy(*by, "_value").agg(F.sum("_w").alias("_c")), by, "_value", "_c")
    return run.filter(F.col("past") >= F.col("total") * q * (1 - 1e-12)).groupBy(*by).agg(F.min("_value").alias("value"))


def approximate_cuts(df: DataFrame, features: list[str], max_bins: int, accuracy: int = 10_000) -> DataFrame:
    """Cuts from a mergeable quantile sketch: one pass, no sort; for tables too large to order."""
    at = F.array(*(F.lit(i / max_bins) for i in range(1, max_bins)))
    got = long_form(df, features).filter("value is not null").groupBy("feature").agg(F.percentile_approx("value", at, accuracy).alias("cuts"))
    return got.select("feature", F.explode(F.array_distinct("cuts")).alias("cut"))


def bin_by_cuts(value: Column, cuts: list[float]) -> Column:
    """Number of cuts at or below the value; null stays null."""
    c = F.array(*(F.lit(float(x)) for x in cuts)) if cuts else F.array().cast("array<double>")
    return F.when(value.isNotNull() & ~F.isnan(value), F.size(F.filter(c, lambda x: x <= value)))


def bin_linear(value: Column, low: float | Column, high: float | Column, max_bin: int) -> Column:
    """round((v - low) / (high - low) * max_bin) clamped to 0 .. max_bin; 0 for a span of 1e-6 or less."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    span = high - low
    inner = F.floor((value - low) / span * max_bin + 0.5)
    return F.when(value.isNull(), None).when((span <= 1e-6) | (value <= low), F.lit(0)).when(value >= high, F.lit(max_bin)).otherwise(inner).cast("int")


def bin_rank(df: DataFrame, value: str, max_bin: int, out: str) -> DataFrame:
    """Place of the value's last copy among all values, from 0 .. n - 1 to 0 .. max_bin and rounded."""
    counts = df.groupBy(F.col(value)).agg(F.count("*").alias("_c")).filter(F.col(value).isNotNull()).withColumn("_all", F.lit(0))
    ranked = running(counts, ["_all"], value, "_c")
    b = F.when(F.col("total") <= 1, 0).otherwise(F.floor((F.col("past") - 1) * max_bin / (F.col("total") - 1) + 0.5)).cast("int")
    return df.join(small(ranked.select(value, b.alias(out))), value, "left")


def tail_rank_features(df: DataFrame, features: list[str], threshold: float = 0.1) -> DataFrame:
    """feature, by_rank: whether the middle 80 % of the values span so little of their range that ranks make better bins.

    Features of fewer than five values or of no span are not by rank.
    """
    counts = long_form(df, features).filter("value is not null").groupBy("feature", "value").agg(F.count("*").alias("c"))
    run = running(counts, ["feature"], "value", "c")
    n = F.col("total")
    trim = F.greatest(F.floor(n * 0.1), F.lit(1))
    place = lambda k: F.min(F.when(F.col("past") > k, F.col("value")))
    got = run.groupBy("feature").agg(F.max(n).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), place(trim).alias("a"), place(n - 1 - trim).alias("z"))
    span = F.col("high") - F.col("low")
    return got.select("feature", F.when((F.col("n") < 5) | (span <= 1e-6), False).otherwise((F.col("z") - F.col("a")) / span <= threshold).alias("by_rank"))


def bin_linear_or_rank(df: DataFrame, features: list[str], max_bin: int, threshold: float = 0.1) -> DataFrame:
    """Adds ``<feature>_bin``: linear bins, or bins by rank where the tails stretch the range. Nulls stay null."""
    plan = {r.feature: r.by_rank for r in tail_rank_features(df, features, threshold).collect()}  # a row a feature
    ends = {r.feature: r for r in bounds(df, features).collect()}
    for f in features:
        out = f"{f}_bin"
        if plan.get(f):
            df = bin_rank(df, f, max_bin, out)
        else:
            e = ends.get(f)
            df = df.withColumn(out, bin_linear(F.col(f), e.low if e and e.low is not None else 0.0, e.high if e and e.high is not None else 0.0, max_bin))
    return df


def is_prebinned(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, prebinned: whether all values are whole numbers from 0 on, to be taken as bins."""
    v = F.col("value")
    odd = F.coalesce((v < 0) | (F.abs(v - F.round(v)) > 1e-6), F.lit(False))
    return long_form(df, features).groupBy("feature").agg((~F.bool_or(odd)).alias("prebinned"))


def bounds(df: DataFrame, features: list[str]) -> DataFrame:
    return long_form(df, features).groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and inverse population deviation of each feature (1 where it is 1e-12 or less)."""
    s = F.stddev_pop("value")
    return long_form(df, features).filter("value is not null").groupBy("feature").agg(F.avg("value").alias("mean"), F.when(s <= 1e-12, 1.0).otherwise(1 / s).alias("inv_std"))


def density(df: DataFrame, bins: list[str], max_bin: int) -> DataFrame:
    """Occupied (feature, bin) slots over all slots."""
    used = long_form(df, bins).filter("value is not null").distinct()
    return used.agg((F.count("*") / F.lit(len(bins) * (max_bin + 1))).alias("density"))


def bundle_conflicts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows' non-zero entries beyond the first, over the columns of one bundle."""
    active = sum((F.when(F.col(c) != 0, 1).otherwise(0) for c in columns), F.lit(0))
    return df.agg(F.sum(F.greatest(active - 1, F.lit(0))).cast("long").alias("conflicts"))
