"""Leakage-aware folds over periods: test blocks with a purge before and an embargo after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def purged_folds(df: DataFrame, time: str, n_splits: int, purge: int = 0, embargo: int = 0) -> DataFrame:
    """Rows of ``df`` for each fold with ``part`` 'train' or 'test'; rows in a purge or embargo are left out.

    Folds are contiguous periods, the first ones a period longer where the
    number does not divide. Only distinct periods are numbered and joined to
    the folds; rows then meet that small table by period.
    """
    periods = df.select(time).filter(F.col(time).isNotNull()).distinct()
    w = Window.orderBy(time)
    numbered = periods.withColumn("_k", F.row_number().over(w) - 1).withColumn("_own", F.ntile(n_splits).over(w) - 1)
    folds = numbered.groupBy(F.col("_own").alias("fold")).agg(F.min("_k").alias("_a"), F.max("_k").alias("_b"))
    test = (F.col("_k") >= F.col("_a")) & (F.col("_k") <= F.col("_b"))
    train = (F.col("_k") < F.col("_a") - purge) | (F.col("_k") > F.col("_b") + embargo)
    # at most n_splits fold rows
    part = numbered.join(F.broadcast(folds), test | train).select(time, "fold", F.when(test, "test").otherwise("train").alias("part"))
    return df.join(part, time)


def purged_panel_folds(df: DataFrame, time: str, entity: str, n_splits: int, purge: int = 0, embargo: int = 0) -> DataFrame:
    """Folds of a panel: periods are split for all entities together, so no entity is in test and training around one time."""
    if df.filter(F.col(entity).isNull()).limit(1).count():
        raise ValueError(f"{entity} must name an entity in every row")
    return purged_folds(df, time, n_splits, purge, embargo)


def split_by_time(df: DataFrame, time: str, test_share: float) -> DataFrame:
    """Adds ``part``: the last share of the distinct times, at least one and not all, is 'test'."""
    times = df.select(time).filter(F.col(time).isNotNull()).distinct()
    n = times.count()
    if n < 2 or not 0 < test_share < 1:
        raise ValueError("a split needs two times and a share between 0 and 1")
    keep = n - min(max(round(n * test_share), 1), n - 1)
    first_test = times.withColumn("_k", F.row_number().over(Window.orderBy(time))).filter(F.col("_k") == keep + 1).first()[0]  # a row a time
    return df.filter(F.col(time).isNotNull()).withColumn("part", F.when(F.col(time) >= F.lit(first_test), "test").otherwise("train"))
