"""Target and frequency encodings of categories, plain and without look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.sources.frames import small

def smooth(total: Column, count: Column, prior: Column, smoothing: float, min_samples: int) -> Column:
    """Category mean blended with the prior by count / (count + smoothing)."""
    share = count / (count + smoothing)
    mean = total / count
    return F.when(count < min_samples, prior).otherwise(mean if smoothing == 0 else share * mean + (1 - share) * prior)


def fit_target(df: DataFrame, cat: str, y: str, smoothing: float = 20.0, min_samples: int = 1) -> DataFrame:
    """category, encoding (and the prior). Sums are combined before the shuffle, so a hot category costs no more."""
    per = df.groupBy(F.col(cat).alias("category")).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count("*").alias("n"))
    prior = df.agg(F.avg(F.col(y).cast("double")).alias("prior"))
    return per.crossJoin(F.broadcast(prior)).select("category", smooth(F.col("s"), F.col("n"), F.col("prior"), smoothing, min_samples).alias("encoding"), "prior")


def apply_target(df: DataFrame, cat: str, fitted: DataFrame, out: str) -> DataFrame:
    """Looks encodings up; unseen categories get the prior."""
    prior = fitted.agg(F.max("prior").alias("_prior"))
    t = small(fitted.select(F.col("category").alias(cat), F.col("encoding").alias("_e")))
    return df.join(t, cat, "left").crossJoin(F.broadcast(prior)).withColumn(out, F.coalesce("_e", "_prior")).drop("_e", "_prior")


def target_time_aware(df: DataFrame, cat: str, y: str, time: str, out: str, smoothing: float = 20.0, min_samples: int = 1) -> DataFrame:
    """Encodes each row from rows of strictly earlier time; rows of one time share a state; no past gives 0.

    Sums per (category, time) come first, so the windows run over periods
    and not over rows.
    """
    cell = df.groupBy(cat, time).agg(F.sum(F.col(y).cast("double")).alias("_s"), F.count("*").alias("_n"))
    past = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    period = cell.groupBy(time).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    prior = period.select(time, (F.sum("_s").over(past) / F.sum("_n").over(past)).alias("_prior"))
    own = Window.partitionBy(cat).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    state = cell.select(cat, time, F.coalesce(F.sum("_s").over(own), F.lit(0.0)).alias("_ps"), F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("_pn")).join(prior, time)
    prior_or_0 = F.coalesce("_prior", F.lit(0.0))
    e = F.when(F.col("_pn") == 0, prior_or_0).otherwise(smooth(F.col("_ps"), F.col("_pn"), prior_or_0, smoothing, min_samples))
    return df.join(small(state.select(cat, time, e.alias(out))), [cat, time], "left")


def fit_frequency(df: DataFrame, cat: str) -> DataFrame:
    total = df.agg(F.count("*").alias("t"))
    return df.groupBy(F.col(cat).alias("category")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("category", (F.col("n") / F.col("t")).alias("frequency"))


def apply_frequency(df: DataFrame, cat: str, fitted: DataFrame, out: str) -> DataFrame:
    """Looks frequencies up; unseen categories get 0."""
    return df.join(small(fitted.select(F.col("category").alias(cat), F.col("frequency").alias("_f"))), cat, "left").withColumn(out, F.coalesce("_f", F.lit(0.0))).drop("_f")


def dense_ids(df: DataFrame, cat: str) -> DataFrame:
    """category, id: positions of the distinct values in order."""
    d = df.select(F.col(cat).alias("category")).filter("category is not null").distinct()
    return d.withColumn("id", F.row_number().over(Window.orderBy("category")) - 1)


def target_encode_all(train: DataFrame, columns: list[str], y: str, smoothing: float = 20.0, min_samples: int = 1) -> dict[str, DataFrame]:
    """An encoder table for each of several columns (category as text, encoding, prior)."""
    return {c: fit_target(train.withColumn(c, F.col(c).cast("string")), c, y, smoothing, min_samples) for c in columns}


def apply_target_all(df: DataFrame, fitted: dict[str, DataFrame]) -> DataFrame:
    """Replaces each column by its encoding; null and unseen categories get the prior."""
    order = df.columns
    for c, t in fitted.items():
        df = apply_target(df.withColumn(c, F.col(c).cast("string")), c, t, "_enc").drop(c).withColumnRenamed("_enc", c)
    return df.select(*order)
