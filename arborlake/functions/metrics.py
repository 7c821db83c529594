"""Evaluation metrics as aggregates: each takes a frame and column names and returns a frame of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = 1e-15


def _one(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.agg(value.alias(name))


def _d(y: str, p: str) -> Column:
    return F.col(y).cast("double") - F.col(p).cast("double")


def rmse(df: DataFrame, y: str, p: str) -> DataFrame:
    return _one(df, F.sqrt(F.avg(_d(y, p) * _d(y, p))), "rmse")


def mae(df: DataFrame, y: str, p: str) -> DataFrame:
    return _one(df, F.avg(F.abs(_d(y, p))), "mae")


def r2_score(df: DataFrame, y: str, p: str) -> DataFrame:
    """1 - RSS / TSS; without variance 1 for a perfect fit, else 0. One pass: TSS from the population variance."""
    rss, tss = F.sum(_d(y, p) * _d(y, p)), F.var_pop(F.col(y).cast("double")) * F.count(F.col(y))
    return _one(df, F.when(tss == 0, F.when(rss == 0, 1.0).otherwise(0.0)).otherwise(1 - rss / tss), "r2_score")


def _corr(y: Column, p: Column) -> Column:
    flat = (F.var_pop(y) == 0) | (F.var_pop(p) == 0)
    return F.when(flat, 0.0).otherwise(F.coalesce(F.corr(y, p), F.lit(0.0)))


def pearson_correlation(df: DataFrame, y: str, p: str) -> DataFrame:
    return _one(df, _corr(F.col(y).cast("double"), F.col(p).cast("double")), "pearson_correlation")


def average_ranks(df: DataFrame, column: str, by: list[str], out: str) -> DataFrame:
    """1-based ranks within groups, ties sharing their mean."""
    w = Window.partitionBy(*by).orderBy(column)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, column)) - 1) / 2)


def rank_ic(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Pearson correlation of average ranks within each group."""
    ranked = average_ranks(average_ranks(df, y, by, "_ry"), p, by, "_rp")
    return ranked.groupBy(*by).agg(_corr(F.col("_ry"), F.col("_rp")).alias("rank_ic"))


def icir(df: DataFrame, ic: str) -> DataFrame:
    v = F.var_pop(ic)
    return _one(df, F.when(v < 1e-15, 0.0).otherwise(F.avg(ic) / F.sqrt(v)), "icir")


def hit_rate(df: DataFrame, y: str, p: str, threshold: float = 0.0) -> DataFrame:
    same = F.signum(F.col(y).cast("double") - threshold) == F.signum(F.col(p).cast("double") - threshold)
    return _one(df, F.avg(same.cast("double")), "hit_rate")


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return _one(df, F.avg((F.col(y) == F.col(p)).cast("double")), "accuracy")


def log_loss(df: DataFrame, y: str, p: str) -> DataFrame:
    q = F.greatest(F.least(F.col(p), F.lit(1 - CLIP)), F.lit(CLIP))
    return _one(df, -F.avg(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q)), "log_loss")


def multiclass_log_loss(df: DataFrame, y: str, probs: str) -> DataFrame:
    q = F.element_at(probs, F.col(y).cast("int") + 1)
    return _one(df, -F.avg(F.ln(F.greatest(F.least(q, F.lit(1 - CLIP)), F.lit(CLIP)))), "multiclass_log_loss")


def ndcg(df: DataFrame, y: str, p: str, group: str, tie: str, k: int | None = None) -> DataFrame:
    """Mean NDCG over groups; a group without gain counts 1. Ties of the score go by ``tie``."""
    gain = F.pow(F.lit(2.0), F.col(y)) - 1
    by_score = Window.partitionBy(group).orderBy(F.desc(p), F.asc(tie))
    by_label = Window.partitionBy(group).orderBy(F.desc(y), F.asc(tie))
    r = df.withColumn("_s", F.row_number().over(by_score)).withColumn("_i", F.row_number().over(by_label))
    part = lambda c: gain / F.log2(F.col(c) + 1.0) if k is None else F.when(F.col(c) <= k, gain / F.log2(F.col(c) + 1.0)).otherwise(0.0)
    per = r.groupBy(group).agg(F.sum(part("_s")).alias("dcg"), F.sum(part("_i")).alias("idcg"))
    return _one(per, F.avg(F.when(F.col("idcg") <= 0, 1.0).otherwise(F.col("dcg") / F.col("idcg"))), "ndcg")


def poisson_deviance(df: DataFrame, y: str, mu: str) -> DataFrame:
    a, b = F.col(y).cast("double"), F.col(mu).cast("double")
    return _one(df, 2 * F.avg(F.when(a > 0, a * F.ln(a / b)).otherwise(0.0) - (a - b)), "poisson_deviance")


def gamma_deviance(df: DataFrame, y: str, mu: str) -> DataFrame:
    a, b = F.col(y).cast("double"), F.col(mu).cast("double")
    return _one(df, 2 * F.avg(-F.ln(a / b) + (a - b) / b), "gamma_deviance")


def tweedie_deviance(df: DataFrame, y: str, mu: str, power: float = 1.5) -> DataFrame:
    a, b = F.col(y).cast("double"), F.col(mu).cast("double")
    q = power
    value = F.pow(a, F.lit(2 - q)) / ((1 - q) * (2 - q)) - a * F.pow(b, F.lit(1 - q)) / (1 - q) + F.pow(b, F.lit(2 - q)) / (2 - q)
    return _one(df, 2 * F.avg(value), "tweedie_deviance")
