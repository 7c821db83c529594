import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions import metrics
from arborlake.operators import binning, encoders, validation
from arborlake.plans import boosting


def table(spark, n=400):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    rows = [(int(i), float(x), None if i % 17 == 0 else float(z), float(3 * (x > 0.5) + z), "u" if x > 0.3 else "v") for i, (x, z) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, c string").cache()


def test_fit_reduces_error_and_handles_missing(spark):
    df = table(spark)
    m = boosting.fit(df, ["a", "b"], "y", boosting.Params(n_estimators=8, max_depth=3, learning_rate=0.5))
    out = m.transform(df)
    assert metrics.rmse(out, "y", "prediction").first()[0] < 0.4
    assert m.importances()["a"] > m.importances()["b"] > 0


def test_first_split_equals_brute_force(spark):
    df = table(spark).filter("b is not null")
    m = boosting.fit(df, ["a"], "y", boosting.Params(n_estimators=1, max_depth=1, max_bins=16))
    rows = df.select("a", "y").collect()
    cuts = m.binner.cuts[0]
    y = np.array([r.y for r in rows])
    bins = np.searchsorted(cuts, [r.a for r in rows], side="right")
    g = y.mean() - y
    gain = [(g[bins <= k].sum() ** 2 / ((bins <= k).sum() + 1e-6) + g[bins > k].sum() ** 2 / ((bins > k).sum() + 1e-6)) for k in range(len(cuts))]
    assert m.trees[0].threshold[0] == int(np.argmax(gain))


@pytest.mark.parametrize("kw", [{"boosting_mode": "dart"}, {"boosting_mode": "goss"}, {"tree_growth": "leaf", "max_leaves": 4}, {"row_subsample": 0.5, "dro_radius": 0.05}])
def test_modes_fit(spark, kw):
    df = table(spark)
    m = boosting.fit(df, ["a", "b", "c"], "y", boosting.Params(n_estimators=3, max_depth=2, learning_rate=0.5, **kw), categorical=["c"])
    assert metrics.rmse(m.transform(df), "y", "prediction").first()[0] < 1.4


def test_monotone(spark):
    df = table(spark).withColumn("y", F.sin(F.col("a") * 9))
    m = boosting.fit(df, ["a"], "y", boosting.Params(n_estimators=3, max_depth=3, learning_rate=0.5, monotone={0: 1}))
    p = np.array([r.prediction for r in m.transform(df).orderBy("a").collect()])
    assert (np.diff(p) >= -1e-9).all()


def test_parameters_are_checked():
    for kw in ({"learning_rate": 0}, {"tree_growth": "leaf"}, {"max_bins": 1}, {"boosting_mode": "dart", "monotone": {0: 1}}):
        with pytest.raises(ValueError):
            boosting.Params(**kw).check()


def test_cuts_follow_the_definition(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 2, 3, 3, 4, 8, 9, 9, 9]], "v double")
    s = sorted(r.v for r in df.collect())
    want = sorted({s[q * len(s) // 4] for q in range(1, 4)})
    assert sorted(r.cut for r in binning.quantile_cuts(df, ["v"], 4).collect()) == want


def test_time_aware_encoding_uses_the_past_only(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.0), ("b", 2, 1.0), ("a", 3, 1.0)], "c string, t int, y double")
    got = {(r.c, r.t): r.e for r in encoders.target_time_aware(df, "c", "y", "t", "e", smoothing=0).collect()}
    assert got == {("a", 1): 0.0, ("a", 2): 1.0, ("b", 2): 1.0, ("a", 3): 0.5}


def test_folds_do_not_leak(spark):
    df = spark.createDataFrame([(i // 2,) for i in range(12)], "t int")
    rows = validation.purged_folds(df, "t", 3, purge=1, embargo=1).collect()
    for f in range(3):
        test = {r.t for r in rows if r.fold == f and r.part == "test"}
        train = {r.t for r in rows if r.fold == f and r.part == "train"}
        assert test == {2 * f, 2 * f + 1} and not train & {min(test) - 1, max(test) + 1, *test}
