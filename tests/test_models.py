from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions import metrics
from arborlake.operators import neutralize
from arborlake.plans import boosting, explain, model_files
from arborlake.plans.morph import Morph, Schedule, learning_rates
from arborlake.streaming.scoring import score_stream
from tests.test_boosting import table


@pytest.fixture(scope="module")
def fitted(spark):
    df = table(spark)
    return df, boosting.fit(df, ["a", "b", "c"], "y", boosting.Params(n_estimators=3, max_depth=3, learning_rate=0.5), categorical=["c"])


def known(tree, node, bins, s):
    """A tree's expectation for one row when only the features in ``s`` are known."""
    if tree.left[node] < 0:
        return tree.weight * tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if tree.feature[node] in s:
        return known(tree, left if tree.goes_left(node, bins[[tree.feature[node]]])[0] else right, bins, s)
    part = tree.cover[left] / tree.cover[node]
    return part * known(tree, left, bins, s) + (1 - part) * known(tree, right, bins, s)


def test_shapley_equals_brute_force(fitted):
    _, m = fitted
    bins = np.random.default_rng(3).integers(-1, 2, (20, 3)) * np.array([90, 120, 1])
    bins[bins < 0] = -1
    expected, phi, inter = explain.shapley(m, bins, pairs=True)
    for row in range(len(bins)):
        def f(s, row=row):
            return m.base[0] + sum(known(t, 0, bins[row], s) for t in m.trees)

        assert f(()) == pytest.approx(expected[0])
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            want = sum(factorial(n) * factorial(2 - n) / 6 * (f((*s, i)) - f(s)) for n in range(3) for s in combinations(rest, n))
            assert phi[0, row, i] == pytest.approx(want, abs=1e-9)
            for j in rest:
                k = 3 - i - j
                want = sum((f((*s, i, j)) - f((*s, i)) - f((*s, j)) + f(s)) / 4 for s in ((), (k,)))
                assert inter[0, row, i, j] == pytest.approx(want, abs=1e-9)
    assert np.allclose(inter.sum(3), phi) and np.allclose(expected[0] + phi[0].sum(1), m.raw(bins)[:, 0])


def test_shap_columns_add_up(fitted):
    df, m = fitted
    out = explain.shap_values(m, m.transform(df)).select("prediction", F.col("expected_value")[0].alias("e"), F.col("shap")[0].alias("s")).collect()
    assert all(r.e + sum(r.s) == pytest.approx(r.prediction, abs=1e-9) for r in out) and len(out) == 400
    assert [r.feature for r in explain.importance(m, df).collect()][0] == "a"


def test_model_file_round_trip(spark, fitted, tmp_path):
    df, m = fitted
    model_files.save(m, spark, str(tmp_path / "m"))
    back = model_files.load(spark, str(tmp_path / "m"))
    pick = lambda x: [r.prediction for r in x.transform(df).orderBy("id").collect()]
    assert pick(back) == pick(m) and back.params == m.params


def test_stream_is_scored_like_a_batch(spark, fitted, tmp_path):
    df, m = fitted
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_stream(m, stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").select("id", "prediction").collect()
    assert got == m.transform(df).orderBy("id").select("id", "prediction").collect()


@pytest.mark.parametrize("transform", ["none", "center", "standardize"])
def test_residual_equals_least_squares(spark, transform):
    df = table(spark).na.drop()
    x, y = np.array([(r.a, r.b) for r in df.collect()]), np.array([r.y for r in df.collect()])
    if transform != "none":
        x = x - x.mean(0)
    if transform == "standardize":
        x = x / x.std(0)
    want = y - x @ np.linalg.solve(x.T @ x + 1e-6 * np.eye(2), x.T @ y)
    got = [r[0] for r in df.select(neutralize.residual(df, F.col("y"), ["a", "b"], transform=transform)).collect()]
    assert np.allclose(got, want)


def test_early_stopping_and_warm_start(spark):
    df = table(spark)
    p = boosting.Params(n_estimators=3, max_depth=2, learning_rate=0.5)
    first = boosting.fit(df, ["a", "b"], "y", p)
    second = boosting.fit(df, ["a", "b"], "y", p, warm=first)
    loss = lambda m: metrics.rmse(m.transform(df), "y", "prediction").first()[0]
    assert len(second.trees) == 6 and loss(second) < loss(first)
    losses = iter([3.0, 2.0, 2.5, 2.6, 1.0])
    m = boosting.fit(df, ["a"], "y", boosting.Params(n_estimators=5, max_depth=1, early_stopping_rounds=2), evaluate=lambda _: next(losses))
    assert len(m.trees) == 2


def test_interaction_groups(spark):
    df = table(spark).na.drop()
    m = boosting.fit(df, ["a", "b"], "y", boosting.Params(n_estimators=3, max_depth=3, learning_rate=0.5, interactions=((0,), (1,))))
    for t in m.trees:
        for _, steps, _ in explain.leaf_paths(t):
            assert len(steps) <= 1


def test_morph_fits_and_blends(spark):
    df = table(spark)
    m = boosting.fit(df, ["a", "b"], "y", boosting.Params(n_estimators=6, max_depth=2, learning_rate=0.5, morph=Morph(warmup=2)))
    assert metrics.rmse(m.transform(df), "y", "prediction").first()[0] < 0.9
    assert model_files.loads(model_files.dumps(m)).params == m.params
    s = Schedule(Morph(warmup=1, info_weight=0.5), 4, learning_rates(4, 0.2, 0.5), moments={0: (0.1, 2.0)})
    assert s.rates == pytest.approx([0.1, 0.2, 0.2, 0.101])
    assert s.leaf_rate(2, 3) == pytest.approx(0.2 * 0.95 * 0.9)
    total, left, right = np.array([2.0, 100, 100, 0]), np.array([[4.0, 5, 5, 0]]), np.array([[-2.0, 95, 95, 0]])
    share, z = 0.5 * np.tanh(1.5), [abs(v - 0.1) / 2 for v in (0.8, -2 / 95, 0.02)]
    info = [v * np.log1p(v) / 1.1 for v in z]
    want = (1 - share) * 7.0 / 400 + share * (info[0] + info[1] - info[2]) - 0.5 * (1 - np.exp(-0.5))
    assert s.gain(2, 0, np.array([7.0]), total, left, right, 0.0) == pytest.approx([want])
    assert s.gain(0, 0, np.array([7.0]), total, left, right, 0.0) == [7.0]


@pytest.mark.parametrize("weight", [None, "w"])
def test_quantile_leaves_equal_brute_force(spark, weight):
    df = table(spark).na.drop().withColumn("w", F.col("id") % 3 + 1.0)
    p = boosting.Params(objective="quantile", n_estimators=1, max_depth=2, learning_rate=1.0, options={"quantile_alpha": 0.3})
    m = boosting.fit(df, ["a", "b"], "y", p, weight=weight)
    rows = m.transform(df).collect()
    by_value = {}
    for r in rows:
        by_value.setdefault(r.prediction, []).append((r.y - m.base[0], r.w if weight else 1.0))
    for value, parts in by_value.items():
        parts.sort()
        reach = np.cumsum([w for _, w in parts])
        want = parts[int(np.searchsorted(reach, 0.3 * reach[-1] * (1 - 1e-12)))][0]
        assert value == pytest.approx(m.base[0] + want, abs=1e-9)
    assert len(by_value) > 2
