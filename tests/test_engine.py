"""The code that training runs, against the column expressions that SQL checks, and against brute force."""

import json
import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborlake.functions import losses, metrics, objectives, ranking
from arborlake.operators import binning, bundling, sampling, splits, validation
from arborlake.plans import boosting, explain, joint, model_files, monotone, policy
from arborlake.plans.estimators import BoostedClassifier, BoostedRegressor, MultiLabelRanker
from arborlake.plans.morph import Morph, Schedule
from arborlake.sources import frames
from tests.test_boosting import table


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(51)
    rows = [(i, float(p), float(y), float(w)) for i, (p, y, w) in enumerate(zip(rng.normal(0, 2, 300), rng.integers(1, 7, 300), rng.uniform(0.5, 3, 300)))]
    return spark.createDataFrame(rows, "id long, p double, y double, w double").cache()


COLUMNS = {
    "squared_error": objectives.squared, "binary": lambda p, y, w: objectives.binary(p, (y > 3).cast("double"), w), "poisson": objectives.poisson, "gamma": objectives.gamma, "tweedie": objectives.tweedie,
    "quantile": lambda p, y, w: objectives.quantile(p, y, w, 0.3),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_training_gradients_equal_the_columns(scored, name):
    g, h = COLUMNS[name](F.col("p"), F.col("y"), F.col("w"))
    x = scored.select("p", (F.col("y") > 3).cast("double").alias("y") if name == "binary" else "y", "w", g.alias("g"), h.alias("h")).toPandas()
    a, b = losses.row_gradients(name, x[["p"]].to_numpy(), x.y.to_numpy(), x.w.to_numpy(), {"quantile_alpha": 0.3})
    assert np.allclose(a[:, 0], x.g) and np.allclose(b[:, 0], x.h)


def test_training_losses_equal_the_columns(scored):
    p, y, w = F.col("p"), F.col("y"), F.col("w")
    made = {"squared_error": objectives.loss_squared(p, y, w), "poisson": objectives.loss_poisson(p, y, w), "gamma": objectives.loss_gamma(p, y, w), "tweedie": objectives.loss_tweedie(p, y, w), "quantile": objectives.loss_quantile(p, y, w, 0.3), "binary": objectives.loss_binary(p, (y > 3).cast("double"), w)}
    want = scored.agg(*(v.alias(k) for k, v in made.items())).first()
    x = scored.toPandas()
    for name in made:
        t = (x.y > 3).astype(float) if name == "binary" else x.y
        total, count = losses.row_loss(name, x[["p"]].to_numpy(), t.to_numpy(), x.w.to_numpy(), {"quantile_alpha": 0.3})
        assert total / count == pytest.approx(want[name])
    s = F.array(p, F.lit(0.5), -p)
    k = F.col("y") % 3
    g, h = objectives.softmax_gradients(s, k, w)
    r = scored.select(s.alias("s"), k.alias("k"), "w", g.alias("g"), h.alias("h")).toPandas()
    a, b = losses.row_gradients("softmax", np.stack(r.s), r.k.to_numpy(), r.w.to_numpy(), {})
    assert np.allclose(a, np.stack(r.g)) and np.allclose(b, np.stack(r.h))
    total, count = losses.row_loss("softmax", np.stack(r.s), r.k.to_numpy(), r.w.to_numpy(), {})
    assert total / count == pytest.approx(scored.agg(objectives.loss_softmax(s, k, w)).first()[0])


def histogram_of(df, feature="a", bins=8):
    """A node's histogram as training lays it out, and the same rows in long form."""
    x = df.select(F.floor(F.col(feature) * bins).cast("int").alias("f"), (F.col("y") - 1.5).alias("g"), F.lit(1.0).alias("h")).toPandas()
    hist = np.zeros((1, bins + 1, 4))
    for f, g, h in x.itertuples(index=False):
        hist[0, bins if f is None or f != f else int(f)] += (g, h, 1, g * g)
    long = df.select(F.floor(F.col(feature) * bins).cast("int").alias("f"), (F.col("y") - 1.5).alias("g"))
    return hist, splits.histogram(long, ["f"], F.lit(0), F.col("g"), F.lit(1.0), squares=True)


@pytest.mark.parametrize("kw", [{}, {"lambda_l2": 3.0, "min_data_in_leaf": 40}, {"lambda_l1": 5.0}, {"dro_radius": 0.3, "lambda_l2": 1.0}])
def test_training_splits_equal_the_scan(spark, kw):
    for feature in ("a", "b"):  # b has missing values
        hist, long = histogram_of(table(spark), feature)
        p = boosting.Params(**kw)
        got = boosting.best_split(hist, p, np.array([0]), [8], [False])
        scan = splits.scan(long, p.lambda_l1, p.lambda_l2, p.dro_radius, p.min_data_in_leaf)
        want = scan.orderBy(F.desc(F.round("gain", 9)), F.desc("default_left"), "threshold").first()
        assert got[0] == pytest.approx(want.gain) and got[2] == want.threshold


def test_training_categorical_splits_equal_the_scan(spark):
    df = table(spark).withColumn("k", F.floor(F.col("a") * 7) * 5 % 7)
    hist, long = histogram_of(df.withColumn("k", F.col("k") / 8), "k")
    got = boosting.best_split(hist, boosting.Params(), np.array([0]), [8], [True])
    want = splits.scan_categorical(long).orderBy(F.desc("gain")).first()
    assert got[0] == pytest.approx(want.gain) and got[4] == want.left


def test_training_morph_gains_equal_the_scan(spark):
    hist, long = histogram_of(table(spark))
    s = Schedule(Morph(warmup=0, info_weight=0.4, pressure=0.0), 10, np.full(10, 0.1), moments={0: (0.1, 0.8)})
    r, total = 5, hist[0].sum(0)
    left = np.cumsum(hist[0, :8], 0)[:-1]
    term = lambda x: x[..., 0] ** 2 / (x[..., 1] + 1e-6)
    got = s.gain(r, 0, term(left) + term(total - left) - term(total), total, left, total - left, 0.0)
    want = splits.morph(splits.scan(long), 0.1, 0.8, 0.4 * np.tanh(1.5), 1.0).filter("default_left").orderBy("threshold").collect()
    assert np.allclose(got, [w.gain for w in want], atol=1e-9)


def test_training_histograms_equal_the_aggregate(spark):
    df = table(spark)
    binner = boosting.fit_binner(df, ["a", "b", "c"], ["c"], boosting.Params(max_bins=8))
    state = boosting.prepare(df, binner, "y", None, None, "id").withColumn("s", F.array(F.lit(0.0)))
    tree = boosting.Tree()
    tree.add(0.0, 0.0)
    job = boosting.Job(boosting.Params(), 1, [], [tree], 0)
    rows = state.mapInArrow(lambda it: job.histogram(it, [(0, 0)], 9, 0, 3), boosting._HIST).filter("node = 0").groupBy("feature", "bin").agg(*(F.sum(F.col("sums")[i]).alias(f"c{i}") for i in range(4))).collect()
    x = state.select(*(F.nullif(F.col("bins")[i], F.lit(-1)).alias(f"f{i}") for i in range(3)), (-F.col("y")).alias("g"))
    want = splits.histogram(x, ["f0", "f1", "f2"], F.lit(0), F.col("g"), F.lit(1.0), squares=True).collect()
    key = lambda f, b: (int(f), 8 if b is None else int(b))
    a = {key(r.feature, r.bin): (r.c0, r.c1, r.c2, r.c3) for r in rows}
    b = {key(r.feature[1], r.bin): (r.sg, r.sh, r.n, r.sq) for r in want}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def brute_pairs(p, y, weight=lambda i, j: 1.0):
    g, h = np.zeros(len(p)), np.zeros(len(p))
    for i in range(len(p)):
        for j in range(len(p)):
            if y[i] > y[j]:
                rho, w = 1 / (1 + np.exp(p[i] - p[j])), weight(i, j)
                g[i] -= rho * w
                g[j] += rho * w
                h[i] += rho * (1 - rho) * w
                h[j] += rho * (1 - rho) * w
    return g, np.maximum(h, losses.FLOOR)


def test_ranking_gradients_equal_brute_force(monkeypatch):
    monkeypatch.setattr(losses, "PAIR_ROWS", 7)
    rng = np.random.default_rng(52)
    p, y = rng.normal(size=20), rng.integers(0, 4, 20).astype(float)
    assert all(np.allclose(a, b) for a, b in zip(losses.group_gradients("rank:pairwise", p, y, {}), brute_pairs(p, y)))
    gain, ideal = 2**y - 1, (np.sort(2**y - 1)[::-1] / np.log2(np.arange(20) + 2)).sum()
    turns = [1 / np.log2(losses._ranks(p + losses._noise(20, 3, 5, t)) + 2.0) for t in range(10)]
    want = brute_pairs(p, y, lambda i, j: np.mean([abs((gain[i] - gain[j]) * (d[i] - d[j])) for d in turns]) / ideal)
    assert all(np.allclose(a, b) for a, b in zip(losses.group_gradients("rank:yeti", p, y, {"seed": 3}, 5), want))
    assert np.abs(losses._noise(500, 1, 2, 3)).max() <= 0.5 and losses.group_gradients("rank:ndcg", p, np.zeros(20), {})[0].any() == False  # noqa: E712


def test_groups_are_cut_whole():
    batches = [pa.RecordBatch.from_pydict({"grp": g, "v": list(range(len(g)))}) for g in ([1, 1, 2], [2, 2], [2], [], [3], [4, 4, 5])]
    tables = list(ranking.whole_groups(iter(batches)))
    assert [t.column("grp").to_pylist() for t in tables] == [[1, 1], [2, 2, 2, 2], [3], [4, 4], [5]]


def test_places_in_an_order_by_counting(spark, monkeypatch):
    rng = np.random.default_rng(53)
    v = np.concatenate([rng.normal(size=300), np.full(200, 0.25), [1e300, -1e300, 5e-324, 0.0]])
    df = spark.createDataFrame([(float(x), i) for i, x in enumerate(v)], "v double, i long").repartition(5).cache()
    for cells, few in ((4096, 10_000), (4096, 0), (3, 5), (3, 0)):
        monkeypatch.setattr(sampling, "CELLS", cells)
        monkeypatch.setattr(sampling, "FEW_VALUES", few)
        for k in (1, 2, 100, 250, 400, len(v)):
            at, below = sampling.kth(df, "v", k)
            assert at == np.sort(v)[k - 1] and below == (v < at).sum()
    assert sampling.kth(df, "v", 0) is None and sampling.kth(df.limit(0), "v", 1) is None
    got = sampling.smallest_hashes(df, F.col("i") % 7, "i", 0.3)
    assert {r.i for r in got.collect()} == set(sorted(range(len(v)), key=lambda i: (i % 7, i))[: int(np.ceil(len(v) * 0.3))])


def test_rows_are_drawn_in_exact_counts_however_they_are_dealt(spark):
    df = table(spark)
    seen = []
    for n in (1, 7):
        binner = boosting.fit_binner(df, ["a", "b"], [], boosting.Params(max_bins=8))
        state = boosting.prepare(df.repartition(n), binner, "y", None, None, "id").withColumn("s", F.array(F.lit(1.5)))
        drawn = []
        for p in (boosting.Params(row_subsample=0.37, seed=4), boosting.Params(boosting_mode="goss", goss_top_rate=0.2, goss_other_rate=0.1, seed=4)):
            job = boosting.Job(p, 1, [], [], 2, boosting._drawn(state, p, 1, [], 2, None))
            rows = state.mapInArrow(lambda it, job=job: (pa.RecordBatch.from_arrays([t.column("rid").combine_chunks(), pa.array(h[:, 0])], names=["i", "h"]) for _, _, h, t in job.parts(it)), "i long, h double").collect()
            drawn.append(sorted((r.i, r.h) for r in rows))
        assert len(drawn[0]) == int(np.ceil(400 * 0.37)) and len(drawn[1]) == 80 + 40
        weights = {h for _, h in drawn[1]}
        assert weights == {1.0, 320 / 40} and sum(h for _, h in drawn[1]) == 400
        seen.append(drawn)
    assert seen[0] == seen[1]


def test_early_stopping_on_a_table(spark):
    df = table(spark)
    p = boosting.Params(n_estimators=12, max_depth=3, learning_rate=1.0, early_stopping_rounds=2)
    valid = df.withColumn("y", -F.col("y"))  # every round makes it worse
    m = boosting.fit(df, ["a", "b"], "y", p, valid=valid)
    assert len(m.trees) == m.best_iteration == 1 and m.history[-1]["stopped"] == "early" and len(m.history) == 3
    good = boosting.fit(df, ["a", "b"], "y", boosting.Params(n_estimators=4, max_depth=2, learning_rate=0.5), valid=df)
    want = [metrics.rmse(boosting.Model(good.params, good.binner, good.base, good.trees[: i + 1]).transform(df), "y", "prediction").first()[0] ** 2 for i in range(4)]
    assert [r["valid_loss"] for r in good.history] == pytest.approx(want)


@pytest.mark.parametrize("kw", [{"dart_normalize": "forest"}, {"dart_sample": "weighted", "dart_max_drop": 2}])
def test_dart_scores_follow_changed_weights(spark, monkeypatch, kw):
    df = table(spark)
    p = boosting.Params(n_estimators=9, max_depth=2, learning_rate=0.5, boosting_mode="dart", dart_drop_rate=0.5, **kw)
    often = boosting.fit(df, ["a", "b"], "y", p)
    monkeypatch.setattr(boosting, "SCORE_EVERY", 1)
    always = boosting.fit(df, ["a", "b"], "y", p)
    assert [t.weight for t in often.trees] == [t.weight for t in always.trees] and len({t.weight for t in often.trees}) > 2
    assert [t.threshold for t in often.trees] == [t.threshold for t in always.trees]
    for a, b in zip(often.trees, always.trees):
        assert np.allclose(a.value, b.value)


def test_sums_in_tiles_change_nothing(spark, monkeypatch):
    df, p = table(spark), boosting.Params(n_estimators=2, max_depth=3, learning_rate=0.5, max_bins=16)
    whole = boosting.fit(df, ["a", "b", "c"], "y", p, categorical=["c"])
    monkeypatch.setattr(boosting, "TILE_BYTES", 8 * 17 * 4)
    tiled = boosting.fit(df, ["a", "b", "c"], "y", p, categorical=["c"])
    assert [(t.feature, t.threshold) for t in whole.trees] == [(t.feature, t.threshold) for t in tiled.trees]


def test_linear_leaves(spark):
    df = table(spark).withColumn("y", F.when(F.col("a") > 0.5, 4 * F.col("a")).otherwise(-2 * F.col("a")) + F.coalesce("b", F.lit(0.0)))
    fits = {}
    for name, kw in (("constant", {}), ("linear", {"leaf_model": "linear"}), ("rescored", {"leaf_model": "linear", "pl_split_candidates": 2})):
        m = fits[name] = boosting.fit(df, ["a", "b", "c"], "y", boosting.Params(n_estimators=3, max_depth=2, learning_rate=0.7, lambda_l2=0.1, **kw), categorical=["c"])
        fits[name + "_rmse"] = metrics.rmse(m.transform(df), "y", "prediction").first()[0]
    spread = df.agg(F.stddev_pop("y")).first()[0]  # a leaf's constant and its weights are solved apart, so neither kind of leaf is always the better one
    assert max(fits["linear_rmse"], fits["rescored_rmse"], fits["constant_rmse"]) < 0.5 * spread
    m = fits["linear"]
    assert m.is_linear and all(f != 2 for t in m.trees for feats, _ in t.linear.values() for f in feats)
    again = model_files.loads(model_files.dumps(m))
    assert [r.prediction for r in again.transform(df).orderBy("id").collect()] == [r.prediction for r in m.transform(df).orderBy("id").collect()]
    assert explain.verify(m, df).count() == 0 and explain.verify(fits["constant"], df).count() == 0


def test_linear_solves_equal_least_squares():
    rng = np.random.default_rng(54)
    x, g, h = rng.normal(size=(50, 3)), rng.normal(size=50), rng.uniform(0.5, 2, 50)
    xg, hx = x.T @ g, (x * h[:, None]).T @ x
    want = -np.linalg.solve(hx + 0.3 * np.eye(3), xg)
    assert np.allclose(boosting.linear_weights(xg, hx, 0.3), want)
    assert boosting.linear_gain(xg, hx, 0.3) == pytest.approx(-0.5 * xg @ want)
    assert not boosting.linear_weights(np.ones(2), np.diag([1.0, 1e9]), 0.0).any() and boosting.linear_gain(np.ones(1), np.zeros((1, 1)), 0.0) == 0
    bins = rng.integers(0, 4, 50)
    each = np.hstack([x * g[:, None], (x[:, :, None] * x[:, None, :]).reshape(50, 9) * h[:, None], x * h[:, None]])
    sums = np.stack([each[bins == b].sum(0) for b in range(4)] + [np.zeros(15)])
    hist = np.stack([[g[bins == b].sum(), h[bins == b].sum(), (bins == b).sum(), 0] for b in range(4)] + [np.zeros(4)])

    def reduction(m):
        c = -g[m].sum() / (h[m].sum() + 0.3 + 1e-6)
        w = boosting.linear_weights(x[m].T @ g[m], (x[m] * h[m, None]).T @ x[m], 0.3)
        u = c + x[m] @ w
        return (-g[m] * u - h[m] * u * u / 2).sum() - 0.15 * (c * c + w @ w)

    pure = lambda m: boosting.linear_gain(x[m].T @ g[m], (x[m] * h[m, None]).T @ x[m], 0.3)
    k = int(np.argmax([pure(bins <= b) + pure(bins > b) for b in range(3)]))
    gain, at, _ = boosting.linear_split(sums, hist, 4, 3, boosting.Params(lambda_l2=0.3))
    assert at == k and gain == pytest.approx(reduction(bins <= k) + reduction(bins > k) - reduction(bins >= 0))


def test_projection_and_weights(spark):
    df = table(spark).na.drop().withColumn("f", F.col("a") * 2 - 1)
    m = boosting.fit(df, ["a", "b"], "y", boosting.Params(n_estimators=3, max_depth=3, learning_rate=0.5, neutralization="per_round_gradient"), factors=["f"])
    plain = boosting.fit(df, ["a", "b"], "y", boosting.Params(n_estimators=3, max_depth=3, learning_rate=0.5))
    tied = lambda m: abs(m.transform(df).agg(F.corr("prediction", "f")).first()[0])
    assert tied(m) < 0.5 * tied(plain) and 0 < m.history[0]["neutralized"] <= 1
    only = boosting.fit(df, ["a", "b"], "y", boosting.Params(n_estimators=2, max_depth=2, feature_weights=(0.0, 1.0)))
    assert {f for t in only.trees for f, left in zip(t.feature, t.left) if left >= 0} == {1}
    refined = boosting.fit(df, ["a"], "y", boosting.Params(n_estimators=1, max_depth=2, learning_rate=1.0, row_subsample=0.3, refine_leaves=True), row_id="id")
    for r in refined.transform(df).groupBy("prediction").agg(F.avg("y").alias("m")).collect():
        assert r.prediction == pytest.approx(r.m)
    with pytest.raises(ValueError):
        boosting.fit(df, ["a"], "y", boosting.Params(neutralization="split_penalty"))


def test_monotone_projection():
    t = boosting.Tree()
    for v in (0.0, 1.0, -1.0, 3.0, 0.5):
        t.add(v, 1.0)
    t.feature[0], t.left[0], t.right[0] = 0, 1, 2
    t.feature[1], t.left[1], t.right[1] = 1, 3, 4
    up = monotone.project(t, {0: 1})
    assert up.value[1] <= up.value[2] and max(up.value[3], up.value[4]) <= up.value[2]
    with pytest.raises(ValueError):
        monotone.validate([t], {0: 1})
    monotone.validate([up], {0: 1})
    assert monotone.project(t, {}).value == t.value and monotone.project(t, {}, 0.75).value == [0.0, 0.75, -0.75, 0.75, 0.5]


def test_warm_start_checks_monotone_trees(spark):
    df = table(spark)
    down = boosting.fit(df.withColumn("y", -F.col("a")), ["a"], "y", boosting.Params(n_estimators=1, max_depth=2))
    with pytest.raises(ValueError):
        boosting.fit(df, ["a"], "y", boosting.Params(n_estimators=1, monotone={0: 1}), warm=down)


@pytest.mark.parametrize("kw", [{}, {"tree_growth": "leaf", "max_leaves": 5}, {"boosting_mode": "goss"}, {"boosting_mode": "dart", "dart_drop_rate": 0.5}, {"morph": Morph(warmup=1)}, {"dro_radius": 0.05, "row_subsample": 0.8}, {"neutralization": "per_round_gradient"}])
def test_joint_modes(spark, kw):
    df = table(spark).withColumn("z", F.col("a") * 3 - F.coalesce("b", F.lit(0.5))).withColumn("one", (F.col("a") > 0.6).cast("int")).withColumn("q", F.col("id") % 20).withColumn("rel", F.floor(F.col("a") * 4))
    names, kinds = ["y", "z", "one", "rel"], ["squared_error", "quantile", "binary", "rank:ndcg"]
    p = boosting.Params(n_estimators=5, max_depth=3, learning_rate=0.5, **kw)
    m = joint.fit(df, ["a", "b", "c"], names, kinds, p, group="q", categorical=["c"], factors=["id"], row_id="id")
    out = m.transform(df.withColumn("prediction", F.lit("old")))
    base = df.agg(F.stddev_pop("y")).first()[0]
    if not kw.get("neutralization"):
        assert metrics.rmse(out.withColumn("p", F.col("prediction")[0]), "y", "p").first()[0] < 0.7 * base
    r = out.select(F.min(F.col("prediction")[2]), F.max(F.col("prediction")[2])).first()
    assert 0 <= r[0] < r[1] <= 1
    binned = out.limit(20)
    for k, one in enumerate(m.unroll()):
        got = one.transform(binned).select(F.col("prediction")) if kinds[k] != "binary" else None
        if got is not None:
            assert got.count() == 20
    again = model_files.loads_joint(model_files.dumps_joint(m))
    assert again.transform(df).select("prediction").collect() == m.transform(df).select("prediction").collect()
    more = joint.fit(df, ["a", "b", "c"], names, kinds, boosting.Params(n_estimators=1, max_depth=2), group="q", categorical=["c"], warm=m)
    assert len(more.trees) == len(m.trees) + 1


def test_joint_refuses_what_it_cannot_do(spark):
    df = table(spark)
    for kinds, kw in ((["squared_error"], {}), (["rank:ndcg", "binary"], {}), (["squared_error"] * 2, {"leaf_model": "linear"})):
        with pytest.raises(ValueError):
            joint.fit(df, ["a"], ["y", "a"], kinds, boosting.Params(**kw))


def test_multi_label(spark):
    df = table(spark).withColumn("z", F.col("a") * 3).withColumn("q", F.col("id") % 10)
    for mode in ("independent", "joint"):
        fitted = MultiLabelRanker(["y", "z"], ["a", "b"], "squared_error", mode, n_estimators=3, max_depth=2, learning_rate=0.5).fit(df)
        out = fitted.transform(df).withColumn("p", F.col("prediction")[1])
        assert metrics.rmse(out, "z", "p").first()[0] < 0.5 and len(out.first().prediction) == 2
        assert fitted.shap_values(df.limit(5), 1).count() == 5
    with pytest.raises(ValueError):
        MultiLabelRanker(["y"], ["a"], mode="both")


def test_policy():
    p = boosting.Params(n_estimators=500)
    assert policy.automatic(p, 500, 10, 2.0, 1.0).n_estimators == 96 and policy.automatic(p, 500, 10, 5.0, 1.0).lambda_l2 == 2.0
    big = policy.automatic(p, 20_000, 300, 1.0, 0.5)
    assert (big.min_data_in_leaf, big.min_split_gain, big.row_subsample, big.col_subsample) == (16, 0.0001, 0.8, 0.5)
    assert policy.automatic(boosting.Params(objective="rank:ndcg"), 3000, 40, 1.0, 0.05).min_split_gain == 0 and policy.automatic(p, 3000, 40, 1.0, 0.05).min_split_gain == 0.001
    assert policy.automatic(boosting.Params(row_subsample=0.5), 3000, 4, 1.0, 1.0).row_subsample == 0.5 and policy.automatic(p, 500, 10, 0.5, 1.0) == p


def test_estimators_with_validation_encoding_and_policy(spark):
    df = table(spark).withColumn("kind", F.concat(F.lit("k"), (F.col("id") % 60).cast("string"))).withColumn("y", F.col("y") + F.col("id") % 60 / 10)
    fitted = BoostedRegressor("y", ["a", "b", "kind"], encode=["kind"], policy="auto", valid=df, n_estimators=8, max_depth=3, learning_rate=0.5, early_stopping_rounds=3).fit(df)
    out = fitted.transform(df.withColumn("kind", F.when(F.col("id") == 0, "unseen").otherwise(F.col("kind"))))
    assert out.filter("kind = 'unseen'").count() == 1 and fitted.score(df) > 0.6 and fitted.best_iteration_ >= 1 and fitted.diagnostics_per_round_[0]["gradient_norm"] > 0
    k = table(spark).select("a", F.floor(F.col("a") * 3).cast("int").alias("k"))
    c = BoostedClassifier("k", ["a"], n_estimators=5, max_depth=2, learning_rate=0.5).fit(k)
    assert c.score(k) > 0.9 and c.classes_ == [0, 1, 2] and c.feature_names_in_ == ["a"]
    assert c.predict_log_proba(k).filter(F.exists("log_probability", lambda x: x > 0)).count() == 0
    for kw in ({"early_stopping_rounds": 2}, {"policy": "odd"}, {"valid": df, "factors": ["a"]}):
        with pytest.raises(ValueError):
            BoostedRegressor("y", **kw)


def test_custom_objectives(spark):
    df = table(spark).na.drop()
    own = {"custom": lambda y, p: (p - y, np.ones_like(p)), "custom_loss": lambda y, p: np.mean((p - y) ** 2)}
    m = boosting.fit(df, ["a", "b"], "y", boosting.Params(n_estimators=3, max_depth=2, learning_rate=0.5, options=own), valid=df)
    same = boosting.fit(df, ["a", "b"], "y", boosting.Params(n_estimators=3, max_depth=2, learning_rate=0.5))
    assert [t.threshold for t in m.trees][0] == [t.threshold for t in same.trees][0] and m.history[-1]["valid_loss"] < m.history[0]["valid_loss"]
    est = BoostedRegressor("y", ["a", "b"], n_estimators=1, options=own)
    assert est.objective_name == "custom" and BoostedRegressor("y").objective_name == "squared_error"
    with pytest.raises(ValueError):
        model_files.dumps(m)
    assert pickle.loads(pickle.dumps(m)).params.options == {}


def test_bad_tables_are_refused(spark):
    df = table(spark)
    for bad in (df.limit(0), df.withColumn("y", F.when(F.col("id") > 5, F.col("y")))):
        with pytest.raises(ValueError):
            boosting.fit(bad, ["a"], "y", boosting.Params())
    with pytest.raises(ValueError):
        boosting.fit(df.withColumn("w", F.lit(None).cast("double")), ["a"], "y", boosting.Params(), weight="w")
    m = boosting.fit(df, ["a"], "y", boosting.Params(n_estimators=1))
    assert m.transform(m.transform(df)).columns.count("prediction") == 1 and m.transform(df.limit(0)).count() == 0
    d = json.loads(model_files.dumps(m))
    assert model_files.compatibility(d) == [] and model_files.compatibility(d | {"x": 1}) == ["x is unknown"] and model_files.compatibility(d | {"x": 1}, strict=False) == []
    for wrong in (d | {"format": 9}, {k: v for k, v in d.items() if k != "trees"}):
        with pytest.raises(ValueError):
            model_files.loads(json.dumps(wrong))
    assert model_files.scoring_only(m).history == []


def test_sources(spark, tmp_path):
    df = table(spark)
    df.select("id", "a").coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    assert frames.read_csv(spark, str(tmp_path / "c"), "id long, a double").count() == 400
    df.write.json(str(tmp_path / "j"))
    assert frames.read(spark, str(tmp_path / "j"), "json").count() == 400
    assert dict(frames.check_time(df.withColumn("t", F.col("id").cast("double")), "t").dtypes)["t"] == "bigint"
    for bad in (df.withColumn("t", F.col("a")), df.withColumn("t", F.lit("x")), df.withColumn("t", F.lit(None).cast("int"))):
        with pytest.raises(ValueError):
            frames.check_time(bad, "t")
    with pytest.raises(ValueError):
        frames.check_group(df.withColumn("g", F.lit(None).cast("int")), "g")
    frames.check_group(df, "id")
    with pytest.raises(ValueError):
        frames.groups_from_sizes(df, "id", spark.createDataFrame([(0, 399)], "group long, size long"))
    with pytest.raises(ValueError):
        validation.split_by_time(df.withColumn("t", F.lit(1)), "t", 0.5)


def test_bundles(spark):
    rows = [tuple(int(i % 10 == k) * (1 + i % 3) for k in range(3)) + (i % 2, int(i % 10 == 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, c int, dense int, clash int")
    b = bundling.discover(df, ["a", "b", "c", "dense"])
    assert b.groups == [["a", "b", "c"]]
    got = df.withColumn("s", bundling.stored(b, b.groups[0])).select("a", "b", "c", *(bundling.decoded(b, c, F.col("s")).alias(f"d{c}") for c in "abc")).collect()
    assert all((r.a, r.b, r.c) == (r.da, r.db, r.dc) for r in got)
    assert bundling.discover(df, ["a", "clash", "b", "c"]).groups == [] and bundling.discover(df.limit(0), ["a", "b"]).groups == []


def test_fingerprint(spark):
    df = table(spark).na.drop().withColumn("y", (F.col("a") - 0.5) ** 2)
    f = policy.fingerprint(df, ["a", "b"], "y")
    assert 0 < f["complexity"] < 0.5 and f["non_linearity"] >= 0 and f["suggested_max_depth"] == 8
    binner = boosting.fit_binner(df, ["a", "b"], [], boosting.Params(max_bins=16))
    assert policy.density(df, binner) == pytest.approx(1.0)


def test_orders_in_ranges_equal_one_order(spark, monkeypatch):
    df = table(spark).withColumn("w", F.col("id") % 4 + 0.5)
    made = lambda: [sorted(map(tuple, x.collect())) for x in (binning.quantile_cuts(df, ["a", "b"], 9), binning.weighted_cuts(df, ["a", "b"], "w", 9), binning.bin_rank(df.select("id", "b"), "b", 20, "r").na.fill(-1), binning.group_quantile(df, ["c"], F.col("a"), 0.4, F.col("w")))]
    one = made()
    monkeypatch.setattr(binning, "FEW_VALUES", 0)
    monkeypatch.setattr(frames, "FETCHED_ROWS", 0)
    assert made() == one
    rows = df.select("a", "w").collect()
    x, w = np.array([r.a for r in rows]), np.array([r.w for r in rows])
    by = np.argsort(x)
    past, total = np.cumsum(w[by]), w.sum()
    want = sorted({x[by][np.searchsorted(past, q * total / 9, side="right")] for q in range(1, 9)})
    assert [c for f, c in one[1] if f == "a"] == want
    whole = binning.weighted_cuts(df.withColumn("w", F.col("id") % 3).filter("id < 5"), ["a"], "w", 100).count()
    assert whole <= 3


@pytest.mark.parametrize("kind", boosting.BINNINGS)
def test_binnings(spark, kind):
    df = table(spark).withColumn("a", F.floor(F.col("a") * 20) if kind == "prebinned" else F.exp(F.col("a") * 40))
    p = boosting.Params(binning=kind, max_bins=32, n_estimators=4, max_depth=3, learning_rate=0.5)
    b = boosting.fit_binner(df, ["a"], [], p)
    v = np.array([r.a for r in df.select("a").collect()], float)
    bins = b.transform([pa.array(v)])[:, 0]
    if kind == "prebinned":
        assert (bins == v).all()
    elif kind in ("rank", "linear_rank"):  # the tail stretches the range, so ranks are taken
        want = np.floor((np.searchsorted(np.sort(v), v, side="right") - 1) * 31 / (len(v) - 1) + 0.5)
        assert len(set(zip(bins, want))) == len(set(bins)) == len(set(want))
    elif kind == "linear":
        assert (bins == np.floor((v - v.min()) / (v.max() - v.min()) * 31 + 0.5)).all()
    assert metrics.rmse(boosting.fit(df, ["a", "c"], "y", p, categorical=["c"]).transform(df), "y", "prediction").first()[0] < (1.7 if kind == "linear" else 0.6)
    with pytest.raises(ValueError):
        boosting.Params(binning="odd").check()
    if kind == "prebinned":
        with pytest.raises(ValueError):
            boosting.fit_binner(table(spark), ["a"], [], p)
