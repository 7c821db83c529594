"""Registered fits of one tree, held against SQL that grows the same tree: the whole path of training under a check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators import neutralize
from arborlake.plans import boosting, explain, joint, model_files
from arborlake.plans.registry import register, table

FEATURES = ["f0", "f1", "f2"]
_ROWS = """x AS (SELECT o_orderkey AS k, o_totalprice AS f0, (o_custkey % 40)::DOUBLE AS f1, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 11 END::DOUBLE AS f2, (o_orderkey % 3 + 1)::DOUBLE AS w,
        (o_custkey % 40) * 2 + o_totalprice / 20000 + CASE WHEN o_orderkey % 7 = 0 THEN 25 ELSE 0 END AS t, (o_orderkey % 5 - 2)::DOUBLE AS e FROM orders)"""


def rows(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("k"), F.col("o_totalprice").alias("f0"), (c % 40).cast("double").alias("f1"), F.when(k % 7 != 0, k % 11).cast("double").alias("f2"), (k % 3 + 1).cast("double").alias("w"),
        ((c % 40) * 2 + F.col("o_totalprice") / 20000 + F.when(k % 7 == 0, 25).otherwise(0)).alias("t"), (k % 5 - 2).cast("double").alias("e"),
    )


@dataclass(frozen=True)
class Grown:
    """The SQL of a tree: target, start value, gradient and hessian (of ``base``, ``y``, ``w``), and settings as in ``boosting.Params``."""

    y: str
    base: str
    g: str
    h: str
    depth: int = 2
    bins: int = 12
    rate: float = 0.5
    l1: float = 0.0
    l2: float = 1.0
    radius: float = 0.0
    project: bool = False
    penalty: float = 0.0

    def effective(self, s: str) -> str:
        t = f"{self.l1} + {self.radius} * sqrt({s}n) * sqrt(greatest({s}q / {s}n - ({s}g / {s}n) * ({s}g / {s}n), 0))" if self.radius else f"{self.l1}"
        return f"(sign({s}g) * greatest(abs({s}g) - ({t}), 0))"

    def term(self, s: str) -> str:
        return f"pow({self.effective(s)}, 2) / ({s}h + {self.l2} + 1e-6)"

    def leaf(self, s: str) -> str:
        return f"(-{self.effective(s)} / ({s}h + {self.l2} + 1e-6))"

    def level(self, d: int) -> str:
        cols = ("g", "h", "n", "q", "e")
        load = f" - {self.penalty} * pow(le * {self.leaf('l')} + re * {self.leaf('r')}, 2) / tn" if self.penalty else ""
        return f"""h{d} AS (SELECT node, f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n, sum(g * g) AS q, sum(e) AS e FROM n{d} JOIN l USING (k) GROUP BY node, f, bin),
        s{d} AS (SELECT *, {", ".join(f"sum({c}) OVER p AS t{c}, coalesce(sum({c}) FILTER (bin IS NULL) OVER p, 0) AS m{c}, sum(CASE WHEN bin IS NULL THEN 0 ELSE {c} END) OVER r AS c{c}" for c in cols)} FROM h{d}
              WINDOW p AS (PARTITION BY node, f), r AS (PARTITION BY node, f ORDER BY bin NULLS FIRST ROWS UNBOUNDED PRECEDING)),
        e{d} AS (SELECT node, f, bin, dl, {", ".join(f"t{c}, c{c} + CASE WHEN dl THEN m{c} ELSE 0 END AS l{c}" for c in cols)} FROM s{d}, (VALUES (true), (false)) v(dl) WHERE bin IS NOT NULL AND (dl OR mn > 0)),
        d{d} AS (SELECT *, {", ".join(f"t{c} - l{c} AS r{c}" for c in cols)} FROM e{d}),
        o{d} AS (SELECT node, f, bin, dl, {self.term("l")} + {self.term("r")} - {self.term("t")}{load} AS gain FROM d{d} WHERE ln > 0 AND rn > 0),
        b{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, dl DESC, bin) AS o FROM o{d} WHERE gain > 0) WHERE o = 1),
        n{d + 1} AS (SELECT n{d}.k, CASE WHEN b{d}.node IS NULL THEN n{d}.node WHEN coalesce(l.bin <= b{d}.bin, b{d}.dl) THEN 2 * n{d}.node + 1 ELSE 2 * n{d}.node + 2 END AS node, n{d}.g, n{d}.h, n{d}.e
              FROM n{d} LEFT JOIN b{d} USING (node) LEFT JOIN l ON l.k = n{d}.k AND l.f = b{d}.f)"""

    def sql(self, select: str, more: str = "") -> str:
        beta = "(SELECT sum(w * e * g) / (sum(w * e * e) + 1e-6) FROM r0)" if self.project else "0"
        return f"""WITH {_ROWS}, y AS (SELECT *, {self.y} AS y FROM x), z AS (SELECT {self.base} AS base FROM y),
        v AS (SELECT k, unnest([{", ".join(f"{{'f': {i}, 'v': {c}}}" for i, c in enumerate(FEATURES))}], recursive := true) FROM x),
        i AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY f) AS n FROM v WHERE v IS NOT NULL),
        c AS (SELECT DISTINCT f, v AS cut FROM i, range(1, {self.bins}) q(q) WHERE i.i = (q.q * n) // {self.bins}),
        l AS (SELECT k, v.f, CASE WHEN v IS NULL THEN NULL ELSE count(*) FILTER (cut <= v) END AS bin FROM v LEFT JOIN c ON c.f = v.f GROUP BY k, v.f, v),
        r0 AS (SELECT k, w, e, {self.g} AS g, {self.h} AS h FROM y, z),
        n0 AS (SELECT k, 0 AS node, g - {beta} * e AS g, h, e FROM r0),
        {", ".join(self.level(d) for d in range(self.depth))},
        a AS (SELECT node, sum(g) AS g, sum(h) AS h, count(*) AS n, sum(g * g) AS q FROM n{self.depth} GROUP BY node),
        leaf AS (SELECT node, n, {self.rate} * {self.leaf("")} AS value FROM a), out AS (SELECT k, node, value FROM n{self.depth} JOIN leaf USING (node)){more}
        {select}"""


def _tree(name: str, sql: Grown, y, objective: str, link: str = "base + value", digits: int = 6, **params) -> None:
    def query(spark, d):
        x = rows(spark, d).withColumn("y", y())
        if name == "fit_neutralized":  # the factor's part is taken out of the target before the fit
            x = x.withColumn("y", neutralize.residual(x, F.col("y"), ["e"], F.col("w")))
        group = "grp" if objective.startswith("rank:") else None
        x = x.withColumn("grp", F.floor(F.col("k") / 12)) if group else x
        p = boosting.Params(objective=objective, n_estimators=1, max_depth=sql.depth, learning_rate=sql.rate, max_bins=sql.bins, lambda_l1=sql.l1, lambda_l2=sql.l2, dro_radius=sql.radius, **params)
        m = boosting.fit(x, FEATURES, "y", p, weight=None if group else "w", group=group, classes=[0, 1] if objective == "binary" else None, factors=["e"] if p.neutralization != "none" else None, row_id="k")
        got = m.transform(x)
        return got.select("k", F.round(F.col("probability")[1] if objective == "binary" else F.col("prediction"), digits).alias("prediction"))

    query.__name__ = name
    register(sql.sql(f"SELECT k, round({link}, {digits}) AS prediction FROM out, z"))(query)


_MEAN = "sum(w * y) / sum(w)"
_tree("fit_tree_regression", Grown("t", _MEAN, "(base - y) * w", "w"), lambda: F.col("t"), "squared_error")
_tree("fit_tree_deep", Grown("t", _MEAN, "(base - y) * w", "w", depth=4, bins=20), lambda: F.col("t"), "squared_error")
_tree("fit_tree_robust", Grown("t", _MEAN, "(base - y) * w", "w", l1=50.0, l2=3.0, radius=0.2), lambda: F.col("t"), "squared_error")
_tree("fit_tree_binary", Grown("(t > 60)::INTEGER", f"ln({_MEAN} / (1 - {_MEAN}))", "(1 / (1 + exp(-base)) - y) * w", "1 / (1 + exp(-base)) * (1 - 1 / (1 + exp(-base))) * w"), lambda: (F.col("t") > 60).cast("int"), "binary", "1 / (1 + exp(-(base + value)))")
_tree("fit_tree_poisson", Grown("floor(t / 10)", f"ln({_MEAN})", "(exp(base) - y) * w", "exp(base) * exp(0.7::DOUBLE) * w"), lambda: F.floor(F.col("t") / 10), "poisson", "exp(base + value)")
_tree("fit_tree_gamma", Grown("t + 1", f"ln({_MEAN})", "(1 - y / exp(base)) * w", "y / exp(base) * w"), lambda: F.col("t") + 1, "gamma", "exp(base + value)")
_tree("fit_tree_projected_gradient", Grown("t + 3 * e", _MEAN, "(base - y) * w", "w", project=True), lambda: F.col("t") + 3 * F.col("e"), "squared_error", neutralization="per_round_gradient")
_tree("fit_tree_split_penalty", Grown("t + 3 * e", _MEAN, "(base - y) * w", "w", penalty=0.5), lambda: F.col("t") + 3 * F.col("e"), "squared_error", neutralization="split_penalty", factor_penalty=0.5)


_tree("fit_neutralized", Grown("t + 3 * e - e * (SELECT sum(w * e * (t + 3 * e)) / (sum(w * e * e) + 1e-6) FROM x)", _MEAN, "(base - y) * w", "w"), lambda: F.col("t") + 3 * F.col("e"), "squared_error")
_RANK = "(rank() OVER (PARTITION BY k // 12 ORDER BY y{}) - 1)"
_tree("fit_ranking_pairs", Grown("floor(t / 20)", "max(0.0)", f"0.5 * ({_RANK.format(' DESC')} - {_RANK.format('')})", f"greatest(0.25 * ({_RANK.format(' DESC')} + {_RANK.format('')}), 1e-7)"), lambda: F.floor(F.col("t") / 20), "rank:pairwise")


_SAVED = Grown("t", _MEAN, "(base - y) * w", "w", depth=3)


@register(_SAVED.sql("SELECT k, round(base + value, 6) AS prediction FROM out, z"))
def score_saved_model(spark, d):
    """Scores of a model that went through its file form."""
    x = rows(spark, d)
    m = boosting.fit(x, FEATURES, "t", boosting.Params(n_estimators=1, max_depth=3, learning_rate=0.5, max_bins=12, lambda_l2=1.0), weight="w", row_id="k")
    return model_files.loads(model_files.dumps(m)).transform(x).select("k", F.round("prediction", 6).alias("prediction"))


_QUANTILE = Grown("t", "(SELECT min(y) FROM (SELECT y, sum(w) OVER (ORDER BY y) AS past, sum(w) OVER () AS total FROM y) WHERE past >= 0.3 * total)", "CASE WHEN y > base THEN -0.3 ELSE 0.7 END * w", "w")


@register(_QUANTILE.sql("SELECT k, round(base + v, 6) AS prediction FROM out JOIN lq USING (node), (SELECT DISTINCT base FROM z) z", """,
        rs AS (SELECT n2.node, y - base AS r, w FROM n2 JOIN y USING (k), (SELECT DISTINCT base FROM z) z), rq AS (SELECT node, r, sum(w) OVER (PARTITION BY node ORDER BY r) AS past, sum(w) OVER (PARTITION BY node) AS total FROM rs),
        lq AS (SELECT node, 0.5 * min(r) AS v FROM rq WHERE past >= 0.3 * total GROUP BY node)""").replace("z AS (SELECT (SELECT min(y)", "z AS (SELECT DISTINCT (SELECT min(y)"))
def fit_quantile(spark, d):
    """A tree whose leaves are the weighted 0.3 quantiles of their residuals."""
    x = rows(spark, d)
    m = boosting.fit(x, FEATURES, "t", boosting.Params(objective="quantile", n_estimators=1, max_depth=2, learning_rate=0.5, max_bins=12, lambda_l2=1.0, options={"quantile_alpha": 0.3}), weight="w", row_id="k")
    return m.transform(x).select("k", F.round("prediction", 6).alias("prediction"))


_STUMP = Grown("t", _MEAN, "(base - y) * w", "w", depth=1)


@register(_STUMP.sql(f"""SELECT k, round(base + (SELECT sum(n * value) / sum(n) FROM leaf), 6) AS expected_value, {", ".join(f"round(CASE WHEN (SELECT f FROM b0) = {i} THEN value - (SELECT sum(n * value) / sum(n) FROM leaf) ELSE 0 END, 6) AS shap_{c}" for i, c in enumerate(FEATURES))} FROM out, z"""))
def shap_stump(spark, d):
    """Shapley values of one split: the leaf's value less the mean over the rows, all of it the split feature's."""
    x = rows(spark, d)
    m = boosting.fit(x, FEATURES, "t", boosting.Params(n_estimators=1, max_depth=1, learning_rate=0.5, max_bins=12, lambda_l2=1.0), weight="w", row_id="k")
    s = explain.shap_values(m, x)
    return s.select("k", F.round(F.col("expected_value")[0], 6).alias("expected_value"), *(F.round(F.col("shap")[0][i], 6).alias(f"shap_{c}") for i, c in enumerate(FEATURES)))


@register(_STUMP.sql(f"SELECT f.feature, round(CASE WHEN f.i = (SELECT f FROM b0) THEN (SELECT avg(abs(value - (SELECT sum(n * value) / sum(n) FROM leaf))) FROM out) ELSE 0 END, 6) AS importance FROM (VALUES {', '.join(f'({i}, {c!r})' for i, c in enumerate(FEATURES))}) f(i, feature)"))
def shap_importance(spark, d):
    """Mean absolute Shapley values of one split."""
    x = rows(spark, d)
    m = boosting.fit(x, FEATURES, "t", boosting.Params(n_estimators=1, max_depth=1, learning_rate=0.5, max_bins=12, lambda_l2=1.0), weight="w", row_id="k")
    return explain.importance(m, x).select("feature", F.round("importance", 6).alias("importance"))


@register(_STUMP.sql("SELECT k, round(base + value + coalesce(wt * sx, 0), 6) AS prediction FROM out JOIN sc USING (k) JOIN lw USING (node), z", """,
        m AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM v, b0 WHERE v.f = b0.f), sc AS (SELECT v.k, coalesce((v - mu) / sd, 0) AS sx FROM v, b0, m WHERE v.f = b0.f),
        lw AS (SELECT node, -0.5 * sum(sx * g) / (sum(sx * sx * h) + 1.0) AS wt FROM n1 JOIN sc USING (k) GROUP BY node)"""))
def fit_linear_leaves(spark, d):
    """A split whose leaves are linear in the split feature."""
    x = rows(spark, d)
    m = boosting.fit(x, FEATURES, "t", boosting.Params(n_estimators=1, max_depth=1, learning_rate=0.5, max_bins=12, lambda_l2=1.0, leaf_model="linear"), weight="w", row_id="k")
    return m.transform(x).select("k", F.round("prediction", 6).alias("prediction"))


@register(f"WITH {_ROWS}, m AS (SELECT sum(w * t) / sum(w) AS m FROM x) SELECT round(sum(w * (t - m) * (t - m)) / sum(w), 6) AS variance FROM x, m")
def target_variance(spark, d):
    from arborlake.plans.policy import target_variance as variance

    return rows(spark, d).agg(F.round(variance(F.col("t"), F.col("w")), 6).alias("variance"))


@register(f"""WITH {_ROWS}, m AS (SELECT {_MEAN.replace("y", "t")} AS base FROM x), g AS (SELECT (base - t) * w AS g, w AS h FROM x, m)
    SELECT round(sqrt(sum(g * g)), 4) AS gradient_norm, round(var_pop(g), 4) AS gradient_variance, round(sqrt(sum(h * h)), 4) AS hessian_norm, count(*)::DOUBLE AS n_rows, 3 AS features FROM g""")
def round_record(spark, d):
    """What a fit records of its first round."""
    m = boosting.fit(rows(spark, d), FEATURES, "t", boosting.Params(n_estimators=1, max_depth=1), weight="w", row_id="k")
    r = m.history[0]
    return spark.createDataFrame([(round(r["gradient_norm"], 4), round(r["gradient_variance"], 4), round(r["hessian_norm"], 4), r["rows"], r["features"])], "gradient_norm double, gradient_variance double, hessian_norm double, n_rows double, features int")


def _joint_sql(depth: int, penalty: float = 0.0) -> str:
    """Two outputs, t and 50 - f1 + 4 e: gains are summed, missing rows count as right and then go where more rows are."""
    term = lambda s: f"(pow({s}a, 2) + pow({s}b, 2)) / ({s}n + 1.0 + 1e-6)"
    load = f" - {penalty} * (pow(le * -la / (ln + 1.0 + 1e-6) + re * -ra / (rn + 1.0 + 1e-6), 2) + pow(le * -lb / (ln + 1.0 + 1e-6) + re * -rb / (rn + 1.0 + 1e-6), 2)) / tn" if penalty else ""
    cols = "abne"
    levels = ", ".join(f"""h{d} AS (SELECT node, f, bin, sum(a) AS a, sum(b) AS b, count(*) AS n, sum(e) AS e FROM n{d} JOIN l USING (k) GROUP BY node, f, bin),
        s{d} AS (SELECT *, {", ".join(f"sum({c}) OVER p AS t{c}, sum(CASE WHEN bin IS NULL THEN 0 ELSE {c} END) OVER r AS l{c}" for c in cols)}, coalesce(sum(n) FILTER (bin IS NULL) OVER p, 0) AS missing FROM h{d}
              WINDOW p AS (PARTITION BY node, f), r AS (PARTITION BY node, f ORDER BY bin NULLS FIRST ROWS UNBOUNDED PRECEDING)),
        d{d} AS (SELECT *, {", ".join(f"t{c} - l{c} AS r{c}" for c in cols)}, ln >= tn - ln - missing AS dl FROM s{d} WHERE bin IS NOT NULL),
        o{d} AS (SELECT node, f, bin, dl, {term("l")} + {term("r")} - {term("t")}{load} AS gain FROM d{d} WHERE rn - missing > 0),
        b{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) AS o FROM o{d} WHERE gain > 0) WHERE o = 1),
        n{d + 1} AS (SELECT n{d}.k, CASE WHEN b{d}.node IS NULL THEN n{d}.node WHEN coalesce(l.bin <= b{d}.bin, b{d}.dl) THEN 2 * n{d}.node + 1 ELSE 2 * n{d}.node + 2 END AS node, n{d}.a, n{d}.b, n{d}.e
              FROM n{d} LEFT JOIN b{d} USING (node) LEFT JOIN l ON l.k = n{d}.k AND l.f = b{d}.f)""" for d in range(depth))
    return f"""WITH {_ROWS}, y AS (SELECT k, t AS y1, 50 - f1 + 4 * e AS y2, e FROM x), z AS (SELECT avg(y1) AS m1, avg(y2) AS m2 FROM y),
        v AS (SELECT k, unnest([{", ".join(f"{{'f': {i}, 'v': {c}}}" for i, c in enumerate(FEATURES))}], recursive := true) FROM x),
        i AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY f) AS n FROM v WHERE v IS NOT NULL),
        c AS (SELECT DISTINCT f, v AS cut FROM i, range(1, 12) q(q) WHERE i.i = (q.q * n) // 12),
        l AS (SELECT k, v.f, CASE WHEN v IS NULL THEN NULL ELSE count(*) FILTER (cut <= v) END AS bin FROM v LEFT JOIN c ON c.f = v.f GROUP BY k, v.f, v),
        n0 AS (SELECT k, 0 AS node, m1 - y1 AS a, m2 - y2 AS b, e FROM y, z), {levels},
        leaf AS (SELECT node, 0.5 * -sum(a) / (count(*) + 1.0 + 1e-6) AS va, 0.5 * -sum(b) / (count(*) + 1.0 + 1e-6) AS vb FROM n{depth} GROUP BY node)
        SELECT k, round(m1 + va, 6) AS p1, round(m2 + vb, 6) AS p2 FROM n{depth} JOIN leaf USING (node), z"""


def _joint(spark, d, depth: int, **params) -> DataFrame:
    x = rows(spark, d).withColumn("y2", 50 - F.col("f1") + 4 * F.col("e"))
    p = boosting.Params(n_estimators=1, max_depth=depth, learning_rate=0.5, max_bins=12, lambda_l2=1.0, **params)
    m = joint.fit(x, FEATURES, ["t", "y2"], ["squared_error", "squared_error"], p, factors=["e"], row_id="k")
    return m.transform(x).select("k", F.round(F.col("prediction")[0], 6).alias("p1"), F.round(F.col("prediction")[1], 6).alias("p2"))


@register(_joint_sql(3))
def fit_joint_tree(spark, d):
    """One tree for two targets."""
    return _joint(spark, d, 3)


@register(_joint_sql(2, 0.5))
def fit_joint_split_penalty(spark, d):
    return _joint(spark, d, 2, neutralization="split_penalty", factor_penalty=0.5)
