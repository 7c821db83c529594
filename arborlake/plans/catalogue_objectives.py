"""Registered queries of ranking objectives and of losses; the ranking ones run the code of training."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.functions import objectives, ranking
from arborlake.plans.registry import register, table

_SCORED = """s AS (SELECT o_orderkey AS k, o_custkey AS grp, o_totalprice / 100000 - 2 AS p, substr(o_orderpriority, 1, 1)::INTEGER AS y, (o_orderkey % 3 + 1)::DOUBLE AS w FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p DESC, k) - 1 AS rank, row_number() OVER (PARTITION BY grp ORDER BY y DESC, k) - 1 AS best, max(p) OVER (PARTITION BY grp) - min(p) OVER (PARTITION BY grp) AS span FROM s),
    i AS (SELECT grp, sum((pow(2, y) - 1) / log2(best + 2)) AS ideal, sum((pow(2, y) - 1) / log2(rank + 2)) AS dcg FROM r GROUP BY 1)"""
_DELTA = "abs((pow(2, a.y) - pow(2, b.y)) * (1 / log2(a.rank + 2) - 1 / log2(b.rank + 2))) / ideal"


def _scored(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 100000 - 2).alias("p"), F.substring("o_orderpriority", 1, 1).cast("int").alias("y"), (F.col("o_orderkey") % 3 + 1).cast("double").alias("w"))


def _pairs(name: str, objective: str, weight: str, where: str = "true", factor: str = "1", **options) -> None:
    def query(spark, d):
        x = ranking.gradients(_scored(spark, d), objective, "o_custkey", "o_orderkey", "p", "y", **options)
        return x.select(F.col("tie").alias("o_orderkey"), (F.round("g", 8) + 0.0).alias("g"), F.round("h", 8).alias("h"))

    query.__name__ = name
    register(f"""WITH {_SCORED},
        pairs AS (SELECT a.k AS hi, b.k AS lo, a.grp, 1 / (1 + exp(a.p - b.p)) AS rho, {weight} AS wt FROM r a JOIN r b ON a.grp = b.grp AND a.y > b.y JOIN i ON i.grp = a.grp WHERE {where}),
        f AS (SELECT grp, sum(2 * rho * wt) AS total FROM pairs GROUP BY 1),
        e AS (SELECT hi AS k, grp, -rho * wt AS g, rho * (1 - rho) * wt AS h FROM pairs UNION ALL SELECT lo, grp, rho * wt, rho * (1 - rho) * wt FROM pairs),
        n AS (SELECT k, sum(g * {factor}) AS g, sum(h * {factor}) AS h FROM e JOIN f USING (grp) GROUP BY 1)
        SELECT s.k AS o_orderkey, round(coalesce(g, 0), 8) + 0.0 AS g, round(greatest(coalesce(h, 0), 1e-7), 8) AS h FROM s LEFT JOIN n USING (k)""")(query)


_pairs("grad_pairwise", "rank:pairwise", "1.0")
_pairs("grad_lambdamart", "rank:ndcg", _DELTA)
_pairs("grad_lambdamart_truncated", "rank:ndcg", _DELTA, "a.rank < 3 OR b.rank < 3", ranking_truncation=3)
_pairs("grad_lambdamart_normalized", "rank:ndcg", f"{_DELTA} / (CASE WHEN a.span > 0 THEN 0.01 + abs(a.p - b.p) ELSE 1 END)", factor="CASE WHEN total > 0 THEN log2(1 + total) / total ELSE 1 END", ranking_normalize=True)


@register(f"""WITH {_SCORED}, z AS (SELECT *, count(*) OVER w AS n, exp(p) / sum(exp(p)) OVER w AS q, exp(y) / sum(exp(y)) OVER w AS t FROM s WINDOW w AS (PARTITION BY grp))
    SELECT k AS o_orderkey, round(CASE WHEN n < 2 THEN 0 ELSE q - t END, 8) + 0.0 AS g, round(CASE WHEN n < 2 THEN 1e-7 ELSE greatest(q * (1 - q), 1e-7) END, 8) AS h FROM z""")
def grad_xendcg(spark, d):
    x = ranking.gradients(_scored(spark, d), "rank:xendcg", "o_custkey", "o_orderkey", "p", "y")
    return x.select(F.col("tie").alias("o_orderkey"), (F.round("g", 8) + 0.0).alias("g"), F.round("h", 8).alias("h"))


@register(f"""WITH {_SCORED}, e AS (SELECT sqrt(sum(w * (p - y) * (p - y)) / count(*)) AS v FROM s GROUP BY grp),
    z AS (SELECT *, count(*) OVER w AS n, ln(exp(p) / sum(exp(p)) OVER w) AS q, exp(y) / sum(exp(y)) OVER w AS t FROM s WINDOW w AS (PARTITION BY grp)), x AS (SELECT sum(CASE WHEN n < 2 THEN 0 ELSE -t * q END) AS v FROM z GROUP BY grp)
    SELECT (SELECT round(avg(v), 6) FROM e) AS query_rmse, (SELECT round(avg(ln(1 + exp(-(a.p - b.p)))), 6) FROM s a JOIN s b ON a.grp = b.grp AND a.y > b.y) AS pairwise,
           (SELECT round(avg(CASE WHEN ideal > 0 THEN 1 - dcg / ideal ELSE 0 END), 6) FROM i) AS ndcg, (SELECT round(avg(v), 6) FROM x) AS xendcg""")
def losses_ranking(spark, d):
    x, out = _scored(spark, d), None
    for name, objective in (("query_rmse", "rank:rmse"), ("pairwise", "rank:pairwise"), ("ndcg", "rank:ndcg"), ("xendcg", "rank:xendcg")):
        one = ranking.loss(x, objective, "o_custkey", "o_orderkey", "p", "y", "w").select(F.round("loss", 6).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # a row each
    return out


_CLASSES = "s AS (SELECT o_orderkey, [o_totalprice / 100000 - 2, 0.5, 2 - o_totalprice / 100000] AS p, o_custkey % 3 AS y, (o_orderkey % 3 + 1)::DOUBLE AS w FROM orders), e AS (SELECT *, list_sum(list_transform(p, lambda v: exp(v))) AS t FROM s)"


def _classed(spark, d):
    o, x = table(spark, d, "orders"), F.col("o_totalprice") / 100000 - 2
    return o.select("o_orderkey", F.array(x, F.lit(0.5), -x).alias("p"), (F.col("o_custkey") % 3).alias("y"), (F.col("o_orderkey") % 3 + 1).cast("double").alias("w"))


@register(f"WITH {_CLASSES} SELECT round(sum(w * (ln(t) - p[y + 1])) / sum(w), 6) AS loss FROM e")
def loss_multiclass(spark, d):
    return _classed(spark, d).agg(F.round(objectives.loss_softmax(F.col("p"), F.col("y"), F.col("w")), 6).alias("loss"))


@register(f"""WITH {_CLASSES} SELECT o_orderkey, {", ".join(f"round((exp(p[{k + 1}]) / t - (y = {k})::INTEGER) * w, 8) AS g{k}, round(greatest(exp(p[{k + 1}]) / t * (1 - exp(p[{k + 1}]) / t), 1e-7) * w, 8) AS h{k}" for k in range(3))} FROM e""")
def grad_softmax(spark, d):
    g, h = objectives.softmax_gradients(F.col("p"), F.col("y"), F.col("w"))
    x = _classed(spark, d).select("o_orderkey", g.alias("g"), h.alias("h"))
    return x.select("o_orderkey", *(F.round(F.col(c)[k], 8).alias(f"{c}{k}") for k in range(3) for c in "gh"))


@register("""WITH s AS (SELECT exp(o_totalprice / 100000 - 2) AS mu, (o_custkey % 7)::DOUBLE AS y, (o_orderkey % 3 + 1)::DOUBLE AS w FROM orders)
    SELECT round(sum(2 * w * (CASE WHEN y > 0 THEN pow(y, 0.5) / -0.25 ELSE 0 END - y * pow(mu, -0.5) / -0.5 + pow(mu, 0.5) / 0.5)) / sum(w), 6) AS loss FROM s""")
def loss_tweedie(spark, d):
    o = table(spark, d, "orders")
    p, y, w = F.col("o_totalprice") / 100000 - 2, (F.col("o_custkey") % 7).cast("double"), (F.col("o_orderkey") % 3 + 1).cast("double")
    return o.agg(F.round(objectives.loss_tweedie(p, y, w), 6).alias("loss"))
