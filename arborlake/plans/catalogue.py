"""Registered queries of the boosting engine and the SQL that they are held against.

Floating-point results are rounded on both sides; ties are broken by keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import gains, metrics, objectives
from arborlake.operators import binning, bundling, encoders, neutralize, sampling, splits, validation
from arborlake.plans import boosting, explain
from arborlake.plans.estimators import BoostedClassifier
from arborlake.plans.morph import Morph
from arborlake.plans.registry import register
from arborlake.plans.registry import rounded as _round
from arborlake.plans.registry import table as _t
from arborlake.sources import frames

FEATURES = ["l_quantity", "l_discount", "l_tax"]

# ---- binning


@register("""
    WITH v AS (SELECT unnest([{'feature': 'l_quantity', 'value': l_quantity}, {'feature': 'l_discount', 'value': l_discount}, {'feature': 'l_extendedprice', 'value': l_extendedprice}], recursive := true) FROM lineitem),
    r AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n FROM v)
    SELECT DISTINCT r.feature, r.value AS cut FROM r, range(1, 16) q(q) WHERE r.i = (q.q * r.n) // 16""")
def quantile_cuts_exact(spark, d):
    return binning.quantile_cuts(_t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], 16)


@register("""
    WITH c AS (SELECT l_quantity AS value, sum(l_linenumber)::DOUBLE AS c FROM lineitem GROUP BY 1),
    r AS (SELECT value, sum(c) OVER (ORDER BY value) AS past, sum(c) OVER () AS total FROM c)
    SELECT DISTINCT 'l_quantity' AS feature, (SELECT min(value) FROM r WHERE past * 8 > q.q * total) AS cut FROM range(1, 8) q(q)""")
def quantile_cuts_weighted(spark, d):
    return binning.weighted_cuts(_t(spark, d, "lineitem"), ["l_quantity"], "l_linenumber", 8)


@register("""
    WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_extendedprice <= lo THEN 0 WHEN l_extendedprice >= hi THEN 255 ELSE floor((l_extendedprice - lo) / (hi - lo) * 255 + 0.5)::INTEGER END AS bin FROM lineitem, b""")
def bin_linear(spark, d):
    li = _t(spark, d, "lineitem")
    b = binning.bounds(li, ["l_extendedprice"])
    x = li.crossJoin(F.broadcast(b))  # one row
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", binning.bin_linear(F.col("l_extendedprice"), F.col("low"), F.col("high"), 255).alias("bin"))


@register("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN nullif(l_tax, 0) IS NULL THEN NULL ELSE (l_tax >= 0.02)::INTEGER + (l_tax >= 0.04)::INTEGER + (l_tax >= 0.06)::INTEGER END AS bin FROM lineitem""")
def bin_missing(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", binning.bin_by_cuts(F.nullif(F.col("l_tax"), F.lit(0.0)), [0.02, 0.04, 0.06]).alias("bin"))


@register("""
    WITH c AS (SELECT o_totalprice AS v, count(*) AS c FROM orders GROUP BY 1), r AS (SELECT v, sum(c) OVER (ORDER BY v) AS up, sum(c) OVER () AS n FROM c)
    SELECT o_orderkey, floor((up - 1) * 31 / (n - 1) + 0.5)::INTEGER AS bin FROM orders JOIN r ON o_totalprice = v""")
def bin_rank(spark, d):
    return binning.bin_rank(_t(spark, d, "orders"), "o_totalprice", 31, "bin").select("o_orderkey", "bin")


@register("""
    WITH v AS (SELECT unnest([{'feature': 'l_quantity', 'value': l_quantity}, {'feature': 'l_discount', 'value': l_discount}, {'feature': 'l_tax', 'value': l_tax}], recursive := true) FROM lineitem)
    SELECT feature, round(avg(value), 6) AS mean, round(1 / stddev_pop(value), 6) AS inv_std FROM v GROUP BY feature""")
def feature_scaler(spark, d):
    return _round(binning.scaler(_t(spark, d, "lineitem"), FEATURES))


@register("SELECT round((count(DISTINCT l_quantity::INTEGER) + count(DISTINCT l_linenumber)) / (2 * 64.0), 6)::DOUBLE AS density FROM lineitem")
def feature_density(spark, d):
    x = _t(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("a"), F.col("l_linenumber").alias("b"))
    return _round(binning.density(x, ["a", "b"], 63))


@register("SELECT sum(greatest((l_tax <> 0)::INTEGER + (l_discount <> 0)::INTEGER - 1, 0))::BIGINT AS conflicts FROM lineitem")
def bundle_conflicts(spark, d):
    return binning.bundle_conflicts(_t(spark, d, "lineitem"), ["l_tax", "l_discount"])


# ---- encoders


@register("""
    WITH p AS (SELECT avg(value) AS prior FROM events), s AS (SELECT event_type, sum(value) AS s, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type AS category, round(n / (n + 20.0) * (s / n) + (1 - n / (n + 20.0)) * prior, 6) AS encoding, round(prior, 6) AS prior FROM s, p""")
def target_encode(spark, d):
    return _round(encoders.fit_target(_t(spark, d, "events"), "event_type", "value"))


@register("""
    WITH f AS (SELECT * FROM events WHERE user_id % 3 = 0), p AS (SELECT avg(value) AS prior FROM f), s AS (SELECT user_id, avg(value) AS m, count(*) AS n FROM f GROUP BY 1)
    SELECT event_id, round(coalesce(n / (n + 20.0) * m + (1 - n / (n + 20.0)) * prior, prior), 6) AS encoding FROM events LEFT JOIN s USING (user_id), p""")
def target_encode_unseen(spark, d):
    e = _t(spark, d, "events")
    fitted = encoders.fit_target(e.filter("user_id % 3 = 0"), "user_id", "value")
    return _round(encoders.apply_target(e.select("event_id", "user_id"), "user_id", fitted, "encoding").select("event_id", "encoding"))


@register("""
    WITH e AS (SELECT event_id, event_type, ts::DATE AS day, value FROM events),
    c AS (SELECT event_type, day, sum(value) AS s, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT day, sum(s) AS s, sum(n) AS n FROM c GROUP BY 1),
    p AS (SELECT day, coalesce(sum(s) OVER w / sum(n) OVER w, 0) AS prior FROM t WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    o AS (SELECT event_type, day, coalesce(sum(s) OVER w, 0) AS s, coalesce(sum(n) OVER w, 0) AS n FROM c WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, round(CASE WHEN n = 0 THEN prior ELSE n / (n + 20.0) * (s / n) + (1 - n / (n + 20.0)) * prior END, 6)::DOUBLE AS encoding FROM e JOIN o USING (event_type, day) JOIN p USING (day)""")
def target_encode_time_aware(spark, d):
    e = _t(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("day"), "value")
    return _round(encoders.target_time_aware(e, "event_type", "value", "day", "encoding").select("event_id", "encoding"))


@register("SELECT event_type AS category, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 9) AS frequency FROM events GROUP BY 1")
def frequency_encode(spark, d):
    return _round(encoders.fit_frequency(_t(spark, d, "events"), "event_type"), 9)


@register("SELECT event_type AS category, (row_number() OVER (ORDER BY event_type) - 1)::INTEGER AS id FROM (SELECT DISTINCT event_type FROM events)")
def dense_category_ids(spark, d):
    return encoders.dense_ids(_t(spark, d, "events"), "event_type")


# ---- folds


@register("""
    WITH e AS (SELECT event_id, ts::DATE AS day FROM events), k AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS k, ntile(4) OVER (ORDER BY day) - 1 AS f FROM (SELECT DISTINCT day FROM e)),
    b AS (SELECT f, min(k) AS a, max(k) AS b FROM k GROUP BY f)
    SELECT event_id, b.f::INTEGER AS fold, CASE WHEN k.k BETWEEN a AND b THEN 'test' ELSE 'train' END AS part FROM e JOIN k USING (day) JOIN b ON k.k BETWEEN a AND b OR k.k < a - 2 OR k.k > b + 1""")
def purged_time_splits(spark, d):
    e = _t(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    return validation.purged_folds(e, "day", 4, purge=2, embargo=1).select("event_id", "fold", "part")


@register("""
    WITH e AS (SELECT event_id, ts::DATE AS day FROM events), k AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM e))
    SELECT event_id, CASE WHEN k > n - least(greatest(round(n * 0.2), 1), n - 1) THEN 'test' ELSE 'train' END AS part FROM e JOIN k USING (day)""")
def split_by_time(spark, d):
    return validation.split_by_time(_t(spark, d, "events").select("event_id", F.to_date("ts").alias("day")), "day", 0.2).select("event_id", "part")


@register("""
    WITH e AS (SELECT event_id, ts::DATE AS day FROM events), k AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS k, ntile(3) OVER (ORDER BY day) - 1 AS f FROM (SELECT DISTINCT day FROM e)),
    b AS (SELECT f, min(k) AS a, max(k) AS b FROM k GROUP BY f)
    SELECT event_id, b.f::INTEGER AS fold, CASE WHEN k.k BETWEEN a AND b THEN 'test' ELSE 'train' END AS part FROM e JOIN k USING (day) JOIN b ON k.k BETWEEN a AND b OR k.k < a - 1 OR k.k > b + 2""")
def purged_panel_splits(spark, d):
    e = _t(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), "user_id")
    return validation.purged_panel_folds(e, "day", "user_id", 3, purge=1, embargo=2).select("event_id", "fold", "part")


@register("""
    WITH s AS (SELECT o_custkey AS g, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT g, sum(n) OVER (ORDER BY g) AS past, n FROM s), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
    SELECT o_orderkey, g AS "group" FROM o JOIN r ON i >= past - n AND i < past""")
def groups_from_sizes(spark, d):
    o = _t(spark, d, "orders")
    sizes = o.groupBy(F.col("o_custkey").alias("group")).agg(F.count("*").alias("size"))
    numbered = binning.running(o.select("o_orderkey", F.lit(0).alias("all"), F.lit(1).cast("long").alias("c")), ["all"], "o_orderkey", "c")
    return frames.groups_from_sizes(numbered.select("o_orderkey", (F.col("past") - 1).alias("i")), "i", sizes).select("o_orderkey", "group")


@register("WITH w AS (SELECT o_orderkey, o_custkey % 4 AS n FROM orders) SELECT o_orderkey, count(*) AS copies FROM w, range(0, 4) r(i) WHERE i < n GROUP BY 1")
def frequency_weights(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("n"))
    return frames.repeat_by_weight(o, "n").groupBy("o_orderkey").agg(F.count("*").alias("copies"))


# ---- histograms and splits


def _binned(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select(
        (F.col("l_quantity") / 10).cast("int").alias("l_quantity"), F.round(F.col("l_discount") * 100).cast("int").alias("l_discount"), F.round(F.nullif(F.col("l_tax"), F.lit(0.0)) * 100).cast("int").alias("l_tax"),
        F.when(F.col("l_linenumber") <= 3, 1).otherwise(2).alias("node"), F.round(F.col("l_extendedprice") - 40000, 2).alias("g"), F.lit(1.0).alias("h"),
    )


_BINNED = """b AS (SELECT (l_quantity / 10)::DOUBLE AS q0, trunc(l_quantity / 10)::INTEGER AS l_quantity, round(l_discount * 100)::INTEGER AS l_discount, round(nullif(l_tax, 0) * 100)::INTEGER AS l_tax,
        CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END AS node, round(l_extendedprice - 40000, 2) AS g, 1.0::DOUBLE AS h FROM lineitem),
    x AS (SELECT node, g, h, unnest([{'feature': 'l_quantity', 'bin': l_quantity}, {'feature': 'l_discount', 'bin': l_discount}, {'feature': 'l_tax', 'bin': l_tax}], recursive := true) FROM b),
    hist AS (SELECT node, feature, bin, sum(g) AS sg, sum(h) AS sh, count(*) AS n, sum(g * g) AS sq FROM x GROUP BY ALL)"""


@register(f"WITH {_BINNED} SELECT node, feature, bin, round(sg, 2) AS sg, round(sh, 2) AS sh, n, round(sq, 0) AS sq FROM hist")
def histogram_level(spark, d):
    h = splits.histogram(_binned(spark, d), FEATURES, F.col("node"), F.col("g"), F.col("h"), squares=True)
    return h.select("node", "feature", "bin", F.round("sg", 2).alias("sg"), F.round("sh", 2).alias("sh"), "n", F.round("sq", 0).alias("sq"))


@register(f"WITH {_BINNED} SELECT feature, bin, round(sg, 2) AS sg, round(sh, 2) AS sh, n FROM hist WHERE node = 2")
def histogram_sibling(spark, d):
    x = _binned(spark, d)
    parent = splits.histogram(x, FEATURES, F.lit(0), F.col("g"), F.col("h"))
    child = splits.histogram(x.filter("node = 1"), FEATURES, F.lit(1), F.col("g"), F.col("h"))
    return _round(splits.subtract(parent, child), 2)


def _scan_sql(l1: float, l2: float, radius: float, k: int, shape: str = "gain", digits: int = 0) -> str:
    def term(s: str) -> str:
        t = f"({l1} + {radius} * sqrt({s}n) * sqrt(greatest({s}sq / {s}n - ({s}sg / {s}n) * ({s}sg / {s}n), 0)))"
        return f"(pow(greatest(abs({s}sg) - {t}, 0), 2) / ({s}sh + {l2} + 1e-6))"

    cols = ("sg", "sh", "n", "sq")
    return f"""WITH {_BINNED},
    s AS (SELECT *, {', '.join(f"sum({c}) OVER p AS t{c}, coalesce(sum({c}) FILTER (bin IS NULL) OVER p, 0) AS m{c}, sum(CASE WHEN bin IS NULL THEN 0 ELSE {c} END) OVER r AS c{c}" for c in cols)} FROM hist
          WINDOW p AS (PARTITION BY node, feature), r AS (PARTITION BY node, feature ORDER BY bin NULLS FIRST ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT node, feature, bin AS threshold, dl AS default_left, {', '.join(f"t{c}, c{c} + CASE WHEN dl THEN m{c} ELSE 0 END AS l{c}" for c in cols)} FROM s, (VALUES (true), (false)) v(dl) WHERE bin IS NOT NULL),
    f AS (SELECT *, {', '.join(f"t{c} - l{c} AS r{c}" for c in cols)} FROM e),
    g AS (SELECT * REPLACE ({shape} AS gain) FROM (SELECT *, {term('l')} + {term('r')} - {term('t')} AS gain FROM f WHERE ln >= 5 AND rn >= 5)),
    o AS (SELECT *, row_number() OVER (PARTITION BY node{', feature' if k else ''} ORDER BY round(gain, {digits}) DESC, feature, threshold, default_left) AS k FROM g)
    SELECT node, feature, threshold, default_left, round(gain, {digits}) AS gain FROM o WHERE k = 1"""


def _best(spark, d, by: list[str], **options) -> DataFrame:
    h = splits.histogram(_binned(spark, d), FEATURES, F.col("node"), F.col("g"), F.col("h"), squares=True)
    return splits.best(splits.scan(h, min_rows=5, **options), by, digits=0).select("node", "feature", "threshold", "default_left", F.round("gain", 0).alias("gain"))


@register(_scan_sql(0, 0, 0, 0))
def best_split_missing_direction(spark, d):
    return _best(spark, d, ["node"])


@register(_scan_sql(500, 3, 0, 0))
def best_split_l1_l2(spark, d):
    return _best(spark, d, ["node"], l1=500.0, l2=3.0)


@register(_scan_sql(0, 1, 0.05, 0))
def best_split_dro(spark, d):
    return _best(spark, d, ["node"], l2=1.0, radius=0.05)


@register(_scan_sql(0, 0, 0, 1))
def split_shortlist_by_feature(spark, d):
    return _best(spark, d, ["node", "feature"])


def _info_sql(s: str) -> str:
    z = f"abs(({s}sg / {s}n + 1500) / 20000)"
    return f"{z} * ln(1 + {z}) / 1.1"


@register(_scan_sql(0, 0, 0, 1, f"0.9 * gain / (tsh * 4e8) + 0.1 * ({_info_sql('l')} + {_info_sql('r')} - {_info_sql('t')}) + CASE WHEN least(ln, rn) / tn < 0.1 THEN -0.5 * (1 - exp(-10 * least(ln, rn) / tn)) ELSE 0 END", 6))
def split_gain_morph(spark, d):
    h = splits.histogram(_binned(spark, d), FEATURES, F.col("node"), F.col("g"), F.col("h"), squares=True)
    x = splits.morph(splits.scan(h, min_rows=5), -1500.0, 20000.0, 0.1, 1.1)
    return splits.best(x, ["node", "feature"]).select("node", "feature", "threshold", "default_left", F.round("gain", 6).alias("gain"))


@register("""
    WITH v AS (SELECT *, l_extendedprice / 100000 AS y, l_linenumber AS w FROM lineitem),
    s AS (SELECT sum(w * l_tax * l_tax) + 1e-6 AS a, sum(w * l_tax * l_discount) AS b, sum(w * l_discount * l_discount) + 1e-6 AS c, sum(w * l_tax * y) AS p, sum(w * l_discount * y) AS q FROM v)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(y - (c * p - b * q) / (a * c - b * b) * l_tax - (a * q - b * p) / (a * c - b * b) * l_discount, 4) AS residual FROM v, s""")
def neutralize_target(spark, d):
    li = _t(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 100000)
    e = neutralize.residual(li, F.col("y"), ["l_tax", "l_discount"], F.col("l_linenumber"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(e, 4).alias("residual"))


@register("""
    WITH m AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM supplier), v AS (SELECT s_suppkey, s_nationkey::DOUBLE AS y, (s_acctbal - m) / s AS x FROM supplier, m)
    SELECT s_suppkey, round(y - x * (SELECT sum(x * y) / (sum(x * x) + 1e-6) FROM v), 4) AS residual FROM v""")
def neutralize_standardized(spark, d):
    s = _t(spark, d, "supplier")
    e = neutralize.residual(s, F.col("s_nationkey").cast("double"), ["s_acctbal"], transform="standardize")
    return s.select("s_suppkey", F.round(e, 4).alias("residual"))


@register("""
    WITH i AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS bin FROM (SELECT DISTINCT event_type FROM events)),
    h AS (SELECT bin, sum(value - 50) AS g, count(*) AS n FROM events JOIN i USING (event_type) GROUP BY 1),
    s AS (SELECT *, sum(g) OVER w AS lg, sum(n) OVER w AS ln, sum(g) OVER () AS tg, sum(n) OVER () AS tn, list(bin) OVER w AS bins FROM h WINDOW w AS (ORDER BY round(g / (n + 1e-6), 9), bin ROWS UNBOUNDED PRECEDING))
    SELECT len(bins)::INTEGER AS n_left, array_to_string(list_sort(bins), ',') AS left_ids, round(lg * lg / (ln + 1e-6) + (tg - lg) * (tg - lg) / (tn - ln + 1e-6) - tg * tg / (tn + 1e-6), 3) AS gain FROM s WHERE tn > ln""")
def best_split_categorical(spark, d):
    e = _t(spark, d, "events")
    ids = encoders.dense_ids(e, "event_type").select(F.col("category").alias("event_type"), F.col("id").alias("cat"))
    x = e.join(encoders.small(ids), "event_type").select("cat", (F.col("value") - 50).alias("g"))
    s = splits.scan_categorical(splits.histogram(x, ["cat"], F.lit(0), F.col("g"), F.lit(1.0)))
    return s.select(F.size("left").alias("n_left"), F.array_join(F.col("left").cast("array<string>"), ",").alias("left_ids"), F.round("gain", 3).alias("gain"))


@register(f"WITH {_BINNED}, s AS (SELECT node, sum(g) AS sg, sum(h) AS sh FROM b GROUP BY 1) SELECT node, round(-0.1 * sg / (sh + 2 + 1e-6), 6) AS value FROM s")
def leaf_newton(spark, d):
    s = _binned(spark, d).groupBy("node").agg(F.sum("g").alias("sg"), F.sum("h").alias("sh"))
    return s.select("node", F.round(gains.leaf_value(F.col("sg"), F.col("sh"), 0.1, 2.0), 6).alias("value"))


@register("SELECT l_returnflag AS leaf, quantile_disc(l_extendedprice - 1000 * l_quantity, 0.25) AS value FROM lineitem GROUP BY 1")
def leaf_quantile(spark, d):
    x = _t(spark, d, "lineitem").withColumn("leaf", F.col("l_returnflag"))
    return binning.group_quantile(x, ["leaf"], F.col("l_extendedprice") - 1000 * F.col("l_quantity"), 0.25)


@register("""
    WITH v AS (SELECT l_returnflag AS leaf, l_extendedprice - 1000 * l_quantity AS r, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY leaf ORDER BY r) AS past, sum(w) OVER (PARTITION BY leaf) AS total FROM v)
    SELECT leaf, min(r) AS value FROM c WHERE past >= 0.7 * total GROUP BY leaf""")
def leaf_quantile_weighted(spark, d):
    x = _t(spark, d, "lineitem").withColumn("leaf", F.col("l_returnflag"))
    return binning.group_quantile(x, ["leaf"], F.col("l_extendedprice") - 1000 * F.col("l_quantity"), 0.7, F.col("l_linenumber"))


@register("""
    WITH v AS (SELECT unnest([{'feature': 'a', 'value': exp(l_extendedprice / 5000)}, {'feature': 'b', 'value': l_quantity}], recursive := true) FROM lineitem), r AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n FROM v)
    SELECT feature, (max(value) FILTER (i = n - 1 - floor(n * 0.1)) - max(value) FILTER (i = floor(n * 0.1))) / (max(value) - min(value)) <= 0.1 AS by_rank FROM r GROUP BY feature""")
def tail_rank_plan(spark, d):
    x = _t(spark, d, "lineitem").select(F.exp(F.col("l_extendedprice") / 5000).alias("a"), F.col("l_quantity").alias("b"))
    return binning.tail_rank_features(x, ["a", "b"])


@register("""
    WITH o AS (SELECT o_orderkey, exp(o_totalprice / 20000) AS a, o_totalprice AS b FROM orders), r AS (SELECT o_orderkey, b, count(*) OVER (ORDER BY a) - 1 AS k, count(*) OVER () AS n, min(b) OVER () AS lo, max(b) OVER () AS hi FROM o)
    SELECT o_orderkey, floor(k * 255 / (n - 1) + 0.5)::INTEGER AS a_bin, CASE WHEN b <= lo THEN 0 WHEN b >= hi THEN 255 ELSE floor((b - lo) / (hi - lo) * 255 + 0.5)::INTEGER END AS b_bin FROM r""")
def bin_linear_or_rank(spark, d):
    x = _t(spark, d, "orders").select("o_orderkey", F.exp(F.col("o_totalprice") / 20000).alias("a"), F.col("o_totalprice").alias("b"))
    return binning.bin_linear_or_rank(x, ["a", "b"], 255).select("o_orderkey", "a_bin", "b_bin")


@register("""SELECT * FROM (VALUES ('l_linenumber', (SELECT bool_and(l_linenumber >= 0) FROM lineitem)), ('l_discount', (SELECT bool_and(abs(l_discount - round(l_discount)) <= 1e-6) FROM lineitem)), ('l_quantity', (SELECT bool_and(l_quantity >= 0 AND abs(l_quantity - round(l_quantity)) <= 1e-6) FROM lineitem))) t(feature, prebinned)""")
def prebinned_features(spark, d):
    return binning.is_prebinned(_t(spark, d, "lineitem"), ["l_linenumber", "l_discount", "l_quantity"])


_ONE_HOT = ", ".join(f"CASE WHEN l_linenumber = {i} THEN 1 + l_suppkey % 3 ELSE 0 END AS c{i}" for i in range(1, 8))


@register(f"""
    WITH b AS (SELECT {_ONE_HOT}, l_extendedprice - 40000 AS g FROM lineitem),
    v AS (SELECT g, unnest([{", ".join(f"{{'feature': 'c{i}', 'bin': c{i}}}" for i in range(1, 8))}], recursive := true) FROM b)
    SELECT feature, bin::INTEGER AS bin, round(sum(g), 2) AS sg, count(*)::DOUBLE AS sh, count(*) AS n FROM v GROUP BY feature, bin""")
def histogram_bundled(spark, d):
    """Histograms of one-hot columns through the bundle that they are stored in."""
    li = _t(spark, d, "lineitem")
    x = li.select(*(F.when(F.col("l_linenumber") == i, 1 + F.col("l_suppkey") % 3).otherwise(0).cast("int").alias(f"c{i}") for i in range(1, 8)), (F.col("l_extendedprice") - 40000).alias("g"))
    b = bundling.discover(x, [f"c{i}" for i in range(1, 8)])
    return bundling.histogram(x, b, F.col("g"), F.lit(1.0)).select("feature", "bin", F.round("sg", 2).alias("sg"), "sh", "n")


@register("""
    WITH t AS (SELECT * FROM events WHERE event_id % 3 <> 0), p AS (SELECT avg(value) AS prior FROM t),
    a AS (SELECT event_type, avg(value) AS m, count(*) AS n FROM t GROUP BY 1), b AS (SELECT user_id, avg(value) AS m, count(*) AS n FROM t GROUP BY 1)
    SELECT event_id, round(coalesce(a.n / (a.n + 20.0) * a.m + 20.0 / (a.n + 20.0) * prior, prior), 6) AS event_type, round(coalesce(b.n / (b.n + 20.0) * b.m + 20.0 / (b.n + 20.0) * prior, prior), 6) AS user_id
    FROM events e LEFT JOIN a USING (event_type) LEFT JOIN b USING (user_id), p WHERE event_id % 3 = 0""")
def target_encode_several(spark, d):
    """Two columns encoded from the training rows, applied to the others."""
    e = _t(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    fitted = encoders.target_encode_all(e.filter("event_id % 3 != 0"), ["event_type", "user_id"], "value")
    return _round(encoders.apply_target_all(e.filter("event_id % 3 = 0"), fitted).select("event_id", "event_type", "user_id"))


@register("WITH f AS (SELECT event_type, count(*) / (SELECT count(*) FROM events WHERE event_id % 2 = 0)::DOUBLE AS f FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT event_id, round(coalesce(f, 0), 9) AS frequency FROM events LEFT JOIN f USING (event_type)")
def frequency_encode_rows(spark, d):
    e = _t(spark, d, "events").select("event_id", "event_type")
    return _round(encoders.apply_frequency(e, "event_type", encoders.fit_frequency(e.filter("event_id % 2 = 0"), "event_type"), "frequency").select("event_id", "frequency"), 9)


@register("""
    WITH h AS (SELECT o_orderkey, (o_orderkey * 7919 + o_custkey * 104729) % 10007 AS h FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY h, o_orderkey) AS r, count(*) OVER () AS n FROM h)
    SELECT o_orderkey FROM r WHERE r <= ceil(n * 0.15)""")
def row_sample(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return sampling.smallest_hashes(o, (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % 10007, "o_orderkey", 0.15).select("o_orderkey")


# ---- objectives: gradients on a fixed score

_SCORE = "(o_totalprice / 100000 - 2)"


def _orders(spark, d) -> tuple[DataFrame, Column, Column, Column]:
    return _t(spark, d, "orders"), F.col("o_totalprice") / 100000 - 2, F.col("o_custkey") % 7 + 1.0, F.col("o_orderkey") % 3 + 1.0


def _gradient(name: str, make: Callable, g: str, h: str) -> None:
    def query(spark, d):
        o, p, y, w = _orders(spark, d)
        a, b = make(p, y, w)
        return o.select("o_orderkey", F.round(a, 9).alias("g"), F.round(b, 9).alias("h"))

    query.__name__ = name
    register(f"WITH s AS (SELECT o_orderkey, {_SCORE} AS p, (o_custkey % 7 + 1)::DOUBLE AS y, (o_orderkey % 3 + 1)::DOUBLE AS w FROM orders) SELECT o_orderkey, round({g}, 9) AS g, round({h}, 9) AS h FROM s")(query)


_gradient("grad_squared", objectives.squared, "(p - y) * w", "w")
_gradient("grad_binary", lambda p, y, w: objectives.binary(p, F.when(y > 4, 1.0).otherwise(0.0), w), "(1 / (1 + exp(-p)) - CASE WHEN y > 4 THEN 1 ELSE 0 END) * w", "1 / (1 + exp(-p)) * (1 - 1 / (1 + exp(-p))) * w")
_gradient("grad_poisson", objectives.poisson, "(exp(p) - y) * w", "greatest(exp(p), 1e-7) * exp(0.7::DOUBLE) * w")
_gradient("grad_gamma", objectives.gamma, "(1 - y / exp(p)) * w", "greatest(y / exp(p), 1e-7) * w")
_gradient("grad_tweedie", objectives.tweedie, "(pow(exp(p), 0.5) - y * pow(exp(p), -0.5)) * w", "greatest(pow(exp(p), 0.5), 1e-7) * w")
_gradient("grad_quantile", lambda p, y, w: objectives.quantile(p, y, w, 0.3), "CASE WHEN y > p THEN -0.3 ELSE 0.7 END * w", "w")


@register(f"""
    WITH s AS (SELECT {_SCORE} AS p, (o_custkey % 7 + 1)::DOUBLE AS y, (o_orderkey % 3 + 1)::DOUBLE AS w FROM orders)
    SELECT round(sum(w * (p - y) * (p - y)) / count(*), 6) AS squared, round(sum(w * (greatest(p, 0) - p * y + ln(1 + exp(-abs(p))))) / count(*), 6) AS "binary", round(sum(w * (exp(p) - y * p)) / sum(w), 6) AS poisson,
           round(sum(w * (y / exp(p) - ln(y / exp(p)) - 1)) / sum(w), 6) AS gamma, round(sum(w * greatest((y - p) * 0.3, (y - p) * -0.7)) / count(*), 6) AS quantile FROM s""")
def losses(spark, d):
    o, p, y, w = _orders(spark, d)
    parts = {"squared": objectives.loss_squared(p, y, w), "binary": objectives.loss_binary(p, y, w), "poisson": objectives.loss_poisson(p, y, w), "gamma": objectives.loss_gamma(p, y, w), "quantile": objectives.loss_quantile(p, y, w, 0.3)}
    return o.agg(*(F.round(v, 6).alias(k) for k, v in parts.items()))


@register(f"""
    WITH s AS (SELECT o_orderkey, exp({_SCORE}) AS a, exp(0.5::DOUBLE) AS b, exp(-{_SCORE}) AS c FROM orders)
    SELECT o_orderkey, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM s""")
def softmax_scores(spark, d):
    o, p, _, _ = _orders(spark, d)
    q = o.select("o_orderkey", objectives.softmax(F.array(p, F.lit(0.5), -p)).alias("q"))
    return q.select("o_orderkey", *(F.round(F.col("q")[i], 6).alias(f"p{i}") for i in range(3)))


# ---- sampling


@register("""
    WITH r AS (SELECT *, row_number() OVER (ORDER BY round(abs(l_extendedprice - 40000), 9) DESC, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber) AS r FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem)), n AS (SELECT count(*) AS n FROM r),
    q AS (SELECT r.*, n.n, row_number() OVER (PARTITION BY r > ceil(n * 0.2) ORDER BY (l_orderkey * 7919 + l_partkey * 104729) % 10007, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber) AS q FROM r, n)
    SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE WHEN r <= ceil(n * 0.2) THEN 1.0 ELSE (n - ceil(n * 0.2)) / ceil(n * 0.1) END::DOUBLE AS amplify FROM q WHERE r <= ceil(n * 0.2) OR q <= ceil(n * 0.1)""")
def goss_sample(spark, d):
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice").distinct()
    x = x.withColumn("g", F.col("l_extendedprice") - 40000).withColumn("tie", F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber"))
    h = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729) % 10007
    return sampling.goss(x, "g", "tie", h, 0.2, 0.1).drop("g", "tie")


# ---- metrics on orders: y and a fixed prediction

_PAIR = "SELECT o_orderkey, o_custkey, o_totalprice / 1000 AS y, (o_custkey % 97) * 3.0 + 10 AS p, substr(o_orderpriority, 1, 1)::INTEGER AS rel FROM orders"


def _pairs(spark, d) -> DataFrame:
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("y"), ((F.col("o_custkey") % 97) * 3.0 + 10).alias("p"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rel"))


def _metric(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    def query(spark, d):
        return _round(make(_pairs(spark, d)))

    query.__name__ = f"metric_{name}"
    register(f"WITH o AS ({_PAIR}) {sql}")(query)


_metric("rmse", lambda x: metrics.rmse(x, "y", "p"), "SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM o")
_metric("mae", lambda x: metrics.mae(x, "y", "p"), "SELECT round(avg(abs(y - p)), 6) AS mae FROM o")
_metric("r2_score", lambda x: metrics.r2_score(x, "y", "p"), "SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2_score FROM o")
_metric("pearson_correlation", lambda x: metrics.pearson_correlation(x, "y", "p"), "SELECT round(corr(y, p), 6) AS pearson_correlation FROM o")
_metric("hit_rate", lambda x: metrics.hit_rate(x, "y", "p", 150.0), "SELECT round(avg((sign(y - 150) = sign(p - 150))::INTEGER), 6) AS hit_rate FROM o")
_metric("accuracy", lambda x: metrics.accuracy(x.withColumn("c", F.col("o_orderkey") % 5 + 1), "rel", "c"), "SELECT round(avg((rel = o_orderkey % 5 + 1)::INTEGER), 6) AS accuracy FROM o")
_metric("log_loss", lambda x: metrics.log_loss(x.withColumn("b", (F.col("rel") > 2).cast("int")).withColumn("q", F.col("p") / 400), "b", "q"), "SELECT round(-avg(CASE WHEN rel > 2 THEN ln(p / 400) ELSE ln(1 - p / 400) END), 6) AS log_loss FROM o")
_metric("multiclass_log_loss", lambda x: metrics.multiclass_log_loss(x.withColumn("c", F.col("rel") - 1).withColumn("q", F.array(*(F.lit(v) for v in (0.1, 0.2, 0.3, 0.15, 0.25)))), "c", "q"), "SELECT round(-avg(ln(CASE rel WHEN 1 THEN 0.1 WHEN 2 THEN 0.2 WHEN 3 THEN 0.3 WHEN 4 THEN 0.15 ELSE 0.25 END)), 6) AS multiclass_log_loss FROM o")
_metric("poisson_deviance", lambda x: metrics.poisson_deviance(x, "y", "p"), "SELECT round(2 * avg(y * ln(y / p) - (y - p)), 6) AS poisson_deviance FROM o")
_metric("gamma_deviance", lambda x: metrics.gamma_deviance(x, "y", "p"), "SELECT round(2 * avg(-ln(y / p) + (y - p) / p), 6) AS gamma_deviance FROM o")
_metric("tweedie_deviance", lambda x: metrics.tweedie_deviance(x, "y", "p"), "SELECT round(2 * avg(pow(y, 0.5) / -0.25 - y * pow(p, -0.5) / -0.5 + pow(p, 0.5) / 0.5), 6) AS tweedie_deviance FROM o")
_NDCG = """, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC, o_orderkey) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY rel DESC, o_orderkey) AS i FROM o),
    g AS (SELECT o_custkey, sum(CASE WHEN s <= {k} THEN (pow(2, rel) - 1) / log2(s + 1) ELSE 0 END) AS d, sum(CASE WHEN i <= {k} THEN (pow(2, rel) - 1) / log2(i + 1) ELSE 0 END) AS b FROM r GROUP BY 1)
    SELECT round(avg(CASE WHEN b <= 0 THEN 1 ELSE d / b END), 6) AS ndcg FROM g"""
_metric("ndcg", lambda x: metrics.ndcg(x, "rel", "y", "o_custkey", "o_orderkey"), _NDCG.format(k=10**9))
_metric("ndcg_at_5", lambda x: metrics.ndcg(x, "rel", "y", "o_custkey", "o_orderkey", 5), _NDCG.format(k=5))
_RANKS = """, r AS (SELECT rel, rank() OVER (PARTITION BY rel ORDER BY y) + (count(*) OVER (PARTITION BY rel, y) - 1) / 2 AS a, rank() OVER (PARTITION BY rel ORDER BY p) + (count(*) OVER (PARTITION BY rel, p) - 1) / 2 AS b FROM o), c AS (SELECT rel, corr(a, b) AS rank_ic FROM r GROUP BY 1)"""
_metric("rank_ic", lambda x: metrics.rank_ic(x, "y", "p", ["rel"]), _RANKS + " SELECT rel, round(rank_ic, 6) AS rank_ic FROM c")
_metric("icir", lambda x: metrics.icir(metrics.rank_ic(x, "y", "p", ["rel"]), "rank_ic"), _RANKS + " SELECT round(avg(rank_ic) / stddev_pop(rank_ic), 6) AS icir FROM c")


# ---- whole fits (rows only: no SQL for them)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price from four numbers of a line item: 5 rounds of depth 3, then scores."""
    li = _t(spark, sf_dir, "lineitem")
    m = boosting.fit(li, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice", boosting.Params(n_estimators=5, max_depth=3, learning_rate=0.3))
    return m.transform(li).select("l_orderkey", "l_linenumber", "l_extendedprice", F.round("prediction", 6).alias("prediction"))


@register()
def fit_regression(spark, d):
    return flagship(spark, d)


@register()
def fit_binary_quality(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select("doc_id", "n_chars", "lang", "quality")
    m = boosting.fit(x, ["n_chars", "lang"], "quality", boosting.Params(objective="binary", n_estimators=3, max_depth=3), categorical=["lang"], classes=[0, 1])
    return m.transform(x).select("doc_id", "prediction", "probability")


@register()
def fit_ranking(spark, d):
    o = _t(spark, d, "orders").withColumn("rel", F.substring("o_orderpriority", 1, 1).cast("int"))
    m = boosting.fit(o, ["o_totalprice"], "rel", boosting.Params(objective="rank:ndcg", n_estimators=2, max_depth=3), group="o_custkey")
    return m.transform(o).select("o_orderkey", "o_custkey", "rel", "prediction")


@register()
def fit_morph(spark, d):
    li = _t(spark, d, "lineitem")
    m = boosting.fit(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", boosting.Params(n_estimators=4, max_depth=3, learning_rate=0.3, morph=Morph(warmup=2, rise=0.25)))
    return m.transform(li).select("l_orderkey", "l_linenumber", F.round("prediction", 6).alias("prediction"))


def _small_fit(x: DataFrame) -> boosting.Model:
    return boosting.fit(x, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", boosting.Params(n_estimators=2, max_depth=3, learning_rate=0.3))


@register()
def shap_values(spark, d):
    li = _t(spark, d, "lineitem")
    return explain.shap_values(_small_fit(li), li.select("l_orderkey", "l_linenumber", *FEATURES)).select("l_orderkey", "l_linenumber", F.col("expected_value")[0].alias("expected_value"), F.col("shap")[0].alias("shap"))


@register()
def shap_interactions(spark, d):
    li = _t(spark, d, "lineitem")
    return explain.shap_values(_small_fit(li), li.select("l_orderkey", "l_linenumber", *FEATURES), pairs=True).select("l_orderkey", "l_linenumber", F.col("interactions")[0].alias("interactions"))


@register()
def fit_multiclass(spark, d):
    """Order priority, five classes, by the classifier."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("k"))
    m = BoostedClassifier("k", ["o_totalprice", "o_orderstatus"], n_estimators=2, max_depth=3).fit(o)
    return m.transform(o).select("o_orderkey", "prediction", "probability")
