"""Histograms and split search over them, in long form (node, feature, bin)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions import gains


def histogram(df: DataFrame, features: list[str], node: Column, g: Column, h: Column, squares: bool = False) -> DataFrame:
    """node, feature, bin, sg, sh, n (and sq); null bins are the missing bin. Partial sums are map-side."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("bin")) for f in features))
    rows = df.select(node.alias("node"), g.alias("g"), h.alias("h"), F.explode(pairs).alias("p"))
    sums = [F.sum("g").alias("sg"), F.sum("h").alias("sh"), F.count("*").alias("n")] + [F.sum(F.col("g") * F.col("g")).alias("sq")] * squares
    return rows.groupBy("node", F.col("p.feature").alias("feature"), F.col("p.bin").alias("bin")).agg(*sums)


def subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The sibling's histogram: parent less child (feature, bin, sg, sh, n)."""
    c = child.select("feature", "bin", *(F.col(x).alias(f"c_{x}") for x in ("sg", "sh", "n")))
    j = parent.alias("p").join(c.alias("c"), (F.col("p.feature") == F.col("c.feature")) & F.col("p.bin").eqNullSafe(F.col("c.bin")), "left")
    return j.select("p.feature", "p.bin", *((F.col(f"p.{x}") - F.coalesce(F.col(f"c_{x}"), F.lit(0))).alias(x) for x in ("sg", "sh", "n"))).filter("n > 0")


def scan(hist: DataFrame, l1: float = 0.0, l2: float = 0.0, radius: float = 0.0, min_rows: int = 1) -> DataFrame:
    """Every numeric split (node, feature, threshold, default_left) with its gain, by prefix sums over bins."""
    names = ["sg", "sh", "n"] + (["sq"] if radius else [])
    w = Window.partitionBy("node", "feature")
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    there = F.col("bin").isNotNull()
    x = hist
    for c in names:
        x = x.withColumn(f"t_{c}", F.sum(c).over(w)).withColumn(f"m_{c}", F.coalesce(F.sum(F.when(~there, F.col(c))).over(w), F.lit(0))).withColumn(f"p_{c}", F.sum(F.when(there, F.col(c)).otherwise(0)).over(run))
    x = x.filter(there).withColumn("default_left", F.explode(F.array(F.lit(True), F.lit(False))))
    for c in names:
        x = x.withColumn(f"l_{c}", F.col(f"p_{c}") + F.when(F.col("default_left"), F.col(f"m_{c}")).otherwise(0)).withColumn(f"r_{c}", F.col(f"t_{c}") - F.col(f"l_{c}"))

    def side(s: str) -> Column:
        g = gains.effective_gradient(F.col(f"{s}_sg"), F.col(f"{s}_sq") if radius else None, F.col(f"{s}_n"), l1, radius)
        return gains.term(g, F.col(f"{s}_sh"), l2)

    x = x.filter(f"l_n >= {min_rows} and r_n >= {min_rows}").withColumn("gain", side("l") + side("r") - side("t"))
    return x.select("node", "feature", F.col("bin").alias("threshold"), "default_left", "gain", *(f"{s}_{c}" for s in "lr" for c in ("sg", "sh", "n")))


def morph(splits: DataFrame, mean: float, std: float, share: float, smoothing: float, l2: float = 0.0) -> DataFrame:
    """Scanned splits with Morph gains: ``share`` is the information term's part, mean and std are those of the gradients."""
    l, r = ({c: F.col(f"{s}_{c}") for c in ("sg", "sh", "n")} for s in "lr")
    total = {c: l[c] + r[c] for c in l}
    info = [gains.info_side(x["sg"], x["n"], mean, std, smoothing) for x in (l, r, total)]
    scaled = F.col("gain") / ((total["sh"] + l2) * std * std)
    return splits.withColumn("gain", (1 - share) * scaled + share * (info[0] + info[1] - info[2]) + gains.balance(l["n"], r["n"]))


def best(splits: DataFrame, by: list[str], k: int = 1, digits: int = 6) -> DataFrame:
    """The k best splits of each group; gains are compared rounded, ties go to feature, threshold, missing right."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("gain", digits)), "feature", "threshold", "default_left")
    return splits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def scan_categorical(hist: DataFrame, l2: float = 0.0, min_rows: int = 1) -> DataFrame:
    """Categories in order of G / (H + l2), then prefix sums: node, feature, left (ids), gain."""
    w = Window.partitionBy("node", "feature")
    order = F.round(F.col("sg") / (F.col("sh") + (l2 + gains.EPSILON)), 9)
    run = w.orderBy(order, "bin").rowsBetween(Window.unboundedPreceding, 0)
    x = hist.filter("bin is not null")
    for c in ("sg", "sh", "n"):
        x = x.withColumn(f"t_{c}", F.sum(c).over(w)).withColumn(f"l_{c}", F.sum(c).over(run)).withColumn(f"r_{c}", F.col(f"t_{c}") - F.col(f"l_{c}"))
    x = x.withColumn("left", F.sort_array(F.collect_list("bin").over(run)))
    g = sum((s * gains.term(F.col(f"{c}_sg"), F.col(f"{c}_sh"), l2) for c, s in (("l", 1), ("r", 1), ("t", -1))), F.lit(0.0))
    return x.filter(f"l_n >= {min_rows} and r_n >= {min_rows}").select("node", "feature", "left", g.alias("gain"))
