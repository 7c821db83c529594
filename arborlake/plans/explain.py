"""Shapley values of fitted trees, on the raw score.

A leaf with value v counts for a set S of known features with v times the
product of o_j over S and of z_j over its other path features: o_j is 1 where
the row passes all conditions on j, z_j the share of cover that passes them.
So a leaf's Shapley values have closed forms in the coefficients of
prod(z_j + o_j t), which are summed over leaves for a batch of rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arborlake.plans.boosting import Model, Tree


def leaf_paths(tree: Tree) -> Iterator[tuple[float, dict[int, list[tuple[int, bool]]], dict[int, float]]]:
    """(weighted value, conditions by feature, passing share of cover by feature) of each leaf."""
    stack: list[tuple[int, dict, dict]] = [(0, {}, {})]
    while stack:
        node, steps, share = stack.pop()
        if tree.left[node] < 0:
            yield tree.weight * tree.value[node], steps, share
            continue
        f = tree.feature[node]
        for child, left in ((tree.left[node], True), (tree.right[node], False)):
            part = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.5
            stack.append((child, steps | {f: [*steps.get(f, []), (node, left)]}, share | {f: share.get(f, 1.0) * part}))


def _weighted(o: np.ndarray, z: np.ndarray, without: tuple[int, ...]) -> np.ndarray:
    """Sum over sets of the features not in ``without`` of Shapley weight times product, a value a row."""
    use = [j for j in range(len(z)) if j not in without]
    n = len(use)
    poly = np.zeros((o.shape[1], n + 1))
    poly[:, 0] = 1.0
    for j in use:
        shifted = np.zeros_like(poly)
        shifted[:, 1:] = poly[:, :-1] * o[j][:, None]
        poly = poly * z[j] + shifted
    return poly @ np.array([factorial(k) * factorial(n - k) / factorial(n + 1) for k in range(n + 1)])


def shapley(model: Model, bins: np.ndarray, pairs: bool = False, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(expected value of each output, values (output, row, feature), interactions (output, row, feature, feature) or None)."""
    rows, width, outputs = len(bins), len(model.binner.features), len(model.base)
    expected, phi = np.array(model.base, float), np.zeros((outputs, rows, width))
    inter = np.zeros((outputs, rows, width, width)) if pairs else None
    for t in model.trees:
        goes = {n: t.goes_left(n, bins[:, t.feature[n]]) for n in range(len(t.left)) if t.left[n] >= 0}
        for value, steps, share in leaf_paths(t):
            feats, z = list(steps), np.array([share[f] for f in steps])
            expected[t.output] += value * z.prod()
            if not feats:
                continue
            o = np.array([np.logical_and.reduce([goes[n] == left for n, left in steps[f]]) for f in feats], float)
            off = o - z[:, None]
            for i, f in enumerate(feats):
                phi[t.output, :, f] += value * off[i] * _weighted(o, z, (i,))
                for j in range(i if pairs else 0):
                    both = value / 2 * off[i] * off[j] * _weighted(o, z, (i, j))
                    inter[t.output, :, f, feats[j]] += both
                    inter[t.output, :, feats[j], f] += both
        for node, (feats, weights) in t.linear.items():  # a linear leaf credits each of its features with its own term
            rows = np.flatnonzero(t.route(bins) == node)
            for f, w in zip(feats, weights):
                phi[t.output, rows, f] += t.weight * w * values[rows, f]
    if pairs:
        own = np.arange(width)
        inter[:, :, own, own] = phi - inter.sum(3)
    return expected, phi, inter


def shap_values(model: Model, df: DataFrame, pairs: bool = False) -> DataFrame:
    """Adds ``expected_value``, ``shap`` and, with ``pairs``, ``interactions``; one entry an output.

    ``shap`` is an array by output of an array by feature, in the model's order.
    The expected value plus a row's Shapley values is its raw score.
    """
    at = [df.columns.index(f) for f in model.binner.features]
    ddl = "expected_value array<double>, shap array<array<double>>" + ", interactions array<array<array<double>>>" * pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f64 = pa.float64()
        kinds = {"expected_value": pa.list_(f64), "shap": pa.list_(pa.list_(f64)), "interactions": pa.list_(pa.list_(pa.list_(f64)))}
        for r in batches:
            raw = [r.column(i) for i in at]
            expected, phi, inter = shapley(model, model.binner.transform(raw), pairs, model.binner.standardised(raw) if model.is_linear else None)
            new = {"expected_value": [expected.tolist()] * r.num_rows, "shap": phi.transpose(1, 0, 2).tolist()}
            if pairs:
                new["interactions"] = inter.transpose(1, 0, 2, 3).tolist()
            yield pa.RecordBatch.from_arrays([*r.columns, *(pa.array(v, kinds[k]) for k, v in new.items())], names=[*r.schema.names, *new])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields]))


def verify(model: Model, df: DataFrame) -> DataFrame:
    """Rows whose Shapley values do not add up to their raw score: none, unless something is wrong."""
    at = [df.columns.index(f) for f in model.binner.features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            raw = [r.column(i) for i in at]
            bins, z = model.binner.transform(raw), model.binner.standardised(raw) if model.is_linear else None
            expected, phi, _ = shapley(model, bins, False, z)
            score = model.raw(bins, z)
            off = np.abs(expected + phi.sum(2).T - score) > 1e-5 + 1e-4 * np.abs(score)
            yield r.filter(pa.array(off.any(1)))

    return df.mapInArrow(run, df.schema)


def importance(model: Model, df: DataFrame) -> DataFrame:
    """feature, importance: the mean absolute Shapley value over rows and outputs, largest first."""
    names = F.array(*(F.lit(f) for f in model.binner.features))
    each = shap_values(model, df).select(F.explode("shap").alias("v")).select(F.posexplode("v").alias("i", "v"))
    return each.groupBy("i").agg(F.avg(F.abs("v")).alias("importance")).select(names[F.col("i")].alias("feature"), "importance").orderBy(F.desc("importance"), "feature")
