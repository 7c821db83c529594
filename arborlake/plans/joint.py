"""Trees with several outputs: one structure for all, a vector of values at each leaf.

Gains are sums over the outputs, each with its own objective. The jobs are
those of ``boosting``: binned rows written once, sums by (node, feature, bin)
in the tasks, here with a pair for each output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arborlake.functions import losses, ranking
from arborlake.operators import binning, sampling
from arborlake.plans import boosting, morph
from arborlake.plans.boosting import EPSILON, MISSING, Binner, Drawn, Job, Model, Params, Tree, _lists, _rows
from arborlake.sources.frames import check_roles, cut_lineage

OBJECTIVES = ("squared_error", "binary", "poisson", "gamma", "tweedie", "quantile", "rank:pairwise", "rank:ndcg", "rank:xendcg", "rank:rmse")
#: Categories that a joint split can part. (Fixed value.)
MOST_CATEGORIES = 64


@dataclass
class JointTree(Tree):
    """A tree whose nodes hold vectors; ``value`` is the first output's."""

    vectors: list[list[float]] = field(default_factory=list)

    def predict_all(self, bins: np.ndarray) -> np.ndarray:
        return self.weight * np.asarray(self.vectors)[self.route(bins)]

    def output_tree(self, k: int) -> Tree:
        return Tree(k, self.weight, self.feature, self.threshold, self.default_left, self.cats, self.left, self.right, [v[k] for v in self.vectors], self.gain, self.cover)


def _all_scores(trees: list[JointTree], bins: np.ndarray, outputs: int) -> np.ndarray:
    return sum((t.predict_all(bins) for t in trees), np.zeros((len(bins), outputs)))


class JointJob(Job):
    """``Job`` with a target and an objective for each output; one tree grows."""

    def __init__(self, p: Params, objectives: list[str], trees: list[JointTree], growing: JointTree, round_index: int, drawn: Drawn = Drawn(), beta: np.ndarray | None = None):
        super().__init__(p, len(objectives), trees, [growing], round_index, drawn, beta)
        self.objectives = objectives

    def gradients(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        grouped = any(o.startswith("rank:") and o != "rank:rmse" for o in self.objectives)
        for t in ranking.whole_groups(batches) if grouped else (pa.Table.from_batches([b]) for b in batches):
            if not t.num_rows:
                continue
            bins, y = _rows(t.column("bins")), _rows(t.column("ys"))
            s, one = _rows(t.column("s")) + _all_scores(self.trees, bins, self.outputs), np.ones(t.num_rows)
            g, h = np.zeros_like(s), np.zeros_like(s)
            for k, name in enumerate(self.objectives):
                if name.startswith("rank:") and name != "rank:rmse":
                    grp = t.column("grp").to_numpy()
                    edge = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
                    for a, b in zip(edge, edge[1:]):
                        g[a:b, k], h[a:b, k] = losses.group_gradients(name, s[a:b, k], y[a:b, k], self.p.options | {"seed": self.p.seed}, int(grp[a]))
                else:
                    (g[:, k : k + 1], h[:, k : k + 1]) = losses.row_gradients(name, s[:, k : k + 1], y[:, k], one, self.p.options)
            if self.beta is not None:
                g = g - _rows(t.column("f")) @ self.beta
            yield bins, g, h, sampling.uniform(t.column("rid").to_numpy(), self.p.seed, self.round), t

    def joint_histogram(self, batches: Iterator[pa.RecordBatch], build: list[int], width: int, first: int, past: int, factors: int) -> Iterator[pa.RecordBatch]:
        """Rows (node, feature, bin, sums): rows, then gradient, hessian and squared gradient of each output, then factors."""
        f, channels = past - first, 1 + 3 * self.outputs + factors
        sums, slot = np.zeros((channels, len(build) * f * width)), np.full(len(self.growing[0].value), -1)
        slot[build] = np.arange(len(build))
        for bins, g, h, t in self.parts(batches):
            at = slot[self.growing[0].route(bins)]
            rows = np.flatnonzero(at >= 0)
            own = bins[rows, first:past]
            cell = ((at[rows, None] * f + np.arange(f)) * width + np.where(own == MISSING, width - 1, own)).ravel()
            x = _rows(t.column("f"))[rows] if factors else np.zeros((len(rows), 0))
            each = [None, *(v[rows, k] for k in range(self.outputs) for v in (g, h, g * g)), *x.T]
            for i, v in enumerate(each):
                sums[i] += np.bincount(cell, None if v is None else np.repeat(v, f), sums.shape[1])
        cell = np.flatnonzero(sums[0])
        if len(cell):
            nodes = np.array(build, np.int32)[cell // (f * width)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array((first + cell // width % f).astype(np.int32)), pa.array((cell % width).astype(np.int32)), _lists(sums[:, cell].T)], names=["node", "feature", "bin", "sums"])


def _sides(x: np.ndarray, outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradients, hessians, squared gradients) by output of sums in the last axis."""
    return tuple(x[..., 1 + i : 1 + 3 * outputs : 3] for i in range(3))


def leaf_vector(x: np.ndarray, outputs: int, p: Params) -> np.ndarray:
    """-G / (H + l2) of each output, gradients pulled in by L1 and the robust radius."""
    g, h, q = _sides(x, outputs)
    n = np.maximum(x[..., :1], 1)
    pull = p.lambda_l1 + (p.dro_radius * np.sqrt(n) * np.sqrt(np.maximum(q / n - (g / n) ** 2, 0)) if p.dro_radius else 0.0)
    return -np.sign(g) * np.maximum(np.abs(g) - pull, 0) / (h + p.lambda_l2 + EPSILON)


def joint_gain(left: np.ndarray, right: np.ndarray, outputs: int, p: Params, reshape=None) -> np.ndarray:
    """Sum over the outputs of G^2 / (H + l2) of both sides less that of their union; ``reshape(k, ...)`` gives Morph gains, with hessians for rows."""
    total, gain = left + right, np.zeros(len(left))
    for k in range(outputs):
        sides = [tuple(v[..., k] for v in _sides(x, outputs)[:2]) for x in (left, right, total)]
        plain = sum(sign * g * g / (h + p.lambda_l2 + EPSILON) for (g, h), sign in zip(sides, (1, 1, -1)))
        if reshape:
            l, r, t = (np.stack([g, h, np.maximum(np.ceil(h), 1.0), g * g], -1) for g, h in sides)
            plain = np.array([reshape(k, plain[i : i + 1], t[i], l[i : i + 1], r[i : i + 1])[0] for i in range(len(plain))])
        gain = gain + plain
    return gain


def best_joint_split(hist: np.ndarray, outputs: int, p: Params, allowed, sizes: list[int], is_cat: list[bool], reshape=None) -> tuple | None:
    """(gain, feature, threshold, default_left, cats). Missing rows count as right in the gain and then go where more rows are."""
    best = None
    for f in allowed:
        x, missing = hist[f, : sizes[f]], hist[f, -1]
        if is_cat[f]:
            if not 2 <= sizes[f] <= MOST_CATEGORIES:
                continue
            g, h, _ = _sides(x, outputs)
            order = np.argsort(g[:, 0] / (h[:, 0] + p.lambda_l2 + EPSILON), kind="stable")
            order = order[x[order, 0] > 0]
        else:
            order = np.arange(sizes[f])
        if len(order) < 2:
            continue
        left = np.cumsum(x[order], 0)[:-1]
        right = left[-1] + x[order[-1]] + missing - left
        gain = joint_gain(left, right, outputs, p, reshape)
        if p.factor_penalty and hist.shape[2] > 1 + 3 * outputs:
            lv, rv = (leaf_vector(s, outputs, replace(p, dro_radius=0.0)) for s in (left, right))
            load = left[:, 1 + 3 * outputs :, None] * lv[:, None, :] + right[:, 1 + 3 * outputs :, None] * rv[:, None, :]
            gain = gain - p.factor_penalty * (load**2).sum((1, 2)) / max(float(left[0, 0] + right[0, 0]), 1.0)
        known = right[:, 0] - missing[0]
        go = left[:, 0] >= known
        n_left, n_right = left[:, 0] + np.where(go, missing[0], 0), known + np.where(go, 0, missing[0])
        low = max(p.min_data_in_leaf, 1)
        gain = np.where((n_left >= low) & (n_right >= low), gain, -np.inf)
        k = int(gain.argmax())
        if gain[k] > 0 and gain[k] >= p.min_split_gain and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), int(f), int(order[k]) if not is_cat[f] else k, bool(go[k]), sorted(int(c) for c in order[: k + 1]) if is_cat[f] else None)
    return best


class JointModel:
    """Fitted joint trees. ``transform`` adds ``prediction``, an array by output."""

    def __init__(self, params: Params, binner: Binner, objectives: list[str], base: list[float], trees: list[JointTree], history: list[dict] | None = None):
        self.params, self.binner, self.objectives, self.base, self.trees, self.history = params, binner, objectives, base, trees, history or []

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        df = df.drop(prediction)
        at, binner, trees, base, names = [df.columns.index(f) for f in self.binner.features], self.binner, self.trees, np.asarray(self.base), self.objectives

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in batches:
                s = base + _all_scores(trees, binner.transform([r.column(i) for i in at]), len(base))
                out = np.hstack([losses.link(n, s[:, k : k + 1]) for k, n in enumerate(names)]) if r.num_rows else s
                yield pa.RecordBatch.from_arrays([*r.columns, _lists(out)], names=[*r.schema.names, prediction])

        return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"{prediction} array<double>").fields]))

    def unroll(self) -> list[Model]:
        """A model for each output, for explanations."""
        return [Model(replace(self.params, objective=n), self.binner, [self.base[k]], [replace(t.output_tree(k), output=0) for t in self.trees]) for k, n in enumerate(self.objectives)]


def _prepare(df: DataFrame, binner: Binner, labels: list[str], group: str | None, row_id: str | None, factors: list[str]) -> DataFrame:
    ys = F.array(*(F.col(y).cast("double") for y in labels))
    keep = df.withColumn("__ys", ys).withColumn("__y", F.lit(0.0))
    cols = [F.col(f).cast("string") if c is not None else F.col(f).cast("double") for f, c in zip(binner.features, binner.categories)]
    rid = F.col(row_id).cast("long") if row_id else F.xxhash64("__ys", *cols)
    rows = keep.select(rid.alias("rid"), (F.col(group).cast("long") if group else F.lit(0).cast("long")).alias("grp"), F.lit(1.0).alias("w"), F.col("__ys").alias("ys"), F.array(*(F.col(x).cast("double") for x in factors)).cast("array<double>").alias("f"), *(c.alias(f"x{i}") for i, c in enumerate(cols)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:5], _lists(binner.transform(b.columns[5:]))], names=["rid", "grp", "w", "ys", "f", "bins"])

    state = rows.mapInArrow(run, "rid long, grp long, w double, ys array<double>, f array<double>, bins array<int>")
    if group:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cut_lineage(state.repartition(n, "grp").sortWithinPartitions("grp", "rid"))
    return boosting.balanced(cut_lineage(state))


def fit(df: DataFrame, features: list[str], labels: list[str], objectives: list[str], params: Params, group: str | None = None, categorical: list[str] | None = None, factors: list[str] | None = None, warm: JointModel | None = None, row_id: str | None = None) -> JointModel:
    """Fits trees that all labels share, level by level or best leaf first; ``warm`` continues a model."""
    p = replace(params, objective="squared_error").check()
    if len(objectives) != len(labels) or any(o not in OBJECTIVES for o in objectives):
        raise ValueError(f"an objective of {OBJECTIVES} is needed for each label")
    if any(o.startswith("rank:") for o in objectives) and not group:
        raise ValueError("ranking objectives need a group")
    if p.leaf_model == "linear" or any(p.monotone.values()):
        raise ValueError("joint trees have constant leaves without monotone constraints")
    if p.neutralization != "none" and not factors:
        raise ValueError("neutralization needs factors")
    for y in labels:
        check_roles(df, y)
    binner = warm.binner if warm else boosting.fit_binner(df, features, categorical or [], p)
    used = list(factors or []) if p.neutralization != "none" else []
    state = _prepare(df, binner, labels, group, row_id, used)
    outputs = len(labels)
    base = warm.base if warm else [boosting.start_values(state.select(F.col("ys")[k].alias("y"), "w"), o, 1, p.options)[0] for k, o in enumerate(objectives)]
    state = state.withColumn("s", F.array(*(F.lit(float(x)) for x in base)))
    gram = boosting._gram(state, len(used), p.factor_ridge) if p.neutralization == "per_round_gradient" else None
    channels = len(used) if p.neutralization == "split_penalty" else 0
    done: list[JointTree] = list(warm.trees) if warm else []
    model = JointModel(p, binner, objectives, base, done)
    plan = morph.Schedule(p.morph, p.n_estimators, morph.learning_rates(p.n_estimators, p.learning_rate, p.morph.rise)) if p.morph else None
    written: list[float] = []
    for r in range(p.n_estimators):
        late = [replace(t, weight=t.weight - w) for t, w in zip(done, written) if t.weight != w] + done[len(written) :]
        if len(late) >= boosting.SCORE_EVERY:
            state, written, late = cut_lineage(_with_scores(state, late, outputs)), [t.weight for t in done], []
        drop: list[int] = []
        if p.boosting_mode == "dart" and done:
            drop = sampling.dropped_trees(len(done), p.dart_drop_rate, p.dart_max_drop, p.seed, r, [t.weight for t in done] if p.dart_sample == "weighted" else None)
        trees, tree = late + [replace(done[i], weight=-done[i].weight) for i in drop], JointTree()
        beta = boosting._projection(state, JointJob(p, objectives, trees, tree, r), gram)[0] if gram is not None else None
        job = JointJob(p, objectives, trees, tree, r, _drawn(state, p, objectives, trees, r, beta), beta)
        _grow(state, job, sampling.features_of_round(len(binner.features), p.col_subsample, p.seed, r), binner.sizes, [c is not None for c in binner.categories], channels, plan)
        _quantile_outputs(state, job)
        if len(tree.value) == 1 and not any(tree.vectors[0]):
            break
        if drop:
            k = len(drop)
            tree.weight = 1 / (k + 1)
            for i in drop:
                done[i] = replace(done[i], weight=done[i].weight * (k if p.dart_normalize == "tree" else 1) / (k + 1))
        done.append(tree)
        model.history.append({"round": r, "leaves": sum(x < 0 for x in tree.left)})
    return model


def _drawn(state: DataFrame, p: Params, objectives: list[str], trees: list[JointTree], r: int, beta) -> Drawn:
    """As in single-output training; GOSS goes by the sum of the outputs' |gradients|."""
    return boosting._drawn(state, p, len(objectives), trees, r, beta, JointJob(p, objectives, trees, JointTree(), r, Drawn(), beta))


def _with_scores(state: DataFrame, trees: list[JointTree], outputs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i = b.schema.names.index("s")
                b = b.set_column(i, "s", _lists(_rows(b.column("s")) + _all_scores(trees, _rows(b.column("bins")), outputs)))
            yield b

    return state.mapInArrow(run, state.schema)


def _quantile_outputs(state: DataFrame, job: JointJob) -> None:
    """Sets a quantile output's leaves to the quantile of their residuals over all rows, times the learning rate."""
    p, tree, trees = job.p, job.growing[0], job.trees
    outputs = [k for k, o in enumerate(job.objectives) if o == "quantile"]
    if not outputs:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bins = _rows(b.column("bins"))
            res, leaf = _rows(b.column("ys")) - _rows(b.column("s")) - _all_scores(trees, bins, job.outputs), tree.route(bins)
            for k in outputs:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), k, np.int32)), pa.array(leaf), pa.array(res[:, k])], names=["k", "leaf", "r"])

    found = binning.group_quantile(state.mapInArrow(run, "k int, leaf int, r double"), ["k", "leaf"], F.col("r"), p.options.get("quantile_alpha", 0.5))
    for row in found.collect():  # a row a leaf and output
        tree.vectors[row.leaf][row.k] = p.learning_rate * row.value
        if row.k == 0:
            tree.value[row.leaf] = tree.vectors[row.leaf][0]


def _grow(state: DataFrame, job: JointJob, allowed: np.ndarray, sizes: list[int], is_cat: list[bool], factors: int, plan: morph.Schedule | None) -> None:
    p, tree, k, r = job.p, job.growing[0], job.outputs, job.round
    nf, width, channels = len(sizes), max(sizes) + 1, 1 + 3 * job.outputs + factors
    across = max(1, min(nf, boosting.TILE_BYTES // (8 * width * channels)))
    down = max(1, boosting.TILE_BYTES // (8 * width * channels * across))
    hists: dict[int, np.ndarray] = {}
    paths: dict[int, frozenset] = {0: frozenset()}
    groups = [frozenset(g) for g in p.interactions]

    def collect(build: list[int]) -> None:
        for node in build:
            hists[node] = np.zeros((nf, width, channels))
        for at in range(0, len(build), down):
            for first in range(0, nf, across):
                part, past = build[at : at + down], min(first + across, nf)
                rows = state.mapInArrow(lambda it, part=part, first=first, past=past: job.joint_histogram(it, part, width, first, past, factors), "node int, feature int, bin int, sums array<double>")
                got = rows.groupBy("node", "feature", "bin").agg(*(F.sum(F.col("sums")[i]).alias(f"c{i}") for i in range(channels))).toPandas()
                v = got[[f"c{i}" for i in range(channels)]].to_numpy(float)
                node, f, b = (got[c].to_numpy(np.int64) for c in ("node", "feature", "bin"))
                for key in part:
                    hists[key][f[node == key], b[node == key]] = v[node == key]

    def add(node_sums: np.ndarray, depth: int) -> int:
        rate = plan.leaf_rate(r, max(depth - 1, 0)) if plan else p.learning_rate  # a joint leaf takes the rate of its split's depth
        vector = (rate * leaf_vector(node_sums, k, p)).tolist()
        tree.vectors.append(vector)
        return tree.add(vector[0], float(node_sums[0]))

    def candidate(node: int, depth: int) -> tuple | None:
        if depth >= p.max_depth:
            return None
        use = allowed
        if groups:
            live, free = [g for g in groups if paths[node] <= g], set(range(nf)) - set().union(*groups)
            use = np.array([f for f in allowed if f in free or any(f in g for g in live)], int)
        reshape = (lambda out, gain, *sums: plan.gain(r, out, gain, *sums, p.lambda_l2)) if plan else None
        return best_joint_split(hists[node], k, p, use, sizes, is_cat, reshape)

    tree.add(0.0, 0.0)
    tree.vectors.append([0.0] * k)
    collect([0])
    root = hists[0][0].sum(0)
    tree.cover[0] = float(root[0])
    tree.vectors[0] = ((plan.leaf_rate(r, 0) if plan else p.learning_rate) * leaf_vector(root, k, p)).tolist()
    tree.value[0] = tree.vectors[0][0]
    if plan:
        g, _, q = _sides(root, k)
        for out in range(k):
            plan.observe(out, g[out], root[0], q[out])
    frontier, leaves = {0: (0, candidate(0, 0))}, 1
    while True:
        ready = [(node, d, c) for node, (d, c) in frontier.items() if c]
        if p.max_leaves:
            ready = ready[: max(p.max_leaves - leaves, 0)] if p.tree_growth == "level" else ready if leaves < p.max_leaves else []
        if not ready:
            break
        if p.tree_growth == "leaf":
            ready = [max(ready, key=lambda x: x[2][0])]
        build, rest = [], []
        for node, d, (gain, f, thr, go, cats) in ready:
            h = hists[node]
            x = h[f, : sizes[f]]
            left = (x[cats] if cats is not None else x[: thr + 1]).sum(0) + (h[f, -1] if go else 0)
            right = h[f].sum(0) - left
            a, b = add(left, d + 1), add(right, d + 1)
            tree.feature[node], tree.threshold[node], tree.default_left[node], tree.cats[node], tree.left[node], tree.right[node], tree.gain[node] = f, thr, go, cats, a, b, gain
            paths[a] = paths[b] = paths[node] | {f}
            leaves += 1
            small, large = (a, b) if left[0] <= right[0] else (b, a)
            build.append(small)
            rest.append((node, d + 1, small, large))
            del frontier[node]
        if all(d >= p.max_depth for _, d, _, _ in rest) and p.tree_growth == "level":
            break
        collect(build)
        for node, d, small, large in rest:
            hists[large] = hists.pop(node) - hists[small]
            hists[large][np.abs(hists[large][:, :, 0]) < 0.5] = 0.0
            for c in (small, large):
                frontier[c] = (d, candidate(c, d))


def fit_independent(df: DataFrame, features: list[str], labels: list[str], objectives: list[str], params: Params, group: str | None = None, categorical: list[str] | None = None, **more) -> list[Model]:
    """A model for each label."""
    return [boosting.fit(df, features, y, replace(params, objective=o), group=group if o.startswith("rank:") else None, categorical=categorical, **more) for y, o in zip(labels, objectives)]
