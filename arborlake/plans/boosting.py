"""Boosted trees: a driver loop over distributed histogram jobs.

Binned rows are written once. A job per tree level replays the trees since
the last written score, computes gradients in Arrow batches, routes rows to
the level's nodes and sums gradients per (node, feature, bin) inside each
task; one small aggregation merges the tasks. The driver sees histograms
only: its work depends on nodes, features and bins, never on rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions import losses, ranking
from arborlake.operators import binning, sampling
from arborlake.plans import monotone, morph
from arborlake.sources.frames import check_roles, cut_lineage

MISSING = -1
EPSILON, TIE = 1e-6, 1e-6
#: Rounds after which scores are written, so that replaying stays short and lineage is cut.
SCORE_EVERY = 10
#: Cells of a leaf's interval in one pass of the search for its quantile.
QUANTILE_CELLS = 4096


@dataclass(frozen=True)
class Params:
    objective: str = "squared_error"
    n_estimators: int = 6
    learning_rate: float = 0.1
    max_depth: int = 6
    max_bins: int = 256
    binning: str = "quantile"
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    min_data_in_leaf: int = 1
    min_child_hessian: float = 0.0
    min_split_gain: float = 0.0
    row_subsample: float = 1.0
    col_subsample: float = 1.0
    seed: int = 0
    tree_growth: str = "level"
    max_leaves: int | None = None
    dro_radius: float = 0.0
    boosting_mode: str = "standard"
    goss_top_rate: float = 0.2
    goss_other_rate: float = 0.1
    dart_drop_rate: float = 0.1
    dart_max_drop: int = 5
    dart_normalize: str = "tree"
    dart_sample: str = "uniform"
    feature_weights: tuple[float, ...] = ()
    leaf_model: str = "constant"
    pl_split_candidates: int = 0
    neutralization: str = "none"
    factor_ridge: float = 1e-6
    factor_penalty: float = 0.0
    refine_leaves: bool = False
    max_leaf_value: float | None = None
    monotone: dict[int, int] = field(default_factory=dict)
    interactions: tuple[tuple[int, ...], ...] = ()
    early_stopping_rounds: int | None = None
    morph: morph.Morph | None = None
    options: dict = field(default_factory=dict)

    def check(self) -> Params:
        if not 0 < self.learning_rate <= 1:
            raise ValueError("learning_rate must be in (0, 1]")
        if not (0 < self.row_subsample <= 1 and 0 < self.col_subsample <= 1):
            raise ValueError("subsample rates must be in (0, 1]")
        if not 2 <= self.max_bins <= 65535:
            raise ValueError("max_bins must be in 2..65535")
        if self.binning not in BINNINGS:
            raise ValueError(f"binning is one of {BINNINGS}")
        if self.tree_growth == "leaf" and not (self.max_leaves and self.max_leaves >= 2):
            raise ValueError("leaf growth needs max_leaves of 2 or more")
        if self.boosting_mode == "dart" and any(self.monotone.values()):
            raise ValueError("dart cannot be combined with monotone constraints")
        if self.boosting_mode == "goss" and not (0 < self.goss_top_rate < 1 and 0 < self.goss_other_rate < 1 and self.goss_top_rate + self.goss_other_rate <= 1):
            raise ValueError("goss rates must be in (0, 1) with a sum of at most 1")
        if self.boosting_mode == "dart" and not (0 < self.dart_drop_rate < 1 and self.dart_max_drop >= 1):
            raise ValueError("dart rate must be in (0, 1) and max drop at least 1")
        if len(self.interactions) > 64:
            raise ValueError("at most 64 interaction groups")
        if self.dart_normalize not in ("tree", "forest") or self.dart_sample not in ("uniform", "weighted"):
            raise ValueError("dart_normalize is tree or forest, dart_sample uniform or weighted")
        if self.leaf_model not in ("constant", "linear") or self.neutralization not in ("none", "per_round_gradient", "split_penalty"):
            raise ValueError("leaf_model is constant or linear, neutralization none, per_round_gradient or split_penalty")
        if self.leaf_model == "linear" and (any(self.monotone.values()) or self.dro_radius or self.neutralization == "split_penalty" or self.objective == "quantile"):
            raise ValueError("linear leaves go with neither monotone constraints, robust gains, split penalties nor quantiles")
        if any(w < 0 or not np.isfinite(w) for w in self.feature_weights):
            raise ValueError("feature weights are finite and not negative")
        if self.refine_leaves and self.objective != "squared_error":
            raise ValueError("leaves are refined for squared_error only")
        return self


@dataclass
class Tree:
    """Nodes in arrays; children are indexes, -1 at leaves. ``cats`` holds the ids that go left."""

    output: int = 0
    weight: float = 1.0
    feature: list[int] = field(default_factory=list)
    threshold: list[int] = field(default_factory=list)
    default_left: list[bool] = field(default_factory=list)
    cats: list[list[int] | None] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    #: node -> (features, weights) of a linear leaf, on standardised values
    linear: dict[int, tuple[list[int], list[float]]] = field(default_factory=dict)

    def add(self, value: float, cover: float) -> int:
        for name, x in (("feature", -1), ("threshold", 0), ("default_left", True), ("cats", None), ("left", -1), ("right", -1), ("value", value), ("gain", 0.0), ("cover", cover)):
            getattr(self, name).append(x)
        return len(self.value) - 1

    def goes_left(self, node: int, b: np.ndarray) -> np.ndarray:
        go = np.isin(b, self.cats[node]) if self.cats[node] is not None else b <= self.threshold[node]
        return np.where(b == MISSING, self.default_left[node], go)

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of a (rows, features) matrix; each node splits the rows that reach it."""
        at = np.zeros(len(bins), np.int32)
        stack = [(0, np.arange(len(bins)))]
        while stack:
            node, rows = stack.pop()
            at[rows] = node
            if self.left[node] >= 0 and len(rows):
                go = self.goes_left(node, bins[rows, self.feature[node]])
                stack += [(self.left[node], rows[go]), (self.right[node], rows[~go])]
        return at

    def predict(self, bins: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
        """Weighted leaf values; ``z`` are standardised raw values (0 where missing), for linear leaves."""
        at = self.route(bins)
        out = np.asarray(self.value)[at]
        for node, (feats, weights) in self.linear.items():
            rows = np.flatnonzero(at == node)
            if len(rows):
                out[rows] += z[np.ix_(rows, feats)] @ np.asarray(weights)
        return self.weight * out


@dataclass
class Binner:
    features: list[str]
    cuts: list[np.ndarray]
    categories: list[dict[str, int] | None]
    #: mean and inverse deviation of each feature (0 and 1 for categories), for linear leaves
    means: list[float] = field(default_factory=list)
    scales: list[float] = field(default_factory=list)

    def transform(self, columns: list[pa.Array]) -> np.ndarray:
        out = np.empty((len(columns[0]), len(columns)), np.int32)
        for f, c in enumerate(columns):
            known = self.categories[f]
            if known is not None:
                kinds = c.cast(pa.string()).dictionary_encode()
                ids = np.array([known.get(v, MISSING) for v in kinds.dictionary.to_pylist()] + [MISSING], np.int32)
                out[:, f] = ids[kinds.indices.fill_null(len(ids) - 1).to_numpy(zero_copy_only=False)]
            else:
                v = c.cast(pa.float64()).to_numpy(zero_copy_only=False)
                out[:, f] = np.where(np.isnan(v), MISSING, np.searchsorted(self.cuts[f], v, side="right"))
        return out

    def standardised(self, columns: list[pa.Array]) -> np.ndarray:
        """Raw values less mean, by deviation; 0 where missing and for categories."""
        out = np.zeros((len(columns[0]), len(columns)))
        for f, c in enumerate(columns):
            if self.categories[f] is None and self.means:
                v = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) - self.means[f]) * self.scales[f]
                out[:, f] = np.where(np.isfinite(v), v, 0.0)
        return out

    @property
    def sizes(self) -> list[int]:
        return [len(c) if c is not None else len(k) + 1 for c, k in zip(self.categories, self.cuts)]


BINNINGS = ("quantile", "sketch", "linear", "rank", "linear_rank", "prebinned")


def _numeric_cuts(df: DataFrame, numeric: list[str], p: Params) -> dict[str, list[float]]:
    """Cuts of each feature, at most ``max_bins`` of them: a value's bin is the number of cuts at or below it."""
    if p.binning in ("quantile", "sketch"):
        make = binning.approximate_cuts if p.binning == "sketch" else binning.quantile_cuts
        found: dict[str, list[float]] = {}
        for r in make(df, numeric, p.max_bins).collect():
            found.setdefault(r.feature, []).append(r.cut)
        return found
    ends = {r.feature: r for r in binning.bounds(df, numeric).collect()}  # a row a feature
    if p.binning == "prebinned":
        odd = [r.feature for r in binning.is_prebinned(df, numeric).collect() if not r.prebinned or (ends[r.feature].high or 0) >= p.max_bins]
        if odd:
            raise ValueError(f"{odd} hold no bins from 0 to {p.max_bins - 1}")
        return {f: [b + 0.5 for b in range(int(e.high or 0))] for f, e in ends.items()}
    most = p.max_bins - 1
    by_rank = set(numeric) if p.binning == "rank" else {r.feature for r in binning.tail_rank_features(df, numeric).collect() if r.by_rank} if p.binning == "linear_rank" else set()
    found = {f: [e.low + (i + 0.5) / most * (e.high - e.low) for i in range(most)] for f, e in ends.items() if f not in by_rank and e.low is not None and e.high - e.low > 1e-6}
    for f in by_rank:  # the smallest value of each bin but the first
        ranked = binning.bin_rank(df.select(F.col(f).cast("double").alias("v")), "v", most, "b")
        found[f] = sorted(r.v for r in ranked.filter("b is not null").groupBy("b").agg(F.min("v").alias("v")).collect())[1:]  # at most max_bins rows
    return found


def fit_binner(df: DataFrame, features: list[str], categorical: list[str], p: Params) -> Binner:
    numeric = [f for f in features if f not in categorical]
    cats: dict[str, dict[str, int]] = {}
    found = dict.fromkeys(numeric, ()) | (_numeric_cuts(df, numeric, p) if numeric else {})
    for f in categorical:
        values = [r[0] for r in df.select(F.col(f).cast("string")).filter(F.col(f).isNotNull()).distinct().orderBy(f).limit(p.max_bins + 1).collect()]
        if len(values) > p.max_bins:
            raise ValueError(f"{f} has more than {p.max_bins} categories; encode it first")
        cats[f] = {v: i for i, v in enumerate(values)}
    means, scales = [], []
    if p.leaf_model == "linear":
        scale = {r.feature: r for r in binning.scaler(df, numeric).collect()} if numeric else {}  # a row a feature
        means, scales = [float(scale[f].mean) if f in scale else 0.0 for f in features], [float(scale[f].inv_std) if f in scale else 1.0 for f in features]
    return Binner(features, [np.array(sorted(found.get(f, []))) for f in features], [cats.get(f) for f in features], means, scales)


def _gain_term(g, h, p: Params, n=None, sq=None):
    t = p.lambda_l1
    if p.dro_radius:
        n = np.maximum(n, 1)
        t = t + p.dro_radius * np.sqrt(n) * np.sqrt(np.maximum(sq / n - (g / n) ** 2, 0))
    e = np.sign(g) * np.maximum(np.abs(g) - t, 0)
    return e, e * e / (h + p.lambda_l2 + EPSILON)


#: Columns of a histogram before those of the factors: gradients, hessians, rows, squared gradients.
SUMS = 4


def _factor_load(left: np.ndarray, right: np.ndarray, total_rows: float, p: Params) -> np.ndarray:
    """Penalty on a split whose two leaves load on the factors."""
    lv, rv = (-_gain_term(x[:, 0], x[:, 1], p, x[:, 2], x[:, 3])[0] / (x[:, 1] + p.lambda_l2 + EPSILON) for x in (left, right))
    load = left[:, SUMS:] * lv[:, None] + right[:, SUMS:] * rv[:, None]
    return p.factor_penalty * (load**2).sum(1) / max(total_rows, 1.0)


def feature_splits(hist: np.ndarray, p: Params, f: int, size: int, categorical: bool, reshape: Callable | None = None) -> Iterator[tuple]:
    """(gain, threshold, default_left, cats) of a feature's best split in each missing direction."""
    total = hist[f].sum(0)
    parent = _gain_term(total[0], total[1], p, total[2], total[3])[1]
    x, missing = hist[f, :size], hist[f, -1]
    order = np.argsort(x[:, 0] / (x[:, 1] + p.lambda_l2 + EPSILON), kind="stable") if categorical else np.arange(size)
    if categorical:
        order = order[x[order, 2] > 0]
    run = np.cumsum(x[order], axis=0)
    for go in (True, False) if missing[2] else (True,):
        left = run + (missing if go else 0)
        right = total - left
        gain = _gain_term(left[:, 0], left[:, 1], p, left[:, 2], left[:, 3])[1] + _gain_term(right[:, 0], right[:, 1], p, right[:, 2], right[:, 3])[1] - parent
        if reshape:
            gain = reshape(gain, total, left, right)
        if p.factor_penalty and hist.shape[2] > SUMS:
            gain = gain - _factor_load(left, right, total[2], p)
        low = max(p.min_data_in_leaf, 1)
        ok = (left[:, 2] >= low) & (right[:, 2] >= low) & (left[:, 1] > p.min_child_hessian) & (right[:, 1] > p.min_child_hessian)
        sign = p.monotone.get(int(f), 0)
        if sign:
            lv, rv = (-s[:, 0] / (s[:, 1] + p.lambda_l2 + EPSILON) for s in (left, right))
            ok &= sign * (rv - lv) >= 0
        gain = np.where(ok, gain, -np.inf)
        if len(gain) and gain.max() > -np.inf:
            k = int(gain.argmax())
            yield float(gain[k]), k, go, sorted(int(c) for c in order[: k + 1]) if categorical else None


def ranked_splits(hist: np.ndarray, p: Params, allowed: np.ndarray, sizes: list[int], categorical: list[bool], reshape: Callable | None = None) -> list[tuple]:
    """(gain, feature, threshold, default_left, cats) of the best split of each feature, the best one first.

    Feature weights scale the comparison only. A later feature must be better
    by more than the tolerance.
    """
    weight = p.feature_weights or np.ones(hist.shape[0])
    found: list[tuple] = []
    for f in allowed:
        own = None
        for v, k, go, cats in feature_splits(hist, p, int(f), sizes[f], categorical[f], reshape):
            if own is None or v > own[0] + TIE * max(abs(v), abs(own[0]), 1.0):
                own = (v, int(f), k, go, cats)
        if own and own[0] > max(p.min_split_gain, 0.0) and weight[f] > 0:
            found.append(own)
    out: list[tuple] = []
    while found:  # the tolerant fold over features in their order, again and again
        top = found[0]
        for c in found[1:]:
            a, b = c[0] * weight[c[1]], top[0] * weight[top[1]]
            if a > b + TIE * max(abs(a), abs(b), 1.0):
                top = c
        out.append(top)
        found.remove(top)
    return out


def best_split(hist: np.ndarray, p: Params, allowed: np.ndarray, sizes: list[int], categorical: list[bool], reshape: Callable | None = None) -> tuple | None:
    """(gain, feature, threshold, default_left, cats) of a node's histogram (feature, bin + missing last, sums and factors); ``reshape`` turns plain gains into others."""
    found = ranked_splits(hist, p, allowed, sizes, categorical, reshape)
    return found[0] if found else None


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def _lists(x: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _scores(trees: list[Tree], bins: np.ndarray, outputs: int, z: np.ndarray | None = None) -> np.ndarray:
    s = np.zeros((len(bins), outputs))
    for t in trees:
        s[:, t.output] += t.predict(bins, z)
    return s


@dataclass(frozen=True)
class Drawn:
    """The rows of a round: those under a limit of the row's number, or GOSS limits and weight."""

    limit: float = 1.0
    goss: tuple[float, float, float, float] | None = None  # |gradient|, number at that gradient, number of the others, their weight


class Job:
    """The per-batch work of one level, as the workers run it."""

    def __init__(self, p: Params, outputs: int, trees: list[Tree], growing: list[Tree], round_index: int, drawn: Drawn = Drawn(), beta: np.ndarray | None = None):
        self.p, self.outputs, self.trees, self.growing, self.round, self.drawn, self.beta = p, outputs, trees, growing, round_index, drawn, beta

    def gradients(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
        """(bins, gradients, hessians, row numbers, the rows) of all rows."""
        p = self.p
        grouped = p.objective.startswith("rank:") and p.objective != "rank:rmse"
        for t in ranking.whole_groups(batches) if grouped else (pa.Table.from_batches([b]) for b in batches):
            if not t.num_rows:
                continue
            bins = _rows(t.column("bins"))
            y, w, rid = t.column("y").to_numpy(), t.column("w").to_numpy(), t.column("rid").to_numpy()
            z = _rows(t.column("z")) if "z" in t.column_names else None
            s = _rows(t.column("s")) + _scores(self.trees, bins, self.outputs, z)
            if grouped:
                g, h = np.zeros_like(s), np.zeros_like(s)
                grp = t.column("grp").to_numpy()
                edge = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
                for a, b in zip(edge, edge[1:]):
                    g[a:b, 0], h[a:b, 0] = losses.group_gradients(p.objective, s[a:b, 0], y[a:b], p.options | {"seed": p.seed}, int(grp[a]))
            else:
                g, h = losses.row_gradients(p.objective, s, y, w, p.options)
            if self.beta is not None:
                g = g - _rows(t.column("f")) @ self.beta
            yield bins, g, h, sampling.uniform(rid, p.seed, self.round), t

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
        """(bins, gradients, hessians, rows) of the drawn rows."""
        for bins, g, h, u, t in self.gradients(batches):
            if self.drawn.goss:
                least, at, others, weight = self.drawn.goss
                size = np.abs(g).sum(1)
                big = (size > least) | ((size == least) & (u <= at))
                keep = big | (u <= others)
                scale = np.where(big, 1.0, weight)[keep, None]
                yield bins[keep], g[keep] * scale, h[keep] * scale, t.filter(pa.array(keep))
            elif self.drawn.limit < 1:
                keep = u <= self.drawn.limit
                yield bins[keep], g[keep], h[keep], t.filter(pa.array(keep))
            else:
                yield bins, g, h, t

    def histogram(self, batches: Iterator[pa.RecordBatch], build: list[tuple[int, int]], width: int, first: int, past: int, factors: int = 0) -> Iterator[pa.RecordBatch]:
        """Rows (k, node, feature, bin, sums) of the features first..past for the nodes to build."""
        f, channels = past - first, SUMS + factors
        sums = np.zeros((channels, len(build) * f * width))
        slot = {k: np.full(len(self.growing[k].value), -1) for k in range(self.outputs)}
        for i, (k, node) in enumerate(build):
            slot[k][node] = i
        squares = 0.0
        for bins, g, h, t in self.parts(batches):
            squares += float((h[np.isfinite(h)] ** 2).sum())
            x = _rows(t.column("f")) if factors else None
            for k in {k for k, _ in build}:
                at = slot[k][self.growing[k].route(bins)]
                rows = np.flatnonzero(at >= 0)
                own = bins[rows, first:past]
                cell = ((at[rows, None] * f + np.arange(f)) * width + np.where(own == MISSING, width - 1, own)).ravel()
                gk, hk = np.repeat(g[rows, k], f), np.repeat(h[rows, k], f)
                for i, v in enumerate((gk, hk, None, gk * gk, *(np.repeat(x[rows, j], f) for j in range(factors)))):
                    sums[i] += np.bincount(cell, v, sums.shape[1])
        cell = np.flatnonzero(sums[2])
        if not len(cell):
            return
        at = cell // (f * width)
        ks, nodes = (np.array([b[i] for b in build], np.int32) for i in (0, 1))
        each = sums[:, cell].T
        none = np.zeros((1, channels))
        none[0, 0] = squares  # a row without a node carries the squared hessians
        col = lambda x: pa.array(np.append(x, -1).astype(np.int32))
        yield pa.RecordBatch.from_arrays([col(ks[at]), col(nodes[at]), col(first + cell // width % f), col(cell % width), _lists(np.vstack([each, none]))], names=["k", "node", "feature", "bin", "sums"])


_HIST = "k int, node int, feature int, bin int, sums array<double>"
#: Bytes of sums that a task holds; more nodes or features take more jobs.
TILE_BYTES = 128 << 20


class Model:
    """Fitted trees. ``transform`` adds ``prediction`` (and ``probability`` for classifiers)."""

    def __init__(self, params: Params, binner: Binner, base: list[float], trees: list[Tree], classes: list | None = None, history: list[dict] | None = None):
        self.params, self.binner, self.base, self.trees, self.classes, self.history = params, binner, base, trees, classes, history or []
        self.best_iteration, self.best_score = len(trees) // max(len(base), 1), None

    def __getstate__(self) -> dict:
        """A pickled model scores; functions among its options stay behind."""
        kept = {k: v for k, v in self.params.options.items() if not callable(v)}
        return self.__dict__ | {"params": replace(self.params, options=kept)}

    def raw(self, bins: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
        return np.asarray(self.base) + _scores(self.trees, bins, len(self.base), z)

    @property
    def is_linear(self) -> bool:
        return any(t.linear for t in self.trees)

    def transform(self, df: DataFrame, prediction: str = "prediction", probability: str = "probability") -> DataFrame:
        """Scores in Arrow batches; works on batch and streaming frames alike."""
        missing = [f for f in self.binner.features if f not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        b, name, classes, linear = self.binner, self.params.objective, self.classes, self.is_linear
        df = df.drop(prediction, *([probability] if classes is not None else []))  # new values take the place of old ones
        at = [df.columns.index(f) for f in b.features]
        schema = f"{prediction} double" + (f", {probability} array<double>" if classes is not None else "")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in batches:
                raw = [r.column(i) for i in at]
                p = losses.link(name, self.raw(b.transform(raw), b.standardised(raw) if linear else None))
                new = {}
                if classes is None:
                    new[prediction] = pa.array(p[:, 0])
                else:
                    if p.shape[1] == 1:
                        p = np.hstack([1 - p, p])
                    p = np.round(p, 7)
                    new[prediction] = pa.array(np.asarray(classes, float)[np.where(p.shape[1] == 2, p[:, -1] >= 0.5, p.argmax(1)).astype(int)])
                    new[probability] = _lists(p)
                yield pa.RecordBatch.from_arrays([*r.columns, *new.values()], names=[*r.schema.names, *new])

        from pyspark.sql.types import StructType

        return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(schema).fields]))

    def importances(self) -> dict[str, float]:
        """Summed split gain of each feature."""
        total = dict.fromkeys(self.binner.features, 0.0)
        for t in self.trees:
            for f, g, left in zip(t.feature, t.gain, t.left):
                if left >= 0:
                    total[self.binner.features[f]] += g
        return total


def start_values(state: DataFrame, objective: str, outputs: int, options: dict) -> list[float]:
    if objective in ("softmax",) or objective.startswith("rank:") and objective != "rank:rmse" or options.get("custom"):
        return [0.0] * outputs
    if objective == "quantile":
        rows = state.select(F.lit(0).alias("all"), "y", "w")
        return [float(binning.group_quantile(rows, ["all"], F.col("y"), options.get("quantile_alpha", 0.5), F.col("w")).first().value)]
    mean = state.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()[0]
    if objective == "binary":
        q = min(max(mean, 1e-7), 1 - 1e-7)
        return [float(np.log(q / (1 - q)))]
    return [float(np.log(max(mean, 1e-7)))] if objective in ("poisson", "gamma", "tweedie") else [float(mean)]


def prepare(df: DataFrame, binner: Binner, label: str, weight: str | None, group: str | None, row_id: str | None = None, factors: list[str] | None = None, linear: bool = False) -> DataFrame:
    """rid, y, w, grp, bins (and f: factors, z: standardised values): what the rounds read. Rows of a group lie together, in order.

    ``rid`` names a row for sampling: its id if there is one, else a hash of
    all that is read of it, so rows that are alike are drawn alike.
    """
    cols = [F.col(f).cast("string") if c is not None else F.col(f).cast("double") for f, c in zip(binner.features, binner.categories)]
    named = [c.alias(f"x{i}") for i, c in enumerate(cols)]
    own = [F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (F.col(group).cast("long") if group else F.lit(0).cast("long")).alias("grp")]
    f = F.array(*(F.col(x).cast("double") for x in factors or [])).cast("array<double>")
    rid = F.col(row_id).cast("long") if row_id else F.xxhash64(*own, *cols)
    rows = df.select(rid.alias("rid"), *own, f.alias("f"), *named).filter("w > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.columns[5:]
            extra = [_lists(binner.standardised(raw))] if linear else []
            yield pa.RecordBatch.from_arrays([*b.columns[:5], _lists(binner.transform(raw)), *extra], names=["rid", "y", "w", "grp", "f", "bins", *(["z"] if linear else [])])

    state = rows.mapInArrow(run, "rid long, y double, w double, grp long, f array<double>, bins array<int>" + (", z array<double>" if linear else ""))
    if not factors:
        state = state.drop("f")
    if group:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cut_lineage(state.repartition(n, "grp").sortWithinPartitions("grp", "rid"))
    return balanced(cut_lineage(state))


#: Rows below which an uneven table is left as it is.
FEW_ROWS = 20_000


def balanced(state: DataFrame) -> DataFrame:
    """Deals rows anew when one task would hold far more than its share: every round reads them several times."""
    sizes = [r.n for r in state.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]  # a row a partition
    tasks = state.sparkSession.sparkContext.defaultParallelism
    if sum(sizes) < FEW_ROWS or max(sizes) <= 2 * sum(sizes) / tasks:
        return state
    return cut_lineage(state.repartition(max(tasks, len(sizes)), "rid"))


def _loss(state: DataFrame, p: Params, trees: list[Tree], outputs: int) -> float:
    """The objective's loss over prepared rows."""
    job = Job(p, outputs, trees, [], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grouped = p.objective.startswith("rank:")
        total, count = 0.0, 0.0
        for t in ranking.whole_groups(batches) if grouped else (pa.Table.from_batches([b]) for b in batches):
            if not t.num_rows:
                continue
            bins, y, w = _rows(t.column("bins")), t.column("y").to_numpy(), t.column("w").to_numpy()
            s = _rows(t.column("s")) + _scores(job.trees, bins, outputs, _rows(t.column("z")) if "z" in t.column_names else None)
            if grouped:
                grp = t.column("grp").to_numpy()
                edge = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
                parts = [losses.group_loss(p.objective, s[a:b, 0], y[a:b], w[a:b], p.options) for a, b in zip(edge, edge[1:])]
                total, count = total + sum(x for x, _ in parts), count + sum(n for _, n in parts)
            else:
                a, b = losses.row_loss(p.objective, s, y, w, p.options)
                total, count = total + a, count + b
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([count])], names=["s", "n"])

    got = state.mapInArrow(run, "s double, n double").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    return float(got.s / got.n) if got.n else 0.0


def _projection(state: DataFrame, job: Job, gram: np.ndarray) -> np.ndarray:
    """Coefficients (factor, output) that a round's gradients are freed of."""
    k = len(gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros((k, job.outputs)), 0.0
        for _, g, _, _, t in job.gradients(batches):
            total += _rows(t.column("f")).T @ (g * t.column("w").to_numpy()[:, None])
            square += float((g**2).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(k * job.outputs), -1)), pa.array(np.append(total.ravel(), square))], names=["i", "v"])

    got = {r.i: r.v for r in state.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}  # a row a factor and output
    rhs = np.array([got[i] for i in range(k * job.outputs)]).reshape(k, job.outputs)
    return np.linalg.solve(gram, rhs), float(np.sqrt(got[-1]))


def _gram(state: DataFrame, k: int, ridge: float) -> np.ndarray:
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sums = state.agg(*(F.sum(F.col("w") * F.col("f")[i] * F.col("f")[j]) for i, j in upper)).first()
    out = ridge * np.eye(k)
    for (i, j), v in zip(upper, sums):
        out[i, j] += v
        out[j, i] += v if i != j else 0.0
    return out


def _drawn(state: DataFrame, p: Params, outputs: int, trees: list[Tree], r: int, beta: np.ndarray | None, job: Job | None = None) -> Drawn:
    """The limits that draw exactly the wanted counts of rows, found by counting; ``job`` gives the gradients."""
    if p.boosting_mode != "goss":
        if p.row_subsample >= 1:
            return Drawn()
        rows = state.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array(sampling.uniform(b.column("rid").to_numpy(), p.seed, r))], names=["u"]) for b in it), "u double")
        found = sampling.kth(rows, "u", int(np.ceil(state.count() * p.row_subsample)))
        return Drawn(limit=found[0] if found else 1.0)
    job = job or Job(p, outputs, trees, [], r, Drawn(), beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g, _, u, _ in job.gradients(batches):
            yield pa.RecordBatch.from_arrays([pa.array(-np.abs(g).sum(1)), pa.array(u)], names=["a", "u"])

    sizes = cut_lineage(state.mapInArrow(run, "a double, u double"))
    n = sizes.count()
    top_n = min(max(int(np.ceil(n * p.goss_top_rate)), 1), n)
    at, below = sampling.kth(sizes, "a", top_n)
    number = sampling.kth(sizes.filter(F.col("a") == at), "u", top_n - below)[0]
    rest = sizes.filter((F.col("a") > at) | ((F.col("a") == at) & (F.col("u") > number)))
    left = rest.count()
    other = sampling.kth(rest, "u", min(int(np.ceil(n * p.goss_other_rate)), left)) if left else None
    if other is None:
        return Drawn(goss=(-at, number, -1.0, 1.0))
    return Drawn(goss=(-at, number, other[0], left / rest.filter(F.col("u") <= other[0]).count()))


@dataclass
class Fitting:
    """What a fit keeps between its rounds."""

    state: DataFrame
    params: Params
    outputs: int
    sizes: list[int]
    is_cat: list[bool]
    gram: np.ndarray | None = None
    factors: int = 0
    plan: morph.Schedule | None = None
    #: trees that the column s holds, with the weights they had then
    written: list[float] = field(default_factory=list)

    def replay(self, done: list[Tree]) -> list[Tree]:
        """Trees whose weighted sum brings the written scores up to date: new ones, and changes of weight."""
        known = len(self.written)
        return [replace(t, weight=t.weight - w) for t, w in zip(done, self.written) if t.weight != w] + done[known:]

    def keep(self, done: list[Tree]) -> None:
        """Writes scores when replaying gets long."""
        late = self.replay(done)
        if len(late) >= SCORE_EVERY * self.outputs:
            self.state = cut_lineage(_with_scores(self.state, late, self.outputs))
            self.written = [t.weight for t in done]


def fit(df: DataFrame, features: list[str], label: str, params: Params, weight: str | None = None, group: str | None = None, categorical: list[str] | None = None, classes: list | None = None, evaluate: Callable[[Model], float] | None = None,
        warm: Model | None = None, valid: DataFrame | None = None, row_id: str | None = None, factors: list[str] | None = None) -> Model:
    """Fits a model.

    For early stopping, ``valid`` is a table whose loss is taken each round (its
    scores are kept, so a round reads it once), and ``evaluate`` gives a loss
    of the model so far. ``warm`` continues a model. Targets must be there and
    finite, weights finite and not negative, at least one row have a weight.
    """
    p = params.check()
    check_roles(df, label, weight)
    if p.neutralization != "none" and not factors:
        raise ValueError("neutralization needs factors")
    outputs = len(classes) if p.objective == "softmax" else 1
    binner = warm.binner if warm else fit_binner(df, features, categorical or [], p)
    linear = p.leaf_model == "linear" or bool(warm and warm.is_linear)
    used = list(factors or []) if p.neutralization != "none" else []
    state = prepare(df, binner, label, weight, group, row_id, used, linear)
    base = warm.base if warm else start_values(state, p.objective, outputs, p.options)
    done: list[Tree] = list(warm.trees) if warm else []
    if warm and any(p.monotone.values()):
        monotone.validate(done, p.monotone, p.max_leaf_value)
    model = Model(p, binner, base, done, classes)
    start = F.array(*(F.lit(float(x)) for x in base))
    fitting = Fitting(state.withColumn("s", start), p, outputs, binner.sizes, [c is not None for c in binner.categories], factors=len(used))
    if p.neutralization == "per_round_gradient":
        fitting.gram, fitting.factors = _gram(state, len(used), p.factor_ridge), 0
    checked = None
    if valid is not None:
        check_roles(valid, label, weight)
        rows = prepare(valid, binner, label, weight, group, row_id, [], linear).withColumn("s", start)
        checked = Fitting(rows, p, outputs, binner.sizes, fitting.is_cat)
    best_at, best_loss = 0, np.inf
    fitting.plan = morph.Schedule(p.morph, p.n_estimators, morph.learning_rates(p.n_estimators, p.learning_rate, p.morph.rise)) if p.morph else None
    for r in range(p.n_estimators):
        fitting.keep(done)
        trees = fitting.replay(done)
        drop: list[int] = []
        if p.boosting_mode == "dart" and done:
            weights = [t.weight for t in done[::outputs]] if p.dart_sample == "weighted" else None
            drop = [i * outputs + k for i in sampling.dropped_trees(len(done) // outputs, p.dart_drop_rate, p.dart_max_drop, p.seed, r, weights) for k in range(outputs)]
            trees = trees + [replace(done[i], weight=-done[i].weight) for i in drop]
        growing = [Tree(output=k) for k in range(outputs)]
        beta, before = _projection(fitting.state, Job(p, outputs, trees, [], r), fitting.gram) if fitting.gram is not None else (None, None)
        job = Job(p, outputs, trees, growing, r, _drawn(fitting.state, p, outputs, trees, r, beta), beta)
        allowed = sampling.features_of_round(len(binner.features), p.col_subsample, p.seed, r)
        record = _grow(fitting, job, allowed, before)
        if p.objective == "quantile" and not any(p.monotone.values()):
            plan = fitting.plan
            _quantile_leaves(fitting.state, p, trees, growing[0], (lambda d: plan.leaf_rate(r, d)) if plan else (lambda d: p.learning_rate))
        elif p.refine_leaves:
            _mean_leaves(fitting.state, p, trees, growing[0])
        if p.leaf_model == "linear":
            _linear_leaves(fitting.state, job)
        if all(len(t.value) == 1 for t in growing) and not any(abs(t.value[0]) > 0 for t in growing):
            model.history.append({"round": r, "stopped": "no split"})
            break
        if drop:
            k = len(drop) // outputs
            for t in growing:
                t.weight = 1 / (k + 1)
            for i in drop:
                done[i] = replace(done[i], weight=done[i].weight * (k if p.dart_normalize == "tree" else 1) / (k + 1))
        done += growing
        model.history.append({"round": r, "leaves": sum(x < 0 for t in growing for x in t.left), **record})
        loss = None
        if checked is not None:
            checked.keep(done)
            loss = model.history[-1]["valid_loss"] = _loss(checked.state, p, checked.replay(done), outputs)
        elif evaluate:
            loss = model.history[-1]["loss"] = float(evaluate(model))
        if loss is not None:
            if loss < best_loss:
                best_at, best_loss = len(done), loss
            elif p.early_stopping_rounds and len(done) - best_at >= p.early_stopping_rounds * outputs:
                model.history[-1]["stopped"] = "early"
                break
    if p.early_stopping_rounds and best_at:
        del done[best_at:]
    model.best_iteration = (best_at or len(done)) // outputs
    model.best_score = best_loss if best_at else None
    return model


def _with_scores(state: DataFrame, trees: list[Tree], outputs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.names.index("s")
            if b.num_rows:
                s = _rows(b.column("s")) + _scores(trees, _rows(b.column("bins")), outputs, _rows(b.column("z")) if "z" in b.schema.names else None)
                b = b.set_column(i, "s", _lists(s))
            yield b

    return state.mapInArrow(run, state.schema)


def _mean_leaves(state: DataFrame, p: Params, trees: list[Tree], tree: Tree) -> None:
    """Sets each leaf to the weighted mean of its residuals over all rows, drawn or not, times the learning rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(tree.value)))
        for b in batches:
            if b.num_rows:
                bins, w = _rows(b.column("bins")), b.column("w").to_numpy()
                res = b.column("y").to_numpy() - (_rows(b.column("s")) + _scores(trees, bins, 1))[:, 0]
                at = tree.route(bins)
                sums += [np.bincount(at, v, len(tree.value)) for v in (w * res, w)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tree.value))), pa.array(sums[0]), pa.array(sums[1])], names=["leaf", "s", "w"])

    limit = p.max_leaf_value or np.inf
    for r in state.mapInArrow(run, "leaf long, s double, w double").groupBy("leaf").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).collect():  # a row a leaf
        if r.w > 0 and tree.left[r.leaf] < 0:
            tree.value[r.leaf] = float(np.clip(p.learning_rate * r.s / r.w, -limit, limit))


#: Features of a linear leaf, and how unequal the diagonal of its system may be. (Fixed values.)
MOST_REGRESSORS, MOST_RATIO = 8, 1e6


def ridge(hx: np.ndarray, l2: float) -> np.ndarray | None:
    """Cholesky factor of X'HX + l2 I; None if it is not well conditioned."""
    a = hx + l2 * np.eye(len(hx))
    d = np.diag(a)
    if not len(d) or not np.isfinite(a).all() or d.min() <= 0 or d.max() / d.min() > MOST_RATIO:
        return None
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return None


def linear_gain(xg: np.ndarray, hx: np.ndarray, l2: float) -> float:
    """Half the squared length of L^-1 X'g: what a linear leaf gains over none."""
    low = ridge(hx, l2)
    return 0.0 if low is None else float(0.5 * (np.linalg.solve(low, xg) ** 2).sum())


def linear_weights(xg: np.ndarray, hx: np.ndarray, l2: float) -> np.ndarray:
    """-(X'HX + l2 I)^-1 X'g; zeros if the system is not well conditioned."""
    low = ridge(hx, l2)
    return np.zeros(len(xg)) if low is None else -np.linalg.solve(low.T, np.linalg.solve(low, xg))


def _path_features(tree: Tree, node: int, is_cat: list[bool]) -> list[int]:
    """Different numeric features on the way to a node, from the root on."""
    up = {c: i for i in range(len(tree.left)) for c in (tree.left[i], tree.right[i]) if c >= 0}
    path: list[int] = []
    while node:
        node = up[node]
        path.append(tree.feature[node])
    return list(dict.fromkeys(f for f in reversed(path) if not is_cat[f]))[:MOST_REGRESSORS]


def _linear_sums(state: DataFrame, job: Job, wanted: dict[tuple[int, int, int], list[int]], width: int) -> dict[tuple[int, int, int, int], np.ndarray]:
    """Sums of X'g, X'HX and X'h by (output, node, split feature or -1, bin or 0) for the regressors that each (output, node, feature) asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for bins, g, h, t in job.parts(batches):
            z = _rows(t.column("z"))
            for k in {k for k, _, _ in wanted}:
                at = job.growing[k].route(bins)
                for (k2, node, f), use in wanted.items():
                    rows = np.flatnonzero(at == node) if k2 == k else np.zeros(0, int)
                    if not len(rows):
                        continue
                    x, d = z[np.ix_(rows, use)], len(use)
                    each = np.hstack([x * g[rows, k, None], (x[:, :, None] * x[:, None, :]).reshape(len(rows), d * d) * h[rows, k, None], x * h[rows, k, None]])
                    cell = np.zeros(len(rows), int) if f < 0 else np.where(bins[rows, f] == MISSING, width - 1, bins[rows, f])
                    sums = held.setdefault((k, node, f), np.zeros((1 if f < 0 else width, 2 * d + d * d)))
                    for c in range(each.shape[1]):
                        sums[:, c] += np.bincount(cell, each[:, c], len(sums))
        out = [(*key, b, row.tolist()) for key, sums in held.items() for b, row in enumerate(sums) if row.any()]
        kinds = [pa.int32()] * 4 + [pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out) if out else ([], [], [], [], []), kinds)], names=["k", "node", "f", "b", "v"])

    rows = state.mapInArrow(run, "k int, node int, f int, b int, v array<double>").select("k", "node", "f", "b", F.posexplode("v").alias("i", "v")).groupBy("k", "node", "f", "b", "i").agg(F.sum("v").alias("v")).collect()  # sums of the level's nodes only
    got: dict[tuple[int, int, int, int], np.ndarray] = {}
    for r in rows:
        d = len(wanted[r.k, r.node, r.f])
        got.setdefault((r.k, r.node, r.f, r.b), np.zeros(2 * d + d * d))[r.i] = r.v
    return got


def _linear_leaves(state: DataFrame, job: Job) -> None:
    """Gives each leaf a ridge model of its path's features beside its constant."""
    p, is_cat = job.p, job.is_cat
    wanted = {(k, node, -1): use for k, t in enumerate(job.growing) for node in range(len(t.value)) if t.left[node] < 0 and (use := _path_features(t, node, is_cat))}
    if not wanted:
        return
    for (k, node, _, _), v in _linear_sums(state, job, wanted, 1).items():
        use = wanted[k, node, -1]
        d = len(use)
        weights = p.learning_rate * linear_weights(v[:d], v[d : d + d * d].reshape(d, d), p.lambda_l2)
        if weights.any():
            job.growing[k].linear[node] = (use, weights.tolist())


def delivered(v: np.ndarray, g: float, h: float, d: int, l2: float, used: int | None = None) -> float:
    """What a linear leaf of the first ``used`` regressors takes off the loss, to second order and less its ridge; its constant and its weights are solved apart."""
    used = d if used is None else used
    xg, hx, xh = v[:used], v[d : d + d * d].reshape(d, d)[:used, :used], v[d + d * d : d + d * d + used]
    c, w = -g / (h + l2 + EPSILON), linear_weights(xg, hx, l2)
    return float(-(c * g + w @ xg) - 0.5 * (c * c * h + 2 * c * (w @ xh) + w @ hx @ w) - 0.5 * l2 * (c * c + w @ w))


def linear_split(sums: np.ndarray, hist: np.ndarray, size: int, d: int, p: Params, parent: int | None = None) -> tuple[float, int, bool] | None:
    """(gain, threshold, default_left) of a feature's split for linear leaves, from sums by bin (missing last).

    The threshold is the one whose two systems gain most; the gain is what the
    two leaves then deliver over the undivided one, which has the first
    ``parent`` regressors.
    """
    whole, all_ = sums.sum(0), hist.sum(0)
    side = lambda v: linear_gain(v[:d], v[d : d + d * d].reshape(d, d), p.lambda_l2)
    best, low = None, max(p.min_data_in_leaf, 1)
    run, rows = np.cumsum(sums[:size], 0), np.cumsum(hist[:size], 0)
    for k in range(size):
        for go in (True, False) if hist[-1, 2] else (True,):
            left, n = run[k] + (sums[-1] if go else 0), rows[k] + (hist[-1] if go else 0)
            if n[2] >= low and all_[2] - n[2] >= low:
                v = side(left) + side(whole - left)
                if best is None or v > best[0] + TIE * max(abs(v), abs(best[0]), 1.0):
                    best = (v, k, go, left, n)
    if best is None:
        return None
    _, k, go, left, n = best
    gain = delivered(left, n[0], n[1], d, p.lambda_l2) + delivered(whole - left, *(all_ - n)[:2], d, p.lambda_l2) - delivered(whole, all_[0], all_[1], d, p.lambda_l2, parent)
    return gain, k, go


def _quantile_leaves(state: DataFrame, p: Params, trees: list[Tree], tree: Tree, rate: Callable[[int], float]) -> None:
    """Sets each leaf to the weighted quantile of its residuals over all rows, times the learning rate.

    Each pass sums weights in ``QUANTILE_CELLS`` cells of a leaf's interval and
    goes on inside the cell that holds the quantile, so only (leaf, cell) sums
    move, until one residual is left in it.
    """
    nodes = len(tree.value)

    def cells(low: np.ndarray, high: np.ndarray) -> DataFrame:
        step = np.where(high > low, (high - low) / QUANTILE_CELLS, 1.0)
        step[step == 0] = np.nextafter(0, 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                col = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("y", "w")}
                bins = _rows(b.column("bins"))
                leaf, res = tree.route(bins), col["y"] - (_rows(b.column("s")) + _scores(trees, bins, 1))[:, 0]
                keep = (res >= low[leaf]) & (res <= high[leaf])
                leaf, res, w = leaf[keep], res[keep], col["w"][keep]
                with np.errstate(invalid="ignore"):
                    cell = np.where(np.isinf(step[leaf]), 0, np.minimum((res - low[leaf]) / step[leaf], QUANTILE_CELLS - 1))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(np.nan_to_num(cell).astype(np.int32)), pa.array(w), pa.array(res)], names=["leaf", "cell", "w", "r"])

        rows = state.mapInArrow(run, "leaf int, cell int, w double, r double")
        return rows.groupBy("leaf", "cell").agg(F.sum("w").alias("w"), F.min("r").alias("low"), F.max("r").alias("high")).toPandas()

    low, high, below = np.full(nodes, -np.inf), np.full(nodes, np.inf), np.zeros(nodes)
    goal = None
    while True:
        found = cells(low, high)
        if goal is None:
            goal = found.groupby("leaf")["w"].sum() * p.options.get("quantile_alpha", 0.5)
        for leaf, rows in found.sort_values("cell").groupby("leaf"):
            past = below[leaf] + rows["w"].cumsum().to_numpy()
            at = min(int(np.searchsorted(past, goal[leaf] * (1 - 1e-12))), len(past) - 1)
            below[leaf] = past[at] - rows["w"].iloc[at]
            low[leaf], high[leaf] = rows["low"].iloc[at], rows["high"].iloc[at]
        if (low[goal.index] == high[goal.index]).all():
            break
    for leaf in goal.index:
        tree.value[leaf] = rate(_depth(tree, leaf)) * float(high[leaf])


def _grow(fitting: Fitting, job: Job, allowed: np.ndarray, before: float | None = None) -> dict:
    """Grows the round's trees; returns what is recorded of its gradients (of all outputs together)."""
    p, growing, sizes, is_cat, plan, r = fitting.params, job.growing, fitting.sizes, fitting.is_cat, fitting.plan, job.round
    job.is_cat = is_cat
    groups = [frozenset(g) for g in p.interactions]
    hists: dict[tuple[int, int], np.ndarray] = {}
    totals: dict[tuple[int, int], np.ndarray] = {}
    limits: dict[tuple[int, int], tuple[float, float]] = {}
    paths: dict[tuple[int, int], frozenset] = {}
    factors = fitting.factors
    nf, width, channels = len(sizes), max(sizes) + 1, SUMS + factors
    across = max(1, min(nf, TILE_BYTES // (8 * width * channels)))  # features of a job, then nodes
    down = max(1, TILE_BYTES // (8 * width * channels * across))
    squares = 0.0
    top = p.max_leaf_value or np.inf

    def collect(build: list[tuple[int, int]]) -> None:
        nonlocal squares
        for key in build:
            hists[key] = np.zeros((nf, width, channels))
        for at in range(0, len(build), down):
            for first in range(0, nf, across):
                part, past = build[at : at + down], min(first + across, nf)
                rows = fitting.state.mapInArrow(lambda it, part=part, first=first, past=past: job.histogram(it, part, width, first, past, factors), _HIST)
                rows = rows.groupBy("k", "node", "feature", "bin").agg(*(F.sum(F.col("sums")[i]).alias(f"c{i}") for i in range(channels))).toPandas()
                k, node, f, b = (rows[c].to_numpy(np.int64) for c in ("k", "node", "feature", "bin"))
                v = rows[[f"c{i}" for i in range(channels)]].to_numpy(float)
                squares = float(v[node < 0, 0].sum())
                for key in part:
                    m = (k == key[0]) & (node == key[1])
                    hists[key][f[m], b[m]] = v[m]

    def value(key: tuple[int, int]) -> float:
        t = totals[key]
        lo, hi = limits.get(key, (-top, top))
        return float(np.clip(-_gain_term(t[0], t[1], p, t[2], t[3])[0] / (t[1] + p.lambda_l2 + EPSILON), lo, hi))

    def usable(key: tuple[int, int]) -> np.ndarray:
        if not groups:
            return allowed
        path = paths.get(key, frozenset())
        live = [g for g in groups if path <= g]
        free = set(range(nf)) - set().union(*groups)
        return np.array([f for f in allowed if f in free or any(f in g for g in live)], int)

    def candidates(keys: list[tuple[int, int]], depth: int) -> dict[tuple[int, int], tuple | None]:
        """The best split of each node; with linear leaves the best of a shortlist by what such leaves gain."""
        if depth >= p.max_depth:
            return dict.fromkeys(keys)
        reshape = lambda k: (lambda gain, *sums: plan.gain(r, k, gain, *sums, p.lambda_l2)) if plan else None
        ranked = {key: ranked_splits(hists[key], p, usable(key), sizes, is_cat, reshape(key[0])) for key in keys}
        if p.leaf_model != "linear" or not p.pl_split_candidates:
            return {key: found[0] if found else None for key, found in ranked.items()}
        short = {key: found[: p.pl_split_candidates] for key, found in ranked.items()}
        wanted = {}
        for (k, node), found in short.items():
            for c in found:
                if not is_cat[c[1]]:
                    use = list(dict.fromkeys([*_path_features(growing[k], node, is_cat), c[1]]))[:MOST_REGRESSORS]
                    wanted[k, node, c[1]] = use
        sums = _linear_sums(fitting.state, job, wanted, width) if wanted else {}
        out: dict[tuple[int, int], tuple | None] = {}
        for key, found in short.items():
            best = found[0] if found else None
            gains = []
            for c in found:
                use = wanted.get((*key, c[1]))
                if use is None:
                    continue
                each = np.stack([sums.get((*key, c[1], b), np.zeros(2 * len(use) + len(use) ** 2)) for b in range(width)])
                got = linear_split(each, hists[key][c[1]], sizes[c[1]], len(use), p, len(_path_features(growing[key[0]], key[1], is_cat)))
                if got:
                    gains.append((got[0], c[1], got[1], got[2], None))
            if gains:
                best = max(gains, key=lambda g: (g[0], -g[1]))
                best = best if best[0] > max(p.min_split_gain, 0.0) else None
            out[key] = best
        return out

    def rate(depth: int) -> float:
        return plan.leaf_rate(r, depth) if plan else p.learning_rate

    for t in growing:
        t.add(0.0, 0.0)
    roots = [(k, 0) for k in range(job.outputs)]
    collect(roots)
    totals |= {key: hists[key][0].sum(0) for key in roots}
    record = _record([totals[key] for key in roots], squares, before, len(allowed))
    for k, t in enumerate(growing):
        t.cover[0], t.value[0] = float(totals[k, 0][2]), rate(0) * value((k, 0))
        if plan:
            plan.observe(k, *totals[k, 0][[0, 2, 3]])
    frontier = {key: (0, c) for key, c in candidates(roots, 0).items()}
    leaves = [1] * job.outputs
    while True:
        ready = [(key, d, c) for key, (d, c) in frontier.items() if c]
        if not ready:
            break
        if p.tree_growth == "leaf":  # best first, one split of each tree a job
            pick = {}
            for key, d, c in ready:
                if leaves[key[0]] < (p.max_leaves or 1 << 30) and (key[0] not in pick or c[0] > pick[key[0]][2][0]):
                    pick[key[0]] = (key, d, c)
            ready = list(pick.values())
            if not ready:
                break
        elif p.max_leaves:
            room = {k: p.max_leaves - n for k, n in enumerate(leaves)}
            kept = []
            for key, d, c in ready:
                if room[key[0]] > 0:
                    room[key[0]] -= 1
                    kept.append((key, d, c))
            ready = kept
            if not ready:
                break
        build, rest = [], []
        for key, d, (gain, f, thr, go, cats) in ready:
            k, node = key
            t = growing[k]
            h = hists[key]
            x = h[f, : sizes[f]]
            left = (x[cats] if cats is not None else x[: thr + 1]).sum(0) + (h[f, -1] if go else 0)
            right = h[f].sum(0) - left
            a, b = t.add(0.0, float(left[2])), t.add(0.0, float(right[2]))
            t.feature[node], t.threshold[node], t.default_left[node], t.cats[node], t.left[node], t.right[node], t.gain[node] = f, thr, go, cats, a, b, gain
            leaves[k] += 1
            small, large = (a, b) if left[2] <= right[2] else (b, a)
            if d + 1 < p.max_depth:  # what splits no more needs its sums only
                build.append((k, small))
            rest.append((key, d, (k, small), (k, large)))
            for c, sums in ((a, left), (b, right)):
                totals[k, c] = sums
                paths[k, c] = paths.get(key, frozenset()) | {f}
                limits[k, c] = limits.get(key, (-top, top))
            del frontier[key]
        if build:
            collect(build)
        fresh: dict[int, list[tuple[int, int]]] = {}
        for key, d, small, large in rest:
            whole = hists.pop(key)
            if small in hists:
                hists[large] = whole - hists[small]
                hists[large][np.abs(hists[large][:, :, 2]) < 0.5] = 0.0
            k, node = key
            t = growing[k]
            left, right = (k, t.left[node]), (k, t.right[node])
            sign = p.monotone.get(t.feature[node], 0)
            if sign:
                limits[left], limits[right] = monotone.child_bounds(limits[left], sign, value(left), value(right))
            for c in (left, right):
                t.value[c[1]] = rate(d + 1) * value(c)
                fresh.setdefault(d + 1, []).append(c)
        for d, keys in fresh.items():
            frontier |= {c: (d, found) for c, found in candidates(keys, d).items()}
        if p.max_leaves and all(n >= p.max_leaves for n in leaves):
            break
    return record


def _record(roots: list[np.ndarray], squares: float, before: float | None, features: int) -> dict:
    """Means over the outputs of a round's gradient norms and variance; the norm of the hessians; what a projection took away."""
    norm = [float(np.sqrt(t[3])) for t in roots]
    spread = [max(float(t[3] / t[2] - (t[0] / t[2]) ** 2), 0.0) if t[2] > 1 else 0.0 for t in roots]
    out = {"gradient_norm": float(np.mean(norm)), "gradient_variance": float(np.mean(spread)), "hessian_norm": float(np.sqrt(squares / len(roots))), "rows": float(roots[0][2]), "features": features}
    if before is not None:
        after = float(np.sqrt(sum(x * x for x in norm)))
        out |= {"gradient_norm_before": before, "neutralized": min(max(1 - after / before, 0.0), 1.0) if before > 0 else 0.0}
    return out


def _depth(t: Tree, node: int) -> int:
    up = {c: i for i in range(len(t.left)) for c in (t.left[i], t.right[i]) if c >= 0}
    d = 0
    while node:
        node, d = up[node], d + 1
    return d


def params_dict(p: Params) -> dict:
    return {k: v for k, v in asdict(p).items() if k != "options"} | {"options": {k: v for k, v in p.options.items() if not callable(v)}}
