"""Objectives on NumPy batches, as the workers use them: start value, gradients and hessians, link."""

from __future__ import annotations

import numpy as np

from arborlake.operators import sampling

FLOOR, CLAMP = 1e-7, 50.0


def _mu(p: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(p, -CLAMP, CLAMP))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def row_gradients(name: str, s: np.ndarray, y: np.ndarray, w: np.ndarray, opt: dict) -> tuple[np.ndarray, np.ndarray]:
    """(rows, outputs) gradients and hessians of row-wise objectives; ``s`` are raw scores."""
    if callable(opt.get("custom")):
        g, h = opt["custom"](y, s[:, 0])
        return (np.asarray(g) * w)[:, None], (np.asarray(h) * w)[:, None]
    if name == "softmax":
        q = softmax(s)
        return (q - (y[:, None] == np.arange(s.shape[1]))) * w[:, None], np.maximum(q * (1 - q), FLOOR) * w[:, None]
    p = s[:, 0]
    if name in ("squared_error", "rank:rmse"):
        g, h = p - y, np.ones_like(p)
    elif name == "binary":
        q = 1 / (1 + np.exp(-np.clip(p, -CLAMP, CLAMP)))
        g, h = q - y, q * (1 - q)
    elif name == "poisson":
        mu = _mu(p)
        g, h = mu - y, np.maximum(mu, FLOOR) * np.exp(opt.get("poisson_max_delta_step", 0.7))
    elif name == "gamma":
        r = y / _mu(p)
        g, h = 1 - r, np.maximum(r, FLOOR)
    elif name == "tweedie":
        mu, v = _mu(p), opt.get("tweedie_power", 1.5)
        a = mu ** (2 - v)
        g, h = a - y * mu ** (1 - v), np.maximum(a, FLOOR)
    elif name == "quantile":
        alpha = opt.get("quantile_alpha", 0.5)
        g, h = np.where(y > p, -alpha, 1 - alpha), np.ones_like(p)
    else:
        raise ValueError(f"unknown objective {name}")
    return (g * w)[:, None], (h * w)[:, None]


def row_loss(name: str, s: np.ndarray, y: np.ndarray, w: np.ndarray, opt: dict) -> tuple[float, float]:
    """(sum, divisor) of a row-wise objective's loss over some rows; ``s`` are raw scores."""
    if callable(opt.get("custom_loss")):
        return float(opt["custom_loss"](y, s[:, 0])) * len(y), float(len(y))
    p = s[:, 0]
    if callable(opt.get("custom")) or name == "squared_error":
        return float(((w if not opt.get("custom") else 1.0) * (p - y) ** 2).sum()), float(len(y))
    if name == "softmax":
        return float(-(w * np.log(np.maximum(softmax(s)[np.arange(len(y)), y.astype(int)], 1e-300))).sum()), float(w.sum())
    if name == "binary":
        return float((w * (np.maximum(p, 0) - p * y + np.log1p(np.exp(-np.abs(p))))).sum()), float(len(y))
    if name == "quantile":
        a = opt.get("quantile_alpha", 0.5)
        return float((w * np.maximum(a * (y - p), (a - 1) * (y - p))).sum()), float(len(y))
    mu = _mu(p)
    if name == "poisson":
        return float((w * (mu - y * p)).sum()), float(w.sum())
    if name == "gamma":
        return float((w * (y / mu - np.log(y / mu) - 1)).sum()), float(w.sum())
    if name == "tweedie":
        v = opt.get("tweedie_power", 1.5)
        top = np.where(y > 0, np.maximum(y, 1e-300) ** (2 - v) / ((1 - v) * (2 - v)), 0.0)
        return float((2 * w * (top - y * mu ** (1 - v) / (1 - v) + mu ** (2 - v) / (2 - v))).sum()), float(w.sum())
    raise ValueError(f"unknown objective {name}")


def _ranks(s: np.ndarray) -> np.ndarray:
    order = np.argsort(-s, kind="stable")
    r = np.empty(len(s), np.int64)
    r[order] = np.arange(len(s))
    return r


#: Rows of a group whose pairs are worked on at once.
PAIR_ROWS = 256


def _noise(n: int, seed: int, group: int, turn: int) -> np.ndarray:
    """Numbers in [-1/2, 1/2] of one permutation of a group."""
    start = (seed + group * 1_000_003 + turn * 7) % 2**64
    state = np.array([(start + k * 0x9E3779B97F4A7C15) % 2**64 for k in range(n)], np.uint64)
    return sampling.mixed(state) / float(2**64) - 0.5


def _ndcg_parts(y: np.ndarray, opt: dict) -> tuple[np.ndarray, float]:
    """Gains of labels and the ideal DCG."""
    gain = 2.0**y - 1
    return gain, float((np.sort(gain)[::-1] / np.log2(np.arange(len(y)) + 2.0)).sum())


def group_gradients(name: str, p: np.ndarray, y: np.ndarray, opt: dict, group: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of one query group; pairs are taken in blocks of rows."""
    n, g, h = len(p), np.zeros(len(p)), np.zeros(len(p))
    if name == "rank:xendcg":
        if n < 2:
            return g, np.full(n, FLOOR)
        a, b = softmax(p[None])[0], softmax(y[None])[0]
        return a - b, np.maximum(a * (1 - a), FLOOR)
    sigma, top, norm = opt.get("ranking_sigma", 1.0), opt.get("ranking_truncation"), opt.get("ranking_normalize")
    gain = discounts = rank = None
    if name != "rank:pairwise":
        gain, ideal = _ndcg_parts(y, opt)
        if ideal <= 0 or n < 2:
            return g, np.maximum(h, FLOOR)
        gain = gain / ideal
        if name == "rank:yeti":  # noise changes the order only
            turns = opt.get("permutations", 10)
            discounts = [1 / np.log2(_ranks(p + _noise(n, opt.get("seed", 0), group, t)) + 2.0) for t in range(turns)]
            top = norm = None
        else:
            rank = _ranks(p)
            discounts = [1 / np.log2(rank + 2.0)]
    spread = bool(norm) and name == "rank:ndcg" and p.max() != p.min()
    total = 0.0
    for a in range(0, n, PAIR_ROWS):
        i = slice(a, a + PAIR_ROWS)
        d = p[i, None] - p
        rho = 1 / (1 + np.exp(np.clip(sigma * d, -CLAMP, CLAMP)))
        weight = (y[i, None] > y).astype(float)
        if discounts:
            weight *= np.abs(gain[i, None] - gain) * np.mean([np.abs(x[i, None] - x) for x in discounts], axis=0)
        if top and rank is not None:
            weight[(rank[i, None] >= top) & (rank >= top)] = 0.0
        if spread:
            weight /= 0.01 + np.abs(d)
        lam, hes = sigma * rho * weight, sigma * sigma * rho * (1 - rho) * weight
        g[i] -= lam.sum(1)
        g += lam.sum(0)
        h[i] += hes.sum(1)
        h += hes.sum(0)
        total += 2 * lam.sum()
    if norm and name == "rank:ndcg" and total > 0:
        g, h = g * (np.log2(1 + total) / total), h * (np.log2(1 + total) / total)
    return g, np.maximum(h, FLOOR)


def group_loss(name: str, p: np.ndarray, y: np.ndarray, w: np.ndarray, opt: dict) -> tuple[float, float]:
    """(sum, count) of one query group: the loss of a table is the sum over its groups by their count."""
    if name == "rank:rmse":
        return float(np.sqrt((w * (p - y) ** 2).sum() / len(p))), 1.0
    if name == "rank:pairwise":
        total = count = 0.0
        for a in range(0, len(p), PAIR_ROWS):
            i = slice(a, a + PAIR_ROWS)
            pair = y[i, None] > y
            total += float(np.logaddexp(0, -opt.get("ranking_sigma", 1.0) * (p[i, None] - p))[pair].sum())
            count += float(pair.sum())
        return total, count
    if name == "rank:xendcg":
        if len(p) < 2:
            return 0.0, 1.0
        top = p.max()
        return float(-(softmax(y[None])[0] * (p - top - np.log(np.exp(p - top).sum()))).sum()), 1.0
    gain, ideal = _ndcg_parts(y, opt)
    got = float((gain / np.log2(_ranks(p) + 2.0)).sum())
    return 1 - (got / ideal if ideal > 0 else 1.0), 1.0


def link(name: str, s: np.ndarray) -> np.ndarray:
    if name == "softmax":
        return softmax(s)
    if name == "binary":
        return 1 / (1 + np.exp(-np.clip(s, -CLAMP, CLAMP)))
    return _mu(s) if name in ("poisson", "gamma", "tweedie") else s
