"""Gradients, hessians and losses of the training objectives as column expressions.

``p`` is the raw score, ``y`` the target, ``w`` the row weight.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floor of hessians and clamp of log-scale scores. (Fixed values.)
HESSIAN_FLOOR, SCORE_CLAMP, POISSON_STEP = 1e-7, 50.0, 0.7


def sigmoid(p: Column) -> Column:
    return F.lit(1.0) / (1.0 + F.exp(-p))


def mean_of(p: Column) -> Column:
    """Mean of a log-link model: exp of the clamped score."""
    return F.exp(F.greatest(F.least(p, F.lit(SCORE_CLAMP)), F.lit(-SCORE_CLAMP)))


def squared(p: Column, y: Column, w: Column) -> tuple[Column, Column]:
    return (p - y) * w, w


def binary(p: Column, y: Column, w: Column) -> tuple[Column, Column]:
    q = sigmoid(p)
    return (q - y) * w, q * (1 - q) * w


def poisson(p: Column, y: Column, w: Column) -> tuple[Column, Column]:
    mu = mean_of(p)
    return (mu - y) * w, F.greatest(mu, F.lit(HESSIAN_FLOOR)) * F.exp(F.lit(POISSON_STEP)) * w


def gamma(p: Column, y: Column, w: Column) -> tuple[Column, Column]:
    r = y / mean_of(p)
    return (1 - r) * w, F.greatest(r, F.lit(HESSIAN_FLOOR)) * w


def tweedie(p: Column, y: Column, w: Column, power: float = 1.5) -> tuple[Column, Column]:
    mu = mean_of(p)
    a = F.pow(mu, F.lit(2 - power))
    return (a - y * F.pow(mu, F.lit(1 - power))) * w, F.greatest(a, F.lit(HESSIAN_FLOOR)) * w


def quantile(p: Column, y: Column, w: Column, alpha: float = 0.5) -> tuple[Column, Column]:
    return F.when(y > p, F.lit(-alpha)).otherwise(F.lit(1 - alpha)) * w, w


def softmax(scores: Column) -> Column:
    """Probabilities of an array of class scores."""
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def loss_squared(p: Column, y: Column, w: Column) -> Column:
    return F.sum(w * (p - y) * (p - y)) / F.count(F.lit(1))


def loss_binary(p: Column, y: Column, w: Column) -> Column:
    return F.sum(w * (F.greatest(p, F.lit(0.0)) - p * y + F.log1p(F.exp(-F.abs(p))))) / F.count(F.lit(1))


def loss_poisson(p: Column, y: Column, w: Column) -> Column:
    return F.sum(w * (mean_of(p) - y * p)) / F.sum(w)


def loss_gamma(p: Column, y: Column, w: Column) -> Column:
    r = y / mean_of(p)
    return F.sum(w * (r - F.ln(r) - 1)) / F.sum(w)


def loss_quantile(p: Column, y: Column, w: Column, alpha: float = 0.5) -> Column:
    d = y - p
    return F.sum(w * F.greatest(d * alpha, d * (alpha - 1))) / F.count(F.lit(1))


def loss_tweedie(p: Column, y: Column, w: Column, power: float = 1.5) -> Column:
    mu = mean_of(p)
    one, two = 1 - power, 2 - power
    top = F.when(y > 0, F.pow(y, F.lit(two)) / (one * two)).otherwise(0.0)
    return F.sum(2 * w * (top - y * F.pow(mu, F.lit(one)) / one + F.pow(mu, F.lit(two)) / two)) / F.sum(w)


def loss_softmax(scores: Column, y: Column, w: Column) -> Column:
    """Weighted mean of -log of the class's probability; ``scores`` is an array by class."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return F.sum(w * (F.ln(total) - (F.element_at(scores, y.cast("int") + 1) - top))) / F.sum(w)


def softmax_gradients(scores: Column, y: Column, w: Column) -> tuple[Column, Column]:
    """Arrays by class of gradients and hessians."""
    q = softmax(scores)
    g = F.transform(q, lambda v, k: (v - (k == y.cast("int")).cast("double")) * w)
    return g, F.transform(q, lambda v: F.greatest(v * (1 - v), F.lit(HESSIAN_FLOOR)) * w)
