"""Monotone constraints on whole trees: bounds of children, projection of finished trees, and a check of given ones."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from arborlake.plans.boosting import Tree

Bounds = tuple[float, float]


def child_bounds(bounds: Bounds, sign: int, left: float, right: float) -> tuple[Bounds, Bounds]:
    """Bounds of both children: a constrained split parts its own at the middle of the children's bounded values."""
    low, high = bounds
    if not sign:
        return bounds, bounds
    middle = float(np.clip((np.clip(left, low, high) + np.clip(right, low, high)) / 2, low, high))
    below, above = (low, middle), (middle, high)
    return (below, above) if sign > 0 else (above, below)


def project(tree: Tree, signs: dict[int, int], most: float | None = None) -> Tree:
    """The tree with every value moved into the bounds that its ancestors' constraints leave."""
    if tree.linear:
        raise ValueError("linear leaves cannot be constrained")
    value = list(tree.value)
    top = np.inf if most is None else most
    todo: list[tuple[int, Bounds]] = [(0, (-top, top))]
    while todo:
        node, bounds = todo.pop()
        value[node] = float(np.clip(value[node], *bounds))
        left, right = tree.left[node], tree.right[node]
        if left >= 0:
            own = child_bounds(bounds, signs.get(tree.feature[node], 0), tree.value[left], tree.value[right])
            todo += [(left, own[0]), (right, own[1])]
    return replace(tree, value=value)


def project_forest(trees: list[Tree], signs: dict[int, int], most: float | None = None) -> list[Tree]:
    return [project(t, signs, most) for t in trees] if any(signs.values()) else list(trees)


def validate(trees: list[Tree], signs: dict[int, int], most: float | None = None) -> None:
    """Raises if a projection would change a leaf."""
    for i, (t, bounded) in enumerate(zip(trees, project_forest(trees, signs, most))):
        for node, (a, b) in enumerate(zip(t.value, bounded.value)):
            if t.left[node] < 0 and abs(a - b) > 1e-9 * max(1.0, abs(a)):
                raise ValueError(f"tree {i}, node {node} violates the monotone constraints")
