"""Ranking objectives over a table: the code of training, group by group, as DataFrames.

A group's rows are dealt to one task and held together, as its pairs need
each other; pairs are worked on in blocks and never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions import losses


def whole_groups(batches: Iterator[pa.RecordBatch], name: str = "grp") -> Iterator[pa.Table]:
    """Batches cut at group ends; rows are sorted by the group. A group's batches are joined once, when it ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(name).to_numpy(zero_copy_only=False)
        if held and held[-1].column(name)[-1].as_py() != g[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _edges(t: pa.Table) -> list[tuple[int, int]]:
    g = t.column("grp").to_numpy()
    edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
    return list(zip(edge, edge[1:]))


def _by_group(df: DataFrame, group: str, tie: str, score: str, label: str, weight: str | None, one: Callable[[pa.Table], pa.RecordBatch], ddl: str) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(group).cast("long").alias("grp"), F.col(tie).alias("tie"), F.col(score).cast("double").alias("p"), F.col(label).cast("double").alias("y"), w.alias("w"))
    rows = rows.repartition("grp").sortWithinPartitions("grp", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            yield one(t)

    return rows.mapInArrow(run, ddl)


def gradients(df: DataFrame, objective: str, group: str, tie: str, score: str, label: str, **options) -> DataFrame:
    """tie, g, h: gradients and hessians of a ranking objective; rows of equal score are in order of ``tie``."""

    def one(t: pa.Table) -> pa.RecordBatch:
        p, y, grp = (t.column(c).to_numpy() for c in ("p", "y", "grp"))
        g, h = np.zeros(len(p)), np.zeros(len(p))
        for a, b in _edges(t):
            g[a:b], h[a:b] = losses.group_gradients(objective, p[a:b], y[a:b], options, int(grp[a]))
        return pa.RecordBatch.from_arrays([t.column("tie").combine_chunks(), pa.array(g), pa.array(h)], names=["tie", "g", "h"])

    kind = dict(df.dtypes)[tie]
    return _by_group(df, group, tie, score, label, None, one, f"tie {kind}, g double, h double")


def loss(df: DataFrame, objective: str, group: str, tie: str, score: str, label: str, weight: str | None = None, **options) -> DataFrame:
    """One row with the loss of a ranking objective (0 without groups or pairs)."""

    def one(t: pa.Table) -> pa.RecordBatch:
        p, y, w = (t.column(c).to_numpy() for c in ("p", "y", "w"))
        parts = [losses.group_loss(objective, p[a:b], y[a:b], w[a:b], options) for a, b in _edges(t)]
        return pa.RecordBatch.from_arrays([pa.array([sum(x) for x in ([q[i] for q in parts] for i in (0, 1))][i : i + 1]) for i in (0, 1)], names=["s", "n"])

    parts = _by_group(df, group, tie, score, label, weight, one, "s double, n double")
    return parts.agg(F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("loss"))
