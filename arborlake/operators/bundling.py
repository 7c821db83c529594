"""Exact feature bundles: sparse binned columns that are never non-zero together share one stored column.

A column may join when it has no missing bin and is non-zero in at most a
quarter of the rows. Conflicts of all pairs come from one pass. Bundles are
kept only if they are runs of neighbouring columns, as one-hot groups are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest stored bin. (Fixed value.)
MOST_BINS = 65_534


@dataclass(frozen=True)
class Bundles:
    """Columns of each bundle, and for each bundled column its first stored bin and its largest own bin."""

    groups: list[list[str]]
    offset: dict[str, int]
    span: dict[str, int]


def overlaps(df: DataFrame, columns: list[str]) -> np.ndarray:
    """For each pair of columns the rows in which both are non-zero; a column's own count on the diagonal."""
    n = len(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for b in batches:
            x = np.stack([np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(float)) != 0 for c in b.columns], 1).astype(float)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "n"])

    out = np.zeros((n, n), np.int64)
    for r in df.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(count, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # a row a pair
        out[r.i, r.j] = int(r.n)
    return out


def discover(df: DataFrame, columns: list[str]) -> Bundles:
    """Bundles of binned columns (null: missing)."""
    shape = df.agg(F.count(F.lit(1)).alias("n"), *(F.max(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.count(c).alias(f"c{i}") for i, c in enumerate(columns))).first()
    both = overlaps(df, columns)
    use = [i for i in range(len(columns)) if shape[f"c{i}"] == shape.n and 0 < both[i, i] <= shape.n // 4]

    def grouped(order: list[int], accepts) -> list[list[int]]:
        groups: list[list[int]] = []
        for i in order:
            home = next((g for g in groups if accepts(g, i)), None)
            if home is None:
                groups.append([i])
            else:
                home.append(i)
        return groups

    def clear(g: list[int], i: int) -> bool:
        return not both[g, i].any()

    by_use = grouped(sorted(use, key=lambda i: (-both[i, i], i)), lambda g, i: clear(g, i) and sum(shape[f"m{j}"] for j in [*g, i]) <= MOST_BINS)
    runs: list[list[int]] = []
    for i in use:
        if runs and runs[-1][-1] == i - 1 and clear(runs[-1], i):
            runs[-1].append(i)
        else:
            runs.append([i])
    several = lambda groups: sorted(sorted(g) for g in groups if len(g) > 1)
    if several(by_use) != several(runs):
        return Bundles([], {}, {})
    groups = [g for g in by_use if len(g) > 1]
    offset, span = {}, {}
    for g in groups:
        at = 1
        for i in g:
            offset[columns[i]], span[columns[i]] = at, int(shape[f"m{i}"])
            at += span[columns[i]]
    return Bundles([[columns[i] for i in g] for g in groups], offset, span)


def stored(b: Bundles, group: list[str]) -> Column:
    """The stored bin of a bundle: at most one of its columns is not 0."""
    return F.coalesce(*(F.when(F.col(c) != 0, F.col(c) + b.offset[c] - 1) for c in group), F.lit(0)).cast("int")


def decoded(b: Bundles, column: str, bin_: Column) -> Column:
    """A column's own bin from the stored one."""
    own = bin_ - b.offset[column] + 1
    return F.when((own >= 1) & (own <= b.span[column]), own).otherwise(0).cast("int")


def histogram(df: DataFrame, b: Bundles, g: Column, h: Column) -> DataFrame:
    """feature, bin, sg, sh, n of every bundled column, from one histogram of each stored column; bin 0 is what other bins leave."""
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), stored(b, group).alias("s")) for i, group in enumerate(b.groups)))
    rows = df.select(g.alias("g"), h.alias("h"), F.explode(pairs).alias("p")).groupBy("p.i", "p.s").agg(F.sum("g").alias("sg"), F.sum("h").alias("sh"), F.count("*").alias("n"))
    members = F.array(*(F.struct(F.lit(i).alias("j"), F.lit(c).alias("feature"), F.lit(b.offset[c]).alias("o"), F.lit(b.span[c]).alias("w")) for i, group in enumerate(b.groups) for c in group))
    own = F.col("s") - F.col("m.o") + 1
    each = rows.withColumn("m", F.explode(members)).filter("m.j = i")
    each = each.select(F.col("m.feature").alias("feature"), F.when((own >= 1) & (own <= F.col("m.w")), own).otherwise(0).cast("int").alias("bin"), "sg", "sh", "n")
    return each.groupBy("feature", "bin").agg(F.sum("sg").alias("sg"), F.sum("sh").alias("sh"), F.sum("n").alias("n"))
