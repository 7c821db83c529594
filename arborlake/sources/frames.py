"""Input tables: reading, role checks, and writing between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: A side of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


#: Rows that are fetched and broadcast from the driver, so that they are computed once.
FETCHED_ROWS = 10_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a side for broadcast when a count shows that it is small; very few rows are fetched and stand as they are."""
    few = df.limit(FETCHED_ROWS + 1).collect()
    if len(few) <= FETCHED_ROWS:
        return F.broadcast(df.sparkSession.createDataFrame(few, df.schema))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A table in any format that Spark reads."""
    return spark.read.format(fmt).options(**options).load(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header line, read by a given schema; values that do not fit are an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def check_time(df: DataFrame, time: str) -> DataFrame:
    """The table with a whole-numbered time in every row."""
    t = F.col(time)
    kind = dict(df.dtypes)[time]
    odd = t.isNull() | (t != F.floor(t)) if kind in ("double", "float") else t.isNull()
    if kind not in ("tinyint", "smallint", "int", "bigint", "double", "float") or df.filter(odd).limit(1).count():
        raise ValueError(f"{time} must hold a whole number in every row")
    return df.withColumn(time, t.cast("long"))


def check_group(df: DataFrame, group: str) -> None:
    if group not in df.columns or df.filter(F.col(group).isNull()).limit(1).count():
        raise ValueError(f"{group} must name a group in every row")


def groups_from_sizes(df: DataFrame, position: str, sizes: DataFrame, out: str = "group") -> DataFrame:
    """Adds a group number to rows that are numbered from 0, from sizes (group, size) of consecutive groups."""
    ends = F.sum("size").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, 0))  # a row a group
    ranges = sizes.withColumn("_end", ends).select(F.col("group").alias(out), (F.col("_end") - F.col("size")).alias("_start"), "size")
    rows, whole = df.count(), sizes.agg(F.sum("size")).first()[0] or 0
    if rows != whole:
        raise ValueError(f"group sizes add up to {whole}, the table has {rows} rows")
    each = ranges.filter("size > 0").withColumn("_at", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("size") - 1)))
    return df.join(each.select(F.col("_at").alias(position), out), position)


def categorical_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in ("string", "boolean")]


def check_roles(df: DataFrame, label: str, weight: str | None = None) -> None:
    """Targets must be there and finite; weights finite, not negative, not all zero. One aggregate."""
    y = F.col(label).cast("double")
    bad = [F.count_if(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))).alias("y"), F.count("*").alias("n")]
    if weight:
        w = F.col(weight).cast("double")
        bad += [F.count_if(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))).alias("w"), F.sum(w).alias("total")]
    r = df.agg(*bad).first()
    if not r.n:
        raise ValueError("no rows")
    if r.y:
        raise ValueError(f"{r.y} targets are missing or not finite")
    if weight and (r.w or not r.total):
        raise ValueError("weights must be finite, not negative and not all zero")


def repeat_by_weight(df: DataFrame, weight: str) -> DataFrame:
    """Integer weights as frequencies: each row that many times, rows of weight 0 left out."""
    return df.filter(F.col(weight) > 0).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(weight).cast("long")))).drop("_i", weight)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes a frame to the folder that all executors share (``spark.checkpoint.dir``) and reads it back.

    Without that setting a local session gets a folder of its own; on a
    cluster there is none that all machines see, so that is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or f"{tempfile.gettempdir()}/arborlake-checkpoints/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)
