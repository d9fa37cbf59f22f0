"""Ranks and quantiles of groups of any size, by ranges of values instead of one task a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galvana.shared import cut


def ordered_counts(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``keys, value, rows_of, before``: each distinct value with its rows and the rows of smaller values in its group.

    Distinct values are dealt by range; within a part they are summed in order,
    and parts hand on their totals, so a group of all rows needs no task of its own.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("rows_of"))
    # Written, so that a part's number stays its own.
    parts = cut(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ordered")
    totals = parts.groupBy(*keys, "_part").agg(F.sum("rows_of").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = totals.select(*keys, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_inside", F.coalesce(F.sum("rows_of").over(inside), F.lit(0))).join(offsets, [*keys, "_part"])
    return placed.select(*keys, value, "rows_of", (F.col("_offset") + F.col("_inside")).alias("before"))


def average_ranks(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``keys, value, rank``: ranks from 1, ties averaged."""
    return ordered_counts(rows, keys, value).select(*keys, value, (F.col("before") + (F.col("rows_of") + 1) / 2).alias("rank"))


def quantiles(rows: DataFrame, keys: Sequence[str], value: str = "value", p: float = 0.5, name: str = "quantile") -> DataFrame:
    """``keys`` and the exact quantile with linear interpolation."""
    ordered = ordered_counts(rows, keys, value)
    sizes = ordered.groupBy(*keys).agg(F.max(F.col("before") + F.col("rows_of")).alias("_n"))
    at = F.lit(p) * (F.col("_n") - 1)
    lo, hi = F.floor(at), F.ceil(at)
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("rows_of"))
    near = ordered.join(sizes, list(keys)).where(holds(lo) | holds(hi))
    ends = near.groupBy(*keys, "_n").agg(F.max(F.when(holds(lo), F.col(value))).alias("_lo"), F.max(F.when(holds(hi), F.col(value))).alias("_hi"))
    return ends.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - lo)).alias(name))
