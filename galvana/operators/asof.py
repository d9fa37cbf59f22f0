"""Joins on order: interpolating samples at offsets, nearest and bracketing rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_at(samples: DataFrame, x: str, values: Sequence[str], offsets: Sequence[float], keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """One row for each group and offset: ``offset`` and each value, linear between its neighbours in x.

    Before the first x the first value holds; past the last x it is null. One
    pass: each offset's neighbours are two conditional aggregates.
    """
    out = []
    for k, off in enumerate(offsets):
        low = F.col(x) <= off + tolerance
        high = F.col(x) >= off - tolerance
        out += [F.max(F.when(low, F.col(x))).alias(f"_x0_{k}"), F.min(F.when(high, F.col(x))).alias(f"_x1_{k}")]
        for v in values:
            # Of rows at one x the least value counts, whatever their order.
            out += [
                F.max(F.when(low & F.col(v).isNotNull(), F.struct(F.col(x), (-F.col(v)).alias("v")))).alias(f"_{v}0_{k}"),
                F.min(F.when(high & F.col(v).isNotNull(), F.struct(F.col(x), F.col(v).alias("v")))).alias(f"_{v}1_{k}"),
            ]
    wide = samples.where(F.col(x).isNotNull()).groupBy(*keys).agg(*out)

    def value(v: str, k: int, off: float):
        a, b = F.col(f"_{v}0_{k}"), F.col(f"_{v}1_{k}")
        x0, x1, y0, y1 = a[x], b[x], -a["v"], b["v"]
        inside = F.when(x1 <= x0, y0).otherwise(y0 + (y1 - y0) * (F.lit(off) - x0) / F.nullif(x1 - x0, F.lit(0.0)))
        return F.when(b.isNull(), F.lit(None)).when(a.isNull(), y1).otherwise(inside)

    rows = F.array(*(F.struct(F.lit(float(off)).alias("offset"), *(value(v, k, off).alias(v) for v in values)) for k, off in enumerate(offsets)))
    return wide.select(*keys, F.inline(rows))


def bracket(rows: DataFrame, anchors: DataFrame, keys: Sequence[str], x: str = "cycle", values: Sequence[str] = ()) -> DataFrame:
    """Each row with the last anchor at or before its x and the first at or after it.

    Rows and anchors share one sorted pass, so no pair of both is formed. Anchor
    columns come back as ``before_*`` and ``after_*``.
    """
    fields = [x, *values]
    mark = F.struct(*fields)
    both = rows.withColumns({"_side": F.lit(1), "_anchor": F.lit(None)}).unionByName(
        anchors.select(*keys, *fields).withColumns({"_side": F.lit(0), "_anchor": mark}).select(*keys, x, "_side", "_anchor"), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys)
    down = w.orderBy(F.col(x), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    up = w.orderBy(F.col(x), F.col("_side").desc()).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumns({"_before": F.last("_anchor", True).over(down), "_after": F.first("_anchor", True).over(up)}).where("_side = 1")
    return found.select(*rows.columns, *(F.col(f"_before.{c}").alias(f"before_{c}") for c in fields), *(F.col(f"_after.{c}").alias(f"after_{c}") for c in fields))


def nearest(rows: DataFrame, anchors: DataFrame, keys: Sequence[str], x: str = "cycle", values: Sequence[str] = ()) -> DataFrame:
    """Each row with the anchor of smallest distance in x, of two the smaller, as ``nearest_*``."""
    found = bracket(rows, anchors, keys, x, values)
    take = F.col(f"after_{x}").isNull() | (F.col(x) - F.col(f"before_{x}") <= F.col(f"after_{x}") - F.col(x))
    first = F.coalesce(take & F.col(f"before_{x}").isNotNull(), F.lit(False))
    return found.select(*rows.columns, *(F.when(first, F.col(f"before_{c}")).otherwise(F.col(f"after_{c}")).alias(f"nearest_{c}") for c in (x, *values)))


def interpolate(rows: DataFrame, anchors: DataFrame, keys: Sequence[str], value: str, x: str = "cycle") -> DataFrame:
    """Each row with ``expected``: the value between its bracketing anchors, held at the ends."""
    found = bracket(rows, anchors, keys, x, [value])
    x0, x1, y0, y1 = (F.col(f"{side}_{c}") for c in (x, value) for side in ("before", "after"))
    inside = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (F.col(x) - x0) / F.nullif(x1 - x0, F.lit(0)))
    return found.select(*rows.columns, F.coalesce(inside, y0, y1).alias("expected"))
