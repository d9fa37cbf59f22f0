"""Trajectories over cycles: deltas from a baseline, health, slopes, local means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions.expr import col, ratio

CELL = ("cell_id",)


def baseline(c: Column | str, cycle: int | None, keys: Sequence[str] = CELL, fallback: bool = True) -> Column:
    """The value at the baseline cycle; with ``fallback`` the earliest where that cycle is missing."""
    w = Window.partitionBy(*keys).orderBy("cycle").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A struct keeps a null value of the baseline row apart from a missing row.
    value = F.struct(col(c).alias("v"))
    at = F.first(F.when(F.col("cycle") == cycle, value), True).over(w) if cycle is not None else F.lit(None)
    return (F.coalesce(at, F.first(value).over(w)) if fallback else at)["v"]


def rolling_slope(y: Column | str, window: int, keys: Sequence[str] = CELL, x: str = "cycle") -> Column:
    """OLS slope over the last ``window`` rows; null before there are so many, or with few values."""
    w = Window.partitionBy(*keys).orderBy(x)
    frame = w.rowsBetween(-(window - 1), 0)
    enough = (F.row_number().over(w) >= window) & (F.regr_count(col(y), F.col(x)).over(frame) >= max(3, window // 2))
    return F.when(enough, F.regr_slope(col(y), F.col(x).cast("double")).over(frame))


def gradient(y: str, x: str = "cycle", keys: Sequence[str] = CELL) -> Column:
    """Second-order differences inside, one-sided at the ends, for uneven x; a null spreads to its neighbours."""
    w = Window.partitionBy(*keys).orderBy(x)
    y0, y1, x0, x1 = F.lag(y).over(w), F.lead(y).over(w), F.lag(x).over(w), F.lead(x).over(w)
    a, b = (F.col(x) - x0).cast("double"), (x1 - F.col(x)).cast("double")
    inside = (a * a * y1 - b * b * y0 + (b * b - a * a) * F.col(y)) / (a * b * (a + b))
    return F.when(x0.isNull(), (y1 - F.col(y)) / b).when(x1.isNull(), (F.col(y) - y0) / a).otherwise(inside)


def trajectory(table: DataFrame, deltas: Sequence[str] = (), increases: Sequence[str] = (), baseline_cycle: int | None = 1, keys: Sequence[str] = CELL, window: int = 21, local: int = 20) -> DataFrame:
    """Add health, efficiencies, deltas and slopes to a table with ``cycle, dchgCapa, chgCapa``.

    SoHQ is the discharge capacity in % of the baseline's, CE_rev the next charge
    in % of this discharge, ``delta_*`` a difference and ``*_inc`` an increase in %
    of the baseline's size.
    """
    w = Window.partitionBy(*keys).orderBy("cycle")
    base = {c: baseline(c, baseline_cycle, keys) for c in {"dchgCapa", *deltas, *increases}}
    rows = table.withColumns({
        "SoHQ": ratio("dchgCapa", base["dchgCapa"]) * 100,
        "CE": ratio("dchgCapa", "chgCapa") * 100,
        "CE_rev": ratio(F.lead("chgCapa").over(w), "dchgCapa") * 100,
        **{f"delta_{c}": F.col(c) - base[c] for c in deltas},
        **{f"{c}_inc": ratio(F.col(c) - base[c], F.abs(base[c])) * 100 for c in increases},
    })
    frame = w.rowsBetween(-(local - 1), 0)
    rows = rows.withColumns({
        "dSoHQ_dN": rolling_slope("SoHQ", window, keys),
        f"CE_local_{local}": F.when(F.count("CE").over(frame) >= 8, F.avg("CE").over(frame)),
    })
    return rows.withColumn("d2SoHQ", gradient("dSoHQ_dN", keys=keys))


def bands(table: DataFrame, health: str = "SoHQ", edges: Sequence[tuple[float, float]] = ((95.0, 90.0), (90.0, 80.0), (80.0, 70.0), (70.0, 60.0)), columns: Sequence[str] = (), least: int = 6, keys: Sequence[str] = CELL) -> DataFrame:
    """Change of each column from the first to the last third of a health band (hi >= health > lo)."""
    band = F.lit(None).cast("string")
    for hi, lo in edges:
        band = F.when((F.col(health) <= hi) & (F.col(health) > lo), F.lit(f"{hi:g}-{lo:g}")).otherwise(band)
    w = Window.partitionBy(*keys, "band")
    rows = table.withColumn("band", band).where("band is not null").withColumns({"_p": F.row_number().over(w.orderBy("cycle")), "_n": F.count("*").over(w)}).where(F.col("_n") >= least)
    third = F.floor(F.col("_n") / 3)
    long = rows.select(*keys, "band", "_n", "_p", third.alias("_third"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))).alias("_f")).select("*", "_f.*")
    first, last = F.col("_p") <= F.col("_third"), F.col("_p") > F.col("_n") - F.col("_third")
    found = long.groupBy(*keys, "band", "feature").agg(
        F.max("_n").alias("n"), F.avg(F.when(first, F.col("value"))).alias("first_mean"), F.avg(F.when(last, F.col("value"))).alias("last_mean"),
        F.count(F.when(first, F.col("value"))).alias("_a"), F.count(F.when(last, F.col("value"))).alias("_b"),
    )
    return found.where("_a >= 2 and _b >= 2").select(*keys, "band", "feature", "n", "first_mean", "last_mean", (F.col("last_mean") - F.col("first_mean")).alias("change"))


def knee_split(table: DataFrame, health: str = "SoHQ", knee: float | None = None, keys: Sequence[str] = CELL) -> DataFrame:
    """The cycle that splits a trajectory: first below a health, else of largest curvature, else at 60 % of the rows."""
    w = Window.partitionBy(*keys)
    rows = table.where(F.col(health).isNotNull()).withColumns({"_p": F.row_number().over(w.orderBy("cycle")), "_n": F.count("*").over(w)})
    by_health = F.min(F.when(F.col(health) <= knee, F.col("cycle"))) if knee is not None else F.lit(None).cast("long")
    by_curve = F.max_by("cycle", F.when(F.col("d2SoHQ").isNotNull(), F.struct(F.abs("d2SoHQ"), -F.col("cycle")))) if "d2SoHQ" in table.columns else F.lit(None).cast("long")
    by_share = F.min(F.when(F.col("_p") >= F.floor(F.col("_n") * 0.6) + 1, F.col("cycle")))
    found = rows.groupBy(*keys).agg(F.coalesce(by_health, by_curve, by_share).alias("knee_cycle"))
    means = table.join(found, list(keys)).groupBy(*keys, "knee_cycle")
    return means.agg(F.avg(F.when(F.col("cycle") < F.col("knee_cycle"), F.col(health))).alias("before_mean"), F.avg(F.when(F.col("cycle") >= F.col("knee_cycle"), F.col(health))).alias("after_mean"))
