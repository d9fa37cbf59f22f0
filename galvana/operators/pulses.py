"""Pulses, rests around them, and constant-voltage tails, by windows over samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions import kernels
from galvana.functions.expr import at_most, pearson, ratio
from galvana.operators.curves import _grouped
from galvana.operators.order import average_ranks
from galvana.operators.score import to_long

KEYS = ("cell_id", "cycle")


def pulse_trace(samples: DataFrame, expected: float, rest_max: float = 0.5, seconds: float = 30.0, keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """The first loaded samples of each cycle: ``t, r_mohm`` since the load, from the sample before it.

    A pulse starts where the current first exceeds the larger of the rest current
    and half the expected one, and ends after ``seconds`` or at rest.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    a = F.abs("current")
    rows = samples.withColumns({"_v0": F.lag("voltage").over(w), "_on": a > max(rest_max, 0.5 * expected), "_p": F.row_number().over(w)})
    first = rows.where("_on").groupBy(*keys).agg(F.min("_p").alias("_first"), F.min_by("time", "_p").alias("_t0"), F.min_by("_v0", "_p").alias("_start"))
    rows = rows.join(first, list(keys)).where((F.col("_p") >= F.col("_first")) & (F.col("time") - F.col("_t0") <= seconds * 1.005))
    ended = F.max((a < rest_max).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_ended", ended).where("_ended = 0 and _start is not null")
    return rows.select(*keys, *order, (F.col("time") - F.col("_t0")).alias("t"), ratio(F.abs(F.col("_start") - F.col("voltage")) * 1000, a).alias("r_mohm"))


def pre_pulse_rest(samples: DataFrame, expected: float, rest_max: float = 0.5, least_s: float = 1800.0, keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """The samples of the rest right before the first pulse of each cycle, if it lasts long enough."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = samples.withColumn("_p", F.row_number().over(w))
    at = rows.groupBy(*keys).agg(F.min(F.when(F.abs("current") >= 0.7 * expected, F.col("_p"))).alias("_pulse")).where("_pulse is not null")
    before = rows.join(at, list(keys)).where(F.col("_p") < F.col("_pulse"))
    busy = before.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.abs("current") > rest_max, F.col("_p"))), F.lit(0)).alias("_busy"))
    rest = before.join(busy, list(keys)).where(F.col("_p") > F.col("_busy"))
    span = rest.groupBy(*keys).agg((F.max("time") - F.min("time")).alias("_s")).where(F.col("_s") >= least_s)
    return rest.join(span, list(keys), "left_semi").select(*samples.columns)


def cv_start(samples: DataFrame, frac: float = 0.92, sustained: int = 5, head: float = 0.1, keys: Sequence[str] = ("cell_id", "cycle", "leg"), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``cv_start, n``: the first place after the head from which the current stays below a share of its early median."""
    w = Window.partitionBy(*keys)
    a = F.abs("current")
    rows = samples.withColumns({"_p": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    cc = rows.where(F.col("_p") <= F.ceil(F.col("_n") / 2)).groupBy(*keys).agg(F.median(a).alias("_cc"))
    rows = rows.join(cc, list(keys)).withColumn("_low", (a < frac * F.col("_cc")).cast("int"))
    ahead = w.orderBy("_p").rowsBetween(0, sustained - 1)
    ok = (F.min("_low").over(ahead) == 1) & (F.count("*").over(ahead) == sustained) & (F.col("_p") > F.col("_n") * head)
    return rows.withColumn("_ok", ok).groupBy(*keys).agg(F.min(F.when(F.col("_ok"), F.col("_p"))).alias("cv_start"), F.max("_n").alias("n"))


def cv_runs(samples: DataFrame, margin: float = 0.015, least: int = 3, keys: Sequence[str] = ("cell_id", "cycle", "leg"), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """The longest run (of equal ones the first) near a leg's top voltage with falling current: ``first, n``."""
    w = Window.partitionBy(*keys)
    o = w.orderBy(*order)
    top = F.percentile("voltage", F.lit(0.99)).over(w)
    rows = samples.withColumns({"_p": F.row_number().over(o), "_in": F.coalesce((F.col("voltage") >= top - margin) & (F.abs("current") < F.lag(F.abs("current")).over(o)), F.lit(False))})
    rows = rows.where("_in").withColumn("_g", F.col("_p") - F.row_number().over(w.orderBy("_p")))
    runs = rows.groupBy(*keys, "_g").agg(F.min("_p").alias("first"), F.count("*").alias("n")).where(F.col("n") >= least)
    return runs.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first")).alias("f"))).alias("b")).select(*keys, (-F.col("b.f")).alias("first"), F.col("b.n").alias("n"))


def root_time_slopes(pulse: DataFrame, windows: Sequence[tuple[float, float]] = ((1.0, 10.0), (10.0, 30.0)), keys: Sequence[str] = KEYS) -> DataFrame:
    """``lo, hi, slope, r2``: resistance (t, r_mohm) over the root of time within each window."""
    out = None
    x, y = F.sqrt("t"), F.col("r_mohm")
    for lo, hi in windows:
        part = pulse.where(F.col("t").between(lo, hi)).groupBy(*keys).agg(
            F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), ratio(F.covar_pop(y, x) * F.covar_pop(y, x), F.var_pop(y) * F.var_pop(x)).alias("r2")
        )
        part = part.select(*keys, F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), "n", "slope", "r2")
        out = part if out is None else out.unionByName(part)
    return out


def temperature_corrected(r: Column | str, celsius: Column | str, ea: float, reference: float = 25.0) -> Column:
    """A resistance at the reference temperature, by an activation energy in J/mol."""
    r, t = (F.col(c) if isinstance(c, str) else c for c in (r, celsius))
    return r * F.exp(F.lit(ea / 8.314462618) * (F.lit(1 / (reference + 273.15)) - 1 / (t + 273.15)))


def polarization_ratio(eta: Column | str, current: float, r_mohm: Column | str) -> Column:
    """Overvoltage over what the resistance explains."""
    return ratio(eta, (F.col(r_mohm) if isinstance(r_mohm, str) else r_mohm) * current / 1000)


def load_window(samples: DataFrame, pad_s: float = 300.0, rest_max: float = 0.5, onset: float = -1.0, keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Samples around the first discharge load, with the time since it and the last unloaded voltage before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    resting = F.last(F.when(F.abs("current") <= rest_max, F.col("voltage")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = samples.withColumns({"_ref": resting, "_p": F.row_number().over(w)})
    first = rows.where(F.col("current") < onset).groupBy(*keys).agg(F.min_by("time", "_p").alias("_t0"), F.min_by("_ref", "_p").alias("v_ref"))
    joined = rows.join(first, list(keys)).withColumn("t", F.col("time") - F.col("_t0"))
    return joined.where(F.abs("t") <= pad_s).select(*keys, *order, "t", "voltage", "current", "v_ref")


def block_recoveries(series: DataFrame, blocks: DataFrame, column: str, width: int = 20, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """``amplitude, decay``: an exponential above the level before each block, over the cycles after it."""
    joined = blocks.select(*keys, "block_start", "block_end").join(series.select(*keys, "cycle", F.col(column).cast("double").alias("y")), list(keys))
    near = joined.where((F.col("cycle").between(F.col("block_start") - width, F.col("block_start") - 1) | F.col("cycle").between(F.col("block_end") + 1, F.col("block_end") + width)) & F.col("y").isNotNull())

    def f(g):
        before, k = g["cycle"] < g["block_start"], g["cycle"] - g["block_end"]
        if before.sum() < 2 or (~before).sum() < 4:
            return {"amplitude": np.nan, "decay": np.nan}
        y, k = g["y"][~before] - g["y"][before].mean(), k[~before].astype(float)
        lim = 2 * np.abs(y).max() + 1e-9
        p, _ = kernels.least_squares(lambda p: p[0] * np.exp(-k / p[1]) - y, (y[0], 5.0), (-lim, 0.5), (lim, 100.0))
        return {"amplitude": float(p[0]), "decay": float(p[1])}

    return _grouped(near, [*keys, "block_start", "block_end"], ["cycle", "y", "block_start", "block_end"], ["cycle"], "amplitude double, decay double", f)


def curvature_onset(table: DataFrame, column: str, early: int = 20, sigmas: float = 3.0, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """The first cycle whose second difference exceeds that many spreads of the early ones."""
    w = Window.partitionBy(*keys).orderBy("cycle")
    second = F.lead(column).over(w) - 2 * F.col(column) + F.lag(column).over(w)
    rows = table.withColumns({"_d": second, "_p": F.row_number().over(w)})
    scale = rows.where(F.col("_p") <= early).groupBy(*keys).agg(F.stddev_pop("_d").alias("_s"))
    hit = (F.col("_p") > early) & (F.abs("_d") > sigmas * F.col("_s"))
    return rows.join(scale, list(keys)).groupBy(*keys).agg(F.min(F.when(hit, F.col("cycle"))).alias("onset_cycle"))


def rank_correlation(table: DataFrame, columns: Sequence[str], target: str, least: int = 5) -> DataFrame:
    """``feature, n, rho``: Spearman's with average ranks of ties, over a table of one row a cell."""
    long = to_long(table.withColumn("_t", F.col(target).cast("double")), columns, ["_t"]).where("value is not null and _t is not null")
    own = average_ranks(long, ["feature"]).withColumnRenamed("rank", "x")
    goal = average_ranks(long, ["feature"], "_t").withColumnRenamed("rank", "y")
    ranked = long.join(own, ["feature", "value"]).join(goal, ["feature", "_t"])
    return ranked.groupBy("feature").agg(F.count("*").alias("n"), pearson("x", "y").alias("rho")).where(F.col("n") >= least)


def lifecycle(seen: DataFrame, confirm: int = 3, of: int = 5, coast: int = 3, end: int = 5, keys: Sequence[str] = ("cell_id", "leg", "track")) -> DataFrame:
    """State of each track over its cycles (cycle, observed): tentative, confirmed, coasting or terminated.

    Confirmed with ``confirm`` observations in the last ``of`` rows, coasting after
    that many misses in a row, terminated after ``end``; a terminated track stays so.
    """
    w = Window.partitionBy(*keys).orderBy("cycle")
    hit = F.col("observed").cast("int")
    rows = seen.withColumns({"_hits": F.sum(hit).over(w.rowsBetween(-(of - 1), 0)), "_run": F.sum(hit).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("_miss", F.sum(F.lit(1) - hit).over(Window.partitionBy(*keys, "_run").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)))
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_was": F.max((F.col("_hits") >= confirm).cast("int")).over(past), "_dead": F.max((F.col("_miss") >= end).cast("int")).over(past)})
    state = F.when(F.col("_dead") == 1, "terminated").when((F.col("_was") == 1) & (F.col("_miss") >= coast), "coasting").when(F.col("_was") == 1, "confirmed").otherwise("tentative")
    return rows.select(*seen.columns, state.alias("state"))


def noise_by_voltage(samples: DataFrame, column: str, bins: int = 5, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Median of a column in equal-width bins of each group's voltages."""
    edges = samples.groupBy(*keys).agg(F.min("voltage").alias("_lo"), F.max("voltage").alias("_hi"))
    place = at_most(F.floor(ratio(F.col("voltage") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins) + 1, bins)
    return samples.join(edges, list(keys)).withColumn("bin", F.coalesce(place, F.lit(1)).cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.median(column).alias("median"))
