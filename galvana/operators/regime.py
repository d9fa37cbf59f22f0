"""Regimes of a trajectory between given breakpoints, anchors of tests, and recoveries after them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions.expr import pearson, ratio, slope
from galvana.operators.asof import nearest
from galvana.operators.score import to_long


def regime(cycle: str, breakpoints: Sequence[float]) -> Column:
    """Number of breakpoints at or below the cycle."""
    out = F.lit(0)
    for b in breakpoints:
        out = out + (F.col(cycle) >= b).cast("int")
    return out


def regime_slopes(table: DataFrame, columns: Sequence[str], breakpoints: Sequence[float], keys: Sequence[str] = ("cell_id",), least: int = 5) -> DataFrame:
    """Slope, correlation and ends of each column within each regime of ``least`` values or more."""
    long = to_long(table.withColumn("regime", regime("cycle", breakpoints)), columns, [*keys, "cycle", "regime"]).where("value is not null")
    found = long.groupBy(*keys, "regime", "feature").agg(
        F.count("*").alias("n"),
        slope("value", "cycle").alias("slope"),
        pearson("value", "cycle").alias("r"),
        F.min_by("value", "cycle").alias("y_start"),
        F.max_by("value", "cycle").alias("y_end"),
    )
    return found.where(F.col("n") >= least)


def rank_drivers(table: DataFrame, columns: Sequence[str], health: str, breakpoints: Sequence[float], top_n: int = 8, least: int = 15) -> DataFrame:
    """The columns of each regime that go with health most, by size of correlation."""
    rows = table.withColumns({"regime": regime("cycle", breakpoints), "_health": F.col(health).cast("double")})
    long = to_long(rows, columns, ["regime", "_health"]).where("value is not null and _health is not null")
    found = long.groupBy("regime", "feature").agg(F.count("*").alias("n"), pearson("value", "_health").alias("r")).where((F.col("n") >= least) & F.col("r").isNotNull())
    w = Window.partitionBy("regime").orderBy(F.desc(F.abs("r")), "feature")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def singularities(table: DataFrame, columns: Sequence[str], breakpoints: Sequence[float], window: int = 15, keys: Sequence[str] = ("cell_id",), least: int = 10) -> DataFrame:
    """At each breakpoint: a column's jump between means of the windows around it, and whether its slope changes sign."""
    slopes = regime_slopes(table, columns, breakpoints, keys, least).select(*keys, "feature", "regime", "slope")
    near = to_long(table, columns, [*keys, "cycle"]).select("*", F.posexplode(F.array(*(F.lit(float(b)) for b in breakpoints))).alias("_k", "breakpoint"))
    c, b = F.col("cycle"), F.col("breakpoint")
    jump = near.groupBy(*keys, "feature", "_k", "breakpoint").agg(
        F.avg(F.when((c < b) & (c >= b - window), F.col("value"))).alias("_a"), F.avg(F.when((c >= b) & (c < b + window), F.col("value"))).alias("_b")
    )
    before = slopes.select(*keys, "feature", F.col("regime").alias("_k"), F.col("slope").alias("slope_before"))
    after = slopes.select(*keys, "feature", (F.col("regime") - 1).alias("_k"), F.col("slope").alias("slope_after"))
    found = jump.join(before, [*keys, "feature", "_k"], "left").join(after, [*keys, "feature", "_k"], "left")
    flip = F.coalesce(F.col("slope_before") * F.col("slope_after") < 0, F.lit(False))
    return found.select(*keys, "feature", "breakpoint", (F.col("_b") - F.col("_a")).alias("jump"), "slope_before", "slope_after", flip.alias("sign_flip"))


def local_slope(y: str, half: int = 15, keys: Sequence[str] = ("cell_id",), least: int = 5) -> Column:
    """Centered OLS slope over ``half`` rows to either side, per 100 cycles."""
    frame = Window.partitionBy(*keys).orderBy("cycle").rowsBetween(-half, half)
    return F.when(F.regr_count(F.col(y), F.col("cycle")).over(frame) >= least, F.regr_slope(F.col(y), F.col("cycle").cast("double")).over(frame) * 100)


def block_relaxation(features: DataFrame, blocks: DataFrame, q: str = "dchgCapa", noise_floor_pct: float = 0.065) -> DataFrame:
    """``q_relax, q_relax_pct, significant`` of each block: its second cycle's capacity less its first's, also in % of the second's."""
    inside = blocks.join(features.select("cell_id", "cycle", F.col(q).alias("_q")), "cell_id").where((F.col("cycle") == F.col("block_start")) | (F.col("cycle") == F.col("block_start") + 1))
    found = inside.groupBy("cell_id", "block_start", "block_end").agg(
        F.max(F.when(F.col("cycle") == F.col("block_start"), F.col("_q"))).alias("q1"), F.max(F.when(F.col("cycle") == F.col("block_start") + 1, F.col("_q"))).alias("q2")
    )
    pct = ratio(F.col("q2") - F.col("q1"), "q2") * 100
    return found.select("cell_id", "block_start", "block_end", (F.col("q2") - F.col("q1")).alias("q_relax"), pct.alias("q_relax_pct"), (F.abs(pct) > noise_floor_pct).alias("significant"))


def rate_capability(features: DataFrame, anchors: DataFrame, q: str = "dchgCapa") -> DataFrame:
    """``RCF``: a routine cycle's capacity over that of the nearest anchor cycle of its cell."""
    values = anchors.join(features.select("cell_id", "cycle", F.col(q).alias("_anchor_q")), ["cell_id", "cycle"]).where("_anchor_q is not null")
    found = nearest(features.select("cell_id", "cycle", q), values.select("cell_id", "cycle", "_anchor_q"), ["cell_id"], "cycle", ["_anchor_q"])
    return found.select("cell_id", "cycle", F.col("nearest_cycle").alias("anchor_cycle"), ratio(q, "nearest__anchor_q").alias("RCF"))


def pre_block_anchors(features: DataFrame, blocks: DataFrame, column: str, width: int = 5) -> DataFrame:
    """Mean of the last ``width`` rows before each block."""
    joined = blocks.select("cell_id", "block_start").join(features.select("cell_id", "cycle", column), "cell_id").where(F.col("cycle") < F.col("block_start"))
    w = Window.partitionBy("cell_id", "block_start").orderBy(F.desc("cycle"))
    last = joined.where(F.col(column).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= width)
    return last.groupBy("cell_id", "block_start").agg(F.avg(column).alias("anchor"), F.count("*").alias("n"))


def contamination(features: DataFrame, kinds: DataFrame, column: str) -> DataFrame:
    """How far excluded cycles lie from the line through a cell's routine cycles."""
    rows = features.join(kinds, ["cell_id", "cycle"])
    routine = rows.where("protocol_kind = 'routine'").groupBy("cell_id").agg(slope(column, "cycle").alias("_a"), F.avg(column).alias("_y"), F.avg(F.when(F.col(column).isNotNull(), F.col("cycle"))).alias("_x"))
    out = rows.where("protocol_excluded").join(routine, "cell_id", "left")
    expected = F.col("_y") + F.col("_a") * (F.col("cycle") - F.col("_x"))
    return out.select("cell_id", "cycle", "protocol_kind", F.col(column).alias("value"), expected.alias("expected"), (F.col(column) - expected).alias("excess"))


def landmark_trend(features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Early and late medians (by the cell's cycle quantiles of 0.2 and 0.8) and their change in %."""
    w = Window.partitionBy(*keys)
    rows = features.withColumns({"_lo": F.percentile("cycle", F.lit(0.2)).over(w), "_hi": F.percentile("cycle", F.lit(0.8)).over(w)})
    long = to_long(rows, columns, [*keys, "cycle", "_lo", "_hi"])
    found = long.groupBy(*keys, "feature").agg(F.median(F.when(F.col("cycle") <= F.col("_lo"), F.col("value"))).alias("early"), F.median(F.when(F.col("cycle") >= F.col("_hi"), F.col("value"))).alias("late"))
    return found.withColumn("change_pct", ratio(F.col("late") - F.col("early"), F.abs("early")) * 100)


def soc_ratios(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``ratio_20_50, ratio_80_50, slope`` of a resistance at three states of charge (soc, r)."""
    at = lambda s: F.max(F.when(F.col("soc") == s, F.col("r")))
    found = rows.groupBy(*keys).agg(at(20).alias("_20"), at(50).alias("_50"), at(80).alias("_80"), slope("r", "soc").alias("r_soc_slope"))
    return found.select(*keys, ratio("_20", "_50").alias("ratio_20_50"), ratio("_80", "_50").alias("ratio_80_50"), "r_soc_slope")


def ocv_drift(blocks: DataFrame, keys: Sequence[str] = ("cell_id",), parallel: float = 0.005, spread: float = 0.01) -> DataFrame:
    """How relaxed voltages at 80, 50 and 20 % (v80, v50, v20 by block_start) move from the first full block.

    stable: all within 5 mV and the spread within 10; parallel_shift: spread within
    10 mV; spread_and_shift or spread_change by whether the mean moves by 5 mV.
    """
    w = Window.partitionBy(*keys).orderBy("block_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.when(F.col("v80").isNotNull() & F.col("v50").isNotNull() & F.col("v20").isNotNull(), F.struct("v80", "v50", "v20"))
    rows = blocks.withColumn("_first", F.first(full, True).over(w))
    d = {c: F.col(f"v{c}") - F.col(f"_first.v{c}") for c in ("80", "50", "20")}
    rows = rows.select(*keys, "block_start", *(x.alias(f"d{c}") for c, x in d.items()))
    shift = (F.col("d80") + F.col("d50") + F.col("d20")) / 3
    wide = F.col("d80") - F.col("d20")
    most = F.greatest(F.abs("d80"), F.abs("d50"), F.abs("d20"))
    kind = (
        F.when(shift.isNull(), "unknown")
        .when((most < parallel) & (F.abs(wide) < spread), "stable")
        .when((F.abs(wide) < spread) & (F.abs(shift) >= parallel), "parallel_shift")
        .when((F.abs(wide) >= spread) & (F.abs(shift) >= parallel), "spread_and_shift")
        .when(F.abs(wide) >= spread, "spread_change")
        .otherwise("local")
    )
    return rows.withColumns({"shift": shift, "spread_change": wide, "drift": kind})


def shift_relation(features: DataFrame, shift: str, resistance: str, endpoint: str, keys: Sequence[str] = ("cell_id",), least: int = 4) -> DataFrame:
    """Whether a voltage shift goes with resistance (kinetic), with the endpoint (inventory), or both."""
    n = F.count(F.when(F.col(shift).isNotNull() & F.col(resistance).isNotNull() & F.col(endpoint).isNotNull(), F.lit(1)))
    found = features.groupBy(*keys).agg(n.alias("n"), pearson(shift, resistance).alias("r_resistance"), pearson(shift, endpoint).alias("r_endpoint"))
    a, b = F.coalesce(F.abs("r_resistance"), F.lit(0.0)), F.coalesce(F.abs("r_endpoint"), F.lit(0.0))
    kind = F.when(F.col("n") < least, "unknown").when((a >= 0.6) & (b < 0.4), "kinetic").when((b >= 0.6) & (a < 0.4), "inventory").when((a >= 0.5) & (b >= 0.5), "mixed").otherwise("unclear")
    return found.withColumn("kind", kind)
