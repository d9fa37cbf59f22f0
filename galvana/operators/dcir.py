"""Resistance pulses by blocks of cycles: what they add to cycle rows, and how relaxed voltages drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions.expr import ratio, slope
from galvana.operators import curves
from galvana.operators.regime import rate_capability
from galvana.operators.segment import consecutive_blocks, pulse_cycles

#: States of charge of a block's cycles, noise of relaxation in %, thresholds of drift in volts.
SOC = (80, 50, 20)
RELAX_NOISE_PCT = 0.065
PARALLEL, SPREAD = 0.005, 0.010
#: Names of a pulse cycle's columns that get the state of charge as suffix.
BY_SOC = (
    "R_ohmic", "R_ct", "tau_ct", "A_diff", "R_30s_total", "R_ohmic_frac", "R_ct_frac", "R_diff_frac", "dcir_fit_rmse", "dcir_fit_r2", "dcir_fit_cond", "dcir_fit_valid",
    "n_points", "n_t_le_1s", "pulse_current_A", "flag", "R_recovery_tau1", "R_recovery_tau2", "relax_amp_ratio", "V_inf_est", "recovery_fit_r2", "tau_consistency_flag",
    "self_discharge_rate", "sd_fit_valid", "V_inf_rest", "relax_completeness",
)


def pulse_blocks(samples: DataFrame, expected: float = 70.0) -> DataFrame:
    """``cell_id, block_id, block_start, block_end, cycle, soc``: cycles of pulse blocks, three to a block.

    A cell with blocks of three cycles or more has those alone, and their first
    three cycles stand for 80, 50 and 20 %; others have no state of charge.
    """
    blocks = consecutive_blocks(pulse_cycles(samples, expected))
    w = Window.partitionBy("cell_id")
    blocks = blocks.withColumn("_long", F.max("n_cycles").over(w) >= 3).where(~F.col("_long") | (F.col("n_cycles") >= 3))
    blocks = blocks.withColumn("block_id", F.row_number().over(w.orderBy("block_start")))
    last = F.when(F.col("_long"), F.col("block_start") + 2).otherwise(F.col("block_end"))
    each = blocks.select("cell_id", "block_id", "block_start", last.alias("block_end"), "_long", F.explode(F.sequence("block_start", last)).alias("cycle"))
    place = F.col("cycle") - F.col("block_start")
    soc = F.when(F.col("_long"), F.when(place == 0, SOC[0]).when(place == 1, SOC[1]).when(place == 2, SOC[2]))
    return each.withColumn("soc", soc).drop("_long")


def pulse_table(samples: DataFrame, blocks: DataFrame, rest_max: float = 0.5, expected: float = 70.0, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """The fits of every cycle of the blocks, with block and state of charge."""
    keys = ["cell_id", "cycle"]
    own = samples.join(blocks.select(*keys).distinct(), keys, "left_semi")
    return blocks.join(curves.pulse_cycle_fits(own, rest_max, expected, order=order), keys)


def soc_structure(pulses: DataFrame) -> DataFrame:
    """``R_ratio_20_50, R_ratio_80_50, R_SOC_slope, R_SOC_curvature`` of each block from its resistances at 30 s."""
    at = lambda s: F.max(F.when(F.col("soc") == s, F.nullif("R_30s_total", F.lit(0.0))))
    r = F.col("R_30s_total")
    found = pulses.where("soc is not null").groupBy("cell_id", "block_id").agg(at(20).alias("_20"), at(50).alias("_50"), at(80).alias("_80"), slope(r, "soc").alias("R_SOC_slope"))
    some = F.col("_50") > 0
    return found.select(
        "cell_id",
        "block_id",
        F.when(some, ratio("_20", "_50")).alias("R_ratio_20_50"),
        F.when(some, ratio("_80", "_50")).alias("R_ratio_80_50"),
        "R_SOC_slope",
        ((F.col("_20") - 2 * F.col("_50") + F.col("_80")) / 1800).alias("R_SOC_curvature"),  # half the second difference over 30 %
    )


def drift_mode(d80: Column, d50: Column, d20: Column, spread: Column) -> tuple[Column, Column]:
    """How relaxed voltages moved, and by how much together: their line over the state of charge, and what is left of it.

    Three even points leave c, -2 c and c of their line, with a deviation of root 2 c.
    """
    c = F.abs(d80 - 2 * d50 + d20) / 6
    line, wide = c * F.sqrt(F.lit(2.0)) < PARALLEL, F.abs(spread) > SPREAD
    still = (F.greatest(F.abs(d80), F.abs(d50), F.abs(d20)) < PARALLEL) & (F.abs(spread) < SPREAD)
    mode = (
        F.when(still, "stable").when(line & ~wide, "parallel_shift").when(wide & line, "spread_and_shift").when(wide, "spread_change").when(2 * c > 2 * PARALLEL, "local_soc50").otherwise("stable")
    )
    return mode, F.when(still, F.lit(0.0)).otherwise((d80 + d50 + d20) / 3)


def ocv_blocks(pulses: DataFrame) -> DataFrame:
    """Relaxed voltages of each block with all three, their spreads, and their drift from the cell's first such block."""
    at = lambda c, s: F.max(F.when(F.col("soc") == s, F.col(c)))
    found = pulses.where("soc is not null").groupBy("cell_id", "block_id", F.col("block_start").alias("block_start_cycle")).agg(
        *(at("V_inf_rest", s).alias(f"ocv_V_inf_soc{s}") for s in SOC), F.max("relax_completeness").alias("relax_completeness_max")
    )
    v = {s: F.col(f"ocv_V_inf_soc{s}") for s in SOC}
    found = found.where(v[80].isNotNull() & v[50].isNotNull() & v[20].isNotNull())
    spreads = {"ocv_spread_20_80": v[20] - v[80], "ocv_spread_50_80": v[50] - v[80], "ocv_spread_20_50": v[20] - v[50]}
    w = Window.partitionBy("cell_id").orderBy("block_id")
    rows = found.withColumns(spreads).withColumn("_first", F.first(F.struct("block_id", *(f"ocv_V_inf_soc{s}" for s in SOC), "ocv_spread_20_80")).over(w))
    rows = rows.withColumns({f"delta_{c}": F.col(c) - F.col(f"_first.{c}") for c in (*(f"ocv_V_inf_soc{s}" for s in SOC), "ocv_spread_20_80")})
    mode, shift = drift_mode(*(F.col(f"delta_ocv_V_inf_soc{s}") for s in SOC), F.col("delta_ocv_V_inf_soc20") - F.col("delta_ocv_V_inf_soc80"))
    start = F.col("block_id") == F.col("_first.block_id")
    return rows.withColumns({"ocv_drift_mode": F.when(start, "baseline").otherwise(mode), "ocv_parallel_shift": F.when(start, 0.0).otherwise(shift)}).drop("_first")


def relaxation(features: DataFrame, pairs: DataFrame, prefix: str, least: float = 10.0, q: str = "dchgCapa") -> DataFrame:
    """``{prefix}, {prefix}_pct, {prefix}_significant`` on both cycles of each pair (cell_id, c1, c2): the second's capacity less the first's."""
    own = features.select("cell_id", "cycle", F.col(q).alias("_q"))
    one = own.select("cell_id", F.col("cycle").alias("c1"), F.col("_q").alias("_q1"))
    two = own.select("cell_id", F.col("cycle").alias("c2"), F.col("_q").alias("_q2"))
    found = pairs.select("cell_id", "c1", "c2").join(one, ["cell_id", "c1"]).join(two, ["cell_id", "c2"]).where(F.least("_q1", "_q2") >= least)
    pct = ratio(F.col("_q2") - F.col("_q1"), "_q2") * 100
    rows = found.where("_q1 is not null and _q2 is not null").select("cell_id", F.explode(F.array("c1", "c2")).alias("cycle"), (F.col("_q2") - F.col("_q1")).alias(prefix), pct.alias(f"{prefix}_pct"), (F.abs(pct) > RELAX_NOISE_PCT).alias(f"{prefix}_significant"))
    return rows.groupBy("cell_id", "cycle").agg(*(F.max_by(c, F.abs(F.col(prefix))).alias(c) for c in (prefix, f"{prefix}_pct", f"{prefix}_significant")))


def enrich(features: DataFrame, samples: DataFrame, test_blocks: DataFrame | None = None, rest_max: float = 0.5, expected: float = 70.0, delta_i: float | None = None, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Add what pulse blocks tell to cycle rows: resistances by state of charge on their own cycles, structure and drift on all
    cycles of a block, relaxation of capacity, rate capability and polarization.

    ``test_blocks`` (cell_id, block_start, block_end) are reference performance tests;
    without them the two cycles before a pulse block stand for one.
    """
    keys = ["cell_id", "cycle"]
    blocks = pulse_blocks(samples, expected)
    pulses = pulse_table(samples, blocks, rest_max, expected, order)
    wide = pulses.groupBy(*keys).agg(*(F.max(F.when(F.col("soc") == s, F.col(c))).alias(f"{c}_soc{s}") for s in SOC for c in BY_SOC), *(F.max(F.when(F.col("soc").isNull(), F.col(c))).alias(c) for c in ("R_ohmic", "R_ct", "tau_ct", "A_diff", "R_30s_total", "dcir_fit_valid", "self_discharge_rate")))
    ocv = ocv_blocks(pulses).drop(*(f"ocv_V_inf_soc{s}" for s in SOC))
    by_block = blocks.select(*keys, "block_id").join(soc_structure(pulses), ["cell_id", "block_id"], "left").join(ocv, ["cell_id", "block_id"], "left")
    by_block = by_block.withColumn("block_id", F.when(F.col("block_start_cycle").isNotNull(), F.col("block_id")))
    starts = blocks.select("cell_id", "block_start").distinct()
    before = starts.select("cell_id", (F.col("block_start") - 2).alias("c1"), (F.col("block_start") - 1).alias("c2"))
    tests = test_blocks.where("block_end > block_start").select("cell_id", F.col("block_start").alias("c1"), (F.col("block_start") + 1).alias("c2")) if test_blocks is not None else before
    rows = features
    for part in (wide, by_block, relaxation(features, before, "Q_relax_dcir"), relaxation(features, tests, "Q_relax_rpt")):
        rows = rows.join(part, keys, "left")
    rpt = F.col("Q_relax_rpt_pct").isNotNull()
    rows = rows.withColumns({f"Q_relax{c}": F.when(rpt, F.col(f"Q_relax_rpt{c}")).otherwise(F.col(f"Q_relax_dcir{c}")) for c in ("", "_pct", "_significant")})
    rows = rows.withColumn("Q_relax_source", F.when(rpt, "rpt_block").when(F.col("Q_relax_dcir_pct").isNotNull(), "dcir_pre"))
    anchors = before.select("cell_id", F.explode(F.array("c1", "c2")).alias("cycle")).distinct()
    routine = features.join(blocks.select(*keys), keys, "left_anti")
    rows = rows.join(rate_capability(features, anchors).join(routine.select(*keys), keys, "left_semi").select(*keys, "RCF"), keys, "left")
    if "eta_SOC50" in features.columns and delta_i:
        rows = rows.withColumn("PER", F.when(F.col("R_30s_total_soc50") > 0, F.col("eta_SOC50") / (delta_i * F.col("R_30s_total_soc50") / 1000)))
    else:
        rows = rows.withColumn("PER", F.lit(None).cast("double"))
    return rows


def first_capacity_cycle(blocks: DataFrame, features: DataFrame) -> DataFrame:
    """``cell_id, baseline_cycle``: the capacity cycle right before each cell's first pulse block, where it was measured."""
    first = blocks.groupBy("cell_id").agg((F.min("block_start") - 1).alias("cycle"))
    return first.join(features.select("cell_id", "cycle"), ["cell_id", "cycle"], "left_semi").withColumnRenamed("cycle", "baseline_cycle")
