"""The wide cycle row: every feature of a cell's cycle, from samples in one pass for each kind of feature."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions.expr import ratio
from galvana.operators import curves, cycle, dcir, protocol, rests, segment, trajectory
from galvana.operators.diagnose import SEMANTICS_SCHEMA, VE_SEMANTICS
from galvana.shared import cut

#: Offsets of landmark resistances in seconds, and columns with a difference or a percent increase from the baseline.
OFFSETS = {"0p1s": 0.1, "10s": 10.0, "30s": 30.0, "60s": 60.0}
DELTAS = (
    "EoC_restV_60s", "EoC_restV_30m", "EoC_restV_end", "EoD_restV_60s", "EoD_restV_30m", "EoD_restV_end", "chgCapa_CCratio",
    "dchg_dQdV_peak1_V", "chg_dQdV_peak1_V", "dchg_dVdQ_SOC0", "dchg_dVdQ_SOC5", "dchg_dVdQ_SOC10", "dchg_dVdQ_SOCmid", "chg_dVdQ_SOC100",
    "dchg_V_avg", "chg_V_avg", "hyst_area", "hyst_max_dV", "dchg_plateau_V", "dchg_dVdQ_SOC0_cliff_width", "dchg_dVdQ_SOC0_to_mid_ratio",
    "dchg_V_cutoff_margin", "dchg_shape_DTW", "EoC_restV_tau", "EoD_restV_tau",
)
INCREASES = tuple(f"{p}_{s}" for p in ("EoC_dchgR", "EoD_chgR") for s in OFFSETS)
#: Columns whose difference needs the requested baseline itself.
STRICT_DELTAS = ("chg_V_avg", "dchg_V_avg", "hyst_area", "hyst_max_dV")
KEYS = ["cell_id", "cycle"]


@dataclass(frozen=True)
class Setting:
    """What is known of a cell's protocol; currents follow from the rated capacity unless stated."""

    rated_ah: float = 72.0
    routine_rate: float = 0.5
    test_rate: float = 1 / 3
    pulse_rate: float = 1.0
    pulse_current: float | None = None
    baseline_cycle: int = 1
    relaxation_s: float | None = None
    v_window: tuple[float, float] = (2.5, 4.2)
    band: tuple[float, float] = (3.0, 3.5)
    routine_steps: int = protocol.ROUTINE_STEPS

    @property
    def rest_max(self) -> float:
        return max(0.01, 0.007 * self.rated_ah)

    @property
    def pulse(self) -> float:
        return self.pulse_current if self.pulse_current is not None else self.rated_ah * self.pulse_rate

    @property
    def delta_i(self) -> float:
        return abs(self.rated_ah * (self.routine_rate - self.test_rate))


def _of_leg(rows: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row a cycle: each new column takes a column of a leg."""
    return rows.groupBy(*KEYS).agg(*(F.max(F.when(F.col("leg") == leg, F.col(c))).alias(name) for name, (leg, c) in columns.items()))


def _both(prefixes: dict[str, str]) -> dict[str, tuple[str, str]]:
    """``{chg,dchg}{suffix}`` of a leg's column."""
    return {f"{p}{suffix}": (leg, c) for p, leg in (("chg", "charge"), ("dchg", "discharge")) for suffix, c in prefixes.items()}


def leg_counters(samples: DataFrame, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Samples of both legs with the leg's own counter as ``capacity``."""
    legs = segment.leg_samples(samples, order=order)
    if {"charge_capacity", "discharge_capacity"} <= set(samples.columns):
        own = F.when(F.col("leg") == "charge", F.col("charge_capacity")).otherwise(F.col("discharge_capacity"))
        legs = legs.withColumn("capacity", own)
    return legs


def observed_columns(legs: DataFrame, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Observed capacity, energy and mean voltage of both legs, and ``observed_window``: ok or the reason against each."""
    found = cycle.observed_legs(legs, order=order)
    apart = legs.groupBy(*cycle.LEG).agg(F.bool_or("disjoint").alias("_apart"))
    found = found.join(apart, list(cycle.LEG))
    reason = F.coalesce(F.when(F.col("_apart"), F.lit("disjoint")), F.col("clock_reason"), F.col("counter_reason"), F.lit("ok"))
    found = found.withColumn("status", reason)
    found = found.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in ("capacity_observed", "energy_observed", "v_avg_observed")})
    wide = _of_leg(found, _both({"Capa_observed": "capacity_observed", "_E_observed": "energy_observed", "_V_avg_observed": "v_avg_observed", "_status": "status"}))
    status = lambda p: F.coalesce(F.col(f"{p}_status"), F.lit("missing"))
    window = F.create_map(F.lit("charge"), status("chg"), F.lit("discharge"), status("dchg"))
    return wide.withColumn("observed_window", window).drop("chg_status", "dchg_status")


def landmark_columns(legs: DataFrame, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``EoC_dchgR_*`` and ``EoD_chgR_*`` at the offsets, their differences and ratios."""
    found = cycle.landmark_resistance(legs, list(OFFSETS.values()), order=order)
    at = lambda leg, o: F.max(F.when((F.col("leg") == leg) & (F.col("offset") == o), F.col("r_mohm")))
    names = (("EoC_dchgR", "discharge"), ("EoD_chgR", "charge"))
    wide = found.groupBy(*KEYS).agg(*(at(leg, o).alias(f"{p}_{s}") for p, leg in names for s, o in OFFSETS.items()))
    more: dict[str, Column] = {}
    for p, _ in names:
        more |= {f"{p}_R{k}_minus_R0p1": F.col(f"{p}_{k}s") - F.col(f"{p}_0p1s") for k in (10, 30)} | {f"{p}_10_60_ratio": ratio(f"{p}_10s", f"{p}_60s")}
    return wide.withColumns(more)


def rest_columns(samples: DataFrame, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Rest voltages after each leg and their time constants, of the last rest."""
    rows = rests.rest_samples(samples, order=order)
    last = rows.groupBy(*KEYS, "after_leg").agg(F.max("run_id").alias("run_id"))
    own = rows.join(last, [*KEYS, "after_leg", "run_id"]).select(*KEYS, "after_leg", *(c for c in order if c != "time"), F.col("t").alias("time"), "voltage")
    tau = rests.rest_taus(own, [*KEYS, "after_leg"], ["time", *order])
    wide = tau.groupBy(*KEYS).agg(*(F.max(F.when(F.col("after_leg") == leg, F.col("tau"))).alias(f"{p}_restV_tau") for p, leg in (("EoC", "charge"), ("EoD", "discharge"))))
    return rests.leg_rests(samples, order=order).join(wide, KEYS, "left")


def shape_distances(legs: DataFrame, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``dchg_shape_DTW``: each discharge curve's distance from its cell's first one."""
    found = curves.normalised_curves(legs.where("leg = 'discharge'"), order=order).where(F.size("curve") > 0)
    first = found.withColumn("_c", F.min("cycle").over(Window.partitionBy("cell_id")))
    moved = first.withColumn("cycle", F.col("cycle") - F.col("_c"))  # the first is cycle 0
    distance = curves.shape_distance(moved.drop("_c"), 0)
    back = first.groupBy("cell_id").agg(F.min("_c").alias("_c"))
    return distance.join(back, "cell_id").select("cell_id", (F.col("cycle") + F.col("_c")).alias("cycle"), F.col("distance").alias("dchg_shape_DTW"))


def cycle_rows(samples: DataFrame, setting: Setting = Setting(), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Every feature of a cycle that needs no other cycle.

    Samples have cell_id, cycle, row_id, time, step_type, current, voltage and
    capacity (or a counter for each leg); step_time, step_no, temperature and
    charge_cv_capacity are used where they are. All joins are on cell and cycle.
    """
    kinds = segment.with_kind(samples, setting.rest_max)
    # Written once: ten kinds of features read the legs.
    legs = cut(leg_counters(kinds, order), "legs")
    prepared = segment.for_derivatives(legs, order=order)
    features = _of_leg(cycle.leg_features(legs, order=order), _both({"Capa": "capacity", "_V_cutoff": "v_end", "_I_cutoff": "i_end"})).drop("dchg_I_cutoff")
    span = kinds.groupBy(*KEYS).agg(((F.max("time") - F.min("time")) / 3600).alias("cycle_duration_h"))
    peaks = [f"{p}_{c}" for p in ("chg", "dchg") for c in curves.shapes.COMMON if "_peak" in c]
    shape = curves.shape_features(legs, order=order, peaks=False).drop(*peaks)
    bands = cycle.band_capacity(legs.where("leg = 'discharge'"), low=setting.band[0], high=setting.band[1], order=order)
    bands = bands.select(*KEYS, *(F.col(f"q_{b}").alias(f"dchg_Q_{b}_V") for b in ("high", "low", "mid")), *(F.col(f"q_{b}_frac").alias(f"dchg_Q_{b}_frac") for b in ("high", "low")), ratio("q_high", F.col("q_high") + F.col("q_low")).alias("dchg_f_graphite_proxy"))
    parts = [
        features, observed_columns(legs, order), landmark_columns(legs, order), rest_columns(kinds, order), shape, curves.peak_features(prepared, order=order), bands,
        curves.constant_voltage(legs.where("leg = 'charge'"), order=order), shape_distances(legs, order),
        cycle.quality_metrics(kinds, setting.v_window, setting.rest_max, setting.relaxation_s, setting.pulse, order=order),
    ]
    if "temperature" in samples.columns:
        warm = legs.groupBy(*cycle.LEG).agg(F.avg("temperature").alias("t"))
        parts.append(_of_leg(warm, _both({"_temp_avg": "t"})))
    rows = span
    for part in parts:
        rows = rows.join(part, KEYS, "left")
    sound = (F.col("observed_window")["charge"] == "ok") & (F.col("observed_window")["discharge"] == "ok")
    rows = rows.withColumns({c: F.when(sound, F.col(c)) for c in curves.shapes.HYSTERESIS} | {f"{p}{s}": F.col(f"{p}{s}_observed") for p in ("chg", "dchg") for s in ("_E", "_V_avg")})
    both = (F.col("chg_E") > 0) & (F.col("dchg_E") != 0)
    rows = rows.withColumns({
        "EE": F.when(both, ratio("dchg_E", "chg_E")),
        "dE": F.when(both, F.col("chg_E") - F.col("dchg_E")),
        "VE": F.when(both, ratio("dchg_V_avg_observed", "chg_V_avg_observed")),
        "CE_observed": ratio("dchgCapa_observed", "chgCapa_observed") * 100,
    })
    text = lambda **x: F.create_map(*(F.lit(y) for pair in x.items() for y in pair))
    return rows.withColumns({
        "VE_observed": F.col("VE"),
        "EE_observed": F.col("EE"),
        "feature_set": F.lit("cycle_v2"),
        "feature_semantics": text(schema=SEMANTICS_SCHEMA, VE=VE_SEMANTICS, VE_observed=VE_SEMANTICS, EE=VE_SEMANTICS, CE="counter_max_percent", hysteresis="endpoint_SOC_proxy_v2"),
        "feature_units": text(chgCapa="Ah", dchgCapa="Ah", chg_E="Wh", dchg_E="Wh", CE="percent", VE="fraction", EE="fraction"),
    })


def with_trajectories(rows: DataFrame, baseline_cycle: int = 1, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Add health, efficiencies, differences and increases from the baseline, slopes, and what baseline was taken.

    A cell without the baseline cycle takes its first; differences of voltages and
    hysteresis stay unknown then.
    """
    deltas, increases = ([c for c in names if c in rows.columns] for names in (DELTAS, INCREASES))
    out = trajectory.trajectory(rows, deltas, increases, baseline_cycle, keys)
    taken = trajectory.baseline("cycle", baseline_cycle, keys)
    out = out.withColumn("_taken", taken)
    semantics = F.struct(F.col("_taken").cast("double").alias("cycle"), F.lit(float(baseline_cycle)).alias("requested_cycle"), F.col("feature_semantics"))
    more = {"baseline_semantics": semantics} | {f"delta_{c}": F.when(F.col("_taken") == baseline_cycle, F.col(f"delta_{c}")) for c in STRICT_DELTAS if c in deltas}
    if "EoC_dchgR_10s" in rows.columns:
        more["EoC_dchgR_10s_growth_50"] = trajectory.rolling_slope("EoC_dchgR_10s", 50, keys)
    if "cycle_duration_h" in rows.columns:
        more["CI_per_hour"] = F.when(F.col("cycle_duration_h") > 0, (100 - F.col("CE")) / F.col("cycle_duration_h"))
    return out.withColumns(more).drop("_taken")


def feature_rows(samples: DataFrame, setting: Setting = Setting(), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """The whole wide table of samples: cycle rows, pulse blocks, trajectories and the protocol's kinds."""
    # Written once: kinds, legs, rests, steps, quality and pulses each read the samples, whose windows would be taken anew.
    samples = cut(samples, "samples")
    steps = protocol.steps_of(segment.with_kind(samples, setting.rest_max), order)
    flags = protocol.protocol_flags(protocol.cycle_steps(steps), setting.routine_steps)
    tests = segment.consecutive_blocks(flags.where("rpt"), min_len=2)
    rows = cut(cycle_rows(samples, setting, order), "cycle_rows")
    rows = dcir.enrich(rows, samples, tests, setting.rest_max, setting.pulse, setting.delta_i, order)
    # Written, as every later table reads it.
    return cut(protocol.attach_protocol(with_trajectories(rows, setting.baseline_cycle), protocol.protocol_kinds(flags)), "features")
