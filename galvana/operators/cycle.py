"""Features of one cycle from its samples, in SQL: capacities, energies, bands, resistances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions.expr import at_most, clip, finite, ratio
from galvana.operators.asof import sample_at
from galvana.operators.segment import continuity_reason, continuous_windows, counter_reason, tagged_windows

LEG = ("cell_id", "cycle", "leg")


def with_steps(samples: DataFrame, q: str, v: str, keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Add ``dq`` and ``v_mid``: each sample's step from the one before; null at a segment's start."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return samples.withColumns({"dq": F.col(q) - F.lag(q).over(w), "v_mid": (F.col(v) + F.lag(v).over(w)) / 2})


def leg_energy(samples: DataFrame, q: str = "capacity", v: str = "voltage", keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``dq_total, energy, v_avg``: trapezoids of V over Q and their capacity-weighted mean."""
    found = with_steps(samples, q, v, keys, order).groupBy(*keys).agg(F.sum("dq").alias("dq_total"), F.sum(F.col("v_mid") * F.col("dq")).alias("energy"))
    return found.withColumn("v_avg", ratio("energy", "dq_total"))


def band_capacity(samples: DataFrame, q: str = "capacity", v: str = "voltage", low: float = 3.0, high: float = 3.5, keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Capacity taken above ``high``, below ``low`` and between, by mid voltage, and the shares."""
    step = F.abs("dq")
    found = (
        with_steps(samples, q, v, keys, order)
        .groupBy(*keys)
        .agg(
            F.sum(F.when(F.col("v_mid") > high, step).otherwise(0.0)).alias("q_high"),
            F.sum(F.when(F.col("v_mid") < low, step).otherwise(0.0)).alias("q_low"),
            F.sum(F.when(F.col("v_mid").between(low, high), step).otherwise(0.0)).alias("q_mid"),
        )
    )
    total = F.col("q_high") + F.col("q_low") + F.col("q_mid")
    return found.select(*keys, "q_high", "q_low", "q_mid", ratio("q_high", total).alias("q_high_frac"), ratio("q_low", total).alias("q_low_frac"))


def ir_drop(samples: DataFrame, v: str = "voltage", n_points: int = 5, keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``ir_drop``: voltage change over the first points; null in segments of fewer."""
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = samples.withColumn("_p", F.row_number().over(w) - 1)
    found = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.when(F.col("_p") == 0, F.col(v))).alias("a"), F.max_by(F.when(F.col("_p") <= n_points, F.col(v)), F.when(F.col("_p") <= n_points, F.col("_p"))).alias("b"))
    return found.select(*keys, F.when(F.col("n") >= n_points, F.abs(F.col("b") - F.col("a"))).alias("ir_drop"))


def observed_legs(samples: DataFrame, q: str = "capacity", v: str = "voltage", keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``capacity_observed, energy_observed, v_avg_observed``: null where the clock or counter is not sound."""
    values = leg_energy(samples, q, v, keys, order)
    clock = continuity_reason(samples, keys, order).select(*keys, F.col("reason").alias("clock_reason"))
    counter = counter_reason(samples, q, v, keys, order).select(*keys, F.col("reason").alias("counter_reason"))
    joined = values.join(clock, list(keys)).join(counter, list(keys))
    sound = F.col("clock_reason").isNull() & F.col("counter_reason").isNull()
    keep = lambda c: F.when(sound, F.col(c))
    return joined.select(*keys, "clock_reason", "counter_reason", keep("dq_total").alias("capacity_observed"), keep("energy").alias("energy_observed"), keep("v_avg").alias("v_avg_observed"))


def landmark_resistance(samples: DataFrame, offsets: Sequence[float] = (0.1, 10.0, 30.0, 60.0), keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``offset, r_mohm``: voltage change since the loaded leg's first sample over the current then, in milliohm."""
    w = Window.partitionBy(*keys).orderBy(*order)
    timed = samples.withColumn("_t", F.col("time") - F.first("time").over(w)).withColumn("_v0", F.first("voltage").over(w))
    start = timed.groupBy(*keys).agg(F.min("_v0").alias("v0"))
    at = sample_at(timed, "_t", ["voltage", "current"], offsets, keys)
    r = F.abs(F.col("v0") - F.col("voltage")) * 1000
    return at.join(start, list(keys)).select(*keys, "offset", ratio(r, F.abs("current")).alias("r_mohm"))


def counter_capacity(q: Column | str, fell: Column) -> Column:
    """Aggregate: a leg's largest count; null for a NaN, a negative or any fall."""
    c = F.col(q) if isinstance(q, str) else q
    bad = F.bool_or(c.isNull() | F.isnan(c) | (c < 0)) | F.coalesce(F.bool_or(fell), F.lit(False))
    return F.when(~bad, F.max(c))


def leg_features(samples: DataFrame, q: str = "capacity", keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """One row for each leg: points, capacity, voltages, duration, mean current."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = samples.withColumns({"_fell": F.col(q) < F.lag(q).over(w), "_p": F.row_number().over(w)})
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_points"),
        counter_capacity(q, F.col("_fell")).alias("capacity"),
        F.min_by("voltage", "_p").alias("v_start"),
        F.max_by("voltage", "_p").alias("v_end"),
        F.min("voltage").alias("v_min"),
        F.max("voltage").alias("v_max"),
        (F.max("time") - F.min("time")).alias("duration_s"),
        F.avg("current").alias("i_mean"),
        F.max_by("current", "_p").alias("i_end"),
    )


def efficiencies(legs: DataFrame) -> DataFrame:
    """``CE, EE, VE, dE, CI_per_hour`` of each cycle from its legs' capacity, energy, v_avg and duration."""
    pick = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    names = ("capacity", "energy", "v_avg")
    wide = legs.groupBy("cell_id", "cycle").agg(
        *(pick(leg, c).alias(f"{p}_{c}") for leg, p in (("charge", "c"), ("discharge", "d")) for c in names), F.sum("duration_s").alias("seconds")
    )
    ce = ratio("d_capacity", "c_capacity") * 100
    hours = F.col("seconds") / 3600
    # A zero energy or voltage counts as missing.
    some = lambda a, b, e: F.when((F.col(a) != 0) & (F.col(b) != 0), e)
    return wide.select(
        "cell_id",
        "cycle",
        ce.alias("CE"),
        some("c_energy", "d_energy", ratio("d_energy", "c_energy")).alias("EE"),
        some("c_v_avg", "d_v_avg", ratio("d_v_avg", "c_v_avg")).alias("VE"),
        some("c_energy", "d_energy", F.col("c_energy") - F.col("d_energy")).alias("dE"),
        ratio(100 - ce, hours).alias("CI_per_hour"),
    )


def quality(samples: DataFrame, v_low: float = 2.5, v_high: float = 4.2, keys: Sequence[str] = ("cell_id", "cycle"), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``samples_per_mv, quant_step, completeness, quality_score``: a geometric mean of clipped ratios, 0 if one is 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.nullif(F.abs(F.col("voltage") - F.lag("voltage").over(w)), F.lit(0.0))
    found = samples.withColumn("_step", step).groupBy(*keys).agg(F.count("*").alias("n"), F.min("voltage").alias("lo"), F.max("voltage").alias("hi"), F.min("_step").alias("quant_step"))
    span = F.col("hi") - F.col("lo")
    found = found.select(*keys, "quant_step", ratio("n", span * 1000).alias("samples_per_mv"), at_most(span / (v_high - v_low), 1.0).alias("completeness"))
    a, b = at_most(F.col("samples_per_mv"), 1.0), F.col("completeness")
    return found.withColumn("quality_score", F.when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(F.exp(0.4 * F.ln(a) + 0.6 * F.ln(b))))


def noise_sigma(samples: DataFrame, v: str = "voltage", window: int = 50, keys: Sequence[str] = ("cell_id", "cycle"), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``noise_sigma``: root mean square distance of samples from straight lines through windows that overlap by half.

    A line's residuals sum to 0, so the squares of all windows add up from each
    window's aggregates. Only whole windows before the last sample count; segments
    of fewer than two windows have none.
    """
    w = Window.partitionBy(*keys)
    half = window // 2
    usable = F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = samples.where(usable).withColumns({"_p": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    # Sample p is in the windows that start at half * k, k from ceil((p - window + 1) / half) to p // half.
    first = F.greatest(F.lit(0), F.ceil((F.col("_p") - window + 1) / half)).cast("int")
    last = F.least(F.floor(F.col("_p") / half), F.ceil((F.col("_n") - window) / half) - 1).cast("int")
    placed = rows.where((F.col("_n") >= 2 * window) & (first <= last)).withColumn("_k", F.explode(F.sequence(first, last)))
    lines = placed.groupBy(*keys, "_k").agg(F.count("*").alias("n"), F.regr_syy(v, "_p").alias("yy"), F.regr_sxy(v, "_p").alias("xy"), F.regr_sxx(v, "_p").alias("xx"))
    found = lines.groupBy(*keys).agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")) / F.sum("n"))).alias("noise_sigma"))
    return samples.select(*keys).distinct().join(found, list(keys), "left")


#: Target and weight of each quality metric.
QUALITY_TARGETS = {"samples_per_mV": (0.5, 0.25), "dqdv_snr": (10.0, 0.25), "leg_completeness": (0.9, 0.2), "rest_sufficiency": (3.0, 0.15), "pulse_stability": (1.0, 0.15)}


def quality_metrics(
    samples: DataFrame, v_window: tuple[float, float] = (2.5, 4.2), rest_max: float = 0.5, tau_s: float | None = None, pulse_current: float | None = None,
    keys: Sequence[str] = ("cell_id", "cycle"), order: Sequence[str] = ("row_id",),
) -> DataFrame:
    """Every quality metric of a cycle, their score and what failed.

    Pulse metrics need a pulse current and a step clock, rest sufficiency a measured
    relaxation time. The score is the weighted geometric mean of what is known over
    its target (at most 1); status is failed where one misses its target, partial
    where some are unknown, assessed where none is, unknown without any.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    v = finite("voltage")
    sound = samples.withColumn("_v", v).where("_v is not null").withColumn("_step", F.nullif(F.abs(F.col("_v") - F.lag("_v").over(w)), F.lit(0.0)))
    found = samples.select(*keys).distinct()
    spans = sound.groupBy(*keys).agg(F.count("*").alias("_n"), (F.max("_v") - F.min("_v")).alias("_span"), F.min("_step").alias("quant_step_est"))
    found = found.join(spans, list(keys), "left").join(noise_sigma(samples, "voltage", 50, keys, order).withColumnRenamed("noise_sigma", "v_noise_sigma"), list(keys), "left")
    if "temperature" in samples.columns:
        warm = samples.groupBy(*keys).agg((F.count(finite("temperature")) > 0).alias("temperature_available"))
        found = found.join(warm, list(keys), "left")
    else:
        found = found.withColumn("temperature_available", F.lit(False))
    step = "step_no" if "step_no" in samples.columns else None
    size = F.abs("current")
    found = found.withColumns({c: F.lit(None).cast("double") for c in ("pulse_sample_count_1s", "pulse_current_stability", "rest_sufficiency")})
    if "step_time" in samples.columns and pulse_current is not None:
        rows = tagged_windows(samples, finite(size) >= pulse_current, keys, order, "step_time", step)
        rows = rows.where("window_id = 1").withColumn("_t", F.col("step_time") - F.min("step_time").over(Window.partitionBy(*keys)))
        pulse = rows.groupBy(*keys).agg(
            F.sum((F.col("_t") <= 1).cast("double")).alias("pulse_sample_count_1s"), F.when(F.count("*") > 1, ratio(F.stddev_pop(size), F.median(size))).alias("pulse_current_stability")
        )
        found = found.drop("pulse_sample_count_1s", "pulse_current_stability").join(pulse, list(keys), "left")
    if "step_time" in samples.columns and tau_s:
        rests = continuous_windows(samples, finite(size) <= rest_max, keys, order, "step_time", step)
        longest = rests.groupBy(*keys).agg((F.max(F.col("last_time") - F.col("first_time")) / tau_s).alias("rest_sufficiency"))
        found = found.drop("rest_sufficiency").join(longest, list(keys), "left")
    known = F.col("_n") >= 2
    found = found.withColumns({
        "samples_per_mV": F.when(known & (F.col("_span") * 1000 > 1e-6), F.col("_n") / (F.col("_span") * 1000)),
        "leg_completeness": at_most(F.col("_span") / max(v_window[1] - v_window[0], 1e-9), 1.0),
        "dqdv_snr": ratio("_span", "v_noise_sigma"),
        "pulse_threshold_a": F.lit(pulse_current).cast("double"),
        "pulse_threshold_source": F.lit("unconfigured" if pulse_current is None else "explicit_A"),
    })
    values = {name: F.col(name) for name in QUALITY_TARGETS if name != "pulse_stability"} | {"pulse_stability": F.greatest(F.lit(0.0), 1 - F.col("pulse_current_stability") / 0.02)}
    values["pulse_stability"] = F.when(F.col("pulse_current_stability").isNotNull(), values["pulse_stability"])
    weight, logs, zero = F.lit(0.0), F.lit(0.0), F.lit(False)
    failed = []
    for name, (target, share) in QUALITY_TARGETS.items():
        part = clip(values[name] / target, 0.0, 1.0)
        weight = weight + F.when(part.isNotNull(), share).otherwise(0.0)
        logs = logs + F.when(part > 0, F.ln(part) * share).otherwise(0.0)
        zero = zero | F.coalesce(part <= 0, F.lit(False))
        failed.append(F.when(part < 1, F.lit(name)))
    found = found.withColumns({"_w": weight, "_l": logs, "_z": zero, "_f": F.array_compact(F.array(*failed))})
    some = F.col("_w") > 0
    status = F.when(F.size("_f") > 0, "failed").when(some & (F.col("_w") < 1 - 1e-9), "partial").when(some, "assessed").otherwise("unknown")
    return found.withColumns({
        "quality_score": F.when(some, F.when(F.col("_z"), 0.0).otherwise(F.exp(F.col("_l") / F.col("_w")))),
        "quality_evidence_coverage": F.col("_w"),
        "quality_status": status,
        "quality_gate_failed_groups": F.array_join("_f", ","),
    }).drop("_n", "_span", "_w", "_l", "_z", "_f")


def _in_ah(c: Column) -> Column:
    """Step-end capacities in Ah: large numbers are mAh, none at all is unknown."""
    x = finite(c)
    return F.when(F.abs(x) >= 1e-12, F.when(F.abs(x) > 200, x / 1000).otherwise(x))


def step_cycle_rows(steps: DataFrame, keys: Sequence[str] = ("cell_id", "cycle")) -> DataFrame:
    """The cycle row of step ends: cutoffs, capacities, times, impedances, rests and what follows from them.

    A leg's row is that of its largest capacity (without any, its last); the rest
    after it is the first rest of a higher step number.
    """
    have = set(steps.columns)
    pick = lambda *names: F.coalesce(*(finite(c) for c in names if c in have), F.lit(None).cast("double"))
    order = F.col("step_no") if "step_no" in have else F.col("row_id")
    fields = {"V": pick("voltage"), "I": pick("current"), "AvgV": pick("AvgVoltage", "voltage") if "AvgVoltage" in have else F.lit(None).cast("double"), "Z": pick("Impedance"), "T": pick("temperature"), "s": pick("step_time_s"), "no": order}
    legs = {"chg": ("charge", pick("charge_capacity", "capacity")), "dchg": ("discharge", pick("discharge_capacity", "capacity"))}
    rows = steps.withColumns({"_no": order})
    primary = rows.groupBy(*keys).agg(
        *(F.max(F.when(F.col("step_type") == leg, F.struct(q.isNotNull().alias("known"), q.alias("q"), F.when(q.isNull(), order).alias("last"), (-order).alias("first"), *(x.alias(c) for c, x in fields.items())))).alias(f"_{p}") for p, (leg, q) in legs.items()),
        F.count("*").alias("n_steps"),
    )
    rests = rows.where("step_type = 'rest'").select(*keys, "_no", pick("voltage").alias("_v"), pick("step_time_s").alias("_s")).join(primary.select(*keys, F.col("_chg.no").alias("_c"), F.col("_dchg.no").alias("_d")), list(keys))
    after = rests.groupBy(*keys).agg(*(F.min(F.when(F.col("_no") > F.col(at), F.struct("_no", "_v", "_s"))).alias(f"_after_{p}") for p, at in (("chg", "_c"), ("dchg", "_d"))))
    found = primary.where("_chg is not null or _dchg is not null").join(after, list(keys), "left")
    out = {}
    for p, end in (("chg", "EoC"), ("dchg", "EoD")):
        g = lambda c: F.col(f"_{p}.{c}")  # noqa: B023, E731
        v_end = F.col(f"_after_{p}._v")
        out |= {
            f"{p}Capa": _in_ah(g("q")), f"{p}_V_cutoff": g("V"), f"{p}_AvgV": g("AvgV"), f"{p}_step_time_s": g("s"), f"impedance_{p}": g("Z"), f"{p}_temp_avg": g("T"),
            f"{end}_restV_init": v_end if p == "chg" else F.when(F.col(f"_after_{p}").isNotNull(), g("V")), f"{end}_restV_end": v_end, f"{end}_restV_60s": F.lit(None).cast("double"), f"{end}_restV_30m": v_end, f"rest_after_{p}_s": F.col(f"_after_{p}._s"),
        }
    out["chg_I_cutoff"] = F.col("_chg.I")
    found = found.select(*keys, "n_steps", *(x.alias(c) for c, x in out.items()))
    return found.withColumns({
        "CE": F.when(F.col("chgCapa") > 0, ratio("dchgCapa", "chgCapa") * 100),
        "V_hyst_proxy": F.col("chg_AvgV") - F.col("dchg_AvgV"),
        "impedance_ratio": F.when((F.col("impedance_dchg") > 0) & (F.col("impedance_chg") != 0), ratio("impedance_chg", "impedance_dchg")),
        "rest_drop_EoC": F.col("EoC_restV_init") - F.col("EoC_restV_end"),
        "rest_drop_EoD": F.col("EoD_restV_init") - F.col("EoD_restV_end"),
    })


#: Step-end columns with a difference from the baseline.
STEP_DELTAS = ("EoC_restV_30m", "EoC_restV_end", "EoD_restV_30m", "EoD_restV_end", "chgCapa", "dchgCapa")


def step_deltas(table: DataFrame, baseline_cycle: int | None = None, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Add ``delta_*``, SoHQ and CE_rev to step-end rows; without a baseline cycle the first of over 1 Ah counts, else the first."""
    w = Window.partitionBy(*keys)
    wanted = F.col("cycle") == baseline_cycle if baseline_cycle is not None else F.coalesce(F.col("dchgCapa") > 1.0, F.lit(False))
    base = F.min(F.struct((~wanted).alias("other"), "cycle", *STEP_DELTAS)).over(w)
    rows = table.withColumn("_base", base)
    rows = rows.withColumns({f"delta_{c}": F.col(c) - F.col(f"_base.{c}") for c in STEP_DELTAS})
    rows = rows.withColumns({
        "SoHQ": F.when(F.col("_base.dchgCapa") > 0, F.col("dchgCapa") / F.col("_base.dchgCapa") * 100),
        "CE_rev": F.when(F.col("dchgCapa") > 0, F.lead("chgCapa").over(w.orderBy("cycle")) / F.col("dchgCapa") * 100),
    })
    return rows.drop("_base")


def step_features(steps: DataFrame, keys: Sequence[str] = ("cell_id", "cycle")) -> DataFrame:
    """``chgCapa, dchgCapa, n_steps`` from step-end rows: each leg's primary row is that of the largest capacity."""
    pick = lambda leg: F.max(F.when(F.col("step_type") == leg, F.col("capacity")))
    return steps.groupBy(*keys).agg(pick("charge").alias("chgCapa"), pick("discharge").alias("dchgCapa"), F.count("*").alias("n_steps"))
