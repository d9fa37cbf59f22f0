"""Features of whole curves: one grouped function for each leg, cycle or cell.

A group holds one curve's samples, which the cycler bounds; Spark spreads and
sorts the groups. All columns in and out are doubles or arrays of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions import kernels, pulse, shapes, turns
from galvana.operators.cycle import LEG

#: Voltage bands of peaks.
CHARGE_BANDS = ((3.48, 3.62, "P1_low"), (3.6, 3.78, "P2_shoulder"), (3.78, 3.94, "P3_main"), (3.94, 4.12, "P4_high"))
DISCHARGE_BANDS = ((3.05, 3.28, "P1_low"), (3.55, 3.78, "P2_mid"), (3.82, 4.0, "P3_high"))


#: Result rows that leave a task at once.
ROWS_OUT = 256


def _starts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Places where other keys begin; nulls are equal."""
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        now, before = pdf[k].iloc[1:], pdf[k].iloc[:-1]
        null, was_null = now.isna().to_numpy(), before.isna().to_numpy()
        new[1:] |= (null != was_null) | ~null & ~was_null & (now.to_numpy() != before.to_numpy())
    return np.flatnonzero(new)


def _grouped(samples: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str], schema: str, f) -> DataFrame:
    """``f(group)`` gives a dict of one row or a list of dicts; keys and types come from the samples.

    Rows are dealt by the keys and sorted by Spark; a task streams through its groups and
    passes many groups' results on at once, so wide results cost no batch for each group.
    """
    types = dict(samples.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    names = [*keys, *(x.split()[0] for x in schema.split(", "))]

    read = list(dict.fromkeys([*keys, *columns]))

    def result(pieces: list[dict[str, np.ndarray]]) -> list[dict]:
        g = pieces[0] if len(pieces) == 1 else {c: np.concatenate([p[c] for p in pieces]) for c in read}
        rows = f({c: g[c] for c in columns})
        own = {k: g[k][0] for k in keys}
        return [own | r for r in (rows if isinstance(rows, list) else [rows])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_group: list[dict[str, np.ndarray]] = []
        last = None
        out: list[dict] = []
        for pdf in parts:
            if not len(pdf):
                continue
            starts = _starts(pdf, keys)
            # Groups are slices of a batch's arrays; a frame for each would cost more than many a small curve.
            batch = {c: pdf[c].to_numpy() for c in read}
            if open_group:
                edge = pd.concat([last, pdf.iloc[:1]], ignore_index=True)
                if len(_starts(edge, keys)) == 2:
                    out += result(open_group)
                    open_group = []
            last = pdf.iloc[-1:]
            for a, z in zip(starts, [*starts[1:], None], strict=True):
                open_group = [*open_group, {c: x[a:z] for c, x in batch.items()}]
                if z is not None:
                    out += result(open_group)
                    open_group = []
                if len(out) >= ROWS_OUT:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if open_group:
            out += result(open_group)
        if out:
            yield pd.DataFrame(out, columns=names)

    chosen = samples.select(*dict.fromkeys([*keys, *order, *columns]))
    dealt = chosen.repartition(*keys).sortWithinPartitions(*keys, *(F.asc_nulls_last(c) for c in order if c not in keys))
    return dealt.mapInPandas(run, f"{head}, {schema}")


def derivative_curves(samples: DataFrame, n: int = 500, keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``v, dqdv``: the differential capacity of each leg as two arrays."""

    def f(g):
        v, y = kernels.derivative(g["voltage"], g["capacity"], n=n)
        return {"v": v.tolist(), "dqdv": y.tolist()}

    return _grouped(samples, keys, ["voltage", "capacity"], order, "v array<double>, dqdv array<double>", f)


def peak_table(samples: DataFrame, bands: dict[str, Sequence[tuple[float, float, str]]] | None = None, keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``band, V, H, share, confidence``: the banded peaks of each leg, with signed heights; ``leg`` must be a key."""
    use = bands or {"charge": CHARGE_BANDS, "discharge": DISCHARGE_BANDS}

    def f(g):
        v, y = kernels.derivative(g["voltage"], g["capacity"], window=31)
        return [dict(zip(("band", "V", "H", "share", "confidence"), p, strict=True)) for p in kernels.band_peaks(v, y, use.get(g["leg"][0], ()))]

    return _grouped(samples, keys, ["leg", "voltage", "capacity"], order, "band string, V double, H double, share double, confidence double", f)


def robust_peak_table(samples: DataFrame, most: int = 8, keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``peak, V, H``: up to ``most`` peaks of dQ/dV in order of voltage."""

    def f(g):
        v, y = kernels.derivative(g["voltage"], g["capacity"])
        return [{"peak": k, "V": a, "H": b} for k, (a, b) in enumerate(kernels.robust_peaks(v, y, most), 1)]

    return _grouped(samples, keys, ["voltage", "capacity"], order, "peak int, V double, H double", f)


def best_cycle(samples: DataFrame, keys: Sequence[str] = ("cell_id", "leg"), order: Sequence[str] = ("row_id",), least: int = 20) -> DataFrame:
    """``best_cycle``: of each leg's cycles the one whose dQ/dV spans most volts (and of near ones, most points)."""
    curve = derivative_curves(samples, 500, [*keys, "cycle"], order).where(F.size("v") >= least)
    score = (F.array_max("v") - F.array_min("v")) * 1000 + F.least(F.size("v"), F.lit(500)) * 0.1
    return curve.groupBy(*keys).agg(F.max_by("cycle", F.struct(score, -F.col("cycle"))).alias("best_cycle"))


def stitched_sweeps(samples: DataFrame, keys: Sequence[str], run_keys: Sequence[str] = ("cycle", "capacity_run"), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``v, q``: one sweep of voltage from a block's counter runs, as two arrays; ``leg`` must be a key.

    Runs are what ``segment.capacity_runs`` marks within each cycle. Where no run is
    long enough to stitch, the widest single one stands for the block. A group is a
    block's samples of one leg, which the cycler bounds.
    """

    def f(g):
        runs, ok = {}, np.isfinite(g["voltage"]) & np.isfinite(g["capacity"])
        for k in np.flatnonzero(ok):
            runs.setdefault(tuple(g[c][k] for c in run_keys), []).append(k)
        parts = [(g["voltage"][k], g["capacity"][k]) for _, k in sorted(runs.items())]
        v, q = kernels.stitch(parts, g["leg"][0] == "discharge")
        if not len(v) and parts:
            v, q = max(parts, key=lambda p: 1000 * np.ptp(p[0]) + 0.1 * min(len(p[0]), 500))
        return {"v": list(map(float, v)), "q": list(map(float, q))}

    return _grouped(samples, keys, ["leg", "voltage", "capacity", *run_keys], order, "v array<double>, q array<double>", f)


def charge_peak_table(samples: DataFrame, most: int = 8, keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``peak, Q, H``: up to ``most`` peaks of dV/dQ in order of capacity."""

    def f(g):
        q, y = kernels.inverse_derivative(g["capacity"], g["voltage"])
        return [{"peak": k, "Q": a, "H": b} for k, (a, b) in enumerate(kernels.robust_peaks(q, y, most, None), 1)]

    return _grouped(samples, keys, ["voltage", "capacity"], order, "peak int, Q double, H double", f)


_SHAPES = ", ".join(
    [*(f"chg_{c} double" for c in (*shapes.COMMON, *shapes.CHARGE)), *(f"dchg_{c} double" for c in (*shapes.COMMON, *shapes.DISCHARGE)), "dchg_cliff_valid boolean"]
    + [*(f"{c} double" for c in shapes.HYSTERESIS), "hyst_reason string"]
)


def shape_features(samples: DataFrame, keys: Sequence[str] = ("cell_id", "cycle"), order: Sequence[str] = ("row_id",), peaks: bool = True) -> DataFrame:
    """Every curve feature of a cycle: peaks, plateaus, dV/dQ at states of charge, cliffs, and the gap between its legs.

    One group function takes each leg's differential curves once. A leg that is
    missing, or whose counter can't be used, leaves its features unknown.
    """

    def f(g):
        legs = {leg: (g["capacity"][m].astype(float), g["voltage"][m].astype(float)) for leg in ("charge", "discharge") for m in [g["leg"] == leg]}
        out: dict = {}
        for prefix, leg in (("chg", "charge"), ("dchg", "discharge")):
            out |= {f"{prefix}_{c}": x for c, x in shapes.leg_shape(*legs[leg], leg == "discharge", peaks=peaks).items()}
        found, reason = shapes.hysteresis(*legs["charge"], *legs["discharge"])
        return out | found | {"hyst_reason": reason}

    return _grouped(samples, keys, ["leg", "voltage", "capacity"], order, _SHAPES, f)


def peak_features(samples: DataFrame, keys: Sequence[str] = ("cell_id", "cycle"), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """The peak columns of both legs of a cycle, from samples that are prepared for derivatives."""

    def f(g):
        out: dict = {}
        for prefix, leg in (("chg", "charge"), ("dchg", "discharge")):
            m = g["leg"] == leg
            out |= {f"{prefix}_{c}": x for c, x in shapes.leg_peaks(g["capacity"][m].astype(float), g["voltage"][m].astype(float)).items()}
        return out

    names = [c for c in shapes.COMMON if "_peak" in c]
    return _grouped(samples, keys, ["leg", "voltage", "capacity"], order, ", ".join(f"{p}_{c} double" for p in ("chg", "dchg") for c in names), f)


def hysteresis(samples: DataFrame, n: int = 500, keys: Sequence[str] = ("cell_id", "cycle"), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``hyst_*``: areas and largest gaps between charge and discharge over the charge's share, in bands, and the reason where unknown."""

    def f(g):
        legs = [g[c][g["leg"] == leg].astype(float) for leg in ("charge", "discharge") for c in ("capacity", "voltage")]
        found, reason = shapes.hysteresis(*legs, n)
        return found | {"hyst_reason": reason}

    schema = ", ".join(f"{c} double" for c in shapes.HYSTERESIS) + ", hyst_reason string"
    return _grouped(samples, keys, ["leg", "voltage", "capacity"], order, schema, f)


def normalised_curves(samples: DataFrame, n: int = 128, keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``curve``: voltage at n points of normalised capacity."""

    def f(g):
        return {"curve": kernels.resample(g["capacity"], g["voltage"], n)[1].tolist()}

    return _grouped(samples, keys, ["voltage", "capacity"], order, "curve array<double>", f)


def shape_distance(curves: DataFrame, baseline_cycle: int = 1, keys: Sequence[str] = ("cell_id", "leg")) -> DataFrame:
    """``distance``: warped distance of each cycle's curve from its cell's baseline curve; null where that has none."""
    base = curves.where(F.col("cycle") == baseline_cycle).select(*keys, F.col("curve").alias("base"))

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.full(len(a), np.nan))
        sizes: dict[tuple[int, int], list[int]] = {}
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            if x is not None and y is not None and len(x) and len(y):
                sizes.setdefault((len(x), len(y)), []).append(k)
        for rows in sizes.values():
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                out.iloc[some] = kernels.warped_distances(np.stack([np.asarray(a.iloc[k], float) for k in some]), np.stack([np.asarray(b.iloc[k], float) for k in some]))
        return out

    joined = curves.join(base, list(keys), "left")
    d = distance("curve", "base")
    return joined.select(*keys, "cycle", d.alias("d")).select(*keys, "cycle", F.when(~F.isnan("d"), F.col("d")).alias("distance"))


def pulse_parameters(pulses: DataFrame, keys: Sequence[str], order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Ohmic, charge transfer and diffusion parts of each pulse (t, r_mohm), with a validity flag and what went wrong."""

    def f(g):
        return pulse.components(g["t"].astype(float), g["r_mohm"].astype(float))

    schema = ", ".join(f"{c} double" for c in pulse.PARAMETERS) + ", dcir_fit_valid boolean, flag string"
    return _grouped(pulses, keys, ["t", "r_mohm"], order, schema, f)


def rest_leaks(rests: DataFrame, keys: Sequence[str], order: Sequence[str] = ("row_id",), late: tuple[float, float] = (1800.0, 3600.0)) -> DataFrame:
    """Self-discharge of each long rest (time in seconds, voltage), and whether its parameters can be told apart."""
    schema = ", ".join(f"{c} double" for c in pulse.LEAK) + ", sd_fit_valid boolean, sd_method string, sd_identifiable boolean, sd_tau2_ok boolean"
    return _grouped(rests, keys, ["time", "voltage"], order, schema, lambda g: pulse.leak((g["time"] - g["time"][0]).astype(float), g["voltage"].astype(float), late))


def constant_voltage(charges: DataFrame, keys: Sequence[str] = ("cell_id", "cycle"), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Charge at constant current and at constant voltage of each charge leg, by its signals."""
    clock = "step_time" if "step_time" in charges.columns else "time"
    counted = [c for c in ("charge_cv_capacity",) if c in charges.columns]

    def f(g):
        own = [g[c].astype(float) for c in ("voltage", "current", clock, "capacity")]
        most = float(np.nanmax(g[counted[0]].astype(float))) if counted and np.isfinite(g[counted[0]].astype(float)).any() else np.nan
        return pulse.constant_voltage(*own, most)

    schema = ", ".join(f"{c} double" for c in pulse.CV) + ", cv_detect_method string, has_cv boolean"
    return _grouped(charges, keys, ["voltage", "current", clock, "capacity", *counted], order, schema, f)


def pulse_cycle_fits(samples: DataFrame, rest_max: float = 0.5, expected: float = 70.0, keys: Sequence[str] = ("cell_id", "cycle"), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Each pulse cycle's resistance parts, its recovery and the self-discharge of the rest before it; a flag where there is no fit."""
    clock = "step_time" if "step_time" in samples.columns else "time"

    def f(g):
        t, v, i = (g[c].astype(float) for c in (clock, "voltage", "current"))
        found, flag = pulse.trace(t - (0.0 if clock == "step_time" else t[0]), v, i, rest_max, expected=expected)
        out: dict = dict.fromkeys(pulse.PARAMETERS, np.nan) | {"dcir_fit_valid": False, "flag": flag} | dict.fromkeys(pulse.RECOVERY, np.nan) | {"tau_consistency_flag": None}
        if found:
            r = np.abs(found["v0"] - found["v"]) / max(abs(found["current"]), 1e-9) * 1000
            out |= pulse.components(found["t"], r, found["i"]) | {"pulse_current_A": abs(found["current"])}
            loaded = np.flatnonzero(np.abs(i) > rest_max)
            after = np.flatnonzero((np.arange(len(i)) > loaded[-1]) & (np.abs(i) <= rest_max))
            if len(after) > 20:
                own = t[after] - t[after[0]]
                near = own <= 1800
                out |= pulse.recovery(own[near], v[after][near], out["tau_ct"])
        rest = pulse.rest_before(t, v, i, rest_max, expected=expected)
        idle = dict.fromkeys(pulse.LEAK, np.nan) | {"sd_fit_valid": False, "sd_method": "no_rest", "sd_identifiable": None, "sd_tau2_ok": None}
        return out | (pulse.leak(*rest) if rest else idle)

    names = (*pulse.PARAMETERS, *pulse.RECOVERY, *pulse.LEAK)
    schema = ", ".join(f"{c} double" for c in names) + ", dcir_fit_valid boolean, flag string, tau_consistency_flag boolean, sd_fit_valid boolean, sd_method string, sd_identifiable boolean, sd_tau2_ok boolean"
    return _grouped(samples, keys, [clock, "voltage", "current"], order, schema, f)


def recoveries(rests: DataFrame, keys: Sequence[str], order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Two relaxations of each rest after a pulse (time, voltage)."""
    schema = ", ".join(f"{c} double" for c in pulse.RECOVERY) + ", tau_consistency_flag boolean"
    return _grouped(rests, keys, ["time", "voltage"], order, schema, lambda g: pulse.recovery((g["time"] - g["time"][0]).astype(float), g["voltage"].astype(float)))


def inflections(table: DataFrame, health: str = "SoHQ", breaks: int = 2, least: int = 10, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """``n_breaks, break1, break2, sse``: each cell's piecewise line; a further break must cut the squares by 8 %."""

    def f(g):
        ok = np.isfinite(g["cycle"].astype(float)) & np.isfinite(g[health].astype(float))
        x, y = g["cycle"][ok].astype(float), g[health][ok].astype(float)
        found = kernels.break_points(x, y, 0, least) if len(x) else ([], np.nan)
        for b in range(1, breaks + 1):
            if len(x) >= (b + 1) * least:
                more = kernels.break_points(x, y, b, least)
                if more[1] < 0.92 * found[1]:
                    found = more
        at = [*found[0], np.nan, np.nan]
        return {"n_breaks": len(found[0]), "break1": at[0], "break2": at[1], "sse": found[1]}

    return _grouped(table, keys, ["cycle", health], ["cycle"], "n_breaks int, break1 double, break2 double, sse double", f)


def turning_points(table: DataFrame, health: str = "SoHQ", breaks: int = 2, least: int = 40, method: str = "hybrid", window: int | None = None, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """``cycle, health, fade_before, fade_after, delta_fade, curvature, regime, n_points, slope``: where each cell's series turns, and the regime that ends there.

    The series is smoothed by a window that follows its length. The last regime of a
    cell is a row without a turn (``cycle`` is its last, fades and curvature null). Fades are
    per 100 cycles over ``least`` points. A series shorter than two segments or 40 points has no rows.
    """

    def f(g):
        ok = np.isfinite(g["cycle"].astype(float)) & np.isfinite(g[health].astype(float))
        x, y = g["cycle"][ok].astype(float), g[health][ok].astype(float)
        found = turns.turns(x, y, breaks, least, method, window)
        if found is None:
            return []
        even, n, rows = found["even"], len(x), []
        for k, (a, b) in enumerate(zip([0, *found["places"]], [*found["places"], n - 1], strict=True), 1):
            turn = {"fade_before": turns.slope(x[max(0, b - least) : b], even[max(0, b - least) : b]), "fade_after": turns.slope(x[b : b + least], even[b : b + least])} if b < n - 1 else {}
            if turn:
                turn |= {"delta_fade": turn["fade_after"] - turn["fade_before"], "curvature": float(found["curvature"][b])}
            rows.append({"cycle": x[b], "health": float(even[b]), "regime": k, "n_points": b - a + 1, "slope": turns.slope(x[a : b + 1], even[a : b + 1])} | turn)
        return rows

    schema = "cycle double, health double, fade_before double, fade_after double, delta_fade double, curvature double, regime int, n_points int, slope double"
    return _grouped(table, keys, ["cycle", health], ["cycle"], schema, f).dropna(subset=["regime"])


def noise_curves(samples: DataFrame, keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",), n: int = 500, window: int = 21) -> DataFrame:
    """``v, dqdv, dvdq``: both derivatives of a leg on one grid of charge, by differences of the smoothed curve."""

    def f(g):
        q, v = np.abs(g["capacity"].astype(float) - g["capacity"][0]), g["voltage"].astype(float)
        at, first = np.unique(np.round(q, 9), return_index=True)
        if len(at) < 2:
            return {"v": [], "dqdv": [], "dvdq": []}
        grid = np.linspace(at[0], at[-1], n)
        volts = np.interp(grid, at, v[first])
        dv, dq = np.gradient(kernels.smooth(volts, window)), np.gradient(kernels.smooth(grid, window))
        with np.errstate(divide="ignore", invalid="ignore"):
            pair = [np.where(np.abs(b) > 1e-9, a / b, np.nan) for a, b in ((dq, dv), (dv, dq))]
        return {"v": volts.tolist()} | {name: _filled(y).tolist() for name, y in zip(("dqdv", "dvdq"), pair, strict=True)}

    return _grouped(samples, keys, ["voltage", "capacity"], order, "v array<double>, dqdv array<double>, dvdq array<double>", f)


def _filled(y: np.ndarray) -> np.ndarray:
    """Unknown values between their neighbours."""
    ok = np.isfinite(y)
    return np.interp(np.arange(len(y)), np.flatnonzero(ok), y[ok]) if ok.any() else y


def noise_uniformity(curves: DataFrame, bins: int = 5, least: int = 10, keys: Sequence[str] = LEG) -> DataFrame:
    """``dqdv_spread, dvdq_spread, n_bins, dvdq_more_uniform`` of each leg's ``noise_curves``.

    Within equal bins of voltage of ten points or more the noise of a derivative is its
    deviation over its mean size; its spread is the deviation of the bins' noise over their mean.
    """
    lo, hi = F.array_min("v"), F.array_max("v")
    rows = curves.where(F.size("v") > 0).select(*keys, lo.alias("_lo"), hi.alias("_hi"), F.explode(F.arrays_zip("v", "dqdv", "dvdq")).alias("_r"))
    # Bins are open below, as the lowest point stands in the first.
    place = F.ceil((F.col("_r.v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins)
    rows = rows.withColumn("_bin", F.greatest(F.lit(1), F.least(F.lit(bins), F.coalesce(place, F.lit(1)))))
    noise = lambda c: F.stddev_pop(f"_r.{c}") / (F.avg(F.abs(f"_r.{c}")) + 1e-12)
    each = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"), noise("dqdv").alias("_a"), noise("dvdq").alias("_b")).where(F.col("_n") >= least)
    spread = lambda c: F.stddev_pop(c) / (F.avg(c) + 1e-12)
    found = each.groupBy(*keys).agg(F.count("*").cast("int").alias("n_bins"), spread("_a").alias("dqdv_spread"), spread("_b").alias("dvdq_spread"))
    return found.withColumn("dvdq_more_uniform", F.when((F.col("dqdv_spread") != 0) & (F.col("dvdq_spread") != 0), F.col("dvdq_spread") < F.col("dqdv_spread")))


def leg_noise(samples: DataFrame, keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``noise_ratio, hf_std, n_peaks, n_points`` of each leg prepared for derivatives; null where the curve is too short."""

    def f(g):
        v, q = g["voltage"].astype(float), g["capacity"].astype(float)
        x, y = kernels.derivative(v, q)
        if len(x) < 5:
            return {"noise_ratio": np.nan, "hf_std": np.nan, "n_peaks": None, "n_points": len(v)}
        even = kernels.smooth(y, 21)
        off, top = np.abs(y - even), float(np.abs(even).max())
        noise = float(np.median(np.abs((y - even) - np.median(y - even))))
        return {"noise_ratio": noise / top if top > 0 else 999.0, "hf_std": float(np.diff(even).std()) if len(off) > 2 else 999.0, "n_peaks": len(kernels.robust_peaks(x, y, 12)), "n_points": len(v)}

    return _grouped(samples, keys, ["voltage", "capacity"], order, "noise_ratio double, hf_std double, n_peaks int, n_points int", f)


def wiggle_widths(samples: DataFrame, lo: float = 3.55, hi: float = 4.05, keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``width_mv, n_inflections``: the span between the first and last peak of the voltage's second difference within a window.

    Of fewer than two peaks the span of all the window's voltages; of fewer than ten samples there, null.
    """

    def f(g):
        v = g["voltage"].astype(float)
        v = v[(v >= lo) & (v <= hi)]
        if len(v) < 10:
            return {"width_mv": np.nan, "n_inflections": None}
        second = np.gradient(np.gradient(v) * 1000)
        at = kernels.peaks(np.abs(second), 0.5 * float(second.std()))
        return {"width_mv": float(abs(v[at[-1]] - v[at[0]]) * 1000) if len(at) >= 2 else float(np.ptp(v) * 1000), "n_inflections": len(at)}

    return _grouped(samples, keys, ["voltage"], order, "width_mv double, n_inflections int", f)


def disappearances(curves: DataFrame, events: DataFrame, merge: float = 0.15, death: float = 0.3, window: int = 3, keys: Sequence[str] = ("cell_id", "leg")) -> DataFrame:
    """``kind, ratio``: whether a track that ends (events: keys, track, cycle, lo, hi) merged into its neighbours or died.

    The ratio is the area over the places lo to hi - 1 of the ``curve`` from the
    event's cycle on to that before it, over at most ``window`` cycles on either
    side (as many as both have). Areas that stay mean merged, a large loss means
    died; no cycles or no area to compare, or anything between, is ambiguous.
    """
    w = Window.partitionBy(*keys)
    rows = curves.select(*keys, "cycle", "curve").withColumns({"_i": F.row_number().over(w.orderBy("cycle")) - 1, "_n": F.count("*").over(w)})
    at = events.join(rows.select(*keys, "cycle", F.col("_i").alias("_at"), "_n"), [*keys, "cycle"])
    at = at.withColumn("_w", F.least(F.lit(window), F.col("_at"), F.col("_n") - F.col("_at") - 1).cast("int")).drop("_n")
    near = at.withColumn("_i", F.explode(F.sequence(F.col("_at") - F.col("_w"), F.col("_at") + F.col("_w"))))
    near = near.join(rows.select(*keys, "_i", "curve"), [*keys, "_i"])
    area = F.aggregate(F.slice("curve", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int")), F.lit(0.0), lambda a, x: a + F.coalesce(F.abs(F.nanvl(x, F.lit(0.0))), F.lit(0.0)))
    sums = near.withColumn("_area", area).groupBy(*keys, "track", "cycle", "_w").agg(
        F.sum(F.when(F.col("_i") < F.col("_at"), F.col("_area"))).alias("_before"), F.sum(F.when(F.col("_i") >= F.col("_at"), F.col("_area"))).alias("_after")
    )
    usable = (F.col("_w") >= 1) & (F.col("_before") > 1e-12)
    r = F.when(usable, F.col("_after") / F.col("_before"))
    kind = F.when(F.abs(r - 1) < merge, "merged").when(r < 1 - death, "died").otherwise("ambiguous")
    return sums.select(*keys, "track", "cycle", kind.alias("kind"), r.alias("ratio"))


def assign_peaks(candidates: DataFrame, references: DataFrame, keys: Sequence[str] = LEG, most: float = 0.12, share: float | None = None) -> DataFrame:
    """Candidates (V, H) of each leg matched one to one with reference peaks (leg, peak_id, V, H, and cell_id where cells have their own).

    The cost is the distance in V and 0.015 of that in the size of H; pairs above ``most`` are
    left out. With a ``share``, candidates' ``proba`` (a map of names) takes that share of its
    probability off the cost, and ``probability, confidence`` are added. A cell's reference peaks
    of a leg are few, so they travel as one row.
    """
    on = [c for c in ("cell_id", "leg") if c in references.columns]
    refs = references.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("peak_id", "V", "H"))).alias("_refs"))
    joined = candidates.join(refs, on).withColumn("_v", F.transform("_refs", lambda x: x["V"]))
    proba = (lambda x: F.coalesce(F.try_element_at("proba", x["peak_id"]), F.lit(0.0))) if share else (lambda x: F.lit(0.0))
    joined = joined.withColumns({"_h": F.transform("_refs", lambda x: x["H"]), "_id": F.transform("_refs", lambda x: x["peak_id"]), "_p": F.transform("_refs", proba)})

    def f(g):
        v, h, ids, p = np.asarray(g["_v"][0], float), np.asarray(g["_h"][0], float), list(g["_id"][0]), np.array([list(x) for x in g["_p"]], float)
        cost = np.abs(g["V"][:, None] - v) + 0.015 * np.abs(np.abs(g["H"])[:, None] - np.abs(h))
        cost = cost * (1 - (share or 0) * p)
        found = [(a, b, float(cost[a, b])) for a, b in kernels.assign(cost, most)]
        rows = [{"peak_id": str(ids[b]), "V": float(g["V"][a]), "H": float(g["H"][a]), "cost": c} for a, b, c in found]
        return [r | {"probability": float(p[a, b]), "confidence": 1 - min(1.0, c / most)} for r, (a, b, c) in zip(rows, found, strict=True)] if share else rows

    schema = "peak_id string, V double, H double, cost double" + (", probability double, confidence double" if share else "")
    return _grouped(joined, keys, ["V", "H", "_v", "_h", "_id", "_p"], ["V"], schema, f).dropna(subset=["peak_id"])
