"""How peaks of dV/dQ move, appear and vanish over a cell's life: maps on a fixed grid, ridges, states and events."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions import kernels, ridges
from galvana.functions.expr import ratio
from galvana.operators.curves import _grouped, disappearances
from galvana.operators.pulses import lifecycle

#: Grid of the charge's share, points and window of the curve, ranges in which ridges are sought apart, cycles that count as the start.
GRID = (0.05, 0.90, 1000)
VOLTAGE_GRID = (2.5, 4.2, 1000)
POINTS, WINDOW = 2500, 7
RANGES = ((0.15, 0.55), (0.55, 0.85))
INITIAL_CYCLES = 20
LEG = ("cell_id", "leg", "cycle")


def places(domain: str = "Q") -> np.ndarray:
    return np.linspace(*(GRID if domain == "Q" else VOLTAGE_GRID))


def evolution_map(samples: DataFrame, domain: str = "Q", normalize: str = "none", keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``curve, total_q, dqdv_snr, samples_per_mv``: each leg's |dV/dQ| over its share of charge, or its dQ/dV over voltage, on the fixed grid.

    Samples are prepared for derivatives. ``normalize`` is none, area or capacity; local
    contrast needs all cycles and comes with the tracks. A leg that is too short
    has an empty curve.
    """

    def f(g):
        out = {"curve": [], "total_q": np.nan, "dqdv_snr": np.nan, "samples_per_mv": np.nan}
        v, q = g["voltage"].astype(float), g["capacity"].astype(float)
        q = np.abs(q - q[0])
        total = float(np.nanmax(q)) if np.isfinite(q).any() else 0.0
        if not total > 0:
            return out
        vx, dqdv, qx, dvdq = kernels.differential(v, q, n=POINTS, window=WINDOW)
        if len(vx) < 5:
            vx, dqdv, qx, dvdq = kernels.differential(v, q, n=min(500, max(100, len(q))), window=WINDOW)
        if len(vx) < 5:
            return out | {"total_q": total}
        even = kernels.smooth(dqdv, WINDOW)
        off = dqdv - even
        noise = 1.4826 * float(np.median(np.abs(off - np.median(off))))
        line = ridges.on_grid(qx / total, np.abs(dvdq), places()) if domain == "Q" else ridges.on_grid(vx, dqdv, places("V"))
        if normalize == "capacity":
            line = line / total
        elif normalize == "area" and np.nansum(np.abs(line)) > 0:
            line = line / np.nansum(np.abs(line))
        return {"curve": line, "total_q": total, "dqdv_snr": float(np.abs(even).max() / (noise + 1e-12)), "samples_per_mv": float(len(vx) / (np.abs(np.gradient(vx)).sum() * 1000 + 1e-12))}

    return _grouped(samples, keys, ["voltage", "capacity"], order, "curve array<double>, total_q double, dqdv_snr double, samples_per_mv double", f)


def local_contrast(maps: DataFrame, keys: Sequence[str] = ("cell_id", "leg")) -> DataFrame:
    """Curves (keys, cycle, curve) over the median size of their own, then over each place's mean size of all cycles.

    Weak lasting ridges so compete with strong ones. Places are summed as rows, so a map of
    any number of cycles has one row a place; unknown values and zero sizes give NaN.
    """
    none = F.lit(float("nan"))
    sizes = F.array_sort(F.transform(F.filter("curve", lambda x: ~F.isnan(x)), F.abs))
    n = F.size(sizes)
    middle = (F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))) / 2
    # The median is a lambda's variable: as a column it would be inlined and sorted anew for every place.
    rows = maps.withColumn("curve", F.get(F.transform(F.array(middle), lambda m: F.transform("curve", lambda x: F.when(m > 1e-15, x / m).otherwise(none))), F.lit(0)))
    places = rows.select(*keys, F.posexplode("curve").alias("_p", "_x"))
    means = places.groupBy(*keys, "_p").agg(F.avg(F.when(~F.isnan("_x"), F.abs("_x"))).alias("_mean"))
    lines = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_mean"))), lambda r: r["_mean"]).alias("_means"))
    over = F.zip_with("curve", "_means", lambda x, m: F.when(m > 1e-15, x / m).otherwise(none))
    return rows.join(lines, list(keys)).withColumn("curve", over).drop("_means")


def tracks(maps: DataFrame, domain: str = "Q", contrast: bool = True, most: int = 12, spreads: float = 0.75, window: int = 40, anchors: DataFrame | None = None, ranges: Sequence[tuple[float, float]] = RANGES) -> DataFrame:
    """``track, cycle, place, coord, height, area, half_width, confidence, snr_local, observed`` of every ridge of a cell's leg.

    Ridges are sought in each range of the grid apart (over voltage in all of it),
    ``most`` in all. Steps are penalised by the map's spread and the drift of ``anchors``
    (a map of capacity cycles). A group is a cell's map, which the cycler bounds; it holds
    all of the map's cycles, so ``contrast`` is taken there, as ``local_contrast`` has it.
    """
    grid = places(domain)
    known = maps.where(F.size("curve") > 0).select("cell_id", "leg", "cycle", "curve")
    both = known.withColumn("_anchor", F.lit(0))
    if anchors is not None:
        both = both.unionByName(anchors.where(F.size("curve") > 0).select("cell_id", "leg", "cycle", "curve", F.lit(1).alias("_anchor")))

    def f(g):
        m = np.stack([np.asarray(c, float) for c in g["curve"]])
        anchor = g["_anchor"].astype(bool)
        drift = ridges.drifts(dict(zip(g["cycle"][anchor].tolist(), m[anchor], strict=True)))
        m, cycles = m[~anchor], g["cycle"][~anchor]
        if not len(m):
            return []
        m = ridges.contrast(m) if contrast else m
        weight, rows, number = ridges.penalty(m, drift), [], 0
        parts = [(np.searchsorted(grid, lo), np.searchsorted(grid, hi, "right")) for lo, hi in ranges] if domain == "Q" and ranges else [(0, len(grid))]
        middle = np.array([np.nanmedian(np.abs(x)) if np.isfinite(x).any() else np.nan for x in m])
        for lo, hi in parts:
            if hi - lo < 10:
                continue
            for path, sure in ridges.peel(m[:, lo:hi], weight, max(1, most // len(parts)), spreads, window):
                for i, j in enumerate((path + lo).tolist()):
                    h, w = m[i, j], ridges.half_width(m[i], j)
                    area = float(np.nansum(np.abs(m[i, max(0, j - w) : j + w + 1])))
                    rows.append({
                        "track": number, "cycle": int(cycles[i]), "place": j, "coord": float(grid[j]), "height": float(h), "area": area, "half_width": w,
                        "confidence": float(sure[i]), "snr_local": float(abs(h) / (middle[i] + 1e-12)), "observed": bool(np.isfinite(h)),
                    })
                number += 1
        return rows

    schema = "track int, cycle int, place int, coord double, height double, area double, half_width int, confidence double, snr_local double, observed boolean"
    return _grouped(both, ["cell_id", "leg"], ["cycle", "curve", "_anchor"], ["_anchor", "cycle"], schema, f).dropna(subset=["track"])


def events(found: DataFrame, maps: DataFrame) -> DataFrame:
    """``event, cycle, ratio``: where a track is confirmed (initial within the start, else born), resumes, or ends merged, died or ambiguous."""
    keys = ["cell_id", "leg", "track"]
    rows = lifecycle(found, keys=keys)
    w = Window.partitionBy(*keys).orderBy("cycle")
    before, start = F.lag("state").over(w), F.min("cycle").over(Window.partitionBy(*keys))
    moved = rows.withColumns({"_before": F.coalesce(before, F.lit("tentative")), "_start": start})
    kind = F.when((F.col("state") == "confirmed") & (F.col("_before") == "tentative"), F.when(F.col("cycle") - F.col("_start") <= INITIAL_CYCLES, "initial").otherwise("born")).when(
        (F.col("state") == "confirmed") & (F.col("_before") == "coasting"), "resumed"
    )
    lived = moved.withColumn("event", kind).where("event is not null").select(*keys, "cycle", "event", F.lit(None).cast("double").alias("ratio"))
    ended = moved.where("state = 'terminated' and _before <> 'terminated'")
    asked = ended.select(*keys, "cycle", F.greatest(F.lit(0), F.col("place") - F.col("half_width")).cast("double").alias("lo"), (F.col("place") + F.col("half_width") + 1).cast("double").alias("hi"))
    gone = disappearances(maps, asked).select(*keys, "cycle", F.col("kind").alias("event"), "ratio")
    return lived.unionByName(gone)


def summary(found: DataFrame) -> DataFrame:
    """One row a track: first and last observed cycle, coordinates, drift per 100 cycles with its fit, areas and confidence."""
    seen = lambda c: F.when(F.col("observed"), F.col(c))
    x, y = seen("cycle").cast("double"), seen("coord")
    first = lambda c: F.min_by(seen(c), F.when(F.col("observed"), F.col("cycle")))
    last = lambda c: F.max_by(seen(c), F.when(F.col("observed"), F.col("cycle")))
    rows = found.groupBy("cell_id", "leg", "track").agg(
        F.min(seen("cycle")).alias("birth_cycle"), F.max(seen("cycle")).alias("death_cycle"), F.count("*").alias("lifetime_cycles"), F.count(seen("cycle")).alias("n_observed"),
        first("coord").alias("start"), last("coord").alias("end"), first("area").alias("area_start"), last("area").alias("area_end"), first("half_width").alias("sigma_start"), last("half_width").alias("sigma_end"),
        F.when(F.count(seen("cycle")) >= 5, F.regr_slope(y, x) * 100).alias("_fit"), F.when(F.count(seen("cycle")) >= 5, ratio(F.covar_pop(y, x) * F.covar_pop(y, x), F.var_pop(y) * F.var_pop(x))).alias("drift_r2"),
        F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("min_confidence"),
    )
    ends = (F.col("end") - F.col("start")) / F.greatest(F.col("death_cycle") - F.col("birth_cycle"), F.lit(1)) * 100
    return rows.withColumns({"drift_per_100": F.coalesce("_fit", ends), "area_fade_pct": F.when(F.col("area_start") > 0, (1 - F.col("area_end") / F.col("area_start")) * 100), "n_coasted": F.col("lifetime_cycles") - F.col("n_observed")}).drop("_fit")


def noise_floor(maps: DataFrame, pairs: DataFrame, domain: str = "Q") -> DataFrame:
    """``n_pairs, error_rms, error_median`` of each cell's leg: how far peaks lie apart in two capacity cycles (cell_id, c1, c2) of one block."""
    grid = places(domain)
    inside = (grid >= grid[0] + 0.05 * np.ptp(grid)) & (grid <= grid[-1] - 0.10 * np.ptp(grid))
    own = maps.where(F.size("curve") > 0)
    one = own.select("cell_id", "leg", F.col("cycle").alias("c1"), F.col("curve").alias("a"))
    two = own.select("cell_id", "leg", F.col("cycle").alias("c2"), F.col("curve").alias("b"))
    both = pairs.join(one, ["cell_id", "c1"]).join(two, ["cell_id", "leg", "c2"])

    def f(g):
        errors = []
        for a, b in zip(g["a"], g["b"], strict=True):
            x, y = (ridges.tops(np.where(inside, np.abs(np.asarray(z, float)), np.nan)) for z in (a, b))
            errors += [float(min(abs(grid[i] - grid[j]) for j in y)) for i in x if y]
        e = np.array(errors)
        return {"n_pairs": len(g["a"]), "error_rms": float(np.sqrt((e**2).mean())) if len(e) else np.nan, "error_median": float(np.median(e)) if len(e) else np.nan}

    return _grouped(both, ["cell_id", "leg"], ["c1", "a", "b"], ["c1"], "n_pairs int, error_rms double, error_median double", f)


def anchor_errors(found: DataFrame, maps: DataFrame, domain: str = "Q", half: float = 0.08, least: int = 3) -> DataFrame:
    """``cycle, track, predicted, observed, error``: each anchor cycle's peak against the track's line through the other anchors.

    An anchor's peak of a track is the largest place of its map (cell_id, leg, cycle, curve)
    within ``half`` of the track's nearest coordinate; a line needs ``least`` other anchors.
    """
    grid = places(domain)
    own = maps.where(F.size("curve") > 0).select("cell_id", "leg", F.col("cycle").alias("anchor"), "curve")
    near = own.join(found.where("observed").select("cell_id", "leg", "track", "cycle", "coord"), ["cell_id", "leg"])
    near = near.groupBy("cell_id", "leg", "track", "anchor").agg(F.min_by("coord", F.struct(F.abs(F.col("cycle") - F.col("anchor")), "cycle")).alias("coord")).join(own, ["cell_id", "leg", "anchor"])

    def f(g):
        seen = []
        for curve, coord in zip(g["curve"], g["coord"], strict=True):
            y = np.where(np.abs(grid - coord) <= half, np.abs(np.asarray(curve, float)), np.nan)
            seen.append(float(grid[np.nanargmax(y)]) if np.isfinite(y).any() else np.nan)
        x, y = g["anchor"].astype(float), np.array(seen)
        rows = []
        for k in range(len(x)):
            rest = (np.arange(len(x)) != k) & np.isfinite(y)
            guess = float(np.polyval(np.polyfit(x[rest], y[rest], 1), x[k])) if rest.sum() >= least else np.nan
            rows.append({"cycle": int(x[k]), "predicted": guess, "observed": y[k], "error": abs(guess - y[k])})
        return rows

    return _grouped(near, ["cell_id", "leg", "track"], ["anchor", "curve", "coord"], ["anchor"], "cycle int, predicted double, observed double, error double", f)


def preflight(maps: DataFrame, least_snr: float = 2.0, least_samples: float = 0.15, least_cycles: int = 10) -> DataFrame:
    """``check, status, value`` of each cell's leg before tracking: cycles, usable curves, noise, sampling, coverage and steady capacity."""
    usable = F.size("curve") > 0
    known = F.when(usable, F.aggregate("curve", F.lit(0), lambda a, x: a + F.when(x.isNotNull() & ~F.isnan(x), 1).otherwise(0)) / F.size("curve"))
    found = maps.groupBy("cell_id", "leg").agg(
        F.count("*").cast("double").alias("n_cycles"), F.avg(usable.cast("double")).alias("usable_share"), F.median("dqdv_snr").alias("dqdv_snr"), F.median("samples_per_mv").alias("samples_per_mv"),
        F.avg(known).alias("grid_coverage"), ratio(F.stddev_pop("total_q"), F.avg("total_q")).alias("capacity_spread"),
    )
    limits = {"n_cycles": (least_cycles, 3), "usable_share": (0.8, 0.5), "dqdv_snr": (2 * least_snr, least_snr), "samples_per_mv": (2 * least_samples, least_samples), "grid_coverage": (0.9, 0.6)}
    rows = [(name, F.col(name), F.when(F.col(name) >= good, "PASS").when(F.col(name) >= poor, "WARN").otherwise("FAIL")) for name, (good, poor) in limits.items()]
    rows.append(("capacity_spread", F.col("capacity_spread"), F.when(F.col("capacity_spread") <= 0.2, "PASS").when(F.col("capacity_spread") <= 0.5, "WARN").otherwise("FAIL")))
    return found.select("cell_id", "leg", F.inline(F.array(*(F.struct(F.lit(name).alias("check"), status.alias("status"), value.alias("value")) for name, value, status in rows))))


def pipeline(samples: DataFrame, capacity_samples: DataFrame | None = None, domain: str = "Q") -> dict[str, DataFrame]:
    """``maps, preflight, tracks, events, summary`` of prepared routine samples; capacity cycles' samples give the anchors."""
    maps = evolution_map(samples, domain)
    anchors = evolution_map(capacity_samples, domain) if capacity_samples is not None else None
    found = tracks(maps, domain, anchors=anchors)
    return {"maps": maps, "preflight": preflight(maps), "tracks": found, "events": events(found, maps), "summary": summary(found)}


def compare_domains(samples: DataFrame) -> DataFrame:
    """Tracks over charge and over voltage side by side: ``domain, n_tracks, mean_lifetime, mean_confidence`` of each cell's leg."""
    out = None
    for domain in ("Q", "V"):
        rows = summary(tracks(evolution_map(samples, domain), domain))
        part = rows.groupBy("cell_id", "leg").agg(F.lit(domain).alias("domain"), F.count("*").alias("n_tracks"), F.avg("n_observed").alias("mean_lifetime"), F.avg("mean_confidence").alias("mean_confidence"))
        out = part if out is None else out.unionByName(part)
    return out


def steep_onsets(samples: DataFrame, lo: float = 0.80, hi: float = 0.99, factor: float = 3.0, keys: Sequence[str] = LEG, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``Q_steepen_abs_Ah, Q_steepen_norm, dvdq_at_steepen, total_Ah``: where a discharge turns steep near its end.

    The first place at ``factor`` times the middle's median of |dV/dQ| (without one the
    steepest) within shares lo to hi of the charge; null without twenty distinct counts.
    """
    names = ("Q_steepen_abs_Ah", "Q_steepen_norm", "dvdq_at_steepen", "total_Ah")

    def f(g):
        out = dict.fromkeys(names, np.nan)
        v, q = g["voltage"].astype(float), g["capacity"].astype(float)
        ok = np.isfinite(v) & np.isfinite(q)
        v, q = v[ok], np.abs(q[ok] - q[ok][0]) if ok.any() else q[ok]
        at, first = np.unique(np.round(q, 6), return_index=True)
        if len(at) < 20 or not at[-1] > 0:
            return out
        q, d = q[first], np.gradient(v[first], q[first])
        share = q / q.max()
        inside = np.flatnonzero((share >= lo) & (share <= hi) & np.isfinite(d))
        middle = np.abs(d[(share >= 0.3) & (share <= 0.7) & np.isfinite(d)])
        if len(inside) < 5:
            return out
        level = factor * max(float(np.median(middle if len(middle) else np.abs(d))), 1e-6)
        steep = inside[np.abs(d[inside]) >= level]
        k = steep[0] if len(steep) else inside[np.abs(d[inside]).argmax()]
        return dict(zip(names, (float(q[k]), float(share[k]), float(d[k]), float(q.max())), strict=True))

    return _grouped(samples, keys, ["voltage", "capacity"], order, ", ".join(f"{c} double" for c in names), f)
