"""Peaks of routine cycles named after those of reference performance tests.

Tests show peaks that the faster routine cycles blur. A test's peaks, moved by how
routine peaks lie off them, say where each peak of a routine cycle is expected;
its own peaks are matched one to one with those, and what is missing is read from
a window of its own around the expectation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions import kernels
from galvana.operators import curves, protocol
from galvana.operators.asof import bracket
from galvana.operators.segment import consecutive_blocks

#: Cycles within which a test is near and not far, routine cycles before a test that give its shift, largest cost, and widths of windows in volts.
HARD, SOFT, SHIFT_CYCLES, MOST_COST, NEAR_V, SPLIT_HALF_V, SPLIT_GAP_V = 10, 30, 5, 0.15, 0.08, 0.06, 0.005
#: Smoothing windows and least heights of bands in tests and in routine cycles, share of the largest height that a window's peak needs, and the reference height of the cost.
TEST_WINDOW, ROUTINE_WINDOW, TEST_LEAST, ROUTINE_LEAST, SPLIT_LEAST, REFERENCE_H = 21, 31, 0.08, 0.12, 0.05, 50.0
LEG = ["cell_id", "cycle", "leg"]


def anchor_cycles(flags: DataFrame) -> DataFrame:
    """``cell_id, life, anchor_cycle, cycle``: the cycles that stand for each test.

    The full capacity cycles right before its block, else its capacity checks, else
    all of the block. Of tests of one life the first counts.
    """
    points = protocol.rpt_checkpoints(flags)
    w = Window.partitionBy("cell_id", "life").orderBy("block_start")
    points = points.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    full = consecutive_blocks(flags.where("capa_full")).select("cell_id", F.sequence("block_start", "block_end").alias("_full"), (F.col("block_end") + 1).alias("block_start"))
    checks = flags.where("capacheck").select("cell_id", "cycle")
    inside = points.join(checks, "cell_id").where(F.col("cycle").between(F.col("block_start"), F.col("block_end"))).groupBy("cell_id", "block_start").agg(F.sort_array(F.collect_list("cycle")).alias("_checks"))
    joined = points.join(full, ["cell_id", "block_start"], "left").join(inside, ["cell_id", "block_start"], "left")
    chosen = F.coalesce("_full", "_checks", F.sequence("block_start", "block_end"))
    return joined.select("cell_id", "life", "anchor_cycle", F.explode(chosen).alias("cycle"))


def second_of_pairs(flags: DataFrame) -> DataFrame:
    """``cell_id, block_start, cycle``: of the full capacity cycles before each test the second (the only one, where there is one)."""
    full = consecutive_blocks(flags.where("capa_full")).select("cell_id", F.sequence("block_start", "block_end").alias("_full"), (F.col("block_end") + 1).alias("block_start"))
    found = consecutive_blocks(flags.where("rpt")).join(full, ["cell_id", "block_start"])
    return found.select("cell_id", "block_start", F.coalesce(F.try_element_at("_full", F.lit(2)), F.try_element_at("_full", F.lit(1))).alias("cycle"))


def _peaks(samples: DataFrame, window: int, least: float, order: Sequence[str]) -> DataFrame:
    bands = {"charge": curves.CHARGE_BANDS, "discharge": curves.DISCHARGE_BANDS}

    def f(g):
        v, y = kernels.derivative(g["voltage"].astype(float), g["capacity"].astype(float), window=window)
        return [{"band": p[0], "V": p[1], "H": p[2]} for p in kernels.band_peaks(v, y, bands.get(g["leg"][0], ()), least, window)]

    return curves._grouped(samples, LEG, ["leg", "voltage", "capacity"], order, "band string, V double, H double", f).dropna(subset=["band"])


def references(prepared: DataFrame, anchors: DataFrame, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``cell_id, life, leg, peak_id, V, H``: means of the banded peaks over a test's cycles."""
    found = _peaks(prepared.join(anchors.select("cell_id", "cycle").distinct(), ["cell_id", "cycle"], "left_semi"), TEST_WINDOW, TEST_LEAST, order)
    joined = found.join(anchors, ["cell_id", "cycle"])
    return joined.groupBy("cell_id", "life", "leg", F.col("band").alias("peak_id")).agg(F.avg("V").alias("V"), F.avg("H").alias("H"))


def rate_shifts(prepared: DataFrame, refs: DataFrame, routine: DataFrame, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``cell_id, life, leg, peak_id, shift, n_pairs``: median distance of routine peaks from the test's, over the routine cycles just before its life.

    A routine cycle's peak is that of the same band, else the nearest within 0.08 V.
    """
    lives = refs.select("cell_id", "life").distinct().withColumn("cycle", F.explode(F.sequence(F.col("life") - SHIFT_CYCLES, F.col("life"))))
    near = lives.join(routine.select("cell_id", "cycle"), ["cell_id", "cycle"])
    found = _peaks(prepared.join(near.select("cell_id", "cycle").distinct(), ["cell_id", "cycle"], "left_semi"), ROUTINE_WINDOW, ROUTINE_LEAST, order)
    # A leg has a handful of banded peaks and references, so this join is small for each cycle.
    both = found.withColumnRenamed("V", "_v").drop("H").join(near, ["cell_id", "cycle"]).join(refs.drop("H"), ["cell_id", "life", "leg"])
    off = F.col("_v") - F.col("V")
    same = F.col("band") == F.col("peak_id")
    each = both.where(same | (F.abs(off) < NEAR_V)).groupBy("cell_id", "life", "leg", "peak_id", "cycle").agg(F.min_by(off, F.struct((~same).alias("other"), F.abs(off).alias("d"))).alias("off"))
    return each.groupBy("cell_id", "life", "leg", "peak_id").agg(F.median("off").alias("shift"), F.count("*").alias("n_pairs"))


def shifted(refs: DataFrame, shifts: DataFrame) -> DataFrame:
    """References with their own shift, else that of the nearest life of the same peak, else none: ``V`` becomes the routine expectation."""
    own = refs.join(shifts.select("cell_id", "life", "leg", "peak_id", "shift"), ["cell_id", "life", "leg", "peak_id"], "left")
    w = Window.partitionBy("cell_id", "leg", "peak_id").orderBy("life")
    some = F.when(F.col("shift").isNotNull(), F.struct("life", "shift"))
    rows = own.withColumns({"_a": F.last(some, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first(some, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    first = F.col("_b").isNull() | (F.col("life") - F.col("_a.life") <= F.col("_b.life") - F.col("life"))
    shift = F.coalesce(F.when(F.coalesce(first, F.lit(False)), F.col("_a.shift")).otherwise(F.col("_b.shift")), F.lit(0.0))
    return rows.withColumn("shift", shift).withColumn("V", F.col("V") + F.col("shift")).drop("_a", "_b")


def expectations(routine: DataFrame, refs: DataFrame) -> DataFrame:
    """``cell_id, cycle, leg, peak_id, V_expected, anchor_left, anchor_right, zone, rate_shift_mV``: between the tests before and after (at the ends the nearest one)."""
    lives = refs.select("cell_id", F.col("life").alias("cycle")).distinct()
    found = bracket(routine.select("cell_id", "cycle"), lives, ["cell_id"])
    spans = found.select("cell_id", "cycle", F.coalesce("before_cycle", "after_cycle").alias("left"), F.coalesce("after_cycle", "before_cycle").alias("right")).where("left is not null")
    side = lambda end: spans.join(refs.select("cell_id", F.col("life").alias(end), "leg", "peak_id", F.col("V").alias(f"_{end}"), F.col("shift").alias(f"_shift_{end}")), ["cell_id", end])
    both = side("left").join(side("right"), ["cell_id", "cycle", "left", "right", "leg", "peak_id"], "full")
    share = (F.col("cycle") - F.col("left")) / F.greatest(F.col("right") - F.col("left"), F.lit(1))
    v = F.coalesce(F.col("_left") + (F.col("_right") - F.col("_left")) * share, "_left", "_right")
    far = F.least(F.abs(F.col("cycle") - F.col("left")), F.abs(F.col("cycle") - F.col("right")))
    zone = F.when(far <= HARD, "hard").when(far <= SOFT, "soft").otherwise("interpolated")
    return both.select(
        "cell_id", "cycle", "leg", "peak_id", v.alias("V_expected"), F.col("left").alias("anchor_left"), F.col("right").alias("anchor_right"), far.alias("distance_to_test"), zone.alias("zone"),
        (F.coalesce("_shift_left", "_shift_right") * 1000).alias("rate_shift_mV"),
    )


def windows(names: Sequence[str], v: Sequence[float], half: float = SPLIT_HALF_V) -> dict[str, tuple[float, float]]:
    """A window of its own around each expected voltage: neighbours part in the middle between them."""
    order = np.argsort(v, kind="stable")
    at = np.asarray(v, float)[order]
    middle = (at[1:] + at[:-1]) / 2
    lo, hi = np.maximum(at - half, np.concatenate([[-np.inf], middle])), np.minimum(at + half, np.concatenate([middle, [np.inf]]))
    return {names[k]: (float(a), float(b)) for k, a, b in zip(order.tolist(), lo, hi, strict=True) if b > a + SPLIT_GAP_V}


def _split_peak(x: np.ndarray, y: np.ndarray, lo: float, hi: float) -> tuple[float, float] | None:
    """The largest local peak of a window, else its largest point, if it is high enough."""
    at = np.flatnonzero((x >= lo) & (x <= hi))
    if not len(at):
        return None
    size, least = np.abs(y[at]), SPLIT_LEAST * np.abs(y).max()
    inner = np.flatnonzero((size[1:-1] >= size[:-2]) & (size[1:-1] >= size[2:]) & (size[1:-1] > least)) + 1 if len(at) >= 3 else np.zeros(0, int)
    k = inner[size[inner].argmax()] if len(inner) else size.argmax()
    return (float(x[at[k]]), float(y[at[k]])) if size[k] >= max(least, 1e-6) else None


_ASSIGNED = "peak_id string, V_observed double, H_observed double, match_cost double, assign_method string, n_candidates int"


def assign(prepared: DataFrame, expected: DataFrame, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """One row for each expected peak of a routine cycle's leg: what was observed, by which method, how surely, and what evidence that is.

    Candidates are matched one to one at a cost of at most 0.15 (volts, and 0.015 for
    each unit of height off the reference height); what is missing is read from its
    window. A group is one leg's samples with its few expectations.
    """
    types = dict(prepared.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in LEG)
    names = [*LEG, *(x.split()[0] for x in _ASSIGNED.split(", "))]

    def f(samples: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if samples.empty or wanted.empty:
            return pd.DataFrame(columns=names)
        samples = samples.sort_values(list(order), kind="stable")
        x, y = kernels.derivative(samples["voltage"].to_numpy(float), samples["capacity"].to_numpy(float), window=ROUTINE_WINDOW)
        if len(x) < 5:
            return pd.DataFrame(columns=names)
        wanted = wanted.sort_values("peak_id")
        ids, v = wanted["peak_id"].tolist(), wanted["V_expected"].to_numpy(float)
        found = kernels.robust_peaks(x, y, 12)
        at, h = np.array([p[0] for p in found]), np.array([p[1] for p in found])
        cost = np.abs(at[:, None] - v) + 0.015 * np.abs(np.abs(h) - REFERENCE_H)[:, None] if len(found) else np.zeros((0, len(v)))
        rows = {ids[b]: (at[a], h[a], float(cost[a, b]), "hungarian") for a, b in kernels.assign(cost, MOST_COST)} if len(found) else {}
        even = kernels.smooth(y, ROUTINE_WINDOW)
        for name, (lo, hi) in windows(ids, v).items():
            if name not in rows and (peak := _split_peak(x, even, lo, hi)):
                rows[name] = (*peak, abs(peak[0] - v[ids.index(name)]), "window_split")
        own = {k: samples[k].iloc[0] for k in LEG}
        none = (np.nan, np.nan, np.nan, "none")
        fields = ("V_observed", "H_observed", "match_cost", "assign_method")
        return pd.DataFrame([own | {"peak_id": i, "n_candidates": len(found)} | dict(zip(fields, rows.get(i, none), strict=True)) for i in ids], columns=names)

    chosen = prepared.select(*dict.fromkeys([*LEG, *order, "voltage", "capacity"]))
    asked = expected.select(*LEG, "peak_id", "V_expected")
    matched = chosen.groupBy(*LEG).cogroup(asked.groupBy(*LEG)).applyInPandas(f, f"{head}, {_ASSIGNED}")
    rows = expected.join(matched, [*LEG, "peak_id"])
    count = F.count("*").over(Window.partitionBy(*LEG))
    split, cost, hard = F.col("assign_method") == "window_split", F.col("match_cost"), F.col("zone") == "hard"
    evidence = (
        F.when(cost.isNull(), "missing").when(split | (cost > 0.12), "inferred_split").when(hard & (F.col("n_candidates") >= count), "observed").when(F.col("zone").isin("hard", "soft"), "shoulder").otherwise("inferred_split")
    )
    base = 1 - F.least(F.lit(1.0), cost / MOST_COST)
    by_window = F.greatest(F.lit(0.25), F.least(F.lit(0.75), base))
    sure = (
        F.when(cost.isNull(), 0.0)
        .when(split, F.when(hard, F.least(F.lit(0.85), by_window + 0.1)).otherwise(by_window))
        .when(hard, F.least(F.lit(1.0), base + 0.15))
        .when(F.col("zone") == "interpolated", F.greatest(F.lit(0.2), base - 0.15))
        .otherwise(base)
    )
    return rows.withColumns({"evidence_type": evidence, "assign_confidence": sure})


def build(prepared: DataFrame, flags: DataFrame, kinds: DataFrame, order: Sequence[str] = ("row_id",)) -> dict[str, DataFrame]:
    """``references, shifts, assigned``: the whole naming of routine peaks, from prepared samples and the protocol."""
    refs = references(prepared, anchor_cycles(flags), order)
    routine = kinds.where("protocol_kind = 'routine'").select("cell_id", "cycle")
    shifts = rate_shifts(prepared, refs, routine, order)
    expected = expectations(routine, shifted(refs, shifts))
    return {"references": refs, "shifts": shifts, "assigned": assign(prepared.join(routine, ["cell_id", "cycle"], "left_semi"), expected, order)}
