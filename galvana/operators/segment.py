"""Segmentation of cycler samples: step kinds, runs, rests, blocks of cycles, continuity.

Samples have ``cell_id, cycle, row_id``; row_id is the order of acquisition, which
decides everything here. Windows partition by cell and cycle, so a group is one
cycle's samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions.expr import col

KEYS = ("cell_id", "cycle")


def _labels(text: str) -> list[str]:
    return [x.strip().lower() for x in text.split(",") if x.strip()]


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def step_kind(step: Column | str, charge: str = "charge", discharge: str = "discharge", rest: str = "rest") -> Column:
    """Kind by substring, discharge before charge (whose label it holds), then rest, else other."""
    s = F.lower(F.trim(col(step).cast("string")))
    holds = lambda text: F.coalesce(_any([F.contains(s, F.lit(x)) for x in _labels(text)]), F.lit(False))
    return F.when(holds(discharge), "discharge").when(holds(charge), "charge").when(holds(rest), "rest").otherwise("other")


def step_kind_exact(step: Column | str, charge: str = "charge", discharge: str = "discharge", rest: str = "rest") -> Column:
    """The stricter rule of rest voltages: legs by exact label, rest by substring."""
    s = F.lower(F.trim(col(step).cast("string")))
    return (
        F.when(s.isin(_labels(charge)), "charge")
        .when(s.isin(_labels(discharge)), "discharge")
        .when(F.coalesce(_any([F.contains(s, F.lit(x)) for x in _labels(rest)]), F.lit(False)), "rest")
        .otherwise("other")
    )


def with_kind(samples: DataFrame, rest_current_max: float | None = None, step: str = "step_type", **labels: str) -> DataFrame:
    """Add ``kind``; an unknown step at no more than the rest current counts as rest."""
    kind = step_kind(step, **labels)
    if rest_current_max is not None:
        kind = F.when((kind == "other") & (F.abs("current") <= rest_current_max), "rest").otherwise(kind)
    return samples.withColumn("kind", kind)


def with_runs(samples: DataFrame, by: Sequence[str] = ("kind",), keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Add ``run_id``: from 0, a new number wherever one of ``by`` changes in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = _any([~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in by]) & F.lag(F.lit(True)).over(w).isNotNull()
    return samples.withColumn("_new", changed.cast("int")).withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(samples: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """One row for each run of a kind: ``run_id, kind, n, first_time, last_time, previous_kind``."""
    found = (
        with_runs(samples, keys=keys, order=order)
        .groupBy(*keys, "run_id", "kind")
        .agg(F.count("*").alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    )
    w = Window.partitionBy(*keys).orderBy("run_id")
    return found.withColumn("previous_kind", F.lag("kind").over(w))


def rest_periods(samples: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Rest runs that follow a leg at once; ``after_leg`` names it. Consumers take the last of each leg."""
    found = runs(samples, keys, order).where((F.col("kind") == "rest") & F.col("previous_kind").isin("charge", "discharge"))
    return found.select(*keys, "run_id", F.col("previous_kind").alias("after_leg"), "n", "first_time", "last_time")


def consecutive_blocks(cycles: DataFrame, keys: Sequence[str] = ("cell_id",), min_len: int = 1) -> DataFrame:
    """Blocks of consecutive cycle numbers: ``block_start, block_end, n_cycles``."""
    w = Window.partitionBy(*keys).orderBy("cycle")
    island = F.col("cycle") - F.row_number().over(w)
    return (
        cycles.select(*keys, "cycle")
        .distinct()
        .withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(F.min("cycle").alias("block_start"), F.max("cycle").alias("block_end"), F.count("*").alias("n_cycles"))
        .where(F.col("n_cycles") >= min_len)
        .drop("_island")
    )


def preceding_blocks(blocks: DataFrame, others: DataFrame, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Blocks with the other table's block that ends one cycle before, where there is one."""
    before = others.select(*keys, (F.col("block_end") + 1).alias("block_start"), F.col("block_start").alias("preceding_start"), F.col("block_end").alias("preceding_end"))
    return blocks.join(before, [*keys, "block_start"], "left")


def capacity_runs(samples: DataFrame, q: str, reset_drop: float = 0.5, keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Add ``capacity_run``: a new one where the counter falls by more than ``reset_drop``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fell = F.coalesce(F.lag(q).over(w) - F.col(q) > reset_drop, F.lit(False)).cast("int")
    return samples.withColumn("_fell", fell).withColumn("capacity_run", F.sum("_fell").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fell")


def tagged_windows(samples: DataFrame, valid: Column, keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",), clock: str = "time", step: str | None = "step_type") -> DataFrame:
    """The valid samples with ``window_id``: runs that end where time does not rise, the step changes or the current changes sign."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = samples.withColumn("_valid", F.coalesce(valid & F.col(clock).isNotNull(), F.lit(False)))
    new = (
        ~F.coalesce(F.lag("_valid").over(w), F.lit(False))
        | ~F.coalesce(F.col(clock) > F.lag(clock).over(w), F.lit(False))
        | (~F.col(step).eqNullSafe(F.lag(step).over(w)) if step else F.lit(False))
        | (F.signum("current") != F.lag(F.signum("current")).over(w))
    )
    rows = rows.withColumn("_new", (F.col("_valid") & new).cast("int"))
    return rows.withColumn("window_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_valid").drop("_valid", "_new")


def continuous_windows(samples: DataFrame, valid: Column, keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",), clock: str = "time", step: str | None = "step_type") -> DataFrame:
    """One row for each window of valid samples: ``window_id, n, first_time, last_time``."""
    rows = tagged_windows(samples, valid, keys, order, clock, step)
    return rows.groupBy(*keys, "window_id").agg(F.count("*").alias("n"), F.min(clock).alias("first_time"), F.max(clock).alias("last_time"))


def leg_samples(samples: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Charge and discharge samples (of ``kind``) with ``leg`` and whether the leg's acquisition is ``disjoint``."""
    rows = with_runs(samples, keys=keys, order=order).where(F.col("kind").isin("charge", "discharge")).withColumn("leg", F.col("kind"))
    w = Window.partitionBy(*keys, "leg")
    return rows.withColumn("disjoint", F.max("run_id").over(w) != F.min("run_id").over(w)).drop("run_id")


def for_derivatives(legs: DataFrame, q: str = "capacity", keys: Sequence[str] = (*KEYS, "leg"), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Samples of legs to differentiate: without the slow start, a discharge without pulses, a charge without its constant-voltage tail.

    The tail starts where the current stays below 92 % of its early median for five
    samples, after the first tenth of the samples and 85 % of the charge.
    """
    rows = trim_leading(legs, q, keys, order)
    charge, discharge = (rows.where(F.col("leg") == leg) for leg in ("charge", "discharge"))
    w = Window.partitionBy(*keys)
    by = w.orderBy(*order)
    a = F.abs("current")
    placed = charge.withColumns({"_p": F.row_number().over(by), "_n": F.count("*").over(w), "_q": F.col(q) / F.nullif(F.max(q).over(w), F.lit(0.0))})
    early = placed.where(F.col("_p") <= F.greatest(F.floor(F.col("_n") / 2), F.lit(4))).groupBy(*keys).agg(F.median(F.when(a > 0, a)).alias("_cc"))
    placed = placed.join(early, list(keys), "left").withColumn("_low", (a < 0.92 * F.col("_cc")).cast("int"))
    ahead = by.rowsBetween(0, 4)
    tail = (F.min("_low").over(ahead) == 1) & (F.count("*").over(ahead) == 5) & (F.col("_p") > F.col("_n") * 0.1) & (F.col("_q") >= 0.85)
    placed = placed.withColumn("_tail", tail).withColumn("_from", F.min(F.when(F.col("_tail"), F.col("_p"))).over(w))
    charge = placed.where(F.col("_from").isNull() | (F.col("_p") < F.col("_from"))).select(*rows.columns)
    return charge.unionByName(drop_pulse_rows(discharge, keys))


def continuity_reason(samples: DataFrame, keys: Sequence[str], order: Sequence[str] = ("row_id",), index: str | None = None) -> DataFrame:
    """The first reason why a segment's samples are not continuous, null if they are.

    In order: insufficient (fewer than 3), gap (``index`` rises by other than 1),
    missing_clock, clock_reset (time falls).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = samples.withColumns({
        "_gap": (F.col(index) - F.lag(index).over(w) != 1) if index else F.lit(False),
        "_back": F.col("time") < F.lag("time").over(w),
    })
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(F.bool_or("_gap"), F.lit(False)).alias("gap"),
        F.bool_or(F.col("time").isNull()).alias("missing"),
        F.coalesce(F.bool_or("_back"), F.lit(False)).alias("back"),
    )
    reason = F.when(F.col("n") < 3, "insufficient").when(F.col("gap"), "gap").when(F.col("missing"), "missing_clock").when(F.col("back"), "clock_reset")
    return found.select(*keys, "n", reason.alias("reason"))


def counter_reason(samples: DataFrame, q: str, v: str, keys: Sequence[str], order: Sequence[str] = ("row_id",)) -> DataFrame:
    """The first reason why a capacity counter can't be paired with its voltage, null if it can.

    In order: insufficient (fewer than 2), nonfinite, reset (the counter falls),
    conflicting (two voltages at one count), zero_capacity.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    bad = F.col(q).isNull() | F.col(v).isNull() | F.isnan(q) | F.isnan(v)
    step = F.col(q) - F.lag(q).over(w)
    rows = samples.withColumns({"_bad": bad, "_fell": step < 0, "_two": (step == 0) & (F.col(v) != F.lag(v).over(w))})
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), flag("_bad").alias("bad"), flag("_fell").alias("fell"), flag("_two").alias("two"), (F.max(q) - F.min(q)).alias("span")
    )
    reason = (
        F.when(F.col("n") < 2, "insufficient").when(F.col("bad"), "nonfinite").when(F.col("fell"), "reset").when(F.col("two"), "conflicting").when(F.col("span") <= 0, "zero_capacity")
    )
    return found.select(*keys, "n", reason.alias("reason"))


def pulse_cycles(samples: DataFrame, expected_pulse_current: float) -> DataFrame:
    """Cycles whose largest current reaches half the pulse current."""
    return samples.groupBy(*KEYS).agg(F.max(F.abs("current")).alias("max_current")).where(F.col("max_current") >= 0.5 * expected_pulse_current)


def drop_pulse_rows(samples: DataFrame, keys: Sequence[str], ratio: float = 1.8, min_active: float = 1.0, least: tuple[int, int, int] = (30, 20, 10)) -> DataFrame:
    """Segments without the rows of DC resistance pulses.

    A segment has pulses where the median of its active currents is below its
    largest over ``ratio``; rows above ratio times the median go. Short segments
    (rows, active rows, rows left) stay whole.
    """
    a = F.abs("current")
    active = F.when(a >= min_active, a)
    stats = samples.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(active).alias("_active"), F.median(active).alias("_median"), F.max(active).alias("_most"))
    joined = samples.join(stats, list(keys))
    pulse = (F.col("_n") >= least[0]) & (F.col("_active") >= least[1]) & (F.col("_median") < F.col("_most") / ratio) & (a > ratio * F.col("_median"))
    w = Window.partitionBy(*keys)
    kept = joined.withColumn("_pulse", F.coalesce(pulse, F.lit(False))).withColumn("_left", F.sum((~F.col("_pulse")).cast("int")).over(w))
    return kept.where(~F.col("_pulse") | (F.col("_left") < least[2])).select(*samples.columns)


def trim_leading(samples: DataFrame, q: str, keys: Sequence[str], order: Sequence[str] = ("row_id",), min_frac: float = 0.005) -> DataFrame:
    """Drop rows before the counter first reaches a share of its largest, all but the one just before."""
    w = Window.partitionBy(*keys)
    rows = samples.withColumn("_place", F.row_number().over(w.orderBy(*order))).withColumn("_most", F.max(q).over(w))
    first = F.min(F.when(F.col(q) >= F.col("_most") * min_frac, F.col("_place"))).over(w)
    return rows.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("_place") >= F.col("_first") - 1)).select(*samples.columns)
