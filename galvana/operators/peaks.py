"""Peaks over cycles: references of good cycles, tracking tables, relation to fade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions.expr import pearson, ratio
from galvana.operators.order import quantiles
from galvana.operators.score import to_long


def golden_references(long: DataFrame, good: DataFrame | None = None) -> DataFrame:
    """``leg, band, V_ref, H_ref, n``: medians over good cycles (cell_id, cycle), or over all."""
    rows = long.join(good, ["cell_id", "cycle"], "left_semi") if good is not None else long
    on = ["leg", "band"]
    medians = [quantiles(rows.select(*on, c), on, c, name=f"{c}_ref") for c in ("V", "H")]
    return rows.groupBy(*on).agg(F.count("*").alias("n")).join(medians[0], on, "left").join(medians[1], on, "left").select(*on, "V_ref", "H_ref", "n")


def track(long: DataFrame, references: DataFrame) -> DataFrame:
    """Peaks with their distance from the reference and their height relative to it; one reference row a leg and band."""
    joined = long.join(references.drop("n"), ["leg", "band"], "left")
    return joined.withColumns({"dV_golden": F.col("V") - F.col("V_ref"), "H_norm": ratio("H", "H_ref")})


def derivatives(tracked: DataFrame, keys: Sequence[str] = ("cell_id", "leg", "band")) -> DataFrame:
    """Add ``dV, dH`` per cycle since the peak's cycle before."""
    w = Window.partitionBy(*keys).orderBy("cycle")
    step = F.col("cycle") - F.lag("cycle").over(w)
    return tracked.withColumns({f"d{c}": ratio(F.col(c) - F.lag(c).over(w), step) for c in ("V", "H")})


def summarize(tracked: DataFrame, keys: Sequence[str] = ("leg", "band")) -> DataFrame:
    """Means and spreads (of the population) of each peak."""
    return tracked.groupBy(*keys).agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in ("V", "H") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))))


def wide(long: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("cell_id", "cycle")) -> DataFrame:
    """One row a cycle with ``{leg}_{band}_V`` and ``_H``; the columns follow from the bands named."""
    named = long.withColumn("_c", F.concat_ws("_", F.substring("leg", 1, 3), "band"))
    names = [f"{leg}_{b}" for leg in ("cha", "dis") for b in bands]
    return named.groupBy(*keys).pivot("_c", names).agg(F.first("V").alias("V"), F.first("H").alias("H"))


def usable(quality: DataFrame, column: str, spread: float = 2.0) -> DataFrame:
    """Add ``usable``: at most the median plus ``spread`` robust deviations over all rows."""
    middle = lambda rows, c: quantiles(rows.select(F.lit(0).alias("_k"), c), ["_k"], c).agg(F.max("quantile")).scalar()
    off = quality.withColumn("_m", middle(quality, column))
    robust = 1.4826 * middle(off.select(F.abs(F.col(column) - F.col("_m")).alias("_off")), "_off")
    return off.withColumn("usable", F.col(column) <= F.col("_m") + spread * robust).drop("_m")


def good_cycle_deltas(table: DataFrame, good: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``delta_*``: each column less its median over the good cycles."""
    medians = quantiles(to_long(table.join(good, ["cell_id", "cycle"], "left_semi"), columns, ()), ["feature"])
    base = medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", "quantile")))).scalar()  # a row for each column
    return table.withColumn("_b", base).withColumns({f"delta_{c}": F.col(c) - F.try_element_at("_b", F.lit(c)) for c in columns}).drop("_b")


def correlate_with_fade(table: DataFrame, columns: Sequence[str], targets: Sequence[str], least: int = 8) -> DataFrame:
    """``feature, target, n, r`` over all rows with both, of ``least`` rows or more."""
    long = to_long(table.select(*dict.fromkeys([*columns, *targets])), columns, list(targets))
    goals = F.inline(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("goal")) for t in targets)))
    both = long.select("feature", "value", goals).where("value is not null and goal is not null")
    return both.groupBy("feature", "target").agg(F.count("*").alias("n"), pearson("value", "goal").alias("r")).where(F.col("n") >= least)


def collapses(soft: DataFrame, floor: float = 0.18, share: float = 0.55) -> DataFrame:
    """Candidates that two references or more claim with scores near the best (cell_id, cycle, candidate, peak_id, score)."""
    best = F.max("score").over(Window.partitionBy("cell_id", "cycle", "candidate"))
    near = soft.withColumn("_best", best).where(F.col("score") >= F.greatest(F.lit(floor), share * F.col("_best")))
    return near.groupBy("cell_id", "cycle", "candidate").agg(F.array_sort(F.collect_set("peak_id")).alias("peaks")).where(F.size("peaks") >= 2)


def soft_links(candidates: DataFrame, references: DataFrame, scale: float = 0.12, radius: float = 0.18) -> DataFrame:
    """Scores of candidates (V) against the references of their leg (and cell, where cells have their own), by distance in V within a radius.

    Both sides meet by voltage bins of the radius's width, so no leg is one group.
    """
    on = [c for c in ("cell_id", "leg") if c in references.columns]
    width = F.floor(F.col("V") / F.lit(radius)).cast("int")
    refs = references.select(*on, "peak_id", F.col("V").alias("_v"), F.explode(F.sequence(width - 1, width + 1)).alias("_bin"))
    joined = candidates.withColumn("_bin", width).join(refs, [*on, "_bin"]).withColumn("_d", F.abs(F.col("V") - F.col("_v")))
    return joined.where(F.col("_d") <= radius).withColumn("score", F.exp(-F.col("_d") / scale)).drop("_d", "_v", "_bin")


def best_links(soft: DataFrame) -> DataFrame:
    """The candidate of the best score for each cycle, leg and reference."""
    return soft.groupBy("cell_id", "cycle", "leg", "peak_id").agg(F.max_by("candidate", F.struct("score", "candidate")).alias("candidate"), F.max("score").alias("score"))


def rank_cycles(measures: DataFrame, k: int = 10, wanted_peaks: int = 3, least_points: int = 100, key: str = "cell_id") -> DataFrame:
    """``rank, quality, noise_ratio, hf_std, n_charge, n_discharge``: the k best cycles of each cell, lower quality first, ties to the earlier cycle.

    Measures (``curves.leg_noise``) of both legs are averaged: 3 times the noise, 0.15 of the high
    frequencies, 0.25 for each peak more or less than ``wanted_peaks``, and 5 where a leg has fewer
    than ``least_points``. A cycle that lacks a leg or its curve has no rank.
    """
    side = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    both = measures.where("noise_ratio is not null and hf_std is not null and n_peaks is not null and leg in ('charge', 'discharge')").groupBy(key, "cycle").agg(
        F.count_distinct("leg").alias("_legs"), F.min("n_points").alias("_points"), *((side("charge", c) + side("discharge", c)).alias(f"_{c}") for c in ("noise_ratio", "hf_std")),
        side("charge", "n_peaks").alias("n_charge"), side("discharge", "n_peaks").alias("n_discharge"),
    )
    rows = both.where("_legs = 2").withColumns({"noise_ratio": F.col("_noise_ratio") / 2, "hf_std": F.col("_hf_std") / 2})
    off = F.abs(F.col("n_charge") - wanted_peaks) + F.abs(F.col("n_discharge") - wanted_peaks)
    quality = 3.0 * F.col("noise_ratio") + 0.15 * F.col("hf_std") + 0.25 * off + F.when(F.col("_points") < least_points, 5.0).otherwise(0.0)
    order = Window.partitionBy(key).orderBy("quality", "cycle")
    ranked = rows.withColumn("quality", quality).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(key, "cycle", "rank", "quality", "noise_ratio", "hf_std", "n_charge", "n_discharge")


def largest_gaps(features: DataFrame, keys: Sequence[str] = ("cell_id", "cycle", "leg")) -> DataFrame:
    """``gap, gap_share, n_features, source``: the largest charge between neighbours in voltage of a curve's features.

    Features (keys, kind, V, Q, total) are ``valley`` of dV/dQ and ``peak`` of dQ/dV: valleys from two on
    count, else peaks, else nothing. The share is in per cent of the curve's charge. One
    window over each curve's few features.
    """
    step = F.lead("Q").over(Window.partitionBy(*keys, "kind").orderBy("V", "Q")) - F.col("Q")
    rows = features.where("kind in ('valley', 'peak') and V is not null and Q is not null").withColumn("_step", step)
    each = rows.groupBy(*keys, "kind").agg(F.max("_step").alias("_gap"), F.count("*").alias("_n"), F.max("total").alias("_total")).where("_n >= 2")
    best = each.groupBy(*keys).agg(F.max_by(F.struct("_gap", "_n", "_total", "kind"), "kind").alias("_b"))  # a valley stands behind a peak in the alphabet
    share = F.when(F.col("_b._total") > 0, 100 * F.col("_b._gap") / F.col("_b._total"))
    return best.select(*keys, F.col("_b._gap").alias("gap"), share.alias("gap_share"), F.col("_b._n").alias("n_features"), F.col("_b.kind").alias("source"))
