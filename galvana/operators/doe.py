"""Comparison of experiment arms, each a set of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions.expr import quantile, ratio, slope
from galvana.operators.score import to_long

KEYS = ("arm", "cell_id", "cycle")


def _differences(means: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The later arm's mean less the earlier one's for each pair of arms in order of name, and its percent. A row a mean: arms are few."""
    a = means.select("arm", *on, F.col("value").alias("_a"))
    b = means.select(F.col("arm").alias("_arm"), *on, F.col("value").alias("_b"))
    both = a.join(b, list(on)).where(F.col("arm") < F.col("_arm"))
    label = lambda kind: F.concat(F.lit(kind), "_arm", F.lit("-"), "arm").alias("arm")
    return both.select(label("delta:"), *on, (F.col("_b") - F.col("_a")).alias("value")), both.select(label("pct:"), *on, (ratio(F.col("_b") - F.col("_a"), F.abs("_a")) * 100).alias("value"))


def early_parameters(features: DataFrame, columns: Sequence[str], early_cycles: int = 30) -> DataFrame:
    """Arms' means of early cycles, and a delta and a percent row for each pair of arms.

    Early cycles are those up to ``early_cycles``; a cell without any gives its
    first five rows.
    """
    w = Window.partitionBy("arm", "cell_id")
    rows = features.withColumns({"_p": F.row_number().over(w.orderBy("cycle")), "_any": F.max((F.col("cycle") <= early_cycles).cast("int")).over(w)})
    early = rows.where(F.when(F.col("_any") == 1, F.col("cycle") <= early_cycles).otherwise(F.col("_p") <= 5))
    means = to_long(early, columns, KEYS).groupBy("arm", "feature").agg(F.avg("value").alias("value"))
    delta, percent = _differences(means, ["feature"])
    return means.unionByName(delta).unionByName(percent)


def early_fade(features: DataFrame, health: str = "SoHQ", early_cycles: int = 30) -> DataFrame:
    """Slope of health over early cycles of each cell (three rows or more), and arms' means as ``__arm_mean__``."""
    early = features.where((F.col("cycle") <= early_cycles) & F.col(health).isNotNull())
    cells = early.groupBy("arm", F.col("cell_id").cast("string").alias("cell_id")).agg(F.count("*").alias("n"), slope(health, "cycle", 3).alias("fade")).where("n >= 3")
    arms = cells.groupBy("arm").agg(F.lit("__arm_mean__").alias("cell_id"), F.sum("n").alias("n"), F.avg("fade").alias("fade"))
    return cells.unionByName(arms.select("arm", "cell_id", "n", "fade"))


def arm_trajectories(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Arms' means by cycle, and the differences of each pair of arms on shared cycles."""
    means = to_long(features, columns, KEYS).groupBy("arm", "cycle", "feature").agg(F.avg("value").alias("value"))
    return means.unionByName(_differences(means, ["cycle", "feature"])[0])


def late_spread(features: DataFrame, columns: Sequence[str], late: float = 0.2) -> DataFrame:
    """Spread of arms' late means by indicator, and the arms of the largest and smallest."""
    edge = features.agg(quantile("cycle", 1 - late)).scalar()
    rows = features.where(F.col("cycle") >= edge)
    means = to_long(rows, columns, KEYS).groupBy("feature", "arm").agg(F.avg("value").alias("m")).where("m is not null")
    return means.groupBy("feature").agg(
        F.count("*").alias("n_arms"),
        F.stddev_pop("m").alias("spread"),
        F.max_by("arm", F.struct("m", "arm")).alias("high_arm"),
        F.min_by("arm", F.struct("m", "arm")).alias("low_arm"),
    )


def arm_summary(features: DataFrame, columns: Sequence[str], late: float = 0.2) -> DataFrame:
    """Mean, late mean (by each arm's own quantile) and slope of each indicator and arm."""
    edges = features.groupBy("arm").agg(quantile("cycle", 1 - late).alias("_hi"))  # a row an arm
    rows = features.join(F.broadcast(edges), "arm")
    long = to_long(rows, columns, [*KEYS, "_hi"])
    return long.groupBy("arm", "feature").agg(F.avg("value").alias("mean"), F.avg(F.when(F.col("cycle") >= F.col("_hi"), F.col("value"))).alias("late_mean"), slope("value", "cycle").alias("slope"))


def phase_summary(diagnosed: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Means of mode scores by arm and third of life, and the largest mode (of equal ones the first)."""
    edges = diagnosed.groupBy("arm").agg(quantile("cycle", 0.33).alias("_a"), quantile("cycle", 0.66).alias("_b"))  # a row an arm
    rows = diagnosed.join(F.broadcast(edges), "arm")
    phase = F.when(F.col("cycle") <= F.col("_a"), "early").when(F.col("cycle") <= F.col("_b"), "mid").otherwise("late")
    found = rows.withColumn("phase", phase).groupBy("arm", "phase").agg(*(F.avg(m).alias(m) for m in modes))
    best = F.greatest(*(F.col(m) for m in modes)) if len(modes) > 1 else F.col(modes[0])
    top = F.lit(None).cast("string")
    for m in reversed(modes):
        top = F.when(F.col(m) == best, F.lit(m)).otherwise(top)
    return found.withColumn("top_mode", top)
