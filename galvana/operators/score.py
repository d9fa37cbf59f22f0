"""Track A: how far each row's indicators lie from an early reference, and screens over cycles and cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions.expr import at_most, clip, finite, pearson, quantile, ratio, slope
from galvana.operators import registry
from galvana.operators.order import quantiles

WATCH, ALERT = 0.55, 0.75


def to_long(table: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys, feature, value``: one row for each column; NaN and infinities become null."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    long = table.select(*keys, F.inline(F.array(*pairs)))
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    return long.withColumn("value", F.when(~bad, F.col("value")))


def _reference(table: DataFrame, columns: Sequence[str], keys: Sequence[str], early: float) -> DataFrame:
    """``keys`` and a struct of center and scale for each column: one row a group."""
    w = Window.partitionBy(*keys)
    rows = table.select(*keys, "cycle", *(finite(c).alias(c) for c in columns))
    rows = rows.withColumns({"_n": F.count("*").over(w), "_p": F.percentile("cycle", F.lit(early)).over(w)}).withColumn("_in", F.col("cycle") <= F.col("_p"))
    rows = rows.withColumn("_m", F.sum(F.col("_in").cast("int")).over(w)).where((F.col("_n") < 5) | (F.col("_m") < 3) | F.col("_in"))
    return rows.groupBy(*keys).agg(*(F.struct(F.median(c).alias("center"), F.stddev_samp(c).alias("scale")).alias(f"_ref_{c}") for c in columns))


def reference_stats(table: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("cell_id",), early: float = 0.2) -> DataFrame:
    """``feature, center, scale``: median and spread of the early rows, all of them where a group is small.

    Early rows have a cycle at or below the quantile; groups of fewer than 5 rows
    or of fewer than 3 early ones use all.
    """
    return _reference(table, columns, keys, early).select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"_ref_{c}.center"), F.col(f"_ref_{c}.scale")) for c in columns))))


def score_long(table: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("cell_id",), reference: DataFrame | None = None) -> DataFrame:
    """``keys, cycle, feature, value, z``: distances from the reference in its spreads; null where that is 0."""
    stats = reference if reference is not None else reference_stats(table, columns, keys)
    long = to_long(table, columns, [*keys, "cycle"]).join(stats, [*keys, "feature"], "left")
    return long.select(*keys, "cycle", "feature", "value", ratio(F.abs(F.col("value") - F.col("center")), "scale").alias("z"))


def score_rows(table: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("cell_id",), reference: DataFrame | None = None) -> DataFrame:
    """``indicator_score, indicator_n_scored, indicator_coverage, indicator_flag, indicator_top`` of each row.

    A row that is not complete is never ok but unknown, and one without any score too.
    """
    # Every group's reference is one row, so scores need no long table and no shuffle of their own.
    if reference is None:
        stats = _reference(table, columns, keys, 0.2)
    else:
        pair = F.struct("center", "scale")
        stats = reference.groupBy(*keys).agg(*(F.max(F.when(F.col("feature") == c, pair)).alias(f"_ref_{c}") for c in columns))
    joined = table.select(*keys, "cycle", *(finite(c).alias(c) for c in columns)).join(stats, list(keys), "left")
    z = F.array(*(F.struct((-ratio(F.abs(F.col(c) - F.col(f"_ref_{c}.center")), F.col(f"_ref_{c}.scale"))).alias("z"), F.lit(c).alias("feature")) for c in columns))
    scored = joined.select(*keys, "cycle", F.filter(z, lambda x: x["z"].isNotNull()).alias("_all")).select(
        *keys,
        "cycle",
        (-F.aggregate("_all", F.lit(0.0), lambda a, x: a + x["z"]) / F.nullif(F.size("_all"), F.lit(0))).alias("_z"),
        F.size("_all").cast("long").alias("indicator_n_scored"),
        F.slice(F.array_sort("_all"), 1, 3).alias("_top"),
    )
    score = clip(F.col("_z") / 3, 0.0, 1.0)
    flag = F.when(score >= ALERT, "alert").when(score >= WATCH, "watch").when((score.isNotNull()) & (F.col("indicator_n_scored") == len(columns)), "ok").otherwise("unknown")
    return scored.select(
        *keys,
        "cycle",
        F.when(F.col("_z").isNotNull(), score).alias("indicator_score"),
        "indicator_n_scored",
        (F.col("indicator_n_scored") / F.lit(len(columns))).alias("indicator_coverage"),
        flag.alias("indicator_flag"),
        F.array_join(F.transform("_top", lambda x: x["feature"]), ",").alias("indicator_top"),
    )


def predict(table: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("cell_id",), reference: DataFrame | None = None) -> DataFrame:
    """Row scores under the names of the prediction API."""
    return score_rows(table, columns, keys, reference).select(*keys, "cycle", F.col("indicator_score").alias("anomaly_score"), F.col("indicator_flag").alias("flag"), F.col("indicator_top").alias("top_features"))


def summarize(table: DataFrame, columns: Sequence[str], health: str, keys: Sequence[str] = ("cell_id",), early: float = 0.2) -> DataFrame:
    """One row for each indicator over all cells: coverage, correlations, early and late means, score."""
    edge = table.agg(F.struct(quantile("cycle", early).alias("_lo"), quantile("cycle", 1 - early).alias("_hi"))).scalar()
    long = score_long(table.select(*{*keys, "cycle", *columns, health}), columns, keys)
    healths = table.select(*keys, "cycle", F.col(health).cast("double").alias("_health"))
    rows = long.join(healths, [*keys, "cycle"]).withColumn("_edge", edge)
    first, last = F.col("cycle") <= F.col("_edge._lo"), F.col("cycle") >= F.col("_edge._hi")
    found = rows.groupBy("feature").agg(
        (F.count("value") / F.count("*")).alias("coverage"),
        pearson("value", "cycle").alias("r_cycle"),
        pearson("value", "_health").alias("r_health"),
        F.avg(F.when(first, F.col("value"))).alias("early_mean"),
        F.avg(F.when(last, F.col("value"))).alias("late_mean"),
        F.avg(F.when(last, F.col("z"))).alias("late_z"),
    )
    found = found.join(quantiles(to_long(table, columns, ()), ["feature"], name="median"), "feature", "left")
    relation = F.coalesce(F.abs("r_health"), F.abs("r_cycle") * 0.85, F.lit(0.0))
    return found.withColumn("score", F.greatest(relation, F.coalesce(clip(F.col("late_z") / 3, 0.0, 1.0), F.lit(0.0))))


def top_per_family(summary: DataFrame, by: str, n: int = 15, least: float = 0.35, column: str = "feature") -> DataFrame:
    """The n best rows at or above ``least`` (of all where none is), one of each family."""
    rows = summary.where(F.col(by).isNotNull()).withColumn("family", registry.family_column(column))
    any_high = rows.agg(F.coalesce(F.max(by) >= least, F.lit(False))).scalar()
    rows = rows.where(~any_high | (F.col(by) >= least))
    w = Window.partitionBy("family").orderBy(F.desc(by), column)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy(F.desc(by), column).limit(n)


def screen(table: DataFrame, columns: Sequence[str], health: str, keys: Sequence[str] = ("cell_id",), early: float = 0.2, least_coverage: float = 0.05) -> DataFrame:
    """Severity of each indicator's drift over the cycles of a cell.

    The larger of its correlation with health (or 0.85 of that with the cycle) and
    0.7 of its early to late change in spreads.
    """
    w = Window.partitionBy(*keys)
    rows = table.withColumns({"_lo": F.percentile("cycle", F.lit(early)).over(w), "_hi": F.percentile("cycle", F.lit(1 - early)).over(w)})
    long = to_long(rows.withColumn("_health", F.col(health).cast("double")), columns, [*keys, "cycle", "_lo", "_hi", "_health"])
    first, last = F.col("cycle") <= F.col("_lo"), F.col("cycle") >= F.col("_hi")
    found = long.groupBy(*keys, "feature").agg(
        (F.count("value") / F.count("*")).alias("coverage"),
        F.stddev_samp("value").alias("spread"),
        pearson("value", "cycle").alias("r_cycle"),
        pearson("value", "_health").alias("r_health"),
        (F.avg(F.when(last, F.col("value"))) - F.avg(F.when(first, F.col("value")))).alias("change"),
        slope("value", "cycle").alias("slope"),
    )
    found = found.where((F.col("coverage") >= least_coverage) & (F.col("spread") >= 1e-12))
    relation = F.coalesce(F.abs("r_health"), F.abs("r_cycle") * 0.85, F.lit(0.0))
    moved = F.lit(0.7) * at_most(F.abs(ratio("change", "spread")), 1.0)
    return found.withColumn("severity", F.greatest(relation, F.coalesce(moved, F.lit(0.0))))


def compare_cells(table: DataFrame, columns: Sequence[str], late: float = 0.2) -> DataFrame:
    """How far cells differ late in life, by indicator.

    The spread of cells' means in each late cycle, its mean and relation to the
    cycle, the range of cells' means, and a score of both as average ranks.
    """
    edge = table.agg(quantile("cycle", 1 - late)).scalar()
    rows = table.where(F.col("cycle") >= edge)
    by_cell = to_long(rows, columns, ["cell_id", "cycle"]).groupBy("feature", "cycle", "cell_id").agg(F.avg("value").alias("value"))
    spread = by_cell.groupBy("feature", "cycle").agg(F.stddev_samp("value").alias("s")).groupBy("feature").agg(F.avg("s").alias("mean_spread"), pearson("s", "cycle").alias("r_spread_cycle"))
    cells = by_cell.groupBy("feature", "cell_id").agg(F.avg("value").alias("m")).groupBy("feature").agg((F.max("m") - F.min("m")).alias("cell_range"), F.count("m").alias("n_cells"))
    found = spread.join(cells, "feature").where("mean_spread is not null")

    def share(c: str):
        """Rank with ties averaged, as a share."""
        return (F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2) / F.count("*").over(Window.partitionBy())

    # One row for each indicator: a single partition is enough.
    return found.withColumn("score", 0.5 * share("mean_spread") + 0.5 * share("cell_range"))


def peak_columns(names: Sequence[str]) -> list[str]:
    return [c for c in names if registry.parse_peak(c)]


def screen_peaks(table: DataFrame, health: str, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """The screen on peak columns, with leg, kind, peak and metric, and severity raised by shifts of voltages."""
    columns = peak_columns(table.columns)
    parts = {c: registry.parse_peak(c) for c in columns}
    found = screen(table, columns, health, keys)
    pick = lambda k: F.create_map(*[F.lit(x) for c in columns for x in (c, str(parts[c][k]))])[F.col("feature")]
    found = found.withColumns({name: pick(k) for k, name in enumerate(("leg", "kind", "peak", "metric"))})
    shift_mv = F.when(F.col("metric") == "V", F.col("change") * 1000)
    raised = F.greatest("severity", F.coalesce(at_most(F.abs(shift_mv) / 50, 1.0), F.lit(0.0)))
    return found.withColumns({"slope_per_100": F.col("slope") * 100, "shift_mv": shift_mv, "severity": raised})
