"""Names of peaks learnt from good cycles, and which peaks of slow tests a faster routine cycle blurs into one.

Golden peaks of all cells together give centroids (medians, with a window of robust
width) and one forest a leg over V, H, |H| and log(1 + |H|). Candidates are matched one
to one with the centroids at a cost that a forest's probability lowers. For the
overlap, peaks of tests and the routine peaks nearest to where the tests' peaks are
expected teach forests that also see the rate; a routine peak's score for a test's
peak joins the forest's probability and the distance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvana.operators import curves, forest, peaks
from galvana.operators.order import quantiles
from galvana.shared import cut

#: Window half-width in robust deviations and its bounds in volts; share of the cost that probability 1 takes off.
WINDOW_SIGMA, WINDOW_LEAST, WINDOW_MOST, FOREST_SHARE = 2.0, 0.03, 0.06, 0.5
#: Rates of tests and routine cycles, radius of a soft match in volts, cycles around a test that teach, weights of probability and distance.
TEST_RATE, ROUTINE_RATE, SOFT_RADIUS, HARD_ZONE, FOREST_WEIGHT, DISTANCE_WEIGHT = 0.33, 0.5, 0.12, 10, 0.55, 0.45
FEATURES = ("V", "H", "H_abs", "H_log")


def peak_features(table: DataFrame) -> DataFrame:
    """Add |H| and log(1 + |H|)."""
    return table.withColumns({"H_abs": F.abs("H"), "H_log": F.log1p(F.abs("H"))})


def centroids(long: DataFrame) -> DataFrame:
    """``leg, peak_id, V, H, H_abs, v_lo, v_hi, n_ref``: medians of golden peaks (leg, peak_id, V, H).

    The window's half-width is twice the scaled median deviation in V (the population's
    deviation where that is 0), held between 0.03 and 0.06 V.
    """
    on = ["leg", "peak_id"]
    rows = peak_features(long.where("leg is not null and peak_id is not null").select(*on, "V", "H"))
    out = rows.groupBy(*on).agg(F.count("*").alias("n_ref"), F.stddev_pop("V").alias("_std"))
    for c in ("V", "H", "H_abs"):
        out = out.join(quantiles(rows.select(*on, c), on, c, name=c), on, "left")
    off = rows.join(out.select(*on, F.col("V").alias("_m")), on).select(*on, F.abs(F.col("V") - F.col("_m")).alias("_off"))
    out = out.join(quantiles(off, on, "_off", name="_mad"), on, "left")
    spread = F.coalesce(*(F.nullif(F.col(c), F.lit(0.0)) for c in ("_mad", "_std")), F.lit(WINDOW_LEAST))
    half = F.greatest(F.lit(WINDOW_LEAST), F.least(F.lit(WINDOW_MOST), WINDOW_SIGMA * 1.4826 * spread))
    return out.select(*on, "V", "H", "H_abs", (F.col("V") - half).alias("v_lo"), (F.col("V") + half).alias("v_hi"), "n_ref")


def train_labels(long: DataFrame, good: DataFrame | None = None, settings: forest.Settings | None = None) -> tuple[DataFrame, forest.Forests]:
    """Centroids and a forest for each leg from peaks (cell_id, cycle, leg, peak_id or band, V, H) of any number of cells.

    ``good`` (cell_id, cycle) names the golden cycles; where a column ``usable_leg`` leaves none of their rows, all of them count.
    """
    rows = long.withColumnRenamed("band", "peak_id") if "peak_id" not in long.columns else long
    if good is not None:
        rows = rows.join(good.select("cell_id", "cycle").distinct(), ["cell_id", "cycle"], "left_semi")
    if "usable_leg" in rows.columns:
        some = rows.where("usable_leg")
        rows = some if not some.isEmpty() else rows
    rows = rows.where("peak_id is not null")
    return centroids(rows), forest.train(peak_features(rows), FEATURES, "peak_id", ["cell_id", "cycle", "leg", "peak_id", "V", "H"], "leg", settings)


def with_probabilities(candidates: DataFrame, forests: forest.Forests) -> DataFrame:
    """Candidates (leg, V, H) with ``proba``, each name's probability."""
    seen = peak_features(candidates)
    return seen.withColumn("proba", forest.probabilities(forests, seen)).drop("H_abs", "H_log")


def assign(candidates: DataFrame, refs: DataFrame, forests: forest.Forests, keys: Sequence[str] = curves.LEG, most: float = 0.12) -> DataFrame:
    """Candidates of each leg matched one to one with centroids: ``peak_id, V, H, cost, probability, confidence``.

    The cost is (|dV| + 0.015 |dH|)(1 - p / 2), and confidence 1 less its share of ``most``.
    """
    return curves.assign_peaks(with_probabilities(candidates, forests), refs, keys, most, FOREST_SHARE)


def overlap_rows(tests: DataFrame, expected: DataFrame, candidates: DataFrame, near: DataFrame, radius: float = SOFT_RADIUS) -> DataFrame:
    """``source, cell_id, life, cycle, leg, peak_id, V, H, rate_c, V_expected``: labelled rows of tests and of routine cycles near them.

    ``tests`` are peaks of tests' cycles (cell_id, life, cycle, leg, peak_id, V, H), ``expected`` where
    routine cycles should show them (cell_id, life, leg, peak_id, V), ``candidates`` all peaks of
    routine cycles (cell_id, cycle, leg, V, H) and ``near`` the routine cycles of each test (cell_id, life, cycle).
    In order of expected voltage each of a test's peaks takes the nearest candidate that is left, within
    the radius. A leg's peaks are few: they meet in one row, and all rows count.
    """
    on = ["cell_id", "life", "leg"]
    found = candidates.groupBy("cell_id", "cycle", "leg").agg(F.array_sort(F.collect_list(F.struct("V", "H"))).alias("_c"))
    found = found.withColumn("_c", F.transform("_c", lambda x, i: F.struct(i.alias("i"), x["V"].alias("V"), x["H"].alias("H"))))
    wanted = expected.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("V", "peak_id"))).alias("_r"))
    kind = "array<struct<peak_id:string,V:double,H:double,V_expected:double>>"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(kind).alias("out"))

    def take(state: Column, ref: Column) -> Column:
        free = F.filter("_c", lambda c: ~F.array_contains(state["used"], c["i"]))
        best = F.array_min(F.transform(free, lambda c: F.struct(F.abs(c["V"] - ref["V"]).alias("d"), c["i"].alias("i"), c["V"].alias("V"), c["H"].alias("H"))))
        fits = F.coalesce(best["d"] <= radius, F.lit(False))
        row = F.struct(ref["peak_id"].alias("peak_id"), best["V"].alias("V"), best["H"].alias("H"), ref["V"].alias("V_expected"))
        return F.struct(
            F.when(fits, F.concat(state["used"], F.array(best["i"]))).otherwise(state["used"]).cast("array<int>").alias("used"),
            F.when(fits, F.concat(state["out"], F.array(row).cast(kind))).otherwise(state["out"]).cast(kind).alias("out"),
        )

    matched = near.join(found, ["cell_id", "cycle"]).join(wanted, on).withColumn("_m", F.aggregate("_r", start, take)["out"])
    columns = ["cell_id", "life", "cycle", "leg", "peak_id", "V", "H", "rate_c", "V_expected"]
    routine = matched.select(F.lit("routine_0p5").alias("source"), *on, "cycle", F.inline("_m")).withColumn("rate_c", F.lit(ROUTINE_RATE))
    slow = tests.where("peak_id is not null").withColumns({"source": F.lit("rpt_0p33"), "rate_c": F.lit(TEST_RATE), "V_expected": F.col("V")})
    return slow.select("source", *columns).unionByName(routine.select("source", *columns))


def near_cycles(lives: DataFrame, routine: DataFrame, half: int = HARD_ZONE) -> DataFrame:
    """``cell_id, life, cycle``: routine cycles (cell_id, cycle) within ``half`` of a test (cell_id, life)."""
    around = lives.select("cell_id", "life").distinct().withColumn("cycle", F.explode(F.sequence(F.col("life") - half, F.col("life") + half)))
    return around.join(routine.select("cell_id", "cycle").distinct(), ["cell_id", "cycle"])


def train_overlap(rows: DataFrame, settings: forest.Settings | None = None) -> forest.Forests:
    """A forest for each leg of two names and eight rows or more, over peak and rate."""
    s = settings or forest.Settings(trees=160, least=2, least_rows=8)
    return forest.train(peak_features(rows), (*FEATURES, "rate_c"), "peak_id", ["cell_id", "life", "cycle", "leg", "peak_id", "source", "V", "H"], "leg", s)


def soft_map(candidates: DataFrame, expected: DataFrame, forests: forest.Forests, radius: float = SOFT_RADIUS) -> DataFrame:
    """Every candidate (cell_id, life, cycle, leg, candidate, V, H) against every expected peak of its test's leg.

    ``geom_score`` is e^(-|dV| / radius), 0 beyond one and a half radii; ``score`` is 0.55 of the
    forest's probability and 0.45 of that. A leg's peaks are few and travel as one row.
    """
    on = ["cell_id", "life", "leg"]
    seen = with_probabilities(candidates.withColumn("rate_c", F.lit(ROUTINE_RATE)), forests)
    refs = expected.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("peak_id", F.col("V").alias("V_expected")))).alias("_r"))
    pairs = seen.join(refs, on).select(*on, "cycle", "candidate", "V", "H", "proba", F.inline("_r"))
    off = F.col("V") - F.col("V_expected")
    near = F.when(F.abs(off) <= 1.5 * radius, F.exp(-F.abs(off) / radius)).otherwise(0.0)
    p = F.coalesce(F.try_element_at("proba", "peak_id"), F.lit(0.0))
    scored = pairs.withColumns({"delta_v": off, "geom_score": near, "rf_proba": p})
    return scored.withColumn("score", FOREST_WEIGHT * F.col("rf_proba") + DISTANCE_WEIGHT * F.col("geom_score")).drop("proba")


def overlap(tests: DataFrame, expected: DataFrame, candidates: DataFrame, routine: DataFrame, settings: forest.Settings | None = None) -> dict[str, DataFrame]:
    """``training, soft, collapses, links``: the whole overlap of tests (at their life) and routine cycles."""
    near = near_cycles(tests, routine)
    rows = cut(overlap_rows(tests, expected, candidates, near), "overlap")  # each step of a forest reads them
    soft = soft_map(candidates.join(near, ["cell_id", "cycle"]), expected, train_overlap(rows, settings))
    return {"training": rows, "soft": soft, "collapses": peaks.collapses(soft), "links": peaks.best_links(soft)}
