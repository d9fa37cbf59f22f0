"""Turns of a series, noise on a common axis, ranks, gaps and the cache of features, against plain code."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvana.functions import turns
from galvana.operators import curves, peaks, registry
from galvana.sources import cache


def series(n=200, noise=0.0, seed=0):
    """Health that falls by 0.01, then 0.05, then 0.2 a cycle."""
    x = np.arange(n, dtype=float)
    y = 100 - 0.01 * x - 0.04 * np.maximum(0, x - 80) - 0.15 * np.maximum(0, x - 150)
    return x, y + np.random.default_rng(seed).normal(0, noise, n)


def test_turns_stand_at_planted_breaks():
    x, y = series(noise=0.02)
    found = turns.turns(x, y)
    assert len(found["places"]) == 2 and abs(found["places"][0] - 80) <= 8 and abs(found["places"][1] - 150) <= 5
    even = [np.mean(y[max(0, k - 5) : k + 6]) for k in range(200)]
    assert np.allclose(found["even"], even) and np.allclose(found["fade"], np.gradient(even, x) * 100)
    squares = lambda a, b: float(((np.polyval(np.polyfit(x[a:b], found["even"][a:b], 1), x[a:b]) - found["even"][a:b]) ** 2).sum())
    best = min(squares(0, a) + squares(a, b) + squares(b, 200) for a in range(40, 121) for b in range(a + 40, 161))
    a, b = found["places"]
    assert squares(0, a) + squares(a, b) + squares(b, 200) == pytest.approx(best, rel=1e-6)
    assert len(turns.turns(x, y, breaks=1)["places"]) == 1 and turns.turns(x, np.full(200, 5.0))["places"]  # the first break always counts
    assert turns.turns(x[:60], y[:60]) is None


def test_curvature_steps_in_where_no_break_fits():
    x, y = series()
    assert turns.turns(x[:80], y[:80])["places"] == turns.turns(x[:80], y[:80], method="piecewise")["places"] != []
    assert any(k in range(143, 158) for k in turns.turns(x, y, method="curvature", breaks=3)["places"])  # the ends of a smoothed series bend, too
    bumps = np.zeros(60)
    bumps[[10, 30, 33, 50]] = [3, -5, 4, 2]
    assert turns.curvature_peaks(bumps, 3, 5) == [10, 30, 50] and turns.curvature_peaks(bumps, 1, 5) == [30] and turns.curvature_peaks(bumps[:4], 2, 1) == []
    assert turns.centred_mean(np.array([1.0, 2.0]), 11).tolist() == [1, 2]


def test_turning_points_and_regimes_of_tables(spark):
    rows = [(1, float(c), float(h)) for c, h in zip(*series(noise=0.02), strict=True)] + [(2, float(c), 90.0) for c in range(30)] + [(1, 500.0, None)]
    found = sorted(curves.turning_points(spark.createDataFrame(rows, "cell_id int, cycle double, SoHQ double")).collect(), key=lambda r: r["regime"])
    assert [r["cell_id"] for r in found] == [1, 1, 1] and found[2]["fade_after"] is None and found[2]["cycle"] == 199
    assert [r["slope"] for r in found] == pytest.approx([-1, -5, -20], rel=0.2) and found[0]["delta_fade"] < 0


def test_noise_of_both_derivatives_on_one_axis(spark):
    rng = np.random.default_rng(0)
    q = np.sort(rng.uniform(0, 50, 400))
    v = 4.2 - 0.02 * q + rng.normal(0, 0.002, 400)
    table = spark.createDataFrame([(1, 1, "discharge", k, float(a), float(b)) for k, (a, b) in enumerate(zip(q, v, strict=True))] + [(2, 1, "discharge", 0, 1.0, 3.0)], "cell_id int, cycle int, leg string, row_id int, capacity double, voltage double")
    lines = curves.noise_curves(table)
    one = lines.where("cell_id = 1").first()
    x, a, b = (np.array(one[c]) for c in ("v", "dqdv", "dvdq"))
    assert len(x) == 500 and np.allclose(a * b, 1, rtol=0.2)
    edges = np.linspace(x.min(), x.max(), 6)
    spread = []
    for y in (a, b):
        bins = [y[(x > lo if k else x >= lo) & (x <= hi)] for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
        cv = [p.std() / (np.abs(p).mean() + 1e-12) for p in bins if len(p) >= 10]
        spread.append(np.std(cv) / (np.mean(cv) + 1e-12))
    found = curves.noise_uniformity(lines).collect()
    assert len(found) == 1 and [found[0]["dqdv_spread"], found[0]["dvdq_spread"]] == pytest.approx(spread, rel=1e-6)
    assert found[0]["dvdq_more_uniform"] == (spread[1] < spread[0])
    noise = {r["cell_id"]: r for r in curves.leg_noise(table).collect()}
    assert noise[1]["noise_ratio"] > 0 and noise[1]["n_points"] == 400 and noise[2]["n_peaks"] is None


def test_ranks_and_gaps(spark):
    legs = [(1, c, leg, noise, 1.0, n, pts) for c, noise, n, pts in ((1, 0.1, 3, 200), (2, 0.05, 3, 200), (3, 0.01, 3, 50), (4, 0.05, 3, 200)) for leg in ("charge", "discharge")] + [(1, 5, "charge", 0.0, 0.0, 3, 500)]
    found = peaks.rank_cycles(spark.createDataFrame(legs, "cell_id int, cycle int, leg string, noise_ratio double, hf_std double, n_peaks int, n_points int"), k=3).orderBy("rank").collect()
    assert [r["cycle"] for r in found] == [2, 4, 1] and found[0]["quality"] == pytest.approx(0.15 + 0.15)
    rows = [(1, "valley", 3.5, 1.0), (1, "valley", 3.6, 4.0), (1, "valley", 3.9, 6.0), (1, "peak", 3.5, 0.0), (1, "peak", 3.7, 9.0), (2, "valley", 3.5, 1.0), (2, "peak", 3.5, 1.0), (2, "peak", 3.6, 2.5), (3, "peak", 3.5, 1.0), (3, None, 3.6, 1.0)]
    gaps = {r["cell_id"]: r for r in peaks.largest_gaps(spark.createDataFrame([(*r, 10.0) for r in rows], "cell_id int, kind string, V double, Q double, total double"), ["cell_id"]).collect()}
    assert set(gaps) == {1, 2} and (gaps[1]["gap"], gaps[1]["source"], gaps[1]["gap_share"]) == (3.0, "valley", 30.0) and (gaps[2]["gap"], gaps[2]["source"]) == (1.5, "peak")


def test_families_in_the_jvm_are_those_of_the_names(spark):
    names = [*(m for f in registry.FAMILIES.values() for m in f), *registry.ALIASES, "x", "_inc", "delta_delta_hyst_area", "SoHQ_inc", "delta_CI_inc", "delta_ocv_spread_slope", "R_SOC_diff_20_80_inc", "delta_R_SOC_diff_20_80", None]
    found = spark.createDataFrame([(n,) for n in names], "feature string").select("feature", registry.family_column("feature").alias("f")).collect()
    assert all(r["f"] == (registry.family_of(r["feature"]) if r["feature"] is not None else None) for r in found)


def test_cache_reads_changed_files_alone(spark, tmp_path):
    raw, store, read = tmp_path / "raw", str(tmp_path / "store"), []
    raw.mkdir()

    def write(cell, value):
        (raw / f"{cell}_raw.csv").write_text("cycle,q\n" + "".join(f"{c},{value + c}\n" for c in range(3)))

    def extract(paths):
        read.append(sorted(p.rsplit("/", 1)[-1] for p in paths))
        rows = spark.read.option("header", True).csv(paths)
        return rows.select(F.regexp_extract("_metadata.file_path", r"(M\d+Ch\d+)", 1).alias("cell_id"), F.col("cycle").cast("int").alias("cycle"), F.col("q").cast("double").alias("q"))

    def run():
        table = cache.update(spark, [str(raw)], store, extract)
        return {(r["cell_id"], r["cycle"]): r["q"] for r in table.collect()}

    for k in (1, 2, 3):
        write(f"M01Ch00{k}", 10 * k)
    first = run()
    assert len(first) == 9 and read == [["M01Ch001_raw.csv", "M01Ch002_raw.csv", "M01Ch003_raw.csv"]]
    assert run() == first and len(read) == 1  # nothing changed: nothing is read
    time.sleep(1.1)
    write("M01Ch002", 500)
    write("M01Ch003", 30)  # touched, with the same lines
    second = run()
    assert read[1:] == [["M01Ch002_raw.csv"]] and second == first | {("M01Ch002", c): 500.0 + c for c in range(3)}
    (raw / "M01Ch001_raw.csv").unlink()
    third = run()
    assert len(read) == 2 and {k[0] for k in third} == {"M01Ch002", "M01Ch003"}
    assert len(cache._versions(spark, store)) == 3 and not math.isnan(third["M01Ch003", 1])
