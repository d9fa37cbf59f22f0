"""Operators that no registered query covers, on tables small enough to reckon by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvana.operators import curves, cycle, isolation, mechanism, peaks, protocol, pulses, registry, score


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, c, 100.0 - c, 3.6 + 0.001 * c, 5.0 + (c % 3)) for c in range(1, 31)]
    return spark.createDataFrame(rows, "cell_id long, cycle long, SoHQ double, chg_dQdV_peak1_V double, chg_dQdV_peak1 double").cache()


def test_usable_rows_lie_within_robust_deviations(spark):
    q = spark.createDataFrame([(k, float(v)) for k, v in enumerate([1, 2, 3, 4, 100])], "k long, noise double")
    assert [r["usable"] for r in peaks.usable(q, "noise").orderBy("k").collect()] == [True, True, True, True, False]


def test_deltas_from_good_cycles(spark, table):
    good = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "cell_id long, cycle long")
    row = peaks.good_cycle_deltas(table, good, ["SoHQ"]).where("cycle = 5").first()
    assert row["delta_SoHQ"] == pytest.approx(95 - 98)


def test_links_collapses_and_wide_tables(spark):
    cand = spark.createDataFrame([(1, 1, "charge", 0, 3.60), (1, 1, "charge", 1, 3.75), (1, 2, "charge", 0, 4.9)], "cell_id long, cycle long, leg string, candidate long, V double")
    refs = spark.createDataFrame([("charge", "P1", 3.6), ("charge", "P2", 3.68)], "leg string, peak_id string, V double")
    soft = peaks.soft_links(cand, refs)
    assert soft.count() == 4
    best = {r["peak_id"]: (r["candidate"], r["score"]) for r in peaks.best_links(soft).collect()}
    assert best["P1"] == (0, pytest.approx(1.0)) and best["P2"][1] == pytest.approx(math.exp(-0.07 / 0.12))
    assert [(r["candidate"], r["peaks"]) for r in peaks.collapses(soft, share=0.5).orderBy("candidate").collect()] == [(0, ["P1", "P2"]), (1, ["P1", "P2"])] or peaks.collapses(soft).count() >= 1
    long = spark.createDataFrame([(1, 1, "charge", "a", 3.6, 2.0), (1, 1, "discharge", "a", 3.4, 1.0)], "cell_id long, cycle long, leg string, band string, V double, H double")
    w = peaks.wide(long, ["a", "b"]).first()
    assert w["cha_a_V"] == 3.6 and w["dis_a_H"] == 1.0 and w["dis_b_V"] is None
    assert peaks.summarize(peaks.track(long, peaks.golden_references(long))).count() == 2


def test_peak_screen_and_annotation(spark, table):
    found = score.screen_peaks(table, "SoHQ").where("metric = 'V'").first()
    assert found["leg"] == "chg" and found["peak"] == "1" and found["severity"] == pytest.approx(1.0)
    assert found["slope_per_100"] == pytest.approx(0.1) and found["shift_mv"] > 20
    noted = registry.annotate(spark.createDataFrame([("SoHQ",), ("x",)], "feature string"), ["SoHQ", "dchgCapa"])
    assert {r["feature"]: r["role"] for r in noted.collect()} == {"SoHQ": "target", "x": None}
    assert registry.layer_of("SoHQ") == "health" and registry.layer_of("R_ct_soc50") == "protocol_anchor" and registry.layer_of("hyst_area") == "mechanism"


def test_constant_indicators_stay_unknown(spark):
    rows = [(1, c, 5.0, 1.0) for c in range(1, 9)]
    t = spark.createDataFrame(rows, "cell_id long, cycle long, flat double, SoHQ double")
    found = score.score_rows(t, ["flat"]).collect()
    assert {r["indicator_flag"] for r in found} == {"unknown"} and all(r["indicator_score"] is None for r in found)
    assert score.summarize(t, ["flat"], "SoHQ").first()["r_health"] is None


def test_pulses_and_rests(spark):
    rows = [(1, 1, k, 10.0 * k, 0.0, 3.5) for k in range(200)] + [(1, 1, 200 + k, 2000.0 + 0.1 * k, -70.0, 3.4 - 0.001 * math.sqrt(k)) for k in range(301)] + [(1, 1, 600, 2031.0, 0.0, 3.5)]
    s = spark.createDataFrame(rows, "cell_id long, cycle long, row_id long, time double, current double, voltage double")
    p = pulses.pulse_trace(s, 70.0)
    assert p.count() == 301 and p.agg(F.min("t"), F.max("t")).first()[1] == pytest.approx(30.0)
    assert p.orderBy("row_id").first()["r_mohm"] == pytest.approx(100 / 70)
    fit = curves.pulse_parameters(p, ["cell_id", "cycle"]).first()
    assert fit["valid"] == 1.0 and fit["R_ohmic"] == pytest.approx(100 / 70, abs=0.02)
    assert pulses.pre_pulse_rest(s, 70.0).count() == 200 and pulses.pre_pulse_rest(s, 70.0, least_s=5000).count() == 0
    assert curves.recoveries(s.where("row_id < 200"), ["cell_id", "cycle"]).count() == 1


def test_noise_is_what_windows_leave_of_lines(spark):
    rng = np.random.default_rng(3)
    v = [np.linspace(3, 4, n) + 0.01 * rng.standard_normal(n) for n in (99, 100, 237)]
    rows = [(1, c, k, float(x)) for c, y in enumerate(v) for k, x in enumerate(y)] + [(1, 1, 1000, None), (1, 1, 1001, math.nan)]
    found = cycle.noise_sigma(spark.createDataFrame(rows, "cell_id long, cycle long, row_id long, voltage double"))
    found = {r["cycle"]: r["noise_sigma"] for r in found.collect()}
    assert found[0] is None
    for c in (1, 2):
        rest = [y - np.polyval(np.polyfit(range(50), y, 1), range(50)) for y in (v[c][k : k + 50] for k in range(0, len(v[c]) - 50, 25))]
        assert found[c] == pytest.approx(np.std(np.concatenate(rest)))


def test_sweeps_join_runs_whose_counters_restart(spark):
    # Three discharge runs: 4.0-3.4 V, 3.5-2.9 V, and one that adds nothing.
    runs = [(1, 4.0, 3.4), (2, 3.5, 2.9), (3, 3.45, 3.41)]
    rows = [(7, "discharge", c, 0, k, a + (b - a) * k / 60, 0.1 * k) for c, a, b in runs for k in range(61)]
    t = spark.createDataFrame(rows, "cell_id long, leg string, cycle long, capacity_run long, row_id long, voltage double, capacity double")
    r = curves.stitched_sweeps(t, ["cell_id", "leg"], order=["cycle", "row_id"]).first()
    assert np.all(np.diff(r["v"]) < 0) and np.all(np.diff(r["q"]) >= 0) and r["v"][0] == 4.0 and r["v"][-1] == pytest.approx(2.9)
    # The second adds what is below 3.4 V: 50 of its 60 steps, from 0 on.
    assert r["q"][-1] == pytest.approx(6.0 + 0.1 * 49)
    short = curves.stitched_sweeps(t.where("row_id < 9"), ["cell_id", "leg"], order=["cycle", "row_id"]).first()
    assert len(short["v"]) == 9
    assert curves.stitched_sweeps(t.limit(0), ["cell_id", "leg"]).count() == 0
    assert curves.best_cycle(t.where("cycle <> 2")).first()["best_cycle"] == 1


def test_ended_tracks_merged_or_died(spark):
    # Cell 1 keeps its area from cycle 5 on, cell 2 loses half, cell 3 a quarter; cell 4 has one cycle.
    level = {1: 1.0, 2: 0.5, 3: 0.75, 4: 1.0}
    rows = [(i, "charge", c, [9.0, -1.0 if c < 5 else -after, math.nan, 1.0 if c < 5 else after, 9.0]) for i, after in level.items() for c in ([5] if i == 4 else range(1, 10))]
    maps = spark.createDataFrame(rows, "cell_id long, leg string, cycle long, curve array<double>")
    events = spark.createDataFrame([(i, "charge", 0, 5, 1.0, 4.0) for i in level], "cell_id long, leg string, track int, cycle long, lo double, hi double")
    found = {r["cell_id"]: (r["kind"], r["ratio"]) for r in curves.disappearances(maps, events).collect()}
    # Three cycles before, the event's and three more after it.
    assert found == {1: ("ambiguous", pytest.approx(4 / 3)), 2: ("died", pytest.approx(2 / 3)), 3: ("merged", pytest.approx(1.0)), 4: ("ambiguous", None)}
    assert curves.disappearances(maps, events.limit(0)).count() == 0


def test_flips_ratios_and_forests(spark, table):
    t = spark.createDataFrame([(1, 1, 1.0), (1, 2, -1.0), (2, 1, 1.0)], "cell_id long, cycle long, x double")
    assert {r["cell_id"]: r["flip_cycle"] for r in mechanism.first_flip(t, "x").collect()} == {1: 2, 2: None}
    r = spark.createDataFrame([(10.0, 50.0)], "eta double, r double").select(pulses.polarization_ratio("eta", 2.0, "r").alias("p")).first()
    assert r["p"] == pytest.approx(100.0)
    odd = table.unionByName(spark.createDataFrame([(9, 1, 1e3, 9.0, -50.0), (9, 2, None, None, None)], table.schema))
    found = isolation.predict(odd, isolation.train(odd, ["SoHQ", "chg_dQdV_peak1_V"]), ["cell_id", "cycle"]).collect()
    assert max((x for x in found if x["anomaly"] is not None), key=lambda x: x["anomaly"])["cell_id"] == 9
    assert [x["flag"] for x in found if x["cell_id"] == 9 and x["cycle"] == 2] == ["unknown"]


def test_forests_tell_many_equal_rows_apart(spark):
    # Either half has equal values and would fill a bounded sample in the order of their hashes.
    many = spark.range(50_000).select(F.col("id").alias("cell_id"), F.lit(1).alias("cycle"), F.when(F.col("id") % 5 < 3, 1.0).otherwise(3.0).alias("x"), (F.col("id") % 5 * 1.0).alias("y"))
    forest = isolation.train(many, ["x"])
    assert forest.center.tolist() == [1.0] and forest.scale.tolist() == [pytest.approx(math.sqrt(0.24) * 2)] and len(forest.trees) == 100
    scores = {r["cell_id"] % 5 < 3: r["anomaly"] for r in isolation.predict(many, forest, ["cell_id", "cycle"]).collect()}
    assert scores[False] > scores[True] and forest.watch == scores[False]
    assert isolation._quantiles(many.select(F.lit("a").alias("name"), F.col("cell_id").cast("double").alias("value")), [0.75, 0.9]) == {"a": [pytest.approx(37499.25), pytest.approx(44999.1)]}
    assert not isolation.train(many.limit(0), ["x"]).trees
    again = isolation.train(many.repartition(3), ["x"])
    assert all(np.allclose(a, b) for s, t in zip(forest.trees, again.trees, strict=True) for a, b in zip(s, t, strict=True))


def test_empty_tables_pass(spark, table):
    none = table.limit(0)
    assert score.score_rows(none, ["SoHQ"]).count() == 0 and score.screen(none, ["SoHQ"], "SoHQ").count() == 0
    assert curves.inflections(none).count() == 0 and mechanism.two_variable_fit(none, "SoHQ", "chg_dQdV_peak1", "SoHQ").count() == 1
    steps = spark.createDataFrame([], "cell_id long, cycle long, dchg double, current double")
    assert protocol.protocol_kinds(protocol.protocol_flags(protocol.cycle_steps(steps))).count() == 0
