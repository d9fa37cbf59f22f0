"""Cells made by hand, from samples to wide rows, pulses, recoveries, ridges and anchors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvana import api
from galvana.functions import pulse, ridges
from galvana.operators import anchors, cycle, dcir, diagnose, evolution, mechanism, protocol, recovery, rests, segment, tools, wide
from galvana.sources import cycler

SAMPLES = "cell_id string, cycle long, row_id long, time double, step_time double, step_type string, current double, voltage double, capacity double"


def one_cycle(rows, cell, number, scale=1.0, sag=0.0, n=60, rest=130):
    """A charge, a rest, a discharge and a rest with relaxations of 200 s; one sample every 30 s."""
    t = rows[-1][3] + 30 if rows else 0.0
    for leg, count, current in (("charge", n, 2.0), ("rest", rest, 0.0), ("discharge", n, -2.0), ("rest", rest, 0.0)):
        after = next((r[5] for r in reversed(rows) if r[5] != "rest"), "charge")
        for k in range(count):
            x = k / (count - 1)
            if leg == "charge":
                v, q = 3.0 + 1.2 * x, 10 * x * scale
            elif leg == "discharge":
                v, q = 4.1 - sag - 1.3 * x - 0.2 * x**8, 9.5 * x * scale
            else:
                v, q = (4.15 + 0.05 * math.exp(-k * 30 / 200) if after == "charge" else 3.25 - 0.05 * math.exp(-k * 30 / 200)), 0.0
            rows.append((cell, number, len(rows), t, 30.0 * k, leg, current, v, q))
            t += 30


@pytest.fixture(scope="module")
def cell(spark):
    rows = []
    for c in range(1, 4):
        one_cycle(rows, "A", c, 1 - 0.02 * (c - 1), 0.01 * (c - 1))
    return spark.createDataFrame(rows, SAMPLES).repartition(3).cache()


def test_rests_have_voltages_or_reasons(spark, cell):
    kinds = segment.with_kind(cell)
    found = {(r["after_leg"], r["offset"]): r for r in rests.rest_voltages(kinds.where("cycle = 1"), (0.0, 15.0, 3870.0, 9000.0)).collect()}
    assert found["charge", 0.0]["voltage"] == pytest.approx(4.2) and found["charge", 15.0]["voltage"] == pytest.approx((4.2 + 4.15 + 0.05 * math.exp(-0.15)) / 2)
    assert found["charge", 9000.0]["status"] == "beyond_rest" and found["discharge", 3870.0]["status"] == "ok"
    odd = [("A", 1, 0, 0.0, None, "charge", 1.0, 4.0, 1.0), ("A", 1, 1, 5.0, None, "rest", 0.0, 4.1, 0.0), ("A", 2, 2, 9.0, None, "charge", 1.0, 4.0, 1.0), ("A", 2, 3, 9.0, None, "rest", 0.0, None, 0.0), ("A", 3, 4, 9.0, None, "charge", 1.0, 4.0, 1.0)]
    rows = segment.with_kind(spark.createDataFrame(odd, SAMPLES))
    got = {(r["cycle"], r["offset"]): (r["status"], r["voltage"]) for r in rests.rest_voltages(rows, (0.0, 1.0)).collect()}
    assert got == {(1, 0.0): ("single_point", 4.1), (1, 1.0): ("beyond_rest", None), (2, 0.0): ("no_data", None), (2, 1.0): ("no_data", None)}
    table = rests.rest_table(rows, (0.0,))
    assert {(r["cycle"], r["method"], r["status_0s"]) for r in table.collect()} == {(1, "step_type", "single_point"), (2, "step_type", "no_data"), (3, "no_rest", "no_rest")}
    sheets = rests.rest_sheets(table, (0.0,))
    assert sheets["EoC"].count() == 2 and sheets["EoD"].count() == 0 and {r["item"]: r["value"] for r in sheets["Meta"].collect()}["n_rows"] == "3"


def test_wide_rows(spark, cell):
    rows = {r["cycle"]: r.asDict() for r in wide.feature_rows(cell, wide.Setting(rated_ah=10.0, relaxation_s=200.0)).collect()}
    assert sorted(rows) == [1, 2, 3]
    first, last = rows[1], rows[3]
    assert len(first) > 330 and first["SoHQ"] == pytest.approx(100) and last["SoHQ"] == pytest.approx(96) and last["CE"] == pytest.approx(95)
    assert first["EoC_restV_init"] == pytest.approx(4.2) and first["EoC_restV_30m"] == pytest.approx(4.15, abs=1e-4) and first["EoD_restV_relax"] == pytest.approx(0.05, abs=1e-6)
    assert first["EoC_restV_tau"] == pytest.approx(200, rel=0.01)
    # At 60 s the discharge has gone two of its 59 steps, at 2 A.
    x = 2 / 59
    assert first["EoC_dchgR_60s"] == pytest.approx((1.3 * x + 0.2 * x**8) / 2 * 1000) and first["EoC_dchgR_10_60_ratio"] == pytest.approx(1 / 6, rel=0.01)
    q, v = np.linspace(0, 9.5, 60), 4.1 - 1.3 * np.linspace(0, 1, 60) - 0.2 * np.linspace(0, 1, 60) ** 8
    energy = float(np.trapezoid(v, q))
    assert first["dchg_E"] == pytest.approx(energy) and first["VE"] == pytest.approx(energy / 9.5 / 3.6) and first["EE"] == pytest.approx(energy / 36)
    high = float(np.diff(q)[(v[1:] + v[:-1]) / 2 > 3.5].sum())
    assert first["dchg_Q_high_V"] == pytest.approx(high) and first["observed_window"] == {"charge": "ok", "discharge": "ok"}
    assert last["delta_dchg_V_avg"] == pytest.approx(-0.02) and last["delta_hyst_area"] == pytest.approx(0.02 * 0.96, abs=1e-9) and last["delta_EoC_restV_end"] == pytest.approx(0)
    assert first["dchg_shape_DTW"] == 0 and last["dchg_shape_DTW"] > 0
    assert first["rest_sufficiency"] == pytest.approx(129 * 30 / 200) and first["cv_detect_method"] == "no_cv" and first["chgCapa_CCratio"] == 100
    assert first["CI_per_hour"] == pytest.approx(5 / first["cycle_duration_h"]) and first["protocol_kind"] == "routine" and first["Q_relax"] is None
    assert first["baseline_semantics"]["cycle"] == 1 and first["feature_semantics"]["schema"] == diagnose.SEMANTICS_SCHEMA
    table = spark.createDataFrame([(1,)], "x int").select(F.lit("Liion_NMC_Gr").alias("chemistry"))
    diagnosed = diagnose.diagnose(wide.feature_rows(cell, wide.Setting(rated_ah=10.0)).crossJoin(table), diagnose.FULL_CELL).where("cycle = 3").first()
    assert diagnosed["LLI_evidence_count"] >= 5 and diagnosed["impedance_evidence_count"] >= 5 and diagnosed["LAM_NE_evidence_count"] >= 5


def test_disjoint_legs_are_not_integrated(spark, cell):
    broken = cell.where("cycle = 1").withColumn("step_type", F.when((F.col("step_type") == "charge") & (F.col("step_time") == 300), "pause").otherwise(F.col("step_type")))
    row = wide.cycle_rows(broken, wide.Setting(rated_ah=10.0)).first()
    assert row["observed_window"]["charge"] == "disjoint" and row["chg_E"] is None and row["VE"] is None and row["hyst_area"] is None and row["dchg_E"] is not None


def test_pulse_parts_are_recovered():
    t = np.arange(0, 30.05, 0.1)
    r = 1.2 + 0.6 * (1 - np.exp(-t / 2.0)) + 0.12 * np.sqrt(t)
    fit = pulse.components(t, r, np.full(len(t), -70.0))
    assert fit["dcir_fit_valid"] and np.allclose([fit["R_ohmic"], fit["R_ct"], fit["tau_ct"], fit["A_diff"]], [1.2, 0.6, 2.0, 0.12], rtol=0.1)
    assert fit["R_30s_total"] == pytest.approx(r[300]) and fit["R_ohmic_frac"] + fit["R_ct_frac"] + fit["R_diff_frac"] == pytest.approx(1, abs=0.02)
    ramp = pulse.components(t, r, -70 * np.minimum(1, t / 5))
    assert "current_ramp" in ramp["flag"] and not ramp["dcir_fit_valid"]
    assert pulse.components(t[:20], r[:20])["flag"] == "too_few_points" and "negative" in pulse.components(t, r - 5)["flag"]
    x = np.arange(0, 1800.0, 5)
    back = pulse.recovery(x, 3.6 - 0.02 * np.exp(-x / 8) - 0.03 * np.exp(-x / 400), 6.0)
    assert back["V_inf_est"] == pytest.approx(3.6, abs=1e-3) and back["R_recovery_tau2"] == pytest.approx(400, rel=0.1) and back["tau_consistency_flag"]
    x = np.arange(0, 7200.0, 10)
    leak = pulse.leak(x, 3.6 - 0.01 * np.exp(-x / 300) - 5e-7 * x)
    assert leak["self_discharge_rate"] == pytest.approx(1.8, rel=0.1) and leak["V_inf_rest"] == pytest.approx(3.6, abs=1e-3)
    assert pulse.leak(x[:20], x[:20])["sd_method"] == "rest_too_short"


def test_constant_voltage_tails():
    t = np.arange(0, 3600.0, 10)
    tail = t >= 1800
    v = np.where(tail, 4.2, 3.6 + 0.6 * t / 1800)
    i = np.where(tail, 20 * np.exp(-(t - 1800) / 600) + 1, 21.0)
    q = np.concatenate([[0], np.cumsum(i[1:] * 10 / 3600)])
    found = pulse.constant_voltage(v, i, t, q, counted=3.5)
    assert found["has_cv"] and found["cv_detect_method"].startswith("signal") and found["tau_CV"] == pytest.approx(600, rel=0.05)
    assert found["chgCCcapa"] == pytest.approx(10.5, rel=0.02) and found["chgCapa_CCratio"] == pytest.approx(100 * found["chgCCcapa"] / (found["chgCCcapa"] + found["chgCVcapa"]))
    assert pulse.constant_voltage(v[:5], i[:5], t[:5], q[:5])["cv_detect_method"] == "too_short"


def pulse_cell(spark):
    """Blocks of three pulse cycles at 100 and 200 with a long rest before each pulse."""
    rows = []
    for c in (98, 99, 100, 101, 102, 150, 198, 199, 200, 201, 202):
        if c in (100, 101, 102, 200, 201, 202):
            k = c % 100
            end = {0: 4.0, 1: 3.7, 2: 3.4}[k] + (0.02 if c >= 200 else 0.0)
            for j in range(400):
                rows.append(("P", c, len(rows), 10.0 * j, 10.0 * j, "rest", 0.0, end - 0.01 * math.exp(-j / 30), 0.0))
            for j in range(301):
                x = 0.1 * j
                r = (1.0 + 0.2 * k) + 0.5 * (1 - math.exp(-x / 2)) + 0.1 * math.sqrt(x)
                rows.append(("P", c, len(rows), 4000 + x, x + 4000, "discharge", -70.0, end - 70 * r / 1000, 0.01 * j))
        else:
            for leg, current, q in (("charge", 30.0, 60.0), ("discharge", -30.0, 59.0 if c in (99, 199) else 58.5)):
                rows += [("P", c, len(rows) + j, 100.0 * j, 100.0 * j, leg, current, 3.5 + 0.1 * j * (1 if leg == "charge" else -1), q * j / 4) for j in range(5)]
    return spark.createDataFrame(rows, SAMPLES)


def test_pulse_blocks_enrich_rows(spark):
    samples = pulse_cell(spark)
    blocks = dcir.pulse_blocks(samples)
    assert [(r["cycle"], r["block_id"], r["soc"]) for r in blocks.orderBy("cycle").collect()] == [(100, 1, 80), (101, 1, 50), (102, 1, 20), (200, 2, 80), (201, 2, 50), (202, 2, 20)]
    features = samples.groupBy("cell_id", "cycle").agg(F.max(F.when(F.col("step_type") == "discharge", F.col("capacity"))).alias("dchgCapa"))
    rows = {r["cycle"]: r for r in dcir.enrich(features, samples).collect()}
    assert rows[100]["R_ohmic_soc80"] == pytest.approx(1.0, rel=0.1) and rows[101]["dcir_fit_valid_soc50"] and rows[100]["R_ohmic_soc50"] is None
    assert rows[201]["R_SOC_slope"] == pytest.approx(-0.2 / 30, rel=0.2) and rows[100]["R_ratio_20_50"] > 1
    assert rows[100]["ocv_drift_mode"] == "baseline" and rows[202]["ocv_drift_mode"] == "parallel_shift" and rows[200]["ocv_parallel_shift"] == pytest.approx(0.02, abs=2e-3)
    assert rows[98]["Q_relax"] == pytest.approx(0.5) and rows[99]["Q_relax_pct"] == pytest.approx(50 / 59) and rows[98]["Q_relax_source"] == "rpt_block" and rows[150]["Q_relax"] is None
    assert rows[150]["RCF"] == pytest.approx(58.5 / 58.5) and rows[100]["RCF"] is None and rows[150]["block_id"] is None
    assert dcir.first_capacity_cycle(blocks, features).first()["baseline_cycle"] == 99


def test_step_ends(spark):
    rows = [
        ("c", 1, 1, "charge", 4.2, 1.0, 70814.0, None, 3.8, 1.2, 3600.0), ("c", 1, 2, "rest", 4.15, 0.0, None, None, None, None, 1800.0),
        ("c", 1, 3, "discharge", 2.5, -1.0, None, 70.0, 3.5, 1.0, 3500.0), ("c", 1, 4, "rest", 2.9, 0.0, None, None, None, None, 1800.0),
        ("c", 2, 1, "charge", 4.2, 1.0, 71000.0, None, 3.8, 1.2, 3600.0), ("c", 2, 2, "discharge", 2.5, -1.0, None, 35.0, 3.4, 1.0, 3500.0),
    ]
    steps = spark.createDataFrame(rows, "cell_id string, cycle long, step_no long, step_type string, voltage double, current double, charge_capacity double, discharge_capacity double, AvgVoltage double, Impedance double, step_time_s double")
    found = {r["cycle"]: r for r in cycle.step_deltas(cycle.step_cycle_rows(steps)).collect()}
    assert found[1]["chgCapa"] == pytest.approx(70.814) and found[1]["CE"] == pytest.approx(70 / 70.814 * 100) and found[1]["EoC_restV_end"] == 4.15 and found[1]["rest_drop_EoD"] == pytest.approx(-0.4)
    assert found[1]["V_hyst_proxy"] == pytest.approx(0.3) and found[1]["impedance_ratio"] == pytest.approx(1.2) and found[2]["EoC_restV_end"] is None
    assert found[2]["SoHQ"] == pytest.approx(50) and found[2]["delta_dchgCapa"] == pytest.approx(-35) and found[1]["CE_rev"] == pytest.approx(71 / 70 * 100)


def test_recovery_after_tests(spark):
    rows, kinds = [], []
    for c in range(1, 301):
        test = c in (100, 101, 102, 200, 201, 202)
        base = 100 - 0.02 * c
        bump = 0.8 * math.exp(-(c - 102) / 6) if 102 < c < 200 else 1.5 * math.exp(-(c - 202) / 9) if c > 202 else 0.0
        rows.append(("r", c, base + (0 if test else bump)))
        kinds.append(("r", c, "rpt" if test else "routine", test))
    table = spark.createDataFrame(rows, "cell_id string, cycle long, SoHQ double")
    known = spark.createDataFrame(kinds, "cell_id string, cycle long, protocol_kind string, protocol_excluded boolean")
    found = recovery.analyze(table, known, known.withColumn("rpt", F.col("protocol_kind") == "rpt"))
    fits = {r["block_id"]: r for r in found["blocks"].collect()}
    assert fits[1]["amplitude"] == pytest.approx(0.8, rel=0.02) and fits[1]["decay"] == pytest.approx(6, rel=0.05) and fits[1]["bump_significant"] and abs(fits[1]["permanent_step_pct"]) < 0.01
    assert fits[2]["amplitude"] == pytest.approx(1.5, rel=0.02) and fits[1]["pre_anchor"] == pytest.approx(100 - 0.02 * 97) and fits[1]["delta_first_vs_anchor"] == pytest.approx(0.8 * math.exp(-1 / 6) - 0.02 * 6)
    fixed = {r["cycle"]: r["SoHQ_corrected"] for r in found["corrected"].where("cycle_role = 'routine'").collect()}
    assert all(fixed[c] == pytest.approx(100 - 0.02 * c, abs=0.01) for c in (50, 103, 110, 120, 205))
    seg = found["segments"].first()
    assert seg["fade_inter"] == pytest.approx(-0.02, rel=0.02) and seg["bump_contamination"] > 0
    onset = found["onsets"].first()
    assert onset["bump_cycle"] == 100 and onset["bump_block_id"] == 1


def moving_ridges(cycles=80, grid=200, noise=0.05):
    """A noisy map with two slowly moving ridges, and their paths."""
    rng = np.random.default_rng(0)
    paths = [np.clip(start + drift * np.arange(cycles) / 100, 0, grid - 1).astype(int) for start, drift in ((40, 0.08), (120, -0.05))]
    off = [np.arange(grid)[None, :] - p[:, None] for p in paths]
    return rng.normal(0, noise, (cycles, grid)) + sum(np.where(np.abs(o) <= 2, np.exp(-0.5 * o**2), 0.0) for o in off), paths


def test_ridges_follow_planted_tracks(spark):
    m, true = moving_ridges()
    found = sorted((p for p, _ in ridges.peel(m, ridges.penalty(m), 4, 3.0)), key=lambda p: p[0])[:2]
    assert all(np.abs(a - b).max() <= 2 for a, b in zip(true, found, strict=True))
    assert not list(ridges.peel(np.full((5, 20), np.nan), 0.1))
    assert ridges.drifts({1: m[0], 11: m[10]}) and 1e-4 <= ridges.penalty(m, [0.01]) <= 2
    x = [[1.0, 2.0, 4.0], [2.0, 2.0, 2.0], [math.nan] * 3, [math.nan, 1.0, 3.0]]
    table = spark.createDataFrame([("a", "charge", k, row) for k, row in enumerate(x)], "cell_id string, leg string, cycle int, curve array<double>")
    got = [r["curve"] for r in evolution.local_contrast(table).orderBy("cycle").collect()]
    rows = np.array([[0.5, 1, 2], [1, 1, 1], [math.nan] * 3, [math.nan, 0.5, 1.5]])
    assert np.allclose(got, rows / [0.75, 2.5 / 3, 1.5], equal_nan=True)


def test_evolution_of_two_peaks(spark):
    q = np.linspace(0, 60, 400)
    rows = []
    for c in range(1, 13):
        slope = 0.01 + 0.02 * np.exp(-(((q / 60 - 0.28 - 0.004 * c) / 0.02) ** 2)) + 0.02 * np.exp(-(((q / 60 - 0.70) / 0.02) ** 2))
        v = 4.1 - np.concatenate([[0], np.cumsum((slope[1:] + slope[:-1]) / 2 * np.diff(q))])
        rows += [("e", "discharge", c, k, float(a), float(b)) for k, (a, b) in enumerate(zip(v, q, strict=True))]
    samples = spark.createDataFrame(rows, "cell_id string, leg string, cycle long, row_id long, voltage double, capacity double")
    maps = evolution.evolution_map(samples).cache()
    assert maps.count() == 12 and maps.first()["total_q"] == pytest.approx(60)
    found = evolution.tracks(maps, contrast=False).cache()
    best = {round(r["start"], 1): r for r in evolution.summary(found).where("n_observed = 12").orderBy("mean_confidence").collect()}
    assert 0.05 < best[0.3]["drift_per_100"] < 0.5 and abs(best[0.7]["drift_per_100"]) < 0.02  # steps are penalised
    assert {r["event"] for r in evolution.events(found, maps).collect()} == {"initial"}
    pairs = spark.createDataFrame([("e", 1, 2)], "cell_id string, c1 long, c2 long")
    assert evolution.noise_floor(maps, pairs).first()["error_median"] < 0.01
    errors = evolution.anchor_errors(found, maps.where("cycle % 3 = 0")).where("track = 0").collect()
    assert len(errors) == 4 and max(r["error"] for r in errors) < 0.01
    assert {r["check"] for r in evolution.preflight(maps).where("status = 'PASS'").collect()} >= {"n_cycles", "usable_share", "capacity_spread"}
    steep = evolution.steep_onsets(samples.where("cycle = 1")).first()
    assert 0.8 <= steep["Q_steepen_norm"] <= 0.99
    assert evolution.tracks(maps.limit(0)).count() == 0
    domains = {r["domain"]: r["n_tracks"] for r in evolution.compare_domains(samples).collect()}
    assert set(domains) <= {"Q", "V"} and domains["Q"] >= 1


def test_steps_of_samples_give_the_protocol(spark, cell):
    steps = protocol.steps_of(segment.with_kind(cell))
    flags = protocol.protocol_flags(protocol.cycle_steps(steps)).collect()
    assert {(r["n_steps"], r["rpt"]) for r in flags} == {(4, False)} and flags[0]["dchg"] > 9


def test_routine_peaks_get_the_names_of_tests(spark):
    def leg(c, peaks, width):
        """A charge whose dQ/dV is high at the given voltages."""
        v = np.linspace(3.3, 4.2, 500)
        dq = 40 + sum(25 * np.exp(-(((v - p) / width) ** 2)) for p in peaks)
        return v, np.concatenate([[0], np.cumsum((dq[1:] + dq[:-1]) / 2 * np.diff(v))])

    rows, flags = [], []
    for c in range(90, 112):
        test = c in (100, 101, 102)
        full = c in (98, 99)
        v, x = leg(c, (3.55, 3.86, 4.03) if full or test else (3.57, 3.88), 0.02 if full or test else 0.03)
        rows += [("r", "charge", c, k, float(a), float(b), 10.0) for k, (a, b) in enumerate(zip(v, x, strict=True))]
        flags.append(("r", c, test, False, full))
    samples = spark.createDataFrame(rows, "cell_id string, leg string, cycle long, row_id long, voltage double, capacity double, current double")
    known = spark.createDataFrame(flags, "cell_id string, cycle long, rpt boolean, capacheck boolean, capa_full boolean")
    kinds = known.select("cell_id", "cycle", F.when(F.col("rpt"), "rpt").when(F.col("capa_full"), "capa_full").otherwise("routine").alias("protocol_kind"))
    assert {(r["life"], r["cycle"]) for r in anchors.anchor_cycles(known).collect()} == {(100, 98), (100, 99)}
    assert anchors.second_of_pairs(known).first()["cycle"] == 99
    found = anchors.build(samples, known, kinds)
    refs = {r["peak_id"]: r["V"] for r in found["references"].collect()}
    assert refs["P1_low"] == pytest.approx(3.55, abs=0.01) and refs["P3_main"] == pytest.approx(3.86, abs=0.01) and refs["P4_high"] == pytest.approx(4.03, abs=0.01)
    shifts = {r["peak_id"]: r["shift"] for r in found["shifts"].collect()}
    assert shifts["P1_low"] == pytest.approx(0.02, abs=0.01) and shifts["P3_main"] == pytest.approx(0.02, abs=0.01)
    rows = {(r["cycle"], r["peak_id"]): r for r in found["assigned"].collect()}
    one = rows[97, "P1_low"]
    assert one["V_observed"] == pytest.approx(3.57, abs=0.015) and one["zone"] == "hard" and one["anchor_left"] == 100 and one["assign_confidence"] > 0.3
    assert len({c for c, _ in rows}) == 17 and all(r["evidence_type"] in ("observed", "shoulder", "inferred_split", "missing") for r in rows.values())
    assert anchors.windows(["a", "b"], [3.5, 3.56]) == {"a": (3.44, pytest.approx(3.53)), "b": (pytest.approx(3.53), 3.62)}


def test_single_analyses(spark, cell):
    assert tools.parse_cycles("1, 2,5-8") == [1, 2, 5, 6, 7, 8]
    rows = [("a", c, c, 50.0 - c) for c in range(1, 31)]
    t = spark.createDataFrame(rows, "cell_id string, cycle long, tagged_cycle long, dchgCapa double")
    health = {r["cycle"]: r["SoHQ"] for r in tools.health_of_first(t).collect()}
    assert health[3] == pytest.approx(100) and health[30] == pytest.approx(20 / 47 * 100)
    points = spark.createDataFrame([("a", 15.0)], "cell_id string, breakpoint double")
    assert sorted(r["cycle"] for r in tools.around(t, points, 10, 10, 5).collect()) == [5, 10, 15, 20, 25]
    s = spark.createDataFrame([("a", c, 60.0 if c == 10 else 1.0) for c in range(1, 61)], "cell_id string, cycle long, current double")
    assert sorted(r["cycle"] for r in tools.chosen_cycles(s).collect()) == [1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 26, 51, 56, 57, 58, 59, 60]
    smooth = {r["cycle"]: r["dchgCapa_smooth"] for r in tools.moving_average(t, "dchgCapa", 5).collect()}
    assert smooth[10] == pytest.approx(40) and smooth[1] == pytest.approx((3 * 49 + 48 + 47) / 5) and smooth[30] == pytest.approx((22 + 21 + 3 * 20) / 5)
    found = {r["feature"]: r for r in tools.indicator_summary(t.withColumn("x", F.when(F.col("cycle") > 15, F.col("cycle"))), ["dchgCapa", "x"]).collect()}
    assert (found["x"]["first"], found["x"]["last"], found["x"]["coverage"]) == (16.0, 30.0, 50.0)
    legs = segment.leg_samples(segment.with_kind(cell))
    discharges = legs.where("leg = 'discharge'")
    fits = {r["cycle"]: r for r in tools.curve_fits(discharges, 2.0).collect()}
    assert fits[1]["dchg_fit_scale"] == pytest.approx(1, abs=1e-3) and fits[3]["dchg_fit_scale"] == pytest.approx(1 / 0.96, abs=0.01) and fits[3]["dchg_fit_dR"] == pytest.approx(10, abs=2)
    slopes = {r["cycle"]: r for r in tools.empty_end_slopes(discharges).collect()}
    assert slopes[1]["dvdq_soc0"] < 0 and slopes[1]["change_pct"] == 0 and slopes[3]["change_pct"] == pytest.approx(-100 * (1 / 0.96 - 1), rel=0.05)
    assert tools.at_charge_shares(discharges.where("cycle = 1"), (50.0,)).first()["v"] == pytest.approx(4.1 - 0.65, abs=0.02)
    assert tools.filter_sweep(discharges.where("cycle = 1"), (500,), (7, 21), (3,), (0.012,)).count() == 2 and tools.band_peak(discharges, 3.0, 3.5).count() == 3
    rows = tools.training_rows(spark.createDataFrame([("a", 1, True, 1.0, 1.0, 1.0, 1.0), ("a", 2, True, 1.0, None, None, None), ("a", 3, False, 1.0, 1.0, 1.0, 1.0)], "cell_id string, cycle long, usable boolean, p double, q double, r double, s double"), list("pqrs"))
    assert [r["cycle"] for r in rows.collect()] == [1]
    wide_rows = spark.createDataFrame([("a", 1, "", True), ("a", 2, "noisy", True)], "cell_id string, cycle long, exclude_flags string, usable_auto boolean")
    kinds = spark.createDataFrame([("a", 2, "rpt", True)], "cell_id string, cycle long, protocol_kind string, protocol_excluded boolean")
    marked = {r["cycle"]: (r["exclude_flags"], r["usable"]) for r in tools.with_exclusions(wide_rows, kinds).collect()}
    assert marked == {1: ("", True), 2: ("noisy|protocol:rpt", False)}
    medians = spark.createDataFrame([("dchgCapa", 35.0), ("cycle", 2.0)], "feature string, quantile double")
    assert tools.deviations(t, ["dchgCapa", "cycle"], medians).where("cycle = 30").first()["top_deviating"] == "cycle=30.00, dchgCapa=20.00"


def test_calibrations_need_their_contract(spark):
    rows = [(10.0, t, "d", s, "p", "10s", "sensor") for t, s in ((40.0, "50"), (70.0, "50"), (None, "50"), (40.0, "20"))]
    measured = spark.createDataFrame(rows, "r_mohm double, temperature_c double, measurement_definition string, soc string, protocol string, time_scale string, temperature_source string")
    known = spark.createDataFrame([(20000.0, 25.0, 0.0, 60.0, "id", "d", "50", "p", "10s", "sensor")], "ea_j_mol double, reference_c double, lo_c double, hi_c double, calibration_id string, measurement_definition string, soc string, protocol string, time_scale string, temperature_source string")
    found = {(r["temperature_c"], r["soc"]): (r["calibration_status"], r["calibration_reason"], r["r_ref"]) for r in tools.calibrated(measured, known).collect()}
    assert found[40.0, "50"] == ("ok", None, pytest.approx(10 * math.exp(20000 / 8.314 * (1 / 298.15 - 1 / 313.15))))
    assert found[70.0, "50"][1] == "measurement_temperature_outside_domain" and found[None, "50"][1] == "missing_measurement_temperature" and found[40.0, "20"][1] == "measurement_definition_mismatch"
    assert {r["calibration_reason"] for r in tools.calibrated(measured.where("soc = '50'"), known.withColumn("reference_c", F.lit(70.0))).collect()} == {"invalid_calibration"}


def test_mechanisms(spark):
    rows = [("g", 1, 70.0, 1.0, None, None), ("g", 2, 70.0, 0.85, 10.0, None), ("g", 3, 55.0, 0.99, 0.0, 15.0)]
    t = spark.createDataFrame(rows, "cell_id string, cycle long, dchgCapa double, RCF double, dchg_fit_dR double, dchg_fit_residual_argmax_SOC double").withColumn("LLI_vs_R_ratio", F.when(F.col("cycle") == 3, 0.3))
    found = {r["cycle"]: r for r in mechanism.mechanism_indicators(t).collect()}
    assert found[2]["mechanism_state"] == "impedance_only" and found[2]["mechanism_confidence"] == 0.7 and found[1]["mechanism_state"] == "undetermined"
    # H1: (30 - 15) / 30 and 1 - 0.15, weights 1 and 0.8; H2: 0.1 - 0.5 and (15 - 40) / 40, weights 1.2 and 0.7.
    assert found[3]["score_H1"] == pytest.approx((0.5 + 0.8 * 0.85) / 1.8) and found[3]["score_H2"] == pytest.approx((1.2 * -0.4 + 0.7 * -0.625) / 1.9)
    assert found[3]["mechanism_state"] == "H1_dominant" and found[3]["mechanism_confidence"] == pytest.approx(0.3 + 0.35 * 2 / 6 + 0.35 * (found[3]["score_H1"] - found[3]["score_H2"]))
    arms = mechanism.arms_from_start(t.withColumn("arm", F.lit("x")))
    assert {"arm", "cell_id", "cycle", "mechanism_state", "RCF"} <= set(arms.columns)


def test_a_resistance_at_its_limit_has_not_grown_whatever_the_order_of_its_sum(spark):
    taxes = [0, 0, 0, 0, 0, 0.01, 0.07, 0.08]  # the mean is 0.02
    means = [float(np.cumsum(x)[-1]) / len(x) * 100 for x in (taxes, taxes[::-1])]
    assert sorted(m > 2 for m in means) == [False, True]
    rows = [(k, c, 70.0, r, dr) for k, m in enumerate([*means, 2.001]) for c, r, dr in ((1, 1.0, None), (2, 0.85, m))]
    t = spark.createDataFrame(rows, "cell_id long, cycle long, dchgCapa double, RCF double, dchg_fit_dR double")
    found = {r["cell_id"]: r["mechanism_state"] for r in mechanism.mechanism_indicators(t).where("cycle = 2").collect()}
    assert found == {0: "undetermined", 1: "undetermined", 2: "impedance_only"}


def test_folders_are_reported(spark, tmp_path):
    rows = []
    one_cycle(rows, "A", 1, n=12, rest=5)
    one_cycle(rows, "A", 2, 0.9, n=12, rest=5)
    lines = ["TotalCycle,StepType,Voltage,Current,Capacity,TotalTime_sec"] + [f"{r[1]},{r[5]},{r[7]},{r[6]},{r[8]},{r[3]}" for r in rows]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "x_raw.csv").write_text("\n".join(lines) + "\n")
    (folder / "other.csv").write_text("a\n1\n")
    assert [p.rsplit("/", 1)[-1] for p in cycler.raw_paths(spark, f"file://{folder}")] == ["x_raw.csv"] and cycler.step_end_path("a/x_raw.csv") == "a/x_StepEnd.csv"
    found = api.diagnose_folder(spark, f"file://{folder}", f"file://{tmp_path}/out")
    assert {"features", "scores", "modes", "screen", "indicators"} <= set(found) and spark.read.parquet(found["features"]).count() == 2
