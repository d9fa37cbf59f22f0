"""Sources, sinks, API, registry and streams on small tables."""

import json
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from galvana import api
from galvana.operators import asof, diagnose, protocol, registry, segment
from galvana.sources import cycler, sinks, units
from galvana.streaming import cycles as streams


def raw_csv(folder, cell="M01Ch005"):
    lines = ["TotalCycle,StepType,Voltage[mV],Current(A),Capacity_Ah,TotalTime_sec,Extra"]
    t = 0
    for c in range(1, 6):
        for leg, sign in (("charge", 1), ("rest", 0), ("discharge", -1), ("rest", 0)):
            for k in range(12):
                t += 10
                v = 3000 + 80 * k if leg == "charge" else 3900 - 75 * k if leg == "discharge" else 3500
                lines.append(f"{c},{leg},{v},{sign * 2.0},{(k * (1 - 0.02 * c)) if sign else 0},{t},x")
    lines.append(",charge,1,1,1,1,x")
    (folder / cell).mkdir()
    path = folder / cell / f"{cell}_raw.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_to_features_scores_and_modes(spark, tmp_path):
    samples = cycler.read_cycler_csv(spark, raw_csv(tmp_path))
    assert {"cycle", "voltage", "current", "capacity", "time", "step_type", "Extra", "file", "row_id", "cell_id"} <= set(samples.columns)
    assert samples.count() == 240 and samples.agg(F.max("voltage")).first()[0] == pytest.approx(3.9)
    assert samples.first()["cell_id"] == "M01Ch005"
    assert cycler.normalize(samples).columns == samples.columns
    features = api.extract(samples)
    rows = features.orderBy("cycle").collect()
    assert [r["cycle"] for r in rows] == [1, 2, 3, 4, 5]
    assert rows[0]["SoHQ"] == pytest.approx(100) and rows[4]["SoHQ"] == pytest.approx(100 * 0.90 / 0.98)
    assert rows[0]["CE"] == pytest.approx(100) and 0 < rows[0]["VE"] < 1.2
    found = api.diagnose_features(features)
    assert set(found) == {"scores", "contributions", "summary", "top", "screen", "cells", "modes"}
    assert found["scores"].count() == 5 and found["modes"].count() == 5


def test_units_come_from_headers_and_never_contradict():
    assert units.unit_of_header("Voltage[mV]") == "mV" and units.unit_of_header("TotalTime_sec") == "sec" and units.unit_of_header("Current") is None
    assert units.resolve("Capacity(mAh)", "Ah") == (1e-3, False) and units.resolve("Capacity", "Ah") == (1.0, True)
    with pytest.raises(ValueError):
        units.resolve("Capacity(mAh)", "Ah", "Ah")
    with pytest.raises(ValueError):
        units.factor("furlong", "V")


def test_alias_order_beats_column_order():
    assert cycler.resolve_column(["AvgCurrent", "Current"], "current") == "Current"
    assert cycler.resolve_column(["I [A]", "total cycle"], "cycle") == "total cycle"
    assert cycler.resolve_column(["x"], "voltage") is None
    with pytest.raises(ValueError):
        cycler.resolve_column(["x"], "voltage", "y")


def test_step_durations_and_labels(spark):
    d = spark.createDataFrame([("1:02:03",), ("2:30",), ("7.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in d.select(cycler.step_duration_s("v")).collect()] == [3723.0, 150.0, 7.5, None, None]
    labels = spark.createDataFrame([("Cycle-1", 5, 0), ("Cycle-1", 6, 1), ("cycle - 2", 9, 2), ("other", 1, 3)], "PairLabel string, cycle long, row_id long")
    assert sorted((r["tagged_cycle"], r["cycle"]) for r in cycler.pair_cycles(labels).collect()) == [(1, 6), (2, 9)]


def test_manifest_and_half_cells(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"cells": [{"doe": "A", "arm": "x", "cell_id": "c1", "path": "p"}, {"doe": "B", "arm": "y", "cell_id": "c2", "path": "q"}]}))
    assert [tuple(r) for r in cycler.read_manifest(spark, str(path), "A").collect()] == [("x", "c1", "p")]
    rows = [("f", k, float(k % 5), (3.0 + 0.1 * (k % 5)) if (k // 5) % 2 == 0 else (3.5 - 0.1 * (k % 5))) for k in range(20)]
    found = cycler.half_cell_cycles(spark.createDataFrame(rows, "file string, row_id long, time double, voltage double")).groupBy("cycle", "step_type").count().collect()
    assert {(r["cycle"], r["step_type"], r["count"]) for r in found} == {(1, "charge", 10), (1, "discharge", 5), (2, "discharge", 5)} or sum(r["count"] for r in found) == 20


def test_saved_tables_are_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, [])], "k long, v string, l array<int>")
    path = str(tmp_path / "t.parquet")
    sinks.save_features(df, path, config={"a": 1})
    assert sinks.load_features(spark, path).count() == 2
    assert sinks.content_hash(df) == sinks.content_hash(df.repartition(3).select("l", "v", "k"))
    assert sinks.content_hash(df) != sinks.content_hash(df.limit(1))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_table(df, path)
    sinks.write_table(df, str(tmp_path / "t.csv"))
    assert cycler.read_table(spark, str(tmp_path / "t.csv")).count() == 2


def test_roles_families_and_aliases(spark):
    assert registry.role_of("SoHQ") == "target" and registry.role_of("cell_id") == "meta" and registry.role_of("hyst_area") == "indicator"
    assert registry.role_of("LLI_score") == "diagnosis" and registry.canonical("delta_EoC_dchgR_10s_inc") == "EoC_dchgR_10s"
    for names, role in ((registry.META_NAMES, "meta"), (registry.TARGET_NAMES, "target"), (registry.COVARIATE_NAMES, "covariate"), (registry.QC_NAMES, "qc")):
        for name in names:
            assert registry.role_of(name) == registry.role_of(f"{name}_inc") == role, name
            assert registry.role_of(f"delta_{name}") == ("diagnosis" if role == "qc" and name.endswith(("_score", "_est")) else role), name
    assert {registry.role_of(x) for x in ("LLI_est", "LAM_PE_est_hc_calibrated", "delta_contact_loss_score")} == {"diagnosis"}
    assert {registry.role_of(x) for x in ("dcir_fit_valid_soc50", "n_points_soc20", "relax_amp_ratio_x")} == {"qc"} and registry.role_of("dchg_shape_DTW") == "indicator"
    assert registry.dedupe_by_family(["hyst_max_dV", "hyst_area", "delta_hyst_area", "x"]) == ["delta_hyst_area", "x"]
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "CI double, CE double, ocv_block_id double")
    assert registry.apply_aliases(df).columns == ["CE", "block_id"]
    assert registry.parse_peak("delta_dchg_dQdV_peak3_V") == ("dchg", "dQdV", 3, "V") and registry.parse_peak("CE") is None
    assert registry.report(df).count() == 3


def test_rest_must_follow_a_leg_at_once(spark):
    steps = ["rest", "charge", "rest", "pause", "rest", "discharge", "rest", "rest"]
    rows = [(1, 1, k, float(k), s, 0.0) for k, s in enumerate(steps)]
    table = segment.with_kind(spark.createDataFrame(rows, "cell_id long, cycle long, row_id long, time double, step_type string, current double"))
    found = segment.rest_periods(table).orderBy("run_id").collect()
    assert [(r["after_leg"], r["n"], r["first_time"]) for r in found] == [("charge", 1, 2.0), ("discharge", 2, 6.0)]


def test_offsets_interpolate_and_end(spark):
    rows = [(1, 0.0, 4.0), (1, 10.0, 3.9), (1, 20.0, None), (1, 30.0, 3.7)]
    found = asof.sample_at(spark.createDataFrame(rows, "k long, t double, v double"), "t", ["v"], [-5.0, 0.0, 5.0, 20.0, 31.0], ["k"]).orderBy("offset").collect()
    got = [r["v"] for r in found]
    assert got[0] == pytest.approx(4.0) and got[1] == pytest.approx(4.0) and got[2] == pytest.approx(3.95) and got[3] == pytest.approx(3.8) and got[4] is None


def test_nearest_takes_the_smaller_of_two(spark):
    rows = spark.createDataFrame([(1, c) for c in (1, 5, 6, 7, 20)] + [(2, 3)], "cell_id long, cycle long")
    anchors = spark.createDataFrame([(1, 4, 1.0), (1, 8, 2.0)], "cell_id long, cycle long, q double")
    found = {(r["cell_id"], r["cycle"]): r["nearest_cycle"] for r in asof.nearest(rows, anchors, ["cell_id"], "cycle", ["q"]).collect()}
    assert found == {(1, 1): 4, (1, 5): 4, (1, 6): 4, (1, 7): 8, (1, 20): 8, (2, 3): None}


def test_unknown_is_never_healthy(spark):
    table = spark.createDataFrame([(1, 1, None, 99.0), (1, 2, 120.0, 150.0)], "cell_id long, cycle long, EoC_dchgR_10s_inc double, CE double")
    row = diagnose.diagnose(table, diagnose.FULL_CELL).orderBy("cycle").collect()
    assert row[0]["transport_limitation_score"] is None and row[0]["transport_status"] == "unknown" and not row[0]["transport_scientific_eligible"]
    assert row[1]["impedance_evidence_count"] == 1 and row[1]["impedance_status"] == "insufficient_or_invalid_evidence"
    assert row[1]["plating_risk_score"] is None  # an efficiency above 100 says nothing


def _measured(**more):
    """A routine row with all that a scientific reading asks for, and its baseline."""
    semantics = {"schema": diagnose.SEMANTICS_SCHEMA}
    common = {"cell_id": 1, "chemistry": "Liion_NMC_Gr", "protocol_kind": "routine", "protocol_excluded": False, "protocol_comparable": True, "protocol_id": "p1", "feature_semantics": semantics}
    row = common | {
        "cycle": 2, "quality_score": 0.9, "quality_evidence_coverage": 0.7, "quality_status": "partial", "quality_gate_failed_groups": "rest_sufficiency", "leg_completeness": 1.0,
        "samples_per_mV": 1.0, "dqdv_snr": 20.0, "pulse_sample_count_1s": 8.0, "pulse_current_stability": 0.005,
        "baseline_semantics": (1.0, 1.0, semantics),
    }
    return common | {"cycle": 1} | {k: v for k, v in more.pop("base", {}).items()}, row | more


def _diagnosed(spark, rules, base, row, extra="", numbers=()):
    kinds = (
        "cell_id long, cycle long, chemistry string, protocol_kind string, protocol_excluded boolean, protocol_comparable boolean, protocol_id string, feature_semantics map<string,string>, quality_score double,"
        " quality_evidence_coverage double, quality_status string, quality_gate_failed_groups string, leg_completeness double, samples_per_mV double, dqdv_snr double, pulse_sample_count_1s double, pulse_current_stability double,"
        " baseline_semantics struct<cycle: double, requested_cycle: double, feature_semantics: map<string,string>>" + extra + "".join(f", {c} double" for c in numbers)
    )
    names = [x.split()[0] for x in kinds.replace("struct<cycle: double, requested_cycle: double, feature_semantics: map<string,string>>", "s").replace("map<string,string>", "m").split(", ")]
    table = spark.createDataFrame([tuple(r.get(c) for c in names) for r in (base, row)], kinds)
    return diagnose.diagnose(table, rules).where("cycle = 2").first()


LLI = {"delta_dchg_V_cutoff_margin": -0.5, "delta_EoD_restV_end": 0.5, "ocv_parallel_shift": 0.5, "delta_EoC_restV_end": -0.5, "CE": 95.0}


def test_support_fills_no_required_group(spark):
    numbers = [*LLI, "delta_dchg_dVdQ_SOC0"]
    missing = _diagnosed(spark, diagnose.FULL_CELL, *_measured(**LLI), numbers=numbers)
    # Five of eleven terms, all for it: 0.45 * (0.6 * 5 / 11 + 0.4 * 0.9) + 0.4 + 0.15, less 5 % without a half cell and 30 % as other modes are as high.
    assert missing["LLI_confidence"] == pytest.approx(0.7 * 0.95 * (0.45 * (0.6 * 5 / 11 + 0.36) + 0.55))
    assert missing["LLI_status"] == "heuristic_unverified" and missing["LLI_eligibility_reasons"] == ["required_group_missing:independent_shape_or_efficiency"]
    weights = [(1.2, 10), (1.0, 10), (1.0, 10), (0.9, 0.5 / 0.03), (0.25, 2.5)]
    assert missing["LLI_pattern_score"] == pytest.approx(sum(w * math.tanh(x) for w, x in weights) / sum(w for w, _ in weights))
    good = _diagnosed(spark, diagnose.FULL_CELL, *_measured(**LLI, delta_dchg_dVdQ_SOC0=8.0), numbers=numbers)
    assert good["LLI_scientific_eligible"] and good["LLI_status"] == good["diagnosis_status"] == "scientifically_eligible" and good["diagnosis_valid"]
    assert good["LLI_supporting_features"].split(",")[0] == "delta_dchg_V_cutoff_margin" and good["LLI_conflicting_features"] == ""
    assert good["diagnosis_constraints"] == "stack_pressure_unknown,halfcell_uncalibrated,quality_groups_failed" and good["LLI_est"] is None
    failed = _diagnosed(spark, diagnose.FULL_CELL, *_measured(**LLI, delta_dchg_dVdQ_SOC0=8.0, quality_gate_failed_groups="samples_per_mV"), numbers=numbers)
    assert "required_quality_unverified:independent_shape_or_efficiency:samples_per_mV" in failed["LLI_eligibility_reasons"]


@pytest.mark.parametrize(("change", "reason"), [
    ({"chemistry": "ASSB_SJ900_Si_rich"}, "chemistry_mismatch"),
    ({"chemistry": None}, "chemistry_unverified"),
    ({"protocol_comparable": None}, "protocol_unverified_or_incompatible"),
    ({"quality_status": "unknown"}, "quality_unverified"),
    ({"quality_score": math.nan}, "quality_unverified"),
    ({"quality_evidence_coverage": math.nan}, "quality_unverified"),
    ({"quality_gate_failed_groups": None}, "quality_groups_unverified"),
    ({"feature_semantics": {}}, "feature_semantics_unverified"),
    ({"leg_completeness": None}, "required_quality_unverified:plateau:leg_completeness"),
    ({"baseline_semantics": (1.0, 99.0, {"schema": "measurements_v2"})}, "baseline_unverified"),
    ({"baseline_semantics": (1.0, 1.0, {"schema": "other"})}, "feature_semantics_mismatch"),
    ({"protocol_id": "other"}, "baseline_protocol_mismatch_or_unknown"),
])
def test_poor_metadata_is_a_reason(spark, change, reason):
    shape = {"delta_dchg_plateau_V": 0.1, "dchg_plateau_width": 2.0, "delta_chg_dQdV_peak1_V": 0.1}
    base, row = _measured(**shape, base={"dchg_plateau_width": 4.0})
    if not change.get("chemistry", True):
        assert _diagnosed(spark, diagnose.FULL_CELL, base, row, numbers=list(shape))["LAM_PE_scientific_eligible"]
    found = _diagnosed(spark, diagnose.FULL_CELL, base, row | change, numbers=list(shape))
    assert reason in found["LAM_PE_eligibility_reasons"] and not found["LAM_PE_scientific_eligible"]
    if reason == "chemistry_mismatch":
        assert found["LAM_PE_confidence"] == 0.0 and found["LAM_PE_status"] == "insufficient_or_invalid_evidence"


@pytest.mark.parametrize(("valid", "count", "eligible"), [(True, 3, True), (False, 1, False), (None, 3, False)])
def test_fits_need_a_valid_flag(spark, valid, count, eligible):
    base, row = _measured(chemistry="ASSB_SJ900_Si_rich", quality_gate_failed_groups="", R_ct_soc50=2.0, tau_ct_soc50=4.0, EoC_dchgR_60s_inc=80.0, dcir_fit_valid_soc50=valid)
    found = _diagnosed(spark, diagnose.ASSB_SI, base, row, ", dcir_fit_valid_soc50 boolean", ["R_ct_soc50", "tau_ct_soc50", "EoC_dchgR_60s_inc"])
    assert (found["interface_R_evidence_count"], found["interface_R_scientific_eligible"]) == (count, eligible)
    assert ("fit_unverified:interface_fit" in found["interface_R_eligibility_reasons"]) != eligible


def test_voltage_efficiency_falls_against_its_baseline(spark):
    windows = {"feature_semantics": {"schema": "measurements_v2", "VE": "observed_window_v2"}, "observed_window": {"charge": "ok", "discharge": "ok"}}
    base, row = _measured(chemistry="ASSB_SJ900_Si_rich", VE=0.93, CI_per_hour=0.4, CE=99.0, base={"VE": 0.95} | windows, **windows)
    found = _diagnosed(spark, diagnose.ASSB_SI, base, row, ", observed_window map<string,string>", ["VE", "CI_per_hour", "CE"])
    ve = math.tanh(0.02 / (0.095 + 0.005))
    assert ve == pytest.approx(0.19738, abs=1e-5)
    assert found["SE_decomposition_score"] == pytest.approx((1.3 * math.tanh(0.8) + 1.0 * ve) / 2.3)
    row["observed_window"] = {"charge": "ok", "discharge": "unknown"}
    found = _diagnosed(spark, diagnose.ASSB_SI, base, row, ", observed_window map<string,string>", ["VE", "CI_per_hour", "CE"])
    assert found["SE_decomposition_evidence_count"] == 1


def test_excluded_rows_are_not_scored_and_poor_quality_ends_confidence(spark):
    rows = [(1, 1, "routine", False, 30.0, 0.5), (1, 2, "rpt", True, 90.0, 0.5), (1, 3, "routine", False, 30.0, 0.0)]
    table = spark.createDataFrame(rows, "cell_id long, cycle long, protocol_kind string, protocol_excluded boolean, EoC_dchgR_10s_inc double, quality_score double").withColumn("EoC_dchgR_60s_inc", F.lit(40.0))
    found = {r["cycle"]: r for r in diagnose.diagnose(table, diagnose.FULL_CELL).collect()}
    assert found[2]["impedance_pattern_score"] is None and not found[2]["diagnosis_scored_row"] and found[2]["diagnosis_status"] == "unknown"
    assert found[1]["impedance_status"] == "insufficient_or_invalid_evidence" or found[1]["impedance_confidence"] > 0
    assert found[3]["impedance_confidence"] == 0.0 and "quality_gate_failed" in found[3]["diagnosis_constraints"]


def test_rules_load_from_json(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({
        "chemistry": "c", "diagnosis_version": "v", "support_threshold": 0.3, "constraints": {"halfcell_calibrated": True, "stack_pressure_MPa": 2.0},
        "modes": {"m": {"evidence": [{"feature": "x", "direction": "increase", "weight": 2, "scale": 4}], "eligibility": {"required_groups": [{"name": "g", "any_of": ["x"], "quality_metrics": ["q"], "fit": "f"}]}}},
    }))
    rules = diagnose.Rules.load(str(path))
    assert rules.modes["m"].terms[0] == diagnose.Term("x", "increase", 2.0, 4.0) and rules.modes["m"].groups[0].fit == "f" and rules.support == 0.3
    found = diagnose.diagnose(spark.createDataFrame([(1, 1, 2.0)], "cell_id long, cycle long, x double"), rules).first()
    assert found["m_score"] == pytest.approx(math.tanh(0.5)) and found["diagnosis_constraints"] == "" and "fit_unverified:g" in found["m_eligibility_reasons"]


def test_unknown_protocol_keeps_all_rows_and_known_ones_only_routine(spark):
    f = spark.createDataFrame([(1, 1), (1, 2)], "cell_id long, cycle long")
    none = spark.createDataFrame([], "cell_id long, cycle long, protocol_kind string, protocol_excluded boolean")
    assert protocol.scoring_rows(protocol.attach_protocol(f, none)).count() == 2
    one = spark.createDataFrame([(1, 1, "rpt", True)], "cell_id long, cycle long, protocol_kind string, protocol_excluded boolean")
    assert protocol.scoring_rows(protocol.attach_protocol(f, one)).count() == 0


def test_closed_cycles_stream(spark, tmp_path):
    rows = [Row(cell_id=1, cycle=c, ts=f"2024-01-01 {c:02d}:{m:02d}:00", voltage=3.0 + m / 100, current=1.0 if m < 10 else -1.0, capacity=float(m)) for c in range(1, 6) for m in range(0, 20, 5)]
    table = spark.createDataFrame(rows).withColumn("ts", F.to_timestamp("ts"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = streams.closed_cycles(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["cycle"]: (r["n"], r["chgCapa"], r["dchgCapa"]) for r in spark.sql("select * from closed").collect()}
    assert got and all(v == (4, 5.0, 15.0) for v in got.values())
    assert streams.closed_cycles(table).count() == 5
    assert streams.leg_totals(table).count() > 0


def test_entry_and_names():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and "trajectory" in names
