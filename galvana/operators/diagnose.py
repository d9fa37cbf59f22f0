"""Track B: scores of degradation modes by signed evidence, compiled from a rule table into column expressions.

The result is not causal. Whatever is missing lowers coverage and confidence; an
unknown is never reported as healthy. A score is the support that a pattern finds;
whether it may be read scientifically is told apart, by reasons against it.

What is known about a row's measurement comes in columns, any of which may be
missing: ``chemistry``, ``protocol_kind``, ``protocol_excluded``, ``protocol_comparable``,
``protocol_id``, ``quality_score``, ``quality_status``, ``quality_evidence_coverage``,
``quality_gate_failed_groups``, ``temperature_available``, ``stack_pressure_MPa``, the
quality metrics and fit flags that groups name, ``feature_semantics`` (map of text:
``schema`` and the convention of features), ``feature_units`` (map of text),
``observed_window`` (map of leg to status), ``baseline_semantics`` (struct of cycle,
requested_cycle and feature_semantics).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galvana.functions.expr import clip, finite

#: How a measurement's conventions are named, and features of fits that need a valid one.
SEMANTICS_SCHEMA, VE_SEMANTICS = "measurements_v2", "observed_window_v2"
FITTED = ("R_ct", "R_ohmic", "A_diff", "tau_ct")
#: Columns of estimates that no validated model fills yet.
ESTIMATES = ("LLI_est", "LAM_PE_est", "LAM_NE_est", "electrode_slippage_est", "LLI_est_hc_calibrated", "LAM_PE_est_hc_calibrated", "LAM_NE_est_hc_calibrated")
#: Modes whose confidence falls without a temperature log, and without a known stack pressure.
NEED_TEMPERATURE = ("impedance", "interface_R", "solid_diffusion", "transport", "contact_loss", "contact")
NEED_PRESSURE = ("contact_loss", "contact")
#: Modes whose score column is a pattern score, and those with a column prefix of another name.
PATTERN_SCORES = ("LLI", "LAM_PE", "LAM_NE", "impedance")
PREFIXES = {"transport": "transport_limitation", "plating": "plating_risk", "contact": "contact_loss"}


@dataclass(frozen=True)
class Term:
    """A feature, the direction that speaks for a mode, its weight and scale, and the baseline's column."""

    feature: str
    direction: str
    weight: float
    scale: float
    baseline_ref: str | None = None
    unit: str | None = None


@dataclass(frozen=True)
class Group:
    """Features of which one is needed, the quality metrics behind them, and the flag of their fit."""

    name: str
    any_of: Sequence[str]
    quality: Sequence[str] = ()
    fit: str | None = None


@dataclass(frozen=True)
class Mode:
    terms: Sequence[Term]
    groups: Sequence[Group] = ()


@dataclass(frozen=True)
class Rules:
    """Modes of a chemistry, thresholds of support, conflict, evidence and collision, and what is known of the setting."""

    chemistry: str
    version: str
    modes: Mapping[str, Mode]
    method: str = "rule_pattern"
    model_version: str = "pattern_rule_v2_semantics"
    support: float = 0.25
    conflict: float = 0.25
    min_evidence: int = 2
    collision: float = 0.65
    stack_pressure: float | None = None
    halfcell_calibrated: bool = False
    constraints: Mapping[str, object] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Rules:
        """Rules of a JSON file: ``chemistry, diagnosis_version, support_threshold, ..., modes: {mode: {evidence: [...], eligibility: {required_groups: [...]}}}``."""
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        if not isinstance(data, dict) or "modes" not in data:
            raise ValueError(f"no rule table: {path}")
        modes = {}
        for name, spec in data["modes"].items():
            terms = [Term(t["feature"], t.get("direction", "increase"), float(t.get("weight", 1.0)), float(t.get("scale", 1.0)), t.get("baseline_ref"), t.get("unit")) for t in spec.get("evidence", [])]
            groups = [Group(g["name"], g["any_of"], g.get("quality_metrics", ()), g.get("fit")) for g in (spec.get("eligibility") or {}).get("required_groups", [])]
            modes[name] = Mode(terms, groups)
        setting = data.get("constraints") or {}
        return cls(
            data.get("chemistry", ""), data.get("diagnosis_version", "fullcell_v1"), modes, data.get("diagnosis_method", "rule_pattern"), data.get("diagnosis_model_version", "pattern_rule_v2_semantics"),
            data.get("support_threshold", 0.25), data.get("conflict_threshold", 0.25), data.get("min_evidence_for_valid", 2), data.get("mode_collision_score", 0.65),
            setting.get("stack_pressure_MPa"), setting.get("halfcell_calibrated") is True, setting,
        )


PULSES = ("pulse_sample_count_1s", "pulse_current_stability")
#: Evidence and required groups of each mode for a silicon-rich solid-state cell.
ASSB_SI = Rules(
    "ASSB_SJ900_Si_rich",
    "assb_si_v1",
    {
        "contact_loss": Mode(
            [
                Term("R_ohmic_soc50", "increase", 1.5, 0.5),
                Term("R_ohmic_frac_soc50", "increase", 1.3, 0.1),
                Term("EoC_dchgR_10s_inc", "increase", 1.0, 25.0),
                Term("mech_vs_chem_ratio", "increase", 1.2, 0.5),
                Term("hyst_frac_low", "increase", 0.9, 0.05),
                Term("dchg_dVdQ_SOC0_cliff_width_abs", "increase", 0.7, 2.0),
                Term("Q_relax_pct", "increase", 0.6, 0.2),
            ],
            [
                Group("contact_resistance", ["R_ohmic_soc50", "R_ohmic_frac_soc50", "EoC_dchgR_10s_inc"], PULSES),
                Group("mechanical_correlate", ["mech_vs_chem_ratio", "hyst_frac_low", "dchg_dVdQ_SOC0_cliff_width_abs"], ("leg_completeness",)),
            ],
        ),
        "interface_R": Mode(
            [
                Term("R_ct_soc50", "increase", 1.4, 0.5),
                Term("tau_ct_soc50", "increase", 1.0, 2.0),
                Term("VE", "decrease_vs_baseline", 1.1, 0.05, "VE", "fraction"),
                Term("EoC_dchgR_60s_inc", "increase", 0.9, 25.0),
                Term("tau_CV", "increase", 0.7, 200.0),
            ],
            [
                Group("interface_fit", ["R_ct_soc50", "tau_ct_soc50"], PULSES, "dcir_fit_valid_soc50"),
                Group("polarization", ["VE", "EoC_dchgR_60s_inc", "tau_CV"], ("leg_completeness",)),
            ],
        ),
        "SE_decomposition": Mode(
            [
                Term("CI_per_hour", "increase", 1.3, 0.5),
                Term("R_ct_soc50", "increase", 1.1, 0.5),
                Term("VE", "decrease_vs_baseline", 1.0, 0.05, "VE", "fraction"),
            ],
            [
                Group("coulombic_loss", ["CI_per_hour"], ("leg_completeness",)),
                Group("interface_fit", ["R_ct_soc50"], PULSES, "dcir_fit_valid_soc50"),
            ],
        ),
        "microshort": Mode(
            [
                Term("self_discharge_rate_soc80", "increase", 1.6, 1.0),
                Term("self_discharge_rate_soc50", "increase", 1.2, 1.0),
                Term("CI_per_hour", "increase", 0.6, 0.5),
            ],
            [
                Group("self_discharge", ["self_discharge_rate_soc80", "self_discharge_rate_soc50"], ("rest_sufficiency",)),
                Group("coulombic_loss", ["CI_per_hour"], ("leg_completeness",)),
            ],
        ),
        "LAM_PE": Mode(
            [
                Term("delta_dchg_plateau_V", "either", 0.8, 0.02),
                Term("dchg_plateau_width", "decrease_vs_baseline", 1.0, 2.0, "dchg_plateau_width"),
                Term("delta_chg_V_avg", "decrease", 0.9, 0.02),
                Term("delta_chg_dQdV_peak1_V", "either", 0.5, 0.02),
            ],
            [
                Group("plateau", ["delta_dchg_plateau_V", "dchg_plateau_width"], ("leg_completeness",)),
                Group("positive_electrode_shape", ["delta_chg_dQdV_peak1_V", "delta_chg_V_avg"], ("dqdv_snr",)),
            ],
        ),
        "LLI": Mode(
            [
                Term("ocv_parallel_shift", "increase", 1.2, 0.05),
                Term("delta_EoD_restV_end", "increase", 1.2, 0.05),
                Term("delta_dchg_V_cutoff_margin", "decrease", 1.0, 0.05),
                Term("VE", "decrease_vs_baseline", 0.9, 0.05, "VE", "fraction"),
                Term("V_inf_est_soc50", "either", 0.5, 0.02),
                Term("CE", "decrease_from_100", 0.35, 2.0),
            ],
            [
                Group("endpoint_shift", ["delta_EoD_restV_end", "delta_dchg_V_cutoff_margin", "ocv_parallel_shift"], ("leg_completeness",)),
                Group("independent_voltage", ["VE", "V_inf_est_soc50"], ("samples_per_mV",)),
            ],
        ),
        "solid_diffusion": Mode(
            [
                Term("A_diff_soc50", "increase", 1.3, 0.05),
                Term("PER", "increase", 1.1, 0.5),
                Term("RCF", "decrease", 1.0, 0.05),
                Term("R_recovery_tau2_soc50", "increase", 0.7, 100.0),
            ],
            [
                Group("diffusion_fit", ["A_diff_soc50"], PULSES, "dcir_fit_valid_soc50"),
                Group("recovery", ["PER", "RCF", "R_recovery_tau2_soc50"], ("rest_sufficiency",)),
            ],
        ),
    },
    model_version="pattern_rule_assb_si_v2_semantics",
)
#: Evidence and required groups of each mode for a graphite full cell.
FULL_CELL = Rules(
    "Liion_NMC_Gr",
    "fullcell_v1",
    {
        "LLI": Mode(
            [
                Term("delta_dchg_V_cutoff_margin", "decrease", 1.2, 0.05),
                Term("delta_EoD_restV_end", "increase", 1.0, 0.05),
                Term("ocv_parallel_shift", "increase", 1.0, 0.05),
                Term("delta_EoC_restV_end", "decrease", 0.9, 0.03),
                Term("VE", "decrease_vs_baseline", 0.8, 0.05, "VE", "fraction"),
                Term("delta_dchg_dVdQ_SOC0", "increase", 0.8, 5.0),
                Term("delta_dchg_dQdV_peak1_V", "either", 0.7, 0.02),
                Term("delta_chg_dQdV_peak1_V", "either", 0.6, 0.02),
                Term("dchg_shape_DTW", "increase", 0.5, 0.01),
                Term("CE", "decrease_from_100", 0.25, 2.0),
                Term("delta_EoD_restV_tau", "either", 0.4, 50.0),
            ],
            [
                Group("endpoint_shift", ["delta_dchg_V_cutoff_margin", "delta_EoD_restV_end", "ocv_parallel_shift", "delta_EoC_restV_end"], ("leg_completeness",)),
                Group("independent_shape_or_efficiency", ["delta_dchg_dVdQ_SOC0", "delta_dchg_dQdV_peak1_V", "delta_chg_dQdV_peak1_V", "VE"], ("samples_per_mV",)),
            ],
        ),
        "LAM_PE": Mode(
            [
                Term("delta_dchg_plateau_V", "either", 0.8, 0.02),
                Term("dchg_plateau_width", "decrease_vs_baseline", 1.0, 2.0, "dchg_plateau_width"),
                Term("delta_chg_V_avg", "decrease", 0.9, 0.02),
                Term("delta_dchg_V_avg", "decrease", 0.7, 0.02),
                Term("chg_dVdQ_SOC100", "either", 0.6, 2.0),
                Term("delta_chg_dQdV_peak1_V", "either", 0.5, 0.02),
                Term("hyst_max_dV", "increase", 0.4, 0.05),
            ],
            [
                Group("plateau", ["delta_dchg_plateau_V", "dchg_plateau_width"], ("leg_completeness",)),
                Group("positive_electrode_shape", ["delta_chg_dQdV_peak1_V", "chg_dVdQ_SOC100"], ("dqdv_snr",)),
            ],
        ),
        "LAM_NE": Mode(
            [
                Term("delta_dchg_dVdQ_SOC0", "increase", 1.2, 5.0),
                Term("dchg_dVdQ_SOC0_to_mid_ratio", "increase", 1.0, 1.0),
                Term("dchg_dVdQ_SOC0_cliff_width_abs", "increase", 0.9, 2.0),
                Term("dchg_Q_cliff_abs", "either", 0.6, 5.0),
                Term("dchg_dVdQ_post_cliff", "increase", 0.6, 0.05),
                Term("delta_dchg_V_cutoff_margin", "decrease", 1.0, 0.05),
                Term("EoD_chgR_10s_inc", "increase", 0.9, 20.0),
                Term("chgCVtime", "increase", 1.3, 100.0),
                Term("delta_dchg_dVdQ_SOC5", "increase", 0.6, 3.0),
            ],
            [
                Group("negative_electrode_cliff", ["delta_dchg_dVdQ_SOC0", "dchg_dVdQ_SOC0_cliff_width_abs", "dchg_Q_cliff_abs"], ("dqdv_snr",)),
                Group("capacity_or_charge_acceptance", ["delta_dchg_V_cutoff_margin", "chgCVtime", "EoD_chgR_10s_inc"], ("leg_completeness",)),
            ],
        ),
        "impedance": Mode(
            [
                Term("EoC_dchgR_10s_inc", "increase", 1.2, 20.0),
                Term("EoC_dchgR_60s_inc", "increase", 1.0, 20.0),
                Term("EoD_chgR_10s_inc", "increase", 1.0, 20.0),
                Term("EoD_chgR_60s_inc", "increase", 0.9, 20.0),
                Term("EoC_dchgR_10_60_ratio", "either", 0.5, 0.2),
                Term("EoC_restV_tau", "increase", 0.5, 100.0),
                Term("chgCVtime", "increase", 0.6, 100.0),
                Term("EoC_dchgR_10s_growth_50", "increase", 0.8, 0.001),
            ],
            [
                Group("pulse_resistance", ["EoC_dchgR_10s_inc", "EoD_chgR_10s_inc"], PULSES),
                Group("time_scale", ["EoC_dchgR_60s_inc", "EoD_chgR_60s_inc", "EoC_dchgR_10_60_ratio"], ("pulse_current_stability",)),
            ],
        ),
        "transport": Mode(
            [
                Term("EoC_dchgR_60s_inc", "increase", 1.0, 20.0),
                Term("EoD_chgR_60s_inc", "increase", 1.0, 20.0),
                Term("EoC_restV_tau", "increase", 1.1, 100.0),
                Term("EoD_restV_tau", "increase", 1.0, 80.0),
                Term("EoC_restV_relax", "either", 0.5, 0.03),
                Term("chgCVtime", "increase", 0.8, 100.0),
                Term("dchg_shape_DTW", "increase", 0.6, 0.01),
            ],
            [
                Group("relaxation", ["EoC_restV_tau", "EoD_restV_tau", "EoC_restV_relax"], ("rest_sufficiency",)),
                Group("load_response", ["EoC_dchgR_60s_inc", "EoD_chgR_60s_inc", "chgCVtime"], ("leg_completeness",)),
            ],
        ),
        "plating": Mode(
            [
                Term("CE_local_20", "decrease_from_100", 1.2, 3.0),
                Term("CE", "decrease_from_100", 0.5, 3.0),
                Term("delta_EoC_restV_end", "decrease", 0.7, 0.03),
                Term("chg_dVdQ_SOC100", "increase", 0.8, 3.0),
                Term("dSoHQ_dN", "decrease", 0.6, 0.05),
            ],
            [
                Group("coulombic", ["CE_local_20", "CE"], ("leg_completeness",)),
                Group("charge_or_relaxation", ["delta_EoC_restV_end", "chg_dVdQ_SOC100"], ("samples_per_mV",)),
            ],
        ),
        "contact": Mode(
            [
                Term("EoC_dchgR_10s_inc", "increase", 1.3, 25.0),
                Term("EoD_chgR_10s_inc", "increase", 1.3, 25.0),
                Term("EoC_dchgR_10_60_ratio", "increase", 0.9, 0.15),
                Term("hyst_frac_low", "increase", 0.9, 0.05),
                Term("chg_ir_drop_proxy", "increase", 0.7, 0.05),
                Term("dchg_ir_drop_proxy", "increase", 0.7, 0.05),
            ],
            [
                Group("pulse_contact", ["EoC_dchgR_10s_inc", "EoD_chgR_10s_inc"], PULSES),
                Group("hysteresis_or_drop", ["hyst_frac_low", "chg_ir_drop_proxy", "dchg_ir_drop_proxy"], ("leg_completeness",)),
            ],
        ),
    },
    model_version="pattern_rule_v2_semantics",
)


def score_column(mode: str) -> str:
    return f"{PREFIXES.get(mode, mode)}_{'pattern_score' if mode in PATTERN_SCORES else 'score'}"


def confidence_column(mode: str) -> str:
    return f"{PREFIXES.get(mode, mode)}_confidence"


class _Row:
    """Columns of a table, or of a struct within it, by name; a missing one is null."""

    def __init__(self, kinds: Mapping[str, T.DataType], within: str | None = None):
        self.kinds, self.within = kinds, within

    def of(self, name: str) -> Column:
        if name not in self.kinds:
            return F.lit(None)
        return F.col(self.within)[name] if self.within else F.col(f"`{name}`")

    def text(self, name: str) -> Column:
        """A text column; null where blank or of another type."""
        return F.when(F.trim(self.of(name)) != "", self.of(name)) if isinstance(self.kinds.get(name), T.StringType) else F.lit(None).cast("string")

    def number(self, name: str) -> Column:
        """A finite number; texts and booleans are none."""
        return finite(self.of(name)) if isinstance(self.kinds.get(name), T.NumericType) else F.lit(None).cast("double")

    def value(self, name: str) -> Column:
        """A finite number of whatever can be read as one."""
        kind = self.kinds.get(name)
        return finite(self.of(name).try_cast("double") if isinstance(kind, T.StringType) else self.of(name)) if isinstance(kind, T.NumericType | T.StringType | T.BooleanType) else F.lit(None).cast("double")

    def affirmed(self, name: str) -> Column:
        """True only for a boolean that is true."""
        return F.coalesce(self.of(name), F.lit(False)) if isinstance(self.kinds.get(name), T.BooleanType) else F.lit(False)

    def denied(self, name: str) -> Column:
        """True only for a boolean that is false."""
        return F.coalesce(~self.of(name), F.lit(False)) if isinstance(self.kinds.get(name), T.BooleanType) else F.lit(False)

    def entry(self, name: str, key: str) -> Column:
        return F.try_element_at(self.of(name), F.lit(key)) if isinstance(self.kinds.get(name), T.MapType) else F.lit(None).cast("string")

    def entries(self, name: str) -> Column:
        """A map as a sorted array, which can be compared; null without it."""
        return F.array_sort(F.map_entries(self.of(name))) if isinstance(self.kinds.get(name), T.MapType) else F.lit(None).cast("array<struct<key:string,value:string>>")

    def observed(self) -> Column:
        """Efficiencies of observed windows compare; those without their windows' status don't."""
        ok = [F.coalesce(x, F.lit(False)) for x in (self.entry("feature_semantics", "VE") == VE_SEMANTICS, *(self.entry("observed_window", leg) == "ok" for leg in ("charge", "discharge")))]
        return ok[0] & ok[1] & ok[2]


def _fit_flag(feature: str) -> str:
    at = feature.rfind("_soc")
    return "dcir_fit_valid" + (feature[at:] if at >= 0 else "")


def evidence(term: Term, row: _Row, base: _Row) -> Column:
    """Signed evidence in (-1, 1), null where the value is missing or out of its meaning."""
    f = term.feature
    x = row.value(f)
    if f in ("CE", "CE_local_20"):
        x = F.when(x.between(0, 100), x)
    elif f in ("VE", "VE_observed"):
        fraction = F.coalesce(row.entry("feature_units", "VE"), F.lit("fraction")) == "fraction"
        x = F.when(row.observed() & fraction & (x > 0) & (x <= 1), x)
    elif f == "CI_per_hour":
        x = F.when(~F.coalesce(row.value("CE") > 100, F.lit(False)), x)
    if f.startswith(FITTED) and _fit_flag(f) in row.kinds:
        x = F.when(row.of(_fit_flag(f)).isNull() | row.affirmed(_fit_flag(f)), x)
    scale = abs(term.scale) if abs(term.scale) > 1e-15 else 1.0
    if term.direction == "decrease_vs_baseline":
        ref = F.nullif(base.value(term.baseline_ref or f), F.lit(0.0))
        if f in ("VE", "VE_observed"):
            ref = F.when(base.observed() & (ref > 0) & (ref <= 1), ref)
        raw = (ref - x) / (F.abs(ref) * 0.1 + scale * 0.1)
    else:
        raw = {"decrease": -x, "either": F.abs(x), "decrease_from_100": 100 - x}.get(term.direction, x) / scale
    return F.tanh(raw)


def constraint_flags(row: _Row, rules: Rules) -> list[Column]:
    """Names of what limits a row's reading, null where it doesn't."""
    name = lambda test, x: F.when(F.coalesce(test, F.lit(False)), F.lit(x) if isinstance(x, str) else x)
    kind = row.text("protocol_kind")
    excluded = row.affirmed("protocol_excluded") if isinstance(row.kinds.get("protocol_excluded"), T.BooleanType) else row.of("protocol_excluded").isNotNull()
    out = [name(row.of("temperature_available").cast("string").isin("false", "False", "0", "0.0"), "no_temperature_log")]
    if rules.stack_pressure is None:
        out.append(name(row.of("stack_pressure_MPa").isNull(), "stack_pressure_unknown"))
    if not rules.halfcell_calibrated:
        out.append(F.lit("halfcell_uncalibrated"))
    out.append(name(excluded, "protocol_excluded"))
    out.append(name(~kind.isin("routine", "unknown", "nan"), F.concat(F.lit("protocol_"), kind)))
    failed = row.text("quality_gate_failed_groups")
    out.append(name(F.trim(failed) != "nan", "quality_groups_failed"))
    out.append(name(row.value("quality_score") <= 0, "quality_gate_failed"))
    return out


def confidence_factor(mode: str, flags: Column) -> Column:
    """What flags leave of a mode's confidence: nothing for failed quality or an unfit protocol."""
    has = lambda flag: F.array_contains(flags, flag)
    factor = F.when(has("halfcell_uncalibrated"), 0.95).otherwise(1.0)
    if mode in NEED_TEMPERATURE:
        factor *= F.when(has("no_temperature_log"), 0.85).otherwise(1.0)
    if mode in NEED_PRESSURE:
        factor *= F.when(has("stack_pressure_unknown"), 0.7).otherwise(1.0)
    unfit = has("quality_gate_failed") | F.exists(flags, lambda x: x.startswith("protocol_"))
    return F.when(unfit, 0.0).otherwise(factor)


def _quoted(text: str) -> str:
    """A SQL literal of a text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(entries: Sequence[tuple[str, str]]) -> str:
    """SQL of an array of the names whose tests hold."""
    return f"array_compact(array(CAST(NULL AS STRING), {', '.join(f'IF({test}, {_quoted(name)}, NULL)' for test, name in entries)}))" if entries else "CAST(array() AS ARRAY<STRING>)"


def row_tests(row: _Row, base: _Row, rules: Rules) -> dict[str, Column]:
    """What any mode's eligibility may ask about a row, true where it speaks against it or can't be told."""
    chemistry = row.text("chemistry")
    known = chemistry.isNotNull() if rules.chemistry.strip() else F.lit(False)
    sound = lambda r: r.affirmed("protocol_comparable") & (r.text("protocol_kind") == "routine") & r.denied("protocol_excluded")
    failed = row.of("quality_gate_failed_groups") if isinstance(row.kinds.get("quality_gate_failed_groups"), T.StringType) else F.lit(None).cast("string")
    failed_groups = F.transform(F.split(F.coalesce(failed, F.lit("")), ","), F.trim)
    meta = row.kinds.get("baseline_semantics")
    stated = _Row({x.name: x.dataType for x in meta.fields} if isinstance(meta, T.StructType) else {}, "baseline_semantics")
    noted = row.of("baseline_semantics").isNotNull() & stated.entries("feature_semantics").isNotNull() & F.col("_base").isNotNull()
    noted &= stated.number("cycle").eqNullSafe(base.number("cycle")) & stated.number("requested_cycle").eqNullSafe(stated.number("cycle"))
    noted = F.coalesce(noted, F.lit(False))
    tests = {
        "unverified": ~known,
        "mismatch": known & (chemistry != rules.chemistry),
        "semantics": row.entry("feature_semantics", "schema") != SEMANTICS_SCHEMA,
        "protocol": ~sound(row),
        "quality": ~(row.text("quality_status").isin("assessed", "partial") & (row.number("quality_score") > 0) & (row.number("quality_evidence_coverage") > 0)),
        "groups": F.lower(F.trim(failed)).isin("nan", "none"),
        "base_protocol": ~sound(base),
        "base_other": ~(row.of("chemistry").eqNullSafe(base.of("chemistry")) & (row.text("protocol_id") == base.text("protocol_id"))),
        "base_unnoted": ~noted,
        "base_semantics": noted & ~F.coalesce(row.entries("feature_semantics") == stated.entries("feature_semantics"), F.lit(False)),
        "window": ~(row.observed() & base.observed()),
    }
    for metric in {m: None for spec in rules.modes.values() for g in spec.groups for m in g.quality}:
        pulse = metric == "pulse_current_stability"
        poor = F.array_contains(failed_groups, "pulse_stability" if pulse else metric) | row.number(metric).isNull()
        tests[f"poor_{metric}"] = poor if pulse else poor | (row.number(metric) <= 0)
    flags = [g.fit for spec in rules.modes.values() for g in spec.groups if g.fit] + [_fit_flag(t.feature) for spec in rules.modes.values() for t in spec.terms if t.feature.startswith(FITTED)]
    tests |= {f"fit_{x}": ~row.affirmed(x) for x in dict.fromkeys(flags)}
    return {f"_t_{name}": F.coalesce(test, F.lit(True)) for name, test in tests.items()}


def eligibility_reasons(spec: Mode, used: Mapping[str, str], rules: Rules) -> Column:
    """What stands against a scientific reading of a mode's score; ``used`` has SQL that tells which features have evidence."""
    any_used = lambda features: f"({' OR '.join(['false', *(used[f] for f in features if f in used)])})"
    test = lambda name: f"`_t_{name}`"
    reasons = [(test("unverified"), "chemistry_unverified"), (test("mismatch"), "chemistry_mismatch")]
    if not spec.groups:
        return F.expr(_listed([*reasons, ("true", "eligibility_contract_unconfigured")]))
    reasons += [
        (test("semantics"), "feature_semantics_unverified"),
        (test("protocol"), "protocol_unverified_or_incompatible"),
        (test("quality"), "quality_unverified"),
        (test("groups"), "quality_groups_unverified"),
    ]
    for g in spec.groups:
        reasons.append((f"NOT {any_used(g.any_of)}", f"required_group_missing:{g.name}"))
        reasons += [(test(f"poor_{metric}"), f"required_quality_unverified:{g.name}:{metric}") for metric in g.quality]
        if g.fit:
            reasons.append((test(f"fit_{g.fit}"), f"fit_unverified:{g.name}"))
    reasons += [(f"{used[t.feature]} AND {test(f'fit_{_fit_flag(t.feature)}')}", f"fit_unverified:{t.feature}") for t in spec.terms if t.feature.startswith(FITTED)]
    relative = any_used(t.feature for t in spec.terms if t.direction == "decrease_vs_baseline" or t.feature.startswith("delta_"))
    for name, reason in (
        ("base_protocol", "baseline_protocol_unverified"),
        ("base_other", "baseline_protocol_mismatch_or_unknown"),
        ("base_unnoted", "baseline_unverified"),
        ("base_semantics", "feature_semantics_mismatch"),
    ):
        reasons.append((f"{relative} AND {test(name)}", reason))
    windowed = any_used(t.feature for t in spec.terms if t.feature in ("VE", "VE_observed"))
    reasons.append((f"{windowed} AND {test('window')}", "observed_window_unverified"))
    return F.expr(f"array_distinct({_listed(reasons)})")


def _warnings(row: _Row, base: _Row, rules: Rules, flags: Column) -> Column:
    """Limits of a row's diagnosis as a whole."""
    always = ["LLI_LAM_kinetics_proxies_confounded", "correlated_evidence_not_independent", "matched_protocol_temperature_SOC_required", "absolute_losses_not_identified"]
    out = [F.lit(x) for x in always]
    out.append(F.when(F.col("_domain") != "matched", F.concat(F.lit("chemistry_domain_"), F.col("_domain"))))
    out.append(F.when(row.value("quality_score").isNull(), "measurement_quality_unverified"))
    out.append(F.when((row.value("VE") <= 0) | (row.value("VE") > 1), "VE_outside_nominal_fraction_range_check_protocol_and_units"))
    out += [F.when((row.value(c) < 0) | (row.value(c) > 100), f"{c}_outside_nominal_percent_range_not_causal_evidence") for c in ("CE", "CE_local_20")]
    if any(c.startswith(FITTED) for c in row.kinds):
        out += [F.lit("equivalent_circuit_parameters_not_unique_mechanisms"), F.lit("ECM_requires_stable_pulse_local_linearity_and_time_resolution")]
    missing = dict.fromkeys(t.baseline_ref or t.feature for m in rules.modes.values() for t in m.terms if t.direction == "decrease_vs_baseline")
    gaps = [F.when(F.nullif(base.value(c), F.lit(0.0)).isNull(), F.lit(f"missing_baseline:{c}")) for c in missing]
    return F.array_distinct(F.concat(F.array_compact(F.array(*out)), flags, F.array_compact(F.array(F.lit(None).cast("string"), *gaps))))


def _scored(table: DataFrame, routine_only: bool) -> Column:
    """Rows to score: not excluded, and routine where any kind is known."""
    if not routine_only:
        return F.lit(True)
    kept = ~F.coalesce(F.col("protocol_excluded").cast("boolean"), F.lit(False)) if "protocol_excluded" in table.columns else F.lit(True)
    if "protocol_kind" not in table.columns:
        return kept
    kind = F.coalesce(F.col("protocol_kind").cast("string"), F.lit("unknown"))
    known = table.where(kept).agg(F.coalesce(F.bool_or(~kind.isin("unknown", "nan")), F.lit(False))).scalar()
    return kept & (~known | (kind == "routine"))


def diagnose(table: DataFrame, rules: Rules, baseline_cycle: int | None = 1, keys: Sequence[str] | None = None, routine_only: bool = True) -> DataFrame:
    """``table`` with score, confidence, evidence, status and reasons of every mode, and of the row.

    ``keys`` tell cells apart (those of cell_id, file and source_file that are there).
    The baseline is the scored row of ``baseline_cycle`` (without it a cell's first);
    a missing one stays unknown. Rows that are not scored have no scores.
    """
    keys = list(keys) if keys is not None else [c for c in ("cell_id", "file", "source_file") if c in table.columns]
    rows = table.withColumn("_scored", _scored(table, routine_only))
    candidates = rows.where("_scored")
    if baseline_cycle is not None and "cycle" in table.columns:
        candidates = candidates.where(F.col("cycle") == baseline_cycle)
    order = F.struct(*(F.col(c) for c in ("cycle",) if c in table.columns), F.lit(0))
    base = candidates.groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_key{k}") for k, c in enumerate(keys))).agg(F.min_by(F.struct(*table.columns), order).alias("_base"))
    same = [F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(f"_key{k}") for k, c in enumerate(keys)]
    rows = rows.join(base, same, "left") if keys else rows.join(base, F.lit(True), "left")
    kinds = {x.name: x.dataType for x in table.schema.fields}
    row, ref = _Row(kinds), _Row(kinds, "_base")
    status = F.when(row.text("chemistry").isNull() | F.lit(not rules.chemistry), "unverified").when(row.of("chemistry") == rules.chemistry, "matched").otherwise("mismatch")
    rows = rows.withColumns({"_flags": F.array_compact(F.array(*constraint_flags(row, rules))), "_domain": status} | row_tests(row, ref, rules))
    rows = rows.withColumns({f"_e_{m}": F.array(*(evidence(t, row, ref) for t in spec.terms)) if spec.terms else F.array().cast("array<double>") for m, spec in rules.modes.items()})

    def sums(mode: str, of) -> str:
        """SQL of a sum over a mode's terms that have evidence and a weight."""
        parts = [(f"get(`_e_{mode}`, {k})", float(t.weight)) for k, t in enumerate(rules.modes[mode].terms) if t.weight > 0]
        return f"({' + '.join(['0D', *(f'IF({x} IS NULL, 0D, {of(x, w)})' for x, w in parts)])})"

    first = {}
    for m in rules.modes:
        weight = sums(m, lambda x, w: f"{w}D")
        first |= {
            f"_n_{m}": F.expr(f"CAST({sums(m, lambda x, w: '1D')} AS INT)"),
            f"_score_{m}": clip(F.expr(f"try_divide({sums(m, lambda x, w: f'greatest({x}, 0D) * {w}D')}, nullif({weight}, 0D))"), 0.0, 1.0),
            f"_agree_{m}": F.expr(f"try_divide({sums(m, lambda x, w: f'IF({x} > 0, {w}D, 0D)')}, nullif({weight}, 0D))"),
        }
    rows = rows.withColumns(first)
    second = {}
    for m, spec in rules.modes.items():
        n, s = F.col(f"_n_{m}"), F.col(f"_score_{m}")
        coverage = n / max(1, len(spec.terms))
        quality = F.coalesce(0.6 * coverage + 0.4 * clip(row.value("quality_score"), 0.0, 1.0), coverage)
        rivals = [F.coalesce(F.col(f"_score_{o}"), F.lit(0.0)) for o in rules.modes if o != m]
        clash = (F.greatest(*rivals, F.lit(0.0)) >= rules.collision) & (s >= rules.collision) if rivals else F.lit(False)
        confidence = (0.45 * quality + 0.40 * F.col(f"_agree_{m}") + 0.15 * F.least(F.lit(1.0), n / 5.0)) * F.when(clash, 0.7).otherwise(1.0) * confidence_factor(m, F.col("_flags"))
        used = {t.feature: f"get(`_e_{m}`, {k}) IS NOT NULL" for k, t in enumerate(spec.terms)}
        second |= {
            f"_coverage_{m}": F.when(n > 0, coverage).otherwise(0.0),
            f"_quality_{m}": F.when(n > 0, quality).otherwise(0.0),
            f"_raw_{m}": F.when(n > 0, clip(confidence, 0.0, 1.0)).otherwise(0.0),
            f"_reasons_{m}": eligibility_reasons(spec, used, rules),
        }
    rows = rows.withColumns(second)
    third, scored = {}, F.col("_scored")
    supports, valids = F.lit(False), F.lit(False)
    for m, spec in rules.modes.items():
        n, raw = F.col(f"_n_{m}"), F.col(f"_raw_{m}")
        support = (n >= rules.min_evidence) & (F.col(f"_quality_{m}") >= 0.3) & (raw >= 0.25) & (F.col("_domain") != "mismatch")
        eligible = F.size(f"_reasons_{m}") == 0
        listed = lambda test: F.expr(f"array_join({_listed([(f'get(`_e_{m}`, {k}) {test}', t.feature) for k, t in enumerate(spec.terms)])}, ',')")  # noqa: B023, E731
        third |= {
            score_column(m): F.when(scored, F.col(f"_score_{m}")),
            confidence_column(m): F.when(scored, F.when(F.col("_domain") == "mismatch", 0.0).otherwise(raw)),
            f"{m}_supporting_features": F.when(scored, listed(f">= {float(rules.support)}D")),
            f"{m}_conflicting_features": F.when(scored, listed(f"<= {-float(rules.conflict)}D")),
            f"{m}_evidence_count": F.when(scored, n),
            f"{m}_evidence_coverage": F.when(scored, F.col(f"_coverage_{m}")),
            f"{m}_status": F.when(scored, F.when(n == 0, "unknown").when(support & eligible, "scientifically_eligible").when(support, "heuristic_unverified").otherwise("insufficient_or_invalid_evidence")),
            f"{m}_scientific_eligible": scored & eligible,
            f"{m}_eligibility_reasons": F.when(scored, F.col(f"_reasons_{m}")),
        }
        supports, valids = supports | support, valids | (support & eligible)
    mean = F.lit(0.0)
    for m in rules.modes:
        mean = mean + F.col(f"_quality_{m}") / len(rules.modes)
    third |= {
        "diagnosis_quality_score": F.when(scored, mean),
        "diagnosis_valid": scored & valids,
        "diagnosis_heuristic_support_valid": scored & supports,
        "diagnosis_method": F.lit(rules.method),
        "diagnosis_model_version": F.lit(rules.model_version),
        "diagnosis_version": F.lit(rules.version),
        "diagnosis_constraints": F.array_join("_flags", ","),
        "diagnosis_scored_row": scored,
        "diagnosis_status": F.when(scored & valids, "scientifically_eligible").when(scored & supports, "heuristic_unverified").otherwise("unknown"),
        "diagnosis_domain_status": F.col("_domain"),
        "diagnosis_warnings": _warnings(row, ref, rules, F.col("_flags")),
    } | {c: F.lit(None).cast("double") for c in ESTIMATES}
    return rows.withColumns(third).select(*(F.col(f"`{c}`") for c in table.columns if c not in third), *third)
