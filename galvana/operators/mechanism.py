"""Which mechanism a cell's aging points to: silicon first (H1), all of the electrode (H2), both, or impedance alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions.expr import clip, finite, ratio

#: Evidence for each mechanism as (column, what is expected of it, weight).
EVIDENCE = {
    "H1": (
        ("Q_cliff_abs_slope_100", "near_zero", 1.2),
        ("Q_cliff_frac_slope_100", "positive", 1.0),
        ("SOC0_to_mid_ratio_slope_100", "positive", 1.3),
        ("dchg_fit_residual_argmax_SOC", "low_soc", 1.0),
        ("LLI_vs_R_ratio", "small", 0.8),
        ("fade_ratio_Si_Gr", "large", 1.0),
    ),
    "H2": (
        ("Q_cliff_abs_slope_100", "negative", 1.3),
        ("LLI_vs_R_ratio", "large", 1.2),
        ("dchg_fit_residual_argmax_SOC", "dispersed", 0.7),
        ("fade_ratio_Si_Gr", "near_one", 1.1),
        ("dchg_fit_scale_slope_100", "negative", 0.9),
    ),
}
#: Slopes per 100 cycles, over the last 100 rows of a cell, and the columns they are of.
SLOPES = {
    "Q_cliff_abs_slope_100": "dchg_Q_cliff_abs",
    "Q_cliff_frac_slope_100": "Q_cliff_frac",
    "SOC0_to_mid_ratio_slope_100": "dchg_dVdQ_SOC0_to_mid_ratio",
    "RCF_slope_100": "RCF",
    "dchg_fit_scale_slope_100": "dchg_fit_scale",
}
#: Fixed value: a resistance that passes its limit by less stands at it; sums in another order differ by this little.
_ROUNDING = 1e-9
_INPUTS = ("dchgCapa", "RCF", "dchg_Q_cliff_abs", "dchg_dVdQ_SOC0_to_mid_ratio", "dchg_Q_high_V", "dchg_Q_low_V", "dchg_fit_scale", "dchg_fit_offset", "dchg_fit_dR", "dchg_fit_residual_argmax_SOC", "LLI_vs_R_ratio")


def _signed(x: Column, expected: str) -> Column:
    """What a value says for its expectation, from -1 to 1."""
    return clip({
        "near_zero": 1 - F.abs(x) / 0.5,
        "negative": -x / 0.3,
        "positive": x / 0.3,
        "low_soc": (30 - x) / 30,
        "dispersed": (x - 40) / 40,
        "small": 1 - x / 2,
        "large": x / 3 - 0.5,
        "near_one": 1 - F.abs(x - 1) / 0.5,
    }[expected], -1.0, 1.0)


def classify(rows: DataFrame) -> DataFrame:
    """Add ``mechanism_state, score_H1, score_H2, mechanism_confidence, n_evidence`` from the columns that are there.

    Missing values say nothing. A grown resistance (over 2 by more than rounding) at kept capacity (within
    3 %) and fallen rate capability (below 95 % of the start's) is impedance alone.
    Fewer than two pieces of evidence leave it undetermined, scores within 0.15 mean
    mixed.
    """
    col = lambda c: finite(c) if c in rows.columns else F.lit(None).cast("double")
    sure = lambda test: F.coalesce(test, F.lit(False))
    kept = F.abs(ratio(col("dchgCapa"), col("dchgCapa_bol")) - 1) < 0.03
    weak = F.when(col("RCF_bol").isNotNull(), col("RCF") < col("RCF_bol") * 0.95).otherwise(col("RCF") < 0.95)
    gate = sure(F.abs(col("dchg_fit_dR")) > 2 + _ROUNDING) & sure(kept) & sure(weak)
    score = {}
    for name, terms in EVIDENCE.items():
        total, weight = F.lit(0.0), F.lit(0.0)
        for c, expected, w in terms:
            total = total + F.coalesce(_signed(col(c), expected) * w, F.lit(0.0))
            weight = weight + F.when(col(c).isNotNull(), w).otherwise(0.0)
        score[name] = F.coalesce(F.try_divide(total, F.nullif(weight, F.lit(0.0))), F.lit(0.0))
    n = F.lit(0)
    for c in dict.fromkeys(c for terms in EVIDENCE.values() for c, _, _ in terms):
        n = n + col(c).isNotNull().cast("int")
    out = rows.withColumns({"_gate": gate, "n_evidence": n, "_h1": score["H1"], "_h2": score["H2"]})
    apart = F.abs(F.col("_h1") - F.col("_h2"))
    state = F.when(F.col("_gate"), "impedance_only").when(F.col("n_evidence") < 2, "undetermined").when(apart < 0.15, "mixed").when(F.col("_h1") > F.col("_h2"), "H1_dominant").otherwise("H2_dominant")
    confidence = F.when(F.col("_gate"), 0.7).when(F.col("n_evidence") < 2, 0.2).otherwise(clip(0.3 + 0.35 * F.col("n_evidence") / 6 + 0.35 * apart, 0.0, 1.0))
    none = lambda c: F.when(F.col("_gate"), 0.0).otherwise(F.col(c))
    return out.withColumns({"mechanism_state": state, "score_H1": none("_h1"), "score_H2": none("_h2"), "mechanism_confidence": confidence}).drop("_gate", "_h1", "_h2")


def mechanism_indicators(table: DataFrame, baseline_cycle: int | None = None, keys: Sequence[str] = ("cell_id",), window: int = 100) -> DataFrame:
    """Ratios to the beginning of life, slopes, the mechanism of every row, and the first cycle at which the scores' order flips.

    The beginning is the row of ``baseline_cycle``, without it (or where it is
    missing) a cell's first. A slope takes a cell's last ``window`` rows with a value,
    where it has five.
    """
    keys = list(keys)
    missing = {c: F.lit(None).cast("double") for c in _INPUTS if c not in table.columns}
    rows = table.withColumns(missing) if missing else table
    cell = Window.partitionBy(*keys)
    past = cell.orderBy("cycle")
    start = F.min(F.struct((F.col("cycle") != (baseline_cycle if baseline_cycle is not None else F.col("cycle"))).alias("other"), "cycle", *_INPUTS)).over(cell)
    rows = rows.withColumn("_bol", start)
    bol = lambda c: F.when(F.col(f"_bol.{c}") > 0, F.col(f"_bol.{c}"))
    fade_gr, fade_si = (1 - ratio(c, bol(c)) for c in ("dchg_Q_high_V", "dchg_Q_low_V"))
    rows = rows.withColumns({
        "dchgCapa_bol": F.col("_bol.dchgCapa"),
        "RCF_bol": F.col("_bol.RCF"),
        "Q_cliff_frac": F.when(F.col("dchgCapa") > 0, ratio("dchg_Q_cliff_abs", "dchgCapa")),
        "Q_cliff_abs_norm_bol": ratio("dchg_Q_cliff_abs", bol("dchg_Q_cliff_abs")),
        "SOC0_to_mid_ratio_norm_bol": ratio("dchg_dVdQ_SOC0_to_mid_ratio", bol("dchg_dVdQ_SOC0_to_mid_ratio")),
        "C_Gr_abs": F.col("dchg_Q_high_V"),
        "C_Si_abs": F.col("dchg_Q_low_V"),
        "C_Gr_frac": F.when(F.col("dchgCapa") > 0, ratio("dchg_Q_high_V", "dchgCapa")),
        "fade_ratio_Si_Gr": F.when(F.abs(fade_gr) > 1e-6, fade_si / fade_gr),
        "LLI_LAM_ratio": F.when(1 - F.col("dchg_fit_scale") > 1e-6, F.abs("dchg_fit_offset") / (1 - F.col("dchg_fit_scale"))),
    }).drop("_bol")
    slopes = {}
    for name, c in SLOPES.items():
        value = finite(c)
        from_end = F.count(value).over(cell.orderBy(F.desc("cycle")).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn(f"_v_{name}", F.when(from_end <= window, value))
        x, y = F.col("cycle").cast("double"), F.col(f"_v_{name}")
        slopes[name] = F.when(F.count(y).over(cell) >= 5, F.regr_slope(y, x).over(cell) * 100)
    rows = classify(rows.withColumns(slopes).drop(*(f"_v_{name}" for name in SLOPES)))
    sign = F.signum(F.col("score_H1") - F.col("score_H2"))
    flip = F.when(sign != F.lag(sign).over(past), F.col("cycle"))
    return rows.withColumn("_flip", flip).withColumn("mechanism_crossover_cycle", F.min("_flip").over(cell)).drop("_flip", *missing)


def arms_from_start(features: DataFrame, baseline_cycle: int | None = None, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Arms on a common footing: each row relative to its own cell's beginning of life, never in absolute terms across arms."""
    found = mechanism_indicators(features, baseline_cycle, keys)
    names = ("arm", *keys, "cycle", "Q_cliff_abs_norm_bol", "SOC0_to_mid_ratio_norm_bol", "fade_ratio_Si_Gr", "mechanism_state", "score_H1", "score_H2", "LLI_vs_R_ratio", "dchg_fit_dR", "RCF")
    return found.select(*(c for c in names if c in found.columns))


def first_flip(table: DataFrame, column: str, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """The first cycle at which a column's sign differs from the one before; null without."""
    w = Window.partitionBy(*keys).orderBy("cycle")
    flipped = F.signum(column) * F.lag(F.signum(column)).over(w) < 0
    return table.withColumn("_f", flipped).groupBy(*keys).agg(F.min(F.when(F.col("_f"), F.col("cycle"))).alias("flip_cycle"))


def two_variable_fit(table: DataFrame, x: str, z: str, y: str) -> DataFrame:
    """``n, b0, b1, b2, r2`` of y on x and z: normal equations out of one pass of moments."""
    rows = table.where(F.col(x).isNotNull() & F.col(z).isNotNull() & F.col(y).isNotNull())
    m = rows.agg(
        F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.avg(z).alias("mz"),
        F.var_pop(x).alias("xx"), F.var_pop(z).alias("zz"), F.var_pop(y).alias("yy"),
        F.covar_pop(x, z).alias("xz"), F.covar_pop(x, y).alias("xy"), F.covar_pop(z, y).alias("zy"),
    )
    det = F.nullif(F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz"), F.lit(0.0))
    m = m.withColumns({"b1": (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / det, "b2": (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / det})
    return m.select("n", (F.col("my") - F.col("b1") * F.col("mx") - F.col("b2") * F.col("mz")).alias("b0"), "b1", "b2", ratio(F.col("b1") * F.col("xy") + F.col("b2") * F.col("zy"), "yy").alias("r2"))
