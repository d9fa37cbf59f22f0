"""What a reference performance test leaves in the health of the routine cycles after it, and health without that."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions import kernels
from galvana.functions.expr import ratio, slope
from galvana.operators.curves import _grouped
from galvana.operators.segment import consecutive_blocks

#: Noise of capacity in %, cycles left out after a test, rows of an anchor, rows before and after a block.
NOISE_PCT, POST_EXCLUDE, ANCHOR_ROWS, BEFORE_ROWS, AFTER_ROWS = 0.065, 5, 5, 20, 20

_FIT = (
    "n_pre", "n_post", "pre_anchor", "pre_anchor_cycle", "pre_anchor_n", "post_first", "pre_immediate", "trend_slope", "trend_intercept",
    "amplitude", "decay", "fit_r2", "fit_rmse", "permanent_step_pct",
)


def with_roles(table: DataFrame, kinds: DataFrame) -> DataFrame:
    """Add ``cycle_role, SoHQ_mixed, SoHQ_routine, SoHQ_rpt``: health of routine cycles apart from that of full capacity cycles."""
    rows = table.join(kinds.select("cell_id", "cycle", F.col("protocol_kind").alias("cycle_role")), ["cell_id", "cycle"], "left")
    role = F.coalesce("cycle_role", F.lit("routine"))
    rows = rows.withColumn("cycle_role", F.when(role == "capacheck", "rpt").otherwise(role))
    only = lambda r: F.when(F.col("cycle_role") == r, F.col("SoHQ"))
    return rows.withColumns({"SoHQ_mixed": F.col("SoHQ"), "SoHQ_routine": only("routine"), "SoHQ_rpt": only("capa_full")})


def block_fits(series: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each block's level before, first value after, trend of the routine cycles before, and the exponential that rises above it after.

    ``series`` has cell_id, cycle and SoHQ_routine. A block takes the last 20 routine
    cycles before it and the first 20 after it (before the next block); the anchor is
    the mean of the last five. The fit asks for two and four of them; its amplitude lies
    in 0 to 20 %, its decay in 0.5 to 80 cycles. The permanent step is what the last five
    corrected values lie above the trend.
    """
    w = Window.partitionBy("cell_id")
    blocks = blocks.select("cell_id", "block_start", "block_end").withColumns({"block_id": F.row_number().over(w.orderBy("block_start")), "_next": F.lead("block_start").over(w.orderBy("block_start"))})
    rows = blocks.join(series.where("cycle_role = 'routine'").select("cell_id", "cycle", F.col("SoHQ_routine").cast("double").alias("y")), "cell_id")
    # A block meets its own cell's cycles only: they lie before it, or after it and before the next one.
    side = F.when(F.col("cycle") < F.col("block_start"), "before").when((F.col("cycle") > F.col("block_end")) & (F.col("_next").isNull() | (F.col("cycle") < F.col("_next"))), "after")
    rows = rows.withColumn("_side", side).where("_side is not null")
    near = Window.partitionBy("cell_id", "block_id", "_side")
    place = F.when(F.col("_side") == "before", F.row_number().over(near.orderBy(F.desc("cycle")))).otherwise(F.row_number().over(near.orderBy("cycle")))
    rows = rows.withColumn("_place", place).where(F.col("_place") <= F.when(F.col("_side") == "before", BEFORE_ROWS).otherwise(AFTER_ROWS))

    def f(g):
        out: dict = dict.fromkeys(_FIT, np.nan)
        before = g["_side"] == "before"
        x, y, k = g["cycle"].astype(float), g["y"].astype(float), g["cycle"] - g["block_end"]
        pre_x, pre_y, post_x, post_y = x[before], y[before], x[~before], y[~before]
        out |= {"n_pre": float(len(pre_x)), "n_post": float(len(post_x))}
        known = np.isfinite(pre_y[-ANCHOR_ROWS:])
        if known.any():
            out |= {"pre_anchor": float(pre_y[-ANCHOR_ROWS:][known].mean()), "pre_anchor_cycle": float(pre_x[-ANCHOR_ROWS:].mean()), "pre_anchor_n": float(known.sum())}
        if len(pre_y):
            out["pre_immediate"] = float(pre_y[-1])
        if len(post_y):
            out["post_first"] = float(post_y[0])
        ok_pre, ok = np.isfinite(pre_y), np.isfinite(post_y)
        if ok_pre.sum() < 2 or ok.sum() < 4:
            return out
        a, b = np.polyfit(pre_x[ok_pre], pre_y[ok_pre], 1)
        trend = a * post_x[ok] + b
        above, rel = post_y[ok] - trend, k[~before][ok].astype(float)
        p, cost = kernels.least_squares(lambda p: p[0] * np.exp(-rel / p[1]) - above, (max(float(above[0]), 0.01), POST_EXCLUDE), (0.0, 0.5), (20.0, 80.0))
        spread = float(((above - above.mean()) ** 2).sum())
        rest = above - p[0] * np.exp(-rel / p[1])
        return out | {
            "trend_slope": float(a), "trend_intercept": float(b), "amplitude": float(p[0]), "decay": float(p[1]),
            "fit_r2": 1 - cost / spread if spread > 1e-12 else np.nan, "fit_rmse": float(np.sqrt((rest**2).mean())), "permanent_step_pct": float(rest[-5:].mean()),
        }

    found = _grouped(rows, ["cell_id", "block_id", "block_start", "block_end"], ["cycle", "y", "_side", "block_end"], ["cycle"], ", ".join(f"{c} double" for c in _FIT), f)
    found = blocks.drop("_next").join(found, ["cell_id", "block_id", "block_start", "block_end"], "left")
    return found.withColumns({
        "delta_first_vs_anchor": F.col("post_first") - F.col("pre_anchor"),
        "delta_first_vs_immediate": F.col("post_first") - F.col("pre_immediate"),
        "bump_significant": F.coalesce((F.col("amplitude") >= NOISE_PCT) & (F.coalesce("fit_r2", F.lit(0.0)) >= 0.5), F.lit(False)),
    })


def segment_contamination(series: DataFrame, fits: DataFrame) -> DataFrame:
    """``fade_intra, fade_inter, bump_contamination`` of each stretch between two blocks: its own slope against that of the anchors."""
    w = Window.partitionBy("cell_id").orderBy("block_id")
    ahead = {f"_{c}": F.lead(c).over(w) for c in ("block_start", "pre_anchor", "pre_anchor_cycle")}
    spans = fits.withColumns(ahead).where("_pre_anchor is not null and pre_anchor is not null and _pre_anchor_cycle <> pre_anchor_cycle")
    spans = spans.select("cell_id", "block_id", "block_end", F.col("_block_start").alias("next_start"), ((F.col("_pre_anchor") - F.col("pre_anchor")) / (F.col("_pre_anchor_cycle") - F.col("pre_anchor_cycle"))).alias("fade_inter"))
    routine = series.where("cycle_role = 'routine'").select("cell_id", "cycle", "SoHQ_routine")
    inside = spans.join(routine, "cell_id").where((F.col("cycle") > F.col("block_end")) & (F.col("cycle") < F.col("next_start")))
    found = inside.groupBy("cell_id", "block_id", "block_end", "next_start", "fade_inter").agg(F.count("*").alias("n"), slope("SoHQ_routine", "cycle").alias("fade_intra")).where("n >= 5")
    return found.withColumn("bump_contamination", F.when(F.abs("fade_inter") > 1e-9, ratio("fade_intra", "fade_inter") - 1))


def corrected(series: DataFrame, fits: DataFrame) -> DataFrame:
    """Add ``SoHQ_corrected, recovery_component, Q_trend``: routine health without the exponential after each block."""
    good = fits.where("amplitude is not null").select("cell_id", "block_start", "block_end", "amplitude", "decay", "trend_slope", "trend_intercept")
    w = Window.partitionBy("cell_id").orderBy("block_start")
    good = good.withColumn("_next", F.lead("block_start").over(w))
    routine = series.where("cycle_role = 'routine'").select("cell_id", "cycle")
    after = good.join(routine, "cell_id").where((F.col("cycle") > F.col("block_end")) & (F.col("_next").isNull() | (F.col("cycle") < F.col("_next"))))
    place = F.row_number().over(Window.partitionBy("cell_id", "block_start").orderBy("cycle"))
    k = F.col("cycle") - F.col("block_end")
    after = after.withColumn("_place", place).where(F.col("_place") <= AFTER_ROWS)
    parts = after.select("cell_id", "cycle", (F.col("amplitude") * F.exp(-k / F.col("decay"))).alias("recovery_component"), (F.col("trend_slope") * F.col("cycle") + F.col("trend_intercept")).alias("Q_trend"))
    rows = series.join(parts, ["cell_id", "cycle"], "left").withColumn("recovery_component", F.coalesce("recovery_component", F.lit(0.0)))
    return rows.withColumn("SoHQ_corrected", F.col("SoHQ_routine") - F.col("recovery_component"))


def knee_onset(rows: DataFrame, health: str = "SoHQ_corrected", sigmas: float = 3.0, least_cycle: float = 100.0) -> DataFrame:
    """``knee_cycle, method``: the first cycle whose curvature exceeds that many spreads of the early ones, of 40 routine cycles or more."""

    def f(g):
        ok = np.isfinite(g[health].astype(float))
        x, y = g["cycle"][ok].astype(float), g[health][ok].astype(float)
        if len(x) < 40:
            return {"knee_cycle": np.nan, "method": "insufficient_points"}
        window = max(11, len(x) // 10) | 1
        y = kernels.smooth(y, min(window, (len(x) - 2) | 1 if len(x) % 2 else len(x) - 3))
        bend = np.gradient(np.gradient(y, x), x)
        early = bend[: max(20, len(x) // 5)]
        sigma = early.std() or 1.4826 * np.median(np.abs(early - np.median(early)))
        at = np.flatnonzero((x >= least_cycle) & (np.abs(bend) > sigmas * sigma))
        return {"knee_cycle": float(x[at[0]]), "method": "curvature"} if len(at) else {"knee_cycle": np.nan, "method": "no_exceedance"}

    return _grouped(rows.where("cycle_role = 'routine'"), ["cell_id"], ["cycle", health], ["cycle"], "knee_cycle double, method string", f)


def bump_onset(fits: DataFrame, noise_pct: float = NOISE_PCT, least_r2: float = 0.5) -> DataFrame:
    """``bump_block_id, bump_cycle, bump_amplitude``: each cell's first block whose amplitude exceeds the noise with a fit good enough (or unrated)."""
    hit = fits.where((F.col("amplitude") >= noise_pct) & (F.col("fit_r2").isNull() | (F.col("fit_r2") >= least_r2)))
    first = hit.groupBy("cell_id").agg(F.min(F.struct("block_id", "block_start", "amplitude")).alias("_b"))
    return first.select("cell_id", F.col("_b.block_id").alias("bump_block_id"), F.col("_b.block_start").alias("bump_cycle"), F.col("_b.amplitude").alias("bump_amplitude"))


def onsets(fits: DataFrame, rows: DataFrame) -> DataFrame:
    """Bump and knee of each cell, which comes first and by how many cycles; unknown unless both are there."""
    found = knee_onset(rows).join(bump_onset(fits), "cell_id", "left")
    gap = F.col("knee_cycle") - F.col("bump_cycle")
    return found.withColumns({"cycle_gap": gap, "bump_precedes_knee": gap > 0})


def analyze(table: DataFrame, kinds: DataFrame, flags: DataFrame) -> dict[str, DataFrame]:
    """The whole analysis: ``series, blocks, segments, corrected, onsets``. Blocks are tests of three cycles or more."""
    series = with_roles(table, kinds)
    fits = block_fits(series, consecutive_blocks(flags.where("rpt"), min_len=3))
    without = corrected(series, fits)
    return {"series": series, "blocks": fits, "segments": segment_contamination(series, fits), "corrected": without, "onsets": onsets(fits, without)}
