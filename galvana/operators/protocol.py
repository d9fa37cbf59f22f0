"""Protocol of cycles: routine, reference performance tests, capacity checks, and what they exclude."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galvana.operators.segment import consecutive_blocks, with_runs

#: Fixed values of the protocol rules.
ROUTINE_STEPS = 4
POST_RPT_EXCLUDE = 5
DCHG_ROUTINE_MIN_AH = 50.0
CAPA_FULL_I_RATIO = 0.85
CAPA_FULL_MIN_AH = 10.0


def steps_of(samples: DataFrame, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Step rows (``dchg, current``) out of samples with ``kind``: the last sample of each step of a cycle.

    A step is a step number where the samples have one, else a run of one kind.
    """
    keys = ["cell_id", "cycle"]
    if "step_no" in samples.columns:
        rows, step = samples, "step_no"
    else:
        rows, step = with_runs(samples, order=order), "run_id"
    q = F.col("discharge_capacity") if "discharge_capacity" in samples.columns else F.when(F.col("kind") == "discharge", F.col("capacity"))
    last = rows.groupBy(*keys, step).agg(F.max(F.struct(*order, q.alias("dchg"), F.col("current").alias("i"))).alias("_last"))
    return last.select(*keys, "_last.dchg", F.col("_last.i").alias("current"))


def cycle_steps(steps: DataFrame) -> DataFrame:
    """``n_steps, dchg, n_currents, i_median`` of every cycle from step rows (dchg, current)."""
    i = F.abs("current")
    return steps.groupBy("cell_id", "cycle").agg(
        F.count("*").alias("n_steps"),
        F.max("dchg").alias("dchg"),
        F.count_distinct(F.round("current", 3)).alias("n_currents"),
        F.median(F.when(F.col("current") < -1, i)).alias("i_median"),
    )


def protocol_flags(
    cycles: DataFrame, routine_steps: int = ROUTINE_STEPS, dchg_routine_min: float = DCHG_ROUTINE_MIN_AH, i_ratio: float = CAPA_FULL_I_RATIO, capa_min: float = CAPA_FULL_MIN_AH
) -> DataFrame:
    """Add ``rpt, capacheck, capa_full`` to cycles with ``n_steps, dchg, i_median``.

    A cycle of other than the routine number of steps is a performance test, and a
    capacity check if its discharge stays below the routine one. A routine one at
    a current clearly below the cell's usual (the most frequent of half-ampere
    bins, the lower of two; at least three cycles) is a full capacity cycle.
    """
    enough = (F.col("n_steps") == routine_steps) & (F.col("dchg") >= capa_min) & (F.col("i_median") > 1)
    bins = cycles.where(enough).withColumn("_bin", F.round(F.col("i_median") * 2) / 2).groupBy("cell_id", "_bin").agg(F.count("*").alias("_n"))
    usual = bins.groupBy("cell_id").agg(F.max_by("_bin", F.struct("_n", (-F.col("_bin")).alias("b"))).alias("i_usual"), F.sum("_n").alias("n_usual"))
    rpt = F.col("n_steps") != routine_steps
    low = F.coalesce((F.col("n_usual") >= 3) & (F.col("i_median") < i_ratio * F.col("i_usual")), F.lit(False))
    return (
        cycles.join(usual, "cell_id", "left")
        .withColumns({
            "rpt": rpt,
            "capacheck": F.coalesce(rpt & (F.col("dchg") > 0) & (F.col("dchg") < dchg_routine_min), F.lit(False)),
            "capa_full": F.coalesce(enough & low, F.lit(False)),
        })
        .drop("i_usual", "n_usual")
    )


def protocol_kinds(flags: DataFrame, post: int = POST_RPT_EXCLUDE) -> DataFrame:
    """``protocol_kind, protocol_excluded`` of every cycle: tests, full capacity cycles and the cycles after a block go."""
    blocks = consecutive_blocks(flags.where("rpt"))
    after = blocks.select("cell_id", F.explode(F.sequence(F.col("block_end") + 1, F.col("block_end") + post)).alias("cycle")).distinct()
    joined = flags.join(after.withColumn("_post", F.lit(True)), ["cell_id", "cycle"], "left")
    kind = F.when(F.col("capacheck"), "capacheck").when(F.col("rpt"), "rpt").when(F.col("capa_full"), "capa_full").when(F.col("_post"), "post_rpt").otherwise("routine")
    return joined.select("cell_id", "cycle", kind.alias("protocol_kind")).withColumn("protocol_excluded", F.col("protocol_kind") != "routine")


def attach_protocol(features: DataFrame, kinds: DataFrame) -> DataFrame:
    """Features with their cycle's kind; unknown and not excluded where there is none."""
    joined = features.join(kinds, ["cell_id", "cycle"], "left")
    return joined.withColumns({"protocol_kind": F.coalesce("protocol_kind", F.lit("unknown")), "protocol_excluded": F.coalesce("protocol_excluded", F.lit(False))})


def scoring_rows(features: DataFrame) -> DataFrame:
    """Rows to score: not excluded, and routine; all rows where no kind is known, none where kinds hold no routine one."""
    known = features.agg(F.coalesce(F.bool_or(F.col("protocol_kind") != "unknown"), F.lit(False))).scalar()
    return features.where((~known | (F.col("protocol_kind") == "routine")) & ~F.col("protocol_excluded"))


def rpt_checkpoints(flags: DataFrame) -> DataFrame:
    """Each test block with the cycle that stands for it and its life.

    The full capacity cycle just before the block, else its first capacity check,
    else its middle. Life is 1 for early blocks, else the hundreds before the start.
    """
    blocks = consecutive_blocks(flags.where("rpt"))
    full = consecutive_blocks(flags.where("capa_full")).select("cell_id", (F.col("block_end") + 1).alias("block_start"), F.floor((F.col("block_start") + F.col("block_end")) / 2).alias("full_cycle"))
    checks = flags.where("capacheck").select("cell_id", "cycle")
    inside = blocks.join(checks, "cell_id").where(F.col("cycle").between(F.col("block_start"), F.col("block_end"))).groupBy("cell_id", "block_start").agg(F.min("cycle").alias("check_cycle"))
    life = F.when(F.col("block_start") <= 10, 1).otherwise(F.greatest(F.lit(100), F.floor((F.col("block_start") - 1) / 100) * 100))
    middle = F.floor((F.col("block_start") + F.col("block_end")) / 2)
    joined = blocks.join(full, ["cell_id", "block_start"], "left").join(inside, ["cell_id", "block_start"], "left")
    return joined.select("cell_id", "block_start", "block_end", life.cast("long").alias("life"), F.coalesce("full_cycle", "check_cycle", middle).cast("long").alias("anchor_cycle"))
