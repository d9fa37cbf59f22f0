"""Streams of cycler samples: cycles that close, and samples that come late. An addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_cycles(samples: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """One row for each session of a cell and cycle without a gap, once the watermark has passed it.

    Samples have ``cell_id, cycle, ts, voltage, current, capacity``; those later than
    the watermark are dropped by Spark. The same function works on a batch.
    """
    return (
        samples.withWatermark("ts", late)
        .groupBy("cell_id", "cycle", F.session_window("ts", gap).alias("session"))
        .agg(
            F.count("*").alias("n"),
            F.min("voltage").alias("v_min"),
            F.max("voltage").alias("v_max"),
            F.max(F.when(F.col("current") > 0, F.col("capacity"))).alias("chgCapa"),
            F.max(F.when(F.col("current") < 0, F.col("capacity"))).alias("dchgCapa"),
        )
        .select("cell_id", "cycle", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n", "v_min", "v_max", "chgCapa", "dchgCapa")
    )


def leg_totals(samples: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Charge moved by window and cell, for append mode."""
    return (
        samples.withWatermark("ts", late)
        .groupBy("cell_id", F.window("ts", window).alias("w"))
        .agg(F.sum(F.greatest(F.lit(0.0), "current")).alias("in_a"), F.sum(F.greatest(F.lit(0.0), -F.col("current"))).alias("out_a"))
        .select("cell_id", F.col("w.start").alias("start"), "in_a", "out_a")
    )
