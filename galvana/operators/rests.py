"""Voltages of rests after charge and discharge, with the reason where one is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galvana.functions.expr import finite
from galvana.operators.asof import sample_at
from galvana.operators.segment import KEYS, rest_periods, with_runs


def rest_samples(samples: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """The samples (with ``kind``) of rests that follow a leg: ``run_id, after_leg, t, voltage``.

    ``t`` counts from a rest's start: by the step's clock where half its samples (two
    at least) have one, else by the total time where two have, else by samples.
    """
    periods = rest_periods(samples, keys, order).select(*keys, "run_id", "after_leg")
    rows = with_runs(samples, keys=keys, order=order).join(periods, [*keys, "run_id"])
    w = Window.partitionBy(*keys, "run_id")
    by = w.orderBy(*order)
    t = (F.row_number().over(by) - 1).cast("double")
    for c, least in (("time", F.lit(2)), ("step_time", F.greatest(F.lit(2), F.floor(F.count("*").over(w) / 2)))):
        if c in samples.columns:
            x = finite(c)
            start = F.first(x, True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            t = F.when(F.count(x).over(w) >= least, x - start).otherwise(t)
    return rows.select(*keys, "run_id", "after_leg", *order, t.alias("t"), finite("voltage").alias("voltage"))


def rest_voltages(samples: DataFrame, offsets: Sequence[float] = (0.1, 60.0), keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``run_id, after_leg, rest_duration_s, offset, voltage, status``: every rest at every offset (seconds).

    The status is ok, before_start, beyond_rest, single_point (a rest of one sample
    has a voltage at its own time alone) or no_data.
    """
    rows = rest_samples(samples, keys, order)
    group = [*keys, "run_id", "after_leg"]
    good = F.col("t").isNotNull() & F.col("voltage").isNotNull()
    spans = rows.groupBy(*group).agg(F.min(F.when(good, F.col("t"))).alias("_t0"), F.max(F.when(good, F.col("t"))).alias("rest_duration_s"), F.count(F.when(good, F.lit(1))).alias("_n"))
    asked = spans.withColumn("offset", F.explode(F.array(*(F.lit(float(o)) for o in offsets))))
    found = asked.join(sample_at(rows.where(good), "t", ["voltage"], offsets, group), [*group, "offset"], "left")
    o = F.col("offset")
    status = (
        F.when(F.col("_n") == 0, "no_data")
        .when(o < F.col("_t0") - 1e-9, "before_start")
        .when(o > F.col("rest_duration_s") + 1e-9, "beyond_rest")
        .when(F.col("_n") == 1, "single_point")
        .otherwise("ok")
    )
    value = F.when(status.isin("ok", "single_point"), F.col("voltage"))
    return found.select(*group, "rest_duration_s", "offset", value.alias("voltage"), status.alias("status"))


def _suffix(offset: float) -> str:
    return f"{offset:g}s"


def rest_table(samples: DataFrame, offsets: Sequence[float] = (0.1, 60.0), keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """One row for each rest with ``v_{offset}s, status_{offset}s``; a cycle without any has one row of status no_rest."""
    found = rest_voltages(samples, offsets, keys, order)
    at = lambda c, o: F.max(F.when(F.col("offset") == o, F.col(c)))
    wide = found.groupBy(*keys, "run_id", "after_leg", "rest_duration_s").agg(*(at(c, o).alias(f"{p}_{_suffix(o)}") for o in offsets for c, p in (("voltage", "v"), ("status", "status"))))
    wide = wide.withColumn("method", F.lit("step_type"))
    none = samples.select(*keys).distinct().join(wide.select(*keys).distinct(), list(keys), "left_anti")
    none = none.withColumns({"method": F.lit("no_rest"), **{f"status_{_suffix(o)}": F.lit("no_rest") for o in offsets}})
    return wide.unionByName(none, allowMissingColumns=True)


def rest_sheets(table: DataFrame, offsets: Sequence[float]) -> dict[str, DataFrame]:
    """The tables of a rest report: all rests, those after charge and after discharge, and counts."""
    label = F.when(F.col("after_leg") == "charge", "EoC (after charge)").when(F.col("after_leg") == "discharge", "EoD (after discharge)").otherwise("")
    volts = [F.col(f"v_{_suffix(o)}").alias(f"V_{_suffix(o)}") for o in offsets]
    every = table.select("cell_id", "cycle", "after_leg", label.alias("rest_label"), "rest_duration_s", "method", *volts)
    leg = lambda x: every.where(F.col("after_leg") == x).drop("after_leg", "rest_label")
    count = lambda test: F.count(F.when(test, F.lit(1))).cast("string")
    items = {
        "sample_times_s": F.lit(", ".join(f"{o:g}" for o in offsets)),
        "n_rows": F.count("*").cast("string"),
        "n_eoc_rows": count(F.col("after_leg") == "charge"),
        "n_eod_rows": count(F.col("after_leg") == "discharge"),
        "n_cells": F.count_distinct("cell_id").cast("string"),
    }
    meta = table.agg(F.array(*(F.struct(F.lit(k).alias("item"), x.alias("value")) for k, x in items.items())).alias("_i")).select(F.inline("_i"))
    return {"All": every, "EoC": leg("charge"), "EoD": leg("discharge"), "Meta": meta}


def leg_rests(samples: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """``{EoC,EoD}_restV_{init,60s,30m,end}`` and their differences: the last rest after each leg of a cycle."""
    at = {"init": 0.0, "60s": 60.0, "30m": 1800.0}
    rows = rest_samples(samples, keys, order).where("t is not null and voltage is not null")
    last = rows.groupBy(*keys, "after_leg").agg(F.max("run_id").alias("run_id"))
    rows = rows.join(last, [*keys, "after_leg", "run_id"])
    group = [*keys, "after_leg"]
    ends = rows.groupBy(*group).agg(F.max_by("voltage", F.struct("t", *order)).alias("end"), F.min_by("voltage", F.struct("t", *order)).alias("first"))
    sampled = sample_at(rows, "t", ["voltage"], list(at.values()), group)
    pick = lambda leg, name: F.max(F.when((F.col("after_leg") == leg) & (F.col("offset") == at[name]), F.col("voltage")))
    of = lambda leg, c: F.max(F.when(F.col("after_leg") == leg, F.col(c)))
    joined = sampled.join(ends, group)
    out: list[Column] = []
    for prefix, leg in (("EoC", "charge"), ("EoD", "discharge")):
        out += [F.coalesce(pick(leg, "init"), of(leg, "first")).alias(f"{prefix}_restV_init"), pick(leg, "60s").alias(f"{prefix}_restV_60s"), pick(leg, "30m").alias(f"{prefix}_restV_30m"), of(leg, "end").alias(f"{prefix}_restV_end")]
    wide = joined.groupBy(*keys).agg(*out)
    return wide.withColumns({
        name: F.col(f"{p}_restV_{a}") - F.col(f"{p}_restV_init") for p in ("EoC", "EoD") for name, a in ((f"{p}_restV_relax", "end"), (f"{p}_restV_relax_60s", "60s"))
    })


def rest_taus(rests: DataFrame, keys: Sequence[str], order: Sequence[str] = ("row_id",), least: int = 8) -> DataFrame:
    """``tau``: each rest's (time, voltage) time constant in seconds, by regression of the log distance from its end.

    The end is the mean of the last fifth of the rest (three samples or more), which takes no
    part. The first tenth (one sample or more) does, and of the others those off the end
    by 1e-4 of the first distance (1 V at least). Five samples are needed, none of them on the
    end itself, and no more than 1e6 seconds are believed. A rest is a few thousand
    samples: its windows share one sort.
    """
    known = rests.where("time is not null and voltage is not null and not isnan(time) and not isnan(voltage)").select(*keys, *(c for c in order if c not in ("time", "voltage")), "time", "voltage")
    by = Window.partitionBy(*keys).orderBy("time", *(c for c in order if c != "time"))
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = known.withColumns({"_k": F.row_number().over(by), "_n": F.count("*").over(whole), "_t": F.col("time") - F.first("time").over(whole)})
    tail = F.col("_k") > F.col("_n") - F.greatest(F.lit(3), F.floor(F.col("_n") / 5))
    rows = rows.withColumn("_tail", tail).withColumn("_off", F.abs(F.col("voltage") - F.avg(F.when(F.col("_tail"), F.col("voltage"))).over(whole)))
    away = F.col("_off") > 1e-4 * F.greatest(F.lit(1.0), F.first("_off").over(whole))
    rows = rows.withColumn("_use", ~F.col("_tail") & (away | (F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10)))))
    used = rows.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.count_if("_use").alias("_used"), F.min(F.when(F.col("_use"), F.col("_off"))).alias("_least"),
        F.regr_slope(F.when(F.col("_use") & (F.col("_off") > 0), F.log("_off")), "_t").alias("_slope"),
    )
    tau = -1 / F.col("_slope")
    told = (F.col("_n") >= least) & (F.col("_used") >= 5) & (F.col("_least") > 0) & (F.col("_slope") < -1e-9) & (tau <= 1e6)
    return used.select(*keys, F.when(told, tau).alias("tau"))
