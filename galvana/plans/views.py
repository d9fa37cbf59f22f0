"""Cycler and cycle tables out of the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, daily: bool = True) -> DataFrame:
    """Events as cycler samples: a user is a cell, a day a cycle (or all days one cycle)."""
    e = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type").isin("purchase", "signup"), "charge").when(F.col("event_type").isin("click", "view"), "discharge").when(F.col("event_type") == "error", "rest").otherwise("other")
    )
    sign = F.when(kind == "charge", 1.0).when(kind == "discharge", -1.0).otherwise(0.0)
    return e.select(
        F.col("user_id").alias("cell_id"),
        (F.dayofmonth("ts") if daily else F.lit(1)).cast("int").alias("cycle"),
        F.col("event_id").alias("row_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"),
        kind.alias("step_type"),
        (sign * F.col("value")).alias("current"),
        (2.5 + F.col("value") / 300).alias("voltage"),
        F.col("value").alias("inc"),
    )


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge and discharge samples with a running capacity, one long cycle for each cell."""
    s = samples(spark, sf_dir, daily=False).where(F.col("step_type").isin("charge", "discharge")).withColumnRenamed("step_type", "leg")
    w = Window.partitionBy("cell_id", "cycle", "leg").orderBy("time", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("capacity", F.sum("inc").over(w))


def cell_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as whole cycles: ten cells, a week a cycle, all charges before the rest and the discharges, a sample every ten seconds.

    Voltages go from 3.0 to 4.2 and back with the share of the charge that has moved.
    """
    s = samples(spark, sf_dir, daily=True).where("step_type in ('charge', 'rest', 'discharge')")
    s = s.select((F.col("cell_id") % 10).alias("cell_id"), (F.floor((F.col("cycle") - 1) / 8) + 1).cast("int").alias("cycle"), "time", "row_id", "step_type", "current", "inc")
    phase = F.when(F.col("step_type") == "charge", 0).when(F.col("step_type") == "rest", 1).otherwise(2)
    order = Window.partitionBy("cell_id").orderBy("cycle", phase, "time", "row_id")
    leg = Window.partitionBy("cell_id", "cycle", "step_type")
    past = leg.orderBy("time", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("inc").over(past) / F.sum("inc").over(leg)
    volts = F.when(F.col("step_type") == "charge", 3.0 + 1.2 * share).when(F.col("step_type") == "discharge", 4.2 - 1.2 * share).otherwise(4.2)
    rows = s.withColumns({"place": F.row_number().over(order), "capacity": F.sum("inc").over(past) / 1000, "voltage": volts})
    return rows.select("cell_id", "cycle", F.col("place").cast("long").alias("row_id"), (F.col("place") * 10.0).alias("time"), "step_type", "current", "voltage", "capacity")


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a cycle table: a supplier is a cell, a month since 1995 a cycle."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("cell_id"), ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).alias("cycle"))
        .agg(
            F.sum("l_quantity").alias("dchgCapa"),
            F.sum(F.col("l_quantity") * (1 + F.col("l_discount"))).alias("chgCapa"),
            F.avg("l_tax").alias("R10"),
            F.stddev_samp("l_extendedprice").alias("hyst"),
            F.count("*").alias("n_steps"),
            F.avg("l_extendedprice").alias("i_dchg"),
        )
    )


def arms(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """The cycle table with the supplier's region as arm."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    arm = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").alias("cell_id"), F.col("r_name").alias("arm"))
    return (of if of is not None else cycles(spark, sf_dir)).join(arm, "cell_id")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits, as ``R`` does in SQL, so that sums in another order agree; the nudge settles halves alike."""
    names = {c for c, t in df.dtypes if t == "double"}
    value = lambda c: F.when(~F.isnan(c), F.round(F.col(c) + F.lit(1e-10), digits) + F.lit(0.0)).alias(c)
    return df.select(*(value(c) if c in names else F.col(c) for c in df.columns))


def R(*names: str, digits: int = 6) -> str:  # noqa: N802
    return ", ".join(f"CASE WHEN NOT isnan(CAST({n} AS DOUBLE)) THEN round(CAST({n} AS DOUBLE) + 1e-10, {digits}) + 0.0 END AS {n}" for n in names)


_KIND = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'charge' WHEN event_type IN ('click', 'view') THEN 'discharge' WHEN event_type = 'error' THEN 'rest' ELSE 'other' END"


def _samples_sql(cycle: str) -> str:
    return f"""SELECT user_id AS cell_id, CAST({cycle} AS INTEGER) AS cycle, event_id AS row_id, epoch_us(ts) / 1e6 AS time, {_KIND} AS step_type,
  CASE {_KIND} WHEN 'charge' THEN value WHEN 'discharge' THEN -value ELSE 0 * value END AS current, 2.5 + value / 300 AS voltage, value AS inc FROM events"""


SAMPLES = _samples_sql("day(ts)")
CELLS = """SELECT cell_id, cycle, place AS row_id, place * 10.0 AS time, step_type, current, moved / 1000 AS capacity,
  CASE step_type WHEN 'charge' THEN 3.0 + 1.2 * moved / whole WHEN 'discharge' THEN 4.2 - 1.2 * moved / whole ELSE 4.2 END AS voltage FROM (
    SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle, CASE step_type WHEN 'charge' THEN 0 WHEN 'rest' THEN 1 ELSE 2 END, time, row_id) AS place,
      sum(inc) OVER (PARTITION BY cell_id, cycle, step_type ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) AS moved, sum(inc) OVER (PARTITION BY cell_id, cycle, step_type) AS whole
    FROM (SELECT * REPLACE (cell_id % 10 AS cell_id, CAST((cycle - 1) // 8 + 1 AS INTEGER) AS cycle) FROM v_samples WHERE step_type IN ('charge', 'rest', 'discharge')))"""
LEGS = f"""SELECT * RENAME (step_type AS leg), sum(inc) OVER (PARTITION BY cell_id, step_type ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) AS capacity
  FROM ({_samples_sql("1")}) WHERE step_type IN ('charge', 'discharge')"""
CYCLES = """SELECT l_suppkey AS cell_id, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS cycle, sum(l_quantity) AS dchgCapa,
  sum(l_quantity * (1 + l_discount)) AS chgCapa, avg(l_tax) AS R10, stddev_samp(l_extendedprice) AS hyst, count(*) AS n_steps,
  avg(l_extendedprice) AS i_dchg FROM lineitem GROUP BY ALL"""
ARM = "SELECT s_suppkey AS cell_id, r_name AS arm FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
TRAJECTORY = """SELECT *, dchgCapa / nullif(first(dchgCapa) OVER a, 0) * 100 AS SoHQ, dchgCapa / nullif(chgCapa, 0) * 100 AS CE,
  lead(chgCapa) OVER w / nullif(dchgCapa, 0) * 100 AS CE_rev, hyst - first(hyst) OVER a AS delta_hyst,
  (R10 - first(R10) OVER a) / nullif(abs(first(R10) OVER a), 0) * 100 AS R10_inc
  FROM v_cycle WINDOW w AS (PARTITION BY cell_id ORDER BY cycle), a AS (PARTITION BY cell_id ORDER BY (cycle <> 1), cycle ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def with_views(select: str, **views: str) -> str:
    """A statement over the views it names, in order."""
    known = {"v_samples": SAMPLES, "v_leg": LEGS, "v_cycle": CYCLES, "v_cell": CELLS, "v_arm": f"SELECT c.*, arm FROM v_cycle c JOIN ({ARM}) a USING (cell_id)", "v_traj": TRAJECTORY} | views
    text = select + " ".join(views.values())
    if "v_cell" in text:
        text += " v_samples"
    if "v_traj" in text or "v_arm" in text:
        text += " v_cycle"
    used = {name: sql for name, sql in known.items() if name in text}
    return ("WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in used.items()) + "\n" if used else "") + select
