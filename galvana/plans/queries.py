"""Registered queries of the battery operators over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from galvana.operators import asof, curves, cycle, dcir, diagnose, doe, evolution, forest, isolation, labels, mechanism, peaks, protocol, pulses, recovery, regime, rests, score, segment, tools, trajectory, wide
from galvana.plans import views
from galvana.plans.views import R, rounded, with_views
from galvana.shared import cut

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, **more: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql, **more)
        return f

    return add


ORDER = ("time", "row_id")
INDICATORS = ["R10", "hyst", "i_dchg", "CE"]


def _health(spark, sf_dir):
    """The cycle table with health: the trajectory's own columns are dropped but for SoHQ and CE."""
    return trajectory.trajectory(views.cycles(spark, sf_dir), ["hyst"], ["R10"])


# Segmentation


@query("step_kinds", """
SELECT event_type, CASE WHEN contains(event_type, 'click') OR contains(event_type, 'view') THEN 'discharge' WHEN contains(event_type, 'purchase') OR contains(event_type, 'sign') THEN 'charge'
  WHEN contains(event_type, 'err') THEN 'rest' ELSE 'other' END AS kind,
  CASE WHEN event_type = 'purchase' THEN 'charge' WHEN event_type IN ('click', 'view') THEN 'discharge' WHEN contains(event_type, 'err') THEN 'rest' ELSE 'other' END AS kind_exact,
  count(*) AS n FROM events GROUP BY ALL""")  # fmt: skip
def step_kinds(spark, sf_dir):
    labels = {"charge": "purchase, sign", "discharge": "click, view", "rest": "err"}
    e = views.table(spark, sf_dir, "events")
    return e.groupBy("event_type", segment.step_kind("event_type", **labels).alias("kind"), segment.step_kind_exact("event_type", **labels).alias("kind_exact")).agg(F.count("*").alias("n"))


_RUNS = """SELECT *, sum(new) OVER (PARTITION BY cell_id, cycle ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) AS run_id FROM (
  SELECT *, CASE WHEN step_type <> lag(step_type) OVER (PARTITION BY cell_id, cycle ORDER BY time, row_id) THEN 1 ELSE 0 END AS new FROM v_samples)"""
_RUN = """SELECT *, lag(kind) OVER (PARTITION BY cell_id, cycle ORDER BY run_id) AS previous_kind FROM (
  SELECT cell_id, cycle, CAST(run_id AS BIGINT) AS run_id, step_type AS kind, count(*) AS n, min(time) AS first_time, max(time) AS last_time FROM v_runs GROUP BY ALL)"""


def _kinds(spark, sf_dir):
    return segment.with_kind(views.samples(spark, sf_dir))


@query("runs", f"SELECT cell_id, cycle, run_id, kind, n, {R('first_time', 'last_time', digits=3)}, previous_kind FROM v_run", v_runs=_RUNS, v_run=_RUN)
def runs(spark, sf_dir):
    return rounded(segment.runs(_kinds(spark, sf_dir), order=ORDER), 3)


@query("rest_periods", f"SELECT cell_id, cycle, run_id, previous_kind AS after_leg, n, {R('first_time', 'last_time', digits=3)} FROM v_run WHERE kind = 'rest' AND previous_kind IN ('charge', 'discharge')", v_runs=_RUNS, v_run=_RUN)
def rest_periods(spark, sf_dir):
    return rounded(segment.rest_periods(_kinds(spark, sf_dir), order=ORDER), 3)


_BLOCKS = """SELECT cell_id, min(cycle) AS block_start, max(cycle) AS block_end, count(*) AS n_cycles FROM (
  SELECT cell_id, cycle, cycle - row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS island FROM v_cycle WHERE n_steps <> 6) GROUP BY cell_id, island"""


@query("consecutive_blocks", "SELECT * FROM v_block WHERE n_cycles >= 2", v_cycle=views.CYCLES, v_block=_BLOCKS)
def consecutive_blocks(spark, sf_dir):
    return segment.consecutive_blocks(views.cycles(spark, sf_dir).where("n_steps <> 6"), min_len=2)


@query("preceding_blocks", """
SELECT b.*, o.block_start AS preceding_start, o.block_end AS preceding_end FROM v_block b LEFT JOIN v_other o ON o.cell_id = b.cell_id AND o.block_end + 1 = b.block_start""",
    v_cycle=views.CYCLES, v_block=_BLOCKS, v_other=_BLOCKS.replace("<> 6", "= 6"))
def preceding_blocks(spark, sf_dir):
    c = views.cycles(spark, sf_dir)
    return segment.preceding_blocks(segment.consecutive_blocks(c.where("n_steps <> 6")), segment.consecutive_blocks(c.where("n_steps = 6")))


@query("capacity_runs", """
SELECT cell_id, cycle, CAST(capacity_run AS BIGINT) AS capacity_run, count(*) AS n FROM (
  SELECT *, sum(fell) OVER (PARTITION BY cell_id, cycle ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) AS capacity_run FROM (
    SELECT *, CASE WHEN lag(inc) OVER (PARTITION BY cell_id, cycle ORDER BY time, row_id) - inc > 0.5 THEN 1 ELSE 0 END AS fell FROM v_samples)) GROUP BY ALL""")  # fmt: skip
def capacity_runs(spark, sf_dir):
    return segment.capacity_runs(views.samples(spark, sf_dir), "inc", order=ORDER).groupBy("cell_id", "cycle", "capacity_run").agg(F.count("*").alias("n"))


@query("continuous_windows", f"""
SELECT cell_id, cycle, CAST(window_id AS BIGINT) AS window_id, n, {R('first_time', 'last_time', digits=3)} FROM (
 SELECT cell_id, cycle, window_id, count(*) AS n, min(time) AS first_time, max(time) AS last_time FROM (
  SELECT *, sum(CASE WHEN ok AND new THEN 1 ELSE 0 END) OVER w AS window_id FROM (
   SELECT *, NOT coalesce(lag(ok) OVER w, false) OR NOT coalesce(time > lag(time) OVER w, false) OR step_type <> lag(step_type) OVER w OR sign(current) <> lag(sign(current)) OVER w AS new
   FROM (SELECT *, abs(current) > 20 AS ok FROM v_samples) WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY time, row_id))
  WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY time, row_id ROWS UNBOUNDED PRECEDING)) WHERE ok GROUP BY ALL)""")  # fmt: skip
def continuous_windows(spark, sf_dir):
    return rounded(segment.continuous_windows(views.samples(spark, sf_dir), F.abs("current") > 20, order=ORDER), 3)


@query("pulse_cycles", f"SELECT cell_id, cycle, {R('max_current')} FROM (SELECT cell_id, cycle, max(abs(current)) AS max_current FROM v_samples GROUP BY ALL) WHERE max_current >= 50")
def pulse_cycles(spark, sf_dir):
    return segment.pulse_cycles(views.samples(spark, sf_dir), 100.0)


@query("drop_pulse_rows", f"""
SELECT cell_id, leg, count(*) AS n, {R('current')} FROM (SELECT cell_id, leg, abs(current) AS current FROM (
  SELECT *, sum(CASE WHEN pulse THEN 0 ELSE 1 END) OVER (PARTITION BY cell_id, leg) AS kept FROM (
    SELECT v.*, n >= 30 AND a >= 20 AND m < x / 1.8 AND abs(current) > 1.8 * m AS pulse FROM v_leg v JOIN (
      SELECT cell_id, leg, count(*) AS n, count(*) FILTER (abs(current) >= 1) AS a, median(abs(current)) FILTER (abs(current) >= 1) AS m, max(abs(current)) FILTER (abs(current) >= 1) AS x
      FROM v_leg GROUP BY ALL) USING (cell_id, leg))) WHERE NOT pulse OR kept < 10) GROUP BY ALL""".replace(R("current"), "round(sum(current), 6) + 0.0 AS total"))  # fmt: skip
def drop_pulse_rows(spark, sf_dir):
    rows = segment.drop_pulse_rows(views.legs(spark, sf_dir), ["cell_id", "leg"])
    return rows.groupBy("cell_id", "leg").agg(F.count("*").alias("n"), F.sum(F.abs("current")).alias("total"))


@query("trim_leading", """
SELECT cell_id, leg, count(*) AS n FROM (SELECT *, min(CASE WHEN capacity >= most * 0.05 THEN place END) OVER (PARTITION BY cell_id, leg) AS first_place FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id, leg ORDER BY time, row_id) AS place, max(capacity) OVER (PARTITION BY cell_id, leg) AS most FROM v_leg))
WHERE first_place IS NULL OR place >= first_place - 1 GROUP BY ALL""")  # fmt: skip
def trim_leading(spark, sf_dir):
    return segment.trim_leading(views.legs(spark, sf_dir), "capacity", ["cell_id", "leg"], ORDER, 0.05).groupBy("cell_id", "leg").agg(F.count("*").alias("n"))


@query("continuity", """
SELECT cell_id, cycle, n, CASE WHEN n < 3 THEN 'insufficient' WHEN gap THEN 'gap' END AS reason FROM (
  SELECT cell_id, cycle, count(*) AS n, coalesce(bool_or(gap), false) AS gap FROM (
    SELECT *, row_id - lag(row_id) OVER (PARTITION BY cell_id, cycle ORDER BY time, row_id) <> 1 AS gap FROM v_samples) GROUP BY ALL)""")  # fmt: skip
def continuity(spark, sf_dir):
    return segment.continuity_reason(views.samples(spark, sf_dir), ["cell_id", "cycle"], ORDER, "row_id")


@query("counter_soundness", """
SELECT cell_id, cycle, n, CASE WHEN n < 2 THEN 'insufficient' WHEN bad THEN 'nonfinite' WHEN fell THEN 'reset' WHEN two THEN 'conflicting' WHEN span <= 0 THEN 'zero_capacity' END AS reason FROM (
  SELECT cell_id, cycle, count(*) AS n, bool_or(inc IS NULL OR voltage IS NULL) AS bad, coalesce(bool_or(step < 0), false) AS fell, coalesce(bool_or(step = 0 AND dv <> 0), false) AS two, max(inc) - min(inc) AS span FROM (
    SELECT *, inc - lag(inc) OVER w AS step, voltage - lag(voltage) OVER w AS dv FROM v_samples WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY time, row_id)) GROUP BY ALL)""")  # fmt: skip
def counter_soundness(spark, sf_dir):
    return segment.counter_reason(views.samples(spark, sf_dir), "inc", "voltage", ["cell_id", "cycle"], ORDER)


# As-of joins

_ANCHOR = "SELECT cell_id, cycle AS anchor, dchgCapa AS q FROM v_cycle WHERE n_steps = 9"


@query("bracket_anchors", f"""
SELECT c.cell_id, c.cycle, max(a.anchor) FILTER (a.anchor <= c.cycle) AS before_cycle, {R('before_dchgCapa')}, min(a.anchor) FILTER (a.anchor >= c.cycle) AS after_cycle, {R('after_dchgCapa')}
FROM v_cycle c LEFT JOIN v_anchor a ON a.cell_id = c.cell_id GROUP BY c.cell_id, c.cycle""".replace(
    R("before_dchgCapa"), "round(max_by(a.q, a.anchor) FILTER (a.anchor <= c.cycle), 6) AS before_dchgCapa").replace(
    R("after_dchgCapa"), "round(min_by(a.q, a.anchor) FILTER (a.anchor >= c.cycle), 6) AS after_dchgCapa"), v_cycle=views.CYCLES, v_anchor=_ANCHOR)
def bracket_anchors(spark, sf_dir):
    c = views.cycles(spark, sf_dir)
    return asof.bracket(c.select("cell_id", "cycle"), c.where("n_steps = 9").select("cell_id", "cycle", "dchgCapa"), ["cell_id"], "cycle", ["dchgCapa"])


@query("nearest_anchor_rcf", f"""
SELECT cell_id, cycle, anchor AS anchor_cycle, {R('RCF')} FROM (SELECT c.cell_id, c.cycle, a.anchor, c.dchgCapa / nullif(a.q, 0) AS RCF,
  row_number() OVER (PARTITION BY c.cell_id, c.cycle ORDER BY abs(c.cycle - a.anchor) NULLS LAST, a.anchor) AS r FROM v_cycle c LEFT JOIN v_anchor a ON a.cell_id = c.cell_id) WHERE r = 1""", v_cycle=views.CYCLES, v_anchor=_ANCHOR)  # fmt: skip
def nearest_anchor_rcf(spark, sf_dir):
    c = views.cycles(spark, sf_dir)
    return regime.rate_capability(c, c.where("n_steps = 9").select("cell_id", "cycle"))


@query("interpolated_anchor", f"""
SELECT cell_id, cycle, {R('expected')} FROM (SELECT cell_id, cycle, coalesce(CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (cycle - x0) / nullif(x1 - x0, 0) END, y0, y1) AS expected FROM (
  SELECT c.cell_id, c.cycle, max(anchor) FILTER (anchor <= c.cycle) AS x0, max_by(q, anchor) FILTER (anchor <= c.cycle) AS y0, min(anchor) FILTER (anchor >= c.cycle) AS x1, min_by(q, anchor) FILTER (anchor >= c.cycle) AS y1
  FROM v_cycle c LEFT JOIN v_anchor a ON a.cell_id = c.cell_id GROUP BY c.cell_id, c.cycle))""", v_cycle=views.CYCLES, v_anchor=_ANCHOR)  # fmt: skip
def interpolated_anchor(spark, sf_dir):
    c = views.cycles(spark, sf_dir)
    return asof.interpolate(c.select("cell_id", "cycle"), c.where("n_steps = 9").select("cell_id", "cycle", "dchgCapa"), ["cell_id"], "dchgCapa")


@query("offset_samples", f"""
SELECT cell_id, leg, "offset", {R('voltage')} FROM (SELECT cell_id, leg, "offset", CASE WHEN x1 IS NULL THEN NULL WHEN x0 IS NULL THEN y1 WHEN x1 <= x0 THEN y0 ELSE y0 + (y1 - y0) * ("offset" - x0) / nullif(x1 - x0, 0) END AS voltage FROM (
  SELECT cell_id, leg, "offset", max(t) FILTER (t <= "offset") AS x0, arg_max(voltage, (t, -voltage)) FILTER (t <= "offset") AS y0, min(t) FILTER (t >= "offset") AS x1, arg_min(voltage, (t, voltage)) FILTER (t >= "offset") AS y1
  FROM (SELECT *, time - min(time) OVER (PARTITION BY cell_id, leg) AS t FROM v_leg), (VALUES (0.0::DOUBLE), (3600.0), (86400.0), (2000000.0)) o("offset") GROUP BY ALL))""")  # fmt: skip
def offset_samples(spark, sf_dir):
    s = views.legs(spark, sf_dir)
    start = s.groupBy("cell_id", "leg").agg(F.min("time").alias("t0"))
    timed = s.join(start, ["cell_id", "leg"]).withColumn("t", F.col("time") - F.col("t0"))
    return asof.sample_at(timed, "t", ["voltage"], [0.0, 3600.0, 86400.0, 2000000.0], ["cell_id", "leg"], 0.0)


# Features of legs

_STEP = "SELECT *, capacity - lag(capacity) OVER w AS dq, (voltage + lag(voltage) OVER w) / 2 AS v_mid, row_number() OVER w AS p FROM v_leg WINDOW w AS (PARTITION BY cell_id, leg ORDER BY time, row_id)"


@query("leg_energy", f"SELECT cell_id, cycle, leg, {R('dq_total', 'energy', 'v_avg', digits=4)} FROM (SELECT *, energy / nullif(dq_total, 0) AS v_avg FROM (SELECT cell_id, cycle, leg, sum(dq) AS dq_total, sum(v_mid * dq) AS energy FROM v_step GROUP BY ALL))", v_leg=views.LEGS, v_step=_STEP)
def leg_energy(spark, sf_dir):
    return rounded(cycle.leg_energy(views.legs(spark, sf_dir), order=ORDER), 4)


@query("band_capacity", f"""SELECT cell_id, cycle, leg, {R('q_high', 'q_low', 'q_mid', 'q_high_frac', 'q_low_frac', digits=4)} FROM (SELECT *, q_high / nullif(q_high + q_low + q_mid, 0) AS q_high_frac, q_low / nullif(q_high + q_low + q_mid, 0) AS q_low_frac FROM (
  SELECT cell_id, cycle, leg, sum(CASE WHEN v_mid > 2.8 THEN abs(dq) ELSE 0 END) AS q_high, sum(CASE WHEN v_mid < 2.6 THEN abs(dq) ELSE 0 END) AS q_low, sum(CASE WHEN v_mid BETWEEN 2.6 AND 2.8 THEN abs(dq) ELSE 0 END) AS q_mid FROM v_step GROUP BY ALL))""", v_leg=views.LEGS, v_step=_STEP)  # fmt: skip
def band_capacity(spark, sf_dir):
    return rounded(cycle.band_capacity(views.legs(spark, sf_dir), low=2.6, high=2.8, order=ORDER), 4)


@query("ir_drop", f"SELECT cell_id, cycle, leg, {R('ir_drop')} FROM (SELECT cell_id, cycle, leg, CASE WHEN count(*) >= 5 THEN abs(max_by(voltage, p) FILTER (p <= 6) - max(voltage) FILTER (p = 1)) END AS ir_drop FROM v_step GROUP BY ALL)", v_leg=views.LEGS, v_step=_STEP)
def ir_drop(spark, sf_dir):
    return cycle.ir_drop(views.legs(spark, sf_dir), order=ORDER)


_LEG = """SELECT cell_id, cycle, leg, count(*) AS n_points, CASE WHEN NOT (bool_or(capacity IS NULL OR capacity < 0) OR coalesce(bool_or(dq < 0), false)) THEN max(capacity) END AS capacity,
  min_by(voltage, p) AS v_start, max_by(voltage, p) AS v_end, min(voltage) AS v_min, max(voltage) AS v_max, max(time) - min(time) AS duration_s, avg(current) AS i_mean, max_by(current, p) AS i_end FROM v_step GROUP BY ALL"""


@query("leg_features", f"SELECT cell_id, cycle, leg, n_points, {R('capacity', 'v_start', 'v_end', 'v_min', 'v_max', 'duration_s', 'i_mean', 'i_end', digits=4)} FROM v_legs", v_leg=views.LEGS, v_step=_STEP, v_legs=_LEG)
def leg_features(spark, sf_dir):
    return rounded(cycle.leg_features(views.legs(spark, sf_dir), order=ORDER), 4)


@query("observed_legs", f"""SELECT cell_id, cycle, leg, clock_reason, counter_reason, {R('capacity_observed', 'energy_observed', 'v_avg_observed', digits=4)} FROM (
  SELECT *, CASE WHEN ok THEN dq_total END AS capacity_observed, CASE WHEN ok THEN energy END AS energy_observed, CASE WHEN ok THEN energy / nullif(dq_total, 0) END AS v_avg_observed FROM (SELECT *, clock_reason IS NULL AND counter_reason IS NULL AS ok FROM (
  SELECT cell_id, cycle, leg, sum(dq) AS dq_total, sum(v_mid * dq) AS energy, CASE WHEN count(*) < 3 THEN 'insufficient' END AS clock_reason,
    CASE WHEN count(*) < 2 THEN 'insufficient' WHEN bool_or(dq < 0) THEN 'reset' WHEN bool_or(dq = 0 AND v_mid <> voltage) THEN 'conflicting' WHEN max(capacity) - min(capacity) <= 0 THEN 'zero_capacity' END AS counter_reason FROM v_step GROUP BY ALL)))""", v_leg=views.LEGS, v_step=_STEP)  # fmt: skip
def observed_legs(spark, sf_dir):
    return rounded(cycle.observed_legs(views.legs(spark, sf_dir), order=ORDER), 4)


@query("efficiencies", f"""SELECT cell_id, cycle, {R('CE', 'EE', 'VE', 'dE', 'CI_per_hour', digits=2)} FROM (SELECT cell_id, cycle, dq / nullif(cq, 0) * 100 AS CE, CASE WHEN ce <> 0 AND de <> 0 THEN de / ce END AS EE, CASE WHEN cv <> 0 AND dv <> 0 THEN dv / cv END AS VE,
  CASE WHEN ce <> 0 AND de <> 0 THEN ce - de END AS dE, (100 - dq / nullif(cq, 0) * 100) / nullif(s / 3600, 0) AS CI_per_hour FROM (
  SELECT cell_id, cycle, max(capacity) FILTER (leg = 'charge') AS cq, max(capacity) FILTER (leg = 'discharge') AS dq, max(energy) FILTER (leg = 'charge') AS ce, max(energy) FILTER (leg = 'discharge') AS de,
    max(energy / nullif(dq_total, 0)) FILTER (leg = 'charge') AS cv, max(energy / nullif(dq_total, 0)) FILTER (leg = 'discharge') AS dv, sum(duration_s) AS s
  FROM v_legs JOIN (SELECT cell_id, cycle, leg, sum(dq) AS dq_total, sum(v_mid * dq) AS energy FROM v_step GROUP BY ALL) USING (cell_id, cycle, leg) GROUP BY ALL))""", v_leg=views.LEGS, v_step=_STEP, v_legs=_LEG)  # fmt: skip
def efficiencies(spark, sf_dir):
    s = views.legs(spark, sf_dir)
    return rounded(cycle.efficiencies(cycle.leg_features(s, order=ORDER).join(cycle.leg_energy(s, order=ORDER), list(cycle.LEG))), 2)


def _between(c: str) -> str:
    """A value between its neighbours in time (``{c}_a`` at x0 and ``{c}_b`` at x1), in SQL."""
    return f"""CASE WHEN x1 IS NULL THEN NULL WHEN x0 IS NULL THEN {c}_b WHEN x1 <= x0 THEN {c}_a ELSE {c}_a + ({c}_b - {c}_a) * ("offset" - x0) / nullif(x1 - x0, 0) END"""


@query("landmark_resistance", f"""
    SELECT cell_id, cycle, leg, "offset", {R('r_mohm', digits=3)} FROM (
      SELECT *, abs(v0 - {_between('v')}) * 1000 / nullif(abs({_between('i')}), 0) AS r_mohm FROM (
        SELECT cell_id, cycle, leg, "offset", min(first_v) AS v0, max(t) FILTER (t <= "offset" + 1e-9) AS x0, min(t) FILTER (t >= "offset" - 1e-9) AS x1,
          arg_max(voltage, (t, -voltage)) FILTER (t <= "offset" + 1e-9) AS v_a, arg_min(voltage, (t, voltage)) FILTER (t >= "offset" - 1e-9) AS v_b,
          arg_max(current, (t, -current)) FILTER (t <= "offset" + 1e-9) AS i_a, arg_min(current, (t, current)) FILTER (t >= "offset" - 1e-9) AS i_b
        FROM (SELECT *, time - first(time) OVER w AS t, first(voltage) OVER w AS first_v FROM v_leg WINDOW w AS (PARTITION BY cell_id, leg ORDER BY time, row_id)), (VALUES (0.0::DOUBLE), (3600.0), (86400.0)) o("offset") GROUP BY ALL))""")  # fmt: skip
def landmark_resistance(spark, sf_dir):
    return rounded(cycle.landmark_resistance(views.legs(spark, sf_dir), (0.0, 3600.0, 86400.0), order=ORDER), 3)


_REST_OFFSETS = (0.0, 3600.0, 21600.0)


@query("rest_voltages", f"""
    SELECT cell_id, cycle, run_id, after_leg, {R('rest_duration_s', digits=3)}, "offset", {R('voltage')}, status FROM (
      SELECT *, CASE WHEN status IN ('ok', 'single_point') THEN CASE WHEN x1 <= x0 THEN y0 ELSE y0 + (y1 - y0) * ("offset" - x0) / nullif(x1 - x0, 0) END END AS voltage FROM (
        SELECT *, CASE WHEN "offset" > rest_duration_s + 1e-9 THEN 'beyond_rest' WHEN n = 1 THEN 'single_point' ELSE 'ok' END AS status FROM (
          SELECT cell_id, cycle, run_id, after_leg, "offset", max(t) AS rest_duration_s, count(*) AS n, max(t) FILTER (t <= "offset" + 1e-9) AS x0, min(t) FILTER (t >= "offset" - 1e-9) AS x1,
            arg_max(voltage, (t, -voltage)) FILTER (t <= "offset" + 1e-9) AS y0, arg_min(voltage, (t, voltage)) FILTER (t >= "offset" - 1e-9) AS y1
          FROM v_rest_samples, (VALUES (0.0::DOUBLE), (3600.0), (21600.0)) o("offset") GROUP BY ALL)))""",
    v_runs=_RUNS, v_run=_RUN,
    v_rest_samples="""
        SELECT r.cell_id, r.cycle, CAST(r.run_id AS BIGINT) AS run_id, p.previous_kind AS after_leg, CASE WHEN count(*) OVER w >= 2 THEN time - min(time) OVER w ELSE 0.0 END AS t, voltage
        FROM v_runs r JOIN v_run p ON p.cell_id = r.cell_id AND p.cycle = r.cycle AND p.run_id = r.run_id WHERE p.kind = 'rest' AND p.previous_kind IN ('charge', 'discharge')
        WINDOW w AS (PARTITION BY r.cell_id, r.cycle, r.run_id)""")  # fmt: skip
def rest_voltages(spark, sf_dir):
    return rests.rest_voltages(_kinds(spark, sf_dir), _REST_OFFSETS, order=ORDER).withColumn("rest_duration_s", F.round("rest_duration_s", 3))


@query("quality_metrics", f"""
    SELECT cell_id, cycle, {R('samples_per_mV', 'leg_completeness', 'dqdv_snr', 'quality_score', digits=5)}, coverage AS quality_evidence_coverage, failed AS quality_gate_failed_groups,
      CASE WHEN failed <> '' THEN 'failed' WHEN coverage > 0 THEN 'partial' ELSE 'unknown' END AS quality_status FROM (
      SELECT *, CASE WHEN coverage = 0 THEN NULL WHEN least(coalesce(a, 1), coalesce(b, 1), coalesce(c, 1)) <= 0 THEN 0 ELSE exp((0.25 * coalesce(ln(a), 0) + 0.25 * coalesce(ln(b), 0) + 0.2 * coalesce(ln(c), 0)) / coverage) END AS quality_score,
        array_to_string([x for x in [CASE WHEN a < 1 THEN 'samples_per_mV' END, CASE WHEN b < 1 THEN 'dqdv_snr' END, CASE WHEN c < 1 THEN 'leg_completeness' END] if x IS NOT NULL], ',') AS failed FROM (
        SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END AS coverage FROM (
          SELECT *, CASE WHEN samples_per_mV IS NOT NULL THEN least(1, samples_per_mV / 0.5) END AS a, CASE WHEN dqdv_snr IS NOT NULL THEN least(1, dqdv_snr / 10) END AS b, CASE WHEN leg_completeness IS NOT NULL THEN least(1, leg_completeness / 0.9) END AS c FROM (
            SELECT s.cell_id, s.cycle, CASE WHEN n >= 2 AND span * 1000 > 1e-6 THEN n / (span * 1000) END AS samples_per_mV, least(1.0, span / 1.7) AS leg_completeness, span / nullif(sigma, 0) AS dqdv_snr FROM (
              SELECT cell_id, cycle, count(voltage) AS n, max(voltage) - min(voltage) AS span FROM v_samples GROUP BY ALL) s
            LEFT JOIN v_sigma g ON g.cell_id = s.cell_id AND g.cycle = s.cycle))))""",
    v_sigma="""
        SELECT cell_id, cycle, sqrt(greatest(0, sum(yy - xy * xy / xx) / sum(n))) AS sigma FROM (
          SELECT cell_id, cycle, k, count(*) AS n, regr_syy(voltage, p) AS yy, regr_sxy(voltage, p) AS xy, regr_sxx(voltage, p) AS xx FROM (
            SELECT *, row_number() OVER (PARTITION BY cell_id, cycle ORDER BY time, row_id) - 1 AS p, count(*) OVER (PARTITION BY cell_id, cycle) AS n FROM v_samples), LATERAL (SELECT unnest(range(greatest(0, (p - 24) // 25), p // 25 + 1)) AS k)
          WHERE n >= 100 AND k * 25 < n - 50 AND p >= k * 25 AND p < k * 25 + 50 GROUP BY ALL) GROUP BY ALL""")  # fmt: skip
def quality_metrics(spark, sf_dir):
    found = cycle.quality_metrics(views.samples(spark, sf_dir), order=ORDER)
    return rounded(found.select("cell_id", "cycle", "samples_per_mV", "leg_completeness", "dqdv_snr", "quality_score", "quality_evidence_coverage", "quality_gate_failed_groups", "quality_status"), 5)


@query("cycle_quality", f"""SELECT cell_id, cycle, {R('quant_step', 'samples_per_mv', 'completeness', 'quality_score')} FROM (SELECT *, CASE WHEN least(1, samples_per_mv) <= 0 OR completeness <= 0 THEN 0.0 ELSE exp(0.4 * ln(least(1, samples_per_mv)) + 0.6 * ln(completeness)) END AS quality_score FROM (
  SELECT cell_id, cycle, min(step) AS quant_step, count(*) / nullif((max(voltage) - min(voltage)) * 1000, 0) AS samples_per_mv, least(1.0, (max(voltage) - min(voltage)) / (4.2 - 2.5)) AS completeness FROM (
  SELECT *, nullif(abs(voltage - lag(voltage) OVER (PARTITION BY cell_id, cycle ORDER BY time, row_id)), 0) AS step FROM v_samples) GROUP BY ALL))""")  # fmt: skip
def cycle_quality(spark, sf_dir):
    return cycle.quality(views.samples(spark, sf_dir), order=ORDER)


@query("noise_sigma", f"""SELECT cell_id, cycle, {R('noise_sigma')} FROM (SELECT cell_id, cycle, CASE WHEN sum(n) > 0 THEN sqrt(greatest(0, sum(yy - xy * xy / xx) / sum(n))) END AS noise_sigma FROM (SELECT DISTINCT cell_id, cycle FROM v_samples) LEFT JOIN (
  SELECT cell_id, cycle, k, count(*) AS n, regr_syy(voltage, p) AS yy, regr_sxy(voltage, p) AS xy, regr_sxx(voltage, p) AS xx FROM (
    SELECT *, row_number() OVER (PARTITION BY cell_id, cycle ORDER BY time, row_id) - 1 AS p, count(*) OVER (PARTITION BY cell_id, cycle) AS n FROM v_samples), LATERAL (SELECT unnest(range((p // 2) - 1, p // 2 + 1)) AS k)
  WHERE n >= 8 AND k >= 0 AND k * 2 < n - 4 GROUP BY ALL) USING (cell_id, cycle) GROUP BY ALL)""")  # fmt: skip
def noise_sigma(spark, sf_dir):
    return cycle.noise_sigma(views.samples(spark, sf_dir), window=4, order=ORDER)


# Protocol

_FLAGS = """SELECT cell_id, cycle, n_steps, dchg, i_median, n_steps <> 6 AS rpt, n_steps <> 6 AND dchg > 0 AND dchg < 100 AS capacheck,
  n_steps = 6 AND dchg >= 10 AND i_median > 1 AND coalesce(n_usual >= 3 AND i_median < 0.85 * i_usual, false) AS capa_full FROM
  (SELECT cell_id, cycle, n_steps, dchgCapa AS dchg, i_dchg / 1000 AS i_median FROM v_cycle) LEFT JOIN (
    SELECT cell_id, max_by(bin, (n, -bin)) AS i_usual, sum(n) AS n_usual FROM (SELECT cell_id, round(i_dchg / 1000 * 2) / 2 AS bin, count(*) AS n FROM v_cycle WHERE n_steps = 6 AND dchgCapa >= 10 AND i_dchg / 1000 > 1 GROUP BY ALL) GROUP BY cell_id) USING (cell_id)"""
_KINDS = """SELECT cell_id, cycle, CASE WHEN capacheck THEN 'capacheck' WHEN rpt THEN 'rpt' WHEN capa_full THEN 'capa_full' WHEN after THEN 'post_rpt' ELSE 'routine' END AS protocol_kind FROM v_flags LEFT JOIN (
  SELECT DISTINCT cell_id, unnest(range(block_end + 1, block_end + 2)) AS cycle, true AS after FROM v_block) USING (cell_id, cycle)"""
_PROTOCOL = {"v_cycle": views.CYCLES, "v_flags": _FLAGS, "v_block": _BLOCKS, "v_kind": _KINDS}


def _flags(spark, sf_dir):
    steps = views.cycles(spark, sf_dir).select("cell_id", "cycle", "n_steps", F.col("dchgCapa").alias("dchg"), (F.col("i_dchg") / 1000).alias("i_median"))
    return protocol.protocol_flags(steps, routine_steps=6, dchg_routine_min=100.0)


@query("protocol_flags", f"SELECT cell_id, cycle, n_steps, {R('dchg')}, rpt, capacheck, capa_full FROM v_flags", **_PROTOCOL)
def protocol_flags(spark, sf_dir):
    return _flags(spark, sf_dir).drop("i_median")


@query("protocol_kinds", "SELECT cell_id, cycle, protocol_kind, protocol_kind <> 'routine' AS protocol_excluded FROM v_kind", **_PROTOCOL)
def protocol_kinds(spark, sf_dir):
    return protocol.protocol_kinds(_flags(spark, sf_dir), post=1)


@query("scoring_rows", f"SELECT cell_id, cycle, {R('dchgCapa')}, protocol_kind FROM v_cycle JOIN v_kind USING (cell_id, cycle) WHERE protocol_kind = 'routine'", **_PROTOCOL)
def scoring_rows(spark, sf_dir):
    c = views.cycles(spark, sf_dir).select("cell_id", "cycle", "dchgCapa")
    return protocol.scoring_rows(protocol.attach_protocol(c, protocol.protocol_kinds(_flags(spark, sf_dir), post=1))).drop("protocol_excluded")


@query("rpt_checkpoints", """
SELECT cell_id, block_start, block_end, CAST(CASE WHEN block_start <= 10 THEN 1 ELSE greatest(100, (block_start - 1) // 100 * 100) END AS BIGINT) AS life,
  CAST(coalesce(floor((f.a + f.b) / 2), c, floor((block_start + block_end) / 2)) AS BIGINT) AS anchor_cycle FROM v_block b LEFT JOIN (
    SELECT cell_id AS fc, min(cycle) AS a, max(cycle) AS b FROM (SELECT cell_id, cycle, cycle - row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS island FROM v_flags WHERE capa_full) GROUP BY cell_id, island) f ON fc = cell_id AND f.b + 1 = block_start
  LEFT JOIN (SELECT v_block.cell_id AS cc, block_start AS cs, min(cycle) AS c FROM v_block JOIN v_flags ON v_flags.cell_id = v_block.cell_id AND capacheck AND cycle BETWEEN block_start AND block_end GROUP BY ALL) ON cc = cell_id AND cs = block_start""", **_PROTOCOL)  # fmt: skip
def rpt_checkpoints(spark, sf_dir):
    return protocol.rpt_checkpoints(_flags(spark, sf_dir))


# Trajectories

_HEALTH = """SELECT *, CASE WHEN row_number() OVER w >= 21 AND regr_count(SoHQ, cycle) OVER f >= 10 THEN regr_slope(SoHQ, cycle) OVER f END AS dSoHQ_dN, CASE WHEN count(CE) OVER g >= 8 THEN avg(CE) OVER g END AS CE_local_20 FROM v_traj
  WINDOW w AS (PARTITION BY cell_id ORDER BY cycle), f AS (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), g AS (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
_V = {"v_cycle": views.CYCLES, "v_traj": views.TRAJECTORY, "v_health": _HEALTH}


@query("trajectory", f"SELECT cell_id, cycle, {R('SoHQ', 'CE', 'CE_rev', 'delta_hyst', 'R10_inc', 'dSoHQ_dN', 'CE_local_20', digits=5)} FROM v_health", **_V)
def trajectory_query(spark, sf_dir):
    return rounded(_health(spark, sf_dir).select("cell_id", "cycle", "SoHQ", "CE", "CE_rev", "delta_hyst", "R10_inc", "dSoHQ_dN", "CE_local_20"), 5)


@query("gradient", f"""SELECT cell_id, cycle, {R('g', digits=5)} FROM (SELECT *, CASE WHEN x0 IS NULL THEN (y1 - SoHQ) / (x1 - cycle) WHEN x1 IS NULL THEN (SoHQ - y0) / (cycle - x0) ELSE
  ((cycle - x0) * (cycle - x0) * y1 - (x1 - cycle) * (x1 - cycle) * y0 + ((x1 - cycle) * (x1 - cycle) - (cycle - x0) * (cycle - x0)) * SoHQ) / ((cycle - x0) * (x1 - cycle) * (x1 - x0)) END AS g FROM (
  SELECT cell_id, cycle, SoHQ, lag(SoHQ) OVER w AS y0, lead(SoHQ) OVER w AS y1, lag(cycle) OVER w AS x0, lead(cycle) OVER w AS x1 FROM v_traj WINDOW w AS (PARTITION BY cell_id ORDER BY cycle)))""", **_V)  # fmt: skip
def gradient(spark, sf_dir):
    return rounded(_health(spark, sf_dir).select("cell_id", "cycle", trajectory.gradient("SoHQ").alias("g")), 5)


@query("local_slope", f"SELECT cell_id, cycle, {R('s', digits=5)} FROM (SELECT cell_id, cycle, CASE WHEN regr_count(SoHQ, cycle) OVER f >= 5 THEN regr_slope(SoHQ, cycle) OVER f * 100 END AS s FROM v_traj WINDOW f AS (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING))", **_V)
def local_slope(spark, sf_dir):
    return rounded(_health(spark, sf_dir).select("cell_id", "cycle", regime.local_slope("SoHQ").alias("s")), 5)


@query("health_bands", f"""SELECT cell_id, band, feature, n, {R('first_mean', 'last_mean', 'change', digits=5)} FROM (SELECT *, last_mean - first_mean AS change FROM (
  SELECT cell_id, band, feature, max(n) AS n, avg(value) FILTER (p <= n // 3) AS first_mean, avg(value) FILTER (p > n - n // 3) AS last_mean, count(value) FILTER (p <= n // 3) AS a, count(value) FILTER (p > n - n // 3) AS b FROM (
    SELECT cell_id, band, n, p, unnest(['R10', 'hyst']) AS feature, unnest([R10, hyst]) AS value FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, band ORDER BY cycle) AS p, count(*) OVER (PARTITION BY cell_id, band) AS n FROM (
      SELECT *, CASE WHEN SoHQ <= 200 AND SoHQ > 90 THEN '200-90' WHEN SoHQ <= 90 AND SoHQ > 50 THEN '90-50' END AS band FROM v_traj) WHERE band IS NOT NULL) WHERE n >= 6) GROUP BY ALL) WHERE a >= 2 AND b >= 2)""", **_V)  # fmt: skip
def health_bands(spark, sf_dir):
    return rounded(trajectory.bands(_health(spark, sf_dir), edges=((200.0, 90.0), (90.0, 50.0)), columns=["R10", "hyst"]), 5)


@query("knee_split", f"""SELECT cell_id, knee_cycle, {R('before_mean', 'after_mean', digits=5)} FROM (SELECT t.cell_id, knee_cycle, avg(SoHQ) FILTER (cycle < knee_cycle) AS before_mean, avg(SoHQ) FILTER (cycle >= knee_cycle) AS after_mean FROM v_traj t JOIN (
  SELECT cell_id, coalesce(min(cycle) FILTER (SoHQ <= 40), min(cycle) FILTER (p >= floor(n * 0.6) + 1)) AS knee_cycle FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS p, count(*) OVER (PARTITION BY cell_id) AS n FROM v_traj WHERE SoHQ IS NOT NULL) GROUP BY cell_id) k USING (cell_id) GROUP BY ALL)""", **_V)  # fmt: skip
def knee_split(spark, sf_dir):
    return rounded(trajectory.knee_split(_health(spark, sf_dir).select("cell_id", "cycle", "SoHQ"), knee=40.0), 5)


# Track A

_LONG = "SELECT cell_id, cycle, unnest(['R10', 'hyst', 'i_dchg', 'CE']) AS feature, unnest([R10, hyst, i_dchg, CE]) AS value, SoHQ AS health FROM v_traj"
_REF = """SELECT cell_id, feature, median(value) AS center, stddev_samp(value) AS scale FROM (SELECT *, count(*) FILTER (early) OVER (PARTITION BY cell_id, feature) AS m FROM (
  SELECT l.*, cycle <= p AS early, n FROM v_long l JOIN (SELECT cell_id, quantile_cont(cycle, 0.2) AS p, count(*) AS n FROM v_cycle GROUP BY cell_id) USING (cell_id))) WHERE n < 5 OR m < 3 OR early GROUP BY ALL"""
_Z = "SELECT cell_id, cycle, feature, value, health, abs(value - center) / nullif(scale, 0) AS z FROM v_long JOIN v_ref USING (cell_id, feature)"
_S = {"v_cycle": views.CYCLES, "v_traj": views.TRAJECTORY, "v_long": _LONG, "v_ref": _REF, "v_z": _Z}
_RAW = "covar_pop({y}, {x}) / nullif(stddev_pop({y}) FILTER ({x} IS NOT NULL) * stddev_pop({x}) FILTER ({y} IS NOT NULL), 0)"
_CORR = "CASE WHEN " + _RAW + " IS NOT NULL THEN greatest(-1, least(1, " + _RAW + ")) END"


def _corr(y: str, x: str) -> str:
    return _CORR.format(y=y, x=f"CAST({x} AS DOUBLE)")


@query("reference_stats", f"SELECT cell_id, feature, {R('center', 'scale', digits=5)} FROM v_ref", **_S)
def reference_stats(spark, sf_dir):
    return rounded(score.reference_stats(_health(spark, sf_dir), INDICATORS), 5)


@query("indicator_scores", f"""SELECT cell_id, cycle, {R('indicator_score', digits=5)}, indicator_n_scored, indicator_n_scored / 4 AS indicator_coverage,
  CASE WHEN indicator_score >= 0.75 THEN 'alert' WHEN indicator_score >= 0.55 THEN 'watch' WHEN indicator_score IS NOT NULL AND indicator_n_scored = 4 THEN 'ok' ELSE 'unknown' END AS indicator_flag, indicator_top FROM (
  SELECT cell_id, cycle, CASE WHEN count(z) > 0 THEN greatest(0, least(1, avg(z) / 3)) END AS indicator_score, count(z) AS indicator_n_scored, array_to_string((list(feature ORDER BY z DESC, feature) FILTER (z IS NOT NULL))[1:3], ',') AS indicator_top FROM v_z GROUP BY ALL)""", **_S)  # fmt: skip
def indicator_scores(spark, sf_dir):
    return rounded(score.score_rows(_health(spark, sf_dir), INDICATORS), 5)


@query("indicator_summary", f"""SELECT feature, {R('coverage', 'r_cycle', 'r_health', 'early_mean', 'late_mean', 'median', 'late_z', 'score', digits=5)} FROM (SELECT *, greatest(coalesce(abs(r_health), abs(r_cycle) * 0.85, 0), CASE WHEN late_z IS NULL THEN 0 ELSE greatest(0, least(1, late_z / 3)) END) AS score FROM (
  SELECT feature, count(value) / count(*) AS coverage, {_corr('value', 'cycle')} AS r_cycle, {_corr('value', 'health')} AS r_health, avg(value) FILTER (cycle <= lo) AS early_mean, avg(value) FILTER (cycle >= hi) AS late_mean, median(value) AS median, avg(z) FILTER (cycle >= hi) AS late_z
  FROM v_z, (SELECT quantile_cont(cycle, 0.2) AS lo, quantile_cont(cycle, 0.8) AS hi FROM v_cycle) GROUP BY feature))""", **_S)  # fmt: skip
def indicator_summary(spark, sf_dir):
    return rounded(score.summarize(_health(spark, sf_dir), INDICATORS, "SoHQ"), 5)


_SCREEN = f"""SELECT *, greatest(coalesce(abs(r_health), abs(r_cycle) * 0.85, 0), CASE WHEN change IS NULL THEN 0 ELSE 0.7 * least(1, abs(change / spread)) END) AS severity FROM (
  SELECT cell_id, feature, count(value) / count(*) AS coverage, stddev_samp(value) AS spread, {_corr('value', 'cycle')} AS r_cycle, {_corr('value', 'health')} AS r_health,
    avg(value) FILTER (cycle >= hi) - avg(value) FILTER (cycle <= lo) AS change, regr_slope(value, cycle) AS slope FROM v_long JOIN (SELECT cell_id, quantile_cont(cycle, 0.2) AS lo, quantile_cont(cycle, 0.8) AS hi FROM v_cycle GROUP BY cell_id) USING (cell_id) GROUP BY cell_id, feature) WHERE coverage >= 0.05 AND spread >= 1e-12"""


@query("indicator_screen", f"SELECT cell_id, feature, {R('coverage', 'spread', 'r_cycle', 'r_health', 'change', 'slope', 'severity', digits=5)} FROM v_screen", **_S, v_screen=_SCREEN)
def indicator_screen(spark, sf_dir):
    return rounded(score.screen(_health(spark, sf_dir), INDICATORS, "SoHQ"), 5)


@query("top_problems", f"SELECT feature, {R('severity', digits=5)}, feature AS family FROM (SELECT feature, avg(severity) AS severity FROM v_screen GROUP BY feature) ORDER BY severity DESC LIMIT 3", **_S, v_screen=_SCREEN)
def top_problems(spark, sf_dir):
    screened = score.screen(_health(spark, sf_dir), INDICATORS, "SoHQ").groupBy("feature").agg(F.avg("severity").alias("severity"))
    return rounded(score.top_per_family(screened, "severity", n=3, least=0.0), 5)


@query("compare_cells", f"""SELECT feature, {R('mean_spread', 'r_spread_cycle', 'cell_range', digits=5)}, n_cells, {R('score', digits=5)} FROM (SELECT *, 0.5 * (rank() OVER (ORDER BY mean_spread) + (count(*) OVER (PARTITION BY mean_spread) - 1) / 2) / count(*) OVER () + 0.5 * (rank() OVER (ORDER BY cell_range) + (count(*) OVER (PARTITION BY cell_range) - 1) / 2) / count(*) OVER () AS score FROM (
  SELECT feature, avg(s) AS mean_spread, {_corr('s', 'cycle')} AS r_spread_cycle FROM (SELECT feature, cycle, stddev_samp(value) AS s FROM v_late GROUP BY ALL) GROUP BY feature) JOIN (SELECT feature, max(m) - min(m) AS cell_range, count(m) AS n_cells FROM (SELECT feature, cell_id, avg(value) AS m FROM v_late GROUP BY ALL) GROUP BY feature) USING (feature))""",
    **_S, v_late="SELECT * FROM v_long, (SELECT quantile_cont(cycle, 0.8) AS hi FROM v_cycle) WHERE cycle >= hi")
def compare_cells(spark, sf_dir):
    return rounded(score.compare_cells(_health(spark, sf_dir), INDICATORS), 5)


# Arms

_ARM = {"v_cycle": views.CYCLES, "v_traj": views.TRAJECTORY, "v_armed": f"SELECT t.*, arm FROM v_traj t JOIN ({views.ARM}) a USING (cell_id)"}
_ARM_LONG = "SELECT arm, cell_id, cycle, unnest(['R10', 'hyst']) AS feature, unnest([R10, hyst]) AS value FROM v_armed"


def _armed(spark, sf_dir):
    return views.arms(spark, sf_dir, _health(spark, sf_dir))


@query("early_parameters", f"""SELECT arm, feature, {R('value', digits=5)} FROM (SELECT * FROM v_mean UNION ALL SELECT 'delta:' || b.arm || '-' || a.arm, feature, b.value - a.value FROM v_mean a JOIN v_mean b USING (feature) WHERE a.arm < b.arm
  UNION ALL SELECT 'pct:' || b.arm || '-' || a.arm, feature, (b.value - a.value) / nullif(abs(a.value), 0) * 100 FROM v_mean a JOIN v_mean b USING (feature) WHERE a.arm < b.arm)""", **_ARM, v_arm_long=_ARM_LONG,
    v_mean="""SELECT arm, feature, avg(value) AS value FROM (SELECT *, bool_or(cycle <= 30) OVER (PARTITION BY arm, cell_id) AS has_early, dense_rank() OVER (PARTITION BY arm, cell_id ORDER BY cycle) AS p FROM v_arm_long) WHERE CASE WHEN has_early THEN cycle <= 30 ELSE p <= 5 END GROUP BY ALL""")
def early_parameters(spark, sf_dir):
    return rounded(doe.early_parameters(_armed(spark, sf_dir), ["R10", "hyst"]), 5)


@query("early_fade", f"SELECT arm, cell_id, n, {R('fade', digits=5)} FROM (SELECT * FROM v_fade UNION ALL SELECT arm, '__arm_mean__', sum(n), avg(fade) FROM v_fade GROUP BY arm)", **_ARM,
    v_fade="SELECT arm, CAST(cell_id AS VARCHAR) AS cell_id, count(*) AS n, regr_slope(SoHQ, cycle) AS fade FROM v_armed WHERE cycle <= 30 AND SoHQ IS NOT NULL GROUP BY arm, cell_id HAVING count(*) >= 3")
def early_fade(spark, sf_dir):
    return rounded(doe.early_fade(_armed(spark, sf_dir)), 5)


@query("arm_trajectories", f"""SELECT arm, cycle, feature, {R('value', digits=5)} FROM (SELECT * FROM v_mean UNION ALL SELECT 'delta:' || b.arm || '-' || a.arm, cycle, feature, b.value - a.value FROM v_mean a JOIN v_mean b USING (cycle, feature) WHERE a.arm < b.arm)""", **_ARM, v_arm_long=_ARM_LONG,
    v_mean="SELECT arm, cycle, feature, avg(value) AS value FROM v_arm_long GROUP BY ALL")
def arm_trajectories(spark, sf_dir):
    return rounded(doe.arm_trajectories(_armed(spark, sf_dir), ["R10", "hyst"]), 5)


@query("late_spread", f"""SELECT feature, count(*) AS n_arms, {R('spread', digits=5)}, max_by(arm, m) AS high_arm, min_by(arm, m) AS low_arm FROM (SELECT feature, arm, avg(value) AS m FROM v_arm_long WHERE cycle >= (SELECT quantile_cont(cycle, 0.8) FROM v_armed) GROUP BY ALL) GROUP BY feature""".replace(R("spread", digits=5), "round(stddev_pop(m), 5) AS spread"), **_ARM, v_arm_long=_ARM_LONG)
def late_spread(spark, sf_dir):
    return rounded(doe.late_spread(_armed(spark, sf_dir), ["R10", "hyst"]), 5)


@query("arm_summary", f"""SELECT arm, feature, {R('mean', 'late_mean', 'slope', digits=5)} FROM (SELECT arm, feature, avg(value) AS mean, avg(value) FILTER (cycle >= hi) AS late_mean, regr_slope(value, cycle) AS slope FROM v_arm_long JOIN (SELECT arm, quantile_cont(cycle, 0.8) AS hi FROM v_armed GROUP BY arm) USING (arm) GROUP BY ALL)""", **_ARM, v_arm_long=_ARM_LONG)
def arm_summary(spark, sf_dir):
    return rounded(doe.arm_summary(_armed(spark, sf_dir), ["R10", "hyst"]), 5)


@query("phase_summary", f"""SELECT arm, phase, {R('R10', 'hyst', digits=5)}, CASE WHEN R10 >= hyst THEN 'R10' ELSE 'hyst' END AS top_mode FROM (SELECT arm, CASE WHEN cycle <= a THEN 'early' WHEN cycle <= b THEN 'mid' ELSE 'late' END AS phase, avg(R10) AS R10, avg(hyst) AS hyst FROM v_armed JOIN (
  SELECT arm, quantile_cont(cycle, 0.33) AS a, quantile_cont(cycle, 0.66) AS b FROM v_armed GROUP BY arm) USING (arm) GROUP BY ALL)""", **_ARM)  # fmt: skip
def phase_summary(spark, sf_dir):
    return rounded(doe.phase_summary(_armed(spark, sf_dir), ["R10", "hyst"]), 5)


# Regimes

_REGIME = f"""SELECT cell_id, regime, feature, count(*) AS n, regr_slope(value, cycle) AS slope, {_corr('value', 'cycle')} AS r, min_by(value, cycle) AS y_start, max_by(value, cycle) AS y_end FROM (
  SELECT *, CASE WHEN cycle >= 60 THEN 2 WHEN cycle >= 30 THEN 1 ELSE 0 END AS regime FROM v_long WHERE value IS NOT NULL) GROUP BY ALL HAVING count(*) >= 5"""


@query("regime_slopes", f"SELECT cell_id, regime, feature, n, {R('slope', 'r', 'y_start', 'y_end', digits=5)} FROM v_regime", **_S, v_regime=_REGIME)
def regime_slopes(spark, sf_dir):
    return rounded(regime.regime_slopes(_health(spark, sf_dir), INDICATORS, (30, 60)), 5)


@query("regime_drivers", f"""SELECT regime, feature, n, {R('r', digits=5)}, rank FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY abs(r) DESC, feature) AS rank FROM (
  SELECT CASE WHEN cycle >= 60 THEN 2 WHEN cycle >= 30 THEN 1 ELSE 0 END AS regime, feature, count(*) AS n, {_corr('value', 'health')} AS r FROM v_long WHERE value IS NOT NULL AND health IS NOT NULL GROUP BY ALL HAVING count(*) >= 15) WHERE r IS NOT NULL) WHERE rank <= 3""", **_S)  # fmt: skip
def regime_drivers(spark, sf_dir):
    return rounded(regime.rank_drivers(_health(spark, sf_dir), INDICATORS, "SoHQ", (30, 60), top_n=3), 5)


@query("singularities", f"""SELECT cell_id, feature, breakpoint, {R('jump', 'slope_before', 'slope_after', digits=5)}, coalesce(slope_before * slope_after < 0, false) AS sign_flip FROM (
  SELECT j.*, a.slope AS slope_before, b.slope AS slope_after FROM (SELECT cell_id, feature, CAST(bp AS DOUBLE) AS breakpoint, k, avg(value) FILTER (cycle >= bp AND cycle < bp + 15) - avg(value) FILTER (cycle < bp AND cycle >= bp - 15) AS jump FROM v_long, (VALUES (30, 0), (60, 1)) t(bp, k) GROUP BY ALL) j
  LEFT JOIN v_regime a ON a.cell_id = j.cell_id AND a.feature = j.feature AND a.regime = k LEFT JOIN v_regime b ON b.cell_id = j.cell_id AND b.feature = j.feature AND b.regime = k + 1)""", **_S, v_regime=_REGIME.replace(">= 5", ">= 10"))  # fmt: skip
def singularities(spark, sf_dir):
    return rounded(regime.singularities(_health(spark, sf_dir), INDICATORS, (30, 60)), 5)


@query("block_relaxation", f"""SELECT cell_id, block_start, block_end, {R('q_relax', 'q_relax_pct')}, abs(q_relax_pct) > 0.065 AS significant FROM (SELECT cell_id, block_start, block_end, q2 - q1 AS q_relax, (q2 - q1) / nullif(q2, 0) * 100 AS q_relax_pct FROM (
  SELECT b.cell_id, block_start, block_end, max(dchgCapa) FILTER (cycle = block_start) AS q1, max(dchgCapa) FILTER (cycle = block_start + 1) AS q2 FROM v_block b JOIN v_cycle c ON c.cell_id = b.cell_id AND cycle IN (block_start, block_start + 1) GROUP BY ALL))""", v_cycle=views.CYCLES, v_block=_BLOCKS)  # fmt: skip
def block_relaxation(spark, sf_dir):
    c = views.cycles(spark, sf_dir)
    return regime.block_relaxation(c, segment.consecutive_blocks(c.where("n_steps <> 6")))


@query("pre_block_anchors", f"""SELECT cell_id, block_start, {R('anchor')}, n FROM (SELECT cell_id, block_start, avg(dchgCapa) AS anchor, count(*) AS n FROM (
  SELECT b.cell_id, block_start, dchgCapa, row_number() OVER (PARTITION BY b.cell_id, block_start ORDER BY cycle DESC) AS r FROM v_block b JOIN v_cycle c ON c.cell_id = b.cell_id AND cycle < block_start) WHERE r <= 5 GROUP BY ALL)""", v_cycle=views.CYCLES, v_block=_BLOCKS)  # fmt: skip
def pre_block_anchors(spark, sf_dir):
    c = views.cycles(spark, sf_dir)
    return regime.pre_block_anchors(c, segment.consecutive_blocks(c.where("n_steps <> 6")), "dchgCapa")


@query("contamination", f"""SELECT cell_id, cycle, protocol_kind, {R('value', 'expected', 'excess', digits=5)} FROM (SELECT k.cell_id, k.cycle, protocol_kind, dchgCapa AS value, y + a * (k.cycle - x) AS expected, dchgCapa - (y + a * (k.cycle - x)) AS excess FROM v_kind k JOIN v_cycle USING (cell_id, cycle) LEFT JOIN (
  SELECT cell_id, CASE WHEN count(*) > 1 THEN regr_slope(dchgCapa, cycle) END AS a, avg(dchgCapa) AS y, avg(cycle) AS x FROM v_kind JOIN v_cycle USING (cell_id, cycle) WHERE protocol_kind = 'routine' GROUP BY cell_id) USING (cell_id) WHERE protocol_kind <> 'routine')""", **_PROTOCOL)  # fmt: skip
def contamination(spark, sf_dir):
    return rounded(regime.contamination(views.cycles(spark, sf_dir), protocol.protocol_kinds(_flags(spark, sf_dir), post=1), "dchgCapa"), 5)


@query("landmark_trend", f"""SELECT cell_id, feature, {R('early', 'late', 'change_pct', digits=5)} FROM (SELECT *, (late - early) / nullif(abs(early), 0) * 100 AS change_pct FROM (SELECT cell_id, feature, median(value) FILTER (cycle <= lo) AS early, median(value) FILTER (cycle >= hi) AS late FROM v_long JOIN (
  SELECT cell_id, quantile_cont(cycle, 0.2) AS lo, quantile_cont(cycle, 0.8) AS hi FROM v_cycle GROUP BY cell_id) USING (cell_id) WHERE feature IN ('R10', 'hyst') GROUP BY ALL))""", **_S)  # fmt: skip
def landmark_trend(spark, sf_dir):
    return rounded(regime.landmark_trend(_health(spark, sf_dir), ["R10", "hyst"]), 5)


@query("soc_ratios", f"SELECT cell_id, {R('ratio_20_50', 'ratio_80_50', 'r_soc_slope', digits=5)} FROM (SELECT cell_id, r20 / nullif(r50, 0) AS ratio_20_50, r80 / nullif(r50, 0) AS ratio_80_50, r_soc_slope FROM (SELECT cell_id, max(r) FILTER (soc = 20) AS r20, max(r) FILTER (soc = 50) AS r50, max(r) FILTER (soc = 80) AS r80, CASE WHEN count(*) >= 2 THEN regr_slope(r, soc) END AS r_soc_slope FROM (SELECT cell_id, 20 + 30 * (cycle - 1) AS soc, hyst AS r FROM v_cycle WHERE cycle IN (1, 2, 3) AND hyst IS NOT NULL) GROUP BY cell_id))")
def soc_ratios(spark, sf_dir):
    rows = views.cycles(spark, sf_dir).where("cycle in (1, 2, 3) and hyst is not null").select("cell_id", (20 + 30 * (F.col("cycle") - 1)).alias("soc"), F.col("hyst").alias("r"))
    return rounded(regime.soc_ratios(rows, ["cell_id"]), 5)


@query("ocv_drift", f"""SELECT cell_id, block_start, {R('d80', 'd50', 'd20', 'shift', 'spread_change')}, CASE WHEN shift IS NULL THEN 'unknown' WHEN greatest(abs(d80), abs(d50), abs(d20)) < 0.005 AND abs(spread_change) < 0.01 THEN 'stable' WHEN abs(spread_change) < 0.01 AND abs(shift) >= 0.005 THEN 'parallel_shift'
  WHEN abs(spread_change) >= 0.01 AND abs(shift) >= 0.005 THEN 'spread_and_shift' WHEN abs(spread_change) >= 0.01 THEN 'spread_change' ELSE 'local' END AS drift FROM (SELECT *, (d80 + d50 + d20) / 3 AS shift, d80 - d20 AS spread_change FROM (
  SELECT cell_id, cycle AS block_start, R10 - first(R10) OVER w AS d80, dchgCapa / 10000 - first(dchgCapa / 10000) OVER w AS d50, chgCapa / 10000 - first(chgCapa / 10000) OVER w AS d20 FROM v_cycle WINDOW w AS (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))""")  # fmt: skip
def ocv_drift(spark, sf_dir):
    c = views.cycles(spark, sf_dir)
    return regime.ocv_drift(c.select("cell_id", F.col("cycle").alias("block_start"), F.col("R10").alias("v80"), (F.col("dchgCapa") / 10000).alias("v50"), (F.col("chgCapa") / 10000).alias("v20")))


@query("shift_relation", f"""SELECT cell_id, n, {R('r_resistance', 'r_endpoint', digits=5)}, CASE WHEN n < 4 THEN 'unknown' WHEN a >= 0.6 AND b < 0.4 THEN 'kinetic' WHEN b >= 0.6 AND a < 0.4 THEN 'inventory' WHEN a >= 0.5 AND b >= 0.5 THEN 'mixed' ELSE 'unclear' END AS kind FROM (SELECT *, coalesce(abs(r_resistance), 0) AS a, coalesce(abs(r_endpoint), 0) AS b FROM (
  SELECT cell_id, count(*) FILTER (R10 IS NOT NULL AND hyst IS NOT NULL AND CE IS NOT NULL) AS n, {_corr('R10', 'hyst')} AS r_resistance, {_corr('R10', 'CE')} AS r_endpoint FROM v_traj GROUP BY cell_id))""", **_V)  # fmt: skip
def shift_relation(spark, sf_dir):
    return rounded(regime.shift_relation(_health(spark, sf_dir), "R10", "hyst", "CE"), 5)


# Track B

_RULES = diagnose.Rules(
    "synthetic",
    "1",
    {
        "wear": diagnose.Mode(
            [diagnose.Term("R10_inc", "increase", 1.0, 25.0), diagnose.Term("CE", "decrease_from_100", 0.5, 3.0)],
            [diagnose.Group("resistance", ["R10_inc"], ("leg_completeness",))],
        ),
        "drift": diagnose.Mode(
            [diagnose.Term("delta_hyst", "either", 0.8, 9000.0), diagnose.Term("R10", "decrease_vs_baseline", 1.1, 0.05)],
            [diagnose.Group("shape", ["delta_hyst"])],
        ),
    },
)
_MODES = {
    "v_row": """
        SELECT *, CASE cell_id % 4 WHEN 0 THEN 'other' WHEN 1 THEN NULL ELSE 'synthetic' END AS chemistry, n_steps >= 3 AS scored, least(1.0, n_steps / 10) AS quality FROM v_traj""",
    "v_signed": """
        SELECT r.*, base.cell_id IS NOT NULL AS has_base, tanh(r.R10_inc / 25.0) AS a, CASE WHEN r.CE BETWEEN 0 AND 100 THEN tanh((100 - r.CE) / 3.0) END AS b,
          tanh(abs(r.delta_hyst) / 9000.0) AS c, tanh((nullif(base.R10, 0) - r.R10) / (0.1 * abs(base.R10) + 0.1 * 0.05)) AS d
        FROM v_row r LEFT JOIN (SELECT * FROM v_row WHERE cycle = 1 AND scored) base ON base.cell_id = r.cell_id""",
    "v_mode": """
        SELECT cell_id, cycle, scored, chemistry, quality, 'wear' AS mode, 1.0 AS w1, 0.5 AS w2, a AS x, b AS y, a IS NOT NULL AND coalesce(chemistry = 'synthetic', false) AS eligible FROM v_signed
        UNION ALL
        SELECT cell_id, cycle, scored, chemistry, quality, 'drift', 0.8, 1.1, c, d, c IS NOT NULL AND coalesce(chemistry = 'synthetic', false) AND has_base FROM v_signed""",
    "v_first": """
        SELECT *, (x IS NOT NULL)::INT + (y IS NOT NULL)::INT AS n, CASE WHEN x IS NULL THEN 0 ELSE w1 END + CASE WHEN y IS NULL THEN 0 ELSE w2 END AS w,
          w1 * coalesce(greatest(x, 0), 0) + w2 * coalesce(greatest(y, 0), 0) AS gain, CASE WHEN x > 0 THEN w1 ELSE 0 END + CASE WHEN y > 0 THEN w2 ELSE 0 END AS agree FROM v_mode WHERE scored""",
    "v_second": """
        SELECT *, gain / nullif(w, 0) AS score, max(CASE WHEN mode = 'wear' THEN gain / nullif(w, 0) END) OVER p AS s_wear, max(CASE WHEN mode = 'drift' THEN gain / nullif(w, 0) END) OVER p AS s_drift
        FROM v_first WINDOW p AS (PARTITION BY cell_id, cycle)""",
    "v_third": """
        SELECT *, 0.6 * n / 2 + 0.4 * quality AS dq,
          0.95 * (0.45 * (0.6 * n / 2 + 0.4 * quality) + 0.40 * agree / nullif(w, 0) + 0.15 * least(1, n / 5)) * CASE WHEN s_wear >= 0.65 AND s_drift >= 0.65 THEN 0.7 ELSE 1.0 END AS conf FROM v_second""",
    "v_fourth": """
        SELECT *, n >= 2 AND dq >= 0.3 AND conf >= 0.25 AND coalesce(chemistry, 'synthetic') = 'synthetic' AS support FROM v_third""",
}


@query("mode_scores", f"""
    SELECT cell_id, cycle, mode, {R('score', 'confidence')}, n AS evidence_count, coverage AS evidence_coverage, status, eligible FROM (
      SELECT *, CASE WHEN n = 0 OR chemistry = 'other' THEN 0.0 ELSE conf END AS confidence, n / 2 AS coverage,
        CASE WHEN n = 0 THEN 'unknown' WHEN support AND eligible THEN 'scientifically_eligible' WHEN support THEN 'heuristic_unverified' ELSE 'insufficient_or_invalid_evidence' END AS status FROM v_fourth)""", **_V, **_MODES)  # fmt: skip
def mode_scores(spark, sf_dir):
    """Two modes over a table with everything that a scientific reading asks for, in part of the cells."""
    semantics = F.create_map(F.lit("schema"), F.lit(diagnose.SEMANTICS_SCHEMA))
    table = _health(spark, sf_dir).withColumns({
        "chemistry": F.when(F.col("cell_id") % 4 == 0, "other").when(F.col("cell_id") % 4 > 1, "synthetic"),
        "protocol_kind": F.when(F.col("n_steps") >= 3, "routine").otherwise("rpt"),
        "protocol_excluded": F.col("n_steps") < 3,
        "protocol_comparable": F.lit(True),
        "protocol_id": F.lit("p"),
        "quality_score": F.least(F.lit(1.0), F.col("n_steps") / 10),
        "quality_status": F.lit("assessed"),
        "quality_evidence_coverage": F.lit(0.5),
        "quality_gate_failed_groups": F.lit(""),
        "leg_completeness": F.col("n_steps") / 10,
        "feature_semantics": semantics,
        "baseline_semantics": F.struct(F.lit(1).alias("cycle"), F.lit(1).alias("requested_cycle"), semantics.alias("feature_semantics")),
    })
    found = diagnose.diagnose(table, _RULES).where("diagnosis_scored_row")
    each = [
        F.struct(F.lit(m).alias("mode"), F.col(diagnose.score_column(m)).alias("score"), F.col(diagnose.confidence_column(m)).alias("confidence"), F.col(f"{m}_evidence_count").alias("evidence_count"),
                 F.col(f"{m}_evidence_coverage").alias("evidence_coverage"), F.col(f"{m}_status").alias("status"), F.col(f"{m}_scientific_eligible").alias("eligible"))
        for m in _RULES.modes
    ]
    return found.select("cell_id", "cycle", F.explode(F.array(*each)).alias("r")).select("cell_id", "cycle", "r.*")


#: What the cycle table has of the solid-state cell's features: column, then how it is made, in SQL that both engines read.
_SOLID = {
    "EoC_dchgR_10s_inc": "R10_inc",
    "EoC_dchgR_60s_inc": "0.8 * R10_inc",
    "hyst_frac_low": "hyst / nullif(i_dchg, 0)",
    "CI_per_hour": "(100 - CE) / n_steps",
    "RCF": "SoHQ / 100",
    "PER": "hyst / 50000",
}
#: Each mode's terms in that table as (evidence, weight), and how many terms its rules have in all.
_SOLID_TERMS = {
    "contact_loss": ((("e10", 1.0), ("frac", 0.9)), 7),
    "interface_R": ((("e60", 0.9),), 5),
    "SE_decomposition": ((("ci", 1.3),), 3),
    "microshort": ((("ci", 0.6),), 3),
    "LLI": ((("ce", 0.35),), 6),
    "solid_diffusion": ((("per", 1.1), ("rcf", 1.0)), 4),
}


def _solid_sql() -> str:
    modes = []
    for mode, (terms, total) in _SOLID_TERMS.items():
        n = " + ".join(f"({e} IS NOT NULL)::INT" for e, _ in terms)
        weight = " + ".join(f"CASE WHEN {e} IS NULL THEN 0 ELSE {w} END" for e, w in terms)
        gain = " + ".join(f"{w} * coalesce(greatest({e}, 0), 0)" for e, w in terms)
        agree = " + ".join(f"CASE WHEN {e} > 0 THEN {w} ELSE 0 END" for e, w in terms)
        modes.append(f"SELECT cell_id, cycle, '{mode}' AS mode, {n} AS n, {total} AS total, ({gain}) / nullif({weight}, 0) AS score, ({agree}) / nullif({weight}, 0) AS agree FROM v_evidence")
    modes.append("SELECT cell_id, cycle, 'LAM_PE', 0, 4, NULL, NULL FROM v_evidence")
    return " UNION ALL ".join(modes)


@query("mode_diagnosis", f"""
    SELECT cell_id, cycle, mode, {R('score', 'confidence')}, CASE WHEN n = 0 THEN 'unknown' WHEN n >= 2 AND n / total >= 0.3 AND confidence >= 0.25 THEN 'heuristic_unverified' ELSE 'insufficient_or_invalid_evidence' END AS status FROM (
      SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE 0.95 * CASE WHEN mode = 'contact_loss' THEN 0.7 ELSE 1.0 END * CASE WHEN high > 1 AND score >= 0.65 THEN 0.7 ELSE 1.0 END
        * (0.45 * n / total + 0.40 * agree + 0.15 * least(1, n / 5)) END AS confidence FROM (
        SELECT *, count(*) FILTER (score >= 0.65) OVER (PARTITION BY cell_id, cycle) AS high FROM v_modes))""", **_V,
    v_solid="SELECT cell_id, cycle, CE, " + ", ".join(f"{sql} AS {name}" for name, sql in _SOLID.items()) + " FROM v_traj",
    v_evidence="""
        SELECT cell_id, cycle, tanh(EoC_dchgR_10s_inc / 25.0) AS e10, tanh(EoC_dchgR_60s_inc / 25.0) AS e60, tanh(hyst_frac_low / 0.05) AS frac,
          CASE WHEN NOT coalesce(CE > 100, false) THEN tanh(CI_per_hour / 0.5) END AS ci, CASE WHEN CE BETWEEN 0 AND 100 THEN tanh((100 - CE) / 2.0) END AS ce, tanh(PER / 0.5) AS per, tanh(-RCF / 0.05) AS rcf FROM v_solid""",
    v_modes=_solid_sql())
def mode_diagnosis(spark, sf_dir):
    """Full rule table of the solid-state cell over what the cycle table has of its features."""
    table = _health(spark, sf_dir).select("cell_id", "cycle", "CE", *(F.expr(sql).alias(name) for name, sql in _SOLID.items()))
    found = diagnose.diagnose(table, diagnose.ASSB_SI)
    each = [F.struct(F.lit(m).alias("mode"), F.col(diagnose.score_column(m)).alias("score"), F.col(diagnose.confidence_column(m)).alias("confidence"), F.col(f"{m}_status").alias("status")) for m in diagnose.ASSB_SI.modes]
    return found.select("cell_id", "cycle", F.explode(F.array(*each)).alias("r")).select("cell_id", "cycle", "r.*")


# The main flow: samples to wide rows to diagnosis


def _wide(spark, sf_dir):
    return wide.feature_rows(views.cell_samples(spark, sf_dir))


_ENERGY = """SELECT *, (voltage + lag(voltage) OVER l) / 2 * (capacity - lag(capacity) OVER l) AS dE, row_number() OVER l AS k, row_number() OVER b AS back
  FROM v_cell WINDOW l AS (PARTITION BY cell_id, cycle, step_type ORDER BY row_id), b AS (PARTITION BY cell_id, cycle, step_type ORDER BY row_id DESC)"""
_WIDE_COLUMNS = ("chgCapa", "dchgCapa", "chg_V_cutoff", "dchg_V_cutoff", "chg_E_observed", "dchg_E_observed", "EoC_restV_init", "EoC_restV_end", "CE", "SoHQ")


@query("wide_relational", f"""SELECT cell_id, cycle, {R(*_WIDE_COLUMNS, digits=5)} FROM (
  SELECT *, dchgCapa / chgCapa * 100 AS CE, dchgCapa / first(dchgCapa) OVER (PARTITION BY cell_id ORDER BY cycle) * 100 AS SoHQ FROM (
    SELECT cell_id, cycle, max(capacity) FILTER (step_type = 'charge') AS chgCapa, max(capacity) FILTER (step_type = 'discharge') AS dchgCapa,
      max(voltage) FILTER (step_type = 'charge' AND back = 1) AS chg_V_cutoff, max(voltage) FILTER (step_type = 'discharge' AND back = 1) AS dchg_V_cutoff,
      sum(dE) FILTER (step_type = 'charge') AS chg_E_observed, sum(dE) FILTER (step_type = 'discharge') AS dchg_E_observed,
      max(voltage) FILTER (step_type = 'rest' AND k = 1) AS EoC_restV_init, max(voltage) FILTER (step_type = 'rest' AND back = 1) AS EoC_restV_end FROM v_energy GROUP BY ALL))""", v_energy=_ENERGY)  # fmt: skip
def wide_relational(spark, sf_dir):
    """Columns of the wide row that SQL can tell."""
    return rounded(_wide(spark, sf_dir).select("cell_id", "cycle", *_WIDE_COLUMNS), 5)


@query("wide_rows")
def wide_rows(spark, sf_dir):
    """The whole wide row, but for its maps of meanings."""
    rows = _wide(spark, sf_dir)
    return rows.select(*(c for c, t in rows.dtypes if not t.startswith(("map", "struct"))))


@query("wide_diagnosis")
def wide_diagnosis(spark, sf_dir):
    """Modes of the full cell over the wide rows."""
    found = diagnose.diagnose(_wide(spark, sf_dir), diagnose.FULL_CELL)
    each = [F.struct(F.lit(m).alias("mode"), F.col(diagnose.score_column(m)).alias("score"), F.col(diagnose.confidence_column(m)).alias("confidence"), F.col(f"{m}_evidence_count").alias("evidence_count"), F.col(f"{m}_status").alias("status")) for m in diagnose.FULL_CELL.modes]
    return found.select("cell_id", "cycle", F.explode(F.array(*each)).alias("r")).select("cell_id", "cycle", "r.*")


# Curves: no SQL; tests compare them with direct computation.


@query("derivative_curves")
def derivative_curves(spark, sf_dir):
    return curves.derivative_curves(views.legs(spark, sf_dir), order=ORDER)


@query("robust_peaks")
def robust_peaks(spark, sf_dir):
    return curves.robust_peak_table(views.legs(spark, sf_dir), order=ORDER)


_BANDS = ((2.5, 2.7, "low"), (2.7, 3.0, "mid"), (3.0, 5.0, "high"))


def _banded(spark, sf_dir):
    return curves.peak_table(views.legs(spark, sf_dir), {"charge": _BANDS, "discharge": _BANDS}, order=ORDER)


@query("banded_peaks")
def banded_peaks(spark, sf_dir):
    return _banded(spark, sf_dir).dropna(subset=["band"])


@query("charge_peaks")
def charge_peaks(spark, sf_dir):
    return curves.charge_peak_table(views.legs(spark, sf_dir), order=ORDER)


@query("shape_features")
def shape_features(spark, sf_dir):
    return curves.shape_features(views.legs(spark, sf_dir), order=ORDER)


@query("best_cycles")
def best_cycles(spark, sf_dir):
    return curves.best_cycle(_monthly(spark, sf_dir), least=1)


@query("stitched_sweeps")
def stitched_sweeps(spark, sf_dir):
    runs = segment.capacity_runs(views.samples(spark, sf_dir), "inc", order=ORDER).where("step_type in ('charge', 'discharge')")
    return curves.stitched_sweeps(runs.withColumnsRenamed({"step_type": "leg", "inc": "capacity"}), ["cell_id", "leg"], order=ORDER)


@query("hysteresis")
def hysteresis(spark, sf_dir):
    return curves.hysteresis(views.legs(spark, sf_dir), order=ORDER)


def _monthly(spark, sf_dir):
    """Line items as curves: a supplier's quantities of a month in order, summed, against their prices."""
    items = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cell_id"),
        F.year("l_shipdate").alias("cycle"),
        F.lit("discharge").alias("leg"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("inc"),
        (F.col("l_extendedprice") / 1e4).alias("inc_v"),
    )
    # Columns of their own, as a sort by a struct has no prefix to compare.
    w = Window.partitionBy("cell_id", "cycle").orderBy("l_shipdate", "l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    summed = items.withColumns({"capacity": F.sum("inc").over(w), "voltage": F.sum("inc_v").over(w), "place": F.row_number().over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return summed.select("cell_id", "cycle", "leg", F.col("place").alias("row_id"), "capacity", "voltage")


@query("shape_distance")
def shape_distance(spark, sf_dir):
    return curves.shape_distance(curves.normalised_curves(_monthly(spark, sf_dir)), baseline_cycle=1995)


def _maps(spark, sf_dir):
    """A supplier's years as discharges on the fixed grid."""
    return evolution.evolution_map(_monthly(spark, sf_dir))


@query("evolution_map")
def evolution_map(spark, sf_dir):
    return _maps(spark, sf_dir)


@query("peak_evolution")
def peak_evolution(spark, sf_dir):
    return evolution.tracks(_maps(spark, sf_dir))


@query("peak_summary")
def peak_summary(spark, sf_dir):
    return evolution.summary(evolution.tracks(_maps(spark, sf_dir)))


@query("peak_events")
def peak_events(spark, sf_dir):
    maps = _maps(spark, sf_dir)
    return evolution.events(evolution.tracks(maps), maps)


@query("evolution_preflight")
def evolution_preflight(spark, sf_dir):
    return evolution.preflight(_maps(spark, sf_dir))


@query("steep_onsets")
def steep_onsets(spark, sf_dir):
    return evolution.steep_onsets(_monthly(spark, sf_dir))


@query("peak_disappearances")
def peak_disappearances(spark, sf_dir):
    """Each ridge's every cycle, asked whether the area around it stays."""
    maps = _maps(spark, sf_dir)
    tracks = evolution.tracks(maps)
    width = F.col("half_width")
    return curves.disappearances(maps, tracks.select("cell_id", "leg", "track", "cycle", F.greatest(F.lit(0.0), (F.col("place") - width).cast("double")).alias("lo"), (F.col("place") + width + 1).cast("double").alias("hi")))


@query("health_inflections")
def health_inflections(spark, sf_dir):
    return curves.inflections(_health(spark, sf_dir).select("cell_id", "cycle", "SoHQ"))


@query("rest_time_constants", f"""SELECT cell_id, leg, {R('tau', digits=3)} FROM (
  SELECT cell_id, leg, CASE WHEN max(n) >= 8 AND count(*) FILTER (used) >= 5 AND min(off) FILTER (used) > 0 AND slope < -1e-9 AND -1 / slope <= 1e6 THEN -1 / slope END AS tau FROM (
    SELECT *, regr_slope(CASE WHEN used AND off > 0 THEN ln(off) END, t) OVER (PARTITION BY cell_id, leg) AS slope FROM v_off) GROUP BY cell_id, leg, slope)""",
  v_placed="SELECT *, row_number() OVER (PARTITION BY cell_id, leg ORDER BY time, row_id) AS k, count(*) OVER (PARTITION BY cell_id, leg) AS n, time - min(time) OVER (PARTITION BY cell_id, leg) AS t FROM v_leg",
  v_end="SELECT *, abs(voltage - avg(CASE WHEN k > n - greatest(3, n // 5) THEN voltage END) OVER (PARTITION BY cell_id, leg)) AS off, k > n - greatest(3, n // 5) AS tail FROM v_placed",
  v_off="SELECT *, NOT tail AND (k <= greatest(1, n // 10) OR off > 1e-4 * greatest(1.0, first(off) OVER (PARTITION BY cell_id, leg ORDER BY k))) AS used FROM v_end")
def rest_time_constants(spark, sf_dir):
    return rounded(rests.rest_taus(views.legs(spark, sf_dir), ["cell_id", "leg"], ORDER), 3)


@query("health_turns")
def health_turns(spark, sf_dir):
    return curves.turning_points(_health(spark, sf_dir).select("cell_id", "cycle", "SoHQ"), least=20)


@query("noise_uniformity")
def noise_uniformity(spark, sf_dir):
    return curves.noise_uniformity(curves.noise_curves(views.legs(spark, sf_dir), order=ORDER))


@query("wiggle_widths")
def wiggle_widths(spark, sf_dir):
    return curves.wiggle_widths(views.legs(spark, sf_dir), 2.5, 4.0, order=ORDER)


@query("cycle_ranks", f"""SELECT cell_id, cycle, rank, {R('quality', 'noise_ratio', 'hf_std')}, n_charge, n_discharge FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY quality, cycle) AS INTEGER) AS rank FROM (
    SELECT cell_id, cycle, R10 * 1.5 AS noise_ratio, hyst / 1e4 AS hf_std, n_steps % 5 AS n_charge, n_steps % 7 AS n_discharge,
      3 * R10 * 1.5 + 0.15 * hyst / 1e4 + 0.25 * (abs(n_steps % 5 - 3) + abs(n_steps % 7 - 3)) + CASE WHEN 20 * n_steps < 100 THEN 5 ELSE 0 END AS quality FROM v_cycle WHERE hyst IS NOT NULL)) WHERE rank <= 10""")  # fmt: skip
def cycle_ranks(spark, sf_dir):
    """Months with their tax as noise of the charge and twice that of the discharge."""
    c = views.cycles(spark, sf_dir)
    leg = lambda name, noise, peaks_: c.select("cell_id", "cycle", F.lit(name).alias("leg"), (F.col("R10") * noise).alias("noise_ratio"), (F.col("hyst") / 1e4).alias("hf_std"), (F.col("n_steps") % peaks_).alias("n_peaks"), (20 * F.col("n_steps")).alias("n_points"))
    return peaks.rank_cycles(leg("charge", 1.0, 5).unionByName(leg("discharge", 2.0, 7)))


@query("largest_gaps", f"""SELECT cell_id, {R('gap', 'gap_share')}, n_features, source FROM (
  SELECT cell_id, max(step) AS gap, 100 * max(step) / max(total) AS gap_share, count(*) AS n_features, kind AS source FROM (
    SELECT *, lead(Q) OVER (PARTITION BY cell_id, kind ORDER BY V, Q) - Q AS step FROM (SELECT cell_id, CASE leg WHEN 'charge' THEN 'peak' ELSE 'valley' END AS kind, voltage AS V, capacity AS Q, 1000.0 AS total FROM v_leg))
  GROUP BY cell_id, kind HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY kind DESC) = 1)""")  # fmt: skip
def largest_gaps(spark, sf_dir):
    """Charges as peaks, discharges as valleys."""
    s = views.legs(spark, sf_dir).select("cell_id", F.when(F.col("leg") == "charge", "peak").otherwise("valley").alias("kind"), F.col("voltage").alias("V"), F.col("capacity").alias("Q"), F.lit(1000.0).alias("total"))
    return peaks.largest_gaps(s, ["cell_id"])


@query("pulse_parameters")
def pulse_parameters(spark, sf_dir):
    s = views.legs(spark, sf_dir)
    start = s.groupBy("cell_id", "leg").agg(F.min("time").alias("t0"))
    pulses = s.join(start, ["cell_id", "leg"]).select("cell_id", "leg", "time", "row_id", ((F.col("time") - F.col("t0")) / 86400).alias("t"), (F.col("capacity") / 100).alias("r_mohm"))
    return curves.pulse_parameters(pulses, ["cell_id", "leg"], ORDER)


# Peaks over cycles


@query("golden_peaks")
def golden_peaks(spark, sf_dir):
    return peaks.golden_references(_banded(spark, sf_dir).dropna(subset=["band"]))


@query("tracked_peaks")
def tracked_peaks(spark, sf_dir):
    found = cut(_banded(spark, sf_dir).dropna(subset=["band"]), "banded")
    return peaks.track(found, peaks.golden_references(found))


@query("assigned_peaks")
def assigned_peaks(spark, sf_dir):
    found = cut(_banded(spark, sf_dir).dropna(subset=["band"]), "banded")
    refs = peaks.golden_references(found).select("leg", F.col("band").alias("peak_id"), F.col("V_ref").alias("V"), F.col("H_ref").alias("H"))
    return curves.assign_peaks(found, refs, most=5.0)


def _sized(found):
    """Heights by their order of magnitude, with their sign."""
    return found.withColumn("H", F.signum("H") * F.log1p(F.abs("H")))


@query("labelled_peaks")
def labelled_peaks(spark, sf_dir):
    """All peaks of each leg, named after the banded ones by centroids and forests."""
    known = _sized(_banded(spark, sf_dir).dropna(subset=["band"])).withColumnRenamed("band", "peak_id")
    refs, forests = labels.train_labels(known, settings=forest.Settings(trees=24, depth=8))
    candidates = _sized(curves.robust_peak_table(views.legs(spark, sf_dir), order=ORDER)).dropna(subset=["V"])
    return labels.assign(candidates, refs, forests, most=1.0)


def _tests_and_routine(spark, sf_dir):
    """A supplier's year 1995 as its test, whose four widest voltage bands name peaks; other years as routine cycles."""
    found = curves.robust_peak_table(_monthly(spark, sf_dir).withColumn("voltage", F.col("voltage") / 100)).dropna(subset=["V"])
    found = cut(found.withColumnRenamed("peak", "candidate"), "peaks")  # tests, routine cycles and every level of a forest read them
    name = F.concat(F.lit("P"), F.least(F.lit(4), F.floor(F.col("V") / 0.5) + 1).cast("string"))
    tests = found.where("cycle = 1995").groupBy("cell_id", F.lit(1995).alias("life"), "cycle", "leg", name.alias("peak_id")).agg(F.max_by("V", F.struct("H", "V")).alias("V"), F.max("H").alias("H"))
    return tests, found.where("cycle <> 1995")


@query("overlap_training")
def overlap_training(spark, sf_dir):
    tests, routine = _tests_and_routine(spark, sf_dir)
    return labels.overlap_rows(tests, tests, routine, labels.near_cycles(tests, routine))


@query("overlap_scores")
def overlap_scores(spark, sf_dir):
    tests, routine = _tests_and_routine(spark, sf_dir)
    return labels.overlap(tests, tests, routine, routine, forest.Settings(trees=24, depth=8, least=2, least_rows=8))["soft"]


@query("peak_derivatives", f"""SELECT cell_id, cycle, {R('dV', 'dH', digits=5)} FROM (SELECT cell_id, cycle, (SoHQ - lag(SoHQ) OVER w) / nullif(cycle - lag(cycle) OVER w, 0) AS dV, (hyst - lag(hyst) OVER w) / nullif(cycle - lag(cycle) OVER w, 0) AS dH FROM v_traj WINDOW w AS (PARTITION BY cell_id ORDER BY cycle))""", **_V)
def peak_derivatives(spark, sf_dir):
    t = _health(spark, sf_dir).select("cell_id", "cycle", F.col("SoHQ").alias("V"), F.col("hyst").alias("H"))
    return rounded(peaks.derivatives(t, ["cell_id"]).select("cell_id", "cycle", "dV", "dH"), 5)


@query("peak_fade_correlation", f"""SELECT feature, target, n, {R('r', digits=5)} FROM (SELECT feature, target, count(*) AS n, {_corr('value', 'goal')} AS r FROM (
  SELECT unnest(['R10', 'hyst']) AS feature, unnest([R10, hyst]) AS value, SoHQ, dchgCapa FROM v_traj), LATERAL (SELECT unnest(['SoHQ', 'dchgCapa']) AS target, unnest([SoHQ, dchgCapa]) AS goal) WHERE value IS NOT NULL AND goal IS NOT NULL GROUP BY ALL HAVING count(*) >= 8)""", **_V)  # fmt: skip
def peak_fade_correlation(spark, sf_dir):
    return rounded(peaks.correlate_with_fade(_health(spark, sf_dir), ["R10", "hyst"], ["SoHQ", "dchgCapa"]), 5)


# Mechanisms, steps, models


#: Columns that a mechanism asks for, made out of the cycle table in SQL that both engines read.
_SILICON = {
    "dchgCapa": "dchgCapa",
    "RCF": "dchgCapa / nullif(i_dchg, 0) * 400",
    "dchg_Q_cliff_abs": "dchgCapa * 0.5 + R10 * 100",
    "dchg_dVdQ_SOC0_to_mid_ratio": "R10 * 50",
    "dchg_Q_high_V": "hyst / 100",
    "dchg_Q_low_V": "i_dchg / 100",
    "dchg_fit_dR": "CASE WHEN n_steps > 6 THEN R10 * 100 END",
    "dchg_fit_residual_argmax_SOC": "CASE WHEN n_steps > 3 THEN 10 * n_steps END",
    "LLI_vs_R_ratio": "abs(R10_inc) / 20",
}
_SIGNED = {
    "h1": ((1.2, "1 - abs(s_cliff) / 0.5"), (1.0, "s_frac / 0.3"), (1.3, "s_ratio / 0.3"), (1.0, "(30 - soc) / 30"), (0.8, "1 - lli / 2"), (1.0, "fade / 3 - 0.5")),
    "h2": ((1.3, "-s_cliff / 0.3"), (1.2, "lli / 3 - 0.5"), (0.7, "(soc - 40) / 40"), (1.1, "1 - abs(fade - 1) / 0.5")),
}


def _mean_signed(terms) -> str:
    total = " + ".join(f"{w} * coalesce(greatest(-1, least(1, {e})), 0) * (CASE WHEN ({e}) IS NULL THEN 0 ELSE 1 END)" for w, e in terms)
    weight = " + ".join(f"CASE WHEN ({e}) IS NULL THEN 0 ELSE {w} END" for w, e in terms)
    return f"coalesce(({total}) / nullif({weight}, 0), 0)"


@query("mechanism", f"""
    SELECT cell_id, cycle, mechanism_state, {R('score_H1', 'score_H2', 'mechanism_confidence', digits=5)}, n_evidence, min(CASE WHEN d <> before THEN cycle END) OVER (PARTITION BY cell_id) AS mechanism_crossover_cycle FROM (
      SELECT *, sign(score_H1 - score_H2) AS d, lag(sign(score_H1 - score_H2)) OVER (PARTITION BY cell_id ORDER BY cycle) AS before FROM (
        SELECT cell_id, cycle, n_evidence, CASE WHEN gate THEN 0 ELSE h1 END AS score_H1, CASE WHEN gate THEN 0 ELSE h2 END AS score_H2,
          CASE WHEN gate THEN 'impedance_only' WHEN n_evidence < 2 THEN 'undetermined' WHEN abs(h1 - h2) < 0.15 THEN 'mixed' WHEN h1 > h2 THEN 'H1_dominant' ELSE 'H2_dominant' END AS mechanism_state,
          CASE WHEN gate THEN 0.7 WHEN n_evidence < 2 THEN 0.2 ELSE greatest(0, least(1, 0.3 + 0.35 * n_evidence / 6 + 0.35 * abs(h1 - h2))) END AS mechanism_confidence FROM v_weighed))""", **_V,
    v_silicon="SELECT cell_id, cycle, " + ", ".join(f"{sql} AS {name}" for name, sql in _SILICON.items()) + " FROM v_traj",
    v_start="SELECT * FROM v_silicon QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY cycle) = 1",
    v_last="""
        SELECT *, count(dchg_Q_cliff_abs) OVER w AS n_cliff, count(RCF) OVER w AS n_rcf, count(dchg_dVdQ_SOC0_to_mid_ratio) OVER w AS n_ratio FROM v_silicon WINDOW w AS (PARTITION BY cell_id ORDER BY cycle DESC)""",
    v_slope="""
        SELECT cell_id, CASE WHEN count(dchg_Q_cliff_abs) FILTER (n_cliff <= 100) >= 5 THEN 100 * regr_slope(dchg_Q_cliff_abs, cycle) FILTER (n_cliff <= 100) END AS s_cliff,
          CASE WHEN count(dchg_Q_cliff_abs) FILTER (n_cliff <= 100) >= 5 THEN 100 * regr_slope(dchg_Q_cliff_abs / dchgCapa, cycle) FILTER (n_cliff <= 100) END AS s_frac,
          CASE WHEN count(dchg_dVdQ_SOC0_to_mid_ratio) FILTER (n_ratio <= 100) >= 5 THEN 100 * regr_slope(dchg_dVdQ_SOC0_to_mid_ratio, cycle) FILTER (n_ratio <= 100) END AS s_ratio FROM v_last GROUP BY cell_id""",
    v_known="""
        SELECT v.cell_id, v.cycle, s_cliff, s_frac, s_ratio, v.dchg_fit_residual_argmax_SOC AS soc, v.LLI_vs_R_ratio AS lli,
          CASE WHEN abs(1 - v.dchg_Q_high_V / b.dchg_Q_high_V) > 1e-6 THEN (1 - v.dchg_Q_low_V / b.dchg_Q_low_V) / (1 - v.dchg_Q_high_V / b.dchg_Q_high_V) END AS fade,
          coalesce(abs(v.dchg_fit_dR) > 2, false) AND coalesce(abs(v.dchgCapa / b.dchgCapa - 1) < 0.03, false) AND coalesce(CASE WHEN b.RCF IS NULL THEN v.RCF < 0.95 ELSE v.RCF < b.RCF * 0.95 END, false) AS gate
        FROM (SELECT * REPLACE (CASE WHEN dchg_Q_high_V IS NULL THEN NULL ELSE dchg_Q_high_V END AS dchg_Q_high_V) FROM v_silicon) v JOIN (SELECT * REPLACE (CASE WHEN dchg_Q_high_V > 0 THEN dchg_Q_high_V END AS dchg_Q_high_V) FROM v_start) b ON b.cell_id = v.cell_id JOIN v_slope s ON s.cell_id = v.cell_id""",
    v_weighed=f"SELECT *, {_mean_signed(_SIGNED['h1'])} AS h1, {_mean_signed(_SIGNED['h2'])} AS h2, " + " + ".join(f"({c} IS NOT NULL)::INT" for c in ("s_cliff", "s_frac", "s_ratio", "soc", "lli", "fade")) + " AS n_evidence FROM v_known")
def mechanism_query(spark, sf_dir):
    table = _health(spark, sf_dir).select("cell_id", "cycle", *(F.expr(sql).cast("double").alias(name) for name, sql in _SILICON.items()))
    found = mechanism.mechanism_indicators(table)
    return rounded(found.select("cell_id", "cycle", "mechanism_state", "score_H1", "score_H2", "mechanism_confidence", "n_evidence", "mechanism_crossover_cycle"), 5)


@query("isolation_scores")
def isolation_scores(spark, sf_dir):
    return isolation.fit_predict(_health(spark, sf_dir), ["R10", "hyst", "CE"])


@query("fade_regression", f"SELECT n, {R('b0', 'b1', 'b2', 'r2', digits=3)} FROM (SELECT *, my - b1 * mx - b2 * mz AS b0, (b1 * xy + b2 * zy) / nullif(yy, 0) AS r2 FROM (SELECT *, (xy * zz - zy * xz) / nullif(xx * zz - xz * xz, 0) AS b1, (zy * xx - xy * xz) / nullif(xx * zz - xz * xz, 0) AS b2 FROM (SELECT count(*) AS n, avg(SoHQ) AS my, avg(R10) AS mx, avg(CE) AS mz, var_pop(R10) AS xx, var_pop(CE) AS zz, var_pop(SoHQ) AS yy, covar_pop(R10, CE) AS xz, covar_pop(R10, SoHQ) AS xy, covar_pop(CE, SoHQ) AS zy FROM v_traj WHERE SoHQ IS NOT NULL AND R10 IS NOT NULL AND CE IS NOT NULL)))", **_V)
def fade_regression(spark, sf_dir):
    return rounded(mechanism.two_variable_fit(_health(spark, sf_dir), "R10", "CE", "SoHQ"), 3)


@query("step_features", """SELECT cell_id, cycle, round(chg, 6) AS chgCapa, round(dchg, 6) AS dchgCapa, n_steps FROM (SELECT cell_id, cycle, max(inc) FILTER (step_type = 'charge') AS chg, max(inc) FILTER (step_type = 'discharge') AS dchg, count(*) AS n_steps FROM v_samples GROUP BY ALL)""")
def step_features(spark, sf_dir):
    return cycle.step_features(views.samples(spark, sf_dir).withColumnRenamed("inc", "capacity"))


# Pulses and tails


_TIMED = "SELECT *, (time - min(time) OVER (PARTITION BY cell_id, leg)) / 86400 AS t, capacity / 100 AS r_mohm FROM v_leg"


# Single analyses


@query("health_of_first", f"""
    SELECT cell_id, tagged_cycle, {R('SoHQ', digits=5)} FROM (
      SELECT *, dchgCapa / nullif(median(dchgCapa) FILTER (tagged_cycle <= 5) OVER (PARTITION BY cell_id), 0) * 100 AS SoHQ FROM (
        SELECT cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS tagged_cycle, dchgCapa FROM v_cycle))""")  # fmt: skip
def health_of_first(spark, sf_dir):
    tagged = views.cycles(spark, sf_dir).withColumn("tagged_cycle", F.row_number().over(Window.partitionBy("cell_id").orderBy("cycle")))
    return rounded(tools.health_of_first(tagged).select("cell_id", "tagged_cycle", "SoHQ"), 5)


@query("moving_average", f"""
    SELECT cell_id, cycle, {R('SoHQ_smooth', digits=5)} FROM (
      SELECT cell_id, cycle, (sum(SoHQ) OVER (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + greatest(0, 6 - p) * first_value + greatest(0, p + 5 - n) * last_value) / 11 AS SoHQ_smooth FROM (
        SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS p, count(*) OVER (PARTITION BY cell_id) AS n, arg_min(SoHQ, cycle) OVER (PARTITION BY cell_id) AS first_value, arg_max(SoHQ, cycle) OVER (PARTITION BY cell_id) AS last_value FROM v_traj))""", **_V)  # fmt: skip
def moving_average(spark, sf_dir):
    return rounded(tools.moving_average(_health(spark, sf_dir).select("cell_id", "cycle", "SoHQ"), "SoHQ").select("cell_id", "cycle", "SoHQ_smooth"), 5)


@query("first_and_last", f"""
    SELECT cell_id, feature, {R('first', 'last', 'coverage', digits=5)} FROM (
      SELECT cell_id, feature, arg_min(value, cycle) AS first, arg_max(value, cycle) AS last, count(value) / count(*) * 100 AS coverage FROM v_long WHERE feature IN ('hyst', 'CE') GROUP BY ALL)""", **_S)  # fmt: skip
def first_and_last(spark, sf_dir):
    return rounded(tools.indicator_summary(_health(spark, sf_dir), ["hyst", "CE"]), 5)


@query("chosen_cycles", """
    SELECT DISTINCT cell_id, cycle FROM (
      SELECT cell_id, cycle FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) - 1 AS p, count(*) OVER (PARTITION BY cell_id) AS n FROM v_most) WHERE p % 25 = 0 OR p < 2 OR p >= n - 2
      UNION ALL SELECT p.cell_id, m.cycle FROM v_most p JOIN v_most m ON m.cell_id = p.cell_id AND m.cycle BETWEEN p.cycle - 1 AND p.cycle + 1 WHERE p.most >= 200)""",
    v_samples=views.SAMPLES, v_most="SELECT cell_id, cycle, max(abs(current)) AS most FROM v_samples GROUP BY ALL")
def chosen_cycles(spark, sf_dir):
    return tools.chosen_cycles(views.samples(spark, sf_dir), 200.0, near=1, ends=2)


@query("cycle_roles", f"""
    SELECT cell_id, cycle, CASE WHEN protocol_kind = 'capacheck' THEN 'rpt' ELSE protocol_kind END AS cycle_role, {R('SoHQ_routine', 'SoHQ_rpt', digits=5)} FROM (
      SELECT t.cell_id, t.cycle, protocol_kind, CASE WHEN protocol_kind = 'routine' THEN SoHQ END AS SoHQ_routine, CASE WHEN protocol_kind = 'capa_full' THEN SoHQ END AS SoHQ_rpt FROM v_traj t JOIN v_kind k ON k.cell_id = t.cell_id AND k.cycle = t.cycle)""",
    **(_PROTOCOL | {"v_traj": views.TRAJECTORY}))
def cycle_roles(spark, sf_dir):
    table = _health(spark, sf_dir).select("cell_id", "cycle", "SoHQ")
    return rounded(recovery.with_roles(table, protocol.protocol_kinds(_flags(spark, sf_dir), post=1)).select("cell_id", "cycle", "cycle_role", "SoHQ_routine", "SoHQ_rpt"), 5)


# Recoveries and pulse blocks


def _recovered(spark, sf_dir):
    table = _health(spark, sf_dir).select("cell_id", "cycle", "SoHQ")
    flags = _flags(spark, sf_dir)
    return recovery.analyze(table, protocol.protocol_kinds(flags, post=1), flags)


@query("recovery_blocks")
def recovery_blocks(spark, sf_dir):
    return _recovered(spark, sf_dir)["blocks"]


@query("recovery_segments")
def recovery_segments(spark, sf_dir):
    return _recovered(spark, sf_dir)["segments"]


@query("recovery_onsets")
def recovery_onsets(spark, sf_dir):
    return _recovered(spark, sf_dir)["onsets"]


@query("health_corrected")
def health_corrected(spark, sf_dir):
    return _recovered(spark, sf_dir)["corrected"]


@query("capacity_relaxation", f"""
    SELECT cell_id, cycle, {R('Q_relax', 'Q_relax_pct')}, abs(Q_relax_pct) > 0.065 AS Q_relax_significant FROM (
      SELECT p.cell_id, unnest([p.c1, p.c2]) AS cycle, b.dchgCapa - a.dchgCapa AS Q_relax, (b.dchgCapa - a.dchgCapa) / nullif(b.dchgCapa, 0) * 100 AS Q_relax_pct
      FROM (SELECT cell_id, block_start AS c1, block_start + 1 AS c2 FROM v_block WHERE block_end > block_start) p JOIN v_cycle a ON a.cell_id = p.cell_id AND a.cycle = c1 JOIN v_cycle b ON b.cell_id = p.cell_id AND b.cycle = c2
      WHERE least(a.dchgCapa, b.dchgCapa) >= 10)""", v_cycle=views.CYCLES, v_block=_BLOCKS)  # fmt: skip
def capacity_relaxation(spark, sf_dir):
    c = views.cycles(spark, sf_dir)
    blocks = segment.consecutive_blocks(c.where("n_steps <> 6"), min_len=2)
    return dcir.relaxation(c, blocks.select("cell_id", F.col("block_start").alias("c1"), (F.col("block_start") + 1).alias("c2")), "Q_relax")


@query("ocv_blocks", f"""
    SELECT cell_id, block_id, block_start_cycle, {R('ocv_spread_20_80', 'ocv_parallel_shift')}, ocv_drift_mode FROM (
      SELECT *, CASE WHEN n = 1 THEN 'baseline' WHEN still THEN 'stable' WHEN line AND NOT wide THEN 'parallel_shift' WHEN wide AND line THEN 'spread_and_shift' WHEN wide THEN 'spread_change' WHEN 2 * c > 0.01 THEN 'local_soc50' ELSE 'stable' END AS ocv_drift_mode,
        CASE WHEN n = 1 OR still THEN 0 ELSE (d80 + d50 + d20) / 3 END AS ocv_parallel_shift FROM (
        SELECT *, c * sqrt(2) < 0.005 AS line, abs(d20 - d80) > 0.01 AS wide, greatest(abs(d80), abs(d50), abs(d20)) < 0.005 AND abs(d20 - d80) < 0.01 AS still FROM (
          SELECT *, abs(d80 - 2 * d50 + d20) / 6 AS c FROM (
            SELECT cell_id, cycle AS block_id, cycle AS block_start_cycle, v20 - v80 AS ocv_spread_20_80, row_number() OVER w AS n, v80 - first(v80) OVER w AS d80, v50 - first(v50) OVER w AS d50, v20 - first(v20) OVER w AS d20 FROM (
              SELECT cell_id, cycle, R10 AS v80, 0.04 + R10 * 0.5 AS v50, dchgCapa / 10000 AS v20 FROM v_cycle) WINDOW w AS (PARTITION BY cell_id ORDER BY cycle)))))""")  # fmt: skip
def ocv_blocks(spark, sf_dir):
    c = views.cycles(spark, sf_dir)
    volts = F.array(*(F.struct(F.lit(s).alias("soc"), v.alias("V_inf_rest")) for s, v in ((80, F.col("R10")), (50, 0.04 + F.col("R10") * 0.5), (20, F.col("dchgCapa") / 10000))))
    rows = c.select("cell_id", F.col("cycle").alias("block_id"), F.col("cycle").alias("block_start"), F.inline(volts), F.lit(None).cast("double").alias("relax_completeness"))
    return dcir.ocv_blocks(rows).select("cell_id", "block_id", "block_start_cycle", "ocv_spread_20_80", "ocv_parallel_shift", "ocv_drift_mode")


@query("root_time_slopes", f"""SELECT cell_id, leg, lo, hi, n, {R('slope', 'r2', digits=5)} FROM (SELECT cell_id, leg, lo, hi, count(*) AS n, CASE WHEN count(*) > 1 THEN regr_slope(r_mohm, sqrt(t)) END AS slope, covar_pop(r_mohm, sqrt(t)) * covar_pop(r_mohm, sqrt(t)) / nullif(var_pop(r_mohm) * var_pop(sqrt(t)), 0) AS r2
  FROM v_timed JOIN (VALUES (1.0::DOUBLE, 10.0::DOUBLE), (10.0, 30.0)) w(lo, hi) ON t BETWEEN lo AND hi GROUP BY ALL)""", v_leg=views.LEGS, v_timed=_TIMED)  # fmt: skip
def root_time_slopes(spark, sf_dir):
    s = views.legs(spark, sf_dir)
    start = s.groupBy("cell_id", "leg").agg(F.min("time").alias("t0"))
    timed = s.join(start, ["cell_id", "leg"]).select("cell_id", "leg", ((F.col("time") - F.col("t0")) / 86400).alias("t"), (F.col("capacity") / 100).alias("r_mohm"))
    return rounded(pulses.root_time_slopes(timed, keys=["cell_id", "leg"]), 5)


@query("cv_start", """SELECT cell_id, cycle, leg, min(p) FILTER (ok) AS cv_start, max(n) AS n FROM (SELECT *, min(low) OVER a = 1 AND count(*) OVER a = 3 AND p > n * 0.1 AS ok FROM (
  SELECT l.*, CASE WHEN abs(current) < 0.92 * cc THEN 1 ELSE 0 END AS low FROM v_placed l JOIN (SELECT cell_id, leg, median(abs(current)) AS cc FROM v_placed WHERE p <= ceil(n / 2) GROUP BY ALL) USING (cell_id, leg))
  WINDOW a AS (PARTITION BY cell_id, leg ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) GROUP BY ALL""", v_leg=views.LEGS,
    v_placed="SELECT *, row_number() OVER (PARTITION BY cell_id, leg ORDER BY time, row_id) AS p, count(*) OVER (PARTITION BY cell_id, leg) AS n FROM v_leg")
def cv_start(spark, sf_dir):
    return pulses.cv_start(views.legs(spark, sf_dir), sustained=3, order=ORDER)


@query("cv_runs", """SELECT cell_id, cycle, leg, arg_max(first, (n, -first)) AS first, max(n) AS n FROM (SELECT cell_id, cycle, leg, min(p) AS first, count(*) AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY cell_id, leg ORDER BY p) AS g FROM (
  SELECT *, row_number() OVER w AS p, voltage >= quantile_cont(voltage, 0.99) OVER (PARTITION BY cell_id, leg) - 0.2 AND abs(current) < lag(abs(current)) OVER w AS inside FROM v_leg WINDOW w AS (PARTITION BY cell_id, leg ORDER BY time, row_id)) WHERE inside) GROUP BY cell_id, cycle, leg, g) GROUP BY ALL""", v_leg=views.LEGS)  # fmt: skip
def cv_runs(spark, sf_dir):
    return pulses.cv_runs(views.legs(spark, sf_dir), margin=0.2, least=1, order=ORDER)


@query("curvature_onset", """SELECT cell_id, min(cycle) FILTER (p > 20 AND abs(d) > 3 * s) AS onset_cycle FROM (SELECT *, stddev_pop(d) FILTER (p <= 20) OVER (PARTITION BY cell_id) AS s FROM (
  SELECT cell_id, cycle, lead(SoHQ) OVER w - 2 * SoHQ + lag(SoHQ) OVER w AS d, row_number() OVER w AS p FROM v_traj WINDOW w AS (PARTITION BY cell_id ORDER BY cycle))) GROUP BY cell_id""", **_V)  # fmt: skip
def curvature_onset(spark, sf_dir):
    return pulses.curvature_onset(_health(spark, sf_dir), "SoHQ")


@query("rank_correlation", f"""SELECT feature, count(*) AS n, {R('rho', digits=5)} FROM (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS x, rank() OVER (PARTITION BY feature ORDER BY health) + (count(*) OVER (PARTITION BY feature, health) - 1) / 2 AS y FROM (
  SELECT cell_id, feature, round(avg(value), 6) AS value, round(avg(health), 6) AS health FROM v_long WHERE feature IN ('R10', 'hyst') GROUP BY ALL)) GROUP BY feature""".replace(R("rho", digits=5), "round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 5) AS rho"), **_S)  # fmt: skip
def rank_correlation(spark, sf_dir):
    cells = _health(spark, sf_dir).groupBy("cell_id").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("R10", "hyst", "SoHQ")))
    return rounded(pulses.rank_correlation(cells, ["R10", "hyst"], "SoHQ"), 5)


@query("track_lifecycle", """SELECT cell_id, cycle, observed, CASE WHEN dead THEN 'terminated' WHEN was AND miss >= 3 THEN 'coasting' WHEN was THEN 'confirmed' ELSE 'tentative' END AS state FROM (SELECT *, bool_or(hits >= 3) OVER p AS was, bool_or(miss >= 5) OVER p AS dead FROM (
  SELECT *, count(*) FILTER (NOT observed) OVER (PARTITION BY cell_id, run ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS miss FROM (SELECT *, count(*) FILTER (observed) OVER (PARTITION BY cell_id ORDER BY cycle ROWS 4 PRECEDING) AS hits, count(*) FILTER (observed) OVER (PARTITION BY cell_id ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT cell_id, cycle, n_steps >= 6 AS observed FROM v_cycle))) WINDOW p AS (PARTITION BY cell_id ORDER BY cycle ROWS UNBOUNDED PRECEDING))""")  # fmt: skip
def track_lifecycle(spark, sf_dir):
    return pulses.lifecycle(views.cycles(spark, sf_dir).select("cell_id", "cycle", (F.col("n_steps") >= 6).alias("observed")), keys=["cell_id"])


@query("noise_by_voltage", f"""SELECT cell_id, bin, count(*) AS n, {R('median')} FROM (SELECT s.*, CAST(least(5, coalesce(floor((voltage - lo) / nullif(hi - lo, 0) * 5) + 1, 1)) AS INTEGER) AS bin FROM v_samples s JOIN (SELECT cell_id, min(voltage) AS lo, max(voltage) AS hi FROM v_samples GROUP BY ALL) USING (cell_id)) GROUP BY ALL""".replace(R("median"), "round(median(inc), 6) + 0.0 AS median"))
def noise_by_voltage(spark, sf_dir):
    return pulses.noise_by_voltage(views.samples(spark, sf_dir), "inc")


@query("temperature_corrected", f"SELECT cell_id, cycle, {R('r25')} FROM (SELECT cell_id, cycle, R10 * 1000 * exp(20000 / 8.314462618 * (1 / 298.15 - 1 / (20.0 + n_steps + 273.15))) AS r25 FROM v_cycle)")
def temperature_corrected(spark, sf_dir):
    return views.cycles(spark, sf_dir).select("cell_id", "cycle", pulses.temperature_corrected(F.col("R10") * 1000, 20.0 + F.col("n_steps"), 20000.0).alias("r25"))


@query("load_window", f"""SELECT cell_id, cycle, time, row_id, CAST(floor(t) AS BIGINT) AS t, {R('voltage', 'current', 'v_ref', digits=4)} FROM (SELECT s.*, time - t0 AS t, v_ref FROM v_samples s JOIN (SELECT cell_id, cycle, arg_min(time, p) AS t0, arg_min(coalesce(ref, -1), p) AS v_ref FROM v_rested WHERE current < -1 GROUP BY ALL) USING (cell_id, cycle)) WHERE abs(t) <= 7200""".replace("cycle, time, row_id", "cycle, row_id").replace("arg_min(time, p) AS t0, arg_min(coalesce(ref, -1), p) AS v_ref", "arg_min(time, p) AS t0, nullif(arg_min(coalesce(ref, -1), p), -1) AS v_ref"),
    v_samples=views.SAMPLES, v_rested="SELECT *, last_value(CASE WHEN abs(current) <= 0.5 THEN voltage END IGNORE NULLS) OVER (PARTITION BY cell_id, cycle ORDER BY time, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref, row_number() OVER (PARTITION BY cell_id, cycle ORDER BY time, row_id) AS p FROM v_samples")
def load_window(spark, sf_dir):
    return rounded(pulses.load_window(views.samples(spark, sf_dir), 7200.0, order=ORDER).drop("time").withColumn("t", F.floor("t")), 4)


@query("block_recoveries")
def block_recoveries(spark, sf_dir):
    c = views.cycles(spark, sf_dir)
    return pulses.block_recoveries(c, segment.consecutive_blocks(c.where("n_steps = 9"), min_len=2), "dchgCapa")


@query("self_discharge")
def self_discharge(spark, sf_dir):
    """A user's month as a rest of two hours."""
    hours = views.legs(spark, sf_dir).withColumn("time", (F.col("time") - F.min("time").over(Window.partitionBy("cell_id", "leg"))) / 360)
    return curves.rest_leaks(hours, ["cell_id", "leg"], ORDER)


@query("discharge_fits")
def discharge_fits(spark, sf_dir):
    """Each supplier's years laid on its year 1995."""
    return tools.curve_fits(_monthly(spark, sf_dir), 40.0, baseline_cycle=1995, scale=0.05)
