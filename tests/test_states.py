"""Stateful streams give the rows of the batch operators, for any order of arrival within the watermark and across restarts."""

import random

import pytest
from pyspark.sql import functions as F

from galvana.operators import protocol, pulses
from galvana.streaming import states

LATE = "10 hours"


def streamed(spark, tmp_path, name, rows, schema, build, runs):
    """Feeds files one after another; ``runs`` says after how many files the query stops and starts again."""
    folder, out, check = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "check"))
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds(F.col("s") * 3600)).coalesce(1).write.mode("append").parquet(f"{folder}")
        if k + 1 in runs:
            source = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
            query = build(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(300)
            assert query.exception() is None
    return spark.read.parquet(out)


def shuffled(rows, seed, hours=8):
    """Rows in an order that no watermark of ten hours calls late, in four files; the last file moves the watermark past all."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[-1] + rng.uniform(0, hours))
    parts = [order[k * len(order) // 4 : (k + 1) * len(order) // 4] for k in range(4)]
    far = max(r[-1] for r in rows) + 1000
    return [*parts, [(-1, *rows[0][1:-2], False, far)]]


@pytest.mark.parametrize("seed", [1, 2])
def test_track_states_equal_the_batch(spark, tmp_path, seed):
    rng = random.Random(7)
    rows = [(cell, "charge", c, rng.random() < (0.9 if c % 12 < 6 else 0.1), c) for cell in range(4) for c in range(1, 41) if rng.random() < 0.9]
    schema = "cell_id int, leg string, cycle int, observed boolean, s int"
    build = lambda s: states.track_states(s, LATE, keys=["cell_id", "leg"])
    found = streamed(spark, tmp_path, "tracks", shuffled(rows, seed), schema, build, runs={2, 5})
    want = pulses.lifecycle(spark.createDataFrame(rows, schema), keys=["cell_id", "leg"])
    plain = lambda df: sorted((r["cell_id"], r["cycle"], r["state"]) for r in df.where("cell_id >= 0").collect())
    assert plain(found) == plain(want)
    assert {r[2] for r in plain(want)} == {"tentative", "confirmed", "coasting", "terminated"}


def test_protocol_states_equal_the_batch_and_drop_what_is_late(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for cell in range(3):
        for c in range(1, 41):
            rpt = c % 15 in (0, 1, 2)
            rows.append((cell, c, rpt, rpt and c % 15 == 0, not rpt and c % 15 == 14, rng.random() < 0.5, c))
    schema = "cell_id int, cycle int, rpt boolean, capacheck boolean, capa_full boolean, extra boolean, s int"
    parts = shuffled(rows, 5)
    parts.append([(0, 5, True, False, False, False, 5)])  # long settled
    found = streamed(spark, tmp_path, "kinds", parts, schema, lambda s: states.protocol_states(s, LATE), runs={3, 6})
    want = protocol.protocol_kinds(spark.createDataFrame(rows, schema))
    plain = lambda df: sorted((r["cell_id"], r["cycle"], r["protocol_kind"], r["protocol_excluded"]) for r in df.where("cell_id >= 0").collect())
    assert plain(found) == plain(want)


def test_machines_step_like_their_rules():
    m = states.TrackMachine(["k"], 3, 5, 3, 5)
    state, names = m.start, []
    for seen in (1, 1, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1):
        state, name = m.step(state, 0, (bool(seen),))
        names.append(name)
    confirmed, coasting = ["confirmed"], ["coasting"]
    assert names == ["tentative"] * 3 + confirmed * 3 + coasting + confirmed * 3 + coasting * 2 + ["terminated"] * 2
