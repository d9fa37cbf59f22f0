"""State machines over streams: tracks of peaks, and protocol kinds of cycles. An addition to the batch operators.

Rows of a key come in any order. Each waits in the key's state, told by its cycle,
until the watermark passes its time; an event timer then takes what has become due
in order of cycles through the machine. So for any order of arrival within the
watermark the rows out are those of the batch operators (``pulses.lifecycle``,
``protocol.protocol_kinds``), and a query that ends goes on from its checkpoint.

Times must not fall while cycles rise. Rows later than the watermark are dropped by
Spark, and so are rows of a cycle that is settled; of a cycle that comes again before
it is settled the last arrival counts. Rows without a cycle or time are left out.
State is one row for each waiting cycle and one for the machine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from galvana.operators.protocol import POST_RPT_EXCLUDE

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_typed_state(spark: SparkSession) -> None:
    """Typed state lives in RocksDB; call before a query with it starts."""
    spark.conf.set(_PROVIDER, _ROCKS)


class InOrder(StatefulProcessor):
    """Keeps rows until they are due and steps through them by cycle."""

    #: Columns that a row brings, the machine's state, its beginning, and the column that comes out.
    fields: tuple[str, ...]
    field_types: str
    machine_types: str
    start: tuple
    out: str

    def __init__(self, keys: Sequence[str]) -> None:
        self.keys = list(keys)

    def step(self, state: tuple, cycle: int, row: tuple) -> tuple[tuple, object]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "cycle long", f"{self.field_types}, ms long")
        self.machine = handle.getValueState("machine", f"{self.machine_types}, settled long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        settled = self.machine.get()[-1] if self.machine.exists() else None
        for pdf in rows:
            for cycle, ms, *own in pdf[["cycle", "at_ms", *self.fields]].itertuples(index=False, name=None):
                if settled is None or cycle > settled:
                    self.waiting.updateValue((int(cycle),), (*(bool(x) for x in own), int(ms)))
                    self.handle.registerTimer(int(ms))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted((k[0], tuple(v)) for k, v in self.waiting.iterator() if v[-1] <= now)
        if not due:
            return
        *state, _ = self.machine.get() if self.machine.exists() else (*self.start, None)
        found = []
        for cycle, row in due:
            state, value = self.step(tuple(state), cycle, row[:-1])
            found.append((*key, cycle, value))
            self.waiting.removeKey((cycle,))
        self.machine.update((*state, due[-1][0]))
        yield pd.DataFrame(found, columns=[*self.keys, "cycle", self.out])

    def close(self) -> None:
        pass


class TrackMachine(InOrder):
    """Tentative, confirmed, coasting, terminated: the rules of ``pulses.lifecycle``."""

    fields, field_types, machine_types, out = ("observed",), "observed boolean", "recent string, misses int, was boolean, dead boolean", "state"
    start = ("", 0, False, False)

    def __init__(self, keys: Sequence[str], confirm: int, of: int, coast: int, end: int) -> None:
        super().__init__(keys)
        self.confirm, self.of, self.coast, self.end = confirm, of, coast, end

    def step(self, state, cycle, row):
        recent, misses, was, dead = state
        seen = row[0]
        recent = (recent + ("1" if seen else "0"))[-self.of :]
        misses = 0 if seen else misses + 1
        was, dead = was or recent.count("1") >= self.confirm, dead or misses >= self.end
        name = "terminated" if dead else "tentative" if not was else "coasting" if misses >= self.coast else "confirmed"
        return (recent, misses, was, dead), name


class ProtocolMachine(InOrder):
    """Kinds of cycles: the rules of ``protocol.protocol_kinds``."""

    fields, field_types, machine_types, out = ("rpt", "capacheck", "capa_full"), "rpt boolean, capacheck boolean, capa_full boolean", "last_test long", "protocol_kind"
    start = (None,)

    def __init__(self, keys: Sequence[str], post: int) -> None:
        super().__init__(keys)
        self.post = post

    def step(self, state, cycle, row):
        (last,), (rpt, capacheck, capa_full) = state, row
        after = last is not None and cycle - last <= self.post
        name = "capacheck" if capacheck else "rpt" if rpt else "capa_full" if capa_full else "post_rpt" if after else "routine"
        return (cycle if rpt else last,), name


def _run(rows: DataFrame, machine: InOrder, late: str) -> DataFrame:
    use_typed_state(rows.sparkSession)
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in machine.keys), "cycle long", f"{machine.out} string"])
    known = rows.where("cycle is not null and ts is not null").withWatermark("ts", late)
    chosen = known.select(*machine.keys, F.col("cycle").cast("long").alias("cycle"), "ts", F.unix_millis("ts").alias("at_ms"), *(F.coalesce(c, F.lit(False)).alias(c) for c in machine.fields))
    return chosen.groupBy(*machine.keys).transformWithStateInPandas(statefulProcessor=machine, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def track_states(seen: DataFrame, late: str = "1 hour", confirm: int = 3, of: int = 5, coast: int = 3, end: int = 5, keys: Sequence[str] = ("cell_id", "leg", "track")) -> DataFrame:
    """``keys, cycle, state`` of each track's cycles (keys, cycle, ts, observed), once the watermark has passed them."""
    return _run(seen, TrackMachine(keys, confirm, of, coast, end), late)


def protocol_states(flags: DataFrame, late: str = "1 hour", post: int = POST_RPT_EXCLUDE, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """``keys, cycle, protocol_kind, protocol_excluded`` of each cell's cycles (keys, cycle, ts, rpt, capacheck, capa_full)."""
    return _run(flags, ProtocolMachine(keys, post), late).withColumn("protocol_excluded", F.col("protocol_kind") != "routine")
