"""Conversation repair: cheapest edits to a legal order of roles, by an auction shortest-path algorithm.

A conversation's rows stand by turn (nulls first), role and a hash of role and
text. Each row has one fault at most: blank (nothing but white space), duplicate
(role and text seen earlier in the conversation), or truncated (its last character
that is no white space isn't ``.``, ``!`` or ``?``). Edits give a sequence of role
initials ``(s?(ua)+)?``: Keep costs 0; Rerole, to user or assistant, 3; Delete 4, and
blank and duplicate rows must go; Insert, an empty user or assistant turn anywhere,
3; a truncated row that stays adds 3.

The rows and the states of that sequence are a lattice with integer costs. The
auction keeps a price at every node and one path: its last node's price rises to
the least cost-plus-price of its arcs and the path contracts, or else the path
extends by that arc, until it arrives. Prices begin at what the rows after a node
cost at least. Once the prices have converged, every cheapest path holds tight arcs
alone (price = cost + next price), and of these the trace takes the least letter
that still arrives: edits' initials D < I < K < R. A long conversation is cut into
segments; the prices at which a segment's four states begin are the final costs of
the segment before it, so the parts' cheapest paths are the whole's.

Two streams pass each conversation through one task in order: compact rows
(initials, faults, hashes) give the audit, a byte a row; texts then meet their
conversation's audit and go through one running SHA-256. Texts are never held, so
memory follows the number of a conversation's rows, not its texts.

Nulls: a null role or text is one space. Rows of a null conv_id are one
conversation, apart from an empty id's. A role that begins with none of s, u, a (an
empty one too) fits nowhere and must be reroled or go. Repeated rows are
duplicates. A conversation without rows has zeros, an empty audit and the hash of
an empty text; an empty table has no result rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galvana.shared import bounded_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a segment of the lattice.
SEGMENT = 32

#: States of the sequence: nothing yet, after s, after u, after a.
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What a written role (user or assistant) leads to, and the edits and costs that end a conversation.
_WRITTEN = (2, 2, 3, 2)
_ENDS, _END_COSTS = ("", "II", "I", ""), (0, 2 * INSERT, INSERT, 0)
_ROLES = {2: b"user", 3: b"assistant"}
#: A row's code: the place of its initial, and whether it must go, and whether it is truncated.
_INITIALS, _GOES, _CUT = "?sua", 4, 8


def _row_arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the letter, cost and next state of every edit of a row."""
    arcs = []
    for state in range(4):
        own = [("D", DELETE, state)]
        if not code & _GOES:
            more = TRUNCATED if code & _CUT else 0
            after = _AFTER.get((state, _INITIALS[code & 3]))
            if after is not None:
                own.append(("K", KEEP + more, after))
            own.append(("R", REROLE + more, _WRITTEN[state]))
        arcs.append(own)
    return arcs


_ARCS = [_row_arcs(code) for code in range(16)]
#: The least that a row costs.
_LEAST = [DELETE if code & _GOES else min(DELETE, TRUNCATED if code & _CUT else KEEP) for code in range(16)]


def _arcs(codes: bytes, node: int) -> list[tuple[str, int, int]]:
    """Letter, cost and head of every arc that leaves a node (4 * row + state); none at the end."""
    row, state = divmod(node, 4)
    if row == len(codes):
        return []
    below = 4 * (row + 1)
    return [("I", INSERT, 4 * row + _WRITTEN[state]), *((letter, cost, below + after) for letter, cost, after in _ARCS[codes[row]][state])]


def auction(codes: bytes, ends: tuple[int, ...], entries: tuple[int, ...]) -> list[int]:
    """Prices of a segment's nodes, converged for paths from the entries to the end; ``ends`` are the costs from there on."""
    prices = [0] * (4 * len(codes)) + list(ends)
    floor = min(ends)
    for row in range(len(codes) - 1, -1, -1):
        floor += _LEAST[codes[row]]
        prices[4 * row : 4 * row + 4] = [floor] * 4
    last = 4 * len(codes)
    for entry in entries:
        path = [entry]
        while path[-1] < last:
            node = path[-1]
            least, head = min((cost + prices[head], head) for _, cost, head in _arcs(codes, node))
            if prices[node] < least:  # the price rises, and the path contracts
                prices[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
    return prices


def trace(codes: bytes, prices: list[int], entry: int) -> tuple[str, int]:
    """The least letters of tight arcs from an entry to the end of a segment, and the state there."""
    last = 4 * len(codes)
    arrives = [False] * last + [True] * 4
    for row in range(len(codes) - 1, -1, -1):
        for _ in range(3):  # insertions stay in a row
            for node in range(4 * row, 4 * row + 4):
                arrives[node] |= any(arrives[head] and prices[node] == cost + prices[head] for _, cost, head in _arcs(codes, node))
    letters, node = [], entry
    while node < last:
        letter, node = min((letter, head) for letter, cost, head in _arcs(codes, node) if arrives[head] and prices[node] == cost + prices[head])
        letters.append(letter)
    return "".join(letters), node - last


def _cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    parts = [codes[a : a + SEGMENT] for a in range(0, len(codes), SEGMENT)]
    ends = [_END_COSTS]
    for part in reversed(parts[1:]):
        least = min(ends[-1])
        prices = auction(part, tuple(x - least for x in ends[-1]), (0, 1, 2, 3))
        ends.append(tuple(x + least for x in prices[:4]))
    state, audit, cost = 0, [], 0
    for k, part in enumerate(parts):
        after = ends[-1 - k]
        least = min(after)
        prices = auction(part, tuple(x - least for x in after), (state,))
        if not k:
            cost = prices[state] + least
        letters, state = trace(part, prices, state)
        audit.append(letters)
    return cost, "".join(audit) + _ENDS[state]


_short = lru_cache(1 << 16)(_cheapest)


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and edits' initials of a conversation of coded rows; short ones are remembered."""
    return _short(codes) if len(codes) <= SEGMENT else _cheapest(codes)


_FOUND = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation out of its rows in order."""
    at, own = None, None

    def close():
        cost, audit = cheapest_edits(bytes(own["codes"]))
        gaps = own["high"] - own["low"] + 1 - own["turns"] if own["turns"] else 0
        return [at, own["conv_id"], gaps, own[0], own[1], own[2], own["illegal"], cost, audit]

    def packed(rows, kind):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kind, strict=True)], names=["key", *_FOUND])

    for batch in batches:
        done = []
        kind = [pa.string(), batch.column("conv_id").type, *[pa.int64()] * 6, pa.string()]
        for key, conv_id, turn, initial, present, blank, repeat, cut in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "turn", "initial", "present", "blank", "repeat", "cut")), strict=True):
            if key != at or own is None:
                if own is not None:
                    done.append(close())
                at, own = key, {"conv_id": conv_id, "codes": bytearray(), "low": None, "high": None, "turns": 0, 0: 0, 1: 0, 2: 0, "illegal": 0}
            if not present:
                continue
            if turn is not None and turn != own["high"]:
                own["low"] = turn if own["low"] is None else own["low"]
                own["high"], own["turns"] = turn, own["turns"] + 1
            fault = 0 if blank else 1 if repeat else 2 if cut else None
            if fault is not None:
                own[fault] += 1
            code = max(0, _INITIALS.find(initial)) if initial else 0
            if own["codes"] and (_INITIALS[own["codes"][-1] & 3], _INITIALS[code]) not in {("s", "u"), ("u", "a"), ("a", "u")}:
                own["illegal"] += 1
            own["codes"].append(code | (_GOES if blank or repeat else _CUT if cut else 0))
        if done:
            yield packed(done, kind)
    if own is not None:
        yield packed([close()], kind)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit row with the hash of its repaired turns; the audit row comes before the turns."""
    running = None

    def write(role: bytes, text: bytes) -> None:
        nonlocal first
        running.update((b"" if first else b"\n") + role + b":" + text)
        first = False

    def inserts() -> None:
        nonlocal place, state
        while place < len(audit) and audit[place] == "I":
            state = _WRITTEN[state]
            write(_ROLES[state], b"")
            place += 1

    for batch in batches:
        done = []
        texts, roles = (batch.column(c).cast(pa.binary()) for c in ("text", "role"))
        kept = pa.RecordBatch.from_arrays([batch.column(c) for c in _FOUND], names=_FOUND)
        for k, edits in enumerate(batch.column("audit").to_pylist()):
            if edits is not None:
                if running is not None:
                    inserts()
                    done.append(own | {"repaired_sha256": running.hexdigest()})
                own, audit, place, state, first, running = kept.slice(k, 1).to_pylist()[0], edits, 0, 0, True, hashlib.sha256()
                continue
            inserts()
            edit, place = audit[place], place + 1
            if edit == "K":
                role = roles[k].as_py()
                state = _AFTER[state, chr(role[0])]
                write(role, texts[k].as_py())
            elif edit == "R":
                state = _WRITTEN[state]
                write(_ROLES[state], texts[k].as_py())
        schema = pa.schema([*kept.schema, ("repaired_sha256", pa.string())])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if running is not None:
        inserts()
        yield pa.RecordBatch.from_pylist([own | {"repaired_sha256": running.hexdigest()}], schema)


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("h"), F.asc("g")]


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row for each conv_id of ``turns`` (conv_id, turn, role, text): faults, ``cost``, ``audit`` and ``repaired_sha256``.

    Where ``present`` is false, a row only names its conversation.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    ).withColumns({"h": F.xxhash64("role", "text"), "g": F.xxhash64(F.lit(1), "role", "text")})
    ending = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    small = rows.select(
        "key", "conv_id", "turn", "role", "h", "g", "present", F.substring("role", 1, 1).alias("initial"), (ending == "").alias("blank"), (~F.right(ending, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    seen = Window.partitionBy("key", "present", "h", "g").orderBy(F.asc_nulls_first("turn"))
    small = small.withColumn("repeat", F.row_number().over(seen) > 1)
    kind = turns.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    found = small.repartition(n, "key").sortWithinPartitions("key", *_order(), "repeat").drop("role", "h", "g").mapInArrow(_audits, f"key string, conv_id {kind}, {counts}, audit string")
    none = F.lit(None)
    heads = found.withColumns({"part": F.lit(0), "turn": none.cast("long"), "role": F.lit(""), "text": F.lit(""), "h": none.cast("long"), "g": none.cast("long")})
    bodies = rows.where("present").select("key", F.lit(1).alias("part"), "turn", "role", "text", "h", "g")
    dealt = heads.unionByName(bodies, allowMissingColumns=True).repartition(n, "key").sortWithinPartitions("key", "part", *_order())
    return dealt.select(*_FOUND, "role", "text").mapInArrow(_hashes, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, told by crc32 of ``conv_id:turn`` modulo 20; ``present`` is false where one is dropped."""
    turns = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    turns = turns.withColumn("_fault", F.crc32(key) % 20)
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return turns.select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("_fault") != 0).alias("present"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged and repaired."""
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), F.col("present"))


def _sql() -> str:
    """The same edits as a dynamic program: for each state a text of nine digits of cost and the letters so far."""

    def step(s: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST({s}[:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {s}[10:] || '{letter}'"

    def kept(s: str, letter: str) -> str:
        return f"CASE WHEN NOT goes AND initial = '{letter}' THEN {step(s, 'more', 'K')} END"

    def written(s: str) -> str:
        return f"CASE WHEN NOT goes THEN {step(s, '3 + more', 'R')} END"

    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: xor(c >> 1, (c & 1) * 3988292384))"
    return f"""
WITH RECURSIVE crc AS (SELECT {table} AS t),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(2) copies(n) WHERE fault <> 0 AND (n = 0 OR fault = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ending, role[1] AS initial FROM damaged),
faulty AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN ending[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
coded AS (SELECT conv_id, place, n, initial, fault IN ('blank', 'duplicate') AS goes, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM faulty),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS place, n, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000000003I' AS s2, '000000006II' AS s3 FROM coded
  UNION ALL
  SELECT conv_id, place, n, n0, n1, c2, least(n3, {step('c2', '3', 'I')}) FROM (
    SELECT *, least(n2, {step('n0', '3', 'I')}, {step('n1', '3', 'I')}, {step('n3', '3', 'I')}) AS c2 FROM (
      SELECT w.conv_id, c.place, w.n, {step('s0', '4', 'D')} AS n0,
             least({step('s1', '4', 'D')}, {kept('s0', 's')}) AS n1,
             least({step('s2', '4', 'D')}, {kept('s0', 'u')}, {kept('s1', 'u')}, {kept('s3', 'u')}, {written('s0')}, {written('s1')}, {written('s3')}) AS n2,
             least({step('s3', '4', 'D')}, {kept('s2', 'a')}, {written('s2')}) AS n3
      FROM walk w JOIN coded c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.place = w.place + 1))),
final AS (SELECT conv_id, least(s0, s3) AS best FROM walk WHERE place = n),
edits AS (
  SELECT conv_id, i, best[9 + i] AS edit, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS place,
         count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS stays
  FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS i FROM final)),
turned AS (
  SELECT e.conv_id, e.i, e.edit, CASE WHEN e.edit = 'I' THEN '' ELSE p.text END AS text, CASE WHEN e.edit = 'K' THEN p.role END AS role,
         e.stays - CASE WHEN max(CASE WHEN e.edit = 'K' AND e.stays = 1 AND p.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) = 1 THEN 1 ELSE 0 END AS seat
  FROM edits e LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND p.place = e.place AND e.edit <> 'I'),
repaired AS (
  SELECT conv_id, sha256(coalesce(string_agg(coalesce(role, CASE seat % 2 WHEN 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY i) FILTER (edit <> 'D'), '')) AS hash FROM turned GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
named AS (SELECT DISTINCT conv_id FROM conversations)
SELECT n.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(CAST(f.best[:9] AS BIGINT), 0) AS cost,
       coalesce(f.best[10:], '') AS audit, coalesce(r.hash, sha256('')) AS repaired_sha256
FROM named n LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM n.conv_id
"""


OP11_SQL = _sql()
