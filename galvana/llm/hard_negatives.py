"""Hard negatives for contrastive training, by exact Kronecker-packed integer products.

Components become floor(scale * x). A block of candidates is packed: each
component, biased to be no less than zero, stands in a field of its own in one
wide integer for several candidates, fields as wide as the largest sum of products
needs, so that no field carries into the next. One multiplication for each anchor
component then serves all candidates of an integer; fields are cut out of the
sums, and the biases' share is taken off. Integers of up to 53 bits are multiplied
as doubles, which hold them exactly; where two fields need more, Python's integers
take their place, so every score is exact.

An anchor's positives are its best other rows of the same label, and the negatives
of each positive are the best rows of other labels whose scores lie between two
percentages of the positive's. Chunks of anchors meet chunks of packed blocks in
cells, once for the positives (a block holds one label and meets that label's
anchors only) and once for the negatives; a task holds one chunk of anchors and
streams blocks past it, and every cell passes on its best rows only. A label that
holds most rows is as many blocks as it takes.

Rows with a null label, a null vector or null or non-finite components take no
part, nor do rows of another length than the anchor's. A null vec_id is no anchor,
can be a positive or negative, and ranks behind every id at equal scores. Rows with
an anchor's own vec_id are the anchor's own. Repeated rows are candidates each; an
anchor row that repeats (same id, label and vector) is one anchor, and a repeated
positive is as many positives. A component beyond the range of doubles once scaled
is held at its ends, and a score beyond 64 bits at theirs. An empty table, a
negative positive score and an anchor without positives give no rows; vectors without
components score 0 with each other.

Calling these functions runs jobs: packed blocks, anchors and positives are tables
of the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galvana.llm.lsh_dedup import vectors
from galvana.shared import bounded_batches, cut

#: Rows of a block, anchors that multiply a block at once, anchors of a cell.
BLOCK_ROWS, STEP_ANCHORS, CELL_ANCHORS = 1024, 256, 8192

_MOST = np.finfo(np.float64).max
_TOP = np.iinfo(np.int64).max
_NONE = -_TOP - 1  # below every score
_DOUBLE_BITS = 53


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact ``anchors @ rows.T`` of integer-valued matrices as longs, held at the ends of 64 bits."""
    n, d = rows.shape
    if not len(anchors) or not n or not d:
        return np.zeros((len(anchors), n), np.int64)
    most = max(np.abs(anchors).max(), np.abs(rows).max())
    number = np.float64
    if 8 * d * float(most) ** 2 >= 2.0**_DOUBLE_BITS:
        exact = np.vectorize(int, otypes=[object])  # components are finite
        anchors, rows, number = exact(anchors), exact(rows), object
    low_a, low_r = anchors.min(), rows.min()
    a, r = anchors - low_a, rows - low_r
    width = max(1, (int(a.sum(axis=1).max()) * int(r.max())).bit_length())
    fields = _DOUBLE_BITS // width if number is np.float64 else 8
    words = -(-n // fields)
    padded = np.zeros((words * fields, d), number)
    padded[:n] = r
    place = np.array([number(1 << width * f) if number is np.float64 else 1 << width * f for f in range(fields)], number)
    packed = np.tensordot(padded.reshape(words, fields, d), place, ([1], [0]))  # one integer a component for ``fields`` rows
    sums = a.dot(packed.T)  # one multiplication an anchor component and integer
    out = np.empty((len(a), words, fields), number)
    if number is np.float64:
        sums = sums.astype(np.int64)
    for f in range(fields):
        out[:, :, f] = (sums >> width * f) & ((1 << width) - 1)
    out = out.reshape(len(a), -1)[:, :n]
    scores = out + low_r * a.sum(axis=1)[:, None] + low_a * r.sum(axis=1)[None, :] + d * low_a * low_r
    return np.clip(scores, -_TOP, _TOP).astype(np.int64)


def _as_bytes(rows: np.ndarray) -> tuple[int, bytes]:
    """A matrix in the narrowest type that holds it, and that type's size."""
    most = np.abs(rows).max(initial=0)
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64
    return np.dtype(kind).itemsize, rows.astype(kind).tobytes()


def _matrix(width: int, raw: bytes, d: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.float64}[width]).reshape(n, d).astype(np.float64)


_FIELDS = "kind int, key string, label string, d int, n int, width int, id long, ids binary, matrix binary, slots array<struct<score: long, id: long>>"
_SCHEMA = pa.schema([
    ("kind", pa.int32()), ("key", pa.string()), ("label", pa.string()), ("d", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("id", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary()),
    ("slots", pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())]))),
])
_NAMES = _SCHEMA.names


def _scaled(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int | None, str, np.ndarray]]:
    """Id, label and integer components of the rows that take part."""
    for x, i, label in zip(vectors(batch.column("embedding")), batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), strict=True):
        if x is not None and label is not None:
            with np.errstate(over="ignore"):
                yield i, label, np.clip(np.floor(scale * x), -_MOST, _MOST)


def _ids(ids: list) -> bytes:
    """Ids and whether each is null."""
    return np.array([[0 if i is None else i, i is None] for i in ids], np.int64).tobytes()


def _pack(scale: int):
    """Blocks of rows of one label and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        waiting = 0

        def block(key):
            rows = held.pop(key)
            width, raw = _as_bytes(np.stack([x for _, x in rows]))
            return dict(zip(_NAMES, (1, None, *key, len(rows), width, None, _ids([i for i, _ in rows]), raw, None), strict=True))

        for batch in batches:
            done = []
            for i, label, x in _scaled(batch, scale):
                key = (label, len(x))
                held.setdefault(key, []).append((i, x))
                waiting += 1
                if len(held[key]) == BLOCK_ROWS:
                    done.append(block(key))
                    waiting -= BLOCK_ROWS
            if waiting > 16 * BLOCK_ROWS:  # many labels
                done += [block(key) for key in list(held)]
                waiting = 0
            if done:
                yield pa.RecordBatch.from_pylist(done, _SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist([block(key) for key in list(held)], _SCHEMA)

    return run


def _name(scale: int):
    """Anchors, one a row, named by a digest of all that they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, label, x in _scaled(batch, scale):
                width, raw = _as_bytes(x)
                key = hashlib.blake2b(f"{i} {len(label)} {label} {width} ".encode() + raw, digest_size=16).hexdigest()
                found.append(dict(zip(_NAMES, (0, key, label, len(x), 1, width, i, _ids([i]), raw, None), strict=True)))
            if found:
                yield pa.RecordBatch.from_pylist(found, _SCHEMA)

    return run


class _Leading:
    """The best rows so far of every list of a cell; lists are numbers."""

    def __init__(self, lists: int, k: int) -> None:
        self.k = k
        self.floor = np.full(lists, _NONE)  # the k-th score, once there is one
        self.rows = np.zeros((0, 4), np.int64)  # list, score, id is null, id

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in rows; ids hold ids and whether they are null."""
        new = np.column_stack([lists, scores, ids[:, 1], ids[:, 0]])
        rows = np.concatenate([self.rows, new])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], ~rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.r_[True, np.diff(rows[:, 0]) != 0])
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        last = place == self.k - 1
        self.floor[rows[last, 0]] = rows[last, 1]
        self.rows = rows[place < self.k]


def _leading_of(scores: np.ndarray, fits: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all scores that fit and reach both the floor and their row's k-th; ties all."""
    held = np.where(fits, scores, _NONE)
    if held.shape[1] > k:
        floor = np.maximum(floor, np.partition(held, held.shape[1] - k, axis=1)[:, -k])
    return np.nonzero(fits & (held >= floor[:, None]))


def _percent(scores: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """Scores' percentage, rounded up or down, without leaving 64 bits (percent is 100 at most)."""
    whole, rest = np.divmod(scores, 100)
    return percent * whole + (-((-percent * rest) // 100) if up else (percent * rest) // 100)


class _Cell:
    """One chunk of anchors, and the blocks that pass it."""

    def __init__(self, k: int, low: int | None, high: int | None) -> None:
        self.k, self.low, self.high = k, low, high
        self.anchors: dict[int, list[dict]] = {}
        self.held: dict[tuple, list] = {}
        self.best: dict[int, _Leading] = {}
        self.packed: dict[int, tuple] = {}

    def _ready(self, d: int) -> tuple:
        if d not in self.packed:
            rows = self.anchors[d]
            matrix = np.concatenate([_matrix(r["width"], r["matrix"], d, 1) for r in rows])
            ids = np.concatenate([np.frombuffer(r["ids"], np.int64).reshape(-1, 2) for r in rows])
            labels: dict[str, list[int]] = {}
            for j, r in enumerate(rows):
                labels.setdefault(r["label"], []).append(j)
            slots = max((len(r["slots"] or ()) for r in rows), default=0)
            score = np.full((len(rows), slots), -1)  # no negative lies between shares of a negative score
            for j, r in enumerate(rows):
                for s, x in enumerate(r["slots"] or ()):
                    score[j, s] = x["score"]
            self.packed[d] = matrix, ids, {x: np.array(v) for x, v in labels.items()}, score
            self.best[d] = _Leading(len(rows) * max(1, slots), self.k)
        return self.packed[d]

    def block(self, row: dict) -> None:
        d, label = row["d"], row["label"]
        if d not in self.anchors:
            return
        held = self.held.setdefault((label, d), [])
        held.append(row)
        if sum(x["n"] for x in held) >= BLOCK_ROWS or sum(map(len, self.held.values())) > 4096:
            self.flush(None if sum(x["n"] for x in held) < BLOCK_ROWS else (label, d))

    def flush(self, only: tuple | None = None) -> None:
        for label, d in [only] if only else list(self.held):
            rows = self.held.pop((label, d))
            matrix = np.concatenate([_matrix(x["width"], x["matrix"], d, x["n"]) for x in rows])
            ids = np.concatenate([np.frombuffer(x["ids"], np.int64).reshape(-1, 2) for x in rows])
            self._score(label, d, matrix, ids)

    def _score(self, label: str, d: int, matrix: np.ndarray, ids: np.ndarray) -> None:
        own_matrix, own_ids, labels, score = self._ready(d)
        best = self.best[d]
        same = labels.get(label, np.zeros(0, np.int64))
        meets = same if self.low is None else np.setdiff1d(np.arange(len(own_ids)), same)
        for a in range(0, len(meets), STEP_ANCHORS):
            some = meets[a : a + STEP_ANCHORS]
            scores = packed_products(own_matrix[some], matrix)
            other = (ids[:, 0] != own_ids[some, 0][:, None]) | (ids[:, 1] != 0)
            if self.low is None:
                i, j = _leading_of(scores, other, self.k, best.floor[some])
                best.add(some[i], scores[i, j], ids[j])
                continue
            for s in range(score.shape[1]):
                own = score[some, s]
                fits = other & (scores >= _percent(own, self.low, True)[:, None]) & (scores <= _percent(own, self.high, False)[:, None])
                lists = some * score.shape[1] + s
                i, j = _leading_of(scores, fits, self.k, best.floor[lists])
                if len(i):
                    best.add(lists[i], scores[i, j], ids[j])

    def found(self) -> Iterator[pa.RecordBatch]:
        self.flush()
        for d, best in self.best.items():
            slots = max(1, self.packed[d][3].shape[1])
            anchor, slot = np.divmod(best.rows[:, 0], slots)
            keys = [self.anchors[d][j]["key"] for j in anchor.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(slot, pa.int32()), pa.array(best.rows[:, 1], pa.int64()), pa.array(best.rows[:, 3], pa.int64(), mask=best.rows[:, 2] != 0)],
                names=["key", "slot", "score", "id"],
            )


def _meet(anchors: DataFrame, blocks: DataFrame, k: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """``key, slot, score, id`` of the k best rows of each anchor's label, or of the k best others within each slot's percentages."""
    spark = anchors.sparkSession
    wanted = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    across = max(1, -(-anchors.count() // CELL_ANCHORS))
    down = max(1, -(-wanted // across))
    n_cells = across * down
    a, b = F.pmod(F.xxhash64("key"), F.lit(across)), F.pmod(F.xxhash64("ids", "matrix"), F.lit(down))
    left = anchors.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda x: a * F.lit(down) + x)))
    right = blocks.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda x: x * F.lit(down) + b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    if row["cell"] != at:
                        if cell:
                            yield from cell.found()
                        at, cell = row["cell"], _Cell(k, low, high)
                    if row["kind"] == 0:
                        cell.anchors.setdefault(row["d"], []).append(row)
                    else:
                        cell.block(row)
        if cell:
            yield from cell.found()

    dealt = left.unionByName(right).repartition(n_cells, "cell").sortWithinPartitions("cell", "kind")
    found = dealt.mapInArrow(run, "key string, slot int, score long, id long")
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors among ``rows`` (vec_id, embedding, label).

    ``anchors`` is the condition of anchors; ``low`` and ``high`` are whole percentages
    of the positive's score, 100 at most.
    """
    bounded_batches(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    blocks = cut(rows.mapInArrow(_pack(scale), _FIELDS), "packed")
    asked = cut(rows.where(anchors & F.col("vec_id").isNotNull()).mapInArrow(_name(scale), _FIELDS).dropDuplicates(["key"]), "anchors")
    found = cut(_meet(asked, blocks, positives).select("key", F.struct((F.col("rank") - 1).alias("slot"), "score", "id").alias("slot")), "positives")
    slots = found.groupBy("key").agg(F.array_sort(F.collect_list("slot")).alias("own"))
    ready = asked.join(slots, "key").withColumn("slots", F.transform("own", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id")))).select(_NAMES)
    ready = cut(ready, "slots")
    chosen = _meet(ready, blocks, negatives, low, high).select("key", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    own = ready.select("key", F.col("id").alias("anchor_id"), F.posexplode("slots").alias("slot", "own"))
    return own.join(chosen, ["key", "slot"]).select("anchor_id", F.col("own.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("own.score").alias("positive_score"), "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors of ``embeddings``, some of whose labels are moved first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id AND len(a.e) = len(r.e)),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""
