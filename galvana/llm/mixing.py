"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target, a number of words; a document of the source is taken
target / source_size times in expectation. The whole part of that is sure. The
fraction is a probability, and two documents settle theirs against each other:
words move from one to the other, in a direction drawn so that neither's
expectation changes, until one probability is 0 or 1. What remains of the other
meets the next. A source's taken words so miss its target by one document at
most.

Documents pair within buckets of bounded length, each bucket hands one remainder
to the next level, and levels shrink by the bucket length until each source has
one remainder, which a last draw settles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galvana.llm.vectext import U64, mix
from galvana.shared import cut

#: Documents that a task pairs in one group.
BUCKET = 256
#: Source names and their sizes come to the driver; a table of more sources is refused.
MOST_SOURCES = 1_000_000


def targets(sizes: dict[str | None, int], weights: Sequence[float], share: float = 1.0, most: float = 3.0) -> dict[str | None, float]:
    """Words to take of each source.

    Sources in code point order, null last, get the weights in turn. A target
    stops at ``most`` times the source's size, and what exceeds it goes to the
    other sources by weight until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] > most * sizes[s] * total]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def settle(part: np.ndarray, size: np.ndarray, draw: np.ndarray, last: bool) -> np.ndarray:
    """Probabilities after pairing in the given order; all but one are 0 or 1, with ``last`` all are."""
    out = part.copy()
    held = -1
    for k in range(len(part)):
        if not 0 < out[k] < 1:
            continue
        if held < 0:
            held = k
            continue
        a, b = size[held], size[k]
        up = min((1 - out[held]) * a, out[k] * b)  # words that can move to the one held
        down = min(out[held] * a, (1 - out[k]) * b)
        if draw[k] * (up + down) < down:
            full, empty = up == (1 - out[held]) * a, up == out[k] * b
            p, q = out[held] + up / a, out[k] - up / b
            out[held], out[k] = 1.0 if full else p, 0.0 if empty else q
        else:
            empty, full = down == out[held] * a, down == (1 - out[k]) * b
            p, q = out[held] - down / a, out[k] + down / b
            out[held], out[k] = 0.0 if empty else p, 1.0 if full else q
        # Rounding can leave a hair; it is settled.
        for j in (held, k):
            out[j] = 0.0 if out[j] < 1e-12 else 1.0 if out[j] > 1 - 1e-12 else out[j]
        held = k if 0 < out[k] < 1 else held if 0 < out[held] < 1 else -1
    if last and held >= 0:
        out[held] = float(draw[held] < out[held])
    return out


def _draws(key: np.ndarray, level: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for each key, the same whenever the level is rounded again."""
    h = mix(mix(key.astype(np.int64).view(U64) + U64(seed)) + U64(level))
    return (h >> U64(11)).astype(np.float64) / 2.0**53


_ROW = "doc_id long, source string, size long, key long, whole long, part double, settled boolean"


def _pair(level: int, last: bool, seed: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.select(["doc_id", "source", "size", "key", "whole", "part"])
        group = group.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        key = group["key"].to_numpy()
        # Long documents first, so that what remains is rather a short one.
        order = np.lexsort((_draws(key, 2 * level, seed), -group["size"].to_numpy()))
        part, size = group["part"].to_numpy()[order], group["size"].to_numpy()[order].astype(np.float64)
        done = settle(part, size, _draws(key[order], 2 * level + 1, seed), last)
        table = group.take(pa.array(order)).set_column(5, "part", pa.array(done))
        return table.append_column("settled", pa.array((done == 0) | (done == 1)))

    return run


def _longest(rows: DataFrame) -> int:
    """Rows of the source that has the most."""
    return rows.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def round_copies(rows: DataFrame, seed: int = 1, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, source, size, copies`` from ``doc_id, source, size, share``: whole numbers near the shares.

    Rows differ in their first three columns; ``share`` is the expected number of
    copies. Rows of size 0 hold no words and get the whole part of their share.
    """
    part = F.when(F.col("size") > 0, F.col("share") - F.floor("share")).otherwise(F.lit(0.0))
    start = rows.select("doc_id", "source", "size", F.xxhash64("doc_id", "source", "size").alias("key"), F.floor("share").cast("long").alias("whole"), part.alias("part"))
    same = ["doc_id", "source", "size"]
    result = start.where("part = 0").select(*same, F.col("whole").alias("copies"))
    now, level = start.where("part > 0"), 0
    longest = _longest(now)
    while longest:
        last = longest <= bucket
        # A source's lanes follow from its own length, so all hold about as many rows.
        sizes = now.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_n"))
        lanes = F.lit(1) if last else F.ceil(F.col("_n") / F.lit(bucket))
        dealt = now.join(F.broadcast(sizes), F.col("source").eqNullSafe(F.col("_source"))).withColumn("lane", F.pmod(F.xxhash64("key", F.lit(level)), lanes))
        done = cut(dealt.groupBy("source", "lane").applyInArrow(_pair(level, last, seed), _ROW), f"rounded{level}")
        result = result.unionByName(done.where("settled").select(*same, (F.col("whole") + F.col("part").cast("long")).alias("copies")))
        now, level = done.where("not settled").drop("settled"), level + 1
        longest = 0 if last else _longest(now)
    return result


_WORDS = r"[^\x20\x09-\x0D]+"


def _measured(docs: DataFrame) -> list:
    """Columns that tell rows apart: id, source and words."""
    words = F.coalesce(F.regexp_count(docs["text"], F.lit(_WORDS)), F.lit(0)).cast("long")
    return [docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), words.alias("size")]


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 1) -> DataFrame:
    """``doc_id, source, size, source_size, target, rows, copies`` for every distinct document of ``docs`` (doc_id, source, text).

    A document is a doc_id, source and size; ``rows`` counts its rows, and
    ``copies`` how often the mix takes them all together. A null text has size 0.
    An empty table has no rows. The result follows from ids, sources and sizes
    alone, so reruns agree.
    """
    rows = cut(docs.select(*_measured(docs)).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r["source"]: int(r["size"]) for r in found}
    wanted = targets(sizes, weights, share, most)
    plan = docs.sparkSession.createDataFrame(
        [(s, n, float(wanted[s]), float(wanted[s]) / n if n else 0.0) for s, n in sizes.items()],
        "_source string, source_size long, target double, share double",
    )
    joined = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    copies = round_copies(joined.select("doc_id", "source", "size", (F.col("share") * F.col("rows")).alias("share")), seed)
    other = copies.select(*(F.col(c).alias(f"_{c}") for c in copies.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "source", "size")]
    return joined.join(other, same).select("doc_id", "source", "size", "source_size", "target", "rows", F.col("_copies").alias("copies"))


def _each_row(number, rows, copies):
    """Copies of one of a document's rows: they differ by one at most."""
    return F.floor(copies / rows) + F.when(number <= copies % rows, F.lit(1)).otherwise(F.lit(0))


def take_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``mix_sources`` takes them, with the columns of ``docs``."""
    columns = docs.columns
    marked = docs.select(F.struct(*(docs[c] for c in columns)).alias("_row"), *(c.alias(f"_{n}") for c, n in zip(_measured(docs), ("id", "source", "size"), strict=True)))
    wanted = mixed.where("copies > 0").select("doc_id", "source", "size", "rows", "copies")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("_id", "doc_id"), ("_source", "source"), ("_size", "size"))]
    joined = marked.join(wanted, same).select("_row", "_id", "_source", "_size", "rows", "copies")
    if mixed.where("rows > 1").isEmpty():
        taken = joined
    else:  # rows that repeat share their copies out
        number = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.xxhash64("_row")))
        taken = joined.select("_row", _each_row(number, F.col("rows"), F.col("copies")).cast("long").alias("copies")).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed by weights 5, 2, 1 in turn to 100% of their words."""
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    each = mixed.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    copies = _each_row(F.col("number"), F.col("rows"), F.col("copies")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies"))
