"""Near-duplicate vectors: random-hyperplane tables, exact cosines, connected components.

Each table gives a vector the signs of its products with random hyperplanes, and
vectors of equal label and signs share a bucket. Bits follow from the number of
vectors, tables from the bits and the recall asked for. Equal vectors form one
class from the start. Within buckets, the signs of all tables together split off
what is clearly below the cosine; what remains hangs together in clusters, and
all pairs of a cluster are verified by their exact cosine in double precision,
in pairs of blocks. So vectors move once for each cluster, not for each table.

A vector that is null or zero, or that holds null or non-finite components, and
one without a label, links with nothing. Vectors of unlike length don't link.
Rows that repeat are copies and link with each other, whatever their ids. The
result has a row for each row of the input; null ids are kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvana.llm.blocks import block_pairs
from galvana.llm.components import components, linked_classes
from galvana.llm.ngram_join import _meets, roots
from galvana.shared import bounded_batches, cut


@dataclass(frozen=True)
class Plan:
    bits: int
    tables: int
    cosine: float
    seed: int = 7

    @classmethod
    def of(cls, rows: int, cosine: float = 0.98, recall: float = 0.99999) -> Plan:
        """About a bucket for every 64 vectors of one label, and tables enough for the recall.

        Two vectors at the cosine agree in a sign with probability 1 - angle / pi.
        """
        bits = min(31, max(8, math.ceil(math.log2(max(rows, 1))) - 6))
        agree = (1 - math.acos(cosine) / math.pi) ** bits
        return cls(bits, math.ceil(math.log(1 - recall) / math.log1p(-agree)), cosine)

    @property
    def likely(self) -> float:
        """Share of equal signs from which a pair is verified: 5 standard deviations below that at the cosine."""
        agree = 1 - math.acos(self.cosine) / math.pi
        return agree - 5 * math.sqrt(agree * (1 - agree) / (self.bits * self.tables))

    def planes(self, dimension: int) -> np.ndarray:
        return np.random.default_rng([self.seed, dimension]).standard_normal((dimension, self.bits * self.tables))


def vectors(column: pa.Array) -> tuple[list[np.ndarray | None]]:
    """Float64 vectors of an Arrow column of lists; None where null or with null or non-finite components."""
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    null = column.is_null().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for a, b, missing in zip((ends - sizes).tolist(), ends.tolist(), null.tolist(), strict=True):
        x = values[a:b]
        out.append(None if missing or not np.isfinite(x).all() else x)
    return out


def _signed(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            found, labels = vectors(batch.column("embedding")), batch.column("label").to_pylist()
            keys, units, signs = [None] * len(found), [None] * len(found), [None] * len(found)
            by_length: dict[int, list[int]] = {}
            for k, (x, label) in enumerate(zip(found, labels, strict=True)):
                if x is not None and label is not None and x.any():
                    by_length.setdefault(len(x), []).append(k)
            for d, rows in by_length.items():
                if d not in planes:
                    planes[d] = plan.planes(d)
                block = np.stack([found[k] for k in rows]) + 0.0
                scaled = block / np.abs(block).max(axis=1, keepdims=True)
                unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
                bits = (unit @ planes[d] > 0).reshape(len(rows), plan.tables, plan.bits)
                sign = (bits @ (1 << np.arange(plan.bits, dtype=np.int64))).astype(np.int32)
                for j, k in enumerate(rows):
                    keys[k] = hashlib.blake2b(repr(labels[k]).encode() + b"/" + block[j].tobytes(), digest_size=16).digest()
                    units[k], signs[k] = unit[j].tobytes(), sign[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(units, pa.binary()), pa.array(signs, pa.binary())],
                schema=pa.schema([("vec_id", pa.int64()), batch.schema.field("label"), ("digest", pa.binary()), ("unit", pa.binary()), ("signs", pa.binary())]),
            )

    return run


def _buckets(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.arange(plan.tables, dtype=np.int32)
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column("signs").to_pylist()), np.int32)
            length = np.array([len(x) // 8 for x in batch.column("unit").to_pylist()], np.int32)
            index = pa.array(np.repeat(np.arange(batch.num_rows), plan.tables))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(index),
                    batch.column("label").take(index),
                    pa.array(np.repeat(length, plan.tables)),
                    pa.array(np.tile(table, batch.num_rows)),
                    pa.array(signs),
                ],
                names=["key", "label", "length", "table", "sign"],
            )

    return run


def _clusters(plan: Plan):
    """Links between vectors whose signs agree well enough, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = plan.bits * plan.tables
        shifts = np.arange(plan.bits, dtype=np.int32)
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                rows = [*left, *(right or [])]
                sign = np.frombuffer(b"".join(x["signs"] for x in rows), np.int32).reshape(len(rows), -1, 1)
                bits = (2 * ((sign >> shifts) & 1) - 1).reshape(len(rows), n).astype(np.float32)
                key = np.array([x["key"] for x in rows], np.int64)
                root = roots((bits @ bits.T + n >= 2 * n * plan.likely) & _meets(len(left), len(rows)), key)
                a.append(root[root != key])
                b.append(key[root != key])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (a, b)], names=["a", "b"])

    return run


def _verify(plan: Plan):
    """Of each vector: the copies that its verified links reach in this pair of blocks, and its root in their forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, links, root = [], [], []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                rows = [*left, *(right or [])]
                unit = np.frombuffer(b"".join(x["unit"] for x in rows), np.float64).reshape(len(rows), -1)
                linked = (unit @ unit.T >= plan.cosine) & _meets(len(left), len(rows))
                copies = linked @ np.array([x["copies"] for x in rows], np.int64)
                own, any_link = np.array([x["key"] for x in rows], np.int64), linked.any(axis=1)
                key.append(own[any_link])
                links.append(copies[any_link])
                root.append(roots(linked, own)[any_link])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (key, links, root)], names=["key", "links", "root"])

    return run


def lsh_dedup(embeddings: DataFrame, cosine: float = 0.98, plan: Plan | None = None, block: int = 256) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings`` (vec_id, embedding, label)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    plan = plan or Plan.of(rows.count(), cosine)
    bounded_batches(embeddings.sparkSession)
    label = rows.schema["label"].dataType.simpleString()
    signed = cut(rows.mapInArrow(_signed(plan), f"vec_id long, label {label}, digest binary, unit binary, signs binary"), "signed")
    classes = cut(
        signed.where("digest is not null")
        .groupBy("digest", "label")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("unit").alias("unit"), F.any_value("signs").alias("signs"))
        .withColumn("key", F.monotonically_increasing_id()),  # written once, so a class keeps its number
        "vectors",
    )
    bucket = ["label", "length", "table", "sign"]
    members = classes.select("key", "label", "unit", "signs").mapInArrow(_buckets(plan), f"key long, label {label}, length int, table int, sign int")
    marks = F.bit_xor(F.xxhash64("key")), F.bit_xor(F.xxhash64(F.lit(1), "key"))
    # Buckets with the same members count once.
    buckets = (
        members.groupBy(*bucket)
        .agg(F.count("*").alias("size"), marks[0].alias("x"), marks[1].alias("y"))
        .where("size > 1")
        .groupBy("label", "length", "size", "x", "y")
        .agg(F.min(F.struct("table", "sign")).alias("first"))
        .select("label", "length", "size", "first.table", "first.sign")
    )
    held = members.join(buckets, bucket).join(classes.select("key", "signs"), "key")
    pairs = block_pairs(held, bucket, F.col("size"), block, ["key"], ["key", "signs"])
    cluster = components(pairs.select("left", "right").mapInArrow(_clusters(plan), "a long, b long"), "a", "b")
    sizes = cluster.groupBy("component").agg(F.count("*").alias("size"))
    wanted = cluster.join(sizes, "component").withColumnRenamed("node", "key").join(classes.select("key", "copies", "unit"), "key")
    pairs = block_pairs(wanted, ["component"], F.col("size"), block, ["key"], ["key", "copies", "unit"])
    found = cut(pairs.select("left", "right").mapInArrow(_verify(plan), "key long, links long, root long"), "links")
    named = linked_classes(classes, found).join(classes.select("key", "digest"), "key").drop("key")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("class_id"))
    return (
        signed.select("vec_id", "digest")
        .join(named, "digest", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op7_lsh_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label at cosine 0.98 or more."""
    return lsh_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98),
reach AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT s, y FROM reach JOIN links ON x = t)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT s AS vec_id, min(t) AS component_id FROM reach GROUP BY s) LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) USING (vec_id)
"""
