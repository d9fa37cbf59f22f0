"""Similarity self-join of documents on the Jaccard index of their word n-grams.

MinHash signatures are cut into bands; documents that agree in a band share a
bucket. The rows of a band and the number of bands follow from the similarity
and the recall that are asked for. Documents with equal n-gram sets form one
class from the start, so copies are never compared. Within buckets, short
signatures split off what is clearly below the similarity; what remains hangs
together in clusters, and all pairs of a cluster are verified on the full sets,
in pairs of blocks. Tasks give each document's number of links and a forest of
links, never a row for each pair.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. A text of fewer words than
n has one gram, all its words; a text without words (empty, null) has none and
links with nothing. Grams are compared by 64-bit hashes. Rows that repeat are
copies; all of them count. Null ids are kept, and join a class like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvana.llm import vectext
from galvana.llm.blocks import block_pairs
from galvana.llm.components import components, linked_classes
from galvana.llm.vectext import U64
from galvana.shared import bounded_batches, cut

#: Bytes of text that a task hashes at once.
BLOCK_BYTES = 1_000_000


@dataclass(frozen=True)
class Plan:
    """Bands and rows of a MinHash signature."""

    bands: int
    rows: int
    words: int
    similarity: float

    @classmethod
    def of(cls, similarity: float = 0.8, recall: float = 0.9999, words: int = 5, most_hashes: int = 256) -> Plan:
        """The most rows a band, and so the fewest false candidates, that keep the recall.

        A pair at just the similarity shares a bucket with probability
        1 - (1 - similarity ** rows) ** bands.
        """
        best = None
        for rows in range(1, 33):
            bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
            if bands * rows <= most_hashes:
                best = cls(bands, rows, words, similarity)
        if best is None:
            raise ValueError("most_hashes is too small for this recall")
        return best

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def likely(self) -> float:
        """Share of equal signature places from which a pair is verified: 5 standard deviations below the similarity."""
        return self.similarity - 5 * math.sqrt(self.similarity * (1 - self.similarity) / self.hashes)


def gram_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct gram hashes in ascending order, joined, and the texts' offsets among them."""
    words, first = vectext.ascii_words(texts)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(words))
    end = first[1:][text]
    gram = np.zeros(len(words), U64)
    for j in range(n):
        other = np.minimum(place + j, len(words) - 1)
        gram = gram * U64(0x9E3779B97F4A7C15) + np.where(place + j < end, words[other], U64(j + 1))
    whole = (place + n <= end) | (place == first[:-1][text])
    gram, text = vectext.mix(gram[whole]), text[whole]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        gram[a:b].sort()
    keep = np.ones(len(gram), bool)
    keep[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    return gram[keep], np.searchsorted(text[keep], np.arange(len(texts) + 1))


def set_digests(grams: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """16 bytes that equal sets share; None for empty sets."""
    full = np.flatnonzero(np.diff(offsets))
    out: list[bytes | None] = [None] * (len(offsets) - 1)
    if len(full):
        sums = [np.add.reduceat(vectext.mix(grams ^ U64(salt)), offsets[full]) for salt in (0x1B873593CC9E2D51, 0x38B34AE5A1E38B93)]
        for k, raw in zip(full.tolist(), np.stack(sums, 1), strict=True):
            out[k] = raw.tobytes()
    return out


def signatures(grams: np.ndarray, offsets: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash of every non-empty set: a row for each, a column for each hash function."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    factors = vectext.mix(np.arange(1, hashes + 1, dtype=U64)) | U64(1)
    out = np.empty((hashes, len(starts)), U64)
    if len(starts):
        for k in range(hashes):
            out[k] = np.minimum.reduceat(grams * factors[k], starts)
    return out.T


def _binary_lists(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _sketches(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = vectext.mix(np.arange(1000, 1000 + plan.rows, dtype=U64)) | U64(1)
        for batch in batches:
            texts, ids = _binary_lists(batch.column("text")), batch.column("doc_id")
            for a, b in vectext.chunks(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, BLOCK_BYTES):
                grams, offsets = gram_sets(texts[a:b], plan.words)
                found = signatures(grams, offsets, plan.hashes)
                bands = np.zeros((len(found), plan.bands), U64)
                for j in range(plan.bands):
                    bands[:, j] = vectext.mix((found[:, j * plan.rows : (j + 1) * plan.rows] * spread).sum(axis=1, dtype=U64) + U64(j))
                full = np.diff(offsets) > 0
                row = np.cumsum(full) - 1
                bands, low = bands.astype(np.int64).tolist(), (found & U64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[a:b],
                        batch.column("text_hash").slice(a, b - a),
                        pa.array(np.diff(offsets), pa.int32()),
                        pa.array(set_digests(grams, offsets), pa.binary()),
                        pa.array([bands[r] if f else None for f, r in zip(full, row, strict=True)], pa.list_(pa.int64())),
                        pa.array([low[r].tobytes() if f else None for f, r in zip(full, row, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "n_grams", "digest", "bands", "signature"],
                )

    return run


def forest(linked: np.ndarray) -> np.ndarray:
    """The smallest place that each place of a symmetric link matrix reaches."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def roots(linked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The smallest key that each place of a symmetric link matrix reaches: edges to it never give a node many smaller neighbours."""
    label = forest(linked)
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, label, keys)
    return least[label]


def _meets(n_left: int, n: int) -> np.ndarray:
    """Which pairs a task compares: those across its two blocks, or those within its only one."""
    side = np.arange(n) >= n_left
    return ~np.eye(n, dtype=bool) if n_left == n else side[:, None] != side[None, :]


def _unique(left: list[dict], right: list[dict] | None) -> tuple[list[dict], int]:
    one = {x["key"]: x for x in left}
    two = {x["key"]: x for x in right or []}
    return [*one.values(), *two.values()], len(one)


def _clusters(plan: Plan):
    """Links between documents whose short signatures agree well enough, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                rows, n_left = _unique(left, right)
                low = np.frombuffer(b"".join(x["signature"] for x in rows), np.uint8).reshape(len(rows), plan.hashes)
                same = np.zeros((len(rows), len(rows)), np.int16)
                for k in range(plan.hashes):
                    same += low[:, k][:, None] == low[:, k][None, :]
                key = np.array([x["key"] for x in rows], np.int64)
                root = roots((same >= plan.likely * plan.hashes) & _meets(n_left, len(rows)), key)
                a.append(root[root != key])
                b.append(key[root != key])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (a, b)], names=["a", "b"])

    return run


def _sets(plan: Plan):
    """The full gram sets of the documents that stand for the classes of clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = _binary_lists(batch.column("text")), batch.column("digest").to_pylist()
            rest = batch.drop_columns(["text"])
            for a, b in vectext.chunks(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, BLOCK_BYTES):
                grams, offsets = gram_sets(texts[a:b], plan.words)
                own = [x == y for x, y in zip(set_digests(grams, offsets), wanted[a:b], strict=True)]
                sets = pa.array([grams[x:y].tobytes() for x, y in zip(offsets, offsets[1:], strict=False)], pa.binary())
                part = rest.slice(a, b - a).append_column("grams", sets)
                yield part.filter(pa.array(own))

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, through the grams that two sets or more hold."""
    n = len(sets)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[inverse]
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    keep = shared[inverse]
    row, column = row[keep], column[keep]
    out, width = np.zeros((n, n), np.float64), 1 << 13
    for first in range(0, int(shared.sum()), width):
        part = (column >= first) & (column < first + width)
        block = np.zeros((n, width), np.float32)
        block[row[part], column[part] - first] = 1
        out += block @ block.T
    return out


def _verify(plan: Plan):
    """Of each document: the copies that its verified links reach in this pair of blocks, and its root in their forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, links, root = [], [], []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                rows, n_left = _unique(left, right)
                if len(rows) < 2:
                    continue
                sets = [np.frombuffer(x["grams"], U64) for x in rows]
                size = np.array([len(x) for x in sets], np.float64)
                both = intersections(sets)
                linked = (both / (size[:, None] + size[None, :] - both) >= plan.similarity) & _meets(n_left, len(rows))
                copies = linked @ np.array([x["copies"] for x in rows], np.int64)
                own = np.array([x["key"] for x in rows], np.int64)
                any_link = linked.any(axis=1)
                key.append(own[any_link])
                links.append(copies[any_link])
                root.append(roots(linked, own)[any_link])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (key, links, root)], names=["key", "links", "root"])

    return run


#: Bits that mark wanted hashes; a bitmap of all of them takes 8 MB, and each row of it 4 KB.
MARKS = 1 << 26


def marked(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose hash is among the wanted ones, and few others, before any shuffle.

    Wanted hashes set bits of a bitmap, which is broadcast: its size is bounded whatever
    they are. Some rows that share a bit pass as well; a join behind tells.
    """
    place = F.pmod(F.col(column), F.lit(MARKS)) + 1
    bits = wanted.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    at = F.bitmap_bit_position(place)
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("_bucket"))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_bucket", "_bits")


def ngram_join(docs: DataFrame, plan: Plan | None = None, bucket_block: int = 256, verify_block: int = 128) -> DataFrame:
    """``doc_id, text_hash, n_grams, class_id, n_links, kept``: a row for each row of ``docs``.

    class_id is the smallest id that links reach (its own without links; null only
    if no document of the class has an id); n_links counts the other rows at or
    above the similarity; text_hash is xxhash64 of the text. Kept are each class's
    rows of smallest id and then text hash, and rows without grams: these are
    one document, repeated or not.
    """
    plan = plan or Plan.of()
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")  # a class's least row has an id if any has
    sketches = cut(
        docs.mapInArrow(_sketches(plan), "doc_id long, text_hash long, n_grams int, digest binary, bands array<long>, signature binary"), "sketches"
    )
    classes = cut(
        sketches.where("n_grams > 0")
        .groupBy("digest")
        .agg(F.min(row).alias("least"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature"))
        .withColumn("key", F.monotonically_increasing_id()),  # written once, so a class keeps its number
        "classes",
    )
    members = classes.select("key", F.explode("bands").alias("bucket"))
    mark = F.bit_xor(F.xxhash64("key")), F.bit_xor(F.xxhash64(F.lit(1), "key"))
    # Buckets with the same members count once.
    buckets = (
        members.groupBy("bucket")
        .agg(F.count("*").alias("size"), mark[0].alias("x"), mark[1].alias("y"))
        .where("size > 1")
        .groupBy("size", "x", "y")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", "size")
    )
    held = members.join(buckets, "bucket").join(classes.select("key", "signature"), "key")
    pairs = block_pairs(held, ["bucket"], F.col("size"), bucket_block, ["key"], ["key", "signature"])
    likely = pairs.select("left", "right").mapInArrow(_clusters(plan), "a long, b long")
    cluster = components(likely, "a", "b").withColumnRenamed("node", "key")
    sizes = cluster.groupBy("component").agg(F.count("*").alias("size"))
    wanted = cluster.join(sizes, "component").join(classes.select("key", "digest", "copies", "least"), "key")
    wanted = wanted.select("component", "size", "key", "digest", "copies", "least.no_id", F.coalesce("least.doc_id", F.lit(0)).alias("id"), "least.text_hash")
    wanted = cut(wanted, "wanted")
    # Only texts that a cluster asks for are shuffled, and one of rows that repeat: copies merge before and while they are.
    same = ["text_hash", "no_id", "id"]
    asked = marked(docs, wanted, "text_hash")
    texts = asked.select("text_hash", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text").groupBy(*same).agg(F.any_value("text").alias("text"))
    texts = wanted.join(texts, same).select("component", "size", "key", "digest", "copies", "text")
    sets = texts.mapInArrow(_sets(plan), "component long, size long, key long, digest binary, copies long, grams binary")
    pairs = block_pairs(sets, ["component"], F.col("size"), verify_block, ["key"], ["key", "copies", "grams"])
    found = cut(pairs.select("left", "right").mapInArrow(_verify(plan), "key long, links long, root long"), "links")
    named = linked_classes(classes, found).join(classes.select("key", "digest"), "key").drop("key")
    alone = F.col("digest").isNull()
    return (
        sketches.select("doc_id", "text_hash", "n_grams", "digest")
        .join(named, "digest", "left")
        .select(
            "doc_id",
            "text_hash",
            "n_grams",
            F.when(alone, F.col("doc_id")).otherwise(F.col("class_id.doc_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            (alone | row.eqNullSafe(F.col("class_id"))).alias("kept"),
        )
    )


def one_of_each(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """``docs`` with one row of each class of near duplicates; texts without words all stay."""
    found = ngram_join(docs, plan).where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("_rows"), F.max("n_grams").alias("_grams"))
    kept = cut(found, "kept").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    same = (F.xxhash64(docs["text"]) == kept["_hash"]) & docs["doc_id"].cast("long").eqNullSafe(kept["_id"])
    if kept.where("_rows > 1 and _grams > 0").isEmpty():
        return docs.join(kept, same, "left_semi")
    # A row that repeats stays once: the first by a hash of its columns. Copies merge before they are shuffled.
    # The row is one column here, so no name of it can clash.
    rows = docs.join(kept.where("_rows > 1 and _grams > 0"), same).select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), kept["_id"], kept["_hash"])
    once = rows.groupBy("_id", "_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return docs.join(kept.where("_rows = 1 or _grams = 0"), same, "left_semi").unionByName(once)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: word 5-grams, Jaccard 0.8 or more."""
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE k / (a.n + b.n - k) >= 0.8),
reach AS (SELECT doc_id AS s, doc_id AS t FROM documents UNION SELECT s, y FROM reach JOIN links ON x = t)
SELECT doc_id, coalesce(n, 0) AS n_grams, class_id, coalesce(k, 0) AS n_links, doc_id = class_id AS kept
FROM (SELECT s AS doc_id, min(t) AS class_id FROM reach GROUP BY s) LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS k FROM links GROUP BY x) USING (doc_id)
"""
