"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words (by hash, ``WORDS`` of them), its trigrams of
character shapes (runs of one kind of character count as one or as several) and
its repetitions: words that equal one a few places before, and words that the
text has had already. Log counts times inverse frequencies of labelled texts, the
words and the rest each of a length of its own, are projected on their leading
singular directions. The labelled vectors are broadcast; every text's cosines
with all of them are computed in blocks, and the nearest vote with weights that
rise with similarity.

Labels are learnt from a bounded sample of labelled rows (``most_labelled``), which
is the one bound here: every term that a labelled text holds counts, and every
text is scored whole. A null text scores like an empty one; a text without any
term, or far from all labelled ones, gets the labels' mean, and without any label
all get 0.5. A doc_id with several labels gets their mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galvana.llm import vectext
from galvana.shared import bounded_batches

#: Bytes and rows of text that a task turns into terms at once, and terms that it projects at once.
BLOCK_BYTES, BLOCK_ROWS, BLOCK_TERMS = 500_000, 1000, 100_000
#: Distances at which a word's repetition is a term.
LAGS = (1, 2, 3, 4, 5, 6, 8, 12, 16)


@dataclass(frozen=True)
class Settings:
    most_labelled: int = 4096
    dimensions: int = 48
    neighbours: int = 25
    power: float = 8.0
    words: float = 0.5  # length of the words' part beside that of the rest


def _shapes() -> np.ndarray:
    """Kind of each byte: 0 to 15."""
    kind = np.full(256, 1, np.int64)  # lower case, and all bytes of other scripts
    groups = {2: "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3: "0123456789", 4: " \t", 5: "\n\r\x0b\x0c", 6: ".", 7: ",;:", 8: "!?", 9: "|", 10: "#$%&*", 11: "<>=/\\", 12: "@", 13: "'\"-_", 14: "()[]{}"}
    for k, members in groups.items():
        kind[list(members.encode())] = k
    kind[:32][kind[:32] == 1] = 15
    kind[33:127][(kind[33:127] == 1) & ~np.isin(np.arange(33, 127), list(range(97, 123)))] = 15
    return kind


_KIND = _shapes()
_TRIGRAMS = 32**3
#: Terms that words share by their hashes; they follow the others.
WORDS = 1 << 15
_OTHERS = _TRIGRAMS + len(LAGS) + 3
TERMS = _OTHERS + WORDS


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of everything that the texts hold."""
    n = len(texts)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, n))])
    parts = []
    if len(joined):
        kind = _KIND[joined]
        first = np.ones(len(kind), bool)
        first[1:] = kind[1:] != kind[:-1]
        first[offsets[:-1][offsets[:-1] < len(kind)]] = True
        at = np.flatnonzero(first)
        long = (np.diff(np.append(at, len(kind))) > 1).astype(np.int64)
        shape = kind[at] * 2 + long
        row = np.searchsorted(offsets, at, side="right") - 1
        tri = (shape[:-2] * 32 + shape[1:-1]) * 32 + shape[2:]
        own = row[:-2] == row[2:]
        parts.append(row[:-2][own] * TERMS + tri[own])
    words, begin = vectext.ascii_words(texts)
    row = np.repeat(np.arange(n), np.diff(begin))
    for k, lag in enumerate(LAGS):
        if len(words) > lag:
            same = (words[lag:] == words[:-lag]) & (row[lag:] == row[:-lag])
            parts.append(row[lag:][same] * TERMS + _TRIGRAMS + k)
    if len(words):
        parts.append(row * TERMS + _OTHERS + (words % np.uint64(WORDS)).astype(np.int64))
        pair = vectext.mix(words ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        fresh = np.zeros(len(words), bool)
        codes, distinct = pd.factorize(pair)
        where = np.empty(len(distinct), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        fresh[where] = True
        parts.append(row[~fresh] * TERMS + _TRIGRAMS + len(LAGS))
        parts.append(row[fresh] * TERMS + _TRIGRAMS + len(LAGS) + 1)
    key, count = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
    return key // TERMS, key % TERMS, count


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    column = texts.cast(pa.binary())
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for a, b in vectext.chunks(sizes + BLOCK_BYTES // BLOCK_ROWS, BLOCK_BYTES):
        yield a, b, [x or b"" for x in column.slice(a, b - a).to_pylist()]


def _by_row(row: np.ndarray, column: np.ndarray, value: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The product of a sparse matrix of n rows, in order of rows, with a dense one."""
    out = np.zeros((n, x.shape[1]), np.float32)
    for a in range(0, len(row), BLOCK_TERMS):
        own, at = row[a : a + BLOCK_TERMS], column[a : a + BLOCK_TERMS]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[first]] += np.add.reduceat(x[at] * value[a : a + BLOCK_TERMS, None], first, axis=0)
    return out


@dataclass
class Space:
    """Terms in use with their weights and projection, and the labelled vectors."""

    column: np.ndarray  # of each term, -1 if not in use
    weight: np.ndarray
    projection: np.ndarray
    labelled: np.ndarray
    quality: np.ndarray
    mean: float

    def sparse(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, words: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of the texts' terms in use, in order of rows."""
        use = self.column[term] >= 0
        row, term, column = row[use], term[use], self.column[term[use]]
        value = (1 + np.log(count[use])) * self.weight[column]
        part = 2 * row + (term >= _OTHERS)
        length = np.sqrt(np.bincount(part, weights=value * value, minlength=2 * n))[part]
        return row, column, (value / length * np.where(term >= _OTHERS, words, 1.0)).astype(np.float32)

    def vectors(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, words: float) -> np.ndarray:
        return unit(_by_row(*self.sparse(row, term, count, n, words), self.projection, n))

    def scores(self, vectors: np.ndarray, s: Settings) -> np.ndarray:
        """Means of the nearest labels, weighted by a power of the cosine."""
        if not len(self.labelled):
            return np.full(len(vectors), 0.5)
        k = min(s.neighbours, len(self.labelled))
        cosine = vectors @ self.labelled.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** s.power
        total = weight.sum(axis=1)
        vote = (weight * self.quality[near]).sum(axis=1)
        return np.where(total > 0, vote / np.where(total > 0, total, 1), self.mean).clip(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def directions(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, m: int, k: int) -> np.ndarray:
    """About the k leading right singular directions of a sparse n x m matrix, by subspace iteration from a fixed start."""
    order = np.lexsort((row, column))
    turned = column[order], row[order], value[order]
    x = np.random.default_rng(11).standard_normal((m, k + 8)).astype(np.float32)
    for _ in range(5):
        x = np.linalg.qr(_by_row(*turned, _by_row(row, column, value, x, n), m))[0].astype(np.float32)
    _, _, turn = np.linalg.svd(_by_row(row, column, value, x, n), full_matrices=False)
    return np.ascontiguousarray((x @ turn.T)[:, :k], np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], quality: np.ndarray, s: Settings) -> Space:
    """The space of the labelled texts' terms and counts."""
    n = len(rows)
    row = np.repeat(np.arange(n), [len(t) for t, _ in rows])
    term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in rows)]).astype(np.int64)
    count = np.concatenate([np.zeros(0), *(c for _, c in rows)])
    frequency = np.bincount(term, minlength=TERMS)
    used = np.flatnonzero(frequency)
    column = np.full(TERMS, -1, np.int64)
    column[used] = np.arange(len(used))
    weight = (1 + np.log(n / np.maximum(frequency[used], 1))).astype(np.float32)
    space = Space(column, weight, np.zeros((len(used), 0), np.float32), np.zeros((0, 0), np.float32), quality, float(quality.mean()) if n else 0.5)
    if n and len(used):
        row, column, value = space.sparse(row, term, count, n, s.words)
        space.projection = directions(row, column, value, n, len(used), s.dimensions)
        space.labelled = unit(_by_row(row, column, value, space.projection, n))
    return space


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in _blocks(batch.column("text")):
            row, term, count = term_counts(texts)
            bounds = np.searchsorted(row, np.arange(b - a + 1)).tolist()
            lists = [pa.array([v[x:y].astype(np.int32).tobytes() for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary()) for v in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(a, b - a), *lists], names=["quality", "terms", "counts"])


def train(docs: DataFrame, labels: DataFrame, learns: Column, settings: Settings | None = None) -> Space:
    """Fit on at most ``most_labelled`` labelled ids, the first by their hashes, among those where ``learns``.

    An id with several texts is learnt by one of them, the first by hash.
    """
    s = settings or Settings()
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("quality")).where(learns)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.most_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("own"), F.first("quality").alias("quality"))
    texts = texts.select("quality", "own.text")
    rows = texts.mapInArrow(_terms, "quality double, terms binary, counts binary").toArrow()
    found = sorted(zip(*(rows[c].to_pylist() for c in ("terms", "counts", "quality")), strict=True))
    lists = [(np.frombuffer(t, np.int32), np.frombuffer(c, np.int32).astype(np.float64)) for t, c, _ in found]
    return fit(lists, np.array([q for _, _, q in found], np.float64), s)


def quality_score(spark: SparkSession, space: Space, text: Column | str = "text", settings: Settings | None = None) -> Column:
    """The score of a column of texts; evaluated in Arrow batches, without a shuffle."""
    s = settings or Settings()
    sent = spark.sparkContext.broadcast(space)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        own = sent.value
        parts = [own.scores(own.vectors(*term_counts(block), b - a, s.words), s) for a, b, block in _blocks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(text)


def fold(doc_id: Column | str) -> Column:
    """True for the rows that are held out: crc32 of the id as text, mod 3, is 1. A null id is not."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``, learnt from labels of ids outside the held-out third."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    score = quality_score(spark, train(docs, labels, ~fold("doc_id")))
    return docs.select("doc_id", score.alias("score")).select("doc_id", fold("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
