"""Byte-level BPE encoding and decoding by a two-tier lookup.

A match of the pattern (a pre-token) that is itself in the vocabulary resolves
through a minimal perfect hash. Any other is merged by its pairs' ranks with a
heap over a linked list of bytes. Tasks look up each distinct pre-token of a
block of texts once, and keep merges in a memo of bounded length.

Results: a null text encodes like an empty one, to no ids; null ids decode to no
bytes. Rows are neither merged nor dropped, and other columns pass unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galvana.llm import vectext
from galvana.llm.vectext import U64
from galvana.shared import bounded_batches

#: Bytes of text that a task encodes at once, and the most pre-tokens of a memo's generation.
BLOCK_BYTES = 1_000_000
MEMO_WORDS = 200_000
#: Vocabularies are broadcast; larger files are refused.
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of over {MAX_VOCABULARY_BYTES} bytes")
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _slots(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (vectext.mix(h ^ displacement.astype(U64) * U64(0xC2B2AE3D27D4EB4F)) % U64(n)).astype(np.int64)


@dataclass
class PerfectHash:
    """A minimal perfect hash by displaced buckets: n keys fill n slots.

    ``displacement`` holds for each bucket the number that sends its keys to slots
    of their own, or for a bucket of one key -1 - its slot.
    """

    displacement: np.ndarray
    keys: np.ndarray  # by slot: a key's 64-bit hash
    order: np.ndarray  # by slot: the key's place among those it was built from

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        n = len(h)
        if len(np.unique(h)) != n:
            raise ValueError("two keys have one hash")
        n_buckets = max(1, n // 3)
        bucket = ((h >> U64(32)) % U64(n_buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=n_buckets)
        firsts = np.cumsum(counts) - counts
        displacement, order, taken = np.zeros(n_buckets, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
        tries = np.arange(64)
        for b in np.argsort(-counts, kind="stable"):
            members = by_bucket[firsts[b] : firsts[b] + counts[b]]
            if len(members) < 2:
                break
            first = 0
            while True:
                slots = _slots(h[members][None, :], (tries + first)[:, None], n)
                free = ~taken[slots].any(axis=1)
                good = next((k for k in np.flatnonzero(free) if len(set(slots[k].tolist())) == len(members)), None)
                if good is not None:
                    break
                first += len(tries)
            displacement[b], taken[slots[good]], order[slots[good]] = first + good, True, members
        alone = np.flatnonzero(counts == 1)
        free = np.flatnonzero(~taken)
        displacement[alone], order[free] = -1 - free, by_bucket[firsts[alone]]
        return cls(displacement, h[order], order)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The places of the keys with these hashes, -1 for others."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        d = self.displacement[((h >> U64(32)) % U64(len(self.displacement))).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, _slots(h, np.maximum(d, 0), len(self.keys)))
        return np.where(self.keys[slot] == h, self.order[slot], -1)


def hash_words(words: list[str]) -> np.ndarray:
    symbols, offsets = vectext.code_points(words)
    return vectext.span_hashes(symbols, offsets[:-1], offsets[1:])


@dataclass
class Vocabulary:
    """What the two tiers need; its size depends on the vocabulary file alone."""

    bytes: list[int]  # the id of each byte
    pairs: dict[int, int]  # the id that two tokens make together, by first << 32 | second
    words: list[str]  # tokens that a pre-token can equal
    word_ids: np.ndarray
    whole: PerfectHash
    classes: np.ndarray
    key: bytes  # a digest of the ranks: names this vocabulary within a worker

    @classmethod
    def build(cls, ranks: dict[bytes, int]) -> Vocabulary:
        words, ids = [], []
        for token, rank in ranks.items():
            try:
                words.append(token.decode())
            except UnicodeDecodeError:  # part of a character: never a whole pre-token
                continue
            ids.append(rank)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"a byte-level vocabulary holds every byte; this one lacks {missing}")
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (one := ranks.get(token[:k])) is not None and (two := ranks.get(token[k:])) is not None:
                    pairs[one << 32 | two] = rank
        key = hashlib.blake2b(repr(sorted(ranks.items())).encode()).digest()
        return cls([ranks[bytes([b])] for b in range(256)], pairs, words, np.array(ids, np.int32), PerfectHash.build(hash_words(words)), vectext.character_classes(), key)


def merge(word: bytes, alphabet: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge a word's bytes, the pair of lowest rank first and of these the leftmost; a token's id is its rank."""
    n = len(word)
    part = [alphabet[b] for b in word]
    get = pairs.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # Rank of the pair that starts at each place now; a heap entry is a rank and a place in one number.
    now = [get(a << 32 | b, -1) for a, b in zip(part, part[1:], strict=False)]
    now.append(-1)
    bits = n.bit_length()
    low = (1 << bits) - 1
    heap = [rank << bits | k for k, rank in enumerate(now) if rank >= 0]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        k, both = entry & low, entry >> bits
        if now[k] != both:
            continue  # one side was merged since
        j = after[k]
        part[k] = both
        part[j] = now[j] = -1
        after[k] = j = after[j]
        if j < n:
            before[j] = k
            now[k] = rank = get(both << 32 | part[j], -1)
            if rank >= 0:
                push(heap, rank << bits | k)
        else:
            now[k] = -1
        if (i := before[k]) >= 0:
            now[i] = rank = get(part[i] << 32 | both, -1)
            if rank >= 0:
                push(heap, rank << bits | i)
    return [x for x in part if x >= 0]


def pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Encoder:
    """Encodes blocks of texts; ``miss`` gives the packed ids of pre-tokens that are no vocabulary words.

    The memo has two generations: a full one becomes the older, and what is used
    again moves to the newer.
    """

    def __init__(self, vocabulary: Vocabulary, miss=None):
        self.v = vocabulary
        self.miss = miss or (lambda words: [pack(merge(w.encode(), vocabulary.bytes, vocabulary.pairs)) for w in words])
        self.ids = [pack([k]) for k in vocabulary.word_ids.tolist()]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _resolve(self, words: list[str], h: np.ndarray) -> list[bytes]:
        known, ids, new, old = self.v.words, self.ids, self.new, self.old
        place = self.v.whole.find(h).tolist()
        out = [ids[p] if p >= 0 and known[p] == w else new.get(w) for p, w in zip(place, words, strict=True)]
        if missing := [k for k, x in enumerate(out) if x is None]:
            if len(new) > MEMO_WORDS:
                self.old, self.new = new, {}
                new, old = self.new, self.old
            never = []
            for k in missing:
                if (x := old.get(words[k])) is not None:
                    out[k] = new[words[k]] = x
                else:
                    never.append(k)
            for k, x in zip(never, self.miss([words[k] for k in never]), strict=True):
                out[k] = new[words[k]] = x
        return out

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and each text's offset among them (one more than texts)."""
        symbols, offsets = vectext.code_points(texts)
        starts = vectext.pretoken_starts(symbols, offsets, self.v.classes)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(symbols))
        codes, where, distinct = vectext.distinct_spans(symbols, starts, ends)
        joined = "".join(texts)
        words = [joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        found = self._resolve(words, distinct)
        flat = np.frombuffer(b"".join(found), np.int32)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        firsts = np.cumsum(lengths) - lengths
        taken = lengths[codes]
        places = np.zeros(len(taken) + 1, np.int64)
        np.cumsum(taken, out=places[1:])
        ids = flat[np.repeat(firsts[codes] - places[:-1], taken) + np.arange(places[-1])]
        return ids, places[np.searchsorted(starts, offsets)]

    def blocks(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``block`` over all of an Arrow column's texts, some at a time."""
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in vectext.chunks(sizes, BLOCK_BYTES):
            yield self.block([x or "" for x in texts.slice(a, b - a).to_pylist()])


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(vocabulary: Broadcast) -> Encoder:
    """This worker's encoder of a broadcast vocabulary: its memo outlives a task; the worker holds one at a time."""
    v = vocabulary.value
    if v.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[v.key] = Encoder(v)
    return _ENCODERS[v.key]


def _id_lists(blocks: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    offsets, total = [np.zeros(1, np.int64)], 0
    for ids, places in blocks:
        offsets.append(places[1:] + total)
        total += len(ids)
    return pa.ListArray.from_arrays(np.concatenate(offsets).astype(np.int32), np.concatenate([np.zeros(0, np.int32), *(x[0] for x in blocks)]))


class Tokenizer:
    """Byte-level BPE as column functions; ``path`` names a file of ranks."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        bounded_batches(spark)
        ranks = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        self._vocabulary = spark.sparkContext.broadcast(Vocabulary.build(ranks))
        tokens = dict((rank, token) for token, rank in ranks.items())
        lengths = np.array([len(tokens.get(k, b"")) for k in range(max(tokens, default=-1) + 1)], np.int64)
        self._tokens = spark.sparkContext.broadcast((lengths, np.frombuffer(b"".join(tokens[k] for k in sorted(tokens)), np.uint8)))

    def encode(self, text: Column | str) -> Column:
        """The ids (array of int) of a column of texts."""
        vocabulary = self._vocabulary

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            return _id_lists(list(encoder(vocabulary).blocks(texts)))

        return encode(text)

    def decode(self, ids: Column | str) -> Column:
        """The bytes of a column of ids; an id that the vocabulary lacks raises an error."""
        tokens = self._tokens

        @F.arrow_udf("binary")
        def decode(column: pa.Array) -> pa.Array:
            return _decoded(column, *tokens.value)

        return decode(ids)

    def documents(self, docs: DataFrame) -> DataFrame:
        """``doc_id, ids, decoded`` of every row of ``docs`` (doc_id, text): encoded and decoded a block at a time, so that a task holds one block's ids."""
        vocabulary, tokens = self._vocabulary, self._tokens

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first = 0
                for block in encoder(vocabulary).blocks(batch.column("text")):
                    ids = _id_lists([block])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(ids)), ids, _decoded(ids, *tokens.value)], names=["doc_id", "ids", "decoded"])
                    first += len(ids)

        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", "text").mapInArrow(both, f"doc_id {kind}, ids array<int>, decoded binary")


def _decoded(column: pa.Array, lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """The bytes of lists of ids; ``lengths`` and ``data`` hold all tokens by id."""
    firsts = np.cumsum(lengths) - lengths
    sizes = np.array(column.value_lengths().fill_null(0), np.int64)
    ids = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out = []
    for a, b in vectext.chunks(sizes, BLOCK_BYTES // 4):
        own = ids[ends[a] - sizes[a] : ends[b - 1]].astype(np.int64)
        if len(own) and (own.min() < 0 or own.max() >= len(lengths) or not lengths[own].all()):
            raise ValueError("ids that the vocabulary lacks")
        taken = lengths[own]
        places = np.zeros(len(own) + 1, np.int64)
        np.cumsum(taken, out=places[1:])
        joined = data[np.repeat(firsts[own] - places[:-1], taken) + np.arange(places[-1])].tobytes()
        rows = places[np.append(ends[a:b] - sizes[a:b], ends[b - 1]) - (ends[a] - sizes[a])].tolist()
        out += [joined[x:y] for x, y in zip(rows, rows[1:], strict=False)]
    return pa.array(out, pa.binary())


def encode_documents(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """A row for each document: its id, its ids and the bytes that they decode to."""
    return tokenizer.documents(docs)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of ``documents``; digests of the ids and of the bytes."""
    return digests(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), Tokenizer(spark)))


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """The digest columns of ``encode_documents``, and more of its columns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
