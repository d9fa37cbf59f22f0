"""Token ids in binary files of patched frame-of-reference blocks.

A file holds segments. A segment is a run of documents in order, and ends with a
line feed after its bytes:

    offset  size      what
    0       4         b"PFR1"
    4       4         uint32: bytes of the segment, these included, the line feed not
    8       4         uint32: partition, 12: uint32: segment of the partition, from 0
    16      8         uint64: ids of the partition before this segment
    24      4         uint32: documents d, 28: uint32: ids n
    32      4         uint32: blocks b, 36: uint32: ids in a block (the last may have fewer)
    40      8 d       int64: document numbers
    ...     d         uint8: 1 where a document has a number
    ...     4 d       uint32: ids in each document
    ...     4 (b + 1) uint32: start of each block and the end of the last, from the first block's first byte
    ...               blocks

A block is the minimum (uint32), the width w (uint8), the number of exceptions e
(uint16), the packed low bits (w bits for each id of a full block, less the minimum,
the highest first), then the exceptions: places (uint16) and high bits (uint32).
The width is that of the ids' percentile, so the few wide ids don't widen all.

Partitions, segments and documents ascend by doc_id, a null first and equal ones in
order of their texts' hashes. A null text is an empty one. Files are written and read by
Spark's text and binary sources, so any store that Spark reaches will do.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galvana.llm import vectext
from galvana.shared import bounded_batches, cut, new_path

MAGIC = b"PFR1"
BLOCK_IDS = 256
#: Ids of a segment, and segments of a file: they bound what a task holds.
SEGMENT_IDS, FILE_SEGMENTS = 1 << 21, 8
PERCENTILE = 90
BLOCK_BYTES, MEMO_WORDS = 1_000_000, 500_000


def pack_blocks(ids: np.ndarray, block: int = BLOCK_IDS, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks' bytes and their starts (one more than blocks)."""
    n_blocks = -(-len(ids) // block)
    if not n_blocks:
        return b"", np.zeros(1, np.uint32)
    full = np.zeros(n_blocks * block, np.int64)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1]
    full = full.reshape(n_blocks, block)
    least = full.min(axis=1)
    rest = (full - least[:, None]).astype(np.uint32)
    rank = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    at = np.partition(rest, rank, axis=1)[:, rank]
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)
    high = rest >> width.astype(np.uint32)[:, None]
    counts = (high > 0).sum(axis=1)
    sizes = 7 + block * width // 8 + 6 * counts
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(starts[-1]), np.uint8)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        """Each row of bytes at a place of its own."""
        out[at[:, None] + np.arange(values.shape[1])] = values

    head = np.zeros((n_blocks, 7), np.uint8)
    head[:, :4] = least.astype("<u4")[:, None].view(np.uint8)
    head[:, 4] = width
    head[:, 5:] = counts.astype("<u2")[:, None].view(np.uint8)
    put(starts[:-1], head)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        low = rest[rows] & np.uint32((1 << w) - 1)
        bits = np.empty((len(rows), block, w), np.uint8)
        for k in range(w):
            bits[:, :, k] = (low >> np.uint32(w - 1 - k)) & np.uint32(1)
        put(starts[rows] + 7, np.packbits(bits.reshape(len(rows), block * w), axis=1))
    row, place = np.nonzero(high)
    if len(row):
        before = np.concatenate([[0], np.cumsum(counts)])
        nth = np.arange(len(row)) - before[row]
        first = (starts[:-1] + 7 + block * width // 8)[row]
        put(first + 2 * nth, place.astype("<u2")[:, None].view(np.uint8))
        put(first + 2 * counts[row] + 4 * nth, high[row, place].astype("<u4")[:, None].view(np.uint8))
    return out.tobytes(), starts.astype(np.uint32)


def unpack_blocks(data: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The n ids of the blocks at ``starts`` in ``data``; any run of blocks can be read alone."""
    starts = starts.astype(np.int64)
    if len(starts) < 2:
        return np.zeros(0, np.uint32)
    head = data[starts[:-1, None] + np.arange(7)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width = head[:, 4].astype(np.int64)
    counts = np.ascontiguousarray(head[:, 5:]).view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((len(width), block), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = data[(starts[rows] + 7)[:, None] + np.arange(block * w // 8)]
        bits = np.unpackbits(packed, axis=1).reshape(len(rows), block, w)
        value = np.zeros((len(rows), block), np.uint32)
        for k in range(w):
            value = (value << np.uint32(1)) | bits[:, :, k]
        out[rows] = value
    row = np.repeat(np.arange(len(width)), counts)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
        first = (starts[:-1] + 7 + block * width // 8)[row]
        place = data[(first + 2 * nth)[:, None] + np.arange(2)].view("<u2")[:, 0]
        high = data[(first + 2 * counts[row] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0]
        out[row, place] |= high << width[row].astype(np.uint32)
    return (out + least[:, None]).reshape(-1)[:n]


def segment(partition: int, number: int, before: int, docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    data, starts = pack_blocks(ids)
    present = np.array([x is not None for x in docs], np.uint8)
    parts = [
        np.array([x or 0 for x in docs], "<i8").tobytes(),
        present.tobytes(),
        lengths.astype("<u4").tobytes(),
        starts.astype("<u4").tobytes(),
        data,
    ]
    size = 40 + sum(map(len, parts))
    head = MAGIC + np.array([size, partition, number], "<u4").tobytes() + np.array([before], "<u8").tobytes()
    return head + np.array([len(docs), len(ids), len(starts) - 1, BLOCK_IDS], "<u4").tobytes() + b"".join(parts)


def segments(content: bytes) -> Iterator[dict]:
    """Every segment of a file: partition, number, before, docs, lengths, ids."""
    data = np.frombuffer(content, np.uint8)
    at = 0
    while at < len(data):
        if content[at : at + 4] != MAGIC:
            raise ValueError("not a file of token segments")
        size, partition, number = np.frombuffer(content, "<u4", 3, at + 4).tolist()
        before = int(np.frombuffer(content, "<u8", 1, at + 16)[0])
        d, n, b, block = np.frombuffer(content, "<u4", 4, at + 24).tolist()
        place = at + 40
        docs = np.frombuffer(content, "<i8", d, place)
        present = np.frombuffer(content, np.uint8, d, place + 8 * d)
        lengths = np.frombuffer(content, "<u4", d, place + 9 * d)
        starts = np.frombuffer(content, "<u4", b + 1, place + 13 * d)
        blocks = data[place + 13 * d + 4 * (b + 1) : at + size]
        ids = unpack_blocks(blocks, starts, n, block)
        yield {"partition": partition, "number": number, "before": before, "docs": pa.array(docs, mask=present == 0), "lengths": lengths.astype(np.int64), "ids": ids}
        at += size + 1


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte.

    Printable bytes of Latin-1 stand for themselves, the others for the code points
    from 256 on, in order.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def splits_alone(text: str) -> bool:
    """Whether a tokenizers file's ids are those of the byte-level pattern's matches, each merged by itself."""
    file = json.loads(text)
    split, model = file.get("pre_tokenizer") or {}, file["model"]
    whole = any(file.get(k) is not None for k in ("normalizer", "truncation", "padding"))
    bytewise = split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
    return not whole and bytewise and model.get("type", "BPE") == "BPE" and not model.get("dropout")


class Words:
    """Encodes texts with a tokenizers file: the library's model merges each distinct pre-token, once in a while.

    A byte-level BPE encodes every match of its pattern by itself, so a text's ids
    are those of its pre-tokens in order. The file's added tokens, the longest of
    those that start first, are cut out before and stand for their ids. Texts that
    hold one which takes spaces, minds word ends or is looked for after the others
    (normalized) go to the library whole, and so do all texts where the file normalizes
    texts, splits them otherwise, or does not merge the same way each time.
    """

    def __init__(self, file: str, classes: np.ndarray):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.model = self.tokenizer.model
        self.by_parts = splits_alone(file)
        added = {t.content: (i, t.single_word or t.lstrip or t.rstrip or t.normalized) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.content}
        self.added = {content: i for content, (i, _) in added.items()}
        self.odd = [content for content, (_, odd) in added.items() if odd]
        self.cuts = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.letters = byte_letters()
        self.classes = classes
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _of(self, words: list[str]) -> list[bytes]:
        new = self.new
        out = [new.get(w) for w in words]
        missing = [k for k, x in enumerate(out) if x is None]
        if missing and len(new) > MEMO_WORDS:
            self.old, self.new = new, {}
            new = self.new
        old, letters, tokenize = self.old, self.letters, self.model.tokenize
        for k in missing:
            w = words[k]
            if not old or (x := old.get(w)) is None:
                shown = w.translate(letters) if w.isascii() else w.encode().decode("latin-1").translate(letters)
                x = array("i", [t.id for t in tokenize(shown)]).tobytes()
            out[k] = new[w] = x
        return out

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and each text's offset among them (one more than texts)."""
        if not self.by_parts:
            found = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            places = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
            return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(places[-1])), places
        if not any(content in t for content in self.added for t in texts):
            return self._plain(texts)
        # Texts as pieces between added tokens; each piece with the ids that follow it.
        pieces, after, first = [], [], [0]
        for t in texts:
            if any(content in t for content in self.odd):
                pieces.append("")
                after.append(self.tokenizer.encode(t, add_special_tokens=False).ids)
            else:
                at = 0
                for m in self.cuts.finditer(t):
                    pieces.append(t[at : m.start()])
                    after.append([self.added[m[0]]])
                    at = m.end()
                pieces.append(t[at:])
                after.append([])
            first.append(len(pieces))
        ids, places = self._plain(pieces)
        more = np.fromiter(map(len, after), np.int64, len(after))
        ids = np.insert(ids, np.repeat(places[1:], more), np.array(list(itertools.chain.from_iterable(after)), np.int32))
        return ids, (places + np.concatenate([[0], np.cumsum(more)]))[first]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        symbols, offsets = vectext.code_points(texts)
        starts = vectext.pretoken_starts(symbols, offsets, self.classes)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(symbols))
        codes, where, _ = vectext.distinct_spans(symbols, starts, ends)
        joined = "".join(texts)
        found = self._of([joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        flat = np.frombuffer(b"".join(found), np.int32)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        firsts, taken = np.cumsum(lengths) - lengths, lengths[codes]
        places = np.concatenate([[0], np.cumsum(taken)])
        ids = flat[np.repeat(firsts[codes] - places[:-1], taken) + np.arange(places[-1])]
        return ids, places[np.searchsorted(starts, offsets)]


_WORDS: dict[int, Words] = {}


def _segments(vocabulary, end_id: int):
    """The segments of one partition's documents, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, classes = vocabulary.value
        key = hash(file)
        if key not in _WORDS:
            _WORDS.clear()
            _WORDS[key] = Words(file, classes)
        words = _WORDS[key]
        partition = TaskContext.get().partitionId()
        number = before = held = 0
        docs, lengths, ids = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal number, before, held
            data = segment(partition, number, before, docs, np.concatenate(lengths), np.concatenate(ids))
            number, before, held = number + 1, before + held, 0
            docs.clear(), lengths.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in vectext.chunks(sizes + 1, BLOCK_BYTES):
                found, places = words.block([x or "" for x in batch.column("text").slice(a, b - a).to_pylist()])
                size = np.diff(places) + 1
                own = np.full(len(found) + b - a, end_id, np.int32)
                inside = np.ones(len(own), bool)
                inside[np.cumsum(size) - 1] = False
                own[inside] = found
                docs += batch.column("doc_id").slice(a, b - a).to_pylist()
                lengths.append(size)
                ids.append(own)
                held += len(own)
                if held >= SEGMENT_IDS:
                    yield close()
        if docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, partitions: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) with the tokenizers file ``tokenizer`` and write them below ``path``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast((file.read(), vectext.character_classes()))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The text's hash deals rows of one id (or without any) to several partitions.
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    found = ordered.mapInArrow(_segments(vocabulary, end_id), "value binary")
    found.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", FILE_SEGMENTS).option("compression", "none").text(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            for s in segments(content.as_py()):
                ends = np.cumsum(s["lengths"])
                raw = np.ascontiguousarray(s["ids"].astype("<u4"))
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - s["lengths"]).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [s["docs"], pa.array(np.full(len(ends), s["partition"], np.int32)), pa.array(s["before"] + ends - s["lengths"]), pa.array(s["lengths"]), pa.array(crc, pa.int64())],
                    names=["doc_id", "partition", "within", "n_tokens", "ids_crc32"],
                )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            for s in segments(content.as_py()):
                offsets = np.concatenate([[0], np.cumsum(s["lengths"])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([s["docs"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(s["ids"].astype(np.int64)))], names=["doc_id", "ids"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids`` (array of long) of all files below ``path``."""
    return _files(spark, path).mapInArrow(_ids, "doc_id long, ids array<long>")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all files below ``path``; start counts the ids before a document."""
    rows = cut(_files(spark, path).mapInArrow(_documents, "doc_id long, partition int, within long, n_tokens long, ids_crc32 long"), "index")
    # One row for each partition that wrote files.
    totals = rows.groupBy("partition").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("partition", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(bases, "partition").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all ``documents`` to files in the shared folder, and index them from there."""
    path = new_path(spark, "token_files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_index(spark, path)
