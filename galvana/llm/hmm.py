"""A hidden Markov language model, trained by Baum-Welch and scored by the scaled forward recursion.

The states emit word classes. Each of the commonest training words, those above a
count that bounds their number (``most_hot``), is a class of its own. The other
words share classes by their hash modulo ``most_classes`` at most, and such a class
emits its words in proportion to their training counts plus a half, with a half for
the words it has not seen. Counts of all words stay in a Spark table; hot words
are broadcast, the others are looked up by a join.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, told apart by 64-bit hashes;
each text ends with one end token. A null text is an empty one: an end token. A
row without an id is a training row. Rows that repeat count and are scored
each. Without training rows every word is unknown. A text of millions of words keeps
the states of one stretch of it at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvana.llm import vectext
from galvana.llm.vectext import U64
from galvana.shared import bounded_batches, cut

#: Bytes of text that a task hashes at once, and tokens that it runs through the recursions at once.
BLOCK_BYTES, BLOCK_TOKENS = 2_000_000, 200_000
#: Classes whose expected counts a task sends in one row.
BUCKET = 4096
#: Parts of a count that sums keep.
GRAIN = np.float64(1 << 16)
#: The end token's hash.
END = 1


@dataclass(frozen=True)
class Settings:
    states: int = 8
    rounds: int = 4
    most_classes: int = 1 << 16
    most_hot: int = 1 << 19
    task_tokens: int = 20_000_000
    half: float = 0.5
    stay: float = 0.95
    seed: int = 5


def hashed_texts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows, their tokens' hashes (with end tokens) and each row's offset among them."""
    values = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    for a, b in vectext.chunks(np.fromiter(map(len, values), np.int64, len(values)) + 1, BLOCK_BYTES):
        words, first = vectext.ascii_words(values[a:b])
        offsets = first + np.arange(b - a + 1)
        tokens = np.full(len(words) + b - a, END, U64)
        inside = np.ones(len(tokens), bool)
        inside[offsets[1:] - 1] = False
        tokens[inside] = words
        yield a, b, tokens.view(np.int64), offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts, each about once for a task."""
    word, count, most = [], [], 1 << 20

    def joined() -> tuple[np.ndarray, np.ndarray]:
        codes, distinct = pd.factorize(np.concatenate(word))
        return distinct, np.bincount(codes, weights=np.concatenate(count), minlength=len(distinct)).astype(np.int64)

    def rows(w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(c)], names=["word", "c"])

    for batch in batches:
        for _, _, tokens, _ in hashed_texts(batch.column("text")):
            codes, distinct = pd.factorize(tokens)
            word.append(distinct)
            count.append(np.bincount(codes, minlength=len(distinct)))
            if sum(map(len, word)) > 2 * most:
                w, c = joined()
                word, count = [w], [c]
                if len(w) > most:
                    yield rows(w, c)
                    word, count = [], []
    if word:
        yield rows(*joined())


@dataclass
class Words:
    """What tasks need to turn texts into classes: words of high counts, their classes, and the number of shared classes after those."""

    word: np.ndarray  # ascending
    c: np.ndarray
    kind: np.ndarray
    classes: int


def _encode(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = words.value
        for batch in batches:
            for a, b, tokens, offsets in hashed_texts(batch.column("text")):
                codes, distinct = pd.factorize(tokens)
                place = np.minimum(np.searchsorted(hot.word, distinct), max(len(hot.word) - 1, 0))
                known = hot.word[place] == distinct if len(hot.word) else np.zeros(len(distinct), bool)
                logs = np.where(known, np.log10(hot.c[place] + 0.5), 0.0) if len(hot.word) else np.zeros(len(distinct))
                kind = (len(hot.word) + distinct.view(U64) % U64(hot.classes)).astype(np.uint32)
                if len(hot.word):
                    kind = np.where(known, hot.kind[place], kind)
                kind = kind[codes]
                known = known[codes]
                sums = np.concatenate([[0], np.cumsum(known)])[offsets]
                total = np.add.reduceat(logs[codes], offsets[:-1])
                rest = pa.ListArray.from_arrays(pa.array((offsets - sums).astype(np.int32)), pa.array(tokens[~known]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("held_out").slice(a, b - a),
                        pa.array(np.diff(offsets)),
                        pa.array(np.diff(sums)),
                        pa.array(total),
                        rest,
                        pa.array([kind[x:y].tobytes() for x, y in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)], pa.binary()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "hot", "hot_log", "rest", "classes"],
                )

    return run


@dataclass
class Model:
    """Start, transition and emission probabilities; ``emit`` has a row for each class."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _start_model(weight: np.ndarray, s: Settings) -> Model:
    """Each state's emissions are the corpus's, unevenly distorted; states tend to stay."""
    noise = np.random.default_rng(s.seed).standard_normal((len(weight), s.states))
    emit = weight[:, None] * np.exp(noise)
    move = np.full((s.states, s.states), (1 - s.stay) / max(1, s.states - 1))
    np.fill_diagonal(move, s.stay if s.states > 1 else 1.0)
    return Model(np.full(s.states, 1 / s.states), move, emit / emit.sum(axis=0))


def lockstep(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of rows of like lengths, the longest first, with a bounded product of rows and length."""
    order = np.argsort(-lengths, kind="stable")
    place = 0
    while place < len(order):
        take = max(1, BLOCK_TOKENS // max(1, int(lengths[order[place]])))
        yield order[place : place + take]
        place += take


def _padded(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences given longest first as columns, and the number of them that reach each step."""
    lengths = np.array([len(x) for x in codes])
    steps = int(lengths[0])
    padded = np.zeros((steps, len(codes)), np.uint32)
    for k, x in enumerate(codes):
        padded[: len(x), k] = x
    return padded, np.searchsorted(-lengths, -np.arange(steps), side="left")


def _step(model: Model, state: np.ndarray | None, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scaled states after a step, and its scales; no state stands before the first."""
    before = model.start[None, :] if state is None else state[: len(kinds)] @ model.move
    state = before * model.emit[kinds]
    scale = state.sum(axis=1)
    return state / scale[:, None], scale


def forward(model: Model, codes: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihoods of sequences given longest first."""
    padded, live = _padded(codes)
    total, state = np.zeros(len(codes)), None
    for kinds, n in zip(padded, live.tolist(), strict=True):
        state, scale = _step(model, state, kinds[:n])
        total[:n] += np.log(scale)
    return total


def expected(model: Model, codes: list[np.ndarray], emit: np.ndarray, move: np.ndarray, start: np.ndarray, block: int = BLOCK_TOKENS) -> None:
    """Add a group's Baum-Welch counts to ``emit``, ``move`` and ``start``.

    Of a long group only the states before each stretch of about ``block`` tokens are
    kept; the way back runs each stretch forward again, so a text's states never
    stand in memory whole.
    """
    padded, live = _padded(codes)
    stretch = max(1, block // len(codes))
    begins = list(range(0, len(padded), stretch))
    before, state = [None], None
    for t in range(begins[-1]):
        state, _ = _step(model, state, padded[t, : live[t]])
        if (t + 1) % stretch == 0:
            before.append(state)
    back = np.ones((int(live[-1]), emit.shape[1]))
    for begin, entry in zip(reversed(begins), reversed(before), strict=True):
        states, scales, state = [], [], entry
        for t in range(begin, min(begin + stretch, len(padded))):
            state, scale = _step(model, state, padded[t, : live[t]])
            states.append(state)
            scales.append(scale)
        kinds, weights = [], []
        for t in range(begin + len(states) - 1, begin - 1, -1):
            n, own = int(live[t]), states[t - begin]
            if len(back) < n:  # rows that end here
                back = np.concatenate([back, np.ones((n - len(back), back.shape[1]))])
            kinds.append(padded[t, :n])
            weights.append(own * back)
            if t:
                last = states[t - begin - 1] if t > begin else entry
                ahead = model.emit[padded[t, :n]] * back / scales[t - begin][:, None]
                move += model.move * (last[:n].T @ ahead)
                back = ahead @ model.move.T
        kind, weight = np.concatenate(kinds), np.concatenate(weights)
        if not begin:
            start += weights[-1].sum(axis=0)
        places, distinct = pd.factorize(kind)
        for k in range(weight.shape[1]):
            emit[distinct, k] += np.bincount(places, weights=weight[:, k], minlength=len(distinct))


def _codes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in column.to_pylist()]


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        # The classes' counts, then the moves', then the start's; sent by buckets, one at a time.
        counts = np.zeros((len(m.emit) + len(m.move) + 1, len(m.move)))
        emit, move, start = counts[: len(m.emit)], counts[len(m.emit) : -1], counts[-1]
        for batch in batches:
            codes = _codes(batch.column("classes"))
            for rows in lockstep(np.array([len(x) for x in codes], np.int64)):
                expected(m, [codes[k] for k in rows.tolist()], emit, move, start)
        for bucket, first in enumerate(range(0, len(counts), BUCKET)):
            own = counts[first : first + BUCKET]
            seen = np.flatnonzero(own.any(axis=1))
            if len(seen):
                parts = [pa.array([x.tobytes()], pa.binary()) for x in (seen.astype(np.uint16), own[seen].astype(np.float32))]
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *parts], names=["bucket", "places", "value"])

    return run


def _sum(states: int):
    """Sums of the rows of each bucket, all of which one task gets. Whole multiples of 1 / ``GRAIN`` add up to the same bits in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, place, value in zip(*(batch.column(c).to_pylist() for c in ("bucket", "places", "value")), strict=True):
                if bucket not in sums:
                    sums[bucket] = np.zeros((BUCKET, states), np.int64)
                sums[bucket][np.frombuffer(place, np.uint16)] += np.rint(np.frombuffer(value, np.float32).reshape(-1, states) * GRAIN).astype(np.int64)
        for bucket, value in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([(value / GRAIN).tobytes()], pa.binary())], names=["bucket", "value"])

    return run


def _score(model, table):
    """Log10 likelihood of the classes, less each token's log10 weight of its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, logs = model.value, table.value
        for batch in batches:
            codes = _codes(batch.column("classes"))
            out = np.zeros(len(codes))
            for rows in lockstep(np.array([len(x) for x in codes], np.int64)):
                out[rows] = forward(m, [codes[k] for k in rows.tolist()]) / math.log(10)
            out -= np.array([logs[x].sum() for x in codes])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "classes"), pa.array(out)], names=[*(c for c in batch.schema.names if c != "classes"), "class_score"])

    return run


def hmm_scores(docs: DataFrame, held_out, settings: Settings | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs`` (doc_id, text).

    Rows where the column ``held_out`` is true are not learnt from. ``base_score`` is
    the log10 probability under single words' smoothed counts, ``score`` under the
    hidden Markov model.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    bounded_batches(spark)
    sc = spark.sparkContext
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    counts = rows.where("not held_out").select("text").mapInArrow(_count, "word long, c long")
    words = cut(counts.groupBy("word").agg(F.sum("c").alias("c")), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The lowest count whose words are few enough: a histogram over powers of 2 ** 0.25.
    step = F.floor(F.log2("c") * 4)
    bins = sorted(words.groupBy(step.alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["bin"])
    kept, least = 0, None
    for r in bins:
        kept += r["n"]
        if kept > s.most_hot:
            break
        least = r["c"]
    hot = words.where(F.col("c") >= least).toArrow() if least is not None else pa.table({"word": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    order = np.argsort(hot["word"].to_numpy(), kind="stable")
    word, c = hot["word"].to_numpy()[order], hot["c"].to_numpy()[order]
    # The commonest words' classes stand together.
    kind = np.empty(len(word), np.uint32)
    kind[np.lexsort((word, -c))] = np.arange(len(word))
    n_shared = min(s.most_classes, max(256, 1 << max(0, math.ceil(math.log2(max(v - len(word), 1) / 8)))))
    n_classes = len(word) + n_shared
    known = sc.broadcast(Words(word, c, kind, n_shared))
    seen = np.zeros(n_classes)
    seen[kind] = c
    unseen = np.full(n_classes, s.half)
    # Shared classes are powers of two in number, so a hash's sign doesn't matter.
    tail = words if least is None else words.where(F.col("c") < least)
    for r in tail.groupBy(F.pmod("word", F.lit(n_shared)).cast("int").alias("kind")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        seen[len(word) + r["kind"]] = r["c"]
        unseen[len(word) + r["kind"]] += s.half * r["v"]
    weight = seen + unseen
    encoded = cut(
        rows.mapInArrow(
            _encode(known),
            f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, hot long, hot_log double, rest array<long>, classes binary",
        ).withColumn("row", F.monotonically_increasing_id()),
        "tokens",
    )
    known.destroy()
    model = _start_model(weight, s)
    # A task sends a row for each class that it has seen, so fewer and longer tasks send less.
    training = encoded.where("not held_out").select("classes").coalesce(max(2 * sc.defaultParallelism, -(-n // s.task_tokens)))
    for _ in range(s.rounds):
        sent = sc.broadcast(model)
        part = training.mapInArrow(_expect(sent), "bucket int, places binary, value binary")
        table = part.repartition("bucket").mapInArrow(_sum(s.states), "bucket int, value binary").toArrow()
        sent.destroy()  # else every round's model stays on the disks
        value = np.zeros((-(-(n_classes + s.states + 1) // BUCKET) * BUCKET, s.states))
        for bucket, own in zip(table["bucket"].to_pylist(), table["value"].to_pylist(), strict=True):
            value[bucket * BUCKET : (bucket + 1) * BUCKET] = np.frombuffer(own).reshape(BUCKET, -1)
        value = value[: n_classes + s.states + 1]
        emit, move, start = value[:n_classes] + unseen[:, None], value[n_classes:-1] + 1, value[-1] + 1
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "hot", "hot_log", "classes").mapInArrow(
        _score(sc.broadcast(model), sc.broadcast(np.log10(weight))),
        f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, hot long, hot_log double, class_score double",
    )
    rest = encoded.select("row", F.explode("rest").alias("word")).join(words, "word", "left")
    rest = rest.groupBy("row").agg(F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("log"))
    logs = F.col("hot_log") + F.coalesce("log", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(math.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        (logs + F.col("class_score")).alias("score"),
    )


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learning from those whose crc32(doc_id) mod 5 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return hmm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
