"""The training-data operators against brute force on small tables with every odd case."""

import base64
import collections
import hashlib
import itertools
import json
import math
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import AddedToken, Tokenizer, normalizers, pre_tokenizers

from galvana.llm import bpe, chat_format, hmm, license_scan, lsh_dedup, mixing, ngram_join, quality_knn, token_files, topk_search, vectext

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use for themselves.
    *(T.StructField(c, T.StringType()) for c in ("size", "copies", "row", "digest", "_id", "_hash", "score", "ids", "key", "n_tokens")),
])

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2


def mirrored(length):
    """Two words of a and b, each the other's mirror (Thue-Morse), which polynomials modulo powers of two can't tell apart."""
    word = "a"
    while len(word) < length:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def texts():
    near = BASE + "and a few words more here"
    out = [BASE, BASE, near, near.upper(), "", None, " \t\n ", "tiny", "Tiny", "two words", "漢字 and é’s ½ \U0001f600 don't it'll", "x" * 70_000, ("long text with many words " * 20_000)]
    out += ["\n".join(mirrored(n)) for n in (64, 1024, 4096)] + [" ".join([x] * 6 + ["end"]) for x in mirrored(1024)]
    out += [f"document {k} says {' '.join(str((k * 7919 + j * 104729) % 1000) for j in range(60))}" for k in range(40)]
    return out


def documents(spark, rows=None):
    if rows is None:
        rows = [(k, t, "en", None if k % 11 == 0 else f"s{k % 4}", None) for k, t in enumerate(texts())]
        rows += [(0, BASE, "en", "s9", None), (0, BASE, "en", "s9", None), (None, "no id here", None, None, None), (None, BASE, None, "s1", None)]
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def tik():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# Mixing


@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 50)), min_size=1, max_size=40), st.integers(0, 9))
@settings(max_examples=60, deadline=None)
def test_settling_keeps_the_words_and_leaves_whole_numbers(rows, seed):
    part, size = np.array([p for p, _ in rows]), np.array([float(s) for _, s in rows])
    draw = np.random.default_rng(seed).random(len(rows))
    out = mixing.settle(part, size, draw, False)
    assert ((out == 0) | (out == 1)).sum() >= len(rows) - 1
    assert abs(out @ size - part @ size) < 1e-6
    done = mixing.settle(part, size, draw, True)
    assert set(done) <= {0.0, 1.0} and abs(done @ size - part @ size) <= size.max() + 1e-6


def test_settling_keeps_every_expectation():
    part, size = np.array([0.3, 0.6, 0.5, 0.2]), np.array([5.0, 2.0, 9.0, 1.0])
    rng = np.random.default_rng(3)
    mean = np.mean([mixing.settle(part, size, rng.random(4), True) for _ in range(6000)], axis=0)
    assert np.allclose(mean, part, atol=0.03)


def test_targets_stop_at_three_times_and_share_the_rest():
    found = mixing.targets({"a": 10, "b": 100, "c": 5, None: 50}, (5, 2, 1))
    assert found["a"] == 30 and found["c"] == 15
    assert abs(found["b"] / found[None] - 2 / 5) < 1e-9 and abs(sum(found.values()) - 165) < 1e-9
    assert mixing.targets({}, (5, 2, 1)) == {} and mixing.targets({"a": 0}, (5, 2, 1)) == {"a": 0.0}


def test_mix_comes_near_its_targets_and_reruns_agree(docs, nothing):
    first, again = (mixing.mix_sources(docs).collect() for _ in range(2))
    assert sorted(map(str, first)) == sorted(map(str, again))
    rows = collections.Counter()
    by_source = collections.defaultdict(list)
    sizes = collections.Counter((r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect())
    assert sizes == {(r["doc_id"], r["source"], r["size"]): r["rows"] for r in first}
    for r in first:
        rows[r["doc_id"], r["source"]] += r["rows"]
        by_source[r["source"]].append(r)
        assert 0 <= r["copies"] <= 3 * r["rows"]
    assert rows[0, "s9"] == 2
    for own in by_source.values():
        taken = sum(r["size"] * r["copies"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own) + 1e-6
    assert mixing.mix_sources(nothing).count() == 0
    taken = mixing.take_mix(docs, mixing.mix_sources(docs))
    assert taken.columns == docs.columns
    count = collections.Counter(r["doc_id"] for r in taken.select("doc_id").collect())
    want = collections.Counter()
    for r in first:
        want[r["doc_id"]] += r["copies"]
    assert count == +want
    assert mixing.take_mix(nothing, mixing.mix_sources(nothing)).count() == 0


def test_many_documents_round_in_several_levels(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").alias("source"), (1 + F.col("id") % 17).alias("size"), F.lit(1.37).alias("share"))
    found = mixing.round_copies(rows, bucket=16).collect()
    assert len(found) == 3000 and {r["copies"] for r in found} == {1, 2}
    for source in ("hot", None):
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["size"] * (r["copies"] - 1.37) for r in own)) <= 17


def test_copies_equal_duels_one_by_one(docs):
    """Sources of one bucket: documents settle in falling order of size, then by draw, as exact fractions."""
    from fractions import Fraction

    found = mixing.mix_sources(docs).collect()
    keys = {(r["doc_id"], r["source"], r["size"]): r["key"] for r in docs.sparkSession.createDataFrame(found).select("doc_id", "source", "size", F.xxhash64("doc_id", "source", "size").alias("key")).collect()}
    for source in {r["source"] for r in found}:
        rows = [r for r in found if r["source"] == source and r["size"]]
        key = np.array([keys[r["doc_id"], source, r["size"]] for r in rows], np.int64)
        one, two = mixing._draws(key, 0, 1), mixing._draws(key, 1, 1)
        share = [r["target"] / r["source_size"] * r["rows"] for r in rows]
        part, held = {k: Fraction(x) - math.floor(x) for k, x in enumerate(share)}, None
        for k in sorted((k for k in part if part[k]), key=lambda k: (-rows[k]["size"], one[k])):
            if held is None:
                held = k
                continue
            a, b = rows[held]["size"], rows[k]["size"]
            up, down = min((1 - part[held]) * a, part[k] * b), min(part[held] * a, (1 - part[k]) * b)
            words = up if two[k] < down / (up + down) else -down
            part[held] += words / a
            part[k] -= words / b
            for j in (held, k):
                if min(part[j], 1 - part[j]) < Fraction(1, 10**10):
                    part[j] = Fraction(round(part[j]))
            held = next((j for j in (k, held) if 0 < part[j] < 1), None)
        if held is not None:
            part[held] = Fraction(int(two[held] < part[held]))
        assert [r["copies"] for r in rows] == [math.floor(x) + part[k] for k, x in enumerate(share)]


# Chats


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, place string") if rows else spark.createDataFrame([], "conv_id long, turn long, role string, text string, key string, place string")


def test_snapshots_collapse_into_the_longest(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), (None, None)]
    rows = [(k, t, *talk[t], "a", "b") for k, n in ((1, 1), (2, 3), (3, 4), (4, 4), (9, 2)) for t in range(n)]
    rows += [(5, 0, "user", "hi", "", ""), (5, 1, "assistant", "other <|end|>", "", ""), (6, 7, "user", "", "", ""), (None, 1, "user", "lost", "", ""), (7, 0, "user", None, "", "")]
    table = chats(spark, rows)
    found = {r["conv_id"]: r for r in chat_format.format_chats(table).collect()}
    assert set(found) == {3, 5, 6, 7, None}
    assert found[3]["n_copies"] == 2 and found[3]["n_turns"] == 4
    assert found[3]["text"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nbye<|end|>\n<||>\n<|end|>\n"
    assert "other < |end|>" in found[5]["text"]
    con = duckdb.connect()
    con.register("t", table.toPandas())
    con.execute("create view conversations as select conv_id::bigint as conv_id, turn, role, text from t")
    want = con.sql(chat_format.OP2_SQL).fetchall()
    assert sorted(map(str, want)) == sorted(str((r["conv_id"], r["n_turns"], r["n_copies"], r["text"])) for r in found.values())
    assert chat_format.format_chats(chats(spark, [])).count() == 0


def test_an_empty_id_is_not_a_null_one(spark):
    rows = [("", 0, "user", "a"), (None, 0, "user", "b"), (None, 1, "user", "c"), ("=", 0, "user", "d")]
    found = chat_format.format_chats(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert sorted(str((r["conv_id"], r["n_turns"])) for r in found) == sorted(map(str, [("", 1), (None, 2), ("=", 1)]))


def test_chats_run_without_python(spark):
    plan = chat_format.format_chats(chats(spark, [(1, 0, "user", "a", "", "")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Token files


@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=700), st.integers(1, 100))
@settings(max_examples=80, deadline=None)
def test_blocks_round_trip(ids, percentile):
    data, starts = token_files.pack_blocks(np.array(ids, np.int64), percentile=percentile)
    raw = np.frombuffer(data, np.uint8)
    assert token_files.unpack_blocks(raw, starts, len(ids)).tolist() == ids
    for k in range(len(starts) - 1):  # each block is readable alone
        part = token_files.unpack_blocks(raw, starts[k : k + 2], 256)
        assert part[: len(ids) - 256 * k].tolist() == ids[256 * k : 256 * k + 256]


def test_files_give_back_what_the_library_encodes(spark, docs, nothing):
    from galvana.shared import new_path

    path = new_path(spark, "test")
    token_files.write_token_files(docs, path, partitions=4)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    hashes = {r["text"] or "": r["h"] for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    start, want = 0, []
    for i, t in rows:
        ids = [*own.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in token_files.read_index(spark, path).collect())
    back = token_files.read_ids(spark, path).collect()
    assert sum(len(r["ids"]) for r in back) == start
    empty = new_path(spark, "test")
    token_files.write_token_files(nothing, empty)
    assert token_files.read_index(spark, empty).count() == 0


@pytest.mark.parametrize("more", [[], [AddedToken("<|end", normalized=False), AddedToken("xx<|"), AddedToken("<pad>", lstrip=True), AddedToken("cat", single_word=True)]])
def test_added_tokens_are_ids_as_in_the_library(spark, more):
    from galvana.shared import new_path

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.add_tokens(more)
    end = "<|endoftext|>"
    odd = [f"a {end} b", end, end * 3, f"{end} ", f" {end}it's", f"x{end}\n\n{end}", "<|endoftext| >", "<|endof", "plain text", "", "cat concat cat", "a  <pad> b", f"é漢{end}\U0001f600", f"n {end} cat", f"xx{end}"]
    found, places = token_files.Words(own.to_str(), vectext.character_classes()).block(odd)
    assert [found[a:b].tolist() for a, b in itertools.pairwise(places.tolist())] == [own.encode(t, add_special_tokens=False).ids for t in odd]
    path = new_path(spark, "test")
    token_files.write_token_files(documents(spark, [(k, t, None, None, None) for k, t in enumerate(odd)]), path, partitions=2)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["ids"] for r in token_files.read_ids(spark, path).collect()} == {k: [*plain.encode(t, add_special_tokens=False).ids, 2] for k, t in enumerate(odd)}


@pytest.mark.parametrize("kind", ["lower", "prefix", "split", "words"])
def test_files_that_split_or_normalize_otherwise_go_to_the_library(spark, tmp_path, kind):
    from galvana.shared import new_path

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json" if kind == "words" else "byte_bpe_50k.json"))
    if kind == "lower":
        own.normalizer = normalizers.Lowercase()
    elif kind != "words":
        own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=kind == "prefix", use_regex=kind != "split")
    texts = ["Hello World", "", "It's  here\n\nnow", "a<|endoftext|>B", "é漢 \U0001f600", None]
    file = tmp_path / "own.json"
    own.save(str(file))
    assert not token_files.splits_alone(file.read_text(encoding="utf-8"))
    path = new_path(spark, "test")
    token_files.write_token_files(documents(spark, [(k, t, None, None, None) for k, t in enumerate(texts)]), path, tokenizer=str(file), partitions=2)
    want = {k: [*own.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids"] for r in token_files.read_ids(spark, path).collect()} == want


# Language model


@pytest.mark.parametrize("block", [1, 3, 6, 1000])
def test_forward_and_counts_match_sums_over_all_paths(block):
    rng = np.random.default_rng(0)
    model = hmm.Model(*(x / x.sum(axis=a, keepdims=True) for x, a in ((rng.random(3), 0), (rng.random((3, 3)), 1), (rng.random((5, 3)), 0))))
    seqs = [np.array(s, np.uint16) for s in ([1, 4, 0, 2], [3, 3], [2])]
    emit, move, start = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    logs = hmm.forward(model, seqs)
    hmm.expected(model, seqs, emit, move, start, block)
    w_emit, w_move, w_start = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    for s, log in zip(seqs, logs, strict=True):
        paths = {}
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * math.prod(model.emit[x, z] for x, z in zip(s, path, strict=True)) * math.prod(model.move[a, b] for a, b in itertools.pairwise(path))
            paths[path] = p
        total = sum(paths.values())
        assert abs(math.log(total) - log) < 1e-9
        for path, p in paths.items():
            w_start[path[0]] += p / total
            for x, z in zip(s, path, strict=True):
                w_emit[x, z] += p / total
            for a, b in itertools.pairwise(path):
                w_move[a, b] += p / total
    assert np.allclose(emit, w_emit) and np.allclose(move, w_move) and np.allclose(start, w_start)


def test_a_long_text_keeps_one_stretch_of_states():
    """All states of the text would be 8 MB, and their weights as much again."""
    rng = np.random.default_rng(3)
    model = hmm._start_model(rng.random(50) + 0.1, hmm.Settings())
    text = rng.integers(0, 50, 125_000).astype(np.uint32)
    found = []
    for block in (2_000, len(text)):
        sums = np.zeros((50, 8)), np.zeros((8, 8)), np.zeros(8)
        tracemalloc.start()
        hmm.expected(model, [text], *sums, block)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        found.append((peak, sums))
    (small, own), (large, whole) = found
    assert small < 6_000_000 < 16_000_000 < large
    assert all(np.allclose(a, b) for a, b in zip(own, whole, strict=True)) and abs(own[0].sum() - len(text)) < 1e-3


@pytest.mark.parametrize("hot", [1 << 19, 3])
def test_scores_follow_the_counts(docs, hot):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    found = hmm.hmm_scores(docs, held, hmm.Settings(states=2, rounds=2, most_hot=hot)).collect()
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [None]) for r in docs.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, ws in rows if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 3)) for i, ws in rows)
    assert want == sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in found)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_scores_equal_loops_over_states(spark):
    """Two rounds of Baum-Welch and the forward recursion, state by state."""
    s = hmm.Settings(states=3, rounds=2)
    lines = ["a b a c", "b b", "c a a b d", "", "a d d d b a", "c"]
    held = {1, 4}
    table = documents(spark, [(k, t, None, None, None) for k, t in enumerate([*lines, "a new word b"])])
    found = {r["doc_id"]: r["score"] for r in hmm.hmm_scores(table, F.col("doc_id").isin(*held, 6), s).collect()}
    train = [t.split() + ["\n"] for k, t in enumerate(lines) if k not in held]
    c = collections.Counter(w for ws in train for w in ws)
    codes = {w: int(vectext.ascii_words([w.encode()])[0].view(np.int64)[0]) if w != "\n" else hmm.END for w in {*c, "new", "word"}}
    order = sorted(c, key=lambda w: (-c[w], codes[w]))
    weight = np.array([c[w] + 0.5 for w in order] + [0.5] * 256)
    kind = {w: order.index(w) if w in c else len(order) + codes[w] % 256 for w in codes}
    m = hmm._start_model(weight, s)
    start, move, emit = m.start, m.move, m.emit
    z = range(3)

    def likelihood(ws, first, last=None):
        """Sum over paths of states; with ``last`` those that hold it at a place."""
        total = 0.0
        for path in itertools.product(z, repeat=len(ws)):
            if last and any(path[t] != i for t, i in last):
                continue
            p = start[path[0]] * emit[kind[ws[0]], path[0]]
            for t in range(1, len(ws)):
                p *= move[path[t - 1], path[t]] * emit[kind[ws[t]], path[t]]
            total += p
        return total

    for _ in range(2):
        new_emit, new_move, new_start = np.full(emit.shape, 0.5), np.ones((3, 3)), np.ones(3)
        for ws in train:
            whole = likelihood(ws, None)
            for i in z:
                new_start[i] += likelihood(ws, None, [(0, i)]) / whole
                for t, w in enumerate(ws):
                    new_emit[kind[w], i] += likelihood(ws, None, [(t, i)]) / whole
                for j in z:
                    for t in range(len(ws) - 1):
                        new_move[i, j] += likelihood(ws, None, [(t, i), (t + 1, j)]) / whole
        start, move, emit = new_start / new_start.sum(), new_move / new_move.sum(axis=1, keepdims=True), new_emit / new_emit.sum(axis=0)
    for k, t in enumerate([*lines, "a new word b"]):
        assert abs(found[k] - math.log10(likelihood(t.split() + ["\n"], None))) < 1e-4


def test_model_probabilities_sum_to_one_and_beat_single_words(spark):
    rng = np.random.default_rng(5)
    words = [[f"{s}{k}" for k in range(30)] for s in "ab"]
    rows = [(k, " ".join(rng.choice(words[k % 2], 40)), None, None, None) for k in range(120)]
    found = hmm.hmm_scores(documents(spark, rows), F.col("doc_id") % 4 == 1, hmm.Settings(states=2, rounds=6)).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert found[1] > found[0]
    # All one-word texts out of the vocabulary, and one unknown word for each class, have a probability of 1 at most.
    assert hmm.hmm_scores(documents(spark, []), F.lit(False)).count() == 0
    only = hmm.hmm_scores(documents(spark, [(1, "a", None, None, None)]), F.lit(True)).first()
    assert only["train_tokens"] == 0 and only["n_known"] == 0


def test_hot_words_emit_by_themselves(spark):
    rng = np.random.default_rng(5)
    words = [[f"{s}{k}" for k in range(30)] for s in "ab"]
    rows = [(k, " ".join(rng.choice(words[k % 2], 40)), None, None, None) for k in range(120)]
    # One shared class tells no word from another.
    found = hmm.hmm_scores(documents(spark, rows), F.col("doc_id") % 4 == 1, hmm.Settings(states=2, rounds=6, most_classes=1)).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert found[1] > found[0] + 50


# Byte-level BPE


def test_pretokens_and_merges_equal_tiktoken(tik):
    vocabulary = bpe.Vocabulary.build(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert sorted(vocabulary.whole.order.tolist()) == list(range(len(vocabulary.words)))
    assert (vocabulary.whole.find(bpe.hash_words(vocabulary.words)) == np.arange(len(vocabulary.words))).all()
    encoder = bpe.Encoder(vocabulary)
    chars = st.sampled_from(list("aZé1½ '\n\t\xa0srelvdmt!,.#漢字٣​\x1c\x85\U0001f600")) | st.characters(exclude_categories=["Cs"])

    @given(st.lists(st.text(chars, max_size=40), max_size=5))
    @settings(max_examples=300, deadline=None)
    def check(many):
        ids, at = encoder.block(many)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [tik.encode_ordinary(t) for t in many]

    check()


def test_query_digests(spark, docs, nothing, tik):
    found = bpe.digests(bpe.encode_documents(docs, bpe.Tokenizer(spark))).collect()
    want = []
    for r in docs.collect():
        ids = tik.encode_ordinary(r["text"] or "")
        want.append(str((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())))
    assert sorted(want) == sorted(str(tuple(r)) for r in found)
    assert bpe.encode_documents(nothing, bpe.Tokenizer(spark)).count() == 0


def test_spans_of_one_hash_are_compared(monkeypatch):
    monkeypatch.setattr(vectext, "span_hashes", lambda symbols, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(2))
    words = "ab cd ab abcd x yz x cd abc abd abc ab".split()
    symbols, offsets = vectext.code_points(words)
    codes, where, _ = vectext.distinct_spans(symbols, offsets[:-1], offsets[1:])
    assert [words[where[c]] for c in codes] == words and len(where) == len(set(words))


def test_mirrored_words_have_hashes_of_their_own():
    for n in (16, 64, 256, 1024, 4096):
        one, two = mirrored(n)
        hashes, _ = vectext.ascii_words([f"{one} {two} {one}".encode()])
        assert hashes[0] == hashes[2] != hashes[1]


def test_memo_generations_do_not_change_results(tik, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    encoder = bpe.Encoder(bpe.Vocabulary.build(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))))
    for _ in range(2):
        for t in ("zxqv wqzzk", "ploughmanship zxqv", "wqzzk kkjjq vvbbn", "zxqv kkjjq"):
            assert encoder.block([t])[0].tolist() == tik.encode_ordinary(t)


# Quality


def test_quality_learns_shapes_and_scores_every_text(spark, docs, nothing):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    good = [" ".join(word() for _ in range(60)).capitalize() + "." for _ in range(60)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) if k % 2 else (word() + " ") * 60 for k in range(60)]
    rows = [(k, t, None, None, None) for k, t in enumerate([*good, *bad])]
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)] + [(3, None), (None, 1)], "doc_id long, quality int")
    table = documents(spark, rows)
    space = quality_knn.train(table, labels, ~quality_knn.fold("doc_id"))
    found = table.select("doc_id", quality_knn.quality_score(spark, space).alias("score")).collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 20 and all((r["score"] >= 0.5) == (r["doc_id"] < 60) for r in held)
    odd = docs.select(quality_knn.quality_score(spark, space).alias("score")).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert nothing.select(quality_knn.quality_score(spark, space)).count() == 0
    unlearnt = quality_knn.train(table, labels.limit(0), F.lit(True))
    assert {r[0] for r in table.select(quality_knn.quality_score(spark, unlearnt)).collect()} == {0.5}


def test_copies_of_an_id_leave_room_for_the_others(spark):
    rows = [(k, f"text {'!?' * k} number {k} " * 5, None, None, None) for k in range(6)]
    table = documents(spark, [rows[0]] * 60 + rows[1:] + [(1, "another text of one", None, None, None)])
    labels = spark.createDataFrame([(k, k / 8) for k in range(6)], "doc_id long, quality double")
    first, again = (quality_knn.train(t, labels, F.lit(True), quality_knn.Settings(most_labelled=6)) for t in (table, table.repartition(7)))
    assert sorted(first.quality.tolist()) == [k / 8 for k in range(6)]
    assert np.array_equal(first.labelled, again.labelled) and np.array_equal(first.quality, again.quality)


def test_scores_equal_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    lines = [" ".join(rng.choice(["alpha", "beta!", "GAMMA", "d 1", "e, f", "zeta"], rng.integers(1, 30))) for _ in range(40)] + ["", None]
    table = documents(spark, [(k, t, None, None, None) for k, t in enumerate(lines)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    s = quality_knn.Settings(dimensions=4, neighbours=5)
    space = quality_knn.train(table, labels, F.lit(True), s)
    found = {r["doc_id"]: r["score"] for r in table.select("doc_id", quality_knn.quality_score(spark, space, settings=s).alias("score")).collect()}
    counts = [collections.Counter() for _ in lines]
    for k, t in enumerate(lines):
        for _, term, count in zip(*(x.tolist() for x in quality_knn.term_counts([(t or "").encode()])), strict=True):
            counts[k][term] = count
    frequency = collections.Counter(t for c in counts[:30] for t in c)
    terms = sorted(frequency)

    def vector(c):
        out = np.zeros(len(terms))
        for words, length in ((False, 1.0), (True, s.words)):
            part = {t: (1 + math.log(n)) * (1 + math.log(30 / frequency[t])) for t, n in c.items() if t in frequency and (t >= quality_knn._OTHERS) == words}
            norm = math.sqrt(sum(x * x for x in part.values()))
            for t, x in part.items():
                out[terms.index(t)] = length * x / norm
        return out

    matrix = np.stack([vector(c) for c in counts])
    axes = np.linalg.svd(matrix[:30], full_matrices=False)[2][:4]
    points = quality_knn.unit(matrix @ axes.T)
    for k in range(len(lines)):
        near = sorted(((float(points[k] @ points[j]), j % 2) for j in range(30)), reverse=True)[:5]
        weights = [max(x, 0) ** s.power for x, _ in near]
        want = sum(w * q for w, (_, q) in zip(weights, near, strict=True)) / sum(weights) if sum(weights) > 1e-12 else 0.5
        assert abs(found[k] - want) < 0.02, (k, found[k], want)


def test_votes_equal_brute_force():
    rng = np.random.default_rng(4)
    space = quality_knn.Space(np.zeros(1), np.zeros(1), np.zeros((1, 1)), quality_knn.unit(rng.standard_normal((50, 6))), rng.integers(0, 2, 50).astype(float), 0.5)
    x = quality_knn.unit(rng.standard_normal((20, 6)))
    s = quality_knn.Settings(neighbours=7, power=3.0)
    for own, score in zip(x, space.scores(x, s), strict=True):
        near = sorted(((float(own @ y), q) for y, q in zip(space.labelled, space.quality, strict=True)), reverse=True)[:7]
        w = [max(c, 0) ** 3 for c, _ in near]
        assert abs(score - sum(a * q for a, (_, q) in zip(w, near, strict=True)) / sum(w)) < 1e-6


# Embeddings


def vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((30, 8))
    rows = [(k, base[k].tolist(), k % 3) for k in range(30)]
    rows += [(100 + k, (base[k % 6] + 0.02 * rng.standard_normal(8)).tolist(), k % 3) for k in range(60)]
    rows += [(200, base[0].tolist(), 0), (200, base[0].tolist(), 0), (201, (2 * base[0]).tolist(), 0), (202, base[0].tolist(), None), (203, None, 0), (204, [0.0] * 8, 0)]
    rows += [(205, [math.nan] * 8, 0), (206, [None] * 8, 0), (207, [math.inf] * 8, 0), (208, base[0].tolist()[:5], 0), (209, [], 0), (None, base[1].tolist(), 1)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, key string, score string").repartition(3)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [256, 4])
def test_near_vectors(spark, block):
    rows, table = vectors(spark)
    found = lsh_dedup.lsh_dedup(table, block=block).collect()
    n = len(rows)
    link = np.zeros((n, n), bool)
    for (a, x), (b, y) in itertools.combinations(enumerate(rows), 2):
        if usable(x[1]) and usable(y[1]) and x[2] is not None and x[2] == y[2] and len(x[1]) == len(y[1]) and any(x[1]) and any(y[1]):
            p, q = np.array(x[1]), np.array(y[1])
            link[a, b] = link[b, a] = p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.98
    label = ngram_join.forest(link)
    least = {k: min((rows[j][0] for j in range(n) if label[j] == k and rows[j][0] is not None), default=None) for k in set(label)}
    want = sorted(str((r[0], int(link[k].sum()), least[label[k]])) for k, r in enumerate(rows))
    assert want == sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in found)
    assert link.sum() > 100
    assert lsh_dedup.lsh_dedup(table.limit(0)).count() == 0


@pytest.mark.parametrize(("rows_in_block", "k"), [(256, 20), (4, 3)])
def test_top_k_equals_brute_force(spark, rows_in_block, k):
    rows, table = vectors(spark)
    rows = [r for r in rows if usable(r[1]) and r[1]]
    found = collections.defaultdict(list)
    for r in topk_search.topk_search(table, F.col("vec_id") % 20 == 0, k, block_rows=rows_in_block, page_blocks=2, sheet_pages=3).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for i, x, _ in {r[0]: r for r in rows if r[0] is not None and r[0] % 20 == 0}.values():
        q = np.floor(64 * np.array(x))
        scores = sorted((-int(q @ np.floor(64 * np.array(y))), j if j is not None else 2**62) for j, y, _ in rows if j != i and len(y) == len(x))
        want[i] = [(n, j if j < 2**62 else None, -s) for n, (s, j) in enumerate(scores[:k], 1)]
    assert dict(found) == want
    assert topk_search.topk_search(table.limit(0), F.lit(True)).count() == 0


def test_queries_visit_only_pages_that_their_scores_leave():
    import pyarrow as pa

    corner = np.array([[10.0, 10.0], [-1.0, -1.0], [3.0, 3.0]])  # one block's greatest values in each of three pages
    sheet = pa.Table.from_pylist([{"dimension": 2, "pages": np.array([7, 8, 9]).tobytes(), "least": (corner - 1).tobytes(), "greatest": corner.tobytes()}])
    queries = np.array([[1.0, 1.0], [-1.0, -1.0]])
    batch = pa.Table.from_pylist([{"number": 5, "dimension": 2, "matrix": queries.tobytes(), "floor": np.array([7, 3]).tobytes()}])
    first = topk_search._first_visits(topk_search._best_pages(sheet, batch)).to_pylist()
    assert {(r["page"], tuple(np.frombuffer(r["asks"], np.uint16).tolist())) for r in first} == {(7, (0,)), (8, (1,))}
    later = topk_search._later_visits(sheet, batch).to_pylist()
    assert {(r["page"], tuple(np.frombuffer(r["asks"], np.uint16).tolist())) for r in later} == {(7, (0,)), (8, (1,))}
    # The third page's bounds, 6 and -4, reach neither k-th score.
    everything = pa.Table.from_pylist([{"number": 5, "dimension": 2, "matrix": queries.tobytes(), "floor": np.array([-100, -100]).tobytes()}])
    assert len(topk_search._later_visits(sheet, everything)) == 3


def test_huge_components_do_not_fail(spark):
    rows = [(0, [1e308, -1e308]), (1, [1e308, 1.0]), (20, [3.4e38, 2.0]), (3, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk_search.topk_search(table, F.col("vec_id") % 20 == 0, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)] and found[0]["score"] == 2**63 - 1


# Licences


def plain_terms(text):
    """Labels, required labels, choices, permissive and unknown names of the longest beginning of a text that a recursive reading takes whole."""
    import re

    tokens = []
    for found in re.finditer(r"\s*(?:([A-Za-z0-9.+:-]+)|([()])|(\S|$))", text):
        if found[3] is not None or found[1] and not found[1].rstrip(".:-"):
            break
        tokens.append(found[2] or found[1].rstrip(".:-"))
        if (found[1] or "")[-1:] == ".":
            break
    for n in range(len(tokens), 0, -1):
        if found := read_whole(tokens[:n]):
            return found if found[0] else None
    return None


def read_whole(tokens):
    at = 0
    unknown = set()

    def peek():
        return tokens[at].lower() if at < len(tokens) else ""

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def name():
        if peek() in ("", "and", "or", "with", "(", ")"):
            raise ValueError
        return take()

    def atom():
        if peek() == "(":
            take()
            found = either()
            if peek() != ")":
                raise ValueError
            take()
            return found
        own = name()
        label = license_scan.licence(own)
        exception = ""
        if peek() == "with":
            take()
            exception = name()
            if peek() == "with":
                raise ValueError
            if exception.lower() not in license_scan.EXCEPTIONS:
                unknown.add(exception)
                exception = ""
        if label is None:
            unknown.add(own)
            return set(), set(), 1, False
        mild = label.removesuffix("-or-later") in license_scan.PERMISSIVE
        label += f"-with-{exception.lower()}" if exception else ""
        return {label}, {label}, 1, mild

    def both():
        found = atom()
        while peek() == "and":
            take()
            other = atom()
            found = found[0] | other[0], found[1] | other[1], found[2] * other[2], found[3] and other[3]
        return found

    def either():
        found = both()
        while peek() == "or":
            take()
            other = both()
            found = found[0] | other[0], found[1] & other[1], found[2] + other[2], found[3] or other[3]
        return found

    try:
        found = either()
        return (*found, unknown) if at == len(tokens) else None
    except ValueError:
        return None


def test_scan_equals_a_plain_search(docs, spark, nothing):
    more = ["Released under the MIT License. CC-BY NC cc by nc cc by nc", "APACHE license, Version 2.0 under the mit licensee", "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND ISC */\nLicense: not an ( expression"]
    more += ["License: MIT AND ISC", "License: MIT OR ISC", "License: unknown", "License: x License: GPL-3.0-or-later\nlicense: mit with llvm-exception", "License: (mit or isc) with llvm-exception"]
    more += ["SPDX-License-Identifier: MIT; License: Apache-2.0", "License: GPL-2.0-or-later AND Foo-1.0", "License: MIT (see LICENSE)", "License: MIT / Apache-2.0. License: see the file", "License: GPL-2.0 WITH Foo-exception or zlib.", "License: MIT and (", "License: SPDX-License-Identifier: isc"]
    table = documents(spark, [(k, t, None, None, None) for k, t in enumerate([*more, *texts()])])
    import re

    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = {r["doc_id"]: r for r in license_scan.license_scan(table).collect()}
    for r in table.collect():
        ws = word.findall((r["text"] or "").encode().lower())
        places = lambda phrases: [(k, label) for phrase, label in phrases.items() for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.encode().split()]  # noqa: B023, E731
        hits, notices = places(license_scan.BASE), places(license_scan.NOTICES)
        own = found[r["doc_id"]]
        assert own["n_words"] == len(ws) and own["places"] == sorted(k for k, _ in hits)
        assert own["base_labels"] == ",".join(sorted({x for _, x in hits}))
        lines = [re.split(r"(?i)(?:spdx-license-identifier|license):", x) for x in (r["text"] or "").split("\n")]
        terms = [t for x in lines for rest in x[1:] if (t := plain_terms(rest))]
        labels = {x for _, x in hits + notices}.union(*(t[0] for t in terms))
        assert own["labels"] == ",".join(sorted(labels))
        assert own["required"] == ",".join(sorted(set().union(*(t[1] for t in terms))))
        assert own["choices"] == (math.prod(t[2] for t in terms) if terms else 0)
        assert own["permissive"] == (all(t[3] for t in terms) if terms else None)
        assert own["unknown"] == ",".join(sorted(set().union(*(t[4] for t in terms))))
        assert abs(own["score"] - (1 - 0.5 ** len(hits + notices) * 0.1 ** len(terms))) < 1e-12
    assert found[2]["labels"] == "gpl-2-with-classpath-exception-2.0,isc,mit" and found[2]["choices"] == 2
    assert (found[3]["required"], found[4]["required"]) == ("isc,mit", "") and found[5]["labels"] == "" and found[7]["labels"] == "isc,mit"
    assert [found[k]["labels"] for k in range(8, 15)] == ["apache-2,mit", "gpl-2-or-later", "mit", "mit", "gpl-2,zlib", "mit", "isc"]
    assert (found[9]["unknown"], found[12]["unknown"]) == ("Foo-1.0", "Foo-exception")
    assert license_scan.license_scan(nothing).count() == 0


NAMES = st.sampled_from(["mit", "ISC", "GPL-2.0-only", "gpl-3.0-or-later", "LicenseRef-x", "Apache-2.0+", "unheard"])


@given(st.recursive(NAMES | NAMES.map(lambda x: f"{x} WITH LLVM-exception"), lambda x: st.tuples(x, st.sampled_from(["and", "OR"]), x).map(" ".join) | x.map("({})".format), max_leaves=12) | st.text("()", max_size=4))
@settings(max_examples=300, deadline=None)
def test_expressions_evaluate_as_a_recursive_reading(text):
    parsed = license_scan.parse(text)
    got = parsed and license_scan.evaluate(parsed[0])
    want = plain_terms(text)
    assert (got and (got[0], got[1].required, got[1].choices, got[1].permissive, got[2])) == want


def test_long_and_deep_licence_texts_take_linear_time():
    import time

    scan = license_scan._scan_texts(*license_scan._automata())
    begin = time.monotonic()
    assert scan(b"cc by nc " * 10**6)["places"] == list(range(0, 3 * 10**6, 3))
    assert scan(b"License: " * 200_000 + b"mit")["labels"] == "mit"
    assert scan(("License: " + " and ".join(["(mit or isc)"] * 70)).encode())["choices"] == 2**62
    assert len(scan(("License: " + " and ".join(f"LicenseRef-{k}" for k in range(50_000))).encode())["required"].split(",")) == 50_000
    assert time.monotonic() - begin < 20


def test_expressions_parse_by_precedence():
    assert license_scan.parse("a OR b AND c WITH d")[0] == ["a", "b", "c", "d", "with", "and", "or"]
    assert license_scan.parse("(a or b) and c")[0] == ["a", "b", "or", "c", "and"]
    for text, taken in (("a b", "a"), ("a AND", "a"), ("a)", "a"), ("a OR OR b", "a"), ("a ; b", "a"), ("(a or b) with c", "(a or b)"), ("a with (b)", "a"), ("a with b with c", "a with b"), ("a and (b or c", "a"), (" a or b. And so on", "a or b.")):
        assert license_scan.parse(text)[1] == taken
    for bad in ("", "(a", "AND a", "()", "; a", "... a"):
        assert license_scan.parse(bad) is None


# Near duplicates


def brute_classes(rows, similarity=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    link = np.zeros((n, n), bool)
    for a, b in itertools.combinations(range(n), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity:
            link[a, b] = link[b, a] = True
    return sets, link, ngram_join.forest(link)


@pytest.mark.parametrize("block", [256, 2])
def test_ngram_join_equals_brute_force(docs, nothing, block):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets, link, label = brute_classes(rows)
    least = {k: min((rows[j][0] for j in range(len(rows)) if label[j] == k and rows[j][0] is not None), default=None) for k in set(label)}
    found = ngram_join.ngram_join(docs, bucket_block=block, verify_block=block).collect()
    want = sorted(str((rows[k][0], len(sets[k]), least[label[k]], int(link[k].sum()))) for k in range(len(rows)))
    assert want == sorted(str((r["doc_id"], r["n_grams"], r["class_id"], r["n_links"])) for r in found)
    assert ngram_join.ngram_join(nothing).count() == 0


def test_many_repeats_of_a_row_are_one_set(spark):
    rows = [(7, BASE, "en", "s", None)] * 3000 + [(8, BASE + "and a few words", "en", "s", None), (9, "something else", "en", "s", None)]
    table = documents(spark, rows)
    found = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in ngram_join.ngram_join(table).distinct().collect()}
    assert found == {7: (7, 3000, True), 8: (7, 3000, False), 9: (9, 0, True)}
    plan = ngram_join.ngram_join(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan
    kept = ngram_join.one_of_each(table)
    assert sorted(r["doc_id"] for r in kept.collect()) == [7, 9]


def test_one_document_of_each_class_stays(docs, nothing):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets, _, label = brute_classes(rows)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({label[k] for k in range(len(rows)) if sets[k]}) + sum(not s for s in sets)
    assert ngram_join.one_of_each(nothing).count() == 0


def test_bands_reach_their_recall():
    for similarity, recall in ((0.8, 0.9999), (0.9, 0.99)):
        p = ngram_join.Plan.of(similarity, recall)
        assert 1 - (1 - similarity**p.rows) ** p.bands >= recall and p.hashes <= 256


def test_word_hashes_tell_words_apart():
    words, first = vectext.ascii_words([b"a b\tA", b"", b"  ab \x0b a\xc3\xa9"])
    assert first.tolist() == [0, 3, 3, 5] and words[0] == words[2] and len(set(words.tolist())) == 4
    assert json.dumps([int(x) for x in first])
