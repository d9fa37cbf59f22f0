"""The pipeline's stages one by one against brute force, and the whole run."""

import base64
import collections
import hashlib
import os

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from galvana.llm import ngram_join, quality_knn

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_hand_on_what_they_keep(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{k}")
        stage(spark, docs, DATA).write.parquet(path)
        seen[name] = (docs, out := spark.read.parquet(path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out

    before, after = seen["quality classifier"]
    kept = {r[0] for r in after.select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    known = [r[0] for r in before.select("doc_id").collect() if r[0] in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in known) >= 0.95 * len(known)

    before, after = seen["n-gram Jaccard join"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    assert {r[0] for r in after.select("doc_id").collect()} == {min(g) for g in groups.values()}

    before, after = seen["mixing sources"]
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    taken, size = (t.agg(F.sum(words)).first()[0] for t in (after, before))
    longest = before.agg(F.max(words)).first()[0] * before.select("source").distinct().count()
    assert abs(taken - size) <= longest
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3

    before, after = seen["byte-level BPE"]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in before.select("doc_id", "text").collect():
        ids = tik.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], ids, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(want) == sorted((r["doc_id"], list(r["ids"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after.collect())


def test_run_equals_the_stages_in_turn_and_empty_tables_pass(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    nothing = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DATA).count() == 0


def test_stages_take_nulls_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (1, "", None, "s", 0), (None, "a b", None, "s", 3)], docs.schema)
    table = docs.unionByName(docs).unionByName(odd)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, DATA).count() > 0
    assert ngram_join.one_of_each(docs.unionByName(docs)).count() == ngram_join.one_of_each(docs).count()
    assert quality_knn.TERMS > 0
