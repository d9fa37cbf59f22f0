"""A corpus pipeline: quality, near duplicates, source mix, tokens.

Each stage takes the documents that the one before it kept and returns the
columns of documents; the last returns token ids. Nulls and empty texts: the
quality classifier scores them like empty texts, documents without words have
no near duplicates and stay, the mix takes documents of no words as often as the
whole part of their source's share says, and they encode to no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvana.llm import bpe, mixing, ngram_join, quality_knn
from galvana.shared import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    space = quality_knn.train(docs, labels, ~quality_knn.fold("doc_id"))
    return docs.where(quality_knn.quality_score(spark, space, docs["text"]) >= 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that word 5-grams join at a Jaccard index of 0.8 or more."""
    return ngram_join.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources by weights 5, 2, 1 in turn takes them."""
    return mixing.take_mix(docs, mixing.mix_sources(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, their number, and digests of the ids and of the bytes that they decode to."""
    encoded = bpe.encode_documents(docs, bpe.Tokenizer(spark))
    return bpe.digests(encoded, "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = cut(docs, f"stage{k}")
    return docs


#: The classifier and the mix are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None
