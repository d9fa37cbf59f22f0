"""Features of raw files, kept: only files that changed are read again.

A manifest has a row for each source file: its path, length, time, a hash of its lines
and the part of the store that holds its cell's features. What a file's listing
says decides first, so an unchanged file isn't opened; a file whose listing changed is
hashed, and extracted only if its lines did. A new manifest is a new folder that
counts once Spark's writer has committed it, so readers see the old or the new one
and an update that dies leaves the old. Files that are gone drop out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvana.sources.cycler import cell_id_of

_MANIFEST = "path string, length long, time timestamp, hash string, cell_id string, part string"


def listing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, length, time`` of source files, without opening them."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", "length", F.col("modificationTime").alias("time"))


def line_hashes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, hash``: two sums over the hashes of a file's lines and their number; blocks of one file are summed apart first."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), "value")
    sums = (F.sum(F.xxhash64(*x, "value").cast("decimal(38,0)")) for x in ((), (F.lit(1),)))
    return lines.groupBy("path").agg(F.concat_ws(":", F.count("*"), *(s.cast("string") for s in sums)).alias("hash"))


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Committed manifests, by Hadoop's listing."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(path, "v=*/_SUCCESS")) or []
    return sorted(int(x.getPath().getParent().getName().removeprefix("v=")) for x in found)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest committed manifest; empty where there is none."""
    have = _versions(spark, folder)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest/v={have[-1]}") if have else spark.createDataFrame([], _MANIFEST)


def update(spark: SparkSession, paths: Sequence[str], folder: str, extract: Callable[[list[str]], DataFrame]) -> DataFrame:
    """Features of all source files; ``extract`` gives those (with cell_id) of the files it is handed, which are the changed ones.

    The names of changed files come to the driver. A file is a cell, told by its path.
    """
    now, before = listing(spark, paths), manifest(spark, folder)
    moved = now.join(before, ["path", "length", "time"], "left_anti")
    asked = [r["path"] for r in moved.select("path").collect()]
    gone = before.join(now, "path", "left_anti").limit(1).count()
    if not asked and not gone:
        return features(spark, folder)
    hashes = line_hashes(spark, asked) if asked else spark.createDataFrame([], "path string, hash string")
    hashed = moved.join(hashes.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")), "path", "left").withColumn("hash", F.coalesce("hash", F.lit("0")))
    known = before.select("path", "hash", F.col("part"))
    placed = hashed.join(known, ["path", "hash"], "left").select("path", "length", "time", "hash", "part").collect()
    fresh = sorted(r["path"] for r in placed if r["part"] is None)
    part = uuid.uuid4().hex
    if fresh:
        extract(fresh).write.parquet(f"{folder}/parts/part={part}")
    rows = [(r["path"], r["length"], r["time"], r["hash"], r["part"] or part) for r in placed]
    renewed = spark.createDataFrame(rows, "path string, length long, time timestamp, hash string, part string").withColumn("cell_id", cell_id_of("path"))
    kept = before.join(now, ["path", "length", "time"], "left_semi")
    version = max([0, *_versions(spark, folder)]) + 1
    kept.unionByName(renewed).write.parquet(f"{folder}/manifest/v={version}")
    return features(spark, folder)


def features(spark: SparkSession, folder: str) -> DataFrame:
    """The features that the newest manifest names."""
    own = manifest(spark, folder)
    parts = [r["part"] for r in own.select("part").distinct().collect()]
    if not parts:
        raise ValueError(f"no features in {folder}")
    table = spark.read.option("basePath", f"{folder}/parts").option("mergeSchema", True).parquet(*(f"{folder}/parts/part={p}" for p in parts))
    return table.join(own.select("part", "cell_id").distinct(), ["part", "cell_id"], "left_semi").drop("part")
