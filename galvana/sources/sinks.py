"""Writers of feature tables with their provenance."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_hash(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order: sums of two row hashes and the count."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    flags = [c.isNull() for c in columns]
    low = F.sum(F.xxhash64(*flags, *columns).cast("decimal(38,0)"))
    other = F.sum(F.xxhash64(F.lit(1), *flags, *columns).cast("decimal(38,0)"))
    r = df.agg(F.count("*"), low, other).first()
    return hashlib.sha256(json.dumps([sorted(df.columns), *map(str, r)]).encode()).hexdigest()


def provenance(source: DataFrame, result: DataFrame, config: dict | None = None) -> dict:
    """What a table came from: hashes of input, configuration and schema."""
    canonical = json.dumps(config or {}, sort_keys=True, default=str)
    return {
        "input_hash": content_hash(source),
        "config_hash": hashlib.sha256(canonical.encode()).hexdigest(),
        "columns": [[f.name, f.dataType.simpleString(), f.metadata] for f in result.schema.fields],
        "spark": result.sparkSession.version,
    }


def _flat(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON, for formats without them."""
    nested = T.StructType, T.ArrayType, T.MapType
    return df.select(*(F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields))


def write_table(df: DataFrame, path: str) -> None:
    """Parquet or CSV by the path's suffix; an existing table is never overwritten."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        df.write.mode("errorifexists").parquet(path)
    else:
        _flat(df).write.mode("errorifexists").option("header", True).csv(path)


def save_features(df: DataFrame, path: str, source: DataFrame | None = None, config: dict | None = None) -> None:
    """A table and, beside it, its metadata as one JSON line, both through Spark's writers."""
    write_table(df, path)
    meta = provenance(source if source is not None else df, df, config) | {"table_hash": content_hash(df)}
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}.metadata")


def load_features(spark, path: str, check: bool = True) -> DataFrame:
    """A saved Parquet table; with ``check`` its rows must give the hash in its metadata."""
    df = spark.read.parquet(path)
    if check:
        meta = json.loads(spark.read.text(f"{path}.metadata").first()[0])
        if content_hash(df) != meta["table_hash"]:
            raise ValueError(f"{path} is not what its metadata describes")
    return df
