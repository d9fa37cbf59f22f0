"""Isolation forest over cycle tables: each tree from rows of its own, scores in every task."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galvana.shared import cut


#: Rows that go down all trees at once.
_ROWS = 512


@dataclass(frozen=True)
class Forest:
    """Trees as arrays of feature, threshold, children and depth, with medians, scales and flag thresholds."""

    columns: tuple[str, ...]
    center: np.ndarray
    scale: np.ndarray
    trees: tuple[tuple[np.ndarray, ...], ...]
    size: int
    watch: float = 0.0
    alert: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher for rows that fewer splits set apart."""
        x = (np.where(np.isfinite(x), x, self.center) - self.center) / self.scale
        # All trees go down together, by blocks of rows; a leaf is its own child, so every step is the same for all.
        sizes = [len(t[0]) for t in self.trees]
        roots = np.cumsum([0, *sizes[:-1]])
        leaf = np.concatenate([t[0] < 0 for t in self.trees])
        feature, threshold, length = (np.concatenate([t[k] for t in self.trees]) for k in (0, 1, 4))
        feature = np.where(leaf, 0, feature)
        at = np.arange(len(leaf))
        left, right = (np.where(leaf, at, np.concatenate([t[k] + r for t, r in zip(self.trees, roots, strict=True)])) for k in (2, 3))
        children = np.stack([right, left], axis=1).ravel()
        depth = np.zeros(len(x))
        for a in range(0, len(x), _ROWS):
            own = np.ascontiguousarray(x[a : a + _ROWS].T)
            place, n = np.arange(own.shape[1]), own.shape[1]
            node = np.repeat(roots[:, None], n, axis=1)
            while True:
                low = own.ravel().take(feature.take(node) * n + place) < threshold.take(node)
                below = children.take(2 * node + low)
                if np.array_equal(below, node):
                    break
                node = below
            for one in length.take(node):
                depth[a : a + _ROWS] += one
        return 2.0 ** (-depth / len(self.trees) / max(_path(self.size), 1e-9))


def _path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _tree(x: np.ndarray, rng: np.random.Generator, most: int) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        k = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + _path(len(rows))])
        span = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(x.shape[1])
        if depth < most and len(rows) > 1 and span.any():
            f = int(rng.choice(np.flatnonzero(span)))
            lo = x[rows, f].min()
            t = lo + rng.random() * span[f]
            low = x[rows, f] < t
            nodes[k][:2] = [f, t]
            nodes[k][2] = grow(rows[low], depth + 1)
            nodes[k][3] = grow(rows[~low], depth + 1)
        return k

    grow(np.arange(len(x)), 0)
    a = np.array(nodes)
    return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]


def _finite(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _quantiles(values: DataFrame, at: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles, between neighbours in proportion, of each ``name``'s ``value`` in a table of both.

    Distinct values are range-partitioned and counted, and only the rows at the wanted ranks are collected.
    """
    counts = cut(values.groupBy("name", "value").agg(F.count("*").alias("n")).sort("name", "value").withColumn("part", F.spark_partition_id()), "ranks")
    base, total = [], {}
    for r in sorted(counts.groupBy("name", "part").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r["name"], r["part"])):
        base.append((r["name"], r["part"], total.get(r["name"], 0)))
        total[r["name"]] = total.get(r["name"], 0) + r["n"]
    if not total:
        return {}
    ranks = {name: sorted({k for q in at for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}) for name, n in total.items()}
    spark = values.sparkSession
    bases = spark.createDataFrame(base, "name string, part int, base long")
    wanted = spark.createDataFrame([(name, k) for name, own in ranks.items() for k in own], "name string, rank long")
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("name", "part").orderBy("value"))
    found = counts.join(F.broadcast(bases), ["name", "part"]).withColumn("upto", upto).join(F.broadcast(wanted), "name")
    value = {(r["name"], r["rank"]): r["value"] for r in found.where("rank < upto and rank >= upto - n").collect()}

    def between(name: str, place: float) -> float:
        lo, hi = value[name, math.floor(place)], value[name, math.ceil(place)]
        return lo + (hi - lo) * (place - math.floor(place))

    return {name: [between(name, q * (n - 1)) for q in at] for name, n in total.items()}


def train(table: DataFrame, columns: Sequence[str], trees: int = 100, size: int = 256, seed: int = 42, keys: Sequence[str] = ("cell_id", "cycle")) -> Forest:
    """Medians, scales and the quantiles 0.75 and 0.90 of the scores are those of all rows.

    Each tree is grown in a task, from ``size`` rows of its own: the first by a hash
    of the ``keys``, which tell rows apart, and of the tree. Keys and columns are written once,
    as every step reads them.
    """
    return _trained(_written(table, columns, keys), columns, trees, size, seed, keys)[0]


def fit_predict(table: DataFrame, columns: Sequence[str], trees: int = 100, size: int = 256, seed: int = 42, keys: Sequence[str] = ("cell_id", "cycle")) -> DataFrame:
    """``anomaly, flag`` of every row by a forest of the same rows, as ``predict`` after ``train``; the table is read and scored once."""
    forest, scored = _trained(_written(table, columns, keys), columns, trees, size, seed, keys)
    known = F.col("anomaly").isNotNull() & ~F.isnan("anomaly")
    flag = F.when(~known, "unknown").when(F.col("anomaly") >= forest.alert, "alert").when(F.col("anomaly") >= forest.watch, "watch").otherwise("ok")
    return scored.select(*keys, "anomaly", flag.alias("flag"))


def _written(table: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return cut(table.select(*keys, *(_finite(c).alias(c) for c in columns)), "isolation_rows")


def _trained(x: DataFrame, columns: Sequence[str], trees: int, size: int, seed: int, keys: Sequence[str]) -> tuple[Forest, DataFrame]:
    """The forest of written rows, and their keys with ``anomaly``."""
    total = x.agg(F.count("*"), *(F.stddev_pop(c) for c in columns)).first()
    n, size = total[0], min(size, total[0])
    long = x.select(F.explode(F.array(*(F.struct(F.lit(str(k)).alias("name"), F.col(c).alias("value")) for k, c in enumerate(columns)))).alias("r")).select("r.*")
    medians = _quantiles(long.where("value is not null"), [0.5])
    center = np.array([medians.get(str(k), [0.0])[0] for k in range(len(columns))])
    scale = np.array([v if v and v > 0 else 1.0 for v in total[1:]])
    if not size:
        forest = Forest(tuple(columns), center, scale, (), 0)
        return forest, predict(x, forest, keys).drop("flag")
    most = int(np.ceil(np.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        own = pdf.sort_values(["_h", *columns], kind="stable")[list(columns)].to_numpy(float)[:size]
        own = (np.where(np.isfinite(own), own, center) - center) / scale
        nodes = np.stack(_tree(own, np.random.default_rng([seed, tree]), most), axis=1)
        return pd.DataFrame({"tree": [tree], "nodes": [nodes.astype(float).tobytes()]})

    def hashed(tree) -> Column:
        return F.xxhash64(*keys, F.lit(seed), tree)

    # Rows below a share of the hashes that leaves four times a tree's rows, so none comes short.
    span = 1 << 40
    share = F.lit(min(span, math.ceil(span * 4 * size / n)))
    drawn = x.withColumn("_tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(hashed(t), F.lit(span)) < share)))
    drawn = drawn.withColumn("_h", F.pmod(hashed(F.col("_tree")), F.lit(span))).select("_tree", "_h", *columns)
    found = sorted(drawn.groupBy("_tree").applyInPandas(grow, "tree int, nodes binary").collect(), key=lambda r: r["tree"])
    nodes = (np.frombuffer(r["nodes"]).reshape(-1, 5) for r in found)
    grown = tuple((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]) for a in nodes)
    forest = Forest(tuple(columns), center, scale, grown, size)
    scored = cut(predict(x, forest, keys).drop("flag"), "isolation_scores")
    scores = scored.select(F.lit("score").alias("name"), _finite("anomaly").alias("value")).where("value is not null")
    watch, alert = _quantiles(scores, [0.75, 0.90]).get("score", [0.0, 0.0])
    return dataclasses.replace(forest, watch=watch, alert=alert), scored


def predict(table: DataFrame, forest: Forest, keys: Sequence[str]) -> DataFrame:
    """``anomaly, flag`` of every row; a row without any value is unknown."""
    sent = table.sparkSession.sparkContext.broadcast(forest)
    types = dict(table.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "anomaly double", "flag string"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = sent.value
        for pdf in parts:
            x = pdf[list(f.columns)].to_numpy(float)
            known = np.isfinite(x).any(axis=1) & bool(f.trees)
            s = f.scores(x) if f.trees else np.full(len(x), np.nan)
            flag = np.where(~known, "unknown", np.where(s >= f.alert, "alert", np.where(s >= f.watch, "watch", "ok")))
            yield pdf[list(keys)].assign(anomaly=np.where(known, s, np.nan), flag=flag)

    return table.select(*keys, *(F.col(c).cast("double").alias(c) for c in forest.columns)).mapInPandas(run, schema)
