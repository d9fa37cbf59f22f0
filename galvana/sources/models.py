"""Models as Parquet tables of plain columns: one row a node, one row a forest, with a version.

``nodes`` holds kind, grp, tree, node, feature (a column's name; null in a leaf),
threshold, left, right and either the class shares (forests of labels) or the
path length (isolation forests); ``forests`` holds what belongs to a whole forest.
Nothing is pickled, so any reader of Parquet can score with them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from galvana.operators import forest, isolation

VERSION = 1
_NODES = "version int, kind string, grp string, tree int, node int, feature string, threshold double, left int, right int, share array<double>, length double"
_FORESTS = "version int, kind string, by string, grp string, columns array<string>, classes array<string>, center array<double>, scale array<double>, size long, watch double, alert double, oob double"


def save(spark: SparkSession, model: forest.Forests | isolation.Forest, path: str) -> str:
    """Write a model below ``path``, over what stands there."""
    nodes, heads = [], []
    if isinstance(model, isolation.Forest):
        heads.append((VERSION, "isolation", None, "", list(model.columns), [], model.center.tolist(), model.scale.tolist(), int(model.size), float(model.watch), float(model.alert), None))
        for t, tree in enumerate(model.trees):
            for k, (f, value, left, right, length) in enumerate(zip(*(a.tolist() for a in tree), strict=True)):
                nodes.append((VERSION, "isolation", "", t, k, model.columns[f] if f >= 0 else None, value, left, right, None, length))
    else:
        for grp, own in model.members.items():
            heads.append((VERSION, "labels", model.by, grp, list(own.columns), list(own.classes), own.center.tolist(), None, own.rows, None, None, own.oob))
            for t, tree in enumerate(own.trees):
                for k, (f, value, left, right, share) in enumerate(zip(*(a.tolist() for a in (tree.feature, tree.threshold, tree.left, tree.right, tree.share)), strict=True)):
                    nodes.append((VERSION, "labels", grp, t, k, own.columns[f] if f >= 0 else None, value, left, right, share, None))
    spark.createDataFrame(nodes, _NODES).repartition("grp", "tree").write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame(heads, _FORESTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/forests")
    return path


def load(spark: SparkSession, path: str) -> forest.Forests | isolation.Forest:
    """The model below ``path``; an unknown version is an error."""
    heads = spark.read.parquet(f"{path}/forests").collect()
    if {r["version"] for r in heads} - {VERSION}:
        raise ValueError(f"model at {path} has version {sorted({r['version'] for r in heads})}, this library reads {VERSION}")
    found: dict[tuple[str, int], list] = {}
    for r in spark.read.parquet(f"{path}/nodes").collect():
        found.setdefault((r["grp"], r["tree"]), []).append(r)
    for own in found.values():
        own.sort(key=lambda r: r["node"])

    def trees_of(head, make):
        place = {c: k for k, c in enumerate(head["columns"])}
        chosen = sorted((t, own) for (grp, t), own in found.items() if grp == head["grp"])
        return tuple(make(np.array([place.get(r["feature"], -1) for r in own]), own) for _, own in chosen)

    def numbers(own, name):
        return np.array([r[name] for r in own])

    if heads and heads[0]["kind"] == "isolation":
        (head,) = heads
        grown = trees_of(head, lambda f, own: (f, numbers(own, "threshold"), numbers(own, "left"), numbers(own, "right"), numbers(own, "length")))
        return isolation.Forest(tuple(head["columns"]), np.array(head["center"]), np.array(head["scale"]), grown, head["size"], head["watch"], head["alert"])
    members = {
        head["grp"]: forest.Forest(
            tuple(head["columns"]), tuple(head["classes"]), np.array(head["center"]),
            trees_of(head, lambda f, own: forest.Tree(f, numbers(own, "threshold"), numbers(own, "left"), numbers(own, "right"), np.array([r["share"] for r in own]))),
            head["size"], head["oob"],
        )
        for head in heads
    }
    return forest.Forests(heads[0]["by"] if heads else None, members)


def save_table(table: DataFrame, path: str) -> str:
    """Write a small model that is a table (centroids, golden references), each row with the version."""
    from pyspark.sql import functions as F

    table.select(F.lit(VERSION).alias("version"), "*").write.mode("overwrite").parquet(path)
    return path


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """What ``save_table`` wrote; an unknown version is an error."""
    table = spark.read.parquet(path)
    if [r["version"] for r in table.select("version").distinct().collect()] not in ([VERSION], []):
        raise ValueError(f"table at {path} has another version than {VERSION}")
    return table.drop("version")
