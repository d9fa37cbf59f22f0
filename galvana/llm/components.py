"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galvana.shared import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("m").alias("a")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node's smaller neighbours and the node itself to the smallest of them; b is the larger end."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return moved.unionByName(least.select("b", F.col("m").alias("a"))).distinct()


#: Edges of a file of a step's table, and files at least.
FILE_EDGES, LEAST_FILES = 250_000, 8


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node that an edge touches.

    The component is the smallest node that links reach. Edges may repeat, run
    both ways or be loops (which link nothing); an edge with a null end is
    ignored. Each step is written to the shared folder, so lineage stays short;
    all joins are on nodes against one pre-aggregated row a node, which lets
    Spark split a hub's rows. Nothing but a count and a checksum is collected.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    now = cut(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    was, mark = None, _print(now)
    while mark != was:
        # A step's edges are about as many as the last one's; small steps leave few files.
        now = cut(_small_star(_large_star(now)).coalesce(max(LEAST_FILES, mark[0] // FILE_EDGES)), "stars")
        was, mark = mark, _print(now)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def linked_classes(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``key, class_id, n_links`` of every class of equal rows.

    ``classes`` has ``key, least, copies``: the smallest id and the number of a
    class's rows. ``found`` has ``key, links, root``: rows that a class links with
    in some pair of blocks, and another class in the same component. class_id is
    the smallest id of the component; n_links counts a row's copies as well.
    """
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    group = components(found, "root", "key").withColumnRenamed("node", "key")
    named = (
        classes.select("key", "least", "copies")
        .join(links, "key", "left")
        .join(group, "key", "left")
        .select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
    )
    least = named.groupBy("component").agg(F.min("least").alias("class_id"))
    return named.join(least, "component").select("key", "class_id", "n_links")
