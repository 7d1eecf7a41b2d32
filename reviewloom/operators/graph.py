"""Connected components of an undirected graph by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.sources.tables import discard, materialize

#: Rounds after which propagation must have converged; each round at least halves the longest path of every component.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("least")).withColumn("least", F.least("least", "src"))
    joined = both.join(least, "src").where("dst > src")
    return joined.select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them; edges run from larger to smaller nodes."""
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    joined = edges.join(least, "src")
    moved = joined.select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.union(least.select("src", F.col("least").alias("dst"))).where("src <> dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (src, dst); the component is named by its smallest node.

    Nodes may be of any type that sorts. Self loops, repeated and reversed edges change nothing; NULL ends are left out; a
    node that has only self loops is not returned; no edges give an empty result. Minimum labels move along stars, whose
    centres are never gathered: each round is two grouped minima and joins, and ends in a table in the shared folder.
    """
    current = materialize(
        edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    )
    mark = None
    for _ in range(MAX_ROUNDS):
        following = materialize(_small_star(_large_star(current)))
        new_mark = tuple(following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        discard(current)
        current = following
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"labels still move after {MAX_ROUNDS} rounds")
    members = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return members.union(current.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()
