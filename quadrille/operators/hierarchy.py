"""Trees of classes or regions as ``(child, parent)`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.sources.entities import shared_checkpoints


def closure(tree: DataFrame) -> DataFrame:
    """``(node, ancestor, distance)`` for every node and ancestor, itself at distance 0.

    Distances double each round, and rounds go on until none adds a row; each is cut by a checkpoint.
    """
    nodes = tree.select(F.col("child").alias("node")).union(tree.select(F.col("parent").alias("node")).filter("node is not null")).distinct()
    out = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")).unionByName(tree.filter("parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))).distinct()
    shared_checkpoints(tree.sparkSession)
    out, before = out.checkpoint(), 0
    while (now := out.count()) != before:
        a, b, before = out.alias("a"), out.alias("b"), now
        paths = a.join(b, F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node"), F.col("b.ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        out = paths.groupBy("node", "ancestor").agg(F.min("distance").alias("distance")).checkpoint()
    return out


def tree_distance(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """Steps between two nodes by their nearest common ancestor, for ``pairs`` ``(a, b)``."""
    up = lambda c: paths.select(F.col("node").alias(c), "ancestor", F.col("distance").alias(f"d{c}"))
    return pairs.join(up("a"), "a").join(up("b"), ["b", "ancestor"]).groupBy("a", "b").agg(F.min(F.struct((F.col("da") + F.col("db")).alias("d"), F.col("ancestor"))).alias("m")).select("a", "b", F.col("m.d").alias("distance"), F.col("m.ancestor").alias("common"))
