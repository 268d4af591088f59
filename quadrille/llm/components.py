"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import cut

#: Edges of at most so many are joined in one task, at 32 bytes each; beyond that by steps over the whole table.
ONE_TASK = 1_000_000


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``(id, component)`` of every vertex of edges ``(x, y)``; a component is its smallest id.

    Loops and repeated edges change nothing; edges with a null end are left out.
    """
    edges = cut(edges.filter("x is not null and y is not null and x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    return _joined(edges) if edges.count() <= one_task else _stars(edges)


def _joined(edges: DataFrame) -> DataFrame:
    """The components of a few edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
        if not parts:
            return
        ids, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        label = np.arange(len(ids))
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], least)
            np.minimum.at(new, label[b], least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        yield pa.record_batch([pa.array(ids), pa.array(ids[label])], ["id", "component"])

    return edges.coalesce(1).mapInArrow(run, "id long, component long")


def _stars(star: DataFrame) -> DataFrame:
    """The components of many edges ``x > y``, distinct.

    Each step needs the least neighbour of a vertex: a sum that is made before rows are
    moved, joined back as one row for each vertex, so the edges of a hub can be dealt to many
    tasks.  The work of each round is cut by a checkpoint.  Rounds go on until nothing changes.
    """
    before = None
    while True:
        # large star: every larger neighbour goes to the least of the neighbours and the vertex
        both = star.select("x", "y").union(star.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()
        # small star: the vertex and its smaller neighbours go to the least of them
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("x", F.col("m").alias("y")))
        star = cut(small.filter("x <> y").distinct())
        now = star.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return star.select(F.col("x").alias("id"), F.col("y").alias("component")).union(star.select("y", F.col("y").alias("c")).distinct())
