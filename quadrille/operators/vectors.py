"""Vector search: exact over all rows, or over the cells of an index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.functions import vector

#: Rows that the cells' centres are fitted on; their number is bounded and documented, every row is indexed.
SAMPLE = 20_000


def centres(vectors: DataFrame, cells: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Unit centres of ``(id, vector)`` by spherical k-means over at most ``SAMPLE`` rows, chosen by a hash of their ids."""
    rows = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("vector").toPandas()["vector"]
    x = np.array(rows.tolist(), float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return c


def _nearest_cells(v, found: np.ndarray, n: int):
    """The ``n`` likest cells of a vector, likest first."""
    listed = F.from_json(F.lit(str(found.round(6).tolist())), "array<array<double>>")
    scored = F.transform(listed, lambda c, i: F.struct((-vector.dot(c, v)).alias("s"), i.alias("cell")))
    return F.slice(F.transform(F.array_sort(scored), lambda s: s["cell"]), 1, n)


def indexed(vectors: DataFrame, found: np.ndarray) -> DataFrame:
    """Every row of ``(id, vector)`` with its ``cell``; write it partitioned by ``cell``, so that a search reads the cells it looks into."""
    return vectors.withColumn("cell", F.get(_nearest_cells(F.col("vector"), found, 1), F.lit(0)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, index: np.ndarray | None = None, look: int = 4) -> DataFrame:
    """``(query, id, distance, rank)``: the ``k`` nearest rows by cosine distance of each of the queries ``(query, q)``, itself left out.

    Without an index every row is compared with every query of the stated set, exactly.  With one, a
    query meets the rows of the ``look`` likest cells.  Each task keeps the first ``k`` of a query before rows are moved.
    """
    if index is None:
        pairs = vectors.select("id", "vector").crossJoin(F.broadcast(queries))
    else:
        rows = vectors if "cell" in vectors.columns else indexed(vectors, index)
        asked = queries.withColumn("cell", F.explode(_nearest_cells(F.col("q"), index, look)))
        pairs = rows.select("id", "vector", "cell").join(F.broadcast(asked), "cell")
    near = pairs.filter("id <> query").select("query", "id", vector.cosine_distance(F.col("vector"), F.col("q")).alias("distance"))
    return near.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))).filter(F.col("rank") <= k)
