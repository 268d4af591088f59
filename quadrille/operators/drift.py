"""Drift between snapshots: spectra, vertex loadings, point clouds, and series of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.functions import vector


def spectral(prints: DataFrame, by: str = "region", order: str = "snapshot_id") -> DataFrame:
    """Each fingerprint against the one before: distance of the spectra, and changes of the first value and the gap."""
    w = W.partitionBy(by).orderBy(order)
    before = F.lag("eigenvalues").over(w)
    out = prints.withColumn("__b", before).filter(F.col("__b").isNotNull())
    gap = lambda c: F.element_at(c, -1) - F.get(c, F.lit(0))
    v, b = F.col("eigenvalues"), F.col("__b")
    return out.select(by, order, vector.l2(v, b).alias("distance"), (F.get(v, F.lit(0)) - F.get(b, F.lit(0))).alias("first_delta"), (gap(v) - gap(b)).alias("gap_delta"))


def vertices(before: DataFrame, after: DataFrame) -> DataFrame:
    """Drift of the loadings ``(id, loadings)`` of shared vertices: cosine distance once each component's sign agrees."""
    a = before.select("id", F.posexplode("loadings").alias("k", "a"))
    b = after.select("id", F.posexplode("loadings").alias("k", "b"))
    both = a.join(b, ["id", "k"])
    signs = both.groupBy("k").agg(F.when(F.sum(F.col("a") * F.col("b")) < 0, -1.0).otherwise(1.0).alias("s"))
    turned = both.join(F.broadcast(signs), "k").withColumn("b", F.col("b") * F.col("s"))
    g = turned.groupBy("id").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    n = F.sqrt(F.col("aa") * F.col("bb"))
    return g.select("id", F.when(n == 0, 0.0).otherwise(1 - F.col("ab") / F.when(n == 0, 1.0).otherwise(n)).alias("drift"))


def sliced_wasserstein(left: DataFrame, right: DataFrame, dims: int, projections: int = 100, seed: int = 42) -> DataFrame:
    """Mean over random directions of the 1-D Wasserstein distance between two clouds ``(vector)``.

    Every direction is a group; a projection's values are reduced to exact sums by sorting within
    the group, one row a point and direction.
    """
    r = np.random.default_rng(seed)
    directions = r.standard_normal((projections, dims))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    spark = left.sparkSession
    listed = spark.createDataFrame([(k, d.tolist()) for k, d in enumerate(directions)], "direction int, d array<double>")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.sort(pdf.loc[pdf["side"] == s, "x"].to_numpy()) for s in (0, 1))
        if not len(a) or not len(b):
            return pd.DataFrame({"direction": pd.Series([], dtype="int32"), "w": pd.Series([], dtype=float)})
        at = np.unique(np.concatenate([np.arange(1, len(a) + 1) / len(a), np.arange(1, len(b) + 1) / len(b)]))
        low = np.concatenate([[0], at[:-1]])
        mid = (at + low) / 2
        gap = np.abs(a[np.minimum((mid * len(a)).astype(int), len(a) - 1)] - b[np.minimum((mid * len(b)).astype(int), len(b) - 1)])
        return pd.DataFrame({"direction": [pdf["direction"].iloc[0]], "w": [float((gap * (at - low)).sum())]})

    cloud = left.select("vector", F.lit(0).alias("side")).unionByName(right.select("vector", F.lit(1).alias("side")))
    projected = cloud.crossJoin(F.broadcast(listed)).select("direction", "side", vector.dot(F.col("vector"), F.col("d")).alias("x"))
    return projected.groupBy("direction").applyInPandas(one, "direction int, w double").agg(F.coalesce(F.avg("w"), F.lit(0.0)).alias("distance"))


def smoothed(series: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """The next value by exponential smoothing, weights normalised."""
    age = F.row_number().over(W.partitionBy(*by).orderBy(F.col(order).desc())) - 1
    weight = alpha * F.pow(F.lit(1 - alpha), age)
    return series.withColumn("__w", weight).groupBy(*by).agg((F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias("forecast"))


def change_points(series: DataFrame, by: list[str], order: str, value: str, threshold: float = 0.5) -> DataFrame:
    """Where the running sum of deviations from the mean is farthest from 0, and whether that is beyond the threshold."""
    whole = W.partitionBy(*by)
    run = whole.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = series.withColumn("__m", F.avg(value).over(whole)).withColumn("cusum", F.sum(F.col(value) - F.col("__m")).over(run))
    best = out.groupBy(*by).agg(F.max(F.struct(F.abs("cusum").alias("a"), F.col(order), F.col("cusum"))).alias("b"))
    return best.select(*by, F.col(f"b.{order}").alias(order), F.col("b.cusum").alias("magnitude"), (F.col("b.a") > threshold).alias("changed"))


def transport(basis_a: DataFrame, basis_b: DataFrame, ridge: float = 1e-3, least: int = 16) -> DataFrame:
    """The functional map between two bases ``(id, loadings)`` over their shared vertices, by regularised least squares.

    One row, or none with fewer than ``least`` shared vertices: the matrix, its residual, and how
    many vertices were shared.  The normal equations are sums over vertices, so only k x k
    numbers come together.
    """
    both = basis_a.select("id", F.col("loadings").alias("a")).join(basis_b.select("id", F.col("loadings").alias("b")), "id")

    def sums(batches):
        aa = ba = None
        n, bb = 0, 0.0
        for pdf in batches:
            if len(pdf):
                a, b = np.array(pdf["a"].tolist()), np.array(pdf["b"].tolist())
                aa, ba = (a.T @ a, b.T @ a) if aa is None else (aa + a.T @ a, ba + b.T @ a)
                n, bb = n + len(a), bb + float((b * b).sum())
        if n:
            yield pd.DataFrame({"aa": [aa.ravel().tolist()], "ba": [ba.ravel().tolist()], "bb": [bb], "n": [n]})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        if n < least:
            return pd.DataFrame({"matrix": pd.Series([], dtype=object), "residual": pd.Series([], dtype=float), "shared": pd.Series([], dtype="int64")})
        k = int(round(len(pdf["aa"].iloc[0]) ** 0.5))
        aa = np.sum([np.array(x) for x in pdf["aa"]], axis=0).reshape(k, k)
        ba = np.sum([np.array(x) for x in pdf["ba"]], axis=0).reshape(-1, k)
        c = np.linalg.solve(aa + ridge * np.eye(k), ba.T).T
        rest = max(0.0, float(pdf["bb"].sum() - 2 * (c * ba).sum() + np.trace(c @ aa @ c.T)))
        return pd.DataFrame({"matrix": [c.tolist()], "residual": [(rest / n) ** 0.5], "shared": [n]})

    parts = both.mapInPandas(sums, "aa array<double>, ba array<double>, bb double, n long")
    return parts.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(solve, "matrix array<array<double>>, residual double, shared long")
