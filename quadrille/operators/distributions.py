"""Class distributions, their fingerprints, and drift between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.functions.stats import kl_term


def shares(df: DataFrame, by: list[str], cls: str) -> DataFrame:
    """``(by..., cls, n, share)``."""
    counts = df.groupBy(*by, cls).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def fingerprint(df: DataFrame, by: list[str], cls: str, depth: str) -> DataFrame:
    """Total, classes, entropy in bits, Simpson index, and mean and deviation of the depth."""
    dist = shares(df, by, cls).groupBy(*by).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_classes"), (-F.sum(F.col("share") * F.log2("share"))).alias("entropy"), (1 - F.sum(F.col("share") * F.col("share"))).alias("simpson"))
    depths = df.groupBy(*by).agg(F.avg(depth).alias("mean_depth"), F.stddev_pop(depth).alias("depth_std"))
    return dist.join(depths, by)


def paired(before: DataFrame, after: DataFrame, cls: str) -> DataFrame:
    """Full outer merge of two distributions ``(cls, share)``; a missing class has share 0."""
    a, b = before.select(cls, F.col("share").alias("p")), after.select(cls, F.col("share").alias("q"))
    return a.join(b, cls, "full_outer").select(cls, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def divergence(pairs: DataFrame) -> DataFrame:
    """Kullback-Leibler both ways and Jensen-Shannon, natural logarithms."""
    m = (F.col("p") + F.col("q")) / 2
    return pairs.agg(F.sum(kl_term(F.col("p"), F.col("q"))).alias("kl"), F.sum(kl_term(F.col("q"), F.col("p"))).alias("kl_back"), (0.5 * F.sum(kl_term(F.col("p"), m)) + 0.5 * F.sum(kl_term(F.col("q"), m))).alias("js"))


def shifts(pairs: DataFrame, cls: str, n: int = 5) -> DataFrame:
    """The ``n`` classes whose share changed most, with the sign."""
    return pairs.withColumn("shift", F.col("q") - F.col("p")).orderBy(F.abs("shift").desc(), cls).limit(n)
