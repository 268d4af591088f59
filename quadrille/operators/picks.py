"""One or a few rows of each group: windows with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of(df: DataFrame, by: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in the given order.

    For ``n`` rows Spark keeps the first of each group before rows are moved, so a large group isn't sorted whole.
    """
    out = df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__r") <= n)
    return out.withColumnRenamed("__r", rank) if rank else out.drop("__r")


def merge_pools(pools: list[DataFrame], key: list[str], order: list[Column]) -> DataFrame:
    """Union of pools; a key in several keeps its row of the first pool, with ``pool``."""
    both = None
    for k, pool in enumerate(pools):
        pool = pool.withColumn("pool", F.lit(k))
        both = pool if both is None else both.unionByName(pool)
    return first_of(both, key, [F.col("pool").asc(), *order])


def diverse(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The best row of each group, and every row whose group has a null."""
    whole = F.lit(True)
    for c in by:
        whole = whole & F.col(c).isNotNull()
    return first_of(df.filter(whole), by, order).unionByName(df.filter(~whole))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str, keep: list[str]) -> DataFrame:
    """New rows over old ones: the last by ``order`` of each key wins; nulls of the columns ``keep`` leave the old value."""
    last = first_of(new, key, [F.col(order).desc()])
    a, b = old.alias("a"), last.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full_outer")
    is_new = F.col(f"b.{key[0]}").isNotNull()
    out = []
    for c in old.columns:
        value = F.coalesce(f"b.{c}", f"a.{c}") if c in keep or c in key else F.when(is_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        out.append(value.alias(c))
    return joined.select(*out)
