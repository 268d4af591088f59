"""Writes of results: partitioned by their scope, replaced scope by scope, and so the same when they are repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.streaming.ingest import replace_scope


def write_links(links: DataFrame, path: str, scope: list[str], threshold: float, key: list[str], score: str = "total") -> None:
    """Accepted and rejected links in one pass, as directories of each scope; of rows with one key the best stays.

    ``accepted`` is read back from the directories' names, as ``true`` or ``false``.
    """
    others = [c for c in links.columns if c not in key]
    best = links.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(score, F.xxhash64(*others))).alias("b")).select(*key, "b.*")
    replace_scope(best.withColumn("accepted", F.coalesce(F.col(score) >= threshold, F.lit(False))), path, [*scope, "accepted"])


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are left out."""
    rows.write.mode("overwrite").json(path)


def write_edge_list(edges: DataFrame, path: str) -> None:
    """``src dst w`` a line."""
    edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("w").cast("string"))).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Comma-separated rows with a header; quotes are doubled."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_tsv(spark: SparkSession, paths: list[str], columns: str) -> DataFrame:
    """Shards of tab-separated rows as one table; compressed files are read as they are, each whole in one task."""
    return spark.read.schema(columns).option("sep", "\t").csv(paths)


def split_by_membership(rows: DataFrame, mask: str, targets: list[str]) -> DataFrame:
    """A row for each target whose bit is set in ``mask``, with ``target``; rows in none are left out."""
    number = F.transform(F.sequence(F.lit(0), F.lit(len(targets) - 1)), lambda i: F.when(F.getbit(F.col(mask).cast("long"), i) == 1, F.get(F.array(*map(F.lit, targets)), i)))
    return rows.withColumn("target", F.explode(F.array_compact(number)))


def enriched(rows: DataFrame, found: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` filled in from ``found``, one row for each key; what isn't found, or is null there, stays."""
    new = found.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def write_registered(df: DataFrame, path: str, registry: str, scope: list[str]) -> None:
    """Replace the scopes that ``df`` has, then put their row counts into the registry, so a scope is listed only when it is whole."""
    replace_scope(df, path, scope)
    written = df.sparkSession.read.parquet(path).join(F.broadcast(df.select(*scope).distinct()), scope, "left_semi")
    replace_scope(written.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_rows")), registry, scope)
