"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.picks import first_of, upsert


def follow(spark: SparkSession, path: str, schema, files_at_once: int = 16) -> DataFrame:
    """A stream of a folder's Parquet files; new files are read once each."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Handle what is there now in micro-batches and stop; a later call goes on from the checkpoint."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def upsert_into(spark: SparkSession, target: str, key: list[str], order: str, keep: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch handler that merges rows into a Parquet table; a repeated batch changes nothing.

    The table is written in versions and a reader takes the newest complete one, so a lost executor or driver leaves the
    version before.
    """

    def each(batch: DataFrame, number: int) -> None:
        new = first_of(batch, key, [F.col(order).desc()])
        if number and (old := latest(spark, target, number)) is not None:
            new = upsert(old, new.select(*old.columns), key, order, keep)
        new.write.mode("overwrite").parquet(f"{target}/v{number:010d}")

    return each


def latest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version, or the newest below ``before``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(target)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))
    names = [n for n in names if n.startswith("v") and (before is None or int(n[1:]) < before)]
    return spark.read.parquet(f"{target}/{names[-1]}") if names else None


def windowed(events: DataFrame, every: str, late: str) -> DataFrame:
    """Counts and sums of events by window and type; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))


def above_mark(records: DataFrame, date: str, mark) -> DataFrame:
    """Records after the high-water mark; those without a date stay."""
    return records if mark is None else records.filter(F.col(date).isNull() | (F.col(date) > F.lit(mark)))


def replace_scope(df: DataFrame, path: str, scope: list[str]) -> None:
    """Write a table by directories of ``scope``, replacing only those that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)
