"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, and tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of this machine only where none is named and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    where = found or tempfile.mkdtemp(prefix="quadrille-checkpoint-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` read back from a reliable checkpoint, so that later steps don't compute it again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text) -> "F.Column":
    """The words of a text column as an array; a null or blank text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value, body):
    """``body`` of a value that is computed once for each row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
