"""Entities with a point, tags and a class, made from the tables of parts and suppliers.

The tables have no geometry, so a point follows from the key by whole-number arithmetic.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Sets the shared folder for checkpoints that the session names; one of this machine only where all runs on it."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="quadrille-"))


def point(key: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a key."""
    key = key.cast("long")
    return (key * 7919) % 12000 / F.lit(100.0) - 60, (key * 104729) % 36000 / F.lit(100.0) - 180


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(osm_id, name, wkg_class, brand, size, lat, lon, tags)`` of parts."""
    lat, lon = point(F.col("p_partkey"))
    size = F.col("p_size").cast("string")
    tags = F.create_map(F.lit("class"), "p_type", F.lit("brand"), "p_brand", F.lit("size"), size)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("osm_id"), F.col("p_name").alias("name"), F.col("p_type").alias("wkg_class"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), lat.alias("lat"), lon.alias("lon"), tags.alias("tags"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(anchor_id, anchor, country, alat, alon)`` of suppliers."""
    lat, lon = point(F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("anchor_id"), F.col("s_name").alias("anchor"), F.col("s_nationkey").alias("country"), lat.alias("alat"), lon.alias("alon"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored links of line items: three scores from 0 to 1, a relation, and whether they are accepted."""
    geo, name, topo = F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.col("l_quantity") / 50
    total = 0.4 * geo + 0.3 * name + 0.3 * topo
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("head"), F.col("l_suppkey").alias("tail"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("part_of"), geo.alias("geo"), name.alias("name"), topo.alias("topo"), total.alias("total"), (total >= 0.5).alias("accepted"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line")
    )


#: The same views as SQL, for other engines.
SQL = """
entity AS (SELECT p_partkey AS osm_id, p_name AS name, p_type AS wkg_class, p_brand AS brand, p_size AS size,
    ((p_partkey * 7919) % 12000) / CAST(100 AS DOUBLE) - 60 AS lat, ((p_partkey * 104729) % 36000) / CAST(100 AS DOUBLE) - 180 AS lon FROM part),
anchor AS (SELECT s_suppkey AS anchor_id, s_name AS anchor, s_nationkey AS country,
    ((s_suppkey * 7919) % 12000) / CAST(100 AS DOUBLE) - 60 AS alat, ((s_suppkey * 104729) % 36000) / CAST(100 AS DOUBLE) - 180 AS alon FROM supplier),
link AS (SELECT *, 0.4 * geo + 0.3 * name + 0.3 * topo AS total, 0.4 * geo + 0.3 * name + 0.3 * topo >= CAST(0.5 AS DOUBLE) AS accepted FROM
    (SELECT l_partkey AS head, l_suppkey AS tail, l_returnflag AS relation, l_linestatus AS part_of, l_discount * 10 AS geo, l_tax * 12.5 AS name, l_quantity / 50 AS topo, l_orderkey AS order_id, l_linenumber AS line FROM lineitem))
"""
