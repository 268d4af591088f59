"""Runs plans over entities ``(osm_id, name, wkg_class, lat, lon)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.operators import graph, search, spatial, walks
from quadrille.plans.parser import Plan, parse


class Unresolved(LookupError):
    """A place or a class of a question that no entity has."""


def place(entities: DataFrame, name: str) -> tuple[int, float, float]:
    """Key and point of the entity that a name stands for."""
    _, found = search.geocode(entities, name)
    row = found.first()
    if row is None:
        raise Unresolved(name)
    return row["osm_id"], row["lat"], row["lon"]


@dataclass(frozen=True)
class Region:
    """What is kept for a region besides its entities: ``edges`` ``(subgraph, src, dst, w)`` and ``prints`` ``(snapshot_id, wkg_class, n)``."""

    edges: DataFrame | None = None
    prints: DataFrame | None = None


def spread(edges: DataFrame, anchor: int, limit: int) -> DataFrame:
    """What a signal at one vertex reaches, most first: ``(id, score)``."""
    own = edges.filter((F.col("src") == anchor) | (F.col("dst") == anchor)).select("subgraph").distinct().limit(1)
    region = edges.join(F.broadcast(own), "subgraph", "left_semi")
    signal = own.select(F.col("subgraph").alias("region")).select(F.col("region").alias("subgraph"), F.lit(anchor).cast("long").alias("id"), F.lit(1.0).alias("s"))
    return walks.diffused(region, signal).filter(F.col("id") != anchor).orderBy(F.col("value").desc(), "id").limit(limit).withColumnRenamed("value", "score")


def changed(prints: DataFrame, since: str) -> DataFrame:
    """How class shares moved from the last snapshot up to ``since`` to the latest one: ``(wkg_class, p, q, shift)``, most first."""
    day = since.replace("-", "_")
    last = prints.agg(F.max("snapshot_id").alias("latest"), F.max(F.when(F.col("snapshot_id") <= day, F.col("snapshot_id"))).alias("before"))
    rows = prints.crossJoin(F.broadcast(last))  # one row
    both = rows.groupBy("wkg_class").agg(*[F.coalesce(F.sum(F.when(F.col("snapshot_id") == F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in ("before", "latest")])
    whole = both.agg(F.sum("before").alias("b"), F.sum("latest").alias("l"))
    share = lambda c, n: F.when(F.col(n) > 0, F.col(c) / F.col(n)).otherwise(0.0)
    pairs = both.crossJoin(F.broadcast(whole)).select("wkg_class", share("before", "b").alias("p"), share("latest", "l").alias("q"))
    return pairs.withColumn("shift", F.col("q") - F.col("p")).orderBy(F.abs("shift").desc(), "wkg_class")


def of_region(plan: Plan, entities: DataFrame, region: Region, limit: int) -> DataFrame:
    """The templates that read a region's graph or its snapshots."""
    needed = region.prints if plan.template == "drift" else region.edges
    if needed is None:
        raise Unresolved(plan.template)
    if plan.template == "drift":
        return changed(needed, plan.slots["since"])
    if plan.template == "diffusion":
        return spread(needed, place(entities, plan.slots["b"])[0], limit)
    if plan.template == "spectrum":
        return graph.spectrum(needed, 6).groupBy("subgraph").agg(F.count(F.lit(1)).alias("vertices"), F.first("eigenvalues").alias("eigenvalues")).orderBy("subgraph")
    sizes = graph.communities(needed).groupBy("subgraph", "community", "modularity").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("subgraph").agg(F.count(F.lit(1)).alias("communities"), F.max("n").alias("largest"), F.max("modularity").alias("modularity")).orderBy("subgraph")


def run(entities: DataFrame, question: str | Plan, vocabulary: set[str] = frozenset(), default_km: float = 2.0, limit: int = 200, region: Region = Region()) -> tuple[Plan, DataFrame]:
    """The plan of a question and its rows, in order."""
    plan = question if isinstance(question, Plan) else parse(question, vocabulary)
    s = plan.slots
    if plan.template == "search":
        return plan, search.name_pool(entities, s["text"], limit)
    if plan.template in ("communities", "drift", "diffusion", "spectrum"):
        return plan, of_region(plan, entities, region, limit)
    if plan.template in ("distance", "bearing"):
        (a, alat, alon), (b, blat, blon) = place(entities, s["a"]), place(entities, s["b"])
        out = entities.filter(F.col("osm_id") == a).limit(1).select(F.lit(a).alias("a"), F.lit(b).alias("b"), geo.haversine_km(blat, blon, alat, alon).alias("distance_km"), geo.bearing(blat, blon, alat, alon).alias("bearing"))
        return plan, out.withColumn("compass", geo.compass("bearing"))
    if "b" not in s or "cls" not in s:
        raise Unresolved(plan.template)
    key, lat, lon = place(entities, s["b"])
    those = entities.filter((F.lower("wkg_class") == s["cls"].lower()) & (F.col("osm_id") != key))
    if plan.template == "cone":
        found = spatial.nearest_in_cone(those, lat, lon, 45.0 * geo.COMPASS.index(s["way"].lower()), spatial.FARTHEST_KM)
        return plan, found.orderBy("distance_km", "osm_id").limit(1)
    reach = (plan.radius_km or default_km) if plan.template == "within" else spatial.FARTHEST_KM
    found = spatial.within_radius(those, lat, lon, reach).orderBy("distance_km", "osm_id")
    return plan, found.limit(limit if plan.template == "within" else 5)
