"""Spatial filters and joins.

Joins meet in cells of a grid as wide as the radius, so they are equi-joins: the anchors' side
is repeated for the cells that its circle touches, the other side keeps one row.  Cells wrap
at 180 degrees and widen towards the poles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.operators.picks import first_of
from quadrille.sources.entities import shared_checkpoints

KM_A_DEGREE = math.pi * geo.RADIUS_KM / 180
FARTHEST_KM = math.pi * geo.RADIUS_KM


def within_radius(df: DataFrame, lat: float, lon: float, km: float, lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """Rows within ``km`` of a point, with ``distance_km``.

    A box of latitudes and longitudes comes first; where the point is stored as columns it reaches the
    scan.  The box has no bound of longitudes where the circle holds a pole.
    """
    d = km / KM_A_DEGREE
    box = F.col(lat_col).between(lat - d, lat + d)
    reach = math.sin(min(km / geo.RADIUS_KM, math.pi / 2))
    if abs(lat) + d < 90 and reach < math.cos(math.radians(lat)):
        w = math.degrees(math.asin(reach / math.cos(math.radians(lat)))) * 1.0000001
        west, east = lon - w, lon + w
        inside = F.col(lon_col).between(west, east)
        # the part of the box beyond 180 degrees
        inside = inside | (F.col(lon_col) >= west + 360) if west < -180 else inside
        box = box & (inside | (F.col(lon_col) <= east - 360) if east > 180 else inside)
    near = df.filter(geo.is_located(lat_col, lon_col) & box)
    return near.withColumn("distance_km", geo.haversine_km(float(lat), float(lon), lat_col, lon_col)).filter(F.col("distance_km") <= km)


def _cell(value: Column, low: float, size: float) -> Column:
    return F.floor((value - low) / size).cast("int")


def radius_join(left: DataFrame, right: DataFrame, km: float, left_at: tuple[str, str] = ("lat", "lon"), right_at: tuple[str, str] = ("alat", "alon"), by: list[tuple[str, str]] = ()) -> DataFrame:
    """All pairs within ``km``, with ``distance_km``; rows without a point pair with nothing.

    With ``by``, pairs of a left and a right column, only rows that are equal in these meet.
    """
    size = min(180.0, max(km / KM_A_DEGREE * 1.0000001, 1e-6))
    columns = max(1, math.floor(360 / size))
    width = 360 / columns  # divides the circle, so that cells wrap exactly
    lat, lon = (F.col(c) for c in left_at)
    here = left.filter(geo.is_located(*left_at)).withColumn("__y", _cell(lat, -90, size)).withColumn("__x", F.pmod(_cell(lon, -180, width), F.lit(columns)))
    alat, alon = (F.col(c) for c in right_at)
    reach = math.sin(min(km / geo.RADIUS_KM, math.pi / 2))
    over_pole = (alat + size >= 90) | (alat - size <= -90)
    wide = F.when(over_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), reach / F.greatest(F.cos(F.radians(alat)), F.lit(1e-12))))) * 1.0000001)
    there = right.filter(geo.is_located(*right_at))
    there = there.withColumn("__y", F.explode(F.sequence(_cell(alat - size, -90, size), _cell(alat + size, -90, size))))
    xs = F.transform(F.sequence(_cell(alon - wide, -180, width), _cell(alon + wide, -180, width)), lambda x: F.pmod(x, F.lit(columns)))
    there = there.withColumn("__x", F.explode(F.array_distinct(xs)))
    for k, (a, b) in enumerate(by):
        here, there = here.withColumn(f"__by{k}", F.col(a)), there.withColumn(f"__by{k}", F.col(b))
    keys = ["__y", "__x", *(f"__by{k}" for k in range(len(by)))]
    pairs = here.join(there, keys).drop(*keys)
    return pairs.withColumn("distance_km", geo.haversine_km(*left_at, *right_at)).filter(F.col("distance_km") <= km)


def crowded(points: DataFrame, km: float, most: float, at: tuple[str, str] = ("alat", "alon"), least_km: float = 0.01) -> float:
    """The widest of ``km``, ``km / 2``, ... at which a point shares a square of that width with ``most`` points, itself included, on average."""
    halvings = max(0, math.ceil(math.log2(km / least_km))) if km > 0 else 0
    lat, lon = (F.col(c) for c in at)
    widths = F.explode(F.sequence(F.lit(0), F.lit(halvings))).alias("__h")
    size = km / KM_A_DEGREE / F.pow(F.lit(2.0), F.col("__h"))
    cells = points.filter(geo.is_located(*at)).select(lat.alias("__lat"), lon.alias("__lon"), widths)
    y, x = F.floor(F.col("__lat") / size), F.floor(F.col("__lon") * F.cos(F.radians("__lat")) / size)
    counts = cells.groupBy("__h", y.alias("__y"), x.alias("__x")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    fits = {r["__h"] for r in counts.groupBy("__h").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).filter(F.col("crowd") <= most).collect()}
    return km / 2 ** min(fits, default=halvings)


def nearest_by_point(left: DataFrame, right: DataFrame, k: int, km: float, anchor_key: str = "anchor_id", left_at: tuple[str, str] = ("lat", "lon"), right_at: tuple[str, str] = ("alat", "alon")) -> DataFrame:
    """For each distinct point of ``left`` the ``k`` nearest rows of ``right`` within ``km``, ties by ``anchor_key``: the point, right's columns and ``distance_km``.

    Rings grow from a radius that follows from how crowded ``right`` is: a point with ``k`` rows within the radius is
    done, the others go on with three times the radius, up to ``km``.  Of rows at one place only the first ``k`` can count.
    """
    shared_checkpoints(left.sparkSession)
    at = list(left_at)
    todo = left.filter(geo.is_located(*left_at)).select(*at).distinct()
    there = first_of(right.filter(geo.is_located(*right_at)), list(right_at), [F.col(anchor_key).asc()], k)
    reach, done = km, None
    if km > 0:
        there = there.checkpoint()
        reach = crowded(there, km, 2.0 * k, right_at)
    while True:
        near = first_of(radius_join(todo, there, min(reach, km), left_at, right_at), at, [F.col("distance_km").asc(), F.col(anchor_key).asc()], k, "__rank")
        if reach >= km:
            near = near.drop("__rank")
            return near if done is None else done.unionByName(near)
        near = near.checkpoint()
        full = near.filter(F.col("__rank") == k).select(*at)
        part = near.join(full, at, "left_semi").drop("__rank")
        done = part if done is None else done.unionByName(part)
        todo = todo.join(full, at, "left_anti").checkpoint()
        if todo.isEmpty():
            return done
        reach *= 3


def nearest_of_set(left: DataFrame, right: DataFrame, km: float, key: str = "osm_id", anchor_key: str = "anchor_id") -> DataFrame:
    """Each row of ``left`` within ``km`` of an anchor, with its nearest anchor and the distance."""
    near = nearest_by_point(left, right.select(anchor_key, "alat", "alon"), 1, km, anchor_key)
    pairs = left.select(key, "lat", "lon").join(near.select("lat", "lon", "distance_km", anchor_key), ["lat", "lon"])
    best = pairs.groupBy(key).agg(F.min(F.struct("distance_km", anchor_key)).alias("b"))
    return best.select(key, F.col(f"b.{anchor_key}").alias(anchor_key), F.col("b.distance_km").alias("distance_km"))


def knn_join(points: DataFrame, k: int, start_km: float, key: str = "osm_id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The ``k`` nearest other points of each: ``(src, dst, distance_km, rank)``; ties by ``dst``.

    Rings grow: points that have ``k`` neighbours within the radius are done, the others go on with
    twice the radius, at last over the whole sphere.
    """
    all_ = points.filter(geo.is_located(lat, lon)).select(F.col(key).alias("dst"), F.col(lat).alias("dlat"), F.col(lon).alias("dlon")).cache()
    todo = all_.select(F.col("dst").alias("src"), F.col("dlat").alias("slat"), F.col("dlon").alias("slon"))
    k = max(0, min(k, all_.count() - 1))
    order = W.partitionBy("src").orderBy("distance_km", "dst")
    done, km = None, start_km
    while True:
        last = km >= FARTHEST_KM
        near = radius_join(all_, todo, min(km, FARTHEST_KM * 1.001) if not last else FARTHEST_KM * 1.001, ("dlat", "dlon"), ("slat", "slon")).filter("src <> dst")
        ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("src", "dst", "distance_km", "rank").persist()
        full = ranked.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= (0 if last else k)).select("src")
        part = ranked.join(full, "src", "left_semi")
        done = part if done is None else done.unionByName(part)
        todo = todo.join(full, "src", "left_anti").persist()
        if last or k == 0 or todo.isEmpty():
            return done
        km *= 2


def nearest_in_cone(df: DataFrame, lat: float, lon: float, direction: float, km: float, half_width: float = 45.0) -> DataFrame:
    """Rows within ``km`` whose bearing from the point is within ``half_width`` of ``direction``."""
    near = within_radius(df, lat, lon, km).withColumn("bearing", geo.bearing(float(lat), float(lon), "lat", "lon"))
    return near.filter(geo.angular_difference("bearing", float(direction)) <= half_width)
