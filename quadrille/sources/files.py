"""Readers of open-data files into records of one shape, and small text formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of columns that may hold coordinates, the first present wins.
LONGITUDES, LATITUDES = ("longitude", "lon", "lng", "x"), ("latitude", "lat", "y")


def _first(columns: list[str], wanted: tuple[str, ...]) -> str | None:
    low = {c.lower(): c for c in columns}
    return next((low[w] for w in wanted if w in low), None)


def csv_records(spark: SparkSession, path: str, date_col: str | None = None) -> DataFrame:
    """``(source_id, attributes map, lon, lat, date)``: attributes are the file's columns as text."""
    df = spark.read.csv(path, header=True)
    lon, lat, key = _first(df.columns, LONGITUDES), _first(df.columns, LATITUDES), _first(df.columns, ("_id", "id"))
    pairs = [x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`"))]
    point = lambda c: F.expr(f"try_cast(`{c}` AS double)") if c else F.lit(None).cast("double")
    date = F.expr(f"try_cast(`{date_col}` AS date)") if date_col else F.lit(None).cast("date")
    return df.select((F.col(f"`{key}`") if key else F.lit(None).cast("string")).alias("source_id"), F.create_map(*pairs).alias("attributes"), point(lon).alias("lon"), point(lat).alias("lat"), date.alias("date"))


def geojson_records(spark: SparkSession, path: str) -> DataFrame:
    """``(source_id, attributes map, kind, lon, lat, geometry)`` of the features of a collection; a point has its place, others their text."""
    feature = "struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    whole = spark.read.text(path, wholetext=True)
    f = whole.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
    place = F.from_json("f.geometry.coordinates", "array<double>")
    is_point = F.col("f.geometry.type") == "Point"
    return f.select(F.col("f.id").alias("source_id"), F.col("f.properties").alias("attributes"), F.col("f.geometry.type").alias("kind"), F.when(is_point, F.get(place, F.lit(0))).alias("lon"), F.when(is_point, F.get(place, F.lit(1))).alias("lat"), F.col("f.geometry.coordinates").alias("geometry"))


def ring_of(poly: str) -> list[tuple[float, float]]:
    """The first outer ring of a polygon file: a name, then sections of a title, points and END; titles with ! are holes."""
    ring: list[tuple[float, float]] = []
    for block in re.split(r"^\s*END\s*$", poly.split("\n", 1)[1] if "\n" in poly else "", flags=re.M):
        lines = [x.strip() for x in block.strip().splitlines() if x.strip()]
        if lines and not lines[0].startswith("!") and not ring:
            ring = [(float(a), float(b)) for a, b in (x.split()[:2] for x in lines[1:])]
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def box_of(ring: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    """West, south, east, north."""
    xs, ys = zip(*ring, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def well_known_text(ring: list[tuple[float, float]]) -> str:
    return "POLYGON((" + ", ".join(f"{x:g} {y:g}" for x, y in [*ring, ring[0]]) + "))"


def point_text(text: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a point in well-known text; null for other text."""
    part = lambda k: F.regexp_extract(text, r"(?i)^point\s*\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)", k)
    return tuple(F.when(part(k) != "", part(k)).cast("double") for k in (1, 2))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """``(subject, predicate, object)`` of a file with one triple a line."""
    line = r'^\s*(<[^>]*>|\S+)\s+(<[^>]*>|\S+)\s+(<[^>]*>|"(?:[^"\\]|\\.)*"\S*|\S+)\s*\.\s*$'
    t = spark.read.text(path).filter(F.col("value").rlike(line))
    strip = lambda k: F.regexp_replace(F.regexp_extract("value", line, k), r'^[<"]|[>"]\S*$', "")
    return t.select(strip(1).alias("subject"), strip(2).alias("predicate"), strip(3).alias("object"))
