"""Search over entities: ladders of tiers, name pools, combined scores and deduplication."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geo, text, vector
from quadrille.operators.picks import diverse, first_of


def ladder(tiers: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[str | None, DataFrame | None]:
    """The first tier with a row, and its name; later tiers aren't made."""
    found = None
    for name, make in tiers:
        found = make()
        if not found.isEmpty():
            return name, found
    return None, found


def by_tag(df: DataFrame, phrase: str, vocabulary_tag: str) -> list[tuple[str, Callable[[], DataFrame]]]:
    """Tiers for a category phrase: exact tag value, then value in normal form, then the likest value."""
    value = F.element_at("tags", vocabulary_tag)
    near = text.correction_score(F.lower(value), F.lit(phrase.lower()))
    return [
        ("exact", lambda: df.filter(value == phrase)),
        ("normal", lambda: df.filter(text.tag_value(value) == text.tag_value(F.lit(phrase)))),
        ("fuzzy", lambda: df.join(F.broadcast(df.select(value.alias("__v")).distinct().withColumn("__s", text.correction_score(F.lower("__v"), F.lit(phrase.lower()))).filter("__s >= 0.55").orderBy(F.col("__s").desc(), "__v").limit(1)), value == F.col("__v")).drop("__v", "__s").filter(near >= 0.55)),
    ]


def name_pool(df: DataFrame, name: str, limit: int, floor: float = 0.3) -> DataFrame:
    """Named rows by likeness to a name: equal names first, then trigram similarity; total order by key."""
    equal = F.lower(text.straight_quotes("name")) == name.lower()
    out = df.withColumn("similarity", F.when(equal, 1.0).otherwise(text.trigram_similarity("name", F.lit(name))))
    # a name much longer than the query is a fragment match
    fits = F.length("name") <= 1.6 * max(len(name), 1)
    return out.filter(equal | (fits & (F.col("similarity") >= floor))).orderBy(F.col("similarity").desc(), "osm_id").limit(limit)


def geocode(df: DataFrame, name: str) -> tuple[str | None, DataFrame]:
    """One place for a name: likest, then equal, then containing; located rows first, then by key."""
    low = name.lower()
    tiers = [
        ("trigram", lambda: name_pool(df, name, 20, 0.4)),
        ("exact", lambda: df.filter(F.lower(text.straight_quotes(text.without_article("name"))) == low)),
        ("contains", lambda: df.filter(F.lower("name").contains(low) & (F.length("name") <= 3 * len(low)))),
    ]
    tier, found = ladder(tiers)
    return tier, found.orderBy(geo.is_located("lat", "lon").desc(), "osm_id").limit(1)


def combined(df: DataFrame, *, query: Column | None, terms: list[str], lat: float | None, lon: float | None, reach_km: float, cls: str | None, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows with ``name_score``, ``geo_score``, ``class_score``, ``boost`` and their weighted sum ``score``."""
    w = {"name": 1.0, "geo": 1.0, "class": 1.0, "boost": 1.0} | (weights or {})
    cos = F.greatest(F.lit(0.0), F.least(F.lit(1.0), vector.cosine(F.col("embedding"), query))) if query is not None else F.lit(0.0)
    near = geo.geo_score(geo.haversine_km(float(lat), float(lon), "lat", "lon"), reach_km) if lat is not None else F.lit(0.0)
    same = (F.col("wkg_class") == cls).cast("double") if cls else F.lit(0.0)
    out = df.withColumn("name_score", cos).withColumn("geo_score", F.coalesce(near, F.lit(0.0))).withColumn("class_score", F.coalesce(same, F.lit(0.0))).withColumn("boost", text.term_hits("name", terms).cast("double"))
    return out.withColumn("score", w["name"] * F.col("name_score") + w["geo"] * F.col("geo_score") + w["class"] * F.col("class_score") + w["boost"] * F.col("boost"))


def diversified(scored: DataFrame, limit: int) -> DataFrame:
    """The best row of each name and geohash cell, nameless rows all, best first."""
    keyed = scored.withColumn("__n", F.when(text.normal_name("name") != "", text.normal_name("name"))).withColumn("__g", geo.geohash("lat", "lon", 5))
    return diverse(keyed, ["__n", "__g"], [F.col("score").desc(), F.col("osm_id").asc()]).drop("__n", "__g").orderBy(F.col("score").desc(), "osm_id").limit(limit)


def apart(ranked: DataFrame, keep: int = 3, metres: float = 50.0) -> DataFrame:
    """Per name at most ``keep`` rows by rank, none within ``metres`` of one kept before it.

    Whether a row stays depends on those before it, so a name's rows go through in order.  The
    input is a ranked result, not a table.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept = pdf.sort_values(["rank", "osm_id"]), []
        for k, (a, b) in enumerate(zip(np.radians(pdf["lat"]), np.radians(pdf["lon"]), strict=True)):
            far = all(2 * 6371000 * np.arcsin(np.sqrt(np.sin((a - c) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((b - d) / 2) ** 2)) >= metres for _, c, d in kept)
            if far and len(kept) < keep:
                kept.append((k, a, b))
        return pdf.iloc[[k for k, _, _ in kept]]

    return ranked.groupBy("name").applyInPandas(one, ranked.schema)


def nth_nearest(df: DataFrame, lat: float, lon: float, n: int) -> DataFrame:
    """The n-th nearest row of each class to a point."""
    out = df.withColumn("distance_km", geo.haversine_km(float(lat), float(lon), "lat", "lon"))
    return first_of(out, ["wkg_class"], [F.col("distance_km").asc(), F.col("osm_id").asc()], n, "rank").filter(F.col("rank") == n)
