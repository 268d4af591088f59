"""Operators against brute force and known values."""

import math

import numpy as np
from pyspark.sql import functions as F

from quadrille.functions import geo, stats, text, vector
from quadrille.operators import graph, spatial


def haversine(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_radius_join_over_the_edges_of_the_map(spark):
    r = np.random.default_rng(3)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(r.uniform(-90, 90, 150), r.uniform(-180, 180, 150)))] + [(900, 89.9, 10.0), (901, 0.0, 179.99), (902, None, 1.0), (903, float("nan"), float("nan"))]
    b = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(r.uniform(-90, 90, 60), r.uniform(-180, 180, 60)))] + [(900, 89.8, -170.0), (901, 0.0, -179.99)]
    left, right = spark.createDataFrame(a, "osm_id long, lat double, lon double"), spark.createDataFrame(b, "anchor_id long, alat double, alon double")
    for km in (150.0, 900.0, 5000.0, 25000.0):
        got = {(x.osm_id, x.anchor_id) for x in spatial.radius_join(left, right, km).collect()}
        assert got == {(i, j) for i, p, q in a if p is not None and not math.isnan(p) for j, s, t in b if haversine(p, q, s, t) <= km}


def test_knn_join(spark):
    r = np.random.default_rng(5)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(r.uniform(-80, 80, 40), r.uniform(-180, 180, 40)))]
    got = sorted((x.src, x["rank"], x.dst) for x in spatial.knn_join(spark.createDataFrame(a, "osm_id long, lat double, lon double"), 3, 800.0).collect())
    want = [(i, k + 1, j) for i, p, q in a for k, (_, j) in enumerate(sorted((haversine(p, q, s, t), j) for j, s, t in a if j != i)[:3])]
    assert got == sorted(want)


def test_known_values(spark):
    row = spark.range(1).select(
        text.trigram_similarity(F.lit("word"), F.lit("two words")).alias("t"),
        geo.geohash(F.lit(57.64911), F.lit(10.40744), 5).alias("g"),
        geo.compass(F.lit(22.5)).alias("c"),
        geo.inverse_distance_weight(F.lit(0.0)).alias("w"),
        stats.freshness(F.lit(0.0), F.lit(0.0)).alias("f"),
        stats.presence(F.lit(2), F.lit(30)).alias("p"),
        vector.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"),
        text.plural_label(F.lit("FuelStation")).alias("l"),
        geo.radius_metres(F.lit("2 km")).alias("m"),
        geo.radius_metres(F.lit("near")).alias("none"),
    ).first()
    assert abs(row.t - 4 / 11) < 1e-9 and row.g == "u4pru" and row.c == "north" and abs(row.w - 1 / math.log(1.1)) < 1e-9
    assert row.f == 1 and abs(row.p - 3 / 35) < 1e-12 and row.z == 0 and row.l == "Fuel Stations" and row.m == 2000 and row.none is None


def test_spectrum_of_a_complete_graph(spark):
    e = spark.createDataFrame([(1, i, j, 1.0) for i in range(8) for j in range(i + 1, 8)], "subgraph int, src long, dst long, w double")
    rows = graph.spectrum(e, 3).collect()
    assert len(rows) == 8 and all(abs(v - 8 / 7) < 1e-9 for v in rows[0].eigenvalues)
    phi = np.array([r.loadings for r in rows])
    assert np.allclose(phi.T @ phi, np.eye(3), atol=1e-9)


def test_spectrum_of_several_components(spark, monkeypatch):
    """The sparse way finds an eigenvalue as often as it occurs, also with a basis that starts anew."""
    monkeypatch.setattr(graph, "DENSE", 0)
    monkeypatch.setattr(graph, "BASIS", 1, raising=False)
    r = np.random.default_rng(5)
    path = [(i, i + 1, 1.0) for i in range(120)]
    pair = [(i % 40 + s, 40 + i + s, float(i % 3 + 1)) for s in (0, 300) for i in range(120)] + [(i + s, 41 + i + s, 1.0) for s in (0, 300) for i in range(39)]
    odd = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 150, 500), r.integers(0, 150, 500), r.integers(1, 5, 500), strict=True)]
    star = [(0, i, 1.0) for i in range(1, 90)]
    graphs = {1: path, 2: pair, 3: odd, 4: [*star, (500, 500, 2.0)]}
    rows = graph.spectrum(spark.createDataFrame([(k, *e) for k, g in graphs.items() for e in g], "subgraph long, src long, dst long, w double"), 4).toPandas()
    for key, edges in graphs.items():
        g = rows[rows.subgraph == key].sort_values("id")
        at = {v: i for i, v in enumerate(g.id)}
        a = np.zeros((len(at), len(at)))
        for x, y, w in edges:
            if x != y:
                a[at[x], at[y]] = a[at[y], at[x]] = max(a[at[x], at[y]], w)
        d = a.sum(1)
        root = np.sqrt(np.where(d > 0, d, 1))
        lap = np.diag((d > 0) * 1.0) - a / root[:, None] / root
        values, phi = np.array(g.eigenvalues.iloc[0]), np.array(g.loadings.tolist())
        assert np.allclose(values, np.linalg.eigvalsh(lap)[1:5], atol=1e-8) and np.allclose(lap @ phi, phi * values, atol=1e-6) and np.allclose(phi.T @ phi, np.eye(4), atol=1e-6), key


def test_components_and_energy(spark):
    e = spark.createDataFrame([(10, 20, 5.0), (20, 10, 3.0), (20, 30, 2.0), (7, 8, 1.0)], "src long, dst long, w double")
    v = spark.createDataFrame([(x,) for x in (10, 20, 30, 7, 8, 50)], "id long")
    assert {r.id: r.component for r in graph.components(graph.canonical(e), v).collect()} == {10: 10, 20: 10, 30: 10, 7: 7, 8: 7, 50: 50}
    flat = v.withColumn("s", F.lit(3.0))
    assert graph.dirichlet(graph.canonical(e), flat).first().energy == 0
