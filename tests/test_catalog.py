"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quadrille.functions import geo
from quadrille.operators import forecasts, graph, spatial
from quadrille.plans import catalog, execute, more, parity, wider  # noqa: F401

WHERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(WHERE, t)}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, WHERE).toPandas()) == rows(duck.execute(catalog.SQL[name]).df())


def regions(spark):
    """The regions' graphs as dense matrices of the heaviest weights, by subgraph, with their ids."""
    out = {}
    for key, g in catalog._regions(spark, WHERE).toPandas().groupby("subgraph"):
        ids = np.unique(g[["src", "dst"]].to_numpy())
        a = np.zeros((len(ids), len(ids)))
        for x, y, w in zip(np.searchsorted(ids, g.src), np.searchsorted(ids, g.dst), g.w, strict=True):
            a[x, y] = a[y, x] = max(a[x, y], w)
        out[key] = ids, a
    return out


@pytest.mark.parametrize("dense", [10**6, 0])
def test_spectrum(spark, monkeypatch, dense):
    monkeypatch.setattr(graph, "DENSE", dense)
    found = {k: g.sort_values("id") for k, g in catalog.gra_08_spectrum(spark, WHERE).toPandas().groupby("subgraph")}
    for key, (ids, a) in regions(spark).items():
        d = a.sum(1)
        lap = np.eye(len(ids)) - a / np.sqrt(d[:, None] * d[None])
        values, vectors = np.linalg.eigvalsh(lap)[1:7], np.array(found[key].loadings.tolist())
        got = np.array(found[key].eigenvalues.iloc[0])
        assert found[key].id.tolist() == ids.tolist() and np.abs(got[: len(set(values.round(6)))][:1] - values[:1]).max() < 1e-8
        assert np.abs(lap @ vectors - vectors * got).max() < 1e-6 and np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-6


def test_diffusion(spark):
    found = {r.id: r.value for r in more.gra_15_diffusion(spark, WHERE).filter("id >= 0").collect()}
    for ids, a in regions(spark).values():
        x = np.linalg.solve(np.diag(a.sum(1)) - a + np.eye(len(ids)), (ids >= 0).astype(float))
        assert all(abs(found[i] - v) < 1e-8 for i, v in zip(ids, x, strict=True) if i >= 0)


def test_communities(spark):
    edges = [(1, a, b, 1.0) for a, b in ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3))] + [(2, 7, 8, 2.0), (2, 8, 7, 1.0), (3, 9, 9, 1.0)]
    out = {r.id: (r.subgraph, r.community, r.modularity) for r in graph.communities(spark.createDataFrame(edges, "subgraph long, src long, dst long, w double")).collect()}
    assert [out[i][1] for i in range(6)] == [0, 0, 0, 3, 3, 3] and out[0][2] == pytest.approx(5 / 14) and out[7][1] == out[8][1] == 7 and out[9][1] == 9
    found = more.gra_18_louvain(spark, WHERE).toPandas()
    for key, (ids, a) in regions(spark).items():
        g = found[found.subgraph == key].sort_values("id")
        c, m = g.community.to_numpy(), a.sum() / 2
        q = sum(a[np.ix_(c == x, c == x)].sum() / (2 * m) - (a[c == x].sum() / (2 * m)) ** 2 for x in set(c))
        assert g.id.tolist() == ids.tolist() and g.modularity.iloc[0] == pytest.approx(q)
    sizes = {r.subgraph: (r.communities, r.largest) for r in more.tpl_13_communities(spark, WHERE).collect()}
    assert sizes == {k: (g.community.nunique(), g.community.value_counts().max()) for k, g in found.groupby("subgraph")}


def test_walks_follow_edges(spark):
    edges = {(r.src, r.dst) for r in catalog._graph(spark, WHERE).collect()}
    paths = [r.path for r in parity.gra_25_walks(spark, WHERE).collect()]
    assert paths and all(len(p) == 8 and all((a, b) in edges or (b, a) in edges for a, b in zip(p, p[1:], strict=False)) for p in paths)


def test_heat_rank(spark):
    rows_ = catalog.gra_19_heat_rank(spark, "/root/testdata/sf0.01").collect()
    assert 0 < len(rows_) <= 20 and [r.score for r in rows_] == sorted((r.score for r in rows_), reverse=True)


def test_alignment_is_one_to_one(spark):
    out = catalog.aln_01_alignment(spark, WHERE).toPandas()
    assert len(out) and out.osm_id.is_unique and out.anchor_id.is_unique and (out.score >= np.array([0.8, 0.7, 0.6])[out["round"]] - 1e-12).all()


def test_apart_by_brute_force(spark):
    e = more.E.entities(spark, WHERE).toPandas()
    got = {(r.name, r.osm_id) for r in catalog.win_03b_apart(spark, WHERE).collect()}
    want = set()
    for name, g in e.sort_values(["size", "osm_id"]).groupby("name"):
        kept = []
        for r in g.itertuples():
            if len(kept) < 3 and all(abs(r.lat - k.lat) > 0.001 or abs(r.lon - k.lon) > 0.001 for k in kept):
                kept.append(r)
        want |= {(name, r.osm_id) for r in kept}
    assert got == want


def test_drift_of_vectors(spark):
    v = {r.vec_id: np.array(r.embedding, float) for r in more.table(spark, WHERE, "embeddings").collect()}
    a = np.array([v[k] for k in sorted(v)])
    b = (a + 0.25 * a[:, ::-1]) * np.where(np.arange(a.shape[1]) % 2 == 0, 1, -1)
    sign = np.where((a * b).sum(0) < 0, -1, 1)
    cos = ((a * b * sign).sum(1)) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    out = catalog.drf_03_vertex_drift(spark, WHERE).orderBy("id").toPandas()
    assert np.allclose(out[[c for c in out.columns if c != "id"][0]], 1 - cos, atol=1e-6)
    row = catalog.gra_21_transport(spark, WHERE).first()
    assert row.shared == len(v) and row.residual > 0
    assert catalog.drf_04_embedding_drift(spark, WHERE).count() == 1


def test_question(spark):
    near = {r.osm_id for r in catalog.nlp_01_question(spark, WHERE).collect()}
    assert all(r.wkg_class == "ECONOMY" for r in more.E.entities(spark, WHERE).collect() if r.osm_id in near)


def test_vector_cells_find_nine_of_ten(spark):
    for where in (WHERE, "/root/testdata/sf0.01"):
        exact = {(r.query, r.id) for r in more.top_04_vector_exact(spark, where).collect()}
        found = {(r.query, r.id) for r in more.top_04_vector_cells(spark, where).collect()}
        assert len(exact & found) >= 0.9 * len(exact), where


def test_ellipsoidal_distance(spark):
    # published geodesics: Flinders Peak to Buninyong, and a quarter meridian
    at = spark.createDataFrame([(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777, 54972.271), (0.0, 0.0, 90.0, 0.0, 10001965.729), (10.0, 20.0, 10.0, 20.0, 0.0), (0.0, 179.5, 0.0, -179.5, 111319.491)], "a double, b double, c double, d double, m double")
    rows_ = at.select("m", geo.ellipsoidal_m("a", "b", "c", "d").alias("x")).collect()
    assert all(abs(r.x - r.m) < 0.01 for r in rows_), rows_
    for r in more.geo_03_ellipsoidal(spark, WHERE).collect():
        assert abs(r.metres - r.sphere) <= 0.006 * r.sphere


def test_forecasts(spark):
    rows_ = [("line", f"{k:02d}", 10.0 + 3 * k) for k in range(12)] + [("two", "00", 4.0), ("two", "01", 8.0), ("fall", "00", 9.0), ("fall", "01", 4.0), ("fall", "02", 0.5)]
    out = {r.k: r for r in forecasts.arima(spark.createDataFrame(rows_, "k string, m string, v double"), "k", "m", "v").collect()}
    assert abs(out["line"].forecast - 46) < 0.6 and out["two"].method == "smoothing" and out["two"].forecast == pytest.approx((0.3 * 8 + 0.21 * 4) / 0.51)
    assert all(r.lower <= r.forecast <= r.upper and r.lower >= 0 for r in out.values())
    assert more.ts_01_forecast(spark, WHERE).count() == 5


def test_region_templates(spark):
    e, region = more.E.entities(spark, WHERE), more._region_of(spark, WHERE)
    plan, found = execute.run(e, "How many communities are there?", region=region)
    assert plan.template == "communities" and found.count() == more.tpl_13_communities(spark, WHERE).count()
    assert execute.run(e, "How good is the connectivity?", region=region)[1].count() == found.count()
    with pytest.raises(execute.Unresolved):
        execute.run(e, "How many communities are there?")
    near = more.tpl_14_event_diffusion(spark, WHERE).collect()
    assert near and [r.score for r in near] == sorted((r.score for r in near), reverse=True)


def test_radius_box_across_the_date_line(spark):
    pts = spark.createDataFrame([(k, float(y), float(x)) for k, (y, x) in enumerate((y, x) for y in range(-85, 90, 5) for x in range(-180, 180, 4))], "k long, lat double, lon double")
    for lat, lon, km in ((10.0, 179.0, 900.0), (-60.0, -178.0, 2500.0), (84.0, 10.0, 1500.0), (0.0, 0.0, 12000.0)):
        want = {r.k for r in pts.filter(geo.haversine_km(lat, lon, "lat", "lon") <= km).collect()}
        assert {r.k for r in spatial.within_radius(pts, lat, lon, km).collect()} == want and want
