"""Queries over repeated tables: their results by SQL, and how many pairs they make on the way."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalog import rows

from quadrille.operators import links, spatial
from quadrille.plans import catalog, more, parity  # noqa: F401


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    """2,000 parts and 1,000 suppliers: those of the smallest tables with shifted keys."""
    out = str(tmp_path_factory.mktemp("repeated"))
    for name, key, times in (("part", "p_partkey", 10), ("supplier", "s_suppkey", 100)):
        t = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        n = t.agg(F.max(key)).first()[0] + 1
        t.crossJoin(spark.range(times).select(F.col("id").alias("k"))).withColumn(key, F.col(key) + n * F.col("k")).drop("k").write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture
def pairs(monkeypatch):
    """The numbers of pairs that radius joins have made."""
    made, join = [], spatial.radius_join

    def counted(*a, **b):
        out = join(*a, **b)
        made.append(out.count())
        return out

    monkeypatch.setattr(spatial, "radius_join", counted)
    monkeypatch.setattr(links, "radius_join", counted)
    return made


def by_sql(where, name):
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet/*.parquet'")
    return rows(con.execute(catalog.SQL[name]).df())


def test_nearest_anchor(spark, where, pairs):
    assert rows(more.join_25_nearest_anchor(spark, where).toPandas()) == by_sql(where, "join_25_nearest_anchor")
    assert sum(pairs) < 50_000


def test_inductive_mean(spark, where, pairs):
    assert rows(parity.geo_16_inductive_mean(spark, where).toPandas()) == by_sql(where, "geo_16_inductive_mean")
    assert sum(pairs) < 100_000


def test_nearest_of_crowds_and_gaps(spark):
    """A crowd at one place, a dense patch across the date line, a lone place, places at the poles, none."""
    crowd = [(k, 10.0, 20.0) for k in range(400, 0, -1)]
    patch = [(1000 + k, -3 + k % 20 * 0.01, (179.9 + k // 20 * 0.01 + 180) % 360 - 180) for k in range(400)]
    right = spark.createDataFrame([*crowd, *patch, (5000, 89.9, 0.0), (5001, -89.9, 170.0), (5002, None, None)], "anchor_id long, alat double, alon double")
    at = [(10.0, 20.0), (10.001, 20.0), (-2.95, -179.95), (-3.0, 179.9), (40.0, -100.0), (89.95, 179.0), (-80.0, -10.0), (-1.0, 178.0), (None, 1.0), (float("nan"), float("nan"))]
    left = spark.createDataFrame([(k, *at[k % len(at)]) for k in range(3 * len(at))], "osm_id long, lat double, lon double")
    for k, km in ((1, 3000.0), (3, 3000.0), (500, 12000.0), (2, 0.5)):
        near = left.join(spatial.nearest_by_point(left, right, k, km), ["lat", "lon"])
        got = sorted((r.osm_id, r.distance_km, r.anchor_id) for r in near.collect())
        want, by = [], {}
        for r in spatial.radius_join(left, right, km).collect():
            by.setdefault(r.osm_id, []).append((r.osm_id, r.distance_km, r.anchor_id))
        for found in by.values():
            want += sorted(found)[:k]
        assert got == sorted(want) and got


def test_predicted_links(spark, where, pairs):
    assert rows(catalog.uslp_01_predicted_links(spark, where).toPandas()) == by_sql(where, "uslp_01_predicted_links")
    # the first join is that of the rejected links, which nobody asks for here
    assert 0 < max(pairs[1:]) < pairs[0]


def test_predicted_by_rings_and_by_all_pairs(spark, monkeypatch):
    at = lambda k: (k * 37 % 101 / 10, k * 53 % 97 / 10 + 174)  # noqa: E731  across the date line
    place = lambda k: (at(k)[0], (at(k)[1] + 180) % 360 - 180)
    heads = spark.createDataFrame([(k, "ab"[k % 2], *place(k % 40)) for k in range(120)] + [(200, "a", None, None)], "head long, relation string, lat double, lon double")
    pool = spark.createDataFrame([(k % 150, *place(k % 60)) for k in range(300)] + [(201, None, 1.0)], "tail long, alat double, alon double")
    of_head, of_tail = F.when(F.col("head") % 7 != 0, F.col("head") % 10 / 10), F.col("tail") % 4 / 4
    for name, cls, threshold in ((of_head, of_tail, 0.5), (of_tail, of_head, 0.85), (of_head, F.lit(0.5), 0.1), ((F.col("head") + F.col("tail")) % 10 / 10, of_tail, 0.6)):
        got = links.predicted(heads, pool, 900.0, name, cls, threshold, 3)[0]
        with monkeypatch.context() as m:
            m.setattr(links, "_best_by_point", lambda *a: None, raising=False)
            want = links.predicted(heads, pool, 900.0, name, cls, threshold, 3)[0]
        assert got.columns == want.columns and want.count() and sorted(map(str, got.drop("alat", "alon").collect())) == sorted(map(str, want.drop("alat", "alon").collect()))


def test_alignment_makes_pairs_in_reach_alone(spark, where, pairs):
    assert catalog.aln_01_alignment(spark, where).count() and sum(pairs) < 15_000


def test_alignment_by_brute_force(spark):
    here = [(k, (None, 0, 1)[k % 3], k * 37 % 50 / 10, k * 53 % 40 / 10, [k % 5 / 5, k % 3 / 3]) for k in range(150)]
    there = [(k, (0, 1, None, 1)[k % 4], k * 31 % 50 / 10, k * 41 % 40 / 10, [k % 7 / 7, k % 2 / 2]) for k in range(60)] + [(99, 0, None, None, [1.0, 1.0])]
    left = spark.createDataFrame(here, "osm_id long, block int, lat double, lon double, lvec array<double>")
    right = spark.createDataFrame(there, "anchor_id long, block int, alat double, alon double, rvec array<double>")
    joined = {(r.osm_id, r.anchor_id): r.distance_km for r in spatial.radius_join(left, right, 300.0).collect()}
    a, b = {r[0]: r for r in here}, {r[0]: r for r in there}
    score = {}
    for (x, y), d in joined.items():
        if a[x][1] is None or b[y][1] is None or a[x][1] == b[y][1]:
            n = math.hypot(*a[x][4]) * math.hypot(*b[y][4])
            score[x, y] = 0.5 * (1 - d / 300) + 0.5 * (sum(p * q for p, q in zip(a[x][4], b[y][4], strict=True)) / n if n else 0)
    want, used_a, used_b = set(), set(), set()
    rounds = [0.9, 0.7, 0.2, -1.0]
    for number, threshold in enumerate(rounds):
        best = {}
        for (x, y), s in score.items():
            if s >= threshold and x not in used_a and y not in used_b:
                best[x] = min(best.get(x, (2.0, 0)), (-round(s, 12), y))
        of = {}
        for x, (s, y) in best.items():
            of[y] = min(of.get(y, (s, x)), (s, x))
        want |= {(x, y, number) for y, (_, x) in of.items()}
        used_a, used_b = used_a | {x for _, x in of.values()}, used_b | set(of)
    assert {(r.osm_id, r.anchor_id, r["round"]) for r in links.aligned(left, right, 300.0, rounds).collect()} == want
