"""Files, streams, plans, and the operators without SQL."""

import json

import numpy as np
from pyspark.sql import functions as F

from quadrille.functions.romanize import romanize
from quadrille.operators import drift, links, search, walks
from quadrille.plans import execute, parser
from quadrille.sources import files
from quadrille.streaming import ingest


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("_id,count_date,name,longitude,latitude\n1,2026-01-02,X,-79.4,43.7\n2,,Y,bad,43.8\n")
    a = {r.source_id: r for r in files.csv_records(spark, str(tmp_path / "a.csv"), "count_date").collect()}
    assert a["1"].attributes["name"] == "X" and (a["1"].lon, a["1"].lat) == (-79.4, 43.7) and str(a["1"].date) == "2026-01-02" and a["2"].lon is None and a["2"].date is None
    shape = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": "f1", "properties": {"AREA": "7"}, "geometry": shape}, {"type": "Feature", "id": "f2", "properties": {}, "geometry": {"type": "Point", "coordinates": [2.5, -1]}}]}))
    b = {r.source_id: r for r in files.geojson_records(spark, str(tmp_path / "b.json")).collect()}
    assert b["f1"].attributes == {"AREA": "7"} and b["f1"].lon is None and json.loads(b["f1"].geometry) == shape["coordinates"] and (b["f2"].lon, b["f2"].lat) == (2.5, -1.0)
    ring = files.ring_of("name\n1\n 0 0\n 4 0\n 4 3\n 0 0\nEND\n!2\n 1 1\n 2 1\n 1 1\nEND\nEND\n")
    assert ring == [(0, 0), (4, 0), (4, 3)] and files.box_of(ring) == (0, 0, 4, 3) and files.well_known_text(ring) == "POLYGON((0 0, 4 0, 4 3, 0 0))"
    lon, lat = files.point_text(F.lit("Point(-88.2 17.5)"))
    assert tuple(spark.range(1).select(lon, lat).first()) == (-88.2, 17.5)
    (tmp_path / "c.nt").write_text('<http://a> <http://b> "x y"@en .\n# note\n<http://a> <http://c> <http://d> .\n')
    assert {tuple(r) for r in files.triples(spark, str(tmp_path / "c.nt")).collect()} == {("http://a", "http://b", "x y"), ("http://a", "http://c", "http://d")}


def test_stream_upserts_once(spark, tmp_path):
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id long, v string, seq long").coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    handle = ingest.upsert_into(spark, target, ["id"], "seq", ["v"])
    ingest.run_once(ingest.follow(spark, source, schema), marks, handle)
    spark.createDataFrame([(1, None, 3), (3, "d", 1)], schema).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        ingest.run_once(ingest.follow(spark, source, schema), marks, handle)
    assert {tuple(r) for r in ingest.latest(spark, target).collect()} == {(1, "b", 3), (2, "c", 1), (3, "d", 1)}


def test_replace_scope_and_mark(spark, tmp_path):
    where = str(tmp_path / "t")
    ingest.replace_scope(spark.createDataFrame([(1, "a"), (2, "b")], "v int, s string"), where, ["s"])
    ingest.replace_scope(spark.createDataFrame([(9, "b")], "v int, s string"), where, ["s"])
    assert {tuple(r) for r in spark.read.parquet(where).select("v", "s").collect()} == {(1, "a"), (9, "b")}
    df = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-03"), (3, None)], "id int, d string").withColumn("d", F.col("d").cast("date"))
    assert {r.id for r in ingest.above_mark(df, "d", "2026-01-02").collect()} == {2, 3} and ingest.above_mark(df, "d", None).count() == 3


def test_parser():
    p = parser.parse("Which cafes are within 2.5 km of Central Park?", {"cafe"})
    assert (p.template, p.slots["cls"], p.slots["b"], p.radius_km) == ("within", "cafe", "Central Park", 2.5) and p.valid
    assert parser.parse("what is the nearest bakery to City Hall", {"bakery"}).slots["cls"] == "bakery"
    assert parser.parse("How far is it from A to B?").template == "distance" and parser.parse("nearest pub north of X").template == "cone"
    assert parser.parse("small ring").template == "search" and parser.singular("bakeries") == "bakery" and parser.singular("buses") == "bus" and parser.singular("grass") == "grass"


def test_plans(spark):
    df = spark.createDataFrame([(1, "Hall", "place", 0.0, 0.0), (2, "Inn", "cafe", 0.01, 0.0), (3, "Far", "cafe", 3.0, 0.0), (4, "East", "cafe", 0.0, 0.5), (5, None, "cafe", None, None)], "osm_id long, name string, wkg_class string, lat double, lon double")
    assert [r.osm_id for r in execute.run(df, "which cafes are within 50 km of Hall", {"cafe"})[1].collect()] == [2]
    assert [r.osm_id for r in execute.run(df, "nearest cafe to Hall", {"cafe"})[1].collect()] == [2, 4, 3]
    assert [r.osm_id for r in execute.run(df, "nearest cafe east of Hall", {"cafe"})[1].collect()] == [4]
    row = execute.run(df, "how far is it from Far to Hall?")[1].first()
    assert abs(row.distance_km - 333.58) < 0.1 and row.compass == "north"


def test_apart_and_alignment(spark):
    ranked = spark.createDataFrame([("a", 1, 1, 0.0, 0.0), ("a", 2, 2, 0.0, 0.0001), ("a", 3, 3, 0.0, 1.0), ("b", 4, 4, 0.0, 0.0)], "name string, osm_id long, rank int, lat double, lon double")
    assert {r.osm_id for r in search.apart(ranked).collect()} == {1, 3, 4}
    left = spark.createDataFrame([(1, "x", 0.0, 0.0, [1.0, 0.0]), (2, "x", 0.0, 0.001, [0.0, 1.0])], "osm_id long, block string, lat double, lon double, lvec array<double>")
    right = spark.createDataFrame([(10, "x", 0.0, 0.0, [0.0, 1.0]), (11, None, 0.0, 0.001, [1.0, 0.0])], "anchor_id long, block string, alat double, alon double, rvec array<double>")
    assert {(r.osm_id, r.anchor_id) for r in links.aligned(left, right, 2.5, [0.8, 0.5]).collect()} == {(1, 11), (2, 10)}


def test_drift(spark):
    r = np.random.default_rng(0)
    a = [(r.standard_normal(3).tolist(),) for _ in range(50)]
    x, y = spark.createDataFrame(a, "vector array<double>"), spark.createDataFrame([([v + 1 for v in p],) for (p,) in a], "vector array<double>")
    assert drift.sliced_wasserstein(x, x, 3, 10).first().distance == 0 and drift.sliced_wasserstein(x, y, 3, 10).first().distance > 0.3
    basis = spark.createDataFrame([(i, v) for i, (v,) in enumerate(a)], "id long, loadings array<double>")
    row = drift.transport(basis, basis, 1e-9).first()
    assert row.shared == 50 and np.allclose(row.matrix, np.eye(3), atol=1e-6)
    assert drift.transport(basis.filter("id < 5"), basis).count() == 0
    assert all(abs(v.drift) < 1e-12 for v in drift.vertices(basis, basis.withColumn("loadings", F.transform("loadings", lambda q: -q))).collect())


def test_walks_stay_on_edges(spark):
    edges = [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0), (3, 0, 1.0)]
    pairs = {(a, b) for a, b, _ in edges} | {(b, a) for a, b, _ in edges}
    out = walks.walks(spark.createDataFrame(edges, "src long, dst long, w double"), 6, 3).collect()
    assert len(out) == 12 and all(len(w.path) == 6 and all(e in pairs for e in zip(w.path, w.path[1:])) for w in out)


def test_romanize():
    assert [romanize(x) for x in ("café", "Éireann", "piñata", "서울", "O'Neil-Ann", None)] == ["cafe", "eireann", "pinata", "seoul", "o'neil-ann", None]


def test_writers(spark, tmp_path):
    import gzip
    import json

    from quadrille.sources import writers

    at = lambda name: str(tmp_path / name)
    links = spark.createDataFrame([(1, 2, "near", 0.9, "s1"), (1, 2, "near", 0.4, "s1"), (3, 4, "near", 0.1, "s1"), (5, 6, "near", None, "s2")], "head long, tail long, relation string, total double, snapshot string")
    for _ in range(2):
        writers.write_links(links, at("links"), ["snapshot"], 0.5, ["snapshot", "head", "tail", "relation"])
    out = spark.read.parquet(at("links"))
    assert {(r.head, r.accepted, r.total) for r in out.collect()} == {(1, "true", 0.9), (3, "false", 0.1), (5, "false", None)} and out.count() == 3
    # a filter on the scope reads its directories alone
    plan = out.filter("snapshot = 's1' and accepted = 'true'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(snapshot" in plan
    writers.write_jsonl(out.filter("accepted = 'true'").select("head", "tail"), at("jsonl"))
    assert [json.loads(line.value) for line in spark.read.text(at("jsonl")).collect()] == [{"head": 1, "tail": 2}]
    writers.write_edge_list(spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, w double"), at("edges"))
    assert spark.read.text(at("edges")).first().value == "1 2 0.5"
    writers.write_csv(spark.createDataFrame([('say "x", y', 1)], "q string, n long"), at("csv"))
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(at("csv")).collect()] == [('say "x", y', "1")]
    for k in range(2):
        with gzip.open(tmp_path / f"{k}.tsv.gz", "wt") as f:
            f.write(f"{k}\tname {k}\n")
    rows = writers.read_tsv(spark, [at("0.tsv.gz"), at("1.tsv.gz")], "id long, name string")
    assert {(r.id, r.name) for r in rows.collect()} == {(0, "name 0"), (1, "name 1")}
    cut = writers.split_by_membership(spark.createDataFrame([(1, 5), (2, 0), (3, None)], "id long, m long"), "m", ["a", "b", "c"])
    assert {(r.id, r.target) for r in cut.collect()} == {(1, "a"), (1, "c")}
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "scope string, v long")
    writers.write_registered(df, at("data"), at("registry"), ["scope"])
    writers.write_registered(df.filter("v = 1"), at("data"), at("registry"), ["scope"])
    assert {(r.scope, r.n_rows) for r in spark.read.parquet(at("registry")).collect()} == {("x", 1), ("y", 1)}
    assert spark.read.parquet(at("data")).count() == 2
    full = writers.enriched(df, spark.createDataFrame([("x", None), ("y", 9)], "scope string, v long"), ["scope"], ["v"])
    assert {tuple(r) for r in full.collect()} == {("x", 1), ("x", 2), ("y", 9)}
