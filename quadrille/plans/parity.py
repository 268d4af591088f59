"""More registered queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.functions import geo, romanize, stats, text, vector
from quadrille.operators import distributions, graph, picks, spatial, walks
from quadrille.plans.catalog import GRAPH, HERE, LAT, LON, _graph, km, query
from quadrille.sources import entities as E
from quadrille.sources.entities import table

VEC = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
DIST = "(1 - list_dot_product(e, q)/(sqrt(list_dot_product(e, e))*sqrt(list_dot_product(q, q))))"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", vector.doubles("embedding").alias("e"))


@query(f"SELECT osm_id, round({HERE}, 3) AS km, contains(name, 'ring') AS named FROM entity WHERE {HERE} <= 1000 OR contains(name, 'ring')")
def pred_15_cutoff_with_bypass(spark, d):
    df = E.entities(spark, d).withColumn("km", geo.haversine_km(LAT, LON, "lat", "lon")).withColumn("named", F.col("name").contains("ring"))
    return df.filter((F.col("km") <= 1000) | F.col("named")).select("osm_id", F.round("km", 3).alias("km"), "named")


@query("SELECT o_custkey, count(*) AS months FROM (SELECT DISTINCT o_custkey, strftime(o_orderdate, '%m') AS m FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01' INTERSECT SELECT DISTINCT o_custkey, strftime(o_orderdate, '%m') FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2001-01-01') GROUP BY 1", views=False)
def join_16_snapshot_pair(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "MM").alias("m"), F.year("o_orderdate").alias("y"))
    a, b = (o.filter(F.col("y") == y).select("o_custkey", "m").distinct() for y in (1999, 2000))
    return a.join(b, ["o_custkey", "m"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("months"))


@query("SELECT head, coalesce(min(CASE WHEN osm_lat BETWEEN -60 AND 0 THEN 0 WHEN osm_lat BETWEEN 0 AND 30 THEN 1 END), 2) AS region FROM (SELECT head, lat AS osm_lat FROM link JOIN entity ON head = osm_id WHERE accepted) GROUP BY head")
def join_23_first_region(spark, d):
    regions = spark.createDataFrame([(0, -60.0, 0.0), (1, 0.0, 30.0)], "region int, s double, n double")
    heads = E.links(spark, d).filter("accepted").select(F.col("head").alias("osm_id")).distinct().join(E.entities(spark, d).select("osm_id", "lat"), "osm_id")
    hit = heads.join(F.broadcast(regions), F.col("lat").between(F.col("s"), F.col("n")), "left")
    return hit.groupBy(F.col("osm_id").alias("head")).agg(F.coalesce(F.min("region"), F.lit(2)).alias("region"))


@query(f"WITH v AS ({VEC}), s AS (SELECT vec_id AS a, e AS q FROM v WHERE vec_id < 5), r AS (SELECT a, vec_id, row_number() OVER (PARTITION BY a ORDER BY {DIST}, vec_id) AS rank FROM v, s WHERE vec_id <> a) SELECT a, vec_id, rank FROM r WHERE rank <= 20", views=False)
def join_26_top_per_anchor(spark, d):
    v = _vectors(spark, d)
    seeds = v.filter("vec_id < 5").select(F.col("vec_id").alias("a"), F.col("e").alias("q"))
    near = v.crossJoin(F.broadcast(seeds)).filter("vec_id <> a").withColumn("distance", vector.cosine_distance(F.col("e"), F.col("q")))
    return picks.first_of(near, ["a"], [F.col("distance").asc(), F.col("vec_id").asc()], 20, "rank").select("a", "vec_id", "rank")


@query("SELECT brand, n FROM (SELECT brand, count(*) AS n FROM entity GROUP BY 1) WHERE brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')")
def agg_05_vocabulary_pool(spark, d):
    vocabulary = spark.createDataFrame([(f"Brand#{k}",) for k in range(1, 5)], "brand string")
    return E.entities(spark, d).groupBy("brand").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(vocabulary), "brand", "left_semi")


@query("SELECT osm_id % 9 AS community, count(*) AS n, sum(CASE WHEN wkg_class = 'ECONOMY' THEN 1 ELSE 0 END) AS of_class FROM entity GROUP BY 1")
def agg_06_community_sizes(spark, d):
    return E.entities(spark, d).groupBy((F.col("osm_id") % 9).alias("community")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("wkg_class") == "ECONOMY").alias("of_class"))


@query("SELECT count(*) AS total, count(CASE WHEN wkg_class <> 'ECONOMY' THEN 1 END) AS with_class FROM entity")
def agg_17_entity_counts(spark, d):
    return E.entities(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("wkg_class") != "ECONOMY", 1)).alias("with_class"))


@query("SELECT community, wkg_class, n FROM (SELECT community, wkg_class, n, row_number() OVER (PARTITION BY community ORDER BY n DESC, wkg_class) AS r FROM (SELECT osm_id % 9 AS community, wkg_class, count(*) AS n FROM entity GROUP BY 1, 2)) WHERE r = 1")
def agg_25_dominant_class(spark, d):
    counts = E.entities(spark, d).groupBy((F.col("osm_id") % 9).alias("community"), "wkg_class").agg(F.count(F.lit(1)).alias("n"))
    return picks.first_of(counts, ["community"], [F.col("n").desc(), F.col("wkg_class")])


@query("SELECT sum(CASE WHEN s AND t THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN s AND NOT t THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT s AND t THEN 1 ELSE 0 END) AS fn FROM (SELECT n_chars > 2000 AS s, quality = 1 AS t FROM documents JOIN labels USING (doc_id))", views=False)
def agg_26_confusion(spark, d):
    x = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 2000).alias("s")).join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("t")), "doc_id")
    return x.agg(F.count_if(F.col("s") & F.col("t")).alias("tp"), F.count_if(F.col("s") & ~F.col("t")).alias("fp"), F.count_if(~F.col("s") & F.col("t")).alias("fn"))


@query(f"WITH g AS ({GRAPH}), s AS (SELECT src AS i, w FROM g UNION ALL SELECT dst, w FROM g WHERE src <> dst), d AS (SELECT i, count(*) AS k, sum(w) AS s FROM s GROUP BY i) SELECT count(*) AS vertices, round(avg(k), 6) AS mean_degree, round(stddev_pop(k), 6) AS std_degree, min(k) AS least, max(k) AS most FROM d", views=False)
def agg_29_graph_statistics(spark, d):
    g = graph.degrees(_graph(spark, d))
    return g.agg(F.count(F.lit(1)).alias("vertices"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.round(F.stddev_pop("degree"), 6).alias("std_degree"), F.min("degree").alias("least"), F.max("degree").alias("most"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y_%m_01') AS snapshot_id FROM orders ORDER BY snapshot_id DESC LIMIT 12", views=False)
def agg_30_newest_snapshots(spark, d):
    return table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy_MM_01").alias("snapshot_id")).distinct().orderBy(F.col("snapshot_id").desc()).limit(12)


@query("SELECT event_id, len(json_keys(props)) AS n_keys FROM events", views=False)
def agg_31_key_count(spark, d):
    return table(spark, d, "events").select("event_id", F.size(F.json_object_keys("props")).alias("n_keys"))


@query("SELECT s_nationkey AS country, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r = 1", views=False)
def win_02_distinct_on(spark, d):
    return picks.first_of(table(spark, d, "supplier"), ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")]).select(F.col("s_nationkey").alias("country"), "s_suppkey")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1", views=False)
def win_06_last_of_buffer(spark, d):
    return picks.first_of(table(spark, d, "events"), ["user_id"], [F.col("event_id").desc()]).select("user_id", "event_id")


@query("SELECT relation, head, tail FROM (SELECT relation, head, tail, row_number() OVER (PARTITION BY relation ORDER BY order_id, line) AS r FROM link WHERE total >= 0.8) WHERE r = 1")
def win_09_first_verified(spark, d):
    return picks.first_of(E.links(spark, d).filter("total >= 0.8"), ["relation"], [F.col("order_id"), F.col("line")]).select("relation", "head", "tail")


@query(f"WITH v AS ({VEC}), s AS (SELECT e AS q FROM v WHERE vec_id = 3) SELECT vec_id FROM (SELECT vec_id, {DIST} AS d FROM v, s ORDER BY d, vec_id LIMIT 40) WHERE d <= 0.5", views=False)
def top_06_cutoff_after_limit(spark, d):
    v = _vectors(spark, d)
    near = v.crossJoin(F.broadcast(v.filter("vec_id = 3").select(F.col("e").alias("q")))).withColumn("d", vector.cosine_distance(F.col("e"), F.col("q")))
    return near.orderBy("d", "vec_id").limit(40).filter("d <= 0.5").select("vec_id")


@query(f"WITH v AS ({VEC}), s AS (SELECT e AS q FROM v WHERE vec_id = 3) SELECT vec_id, round(-list_dot_product(e, q), 6) AS score FROM v, s ORDER BY list_dot_product(e, q) DESC, vec_id LIMIT 15", views=False)
def top_07_inner_product(spark, d):
    v = _vectors(spark, d)
    near = v.crossJoin(F.broadcast(v.filter("vec_id = 3").select(F.col("e").alias("q")))).withColumn("p", vector.dot(F.col("e"), F.col("q")))
    return near.orderBy(F.col("p").desc(), "vec_id").limit(15).select("vec_id", F.round(-F.col("p"), 6).alias("score"))


@query("SELECT osm_id FROM entity WHERE wkg_class IN ('ECONOMY', 'PROMO') ORDER BY size DESC, osm_id LIMIT 30")
def top_12_class_closure(spark, d):
    return E.entities(spark, d).filter(F.col("wkg_class").isin("ECONOMY", "PROMO")).orderBy(F.col("size").desc(), "osm_id").limit(30).select("osm_id")


@query("SELECT p_partkey AS osm_id FROM part WHERE p_size < 5 UNION SELECT p_partkey FROM part WHERE p_retailprice > 1500", views=False)
def set_04_union(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "osm_id")
    return p.filter("p_size < 5").select("osm_id").union(p.filter("p_retailprice > 1500").select("osm_id")).distinct()


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'", views=False)
def set_03_intersection(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").intersect(o.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT anchor_id, round((floor((alat + 90)/0.17578125) + 0.5)*0.17578125 - 90, 8) AS clat, round((floor((alon + 180)/0.3515625) + 0.5)*0.3515625 - 180, 8) AS clon FROM anchor")
def geo_09_cell_center(spark, d):
    h, w = geo.cell_sizes(4)
    return E.anchors(spark, d).select("anchor_id", F.round(geo.cell_center("alat", -90, h), 8).alias("clat"), F.round(geo.cell_center("alon", -180, w), 8).alias("clon"))


@query(f"WITH c AS (SELECT DISTINCT (floor((alat + 90)/45) + 0.5)*45 - 90 AS y, (floor((alon + 180)/45) + 0.5)*45 - 180 AS x FROM anchor) SELECT a.y, a.x, round(max({km('a.y', 'a.x', 'b.y', 'b.x')}), 3) AS d_max FROM c a, c b GROUP BY 1, 2")
def geo_10_farthest_cell(spark, d):
    h, w = geo.cell_sizes(1)
    c = E.anchors(spark, d).select(geo.cell_center("alat", -90, h).alias("y"), geo.cell_center("alon", -180, w).alias("x")).distinct()
    b = c.select(F.col("y").alias("by"), F.col("x").alias("bx"))  # at most 32 cells
    return c.crossJoin(F.broadcast(b)).groupBy("y", "x").agg(F.round(F.max(geo.haversine_km("y", "x", "by", "bx")), 3).alias("d_max"))


@query(f"WITH k AS (SELECT osm_id, vec_lat, r, w FROM (SELECT e.osm_id, a.alat AS vec_lat, row_number() OVER (PARTITION BY e.osm_id ORDER BY {km('e.lat', 'e.lon', 'a.alat', 'a.alon')}, a.anchor_id) AS r, greatest(1/ln(greatest({km('e.lat', 'e.lon', 'a.alat', 'a.alon')}, CAST(1.1 AS DOUBLE))), exp(CAST(1 AS DOUBLE))) AS w FROM entity e, anchor a WHERE {km('e.lat', 'e.lon', 'a.alat', 'a.alon')} <= 4000) WHERE r <= 5) SELECT osm_id, round(sum(w*vec_lat)/sum(w), 6) AS mean FROM k GROUP BY osm_id")
def geo_16_inductive_mean(spark, d):
    e = E.entities(spark, d).select("osm_id", "lat", "lon")
    near = spatial.nearest_by_point(e, E.anchors(spark, d).select("anchor_id", "alat", "alon"), 5, 4000.0).withColumn("w", geo.inverse_distance_weight("distance_km"))
    pairs = e.join(near, ["lat", "lon"])
    near = picks.first_of(pairs, ["osm_id"], [F.col("distance_km").asc(), F.col("anchor_id").asc()], 5)
    return near.groupBy("osm_id").agg(F.round(F.sum(F.col("w") * F.col("alat")) / F.sum("w"), 6).alias("mean"))


@query("SELECT osm_id, round((0.6*s + CASE WHEN l IS NULL THEN 0 ELSE 0.25*l END + 0.15*c)/(0.75 + CASE WHEN l IS NULL THEN 0 ELSE 0.25 END), 6) AS confidence FROM (SELECT osm_id, CAST(size AS DOUBLE)/50 AS s, CASE WHEN osm_id % 3 = 0 THEN CAST(1 AS DOUBLE) END AS l, CASE WHEN wkg_class = 'ECONOMY' THEN CAST(1 AS DOUBLE) ELSE 0 END AS c FROM entity)")
def math_03_available_mean(spark, d):
    df = E.entities(spark, d)
    link = F.when(F.col("osm_id") % 3 == 0, 1.0)
    return df.select("osm_id", F.round(stats.weighted_available([(F.col("size") / 50, 0.6), (link, 0.25), ((F.col("wkg_class") == "ECONOMY").cast("double"), 0.15)]), 6).alias("confidence"))


@query("SELECT l_orderkey, count(*) >= 2 AND min(l_quantity) = max(l_quantity) AS degenerate FROM lineitem GROUP BY 1", views=False)
def math_10_degenerate(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(((F.count(F.lit(1)) >= 2) & (F.min("l_quantity") == F.max("l_quantity"))).alias("degenerate"))


@query("SELECT osm_id, k, v FROM (SELECT osm_id, 'class' AS k, wkg_class AS v FROM entity UNION ALL SELECT osm_id, 'brand', brand FROM entity UNION ALL SELECT osm_id, 'size', CAST(size AS VARCHAR) FROM entity)")
def json_01_explode_object(spark, d):
    text_ = E.entities(spark, d).select("osm_id", F.to_json("tags").alias("j"))
    return text_.select("osm_id", F.explode(F.from_json("j", "map<string,string>")).alias("k", "v"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS k FROM supplier", views=False)
def json_03_permissive(spark, d):
    t = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('noise {"k": '), F.col("s_suppkey").cast("string"), F.lit("} more"))).otherwise(F.lit("no object {"))
    return table(spark, d, "supplier").select("s_suppkey", F.from_json(F.regexp_extract(t, r"\{[^{}]*\}", 0), "k bigint")["k"].alias("k"))


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS cosine FROM embeddings", views=False)
def vec_03_zero_guard(spark, d):
    e = F.transform(F.col("e"), lambda x: F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(x))
    return _vectors(spark, d).select("vec_id", F.round(vector.cosine(e, F.col("e")), 9).alias("cosine"))


@query("SELECT osm_id, CASE WHEN size % 10 = 0 THEN NULL ELSE size END AS guarded FROM entity")
def math_09_finite(spark, d):
    bad = F.when(F.col("size") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("size").cast("double"))
    return E.entities(spark, d).select("osm_id", stats.finite(bad, -1.0).alias("g")).select("osm_id", F.when(F.col("g") >= 0, F.col("g")).cast("int").alias("guarded"))


@query(f"WITH g AS ({GRAPH}), s AS (SELECT src AS a, dst AS b, w FROM g WHERE src <> dst UNION ALL SELECT dst, src, w FROM g WHERE src <> dst) SELECT a AS src, b AS dst, round(w/sum(w) OVER (PARTITION BY a), 8) AS p FROM s", views=False)
def gra_27_transitions(spark, d):
    return walks.transitions(_graph(spark, d)).select("src", "dst", F.round("p", 8).alias("p"))


@query(f"WITH g AS ({GRAPH}), s AS (SELECT src AS a, dst AS b, w FROM g WHERE src <> dst UNION ALL SELECT dst, src, w FROM g WHERE src <> dst) SELECT a AS id, round(sum(w*(a%7)*((a%7)-(b%7))), 6) AS term FROM s GROUP BY a", views=False)
def gra_16_dirichlet_terms(spark, d):
    g = _graph(spark, d)
    return graph.dirichlet_terms(g, g.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", (F.col("id") % 7).cast("double").alias("s"))).select("id", F.round("term", 6).alias("term"))


@query(f"WITH g AS ({GRAPH}), s AS (SELECT src AS row, dst AS col, w FROM g WHERE src <> dst UNION ALL SELECT dst, src, w FROM g WHERE src <> dst) SELECT row, col, -w AS value FROM s UNION ALL SELECT row, row, sum(w) FROM s GROUP BY row", views=False)
def gra_05_laplacian(spark, d):
    return graph.laplacian(_graph(spark, d), False)


@query("SELECT osm_id, dense_rank() OVER (ORDER BY wkg_class) - 1 AS signal FROM entity")
def gra_12_class_signal(spark, d):
    classes = E.entities(spark, d).select("wkg_class").distinct()
    ranked = classes.withColumn("signal", F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy("wkg_class")) - 1)
    return E.entities(spark, d).join(F.broadcast(ranked), "wkg_class").select("osm_id", "signal")


@query("SELECT m AS month, round(coalesce(0.5*sum(p*ln(p/((p+q)/2))) + 0.5*sum(q*ln(q/((p+q)/2))), 0), 6) AS js FROM (SELECT m, c, p, lag(p) OVER (PARTITION BY c ORDER BY m) AS q FROM (SELECT m, c, CAST(n AS DOUBLE)/sum(n) OVER (PARTITION BY m) AS p FROM (SELECT strftime(o_orderdate, '%Y') AS m, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1, 2))) WHERE q IS NOT NULL GROUP BY m", views=False)
def bat_03_consecutive_drift(spark, d):
    o = table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy"))
    s = distributions.shares(o, ["month"], "o_orderpriority")
    q = F.lag("share").over(W.partitionBy("o_orderpriority").orderBy("month"))
    x = s.withColumn("q", q).filter("q is not null").withColumn("m", (F.col("share") + F.col("q")) / 2)
    return x.groupBy("month").agg(F.round(0.5 * F.sum(F.col("share") * F.log(F.col("share") / F.col("m"))) + 0.5 * F.sum(F.col("q") * F.log(F.col("q") / F.col("m"))), 6).alias("js"))


@query("SELECT DISTINCT p_name, p_name AS roman FROM part", views=False)
def str_06_romanized(spark, d):
    return table(spark, d, "part").select("p_name").distinct().select("p_name", romanize.romanized("p_name").alias("roman"))


@query("SELECT DISTINCT p_name, CASE WHEN regexp_matches(p_name, '[^aeiou]y$') THEN regexp_replace(p_name, 'y$', 'ies') WHEN regexp_matches(p_name, '(s|x|z|ch|sh)$') THEN p_name || 'es' ELSE p_name || 's' END AS label FROM part", views=False)
def str_19_plural_label(spark, d):
    return table(spark, d, "part").select("p_name").distinct().select("p_name", text.plural_label("p_name").alias("label"))


@query()
def gra_25_walks(spark, d):
    return walks.walks(_graph(spark, d), 8, 2)
