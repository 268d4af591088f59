"""The registered queries, each with its SQL for comparison on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.functions import geo, stats, text, vector
from quadrille.operators import distributions, drift, graph, hierarchy, links, picks, search, spatial
from quadrille.plans import execute
from quadrille.sources import entities as E
from quadrille.sources.entities import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            more = f", {sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else sql
            SQL[f.__name__] = f"WITH {E.SQL.strip()} {more}" if views else sql
        return f

    return add


def km(a: str, b: str, c: str, d: str) -> str:
    """Haversine kilometres as SQL."""
    h = f"(pow(sin(radians({c}-({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-({b}))/2),2))"
    return f"(2*CAST(6371 AS DOUBLE)*atan2(sqrt({h}),sqrt(1-{h})))"


def brg(a: str, b: str, c: str, d: str) -> str:
    deg = f"(degrees(atan2(sin(radians({d}-({b})))*cos(radians({c})), cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians({d}-({b})))))+360)"
    return f"({deg} - 360*floor({deg}/360))"


LAT, LON, REACH = 10.0, 20.0, 1500.0
HERE = km("10", "20", "lat", "lon")


# scans and time


@query("SELECT l_orderkey % 7 AS way, round(avg(l_quantity),6) AS lat, round(avg(l_extendedprice),4) AS lon, count(*) AS members FROM lineitem GROUP BY 1", views=False)
def src_03_member_centroid(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 7).alias("way")).agg(F.round(F.avg("l_quantity"), 6).alias("lat"), F.round(F.avg("l_extendedprice"), 4).alias("lon"), F.count(F.lit(1)).alias("members"))


@query("SELECT k, v, count(*) AS n FROM (SELECT 'class' AS k, wkg_class AS v FROM entity UNION ALL SELECT 'brand', brand FROM entity UNION ALL SELECT 'size', CAST(size AS VARCHAR) FROM entity) GROUP BY k, v")
def src_05_tag_counts(spark, d):
    return E.entities(spark, d).select(F.explode("tags").alias("k", "v")).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, count(*) AS n FROM entity")
def src_06_bounding_box(spark, d):
    return E.entities(spark, d).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') WHERE r = 1", views=False)
def src_08_state_as_of(spark, d):
    ev = table(spark, d, "events").filter(F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return picks.first_of(ev, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query("SELECT osm_id FROM entity WHERE NOT (brand = 'Brand#2' OR size > 25)")
def src_09_tag_filter_inverted(spark, d):
    tags = F.col("tags")
    return E.entities(spark, d).filter(~((tags["brand"] == "Brand#2") | (tags["size"].cast("int") > 25))).select("osm_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'", views=False)
def src_12_time_slice(spark, d):
    return table(spark, d, "events").filter((F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp"))).select("event_id")


@query("SELECT osm_id FROM (SELECT osm_id, md5(concat('node:', CAST(osm_id AS VARCHAR))) AS h FROM entity) ORDER BY h, osm_id LIMIT 50")
def src_29_hashed_order(spark, d):
    key = F.md5(F.concat_ws(":", F.lit("node"), F.col("osm_id").cast("string")))
    return E.entities(spark, d).orderBy(key, "osm_id").limit(50).select("osm_id")


# predicates


@query("SELECT osm_id FROM entity WHERE wkg_class = 'ECONOMY' AND brand = 'Brand#7'")
def pred_02_tags_contain(spark, d):
    df = E.entities(spark, d)
    for k, v in {"class": "ECONOMY", "brand": "Brand#7"}.items():
        df = df.filter(F.element_at("tags", k) == v)
    return df.select("osm_id")


@query("SELECT osm_id, true AS has_brand, false AS has_name FROM entity")
def pred_03_has_key(spark, d):
    return E.entities(spark, d).select("osm_id", F.map_contains_key("tags", "brand").alias("has_brand"), F.map_contains_key("tags", "name").alias("has_name"))


@query("SELECT count(*) AS n FROM entity")
def pred_04_any_key(spark, d):
    return E.entities(spark, d).filter(F.arrays_overlap(F.map_keys("tags"), F.array(F.lit("amenity"), F.lit("size")))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) < 10", views=False)
def pred_05_json_field(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").filter(k < 10).select("event_id", k.alias("k"))


@query("SELECT osm_id, name FROM entity WHERE lower(name) LIKE '%red%' OR lower(brand) = 'brand#3'")
def pred_06_case_insensitive(spark, d):
    return E.entities(spark, d).filter(F.lower("name").contains("red") | (F.lower("brand") == "brand#3")).select("osm_id", "name")


@query(f"SELECT osm_id, round({HERE}, 3) AS distance_km FROM entity WHERE {HERE} <= 1500")
def pred_07_within_radius(spark, d):
    return spatial.within_radius(E.entities(spark, d), LAT, LON, REACH).select("osm_id", F.round("distance_km", 3).alias("distance_km"))


@query("SELECT osm_id FROM entity WHERE osm_id % 5 <> 0")
def pred_08_located(spark, d):
    nan = F.when(F.col("osm_id") % 5 == 0, F.lit(float("nan")))
    df = E.entities(spark, d).withColumn("lat", F.coalesce(nan, "lat")).withColumn("lon", F.coalesce(nan, "lon"))
    return df.filter(geo.is_located("lat", "lon")).select("osm_id")


RING = [(-30.0, -20.0), (40.0, -25.0), (60.0, 15.0), (10.0, 50.0), (-40.0, 20.0)]
EDGES = " + ".join(f"CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < ({x2 - x1})*(lat-({y1}))/CAST({y2 - y1} AS DOUBLE)+({x1}) THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1], strict=True))


@query(f"SELECT osm_id FROM entity WHERE ({EDGES}) % 2 = 1")
def pred_09_in_polygon(spark, d):
    return E.entities(spark, d).filter(geo.in_polygon("lat", "lon", RING)).select("osm_id")


@query("SELECT n_nationkey, greatest(least(c - 0.25, 89.5), -90) AS south FROM (SELECT n_nationkey, (n_nationkey * 7) % 180 - CAST(90 AS DOUBLE) AS c FROM nation)", views=False)
def pred_14_minimum_span(spark, d):
    c = (F.col("n_nationkey") * 7) % 180 - F.lit(90.0)
    return table(spark, d, "nation").select("n_nationkey", F.greatest(F.least(c - 0.25, F.lit(89.5)), F.lit(-90.0)).alias("south"))


@query("SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49.5) AS has_data FROM supplier", views=False)
def pred_22_exists(spark, d):
    have = table(spark, d, "lineitem").filter("l_quantity > 49.5").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("h", F.lit(True))
    return table(spark, d, "supplier").select("s_suppkey").join(have, "s_suppkey", "left").select("s_suppkey", F.coalesce("h", F.lit(False)).alias("has_data"))


@query("SELECT n_nationkey FROM nation WHERE lower(n_name) IN ('nation_3', 'nation_7') OR lower(replace(n_name, '_', '-')) = 'nation-9'", views=False)
def pred_28_country_forms(spark, d):
    return table(spark, d, "nation").filter(F.lower("n_name").isin("nation_3", "nation_7") | (text.slug("n_name") == "nation-9")).select("n_nationkey")


# joins


@query(f"SELECT osm_id, round(min({km('alat', 'alon', 'lat', 'lon')}), 3) AS distance_km FROM entity, anchor WHERE {km('alat', 'alon', 'lat', 'lon')} <= 800 AND wkg_class = 'ECONOMY' GROUP BY osm_id")
def join_01_nearest_of_set(spark, d):
    e = E.entities(spark, d).filter("wkg_class = 'ECONOMY'")
    return spatial.nearest_of_set(e, E.anchors(spark, d), 800.0).select("osm_id", F.round("distance_km", 3).alias("distance_km"))


@query(f"SELECT anchor_id, count(*) AS n, round(sum({km('alat', 'alon', 'lat', 'lon')}), 1) AS total_km FROM entity, anchor WHERE {km('alat', 'alon', 'lat', 'lon')} <= 1200 GROUP BY anchor_id")
def join_02_radius_join(spark, d):
    pairs = spatial.radius_join(E.entities(spark, d), E.anchors(spark, d), 1200.0)
    return pairs.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance_km"), 1).alias("total_km"))


@query(f"SELECT src, dst, rank, round(k, 3) AS distance_km FROM (SELECT a.anchor_id AS src, b.anchor_id AS dst, {km('a.alat', 'a.alon', 'b.alat', 'b.alon')} AS k, row_number() OVER (PARTITION BY a.anchor_id ORDER BY {km('a.alat', 'a.alon', 'b.alat', 'b.alon')}, b.anchor_id) AS rank FROM anchor a, anchor b WHERE a.anchor_id <> b.anchor_id) WHERE rank <= 5")
def join_03_knn(spark, d):
    out = spatial.knn_join(E.anchors(spark, d), 5, 1500.0, "anchor_id", "alat", "alon")
    return out.select("src", "dst", "rank", F.round("distance_km", 3).alias("distance_km"))


ONTO = [("class", "ECONOMY", "Economy", 2), ("class", None, "Part", 1), ("brand", "Brand#3", "BrandThree", 3), ("brand", None, "Branded", 1)]
ONTO_SQL = ", ".join(f"('{k}', {'NULL' if v is None else repr(v)}, '{c}', {n})" for k, v, c, n in ONTO)


@query(f"SELECT osm_id, cls, depth FROM (SELECT osm_id, cls, depth, row_number() OVER (PARTITION BY osm_id ORDER BY depth DESC, cls) AS r FROM (SELECT osm_id, 'class' AS k, wkg_class AS v FROM entity UNION ALL SELECT osm_id, 'brand', brand FROM entity) t JOIN (VALUES {ONTO_SQL}) o(ok, ov, cls, depth) ON k = ok AND (v = ov OR ov IS NULL)) WHERE r = 1")
def join_05_ontology_match(spark, d):
    onto = spark.createDataFrame(ONTO, "ok string, ov string, cls string, depth int")
    t = E.entities(spark, d).select("osm_id", F.explode("tags").alias("k", "v"))
    hit = t.join(F.broadcast(onto), (F.col("k") == F.col("ok")) & ((F.col("v") == F.col("ov")) | F.col("ov").isNull()))
    return picks.first_of(hit, ["osm_id"], [F.col("depth").desc_nulls_last(), F.col("cls")]).select("osm_id", "cls", "depth")


@query("SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", views=False)
def join_07_metric_lookup(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    c = table(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("SELECT osm_id FROM entity WHERE osm_id IN (SELECT head FROM link WHERE total > 0.85)")
def join_08_semi(spark, d):
    heads = E.links(spark, d).filter("total > 0.85").select(F.col("head").alias("osm_id"))
    return E.entities(spark, d).join(heads, "osm_id", "left_semi").select("osm_id")


@query("SELECT osm_id FROM entity WHERE osm_id NOT IN (SELECT head FROM link WHERE total > 0.7)")
def join_10_anti(spark, d):
    heads = E.links(spark, d).filter("total > 0.7").select(F.col("head").alias("osm_id"))
    return E.entities(spark, d).join(heads, "osm_id", "left_anti").select("osm_id")


@query(f"SELECT country, count(*) AS pairs FROM (SELECT a.country FROM anchor a JOIN anchor b ON a.country = b.country AND a.anchor_id < b.anchor_id WHERE {km('a.alat', 'a.alon', 'b.alat', 'b.alon')} <= 5000) GROUP BY country")
def join_11_blocked(spark, d):
    a = E.anchors(spark, d)
    b = a.select(F.col("anchor_id").alias("other"), "country", F.col("alat").alias("blat"), F.col("alon").alias("blon"))
    near = a.join(b, "country").filter("anchor_id < other").filter(geo.haversine_km("alat", "alon", "blat", "blon") <= 5000)
    return near.groupBy("country").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT relation, accepted, rejected FROM (SELECT relation, sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS accepted, sum(CASE WHEN accepted THEN 0 ELSE 1 END) AS rejected FROM link GROUP BY relation)")
def join_18_outer_counts(spark, d):
    li = E.links(spark, d)
    a = li.filter("accepted").groupBy("relation").agg(F.count(F.lit(1)).alias("accepted"))
    r = li.filter("not accepted").groupBy("relation").agg(F.count(F.lit(1)).alias("rejected"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(r, "relation", "full_outer").select("relation", zero("accepted"), zero("rejected"))


@query("SELECT osm_id, bit_or(b) AS targets FROM (SELECT osm_id, CASE WHEN lat BETWEEN -60 AND 10 AND lon BETWEEN -180 AND 0 THEN 1 ELSE 0 END AS b FROM entity UNION ALL SELECT osm_id, CASE WHEN lat BETWEEN 0 AND 60 AND lon BETWEEN -20 AND 180 THEN 2 ELSE 0 END FROM entity) GROUP BY osm_id HAVING bit_or(b) > 0")
def join_20_target_mask(spark, d):
    boxes = spark.createDataFrame([(0, -60.0, -180.0, 10.0, 0.0), (1, 0.0, -20.0, 60.0, 180.0)], "t int, s double, w double, n double, e double")
    hit = E.entities(spark, d).join(F.broadcast(boxes), F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e")))
    return hit.groupBy("osm_id").agg(F.bit_or(F.expr("shiftleft(1, t)")).alias("targets"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND abs((a.n_nationkey * 37) % 100 - (b.n_nationkey * 37) % 100) <= 6", views=False)
def join_22_adjacent_boxes(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", ((F.col("n_nationkey") * 37) % 100).alias("x"))
    b = n.select(F.col("n_nationkey").alias("b"), F.col("x").alias("y"))
    return n.join(F.broadcast(b), (F.col("n_nationkey") < F.col("b")) & (F.abs(F.col("x") - F.col("y")) <= 6)).select(F.col("n_nationkey").alias("a"), "b")


# aggregates


@query(f"SELECT wkg_class, count(*) AS n FROM entity WHERE {HERE} <= 3000 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 4")
def agg_01_census_in_radius(spark, d):
    near = spatial.within_radius(E.entities(spark, d), LAT, LON, 3000.0)
    return near.groupBy("wkg_class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "wkg_class").limit(4)


@query(f"SELECT count(*) AS n FROM entity WHERE {HERE} <= 3000 AND brand = 'Brand#3'")
def agg_04_count_within(spark, d):
    return spatial.within_radius(E.entities(spark, d), LAT, LON, 3000.0).filter("brand = 'Brand#3'").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT wkg_class, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, count(*) AS n FROM entity GROUP BY 1 ORDER BY n DESC, 1 LIMIT 200")
def agg_07_class_centroids(spark, d):
    g = E.entities(spark, d).groupBy("wkg_class").agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), "wkg_class").limit(200)


@query("SELECT wkg_class, n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 8) AS share FROM (SELECT wkg_class, count(*) AS n FROM entity GROUP BY 1)")
def agg_08_class_distribution(spark, d):
    return distributions.shares(E.entities(spark, d).withColumn("one", F.lit(1)), ["one"], "wkg_class").select("wkg_class", "n", F.round("share", 8).alias("share"))


@query("SELECT m AS month, total, k AS unique_classes, round(h, 6) AS entropy, round(s, 6) AS simpson, round(md, 4) AS mean_depth, round(sd, 4) AS depth_std FROM (SELECT m, sum(n) AS total, count(*) AS k, -sum(p*log2(p)) AS h, 1-sum(p*p) AS s FROM (SELECT m, n, CAST(n AS DOUBLE)/sum(n) OVER (PARTITION BY m) AS p FROM (SELECT strftime(o_orderdate, '%Y_%m_01') AS m, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) GROUP BY m) JOIN (SELECT strftime(o_orderdate, '%Y_%m_01') AS m2, avg(o_totalprice) AS md, stddev_pop(o_totalprice) AS sd FROM orders GROUP BY 1) ON m = m2", views=False)
def agg_10_fingerprint(spark, d):
    o = table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy_MM_01"))
    f = distributions.fingerprint(o, ["month"], "o_orderpriority", "o_totalprice")
    return f.select("month", "total", "unique_classes", F.round("entropy", 6).alias("entropy"), F.round("simpson", 6).alias("simpson"), F.round("mean_depth", 4).alias("mean_depth"), F.round("depth_std", 4).alias("depth_std"))


@query("SELECT relation, count(*) AS n, sum(CASE WHEN geo > name + topo THEN 1 ELSE 0 END) AS geo_led, sum(CASE WHEN topo > geo + name THEN 1 ELSE 0 END) AS topo_led, sum(CASE WHEN total < 0.6 THEN 1 ELSE 0 END) AS b0, sum(CASE WHEN total >= 0.6 AND total < 0.7 THEN 1 ELSE 0 END) AS b1, sum(CASE WHEN total >= 0.7 THEN 1 ELSE 0 END) AS b2, round(avg(total), 6) AS mean FROM link WHERE accepted GROUP BY relation")
def agg_13_conditional(spark, d):
    c = lambda x: F.count_if(x)
    g, n, t, s = F.col("geo"), F.col("name"), F.col("topo"), F.col("total")
    return E.links(spark, d).filter("accepted").groupBy("relation").agg(F.count(F.lit(1)).alias("n"), c(g > n + t).alias("geo_led"), c(t > g + n).alias("topo_led"), c(s < 0.6).alias("b0"), c((s >= 0.6) & (s < 0.7)).alias("b1"), c(s >= 0.7).alias("b2"), F.round(F.avg(s), 6).alias("mean"))


@query("SELECT relation, round(avg(CASE WHEN accepted THEN CAST(1 AS DOUBLE) ELSE 0 END), 3) AS rate, count(*) AS total FROM link GROUP BY relation")
def agg_14_acceptance_rate(spark, d):
    return E.links(spark, d).groupBy("relation").agg(F.round(F.avg(F.col("accepted").cast("double")), 3).alias("rate"), F.count(F.lit(1)).alias("total"))


@query("SELECT relation, count(*) AS n, sum(CASE WHEN geo > 0.3 OR name > 0.3 OR topo > 0.3 THEN 1 ELSE 0 END) AS augmentable FROM link GROUP BY relation")
def agg_15_augmentable(spark, d):
    return E.links(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("geo") > 0.3) | (F.col("name") > 0.3) | (F.col("topo") > 0.3)).alias("augmentable"))


@query("SELECT brand, wkg_class, n FROM (SELECT brand, wkg_class, n, row_number() OVER (PARTITION BY brand ORDER BY n DESC, wkg_class) AS r FROM (SELECT brand, wkg_class, count(*) AS n FROM entity GROUP BY 1, 2)) WHERE r = 1")
def agg_18_mode_per_group(spark, d):
    counts = E.entities(spark, d).groupBy("brand", "wkg_class").agg(F.count(F.lit(1)).alias("n"))
    return picks.first_of(counts, ["brand"], [F.col("n").desc(), F.col("wkg_class")])


@query("SELECT DISTINCT brand FROM entity")
def agg_19_vocabulary(spark, d):
    return E.entities(spark, d).select("brand").distinct()


@query("SELECT event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1", views=False)
def agg_20_tally(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


@query("SELECT name, count(*) AS n FROM entity GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, name LIMIT 10")
def agg_22_brand_tally(spark, d):
    return E.entities(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").orderBy(F.col("n").desc(), "name").limit(10)


@query("SELECT w, tp, fp, fn, round(2.0*tp/(2*tp+fp+fn), 6) AS f1 FROM (SELECT w, sum(CASE WHEN s AND t THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN s AND NOT t THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT s AND t THEN 1 ELSE 0 END) AS fn FROM (SELECT w, (w*geo + (1-w)*topo) >= 0.5 AS s, part_of = 'O' AS t FROM link, (SELECT CAST(range AS DOUBLE)/10 AS w FROM range(1, 10))) GROUP BY w) ORDER BY f1 DESC, w LIMIT 1")
def agg_27_weight_grid(spark, d):
    weights = spark.range(1, 10).select((F.col("id").cast("double") / 10).alias("w"))
    rows = E.links(spark, d).select("geo", "topo", (F.col("part_of") == "O").alias("t")).crossJoin(F.broadcast(weights))
    s, t = (F.col("w") * F.col("geo") + (1 - F.col("w")) * F.col("topo")) >= 0.5, F.col("t")
    g = rows.groupBy("w").agg(F.count_if(s & t).alias("tp"), F.count_if(s & ~t).alias("fp"), F.count_if(~s & t).alias("fn"))
    return g.withColumn("f1", F.round(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)).orderBy(F.col("f1").desc(), "w").limit(1)


# windows, top-k, sets


@query("SELECT name, osm_id FROM (SELECT name, osm_id, row_number() OVER (PARTITION BY name ORDER BY osm_id) AS r FROM entity) WHERE r <= 3")
def win_03_at_most_three(spark, d):
    return picks.first_of(E.entities(spark, d), ["name"], [F.col("osm_id")], 3).select("name", "osm_id")


@query("SELECT osm_id, pool FROM (SELECT osm_id, pool, row_number() OVER (PARTITION BY osm_id ORDER BY pool) AS r FROM (SELECT osm_id, 0 AS pool FROM entity WHERE size > 40 UNION ALL SELECT osm_id, 1 FROM entity WHERE size > 30)) WHERE r = 1")
def win_05_merge_pools(spark, d):
    e = E.entities(spark, d).select("osm_id", "size")
    return picks.merge_pools([e.filter("size > 40"), e.filter("size > 30")], ["osm_id"], [F.col("osm_id")]).select("osm_id", "pool")


@query("SELECT day, n, round(sum(n - m) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS cusum FROM (SELECT day, n, avg(n) OVER () AS m FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1))", views=False)
def win_08_cusum(spark, d):
    days = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    whole = W.partitionBy(F.lit(0))
    run = whole.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return days.withColumn("m", F.avg("n").over(whole)).select("day", "n", F.round(F.sum(F.col("n") - F.col("m")).over(run), 6).alias("cusum"))


@query("SELECT brand, osm_id FROM (SELECT brand, osm_id, row_number() OVER (PARTITION BY brand ORDER BY md5(CAST(osm_id AS VARCHAR)), osm_id) AS r, count(*) OVER (PARTITION BY brand) AS n FROM entity) WHERE r <= greatest(1, round_even(n * 0.2, 0))")
def win_10_holdout(spark, d):
    w = W.partitionBy("brand")
    e = E.entities(spark, d).withColumn("r", F.row_number().over(w.orderBy(F.md5(F.col("osm_id").cast("string")), "osm_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return e.filter(F.col("r") <= F.greatest(F.lit(1.0), F.bround(F.col("n") * 0.2, 0).cast("double"))).select("brand", "osm_id")


@query(f"SELECT osm_id, round({HERE}, 3) AS distance_km FROM entity WHERE {HERE} <= 4000 ORDER BY {HERE}, osm_id LIMIT 10")
def top_01_nearest(spark, d):
    near = spatial.within_radius(E.entities(spark, d), LAT, LON, 4000.0)
    return near.orderBy("distance_km", "osm_id").limit(10).select("osm_id", F.round("distance_km", 3).alias("distance_km"))


@query(f"SELECT osm_id, round({HERE}, 3) AS distance_km, round({brg('10', '20', 'lat', 'lon')}, 3) AS bearing FROM entity WHERE {HERE} <= 4000 AND ({brg('10', '20', 'lat', 'lon')} <= 45 OR {brg('10', '20', 'lat', 'lon')} >= 315) ORDER BY {HERE}, osm_id LIMIT 1")
def top_03_cone(spark, d):
    near = spatial.nearest_in_cone(E.entities(spark, d), LAT, LON, 0.0, 4000.0)
    return near.orderBy("distance_km", "osm_id").limit(1).select("osm_id", F.round("distance_km", 3).alias("distance_km"), F.round("bearing", 3).alias("bearing"))


@query("WITH s AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(1 - list_dot_product(e, q)/(sqrt(list_dot_product(e, e))*sqrt(list_dot_product(q, q))), 6) AS distance FROM v, s WHERE vec_id <> 0 ORDER BY 1 - list_dot_product(e, q)/(sqrt(list_dot_product(e, e))*sqrt(list_dot_product(q, q))), vec_id LIMIT 10", views=False)
def top_05_like_this(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", vector.doubles("embedding").alias("e"))
    seed = v.filter("vec_id = 0").select(F.col("e").alias("q"))
    near = v.filter("vec_id <> 0").crossJoin(F.broadcast(seed)).withColumn("distance", vector.cosine_distance(F.col("e"), F.col("q")))
    return near.orderBy("distance", "vec_id").limit(10).select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT head, tail, round(total, 6) AS total FROM (SELECT head, tail, total, row_number() OVER (PARTITION BY head, relation ORDER BY total DESC, tail, order_id, line) AS r FROM link WHERE total >= 0.6) WHERE r <= 2")
def top_08_links_per_head(spark, d):
    li = E.links(spark, d).filter("total >= 0.6")
    out = picks.first_of(li, ["head", "relation"], [F.col("total").desc(), F.col("tail"), F.col("order_id"), F.col("line")], 2)
    return out.select("head", "tail", F.round("total", 6).alias("total"))


@query(f"SELECT osm_id FROM entity WHERE wkg_class = 'ECONOMY' ORDER BY {HERE}, osm_id LIMIT 1 OFFSET 1")
def top_09_second_nearest(spark, d):
    near = spatial.within_radius(E.entities(spark, d).filter("wkg_class = 'ECONOMY'"), LAT, LON, spatial.FARTHEST_KM)
    return near.orderBy("distance_km", "osm_id").offset(1).limit(1).select("osm_id")


@query("SELECT osm_id FROM entity ORDER BY size DESC, osm_id LIMIT 20 OFFSET 40")
def top_11_page(spark, d):
    return E.entities(spark, d).orderBy(F.col("size").desc(), "osm_id").offset(40).limit(20).select("osm_id")


@query("SELECT p_brand AS brand, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) THEN 'kept' ELSE 'new' END AS state FROM part WHERE p_size = 2 GROUP BY 1", views=False)
def set_02_new_and_kept(spark, d):
    p = table(spark, d, "part")
    a, b = p.filter("p_size = 1").select(F.col("p_brand").alias("brand")).distinct(), p.filter("p_size = 2").select(F.col("p_brand").alias("brand")).distinct()
    return b.exceptAll(a).withColumn("state", F.lit("new")).unionByName(b.intersect(a).withColumn("state", F.lit("kept")))


# geometry and scores


@query(f"SELECT anchor_id, round({km('10', '20', 'alat', 'alon')}*1000, 0) AS metres, round({brg('10', '20', 'alat', 'alon')}, 4) AS bearing, ['north','northeast','east','southeast','south','southwest','west','northwest'][1 + CAST(round_even({brg('10', '20', 'alat', 'alon')}/45, 0) AS INTEGER) % 8] AS compass FROM anchor")
def geo_04_bearing(spark, d):
    b = geo.bearing(LAT, LON, "alat", "alon")
    return E.anchors(spark, d).select("anchor_id", F.round(geo.haversine_m(LAT, LON, "alat", "alon"), 0).alias("metres"), F.round(b, 4).alias("bearing"), geo.compass(b).alias("compass"))


@query("SELECT anchor_id, abs(((anchor_id * 77) % 360 + 180) % 360 - CAST(180 AS DOUBLE)) AS turn FROM anchor")
def geo_07_angular_difference(spark, d):
    return E.anchors(spark, d).select("anchor_id", geo.angular_difference(((F.col("anchor_id") * 77) % 360).cast("double"), F.lit(0.0)).alias("turn"))


ALPHABET = geo.BASE32


def _geohash_sql(n: int) -> str:
    bits = 5 * n
    nx, ny = (bits + 1) // 2, bits // 2
    x = f"CAST(floor((lon+180)/360*{1 << nx}) AS BIGINT)"
    y = f"CAST(floor((lat+90)/180*{1 << ny}) AS BIGINT)"
    out = []
    for k in range(n):
        bit = []
        for i in range(5 * k, 5 * k + 5):
            s, at = (x, nx - 1 - i // 2) if i % 2 == 0 else (y, ny - 1 - i // 2)
            bit.append(f"(({s} >> {at}) & 1) * {1 << (4 - i % 5)}")
        out.append(f"substr('{ALPHABET}', 1 + CAST({' + '.join(bit)} AS INTEGER), 1)")
    return " || ".join(out)


@query(f"SELECT osm_id, {_geohash_sql(5)} AS gh FROM entity")
def geo_08_geohash(spark, d):
    return E.entities(spark, d).select("osm_id", geo.geohash("lat", "lon", 5).alias("gh"))


@query("SELECT osm_id, round(greatest(1/ln(greatest(km, CAST(1.1 AS DOUBLE))), exp(CAST(1 AS DOUBLE))), 6) AS w FROM (SELECT osm_id, CAST(size AS DOUBLE)/20 AS km FROM entity)")
def geo_14_edge_weight(spark, d):
    return E.entities(spark, d).select("osm_id", F.round(geo.inverse_distance_weight(F.col("size").cast("double") / 20), 6).alias("w"))


@query("SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) * 1000 AS metres FROM supplier", views=False)
def geo_19_radius_text(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", geo.radius_metres(F.concat(F.lit("within "), F.col("s_suppkey").cast("string"), F.lit(" km"))).alias("metres"))


@query("SELECT osm_id, round(0.5*exp(-CAST(size AS DOUBLE)/50) + 0.5*exp(-CAST(osm_id % 10 AS DOUBLE)/10), 8) AS freshness FROM entity")
def math_01_freshness(spark, d):
    return E.entities(spark, d).select("osm_id", F.round(stats.freshness(F.col("size").cast("double") / 50, (F.col("osm_id") % 10).cast("double") / 10), 8).alias("freshness"))


@query("SELECT brand, n, k, round((k+1.0)/(n+5.0), 8) AS p FROM (SELECT brand, count(*) AS n, sum(CASE WHEN wkg_class = 'ECONOMY' THEN 1 ELSE 0 END) AS k FROM entity GROUP BY brand)")
def math_02_presence(spark, d):
    g = E.entities(spark, d).groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("wkg_class") == "ECONOMY").alias("k"))
    return g.withColumn("p", F.round(stats.presence(F.col("k"), F.col("n")), 8))


@query("SELECT osm_id, CASE WHEN size < 10 THEN 'low' WHEN size < 25 THEN 'medium' WHEN size < 40 THEN 'high' ELSE 'extreme' END AS band FROM entity")
def math_05_bands(spark, d):
    return E.entities(spark, d).select("osm_id", stats.band(F.col("size"), (10, 25, 40)).alias("band"))


MONTH = "SELECT o_orderpriority AS c, CAST(count(*) AS DOUBLE)/(SELECT count(*) FROM orders WHERE {0}) AS p FROM orders WHERE {0} GROUP BY 1"
BEFORE, AFTER = "o_orderdate < TIMESTAMP '1996-01-01'", "o_orderdate >= TIMESTAMP '2001-01-01'"
PAIRS = f"SELECT coalesce(a.c, b.c) AS c, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM ({MONTH.format(BEFORE)}) a FULL OUTER JOIN ({MONTH.format(AFTER)}) b ON a.c = b.c"


def _pairs(spark, d):
    o = table(spark, d, "orders").withColumn("one", F.lit(1))
    a = distributions.shares(o.filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")), ["one"], "o_orderpriority")
    b = distributions.shares(o.filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")), ["one"], "o_orderpriority")
    return distributions.paired(a, b, "o_orderpriority")


EPS = "CAST(1e-10 AS DOUBLE)"


@query(f"SELECT round(sum((p+{EPS})*ln((p+{EPS})/(q+{EPS}))), 8) AS kl, round(0.5*sum((p+{EPS})*ln((p+{EPS})/((p+q)/2+{EPS}))) + 0.5*sum((q+{EPS})*ln((q+{EPS})/((p+q)/2+{EPS}))), 8) AS js FROM ({PAIRS})", views=False)
def drf_06_divergence(spark, d):
    return distributions.divergence(_pairs(spark, d)).select(F.round("kl", 8).alias("kl"), F.round("js", 8).alias("js"))


@query(f"SELECT c AS cls, round(q - p, 8) AS shift FROM ({PAIRS}) ORDER BY abs(q - p) DESC, c LIMIT 3", views=False)
def top_10_dominant_shifts(spark, d):
    return distributions.shifts(_pairs(spark, d), "o_orderpriority", 3).select(F.col("o_orderpriority").alias("cls"), F.round("shift", 8).alias("shift"))


# text and vectors


@query("SELECT DISTINCT p_name, levenshtein(p_name, 'smal rings') AS distance FROM part WHERE levenshtein(p_name, 'smal rings') <= 6", views=False)
def str_18_levenshtein(spark, d):
    lev = F.levenshtein("p_name", F.lit("smal rings"))
    return table(spark, d, "part").filter(lev <= 6).select("p_name", lev.alias("distance")).distinct()


def _grams(e: str) -> str:
    word = lambda w: f"list_transform(range(1, CAST(length({w}) AS BIGINT)+2), lambda i: substr('  ' || {w} || ' ', i, 3))"
    return f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({e}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: {word('w')})))"


@query(f"SELECT DISTINCT p_name, round(CAST(length(list_intersect(a, b)) AS DOUBLE)/(length(a)+length(b)-length(list_intersect(a, b))), 6) AS similarity FROM (SELECT p_name, {_grams('p_name')} AS a, {_grams(chr(39) + 'small ring' + chr(39))} AS b FROM part) WHERE CAST(length(list_intersect(a, b)) AS DOUBLE)/(length(a)+length(b)-length(list_intersect(a, b))) >= 0.3", views=False)
def str_01_trigram(spark, d):
    s = text.trigram_similarity("p_name", F.lit("small ring"))
    names = table(spark, d, "part").select("p_name").distinct()
    return names.withColumn("similarity", s).filter("similarity >= 0.3").select("p_name", F.round("similarity", 6).alias("similarity"))


@query("SELECT s_suppkey, lower(replace(s_name, '#', '-')) AS slug FROM supplier", views=False)
def str_20_slug(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.slug("s_name").alias("slug"))


@query("SELECT DISTINCT p_name, replace(p_name, ' ', '_') AS tag FROM part", views=False)
def str_14_tag_value(spark, d):
    return table(spark, d, "part").select("p_name", text.tag_value("p_name").alias("tag")).distinct()


@query("SELECT osm_id, CAST(contains(name, 'red') AS INTEGER) + CAST(contains(name, 'ring') AS INTEGER) AS hits FROM entity")
def str_21_term_hits(spark, d):
    return E.entities(spark, d).select("osm_id", text.term_hits("name", ["red", "ring"]).alias("hits"))


@query("SELECT label, round(avg(list_dot_product(e, e)), 5) AS squares, round(avg(e[1]), 6) AS first FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) GROUP BY label", views=False)
def vec_04_class_means(spark, d):
    v = table(spark, d, "embeddings").select("label", vector.doubles("embedding").alias("e"))
    return v.groupBy("label").agg(F.round(F.avg(vector.dot(F.col("e"), F.col("e"))), 5).alias("squares"), F.round(F.avg(F.col("e")[0]), 6).alias("first"))


# graphs over shared orders


GRAPH = "SELECT least(a, b) AS src, greatest(a, b) AS dst, max(w) AS w FROM (SELECT l_suppkey AS a, l_partkey AS b, CAST(l_linenumber AS DOUBLE) AS w FROM lineitem) GROUP BY 1, 2"


def _graph(spark, d):
    """Suppliers and parts that line items bring together; a key is one vertex in either role."""
    return graph.canonical(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").cast("double").alias("w")))


def _ids(edges):
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _regions(spark, d):
    """The graph of suppliers and parts within each nation of suppliers; parts are numbered apart."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("subgraph"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).cast("long").alias("dst")).agg(F.max(F.col("l_linenumber").cast("double")).alias("w"))
    return li.join(s, "src").select("subgraph", F.col("src").cast("long").alias("src"), "dst", "w")


@query(GRAPH, views=False)
def gra_01_canonical(spark, d):
    return _graph(spark, d)


@query(f"SELECT id, count(DISTINCT o) AS degree FROM (SELECT src AS id, dst AS o FROM ({GRAPH}) UNION ALL SELECT dst, src FROM ({GRAPH})) GROUP BY id", views=False)
def gra_02_degree(spark, d):
    return graph.degrees(_graph(spark, d)).select("id", "degree")


@query(f"WITH g AS ({GRAPH}), s AS (SELECT src AS i, dst AS j, w FROM g WHERE src <> dst UNION ALL SELECT dst, src, w FROM g WHERE src <> dst), d AS (SELECT i, sum(w) AS d FROM s GROUP BY i) SELECT s.i AS row, s.j AS col, round(-w/sqrt(a.d*b.d), 8) AS value FROM s JOIN d a ON s.i = a.i JOIN d b ON s.j = b.i UNION ALL SELECT i, i, 1.0 FROM d", views=False)
def gra_04_normalised_laplacian(spark, d):
    return graph.laplacian(_graph(spark, d), True).select("row", "col", F.round("value", 8).alias("value"))


@query(f"SELECT round(sum(w*((src%7)-(dst%7))*((src%7)-(dst%7))), 6) AS energy FROM ({GRAPH})", views=False)
def gra_14_dirichlet(spark, d):
    g = _graph(spark, d)
    return graph.dirichlet(g, _ids(g).select("id", (F.col("id") % 7).cast("double").alias("s"))).select(F.round("energy", 6).alias("energy"))


@query(f"WITH g AS ({GRAPH}), m AS (SELECT sum(w) AS m FROM g), i AS (SELECT src%5 AS c, sum(w) AS x FROM g WHERE src%5 = dst%5 GROUP BY 1), e AS (SELECT c, sum(w) AS y FROM (SELECT src%5 AS c, w FROM g UNION ALL SELECT dst%5, w FROM g) GROUP BY 1) SELECT round(sum(coalesce(x, 0)/m - (y/(2*m))*(y/(2*m))), 8) AS modularity FROM e LEFT JOIN i USING (c), m", views=False)
def gra_17_modularity(spark, d):
    g = _graph(spark, d)
    return graph.modularity(g, _ids(g).select("id", (F.col("id") % 5).alias("community"))).select(F.round("modularity", 8).alias("modularity"))


@query(f"WITH g AS (SELECT src AS a, dst AS b FROM ({GRAPH}) WHERE src <> dst), t AS (SELECT x.a AS a, x.b AS b, y.b AS c FROM g x JOIN g y ON x.b = y.a JOIN g z ON z.a = x.a AND z.b = y.b), v AS (SELECT id, count(*) AS t FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id), d AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM g UNION ALL SELECT b FROM g) GROUP BY id) SELECT id, degree, coalesce(t, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0*coalesce(t, 0)/(degree*(degree-1)) ELSE 0 END, 8) AS coefficient FROM d LEFT JOIN v USING (id)", views=False)
def gra_07_clustering(spark, d):
    return graph.clustering(_graph(spark, d)).select("id", "degree", "triangles", F.round("coefficient", 8).alias("coefficient"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_suppkey + 1000000 * (1 + l_orderkey % 30) AS b FROM lineitem), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS l FROM b UNION SELECT b.b, r.l FROM r JOIN b ON r.id = b.a) SELECT id, min(l) AS component FROM r GROUP BY id", views=False)
def gra_06_components(spark, d):
    li = table(spark, d, "lineitem")
    e = li.select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") + 1000000 * (1 + F.col("l_orderkey") % 30)).alias("dst")).distinct()
    v = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.components(e, v)


# forecasts and change


@query("SELECT round(sum(w*x)/sum(w), 6) AS forecast FROM (SELECT n AS x, pow(0.7, row_number() OVER (ORDER BY m DESC) - 1)*0.3 AS w FROM (SELECT strftime(o_orderdate, '%Y_%m') AS m, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1))", views=False)
def ts_02_smoothing(spark, d):
    m = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy_MM").alias("m")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = F.pow(F.lit(0.7), F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("m").desc())) - 1) * 0.3
    return m.withColumn("w", w).agg(F.round(F.sum(F.col("w") * F.col("n")) / F.sum("w"), 6).alias("forecast"))


@query("SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2", views=False)
def ext_tumbling_windows(spark, d):
    ev = table(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return ev.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", "v")


@query("SELECT user_id AS id, event_type, CASE WHEN user_id % 2 = 0 THEN NULL ELSE 1.5 END AS note FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1", views=False)
def snk_01_upsert(spark, d):
    ev = table(spark, d, "events")
    old = ev.select(F.col("user_id").alias("id")).distinct().select("id", F.lit("none").alias("event_type"), F.when(F.col("id") % 2 != 0, 1.5).alias("note"))
    new = ev.select(F.col("user_id").alias("id"), "event_type", F.lit(None).cast("double").alias("note"), "event_id")
    return picks.upsert(old, new, ["id"], "event_id", ["note"])


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' OR ts IS NULL", views=False)
def pred_30_above_mark(spark, d):
    mark = F.lit("2024-01-20").cast("timestamp")
    return table(spark, d, "events").filter((F.col("ts") > mark) | F.col("ts").isNull()).select("event_id")


# templates


@query(f"SELECT osm_id, name, wkg_class, round({HERE}, 3) AS distance_km, round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 - {HERE}/1500)), 6) AS geo_score FROM entity WHERE wkg_class = 'ECONOMY' AND {HERE} <= 1500 ORDER BY {HERE}, osm_id LIMIT 200")
def tpl_01_filter_aggregate_measure(spark, d):
    """Which entities of a class lie within a radius of a place, nearest first."""
    near = spatial.within_radius(E.entities(spark, d).filter("wkg_class = 'ECONOMY'"), LAT, LON, REACH)
    out = near.orderBy("distance_km", "osm_id").limit(200)
    return out.select("osm_id", "name", "wkg_class", F.round("distance_km", 3).alias("distance_km"), F.round(geo.geo_score("distance_km", REACH), 6).alias("geo_score"))


@query(f"SELECT a.anchor_id AS a, b.anchor_id AS b, round({km('a.alat', 'a.alon', 'b.alat', 'b.alon')}, 3) AS distance_km FROM anchor a, anchor b WHERE a.anchor_id = 3 AND b.anchor_id = 7")
def tpl_02_distance_of_two(spark, d):
    a = E.anchors(spark, d)
    b = a.filter("anchor_id = 7").select(F.col("anchor_id").alias("b"), F.col("alat").alias("blat"), F.col("alon").alias("blon"))
    return a.filter("anchor_id = 3").crossJoin(F.broadcast(b)).select(F.col("anchor_id").alias("a"), "b", F.round(geo.haversine_km("alat", "alon", "blat", "blon"), 3).alias("distance_km"))


@query(f"SELECT osm_id, round({HERE}, 3) AS distance_km FROM entity WHERE brand = 'Brand#5' ORDER BY {HERE}, osm_id LIMIT 5")
def tpl_04_nearest_five(spark, d):
    near = spatial.within_radius(E.entities(spark, d).filter("brand = 'Brand#5'"), LAT, LON, spatial.FARTHEST_KM)
    return near.orderBy("distance_km", "osm_id").limit(5).select("osm_id", F.round("distance_km", 3).alias("distance_km"))


@query()
def gra_08_spectrum(spark, d):
    """The spectrum and loadings of every region's graph."""
    return graph.spectrum(_regions(spark, d), 6)


@query()
def gra_19_heat_rank(spark, d):
    """What is nearest by the heat kernel to the first supplier of the nation with the most."""
    by = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("subgraph")).agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("first"))
    one = by.orderBy(F.col("n").desc(), "subgraph").limit(1)
    g = graph.spectrum(_regions(spark, d).join(one, "subgraph", "left_semi"), 6)
    return graph.heat_rank(g, g.join(one.select(F.col("first").alias("id")), "id", "left_semi"), 1.0).filter("score > 1e-6").orderBy(F.col("score").desc(), "id").limit(20)


# search, links, alignment, hierarchies, drift


@query("SELECT osm_id, round(similarity, 6) AS similarity FROM (SELECT osm_id, name, CASE WHEN lower(name) = 'red widget' THEN CAST(1 AS DOUBLE) ELSE CAST(length(list_intersect(a, b)) AS DOUBLE)/(length(a)+length(b)-length(list_intersect(a, b))) END AS similarity FROM (SELECT p_partkey AS osm_id, p_name AS name, " + _grams("p_name") + " AS a, " + _grams("'red widget'") + " AS b FROM part)) WHERE similarity >= 0.3 AND length(name) <= 16 ORDER BY similarity DESC, osm_id LIMIT 25", views=False)
def cmp_05_name_pool(spark, d):
    return search.name_pool(E.entities(spark, d), "red widget", 25).select("osm_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT osm_id, round(score, 6) AS score FROM (SELECT osm_id, name, gh, score, row_number() OVER (PARTITION BY name, gh ORDER BY score DESC, osm_id) AS r FROM (SELECT osm_id, name, {_geohash_sql(5)} AS gh, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 - {HERE}/3000)) + CASE WHEN wkg_class = 'ECONOMY' THEN 1 ELSE 0 END + CAST(contains(name, 'red') AS INTEGER) AS score FROM entity)) WHERE r = 1 ORDER BY score DESC, osm_id LIMIT 30")
def cmp_09_combined_search(spark, d):
    df = search.combined(E.entities(spark, d), query=None, terms=["red"], lat=LAT, lon=LON, reach_km=3000.0, cls="ECONOMY")
    return search.diversified(df, 30).select("osm_id", F.round("score", 6).alias("score"))


@query()
def win_03b_apart(spark, d):
    ranked = E.entities(spark, d).select("name", "osm_id", F.col("size").alias("rank"), "lat", "lon")
    return search.apart(ranked)


@query(f"SELECT head, tail, round(total, 6) AS total FROM (SELECT head, tail, total, row_number() OVER (PARTITION BY head ORDER BY total DESC, tail) AS r FROM (SELECT osm_id AS head, anchor_id AS tail, (greatest(CAST(0 AS DOUBLE), 1 - {km('alat', 'alon', 'lat', 'lon')}/2000) + (osm_id % 10)/CAST(10 AS DOUBLE) + (anchor_id % 10)/CAST(10 AS DOUBLE))/3 AS total FROM entity, anchor WHERE {km('alat', 'alon', 'lat', 'lon')} <= 2000 AND osm_id <> anchor_id) WHERE total >= 0.5) WHERE r <= 3")
def uslp_01_predicted_links(spark, d):
    heads = E.entities(spark, d).select(F.col("osm_id").alias("head"), F.lit("near").alias("relation"), "lat", "lon")
    pool = E.anchors(spark, d).select(F.col("anchor_id").alias("tail"), "alat", "alon")
    accepted, _ = links.predicted(heads, pool, 2000.0, (F.col("head") % 10) / 10, (F.col("tail") % 10) / 10, 0.5, 3)
    return accepted.select("head", "tail", F.round("total", 6).alias("total"))


@query()
def aln_01_alignment(spark, d):
    left = E.entities(spark, d).withColumn("block", F.col("osm_id") % 3).withColumn("lvec", F.array(F.col("size") / 50, F.col("osm_id") % 10 / 10))
    right = E.anchors(spark, d).withColumn("block", F.col("anchor_id") % 3).withColumn("rvec", F.array(F.col("country") / 25, F.col("anchor_id") % 10 / 10))
    return links.aligned(left, right, 1500.0, [0.8, 0.7, 0.6])


@query("WITH RECURSIVE t AS (SELECT n_nationkey AS child, CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey - 1) // 2 END AS parent FROM nation), up AS (SELECT child AS node, child AS ancestor, 0 AS distance FROM t UNION ALL SELECT up.node, t.parent, up.distance + 1 FROM up JOIN t ON up.ancestor = t.child WHERE t.parent IS NOT NULL) SELECT node, ancestor, distance FROM up", views=False)
def hie_02_ancestors(spark, d):
    tree = table(spark, d, "nation").select(F.col("n_nationkey").alias("child"), F.when(F.col("n_nationkey") != 0, F.floor((F.col("n_nationkey") - 1) / 2).cast("int")).alias("parent"))
    return hierarchy.closure(tree)


@query("WITH RECURSIVE t AS (SELECT n_nationkey AS child, CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey - 1) // 2 END AS parent FROM nation), up AS (SELECT child AS node, child AS ancestor, 0 AS distance FROM t UNION ALL SELECT up.node, t.parent, up.distance + 1 FROM up JOIN t ON up.ancestor = t.child WHERE t.parent IS NOT NULL) SELECT a.n_nationkey AS a, b.n_nationkey AS b, min(x.distance + y.distance) AS distance FROM nation a, nation b, up x, up y WHERE a.n_nationkey < b.n_nationkey AND x.node = a.n_nationkey AND y.node = b.n_nationkey AND x.ancestor = y.ancestor GROUP BY 1, 2", views=False)
def ont_04_tree_distances(spark, d):
    n = table(spark, d, "nation").select("n_nationkey")
    pairs = n.select(F.col("n_nationkey").alias("a")).crossJoin(F.broadcast(n.select(F.col("n_nationkey").alias("b")))).filter("a < b")
    return hierarchy.tree_distance(hie_02_ancestors(spark, d), pairs).select("a", "b", "distance")


@query("SELECT m AS month, round(sqrt(pow(a-pa, 2) + pow(b-pb, 2)), 6) AS distance, round(a-pa, 6) AS first_delta FROM (SELECT m, a, b, lag(a) OVER (ORDER BY m) AS pa, lag(b) OVER (ORDER BY m) AS pb FROM (SELECT strftime(o_orderdate, '%Y_%m') AS m, avg(o_totalprice)/100000 AS a, CAST(count(*) AS DOUBLE)/100 AS b FROM orders GROUP BY 1)) WHERE pa IS NOT NULL", views=False)
def drf_01_spectral_drift(spark, d):
    m = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy_MM").alias("month")).agg(F.array(F.avg("o_totalprice") / 100000, F.count(F.lit(1)).cast("double") / 100).alias("eigenvalues"))
    return drift.spectral(m.withColumn("region", F.lit("all")), "region", "month").select("month", F.round("distance", 6).alias("distance"), F.round("first_delta", 6).alias("first_delta"))


@query()
def drf_04_embedding_drift(spark, d):
    v = table(spark, d, "embeddings").select("label", vector.doubles("embedding").alias("vector"))
    return drift.sliced_wasserstein(v.filter("label < 5"), v.filter("label >= 5"), 64)


@query("SELECT event_type, day AS day, round(c, 6) AS magnitude, abs(c) > 0.5 AS changed FROM (SELECT event_type, day, c, row_number() OVER (PARTITION BY event_type ORDER BY abs(c) DESC, day DESC) AS r FROM (SELECT event_type, day, sum(n - m) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT event_type, day, n, avg(n) OVER (PARTITION BY event_type) AS m FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2)))) WHERE r = 1", views=False)
def ts_03_change_points(spark, d):
    days = table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return drift.change_points(days, ["event_type"], "day", "n").withColumn("magnitude", F.round("magnitude", 6))


def _moved(loadings):
    """Loadings of another snapshot: signs change from part to part, and each part takes from its mirror image."""
    return F.transform(F.zip_with(loadings, F.reverse(loadings), lambda x, y: x + 0.25 * y), lambda x, i: F.when(i % 2 == 0, x).otherwise(-x))


@query()
def gra_21_transport(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vector.doubles("embedding").alias("loadings"))
    return drift.transport(v, v.withColumn("loadings", _moved(F.col("loadings")))).select("shared", F.round("residual", 4).alias("residual"))


@query()
def drf_03_vertex_drift(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vector.doubles("embedding").alias("loadings"))
    return drift.vertices(v, v.withColumn("loadings", _moved(F.col("loadings"))))


@query()
def nlp_01_question(spark, d):
    return execute.run(E.entities(spark, d), "Which economy are within 2500 km of small ring?", {"ECONOMY"})[1].select("osm_id", F.round("distance_km", 3).alias("distance_km"))
