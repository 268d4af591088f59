"""Registered queries over snapshots, templates, names, links and hierarchies, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.functions import geo, romanize, stats, text, vector
from quadrille.operators import distributions, forecasts, graph, hierarchy, picks, spatial, vectors, walks
from quadrille.plans import execute
from quadrille.plans.catalog import HERE, LAT, LON, _geohash_sql, _graph, _grams, _regions, brg, km, query
from quadrille.sources import entities as E
from quadrille.sources import writers
from quadrille.sources.entities import table

ONE, NOUGHT = "CAST(1 AS DOUBLE)", "CAST(0 AS DOUBLE)"
SNAP = "SELECT o_orderkey AS osm_id, o_orderpriority AS wkg_class, strftime(o_orderdate, '%Y') AS snapshot_id, c_nationkey AS country, o_totalprice AS depth FROM orders JOIN customer ON o_custkey = c_custkey"
NATION_TREE = "SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'planet' FROM region UNION ALL SELECT 'planet', NULL"


def snapshots(spark, d):
    """Dated entities of countries: the columns that every snapshot query filters on."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("osm_id"), F.col("o_orderpriority").alias("wkg_class"), F.date_format("o_orderdate", "yyyy").alias("snapshot_id"), "o_custkey", F.col("o_totalprice").alias("depth"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("country"))
    return o.join(c, "o_custkey").drop("o_custkey")


def nations(spark, d):
    """The tree planet, region, nation as ``(child, parent)``."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("planet").alias("parent"))
    return n.unionByName(r).unionByName(spark.range(1).select(F.lit("planet").alias("child"), F.lit(None).cast("string").alias("parent")))


# sources and predicates


@query("SELECT n_nationkey AS way, count(s_suppkey) AS members, count(s_suppkey) = 0 AS unresolved, round(avg(alat), 6) AS lat, round(avg(alon), 6) AS lon FROM nation LEFT JOIN (SELECT *, anchor_id AS s_suppkey FROM anchor) ON country = n_nationkey GROUP BY 1")
def src_04_centroid(spark, d):
    a = table(spark, d, "nation").join(E.anchors(spark, d), F.col("country") == F.col("n_nationkey"), "left")
    out = a.groupBy(F.col("n_nationkey").alias("way")).agg(F.count("anchor_id").alias("members"), F.avg("alat").alias("lat"), F.avg("alon").alias("lon"))
    return out.select("way", "members", (F.col("members") == 0).alias("unresolved"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SELECT 'node' AS kind, count(*) AS n FROM entity UNION ALL SELECT 'way', count(*) FROM anchor UNION ALL SELECT 'relation', count(*) FROM link")
def src_07_file_info(spark, d):
    parts = [("node", E.entities(spark, d)), ("way", E.anchors(spark, d)), ("relation", E.links(spark, d))]
    out = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT vec_id, label, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM (SELECT *, ((vec_id * 7919) % 12000) / CAST(100 AS DOUBLE) - 60 AS lat, ((vec_id * 104729) % 36000) / CAST(100 AS DOUBLE) - 180 AS lon FROM embeddings) WHERE label = 3 AND lat BETWEEN -20 AND 40 AND lon BETWEEN -90 AND 90", views=False)
def src_27_embedding_scan(spark, d):
    lat, lon = E.point(F.col("vec_id"))
    v = table(spark, d, "embeddings").filter("label = 3").filter(geo.in_box(lat, lon, -20.0, -90.0, 40.0, 90.0))
    return v.select("vec_id", "label", F.round(F.aggregate(vector.doubles("embedding"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(f"SELECT wkg_class, count(*) AS n FROM ({SNAP}) WHERE snapshot_id = '1998' AND country = 7 GROUP BY 1", views=False)
def pred_01_snapshot_and_country(spark, d):
    return snapshots(spark, d).filter("snapshot_id = '1998' and country = 7").groupBy("wkg_class").agg(F.count(F.lit(1)).alias("n"))


RING = [(-60.0, -30.0), (80.0, -45.0), (120.0, 50.0), (-20.0, 35.0)]


def _ring_sql() -> str:
    out = []
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1], strict=True):
        out.append(f"CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lon < CAST({x2 - x1} AS DOUBLE) * (lat - CAST({y1} AS DOUBLE)) / CAST({y2 - y1} AS DOUBLE) + {x1} THEN 1 ELSE 0 END")
    return f"(({' + '.join(out)}) % 2 = 1)"


@query(f"SELECT osm_id, round(km, 3) AS distance_km FROM (SELECT osm_id, lat, lon, {HERE} AS km FROM entity ORDER BY km, osm_id LIMIT 100) WHERE {_ring_sql()}")
def pred_10_hard_post_filter(spark, d):
    top = E.entities(spark, d).withColumn("km", geo.haversine_km(LAT, LON, "lat", "lon")).orderBy("km", "osm_id").limit(100)
    return top.filter(geo.in_polygon("lat", "lon", RING)).select("osm_id", F.round("km", 3).alias("distance_km"))


@query("SELECT country, round(min(alat), 4) AS south, round(min(alon), 4) AS west, round(max(alat), 4) AS north, round(max(alon), 4) AS east FROM anchor GROUP BY 1")
def pred_11_region_boxes(spark, d):
    r = lambda f, c, n: F.round(f(c), 4).alias(n)
    return E.anchors(spark, d).groupBy("country").agg(r(F.min, "alat", "south"), r(F.min, "alon", "west"), r(F.max, "alat", "north"), r(F.max, "alon", "east"))


@query("SELECT p.phrase, c.wkg_class FROM (SELECT 'economies' AS phrase, 'ECONOMY' AS form UNION ALL SELECT 'Promos', 'PROMO' UNION ALL SELECT 'gardens', 'GARDEN') p JOIN (SELECT DISTINCT wkg_class FROM entity) c ON c.wkg_class = p.form")
def pred_16_phrase_target(spark, d):
    phrase = F.lower("phrase")
    form = F.when(phrase.rlike("ies$"), F.regexp_replace(phrase, "ies$", "y")).when(phrase.rlike("[^s]s$"), F.regexp_replace(phrase, "s$", "")).otherwise(phrase)
    asked = spark.range(3, numPartitions=1).select(F.get(F.array(F.lit("economies"), F.lit("Promos"), F.lit("gardens")), F.col("id").cast("int")).alias("phrase"))
    classes = E.entities(spark, d).select("wkg_class").distinct()
    return asked.withColumn("form", form).join(classes, F.lower("wkg_class") == F.col("form")).select("phrase", "wkg_class")


@query("SELECT name, bool_or(lower(name) = lower(wkg_class)) AS is_category FROM entity GROUP BY 1")
def pred_18_anchor_is_category(spark, d):
    return E.entities(spark, d).groupBy("name").agg(F.max(F.lower("name") == F.lower("wkg_class")).alias("is_category"))


@query("SELECT n_nationkey AS country, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS anchors, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) AS people, EXISTS (SELECT 1 FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey AND o_totalprice > 400000) AS large FROM nation", views=False)
def pred_23_availability(spark, d):
    """Which kinds of data each country has: one row of each kind is enough."""
    has = lambda df, name: df.select(F.col(df.columns[0]).alias("country")).distinct().withColumn(name, F.lit(True))
    big = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    out = table(spark, d, "nation").select(F.col("n_nationkey").alias("country"))
    for df, name in ((table(spark, d, "supplier").select("s_nationkey"), "anchors"), (customers, "people"), (customers.join(big, "c_custkey", "left_semi").select("c_nationkey"), "large")):
        out = out.join(has(df, name), "country", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


@query("SELECT osm_id, wkg_class IN ('ECONOMY', 'PROMO') AS poi FROM entity WHERE wkg_class <> 'STANDARD' AND length(name) > 0")
def pred_25_evidence_worthy(spark, d):
    return E.entities(spark, d).filter((F.col("wkg_class") != "STANDARD") & (F.length("name") > 0)).select("osm_id", F.col("wkg_class").isin("ECONOMY", "PROMO").alias("poi"))


@query("SELECT country, count(*) AS n FROM anchor WHERE country IN (1, 5, 9, 15) GROUP BY 1")
def pred_29_allowlist(spark, d):
    return E.anchors(spark, d).filter(F.col("country").isin(1, 5, 9, 15)).groupBy("country").agg(F.count(F.lit(1)).alias("n"))


# joins


@query("SELECT osm_id, name FROM entity WHERE osm_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def join_09_candidate_ids(spark, d):
    ids = table(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("osm_id"))
    return E.entities(spark, d).join(ids, "osm_id", "left_semi").select("osm_id", "name")


@query(f"SELECT osm_id, anchor_id, round((g + n + c)/3, 6) AS total FROM (SELECT osm_id, anchor_id, greatest({NOUGHT}, least({ONE}, 1 - {km('alat', 'alon', 'lat', 'lon')}/800)) AS g, CAST(size AS DOUBLE)/50 AS n, CASE WHEN country % 2 = osm_id % 2 THEN {ONE} ELSE {NOUGHT} END AS c FROM entity, anchor WHERE {km('alat', 'alon', 'lat', 'lon')} <= 800)")
def join_12_three_space_scores(spark, d):
    pairs = spatial.radius_join(E.entities(spark, d), E.anchors(spark, d), 800.0)
    same = (F.col("country") % 2 == F.col("osm_id") % 2).cast("double")
    total = (geo.geo_score("distance_km", 800.0) + F.col("size") / 50 + same) / 3
    return pairs.select("osm_id", "anchor_id", F.round(total, 6).alias("total"))


@query("SELECT osm_id AS head, 'class' AS relation, wkg_class AS literal FROM entity UNION ALL SELECT osm_id, 'brand', brand FROM entity")
def join_15_heads_by_literal(spark, d):
    pair = lambda k: F.struct(F.lit(k).alias("relation"), F.element_at("tags", k).alias("literal"))
    return E.entities(spark, d).select(F.col("osm_id").alias("head"), F.inline(F.array(pair("class"), pair("brand"))))


@query(f"WITH s AS ({SNAP}), a AS (SELECT wkg_class, CAST(count(*) AS DOUBLE)/(SELECT count(*) FROM s WHERE country = 1) AS p FROM s WHERE country = 1 GROUP BY 1), b AS (SELECT wkg_class, CAST(count(*) AS DOUBLE)/(SELECT count(*) FROM s WHERE country = 2 AND depth > 300000) AS q FROM s WHERE country = 2 AND depth > 300000 GROUP BY 1) SELECT wkg_class, round(coalesce(p, 0), 8) AS p, round(coalesce(q, 0), 8) AS q FROM a FULL JOIN b USING (wkg_class)", views=False)
def join_17_merged_distributions(spark, d):
    s = snapshots(spark, d).withColumn("all", F.lit(1))
    a, b = (distributions.shares(x, ["all"], "wkg_class") for x in (s.filter("country = 1"), s.filter("country = 2 and depth > 300000")))
    return distributions.paired(a, b, "wkg_class").select("wkg_class", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))


@query("SELECT x.c AS a, y.c AS b, count(*) AS shared FROM (SELECT DISTINCT country AS c, wkg_class FROM entity JOIN anchor ON osm_id = anchor_id) x JOIN (SELECT DISTINCT country AS c, wkg_class FROM entity JOIN anchor ON osm_id = anchor_id) y ON x.wkg_class = y.wkg_class AND x.c < y.c GROUP BY 1, 2")
def join_19_shared_descriptors(spark, d):
    """How many class descriptors two countries share; a country has each once, so a class meets no more rows than there are countries."""
    e = E.entities(spark, d).join(E.anchors(spark, d).withColumnRenamed("anchor_id", "osm_id"), "osm_id").select("country", "wkg_class").distinct()
    b = e.select(F.col("country").alias("b"), "wkg_class")
    return e.withColumnRenamed("country", "a").join(b, "wkg_class").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@query("SELECT r AS rank, osm_id, name FROM (SELECT o_custkey AS k, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40) JOIN entity ON osm_id = k")
def join_24_ranked_ids(spark, d):
    top = table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(40)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.col("o_totalprice").desc(), "o_orderkey"))).select("rank", F.col("o_custkey").alias("osm_id"))
    return ranked.join(E.entities(spark, d), "osm_id").select("rank", "osm_id", "name")


@query(f"SELECT osm_id, anchor_id, round(d, 3) AS distance_km FROM (SELECT osm_id, anchor_id, {km('alat', 'alon', 'lat', 'lon')} AS d, row_number() OVER (PARTITION BY osm_id ORDER BY {km('alat', 'alon', 'lat', 'lon')}, anchor_id) AS r FROM entity, anchor WHERE {km('alat', 'alon', 'lat', 'lon')} <= 3000) WHERE r = 1")
def join_25_nearest_anchor(spark, d):
    return spatial.nearest_of_set(E.entities(spark, d), E.anchors(spark, d), 3000.0).select("osm_id", "anchor_id", F.round("distance_km", 3).alias("distance_km"))


# aggregates


@query(f"SELECT wkg_class, count(*) AS n FROM entity WHERE {HERE} <= 6000 AND {_ring_sql()} GROUP BY 1 ORDER BY n DESC, wkg_class LIMIT 8")
def agg_02_census_in_polygon(spark, d):
    near = spatial.within_radius(E.entities(spark, d), LAT, LON, 6000.0).filter(geo.in_polygon("lat", "lon", RING))
    return near.groupBy("wkg_class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "wkg_class").limit(8)


@query(f"SELECT count(*) AS n FROM entity WHERE {HERE} <= 2500 AND brand IS NOT NULL")
def agg_03_count_with_key(spark, d):
    near = spatial.within_radius(E.entities(spark, d), LAT, LON, 2500.0)
    return near.filter(F.map_contains_key("tags", "brand")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT wkg_class, count(*) AS n, round(CAST(count(*) AS DOUBLE)/sum(count(*)) OVER (), 6) AS share FROM entity WHERE {HERE} <= 3000 GROUP BY 1")
def agg_09_result_distribution(spark, d):
    near = spatial.within_radius(E.entities(spark, d), LAT, LON, 3000.0).withColumn("all", F.lit(1))
    return distributions.shares(near, ["all"], "wkg_class").select("wkg_class", "n", F.round("share", 6).alias("share"))


@query("SELECT brand, round(-sum(p*log2(p)), 6) AS entropy, round(1 - sum(p*p), 6) AS simpson FROM (SELECT brand, CAST(n AS DOUBLE)/sum(n) OVER (PARTITION BY brand) AS p FROM (SELECT brand, wkg_class, count(*) AS n FROM entity GROUP BY 1, 2)) GROUP BY brand")
def agg_11_entropy_and_simpson(spark, d):
    out = distributions.fingerprint(E.entities(spark, d), ["brand"], "wkg_class", "size")
    return out.select("brand", F.round("entropy", 6).alias("entropy"), F.round("simpson", 6).alias("simpson"))


@query("SELECT CASE WHEN head % 5 = 0 THEN 'a' WHEN head % 3 = 0 THEN 'b' ELSE 'country-level' END AS region, count(CASE WHEN accepted THEN 1 END) AS accepted, count(CASE WHEN NOT accepted THEN 1 END) AS rejected FROM link GROUP BY 1")
def agg_16_link_groups(spark, d):
    """Links by region; regions overlap, and each link counts in the first that has its head."""
    region = F.when(F.col("head") % 5 == 0, "a").when(F.col("head") % 3 == 0, "b").otherwise("country-level")
    return E.links(spark, d).groupBy(region.alias("region")).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


@query("SELECT count(*) AS entities, count(DISTINCT wkg_class) AS classes, sum(size) AS size, round(avg(size), 6) AS mean_size FROM entity")
def agg_21_global_statistics(spark, d):
    return E.entities(spark, d).agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("wkg_class").alias("classes"), F.sum("size").alias("size"), F.round(F.avg("size"), 6).alias("mean_size"))


@query(f"SELECT k, v, n FROM (SELECT k, v, count(*) AS n FROM (SELECT 'class' AS k, wkg_class AS v FROM entity WHERE {HERE} <= 3000 UNION ALL SELECT 'brand', brand FROM entity WHERE {HERE} <= 3000 UNION ALL SELECT 'size', CAST(size AS VARCHAR) FROM entity WHERE {HERE} <= 3000) GROUP BY k, v) ORDER BY n DESC, k, v LIMIT 1")
def agg_23_dominant_tag(spark, d):
    near = spatial.within_radius(E.entities(spark, d), LAT, LON, 3000.0)
    return near.select(F.explode("tags").alias("k", "v")).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "k", "v").limit(1)


@query("SELECT wkg_class, n, sample FROM (SELECT wkg_class, count(*) AS n, min(osm_id) AS sample FROM entity GROUP BY 1)")
def agg_24_digest(spark, d):
    return E.entities(spark, d).groupBy("wkg_class").agg(F.count(F.lit(1)).alias("n"), F.min("osm_id").alias("sample"))


# windows, tops and sets


@query("SELECT country, osm_id, wkg_class FROM (SELECT country, osm_id, wkg_class, row_number() OVER (PARTITION BY country ORDER BY depth DESC, osm_id) AS r FROM (" + SNAP + ")) WHERE r = 1", views=False)
def win_01_deepest(spark, d):
    best = snapshots(spark, d).groupBy("country").agg(F.min_by(F.struct("osm_id", "wkg_class"), F.struct(-F.col("depth"), "osm_id")).alias("b"))
    return best.select("country", "b.osm_id", "b.wkg_class")


@query(f"SELECT name, gh, osm_id FROM (SELECT name, gh, osm_id, row_number() OVER (PARTITION BY name, gh ORDER BY size DESC, osm_id) AS r FROM (SELECT *, {_geohash_sql(2)} AS gh FROM entity)) WHERE r = 1")
def win_04_diversity(spark, d):
    e = E.entities(spark, d).withColumn("gh", geo.geohash("lat", "lon", 2))
    return picks.diverse(e, ["name", "gh"], [F.col("size").desc(), F.col("osm_id").asc()]).select("name", "gh", "osm_id")


@query("SELECT head, tail FROM (SELECT head, tail, row_number() OVER (PARTITION BY head ORDER BY order_id, line, tail) AS r FROM link WHERE accepted) WHERE r = 1")
def win_07_first_pair(spark, d):
    first = E.links(spark, d).filter("accepted").groupBy("head").agg(F.min(F.struct("order_id", "line", "tail")).alias("b"))
    return first.select("head", "b.tail")


@query(f"SELECT osm_id, name, round({HERE}, 3) AS distance_km FROM entity WHERE wkg_class = 'PROMO' AND osm_id <> 5 AND length(name) > 0 ORDER BY {HERE}, osm_id LIMIT 1")
def top_02_nearest_named(spark, d):
    near = spatial.within_radius(E.entities(spark, d).filter("wkg_class = 'PROMO' and osm_id <> 5 and length(name) > 0"), LAT, LON, spatial.FARTHEST_KM)
    return near.orderBy("distance_km", "osm_id").limit(1).select("osm_id", "name", F.round("distance_km", 3).alias("distance_km"))


@query("SELECT osm_id FROM (SELECT osm_id FROM entity ORDER BY size DESC, md5('part' || osm_id) LIMIT 30) ORDER BY osm_id LIMIT 3")
def top_13_seed_examples(spark, d):
    pool = E.entities(spark, d).orderBy(F.col("size").desc(), F.md5(F.concat(F.lit("part"), F.col("osm_id").cast("string")))).limit(30)
    return pool.orderBy("osm_id").limit(3).select("osm_id")


@query(f"SELECT osm_id, pool FROM (SELECT osm_id, pool, row_number() OVER (PARTITION BY osm_id ORDER BY pool) AS r FROM (SELECT osm_id, 0 AS pool FROM entity WHERE contains(name, 'ring') UNION ALL SELECT osm_id, 1 FROM entity WHERE {HERE} <= 2000)) WHERE r = 1")
def set_01_pool_union(spark, d):
    e = E.entities(spark, d)
    pools = [e.filter(F.col("name").contains("ring")).select("osm_id"), spatial.within_radius(e, LAT, LON, 2000.0).select("osm_id")]
    return picks.merge_pools(pools, ["osm_id"], [F.col("osm_id").asc()]).select("osm_id", "pool")


BIGRAMS = "list_distinct(list_transform(range(1, greatest(CAST(length({t}) AS BIGINT)-1, 1)+1), lambda i: substr({t}, i, 2)))"


@query("SELECT p_name, round(CAST(length(list_intersect(a, b)) AS DOUBLE)/(length(a)+length(b)-length(list_intersect(a, b))), 6) AS jaccard FROM (SELECT DISTINCT p_name, " + BIGRAMS.format(t="replace(lower(p_name), ' ', '')") + " AS a, " + BIGRAMS.format(t="'coldwidget'") + " AS b FROM part)", views=False)
def str_04_bigram_jaccard(spark, d):
    return table(spark, d, "part").select("p_name").distinct().select("p_name", F.round(text.ngram_jaccard("p_name", F.lit("cold widget")), 6).alias("jaccard"))


# geometry


@query(f"SELECT a.anchor_id AS a, b.anchor_id AS b, round({km('a.alat', 'a.alon', 'b.alat', 'b.alon')}, 4) AS km, round(1000*{km('a.alat', 'a.alon', 'b.alat', 'b.alon')}, 1) AS m FROM anchor a JOIN anchor b ON b.anchor_id = a.anchor_id + 1")
def geo_01_haversine(spark, d):
    a = E.anchors(spark, d)
    b = a.select((F.col("anchor_id") - 1).alias("anchor_id"), F.col("anchor_id").alias("b"), F.col("alat").alias("blat"), F.col("alon").alias("blon"))
    at = ("alat", "alon", "blat", "blon")
    return a.join(b, "anchor_id").select(F.col("anchor_id").alias("a"), "b", F.round(geo.haversine_km(*at), 4).alias("km"), F.round(geo.haversine_m(*at), 1).alias("m"))


@query(f"SELECT anchor_id, CAST(round_even({brg('10', '20', 'alat', 'alon')}/45, 0) AS INTEGER) % 8 AS way, list_extract(['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'], 1 + CAST(round_even({brg('10', '20', 'alat', 'alon')}/45, 0) AS INTEGER) % 8) AS compass FROM anchor")
def geo_05_compass(spark, d):
    b = geo.bearing(LAT, LON, "alat", "alon")
    return E.anchors(spark, d).select("anchor_id", F.pmod(F.bround(b / 45).cast("int"), F.lit(8)).alias("way"), geo.compass(b).alias("compass"))


@query(f"SELECT osm_id, round(greatest({NOUGHT}, least({ONE}, 1 - {HERE}/5000)), 6) AS score FROM entity")
def geo_11_geo_score(spark, d):
    return E.entities(spark, d).select("osm_id", F.round(geo.geo_score(geo.haversine_km(LAT, LON, "lat", "lon"), 5000.0), 6).alias("score"))


@query("SELECT osm_id, round(greatest(CAST(0 AS DOUBLE), 1 - 111*sqrt(pow(lat - 10, 2) + pow(lon - 20, 2))/20000), 6) AS score FROM entity")
def geo_13_planar_score(spark, d):
    km_ = 111 * F.sqrt(F.pow(F.col("lat") - LAT, 2) + F.pow(F.col("lon") - LON, 2))
    return E.entities(spark, d).select("osm_id", F.round(F.greatest(F.lit(0.0), 1 - km_ / 20000), 6).alias("score"))


@query(f"WITH k AS (SELECT e.osm_id AS id, a.alat AS v, ln(1 + 1/greatest({km('e.lat', 'e.lon', 'a.alat', 'a.alon')}, 0.001)) AS w, row_number() OVER (PARTITION BY e.osm_id ORDER BY {km('e.lat', 'e.lon', 'a.alat', 'a.alon')}, a.anchor_id) AS r FROM entity e, anchor a WHERE {km('e.lat', 'e.lon', 'a.alat', 'a.alon')} <= 4000) SELECT id AS osm_id, round(sum(w*v)/sum(w), 5) AS mean FROM k WHERE r <= 50 GROUP BY 1")
def geo_15_inference_weights(spark, d):
    pairs = spatial.radius_join(E.entities(spark, d), E.anchors(spark, d), 4000.0)
    near = picks.first_of(pairs, ["osm_id"], [F.col("distance_km").asc(), F.col("anchor_id").asc()], 50).withColumn("w", F.log(1 + 1 / F.greatest(F.col("distance_km"), F.lit(0.001))))
    return near.groupBy("osm_id").agg(F.round(F.sum(F.col("w") * F.col("alat")) / F.sum("w"), 5).alias("mean"))


@query("SELECT country, 'POLYGON((' || w || ' ' || s || ',' || e || ' ' || s || ',' || e || ' ' || n || ',' || w || ' ' || n || ',' || w || ' ' || s || '))' AS wkt FROM (SELECT country, CAST(floor(min(alon)) AS BIGINT) AS w, CAST(floor(min(alat)) AS BIGINT) AS s, CAST(ceil(max(alon)) AS BIGINT) AS e, CAST(ceil(max(alat)) AS BIGINT) AS n FROM anchor GROUP BY 1)")
def geo_20_box_as_wkt(spark, d):
    b = E.anchors(spark, d).groupBy("country").agg(F.floor(F.min("alon")).alias("w"), F.floor(F.min("alat")).alias("s"), F.ceil(F.max("alon")).alias("e"), F.ceil(F.max("alat")).alias("n"))
    return b.select("country", F.format_string("POLYGON((%1$d %2$d,%3$d %2$d,%3$d %4$d,%1$d %4$d,%1$d %2$d))", "w", "s", "e", "n").alias("wkt"))


# scores and distributions


@query("SELECT l_orderkey, round(f, 6) AS filled, CASE WHEN f >= CAST(0.75 AS DOUBLE) THEN 'high' WHEN f >= CAST(0.5 AS DOUBLE) THEN 'medium' ELSE 'low' END AS band FROM (SELECT l_orderkey, CAST(count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS DOUBLE)/count(*) AS f FROM lineitem GROUP BY 1)", views=False)
def math_04_run_confidence(spark, d):
    f = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count_if(F.col("l_returnflag") != "R") / F.count(F.lit(1))).alias("f"))
    return f.select("l_orderkey", F.round("f", 6).alias("filled"), F.when(F.col("f") >= 0.75, "high").when(F.col("f") >= 0.5, "medium").otherwise("low").alias("band"))


def _divergence_sql(a: str, b: str) -> str:
    """Shares p and q of the classes in two halves of the orders, joined in full."""
    half = lambda w: f"(SELECT c_mktsegment || o_orderpriority AS c, CAST(count(*) AS DOUBLE)/sum(count(*)) OVER () AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE {w} GROUP BY 1)"
    return f"SELECT coalesce(x.c, y.c) AS c, coalesce(x.s, 0) AS p, coalesce(y.s, 0) AS q FROM {half(a)} x FULL JOIN {half(b)} y ON x.c = y.c"


def _halves(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("c", F.concat("c_mktsegment", "o_orderpriority")).withColumn("all", F.lit(1))
    a, b = (distributions.shares(o.filter(w), ["all"], "c") for w in ("o_totalprice < 150000", "o_totalprice >= 150000"))
    return distributions.paired(a, b, "c")


@query(f"SELECT round(sum((p+1e-10)*ln((p+1e-10)/(q+1e-10))), 6) AS kl, round(0.5*sum((p+1e-10)*ln((p+1e-10)/((p+q)/2+1e-10))) + 0.5*sum((q+1e-10)*ln((q+1e-10)/((p+q)/2+1e-10))), 6) AS js FROM ({_divergence_sql('o_totalprice < 150000', 'o_totalprice >= 150000')})", views=False)
def math_07_divergences(spark, d):
    out = distributions.divergence(_halves(spark, d))
    return out.select(F.round("kl", 6).alias("kl"), F.round("js", 6).alias("js"))


@query("SELECT l_orderkey, CASE WHEN m < CAST(0.1 AS DOUBLE) THEN 'low' WHEN m < CAST(0.3 AS DOUBLE) THEN 'medium' WHEN m < CAST(0.5 AS DOUBLE) THEN 'high' ELSE 'extreme' END AS band FROM (SELECT l_orderkey, max(l_discount)*8 AS m FROM lineitem GROUP BY 1)", views=False)
def math_06_class_bands(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.max("l_discount") * 8).alias("m"))
    return m.select("l_orderkey", stats.band(F.col("m"), (0.1, 0.3, 0.5)).alias("band"))


@query("SELECT label, round(0.5*exp(-a) + 0.5*exp(-b), 6) AS freshness FROM (SELECT label, abs(avg(embedding[1])) AS a, abs(avg(embedding[2])) AS b FROM embeddings GROUP BY 1)", views=False)
def drf_05_freshness(spark, d):
    v = table(spark, d, "embeddings").select("label", vector.doubles("embedding").alias("e"))
    out = v.groupBy("label").agg(F.abs(F.avg(F.col("e")[0])).alias("a"), F.abs(F.avg(F.col("e")[1])).alias("b"))
    return out.select("label", F.round(stats.freshness(F.col("a"), F.col("b")), 6).alias("freshness"))


@query("SELECT country, y AS snapshot_id, round(e - p, 6) AS delta, round(e/p, 6) AS ratio FROM (SELECT country, y, e, lag(e) OVER (PARTITION BY country ORDER BY y) AS p FROM (SELECT country, snapshot_id AS y, avg(depth)/1000 AS e FROM (" + SNAP + ") GROUP BY 1, 2)) WHERE p IS NOT NULL", views=False)
def drf_02_signal_drift(spark, d):
    s = snapshots(spark, d).groupBy("country", "snapshot_id").agg((F.avg("depth") / 1000).alias("e"))
    s = s.withColumn("p", F.lag("e").over(W.partitionBy("country").orderBy("snapshot_id"))).filter("p is not null")
    return s.select("country", "snapshot_id", F.round(F.col("e") - F.col("p"), 6).alias("delta"), F.round(F.col("e") / F.col("p"), 6).alias("ratio"))


# names and phrases


_SIM = "CAST(length(list_intersect(a, b)) AS DOUBLE)/(length(a)+length(b)-length(list_intersect(a, b)))"


@query(f"SELECT asked, v, round(s, 6) AS similarity, l AS edits FROM (SELECT asked, v, s, l, row_number() OVER (PARTITION BY asked ORDER BY s DESC, l, v) AS r FROM (SELECT asked, v, {_SIM} AS s, levenshtein(lower(v), asked) AS l FROM (SELECT asked, v, {_grams('v')} AS a, {_grams('asked')} AS b FROM (SELECT DISTINCT p_name AS v FROM part), (SELECT 'smal rings' AS asked UNION ALL SELECT 'cold wigdet' UNION ALL SELECT 'zzqxw')) WHERE length(list_intersect(a, b)) > 0 OR levenshtein(lower(v), asked) <= 3) WHERE s >= 0.5 OR l <= 3) WHERE r = 1", views=False)
def str_03_correction(spark, d):
    """The vocabulary's word for each misspelt one: likest first, then fewest edits."""
    asked = spark.range(3, numPartitions=1).select(F.get(F.array(F.lit("smal rings"), F.lit("cold wigdet"), F.lit("zzqxw")), F.col("id").cast("int")).alias("asked"))  # three rows
    v = table(spark, d, "part").select(F.col("p_name").alias("v")).distinct().crossJoin(F.broadcast(asked))
    v = v.withColumn("similarity", text.trigram_similarity("v", "asked")).withColumn("edits", F.levenshtein(F.lower("v"), F.col("asked")))
    best = v.filter("similarity >= 0.5 or edits <= 3").groupBy("asked").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "edits", "v")).alias("b"))
    return best.select("asked", "b.v", F.round(-F.col("b.s"), 6).alias("similarity"), "b.edits")


NAMES = {"Café Ñandú": "cafe nandu", "Éireann": "eireann", "piñata": "pinata", "서울": "seoul", "O'Brien-West": "o'brien-west", "Łódź": "lodz"}


@query(" UNION ALL ".join("SELECT '{}' AS name, '{}' AS roman".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in NAMES.items()), views=False)
def str_07_scripts(spark, d):
    names = spark.range(len(NAMES), numPartitions=1).select(F.get(F.array(*map(F.lit, NAMES)), F.col("id").cast("int")).alias("name"))
    return names.select("name", romanize.romanized("name").alias("roman"))


@query("SELECT s_name, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9 ''-]', ' ', 'g'), ' +', ' ', 'g')) AS normal, regexp_replace('The ' || s_name, '(?i)^(a|an|the) ', '') AS bare, 'it''s \"x\"' AS quotes FROM supplier", views=False)
def str_10_normal_names(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_name", text.normal_name("s_name").alias("normal"), text.without_article(F.concat(F.lit("The "), "s_name")).alias("bare"), text.straight_quotes(F.lit("it’s “x”")).alias("quotes"))


STREETS = {"St": "Street", "Ave": "Avenue", "Rd": "Road", "Blvd": "Boulevard", "Dr": "Drive", "Ln": "Lane"}


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ' Street' WHEN 1 THEN c_mktsegment || ' Road' WHEN 2 THEN 'St ' || c_mktsegment ELSE c_mktsegment || ' Lane' END AS street FROM customer", views=False)
def str_13_street_suffix(spark, d):
    k = F.col("c_custkey") % 4
    t = F.when(k == 0, F.concat("c_mktsegment", F.lit(" St"))).when(k == 1, F.concat("c_mktsegment", F.lit(" Rd."))).when(k == 2, F.concat(F.lit("St "), "c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" ln")))
    return table(spark, d, "customer").select("c_custkey", text.long_street(t, STREETS).alias("street"))


@query("SELECT p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g')) AS folded, count(*) AS n FROM part GROUP BY 1, 2", views=False)
def str_23_question_key(spark, d):
    folded = F.trim(F.regexp_replace(F.lower(F.concat("p_name", F.lit(" ?"))), "[^a-z0-9 ]", ""))
    return table(spark, d, "part").groupBy("p_name", folded.alias("folded")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT osm_id, (CASE WHEN wkg_class = 'PROMO' THEN 1 ELSE 0 END) + (CASE WHEN brand = 'Brand#13' THEN 1 ELSE 0 END) AS boost FROM entity")
def str_22_tag_boost(spark, d):
    hit = lambda k, v: F.coalesce((F.element_at("tags", k) == v).cast("int"), F.lit(0))
    return E.entities(spark, d).select("osm_id", (hit("class", "PROMO") + hit("brand", "Brand#13")).alias("boost"))


@query("SELECT osm_id, '{\"brand\":\"' || brand || '\",\"size\":\"' || size || '\"}' AS j FROM entity")
def json_02_build(spark, d):
    return E.entities(spark, d).select("osm_id", F.to_json(F.struct("brand", F.col("size").cast("string").alias("size"))).alias("j"))


# vectors


@query("SELECT vec_id, round(1 - list_dot_product(e, q)/(sqrt(list_dot_product(e, e))*sqrt(list_dot_product(q, q))), 6) AS distance, round(-list_dot_product(e, q), 5) AS negative FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)", views=False)
def vec_01_distances(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", vector.doubles("embedding").alias("e"))
    q = F.broadcast(v.filter("vec_id = 0").select(F.col("e").alias("q")).limit(1))
    return v.crossJoin(q).select("vec_id", F.round(vector.cosine_distance(F.col("e"), F.col("q")), 6).alias("distance"), F.round(-vector.dot(F.col("e"), F.col("q")), 5).alias("negative"))


# graphs


@query()
def gra_18_louvain(spark, d):
    """Communities of every region's graph, by Louvain's method."""
    return graph.communities(_regions(spark, d))


@query()
def gra_15_diffusion(spark, d):
    """How a signal at each region's suppliers spreads over its graph."""
    g = _regions(spark, d)
    signal = g.select(F.col("subgraph").alias("region"), F.col("src").alias("id")).distinct().select(F.col("region").alias("subgraph"), "id", F.lit(1.0).alias("s"))
    return walks.diffused(g, signal)


# hierarchies


@query(f"WITH RECURSIVE t AS ({NATION_TREE}), up AS (SELECT child AS node, child AS ancestor, 0 AS distance FROM t UNION ALL SELECT up.node, t.parent, up.distance + 1 FROM up JOIN t ON up.ancestor = t.child WHERE t.parent IS NOT NULL) SELECT parent, count(DISTINCT node) - 1 AS below, max(distance) AS deepest FROM (SELECT ancestor AS parent, node, distance FROM up) GROUP BY 1", views=False)
def hie_01_region_tree(spark, d):
    paths = hierarchy.closure(nations(spark, d))
    return paths.groupBy(F.col("ancestor").alias("parent")).agg((F.count_distinct("node") - 1).alias("below"), F.max("distance").alias("deepest"))


@query(f"WITH RECURSIVE t AS ({NATION_TREE}), up AS (SELECT child AS node, child AS ancestor, 0 AS distance FROM t UNION ALL SELECT up.node, t.parent, up.distance + 1 FROM up JOIN t ON up.ancestor = t.child WHERE t.parent IS NOT NULL) SELECT node, string_agg(ancestor, '/' ORDER BY distance DESC) AS path FROM up GROUP BY 1", views=False)
def hie_03_path_to_root(spark, d):
    paths = hierarchy.closure(nations(spark, d)).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("distance", "ancestor")), asc=False).alias("p"))
    return paths.select("node", F.array_join(F.col("p.ancestor"), "/").alias("path"))


@query("SELECT 'n' || n_nationkey AS node, CASE WHEN n_nationkey % 3 = 0 THEN 'n' || n_nationkey WHEN n_regionkey % 2 = 0 THEN 'r' || n_regionkey ELSE 'planet' END AS source FROM nation", views=False)
def hie_04_nearest_source(spark, d):
    """The first valid source walking up: nations whose number divides by 3, even regions, the planet."""
    number = F.substring("ancestor", 2, 9).cast("int")
    valid = (F.col("ancestor") == "planet") | (F.col("ancestor").startswith("n") & (number % 3 == 0)) | (F.col("ancestor").startswith("r") & (number % 2 == 0))
    up = hierarchy.closure(nations(spark, d)).filter(F.col("node").startswith("n")).filter(valid)
    return up.groupBy("node").agg(F.min_by("ancestor", "distance").alias("source"))


@query("SELECT 'n' || n_nationkey AS node, n_regionkey = 2 AS inside FROM nation", views=False)
def hie_05_is_descendant(spark, d):
    up = hierarchy.closure(nations(spark, d)).filter(F.col("node").startswith("n"))
    return up.groupBy("node").agg(F.max(F.col("ancestor") == "r2").alias("inside"))


@query("SELECT 'r' || r_regionkey AS cls, 'planet' AS super, count(n_nationkey) AS subs FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1", views=False)
def hie_06_class_view(spark, d):
    t = nations(spark, d)
    subs = t.groupBy(F.col("parent").alias("cls")).agg(F.count(F.lit(1)).alias("subs"))
    return t.filter("parent = 'planet'").select(F.col("child").alias("cls"), F.col("parent").alias("super")).join(subs, "cls", "left").withColumn("subs", F.coalesce("subs", F.lit(0)))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN 'r' || a.n_regionkey ELSE 'planet' END AS common FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1", views=False)
def ont_03_common_ancestor(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    pairs = n.select(F.concat(F.lit("n"), "k").alias("a"), F.concat(F.lit("n"), F.col("k") + 1).alias("b"))
    out = hierarchy.tree_distance(hierarchy.closure(nations(spark, d)), pairs)
    key = lambda c: F.substring(c, 2, 9).cast("int").alias(c)
    return out.select(key("a"), key("b"), "common")


# templates and results


@query(f"SELECT anchor_id, round({km('10', '20', 'alat', 'alon')}, 3) AS distance_km, row_number() OVER (ORDER BY {km('10', '20', 'alat', 'alon')}, anchor_id) AS rank FROM anchor WHERE anchor_id IN (1, 3, 5, 7)")
def tpl_04b_compare_closer(spark, d):
    named = E.anchors(spark, d).filter(F.col("anchor_id").isin(1, 3, 5, 7)).withColumn("km", geo.haversine_km(LAT, LON, "alat", "alon"))  # the named candidates of one question
    return named.select("anchor_id", F.round("km", 3).alias("distance_km"), F.row_number().over(W.orderBy("km", "anchor_id")).alias("rank"))


@query(f"SELECT a.anchor_id AS a, b.anchor_id AS b, round({brg('a.alat', 'a.alon', 'b.alat', 'b.alon')}, 4) AS bearing, list_extract(['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'], 1 + CAST(round_even({brg('a.alat', 'a.alon', 'b.alat', 'b.alon')}/45, 0) AS INTEGER) % 8) AS compass FROM anchor a, anchor b WHERE a.anchor_id = 2 AND b.anchor_id = 6")
def tpl_05_bearing_of_a_pair(spark, d):
    a = E.anchors(spark, d)
    b = a.filter("anchor_id = 6").select(F.col("anchor_id").alias("b"), F.col("alat").alias("blat"), F.col("alon").alias("blon")).limit(1)
    out = a.filter("anchor_id = 2").crossJoin(F.broadcast(b)).withColumn("t", geo.bearing("alat", "alon", "blat", "blon"))
    return out.select(F.col("anchor_id").alias("a"), "b", F.round("t", 4).alias("bearing"), geo.compass("t").alias("compass"))


@query(f"SELECT country, snapshot_id, total, unique_classes FROM (SELECT country, snapshot_id, count(*) AS total, count(DISTINCT wkg_class) AS unique_classes, row_number() OVER (PARTITION BY country ORDER BY snapshot_id DESC) AS r FROM ({SNAP}) GROUP BY 1, 2) WHERE r = 1", views=False)
def tpl_11_latest_fingerprint(spark, d):
    s = snapshots(spark, d).groupBy("country", "snapshot_id").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("wkg_class").alias("unique_classes"))
    last = s.groupBy("country").agg(F.max(F.struct("snapshot_id", "total", "unique_classes")).alias("b"))
    return last.select("country", "b.*")


@query(f"SELECT country, snapshot_id, round(magnitude, 4) AS magnitude FROM (SELECT country, snapshot_id, m - lag(m) OVER (PARTITION BY country ORDER BY snapshot_id) AS magnitude, row_number() OVER (PARTITION BY country ORDER BY snapshot_id DESC) AS r FROM (SELECT country, snapshot_id, avg(depth)/1000 AS m FROM ({SNAP}) GROUP BY 1, 2)) WHERE r = 1", views=False)
def tpl_12_latest_drift(spark, d):
    s = snapshots(spark, d).groupBy("country", "snapshot_id").agg((F.avg("depth") / 1000).alias("m"))
    by = W.partitionBy("country").orderBy("snapshot_id")
    s = s.withColumn("magnitude", F.col("m") - F.lag("m").over(by))
    last = s.groupBy("country").agg(F.max_by(F.struct("snapshot_id", "magnitude"), "snapshot_id").alias("b"))
    return last.select("country", "b.snapshot_id", F.round("b.magnitude", 4).alias("magnitude"))


@query()
def tpl_13_communities(spark, d):
    """Each region's number of communities, its modularity and its largest community."""
    sizes = gra_18_louvain(spark, d).groupBy("subgraph", "community", "modularity").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("subgraph").agg(F.count(F.lit(1)).alias("communities"), F.max("n").alias("largest"), F.round(F.max("modularity"), 6).alias("modularity"))


@query("SELECT head, array_to_string(list_sort(list(DISTINCT tail)), ',') AS tails FROM (SELECT head, tail, dense_rank() OVER (PARTITION BY head ORDER BY tail) AS r FROM link WHERE accepted) WHERE r <= 200 GROUP BY 1")
def cmp_11_predicted_tails(spark, d):
    tails = E.links(spark, d).filter("accepted").select("head", "tail").distinct()
    first = picks.first_of(tails, ["head"], [F.col("tail").asc()], 200)
    return first.groupBy("head").agg(F.array_join(F.sort_array(F.collect_list("tail")), ",").alias("tails"))


@query("SELECT relation, head, tail FROM (SELECT relation, head, tail, order_id, line, row_number() OVER (PARTITION BY relation ORDER BY total DESC, order_id, line, tail) AS r FROM link) WHERE r <= 50")
def cmp_22_map_links(spark, d):
    """A map's links: as many of each relation, the best ones."""
    order = [F.col("total").desc(), F.col("order_id").asc(), F.col("line").asc(), F.col("tail").asc()]
    return picks.first_of(E.links(spark, d), ["relation"], order, 50).select("relation", "head", "tail")


@query(f"SELECT osm_id, NOT bool_or(wkg_class = 'ECONOMY') OVER () AS mismatch FROM (SELECT osm_id, wkg_class FROM entity WHERE {HERE} <= 900)")
def bat_15_class_mismatch(spark, d):
    near = spatial.within_radius(E.entities(spark, d), LAT, LON, 900.0)
    flag = F.broadcast(near.agg((~F.coalesce(F.max(F.col("wkg_class") == "ECONOMY"), F.lit(False))).alias("mismatch")))
    return near.crossJoin(flag).select("osm_id", "mismatch")


@query("SELECT wkg_class AS dataset, strftime(snapshot_at, '%Y-%m') AS recorded_at, n FROM (SELECT o_orderpriority AS wkg_class, date_trunc('month', o_orderdate) AS snapshot_at, count(*) AS n FROM orders GROUP BY 1, 2)", views=False)
def bat_11_quality_snapshots(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), F.date_format("o_orderdate", "yyyy-MM").alias("recorded_at")).agg(F.count(F.lit(1)).alias("n"))


# vector search, forecasts, geodesics and the templates of regions


def _embedded(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vector.doubles("embedding").alias("vector"))
    return v, v.filter("id % 20 = 0").select(F.col("id").alias("query"), F.col("vector").alias("q"))


_UNIT = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"


@query(f"SELECT query, id, round(distance, 6) AS distance, rank FROM (SELECT query, id, distance, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM (SELECT y.id AS query, x.id AS id, 1 - list_dot_product(x.e, y.e)/(sqrt(list_dot_product(x.e, x.e))*sqrt(list_dot_product(y.e, y.e))) AS distance FROM ({_UNIT}) x, ({_UNIT}) y WHERE y.id % 20 = 0 AND x.id <> y.id)) WHERE rank <= 10", views=False)
def top_04_vector_exact(spark, d):
    """The ten nearest rows of each query, exactly; queries are the rows whose id divides by 20."""
    v, queries = _embedded(spark, d)
    return vectors.nearest(v, queries, 10).select("query", "id", F.round("distance", 6).alias("distance"), "rank")


@query()
def top_04_vector_cells(spark, d):
    """The same by an index of cells; recall is measured in the tests."""
    v, queries = _embedded(spark, d)
    found = vectors.centres(v, 16)
    return vectors.nearest(v, queries, 10, found, look=12).select("query", "id", F.round("distance", 6).alias("distance"), "rank")


@query()
def geo_03_ellipsoidal(spark, d):
    """Metres on the ellipsoid between each anchor and the next, and on the sphere."""
    a = E.anchors(spark, d)
    b = a.select((F.col("anchor_id") - 1).alias("anchor_id"), F.col("alat").alias("blat"), F.col("alon").alias("blon"))
    at = ("alat", "alon", "blat", "blon")
    return a.join(b, "anchor_id").select("anchor_id", *at, F.round(geo.ellipsoidal_m(*at), 1).alias("metres"), F.round(geo.haversine_m(*at), 1).alias("sphere"))


@query()
def ts_01_forecast(spark, d):
    """The next month's orders of each priority with a band of 95 %."""
    m = table(spark, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy_MM").alias("month")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return forecasts.arima(m, "o_orderpriority", "month", "n")


def _region_of(spark, d):
    prints = snapshots(spark, d).groupBy(F.concat("snapshot_id", F.lit("_01_01")).alias("snapshot_id"), "wkg_class").agg(F.count(F.lit(1)).alias("n"))
    return execute.Region(_regions(spark, d), prints)


@query(f"SELECT wkg_class, round(p, 6) AS p, round(q, 6) AS q FROM (SELECT wkg_class, CAST(b AS DOUBLE)/sum(b) OVER () AS p, CAST(l AS DOUBLE)/sum(l) OVER () AS q FROM (SELECT wkg_class, count(CASE WHEN snapshot_id = '1998' THEN 1 END) AS b, count(CASE WHEN snapshot_id = (SELECT max(snapshot_id) FROM ({SNAP})) THEN 1 END) AS l FROM ({SNAP}) GROUP BY 1))", views=False)
def tpl_12b_change_since(spark, d):
    found = execute.run(E.entities(spark, d), "What changed since 1998-06-01?", region=_region_of(spark, d))[1]
    return found.select("wkg_class", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query()
def tpl_14_event_diffusion(spark, d):
    """What an event at the first supplier of the nation with the most reaches."""
    by = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("first"))
    anchor = by.orderBy(F.col("n").desc(), "s_nationkey").first()["first"]
    return execute.spread(_regions(spark, d), anchor, 50)


# writes


@query("SELECT osm_id, CASE WHEN n > 1 THEN 'many' ELSE brand END AS brand, size FROM (SELECT osm_id, brand, size, (SELECT count(*) FROM lineitem WHERE l_partkey = osm_id AND l_quantity = 50) AS n FROM entity)")
def snk_10_enrichment(spark, d):
    found = table(spark, d, "lineitem").filter("l_quantity = 50").groupBy(F.col("l_partkey").alias("osm_id")).agg(F.when(F.count(F.lit(1)) > 1, F.lit("many")).alias("brand"))
    return writers.enriched(E.entities(spark, d).select("osm_id", "brand", "size"), found, ["osm_id"], ["brand"])


@query("SELECT osm_id, t AS target FROM entity, (SELECT 0 AS b, 'north' AS t UNION ALL SELECT 1, 'south' UNION ALL SELECT 2, 'west') WHERE (size >> b) & 1 = 1")
def src_20_split_by_membership(spark, d):
    return writers.split_by_membership(E.entities(spark, d).select("osm_id", "size"), "size", ["north", "south", "west"]).select("osm_id", "target")
