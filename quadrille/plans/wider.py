"""Registered queries over phrases, answers, link scores and members, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.functions import geo, records, text, vector
from quadrille.operators import hierarchy
from quadrille.plans.catalog import km, query
from quadrille.plans.more import NATION_TREE, RING, _ring_sql, nations
from quadrille.sources import entities as E
from quadrille.sources import files
from quadrille.sources.entities import table

POLY = "region\n1\n" + "\n".join(f"   {x}   {y}" for x, y in [*RING, RING[0]]) + "\nEND\nEND\n"


def _some(values, at):
    """One of some texts, by a whole number."""
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _some_sql(values, at: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({at} AS INTEGER) + 1]"


# sources


@query(f"SELECT wkg_class, count(*) AS n FROM entity WHERE {_ring_sql()} GROUP BY 1")
def src_13_poly_clip(spark, d):
    ring = files.ring_of(POLY)
    return E.entities(spark, d).filter(geo.in_polygon("lat", "lon", ring)).groupBy("wkg_class").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'POLYGON((-60 -30, 80 -45, 120 50, -20 35, -60 -30))' AS wkt", views=False)
def src_14_poly_text(spark, d):
    return spark.range(1).select(F.lit(files.well_known_text(files.ring_of(POLY))).alias("wkt"))


@query("SELECT count(*) AS n, min(osm_id) AS first FROM entity WHERE lon BETWEEN -60 AND 120 AND lat BETWEEN -45 AND 50")
def src_15_poly_box(spark, d):
    west, south, east, north = files.box_of(files.ring_of(POLY))
    return E.entities(spark, d).filter(geo.in_box("lat", "lon", south, west, north, east)).agg(F.count(F.lit(1)).alias("n"), F.min("osm_id").alias("first"))


@query("SELECT anchor_id, round(alon, 4) AS lon, round(alat, 4) AS lat FROM anchor")
def src_24_point_text(spark, d):
    written = F.format_string("Point(%.4f %.4f)", F.col("alon"), F.col("alat"))
    lon, lat = files.point_text(written)
    return E.anchors(spark, d).select("anchor_id", F.round(lon, 4).alias("lon"), F.round(lat, 4).alias("lat"))


@query("SELECT concat_ws(' ', head, tail, round(max(total), 6)) AS value FROM link GROUP BY head, tail")
def snk_08_edge_list(spark, d):
    """The lines of an edge list, one for each pair; a text writer takes them as they are."""
    return E.links(spark, d).groupBy("head", "tail").agg(F.round(F.max("total"), 6).alias("w")).select(F.concat_ws(" ", "head", "tail", "w").alias("value"))


@query("SELECT head, tail, relation, round(max(total), 6) AS total, max(total) >= CAST(0.5 AS DOUBLE) AS predicted FROM link GROUP BY 1, 2, 3")
def snk_06_split_links(spark, d):
    """One row for each key, marked for the table of accepted or of rejected links."""
    best = E.links(spark, d).groupBy("head", "tail", "relation").agg(F.max("total").alias("best"))
    return best.select("head", "tail", "relation", F.round("best", 6).alias("total"), (F.col("best") >= 0.5).alias("predicted"))


# predicates


@query("SELECT osm_id, osm_id % 3 = 0 AS generic FROM entity")
def pred_19_generic_amenity(spark, d):
    phrase = F.when(F.col("osm_id") % 3 == 0, _some(records.GENERIC, F.col("osm_id") % 10)).otherwise(F.col("name"))
    return E.entities(spark, d).select("osm_id", records.is_generic(F.concat(phrase, F.lit(" near"))).alias("generic"))


@query("SELECT anchor_id, EXISTS (SELECT 1 FROM link WHERE tail = anchor_id AND accepted AND relation = 'R') AS has_rows FROM anchor")
def pred_21_anchor_has_rows(spark, d):
    there = E.links(spark, d).filter("accepted and relation = 'R'").select(F.col("tail").alias("anchor_id"), F.lit(True).alias("there")).distinct()
    return E.anchors(spark, d).join(there, "anchor_id", "left").select("anchor_id", F.coalesce("there", F.lit(False)).alias("has_rows"))


CLASSES = ("wkgs:Highway", "Amenity", "wkgs:place", "WKGObject", "wkgs: Shop ", "LANDUSE", "")


@query(f"SELECT c AS wkg_class, count(*) AS n, c IN ('Amenity', 'wkgs: Shop ') AS is_poi FROM (SELECT {_some_sql(CLASSES, 'osm_id % 7')} AS c FROM entity) GROUP BY 1")
def pred_24_poi_class(spark, d):
    named = E.entities(spark, d).groupBy(_some(CLASSES, F.col("osm_id") % 7).alias("wkg_class")).agg(F.count(F.lit(1)).alias("n"))
    return named.withColumn("is_poi", records.is_poi(F.col("wkg_class")))


@query("SELECT osm_id, name, wkg_class AS type, round(lat, 4) AS lat, round(lon, 4) AS lon, brand FROM entity")
def pred_27_result_shape(spark, d):
    e = E.entities(spark, d)
    return e.select("osm_id", "name", F.col("wkg_class").alias("type"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.element_at("tags", "brand").alias("brand"))


# members and geometry


@query("SELECT l_orderkey AS way, bit_or(1 << CAST(n_regionkey AS INTEGER)) AS targets FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", views=False)
def join_21_way_targets(spark, d):
    """The regions that a way's members belong to, as bits."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.expr("shiftleft(1, cast(n_regionkey as int))").alias("bit"))
    s = table(spark, d, "supplier").join(n, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "bit")
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(s, "l_suppkey").groupBy(F.col("l_orderkey").alias("way")).agg(F.bit_or("bit").alias("targets"))


@query(f"SELECT anchor_id, osm_id, round(1000 * {km('alat', 'alon', 'lat', 'lon')}, 1) AS metres FROM anchor JOIN entity ON anchor_id = osm_id % 10")
def geo_02_metres(spark, d):
    e = E.entities(spark, d).withColumn("anchor_id", F.col("osm_id") % 10)
    return e.join(E.anchors(spark, d), "anchor_id").select("anchor_id", "osm_id", F.round(geo.haversine_m("alat", "alon", "lat", "lon"), 1).alias("metres"))


@query("SELECT osm_id, lat BETWEEN 0 AND 30 AND lon BETWEEN 0 AND 60 AS core FROM entity WHERE lat BETWEEN -2.5 AND 32.5 AND lon BETWEEN -2.5 AND 62.5")
def geo_18_buffered_box(spark, d):
    near = E.entities(spark, d).filter(geo.in_box("lat", "lon", -2.5, -2.5, 32.5, 62.5))
    return near.select("osm_id", geo.in_box("lat", "lon", 0.0, 0.0, 30.0, 60.0).alias("core"))


def _circles(spark, d):
    """Circles of 50 km in 64 segments, closed."""
    k = F.sequence(F.lit(0), F.lit(64))
    turn = lambda i: F.lit(6.283185307179586) * (i % 64) / 64
    lat = F.transform(k, lambda i: F.col("alat") + 50 / 111.32 * F.sin(turn(i)))
    lon = F.transform(k, lambda i: F.col("alon") + 50 / (111.32 * F.cos(F.radians("alat"))) * F.cos(turn(i)))
    return E.anchors(spark, d).select("anchor_id", lat.alias("lats"), lon.alias("lons"))


CIRCLE = "SELECT anchor_id, k, alat + 50 / CAST(111.32 AS DOUBLE) * sin(6.283185307179586 * (k % 64) / 64) AS lat, alon + 50 / (CAST(111.32 AS DOUBLE) * cos(radians(alat))) * cos(6.283185307179586 * (k % 64) / 64) AS lon FROM anchor, range(65) t(k)"


@query(f"SELECT anchor_id, k, round(lat, 5) AS lat, round(lon, 5) AS lon FROM ({CIRCLE})")
def geo_21_circle(spark, d):
    return _circles(spark, d).select("anchor_id", F.posexplode(F.arrays_zip("lats", "lons")).alias("k", "p")).select("anchor_id", F.col("k").cast("long").alias("k"), F.round("p.lats", 5).alias("lat"), F.round("p.lons", 5).alias("lon"))


@query(f"SELECT anchor_id, round(min(lat), 5) AS south, round(min(lon), 5) AS west, round(max(lat), 5) AS north, round(max(lon), 5) AS east FROM ({CIRCLE}) GROUP BY 1")
def geo_23_ring_box(spark, d):
    r = lambda f, c, n: F.round(f(c), 5).alias(n)
    return _circles(spark, d).select("anchor_id", r(F.array_min, "lats", "south"), r(F.array_min, "lons", "west"), r(F.array_max, "lats", "north"), r(F.array_max, "lons", "east"))


# names and phrases


@query("SELECT osm_id, lower(name) AS plain FROM entity")
def str_08_diacritics(spark, d):
    return E.entities(spark, d).select("osm_id", text.latin(F.translate("name", "aeiou", "áèîõü")).alias("plain"))


@query("SELECT osm_id, '\"' || name || '\" it''s' AS straight FROM entity")
def str_11_straight_quotes(spark, d):
    return E.entities(spark, d).select("osm_id", text.straight_quotes(F.concat(F.lit("“"), "name", F.lit("” it’s"))).alias("straight"))


@query("SELECT osm_id, name AS bare FROM entity")
def str_12_articles(spark, d):
    article = _some(("The ", "an ", "a ", ""), F.col("osm_id") % 4)
    return E.entities(spark, d).select("osm_id", text.without_article(F.concat(article, "name")).alias("bare"))


@query("SELECT osm_id, lower(name) AS spaced, replace(lower(name), ' ', '_') AS underscored FROM entity")
def str_15_tag_variants(spark, d):
    spaced, underscored = records.tag_variants(F.when(F.col("osm_id") % 2 == 0, F.concat(F.lit("  "), F.upper("name"))).otherwise(F.replace("name", F.lit(" "), F.lit("_"))))
    return E.entities(spark, d).select("osm_id", spaced.alias("spaced"), underscored.alias("underscored"))


@query(f"SELECT osm_id, CASE WHEN osm_id % 12 = 10 THEN lower(name) || ' vendors' ELSE lower(name) END AS phrase, {_some_sql(records.FRAGMENTS, 'osm_id % 12')} AS fragment FROM entity")
def str_16_fragments(spark, d):
    fragment = _some(records.FRAGMENTS, F.col("osm_id") % 12)
    return E.entities(spark, d).select("osm_id", records.without_fragment(F.concat("name", fragment)).alias("phrase"), fragment.alias("fragment"))


PLURAL = "CASE WHEN w LIKE '%y' THEN w[:-2] || 'ies' WHEN w LIKE '%s' THEN w || 'es' ELSE w || 's' END"


@query(
    f"""WITH v AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(string_split(name, ' ')) AS w FROM entity)),
    p AS (SELECT {PLURAL} AS word FROM v UNION SELECT unnest(['gas', 'news', 'address'])),
    c AS (SELECT word, 1 AS k, CASE WHEN word LIKE '%ies' THEN word[:-4] || 'y' END AS w FROM p UNION ALL SELECT word, 2, CASE WHEN word LIKE '%es' THEN word[:-3] END FROM p UNION ALL SELECT word, 3, word[:-2] FROM p)
    SELECT p.word, coalesce(min_by(v.w, c.k), p.word) AS singular FROM p LEFT JOIN c ON c.word = p.word AND p.word LIKE '%s' AND length(p.word) > 3 LEFT JOIN v ON v.w = c.w GROUP BY p.word"""
)
def str_17_singular(spark, d):
    """Plurals that a known word stands behind; others stay."""
    known = E.entities(spark, d).select(F.explode(F.split(F.lower("name"), " ")).alias("known")).distinct()
    w = F.col("known")
    plural = F.when(w.endswith("y"), F.concat(F.expr("left(known, length(known) - 1)"), F.lit("ies"))).when(w.endswith("s"), F.concat(w, F.lit("es"))).otherwise(F.concat(w, F.lit("s")))
    others = spark.range(3, numPartitions=1).select(_some(("gas", "news", "address"), F.col("id")).alias("word"))
    words = known.select(plural.alias("word")).unionByName(others).distinct()
    tried = words.select("word", F.posexplode_outer(records.singulars(F.col("word"))).alias("k", "known"))
    found = tried.join(known.withColumn("there", F.lit(True)), "known", "left").groupBy("word").agg(F.min_by("known", F.when(F.col("there"), F.col("k"))).alias("s"), F.max("there").alias("any"))
    return found.select("word", F.when(F.col("any"), F.col("s")).otherwise(F.col("word")).alias("singular"))


ASKED = ("Whichs", "Wher", "Whatt", "Mill", "How", "Doess", "Thei", "which")


@query(f"SELECT osm_id, {_some_sql(('Which', 'Where', 'What', 'Mill', 'How', 'Does', 'Their', 'which'), 'osm_id % 8')} AS word FROM entity")
def str_24_question_words(spark, d):
    return E.entities(spark, d).select("osm_id", records.question_word(_some(ASKED, F.col("osm_id") % 8)).alias("word"))


@query(f"SELECT osm_id, {_some_sql(('south-america', 'oceania', 'asia', 'europe', 'other', 'north-america'), 'osm_id % 6')} AS continent FROM entity")
def hie_08_continents(spark, d):
    label = _some((" South America", "AUSTRALIA-oceania", "China", "united kingdom", "Atlantis", "Central America"), F.col("osm_id") % 6)
    return E.entities(spark, d).select("osm_id", records.continent(label).alias("continent"))


# tags, vectors and link scores


@query("SELECT token, count(*) AS n FROM (SELECT unnest(['class', 'brand', 'size', 'name', wkg_class, brand, CAST(size AS VARCHAR)]) AS token FROM entity) GROUP BY 1")
def agg_28_tag_tokens(spark, d):
    """Keys, and values of one token."""
    tags = E.entities(spark, d).select(F.explode(F.map_concat("tags", F.create_map(F.lit("name"), F.col("name")))).alias("k", "v"))
    single = F.when(F.size(F.split(F.trim("v"), r"\s+")) == 1, F.nullif(F.trim("v"), F.lit("")))
    return tags.select(F.explode(F.array_compact(F.array("k", single))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _vector_sql(words: str, i: int) -> str:
    return f"coalesce(list_sum(list_transform({words}, lambda w: CAST(CAST('0x' || substr(md5(w), {4 * i + 1}, 4) AS INTEGER) AS DOUBLE) / 65535 - CAST(0.5 AS DOUBLE))), 0) / greatest(len({words}), 1)"


def _cosine_sql(a: str, b: str) -> str:
    x, y = ([f"({_vector_sql(w, i)})" for i in range(4)] for w in (a, b))
    dot = lambda p, q: "(" + " + ".join(f"{i} * {j}" for i, j in zip(p, q, strict=True)) + ")"
    return f"coalesce({dot(x, y)} / nullif(sqrt({dot(x, x)}) * sqrt({dot(y, y)}), 0), 0)"


@query("SELECT osm_id, " + ", ".join(f"round({_vector_sql('ws', i)}, 6) AS v{i}" for i in range(4)) + " FROM (SELECT osm_id, list_filter(string_split(lower(name), ' '), lambda w: w <> 'widget') AS ws FROM entity)")
def vec_06_text_vector(spark, d):
    v = records.hashed_vector(F.col("name"), without=("widget",))
    return E.entities(spark, d).select("osm_id", v.alias("v")).select("osm_id", *[F.round(F.get("v", F.lit(i)), 6).alias(f"v{i}") for i in range(4)])


@query(f"SELECT osm_id, round({_cosine_sql('a', 'b')}, 5) AS score FROM (SELECT osm_id, string_split(lower(name), ' ') AS a, ['cold', 'widget'] AS b FROM entity)")
def uslp_02_name_score(spark, d):
    """Raw cosine: a negative one stays negative."""
    return E.entities(spark, d).select("osm_id", F.round(vector.cosine(records.hashed_vector(F.col("name")), records.hashed_vector(F.lit("cold widget"))), 5).alias("score"))


@query(f"SELECT osm_id, round(greatest(least({_cosine_sql('a', 'b')}, 1), 0), 5) AS score FROM (SELECT osm_id, string_split(lower(name), ' ') AS a, ['small', 'gear'] AS b FROM entity)")
def vec_07_name_alignment(spark, d):
    c = vector.cosine(records.hashed_vector(F.col("name")), records.hashed_vector(F.lit("small gear")))
    return E.entities(spark, d).select("osm_id", F.round(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)), 5).alias("score"))


@query(f"SELECT relation, wkg_class, round({_cosine_sql('a', 'b')}, 5) AS score FROM (SELECT relation, wkg_class, string_split(CASE relation WHEN 'A' THEN 'city' WHEN 'N' THEN 'country' ELSE 'suburb' END, ' ') AS a, string_split(lower(wkg_class), ' ') AS b FROM (SELECT DISTINCT relation FROM link), (SELECT DISTINCT wkg_class FROM entity))")
def uslp_03_class_score(spark, d):
    """Scores of every relation and class that occur: two short lists."""
    named = F.when(F.col("relation") == "A", "city").when(F.col("relation") == "N", "country").otherwise("suburb")
    pairs = E.links(spark, d).select("relation").distinct().crossJoin(E.entities(spark, d).select("wkg_class").distinct())
    return pairs.select("relation", "wkg_class", F.round(vector.cosine(records.hashed_vector(named), records.hashed_vector(F.col("wkg_class"))), 5).alias("score"))


@query("SELECT osm_id, CASE WHEN osm_id % 16 < (osm_id % 16 + 1 + osm_id % 15) % 16 THEN wkg_class ELSE brand END AS class_text FROM entity")
def uslp_04_class_text(spark, d):
    i = F.col("osm_id") % 16
    tags = F.create_map(_some(records.CLASS_KEYS, i), F.col("wkg_class"), _some(records.CLASS_KEYS, (i + 1 + F.col("osm_id") % 15) % 16), F.col("brand"))
    return E.entities(spark, d).select("osm_id", records.class_text(tags).alias("class_text"))


@query("SELECT h.vec_id AS head, t.vec_id AS tail, round(-sqrt(list_sum(list_transform(list_zip(CAST(h.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])), lambda z: (z[1] + z[2] - z[3]) * (z[1] + z[2] - z[3])))), 4) AS score FROM embeddings h JOIN embeddings r ON r.vec_id = h.label JOIN embeddings t ON t.vec_id = h.vec_id + 1", views=False)
def uslp_10_translation(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", vector.doubles("embedding").alias("e"))
    r = v.select(F.col("vec_id").alias("label"), F.col("e").alias("r"))
    t = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("t"))
    moved = F.zip_with("e", "r", lambda x, y: x + y)
    return v.join(r, "label").join(t, "vec_id").select(F.col("vec_id").alias("head"), (F.col("vec_id") + 1).alias("tail"), F.round(-vector.l2(moved, F.col("t")), 4).alias("score"))


@query("SELECT head, tail, rank, round(final, 5) AS final_score FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY final DESC, order_id, line) AS rank FROM (SELECT head, tail, order_id, line, (CAST(0.4 AS DOUBLE) / (1 + topo) + CAST(0.3 AS DOUBLE) * name + CAST(0.3 AS DOUBLE)) AS final FROM link)) WHERE rank <= 3")
def top_14_alignment_candidates(spark, d):
    final = 0.4 / (1 + F.col("topo")) + 0.3 * F.col("name") + 0.3
    rank = F.row_number().over(W.partitionBy("head").orderBy(F.desc("final"), "order_id", "line"))
    return E.links(spark, d).withColumn("final", final).withColumn("rank", rank).filter("rank <= 3").select("head", "tail", F.col("rank").cast("long").alias("rank"), F.round("final", 5).alias("final_score"))


@query("SELECT osm_id, 'Q' || osm_id AS wikidata FROM entity WHERE osm_id % 5 = 0")
def aln_02_seeds(spark, d):
    """Entities whose tags name the other side."""
    tagged = E.entities(spark, d).withColumn("tags", F.when(F.col("osm_id") % 5 == 0, F.map_concat("tags", F.create_map(F.lit("wikidata"), F.concat(F.lit("Q"), "osm_id")))).otherwise(F.col("tags")))
    return tagged.select("osm_id", F.try_element_at("tags", F.lit("wikidata")).alias("wikidata")).filter("wikidata is not null")


@query("SELECT src, dst, round(max(total), 6) AS w FROM (SELECT head AS src, tail AS dst, total FROM link UNION ALL SELECT tail, head, total FROM link) WHERE src <> dst GROUP BY 1, 2")
def gra_03_symmetric(spark, d):
    e = E.links(spark, d).select(F.col("head").alias("src"), F.col("tail").alias("dst"), "total")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "total"))
    return both.filter("src <> dst").groupBy("src", "dst").agg(F.round(F.max("total"), 6).alias("w"))


@query("SELECT osm_id, " + ", ".join(f"CAST(wkg_class = '{c}' AS INTEGER) AS {c.lower()}" for c in ("STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL")) + " FROM entity")
def gra_13_one_hot(spark, d):
    return E.entities(spark, d).select("osm_id", *[(F.col("wkg_class") == c).cast("int").alias(c.lower()) for c in ("STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL")])


# hierarchies, plans and answers


@query(f"WITH RECURSIVE t AS ({NATION_TREE}), c AS (SELECT parent AS class, child AS subclass FROM t WHERE parent IS NOT NULL UNION ALL SELECT c.class, t.child FROM c JOIN t ON t.parent = c.subclass) SELECT class, count(*) AS subclasses FROM c GROUP BY 1", views=False)
def ont_02_subclasses(spark, d):
    tree = nations(spark, d)
    return hierarchy.closure(tree).filter("node <> ancestor").groupBy(F.col("ancestor").alias("class")).agg(F.count(F.lit(1)).alias("subclasses"))


@query("SELECT name, osm_id FROM (SELECT name, osm_id, row_number() OVER (PARTITION BY name ORDER BY osm_id % 5 <> 0 DESC, CASE WHEN brand = 'Brand#1' THEN 2 WHEN brand = 'Brand#2' THEN 1 ELSE 0 END + CASE WHEN size > 40 THEN 1 ELSE 0 END - CASE WHEN wkg_class = 'PROMO' THEN 2 ELSE 0 END DESC, osm_id) AS r FROM entity) WHERE r = 1")
def cmp_07_pick(spark, d):
    """One candidate a name: with coordinates first, then by what speaks for a place; earlier ones win ties."""
    place = F.when(F.col("brand") == "Brand#1", 2).when(F.col("brand") == "Brand#2", 1).otherwise(0) + F.when(F.col("size") > 40, 1).otherwise(0) - F.when(F.col("wkg_class") == "PROMO", 2).otherwise(0)
    return E.entities(spark, d).groupBy("name").agg(F.max_by("osm_id", F.struct((F.col("osm_id") % 5 != 0).alias("located"), place.alias("score"), (-F.col("osm_id")).alias("rank"))).alias("osm_id"))


@query("SELECT wkg_class, 'Found ' || count(*) || ' ' || lower(wkg_class) || ' results; the first is ' || min_by(name, osm_id) || '.' AS answer FROM entity GROUP BY 1")
def cmp_13_answers(spark, d):
    found = E.entities(spark, d).groupBy("wkg_class").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "osm_id").alias("first"))
    return found.select("wkg_class", F.format_string("Found %d %s results; the first is %s.", "n", F.lower("wkg_class"), "first").alias("answer"))


@query("SELECT osm_id, wkg_class, coalesce(n, 0) AS links, coalesce(ok, 0) AS accepted, coalesce(kinds, 0) AS relations FROM entity LEFT JOIN (SELECT head, count(*) AS n, count(*) FILTER (WHERE accepted) AS ok, count(DISTINCT relation) AS kinds FROM link GROUP BY 1) ON head = osm_id")
def cmp_14_context(spark, d):
    linked = E.links(spark, d).groupBy(F.col("head").alias("osm_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("ok"), F.size(F.collect_set("relation")).cast("long").alias("kinds"))
    got = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return E.entities(spark, d).join(linked, "osm_id", "left").select("osm_id", "wkg_class", got("n", "links"), got("ok", "accepted"), got("kinds", "relations"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'error' WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 = 0 THEN 'class_mismatch' WHEN o_orderkey % 3 > 0 AND o_orderkey % 7 < 2 THEN 'filled_by_repair' WHEN o_orderkey % 3 > 0 THEN 'filled' WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 > 0 THEN 'missing_with_evidence' ELSE 'missing' END AS status FROM orders) GROUP BY 1", views=False)
def cmp_17_coverage(spark, d):
    k = F.col("o_orderkey")
    repair = F.when(k % 7 == 0, "fallback_evidence").when(k % 7 == 1, "class_swap")
    status = records.coverage(F.col("o_orderstatus") == "P", k % 3, k % 5 == 0, repair, k % 2)
    return table(spark, d, "orders").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS subdivision, r_name || ' / ' || n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey", views=False)
def cmp_21_subdivisions(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, d, "nation").join(r, "n_regionkey").select(F.col("n_nationkey").alias("subdivision"), F.concat_ws(" / ", "r_name", "n_name").alias("label"))


@query("SELECT coalesce(f.x, b.x) AS seed, coalesce(f.y, b.y) AS candidate, round(coalesce(f.s, b.s) * CAST(0.85 AS DOUBLE), 6) AS evidence FROM (SELECT head AS x, tail AS y, max(total) AS s FROM link WHERE accepted GROUP BY 1, 2) f FULL JOIN (SELECT tail AS x, head AS y, max(total) AS s FROM link WHERE accepted GROUP BY 1, 2) b ON f.x = b.x AND f.y = b.y")
def bat_12_link_evidence(spark, d):
    """Links in either direction times the validation's accuracy; the seed as head wins."""
    best = E.links(spark, d).filter("accepted").groupBy("head", "tail").agg(F.max("total").alias("s"))
    ahead = best.select(F.col("head").alias("seed"), F.col("tail").alias("candidate"), F.col("s").alias("ahead"))
    back = best.select(F.col("tail").alias("seed"), F.col("head").alias("candidate"), F.col("s").alias("back"))
    return ahead.join(back, ["seed", "candidate"], "full").select("seed", "candidate", F.round(F.coalesce("ahead", "back") * 0.85, 6).alias("evidence"))


@query("SELECT brand, min_by(name, (wkg_class <> 'ECONOMY')::INTEGER * 1000000000 + osm_id) AS top FROM entity WHERE lower(name) <> 'small widget' GROUP BY 1")
def bat_16_top_named(spark, d):
    """The first named entity but the anchor, of the class asked for if there is one."""
    named = E.entities(spark, d).filter(F.lower(F.trim("name")) != "small widget")
    return named.groupBy("brand").agg(F.min_by("name", F.struct(F.col("wkg_class") != "ECONOMY", "osm_id")).alias("top"))


@query("SELECT l_orderkey AS plan, sum(CASE WHEN before > role THEN 1 ELSE 0 END) = 0 AS valid, sum(CASE WHEN before > role THEN 1 ELSE 0 END) AS violations FROM (SELECT l_orderkey, l_partkey % 5 AS role, lag(l_partkey % 5) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM lineitem) GROUP BY 1", views=False)
def nlp_08_role_order(spark, d):
    """Roles of a plan's steps mustn't fall."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 5).alias("role"))
    fell = F.col("role") < F.lag("role").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    out = li.withColumn("fell", F.coalesce(fell, F.lit(False)).cast("long")).groupBy(F.col("l_orderkey").alias("plan")).agg(F.sum("fell").alias("violations"))
    return out.select("plan", (F.col("violations") == 0).alias("valid"), "violations")
