"""Link prediction by three scores, and iterative alignment of two sets of entities."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geo, vector
from quadrille.operators.picks import first_of
from quadrille.operators.spatial import crowded, radius_join
from quadrille.sources.entities import shared_checkpoints


def scored(pairs: DataFrame, reach_km: float, name: Column, cls: Column) -> DataFrame:
    """Pairs with ``geo_score``, ``name_score``, ``class_score`` and ``total``, their mean; beyond the reach all is 0."""
    inside = (F.col("distance_km") <= reach_km).cast("double")
    out = pairs.withColumn("geo_score", geo.geo_score("distance_km", reach_km)).withColumn("name_score", name * inside).withColumn("class_score", cls * inside)
    return out.withColumn("total", (F.col("geo_score") + F.col("name_score") + F.col("class_score")) / 3)


def predicted(heads: DataFrame, pool: DataFrame, km: float, name: Column, cls: Column, threshold: float, top_k: int) -> tuple[DataFrame, DataFrame]:
    """Accepted links, at most ``top_k`` for each head and relation, and rejected ones.

    ``heads`` has ``head, relation, lat, lon``; ``pool`` has ``tail, alat, alon``.
    """
    all_ = scored(radius_join(heads, pool, km).filter("head <> tail"), km, name, cls)
    order = [F.col("total").desc(), F.col("tail").asc()]
    found = _best_by_point(heads, pool, km, name, cls, threshold, top_k)
    likely = all_ if found is None else scored(found.filter("head <> tail"), km, name, cls).select(*all_.columns)
    accepted = first_of(likely.filter(F.col("total") >= threshold), ["head", "relation"], order, top_k)
    return accepted, all_.filter(F.col("total") < threshold)


def _of(df: DataFrame, score: Column) -> bool:
    """Whether a score follows from the columns of ``df`` alone."""
    try:
        df.select(score)
    except AnalysisException:
        return False
    return True


def _best_by_point(heads: DataFrame, pool: DataFrame, km: float, name: Column, cls: Column, threshold: float, top_k: int) -> DataFrame | None:
    """Heads with the pool's rows among which their ``top_k`` accepted ones are, or None where a score hangs on both ends.

    Heads of one point and score share their best rows; one more is kept for each row that a head's own id may take.
    Rings grow: a row beyond the radius has less nearness and at most the pool's greatest score, so a point is done
    where that can't be accepted or can't pass what it has.
    """
    scores = {"__name": name, "__cls": cls}
    of_head = {"__name": _of(heads, name), "__cls": not _of(pool, cls)}
    if not of_head["__name"] and not _of(pool, name) or of_head["__cls"] and not _of(heads, cls):
        return None
    shared_checkpoints(heads.sparkSession)
    own, other = [c for c in scores if of_head[c]], [c for c in scores if not of_head[c]]
    heads = heads.filter(geo.is_located("lat", "lon")).select("*", *(scores[c].cast("double").alias(c) for c in own))
    there = pool.filter(geo.is_located("alat", "alon")).select("*", *(scores[c].cast("double").alias(c) for c in other)).checkpoint()
    ends = lambda columns: sum((F.col(c) for c in columns), F.lit(0.0))
    of_tail = there.groupBy("tail").agg(F.count(F.lit(1)).alias("n"), F.max(ends(other)).alias("s")).agg(F.max("n").alias("n"), F.max("s").alias("s")).first()
    if of_tail["s"] is None:
        return None
    keys, need = ["lat", "lon", *own], top_k + of_tail["n"]
    todo = heads.select(*keys).distinct().dropna(subset=own).checkpoint()
    reach, done = crowded(there, km, 2.0 * need), None
    total = (geo.geo_score("distance_km", km) + F.col("__name") + F.col("__cls")) / 3
    while True:
        near = radius_join(todo, there, min(reach, km)).withColumn("__total", total).filter(F.col("__total") >= threshold)
        near = first_of(near, keys, [F.col("__total").desc(), F.col("tail").asc()], need)
        if reach >= km:
            done = near if done is None else done.unionByName(near)
            break
        near = near.checkpoint()
        last = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__total").alias("__least"))
        beyond = (geo.geo_score(F.lit(float(reach)), km) + ends(own) + of_tail["s"]) / 3 + 1e-9
        over = (beyond < threshold) | ((F.col("__n") >= need) & (F.col("__least") > beyond))
        full = todo.join(last, keys, "left").filter(over).select(*keys)
        part = near.join(full, keys, "left_semi")
        done = part if done is None else done.unionByName(part)
        todo = todo.join(full, keys, "left_anti").checkpoint()
        if todo.isEmpty():
            break
        reach *= 2
    return heads.join(done.drop("__total", *other), keys).drop(*own)


def aligned(left: DataFrame, right: DataFrame, km: float, rounds: list[float]) -> DataFrame:
    """One partner at most for each row of both sides, the best pairs first: ``(osm_id, anchor_id, score, round)``.

    Candidates share a block and lie within ``km``.  Each round accepts pairs above its threshold
    that are the best of both ends; the next one works on what is left.

    Half of a score is nearness, so a round's threshold bounds the distance: pairs are made in each round anew,
    for rows without a partner, within that distance alone.  Distances are measured once for each place and block.
    """
    shared_checkpoints(left.sparkSession)
    side = lambda df, key, at, vec: df.filter(geo.is_located(*at)).select(key, *at, "block", vec, vector.norm(F.col(vec)).alias(f"{vec}_norm"))
    left = side(left, "osm_id", ("lat", "lon"), "lvec")
    right = side(right, "anchor_id", ("alat", "alon"), "rvec").withColumnRenamed("block", "__block").checkpoint()
    places = left.select("lat", "lon", "block").distinct().checkpoint()
    open_ends = not places.filter("block is null").isEmpty(), not right.filter("__block is null").isEmpty()
    done = None
    for number, threshold in enumerate(rounds):
        here, there = left, right
        if done is not None:
            here, there = left.join(done, "osm_id", "left_anti"), right.join(done, "anchor_id", "left_anti")
        # a score is at most half the nearness and a half; the rest is for rounding
        reach = max(0.0, min(km, km * 2 * (1 - threshold) + 1e-6 * km))
        met = within_blocks(places, there, reach, *open_ends)
        same = [F.col("__lat") == F.col("lat"), F.col("__lon") == F.col("lon"), F.col("__own").eqNullSafe(F.col("block"))]
        met = met.select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.col("block").alias("__own"), "anchor_id", "rvec", "rvec_norm", "distance_km")
        pairs = here.join(met, same)
        n = F.col("lvec_norm") * F.col("rvec_norm")
        cosine = F.when(n == 0, F.lit(0.0)).otherwise(vector.dot(F.col("lvec"), F.col("rvec")) / F.when(n == 0, F.lit(1.0)).otherwise(n))
        pairs = pairs.select("osm_id", "anchor_id", (0.5 * geo.geo_score("distance_km", km) + 0.5 * F.greatest(F.lit(0.0), cosine)).alias("score"))
        rest = pairs.filter(F.col("score") >= threshold)
        best = first_of(rest, ["osm_id"], [F.col("score").desc(), F.col("anchor_id").asc()])
        best = first_of(best, ["anchor_id"], [F.col("score").desc(), F.col("osm_id").asc()]).withColumn("round", F.lit(number)).select("osm_id", "anchor_id", "score", "round")
        done = best if done is None else done.unionByName(best)
        done = done.checkpoint()
    return done


def within_blocks(places: DataFrame, there: DataFrame, km: float, open_left: bool, open_right: bool) -> DataFrame:
    """Pairs of a radius join whose ``block`` and ``__block`` are equal, or one of them null; equal ones meet in cells of their block.

    ``open_left`` and ``open_right`` say whether a side has nulls.
    """
    own, other = F.col("block"), F.col("__block")
    out = radius_join(places.filter(own.isNotNull()), there.filter(other.isNotNull()), km, by=[("block", "__block")])
    if open_left:
        out = out.unionByName(radius_join(places.filter(own.isNull()), there, km))
    if open_right:
        out = out.unionByName(radius_join(places.filter(own.isNotNull()), there.filter(other.isNull()), km))
    return out


def translation_score(head: Column, relation: Column, tail: Column) -> Column:
    """Minus the length of head + relation - tail."""
    moved = F.zip_with(head, relation, lambda a, b: a + b)
    return -vector.l2(moved, tail)
