"""Document fingerprints: canonical exact digests.

The canonical text is compatibility-composed (NFKC), case-folded, and has its white space
folded.  Its digest is two 64-bit xxhash values under different seeds; documents
with equal digests form a bucket, and their canonical texts are compared byte by byte
with the bucket's first, so that texts of one bucket that differ get digests apart.

Nulls are empty texts.  Only column expressions are used (the Unicode functions are those
of the library that Spark itself ships).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.llm.common import cut, session_partitions

SEEDS = ("canonical", "document")
#: Digests of buckets with two or more rows are broadcast up to so many, at 50 bytes each; beyond that they are joined.
MAX_BROADCAST = 400_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, runs of white space to one blank, none at the ends."""
    plain = F.coalesce(text, F.lit(""))
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), plain, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    ascii_only = F.length(plain) == F.octet_length(plain)
    return F.trim(F.regexp_replace(F.when(ascii_only, F.lower(plain)).otherwise(folded), r"[\s\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """32 hexadecimal digits: xxhash under two seeds."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.xxhash64(F.lit(s), canon)), 16, "0")) for s in SEEDS])


def settled(wide: Column, canon: Column, first: Column) -> Column:
    """The fingerprint of a text in a bucket whose first text is ``first``: texts with other bytes get their SHA-256 as well."""
    return F.when(canon == first, wide).otherwise(F.concat(wide, F.lit("-"), F.sha2(canon, 256)))


def unlike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, wide, fingerprint)`` of the rows whose canonical bytes differ from the first text of their bucket.

    Digests alone are counted first; only the texts of buckets with two or more rows are moved.  The
    first text of a bucket, the least in byte order, is one row, so that a bucket with
    a third of all rows can be split over many tasks in the join.
    """
    wide = digest(canonical(docs[text_col]))
    several = cut(docs.select(wide.alias("wide")).groupBy("wide").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("wide"))
    if several.count() <= MAX_BROADCAST:
        several = F.broadcast(several)
    rows = docs.select(docs[id_col].alias("id"), canonical(docs[text_col]).alias("canon")).withColumn("wide", digest(F.col("canon"))).join(several, "wide", "left_semi")
    first = rows.groupBy("wide").agg(F.min("canon").alias("first"))
    return rows.join(first, "wide").filter("canon <> first").select("id", "wide", settled(F.col("wide"), F.col("canon"), F.col("first")).alias("fingerprint")).dropDuplicates()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)``, a row for each row of ``docs``: equal exactly where the canonical texts are equal."""
    rows = docs.select(docs[id_col].alias(id_col), digest(canonical(docs[text_col])).alias("wide"))
    return resolved(rows, unlike(docs, id_col, text_col), id_col, "wide", "fingerprint").drop("wide")


def resolved(rows: DataFrame, found: DataFrame, id_col: str, wide_col: str, name: str) -> DataFrame:
    """``rows`` with the fingerprint ``name``: what ``unlike`` found for the row, else its bare digest."""
    found = found.select(F.col("id").alias("__id"), F.col("wide").alias("__wide"), F.col("fingerprint").alias("__found"))
    out = rows.join(found, (F.col(wide_col) == F.col("__wide")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    return out.withColumn(name, F.coalesce("__found", wide_col)).drop("__id", "__wide", "__found")


def beside_next(docs: DataFrame, values: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``next_<value>`` of the next document by descending id; after the last comes the first.

    Ids are dealt to ranges by approximate quantiles, so rows are moved once; the first
    document of each range also goes, as a guest, to the range before it, whose last
    document it follows.  Among equal ids the order is by descending text, and null ids
    come last.
    """
    n = min(20_000, max(1, 4 * session_partitions(docs.sparkSession)))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    splits = sorted(set(ids.agg(F.percentile_approx("id", [(i + 1) / n for i in range(n - 1)] or [0.5], min(1_000_000, 100 * n)).alias("s")).first()["s"] or []))
    held = docs.withColumn("__range", _range(F.col(id_col).cast("long"), splits))
    firsts = sorted(held.groupBy("__range").agg(F.max(F.col(id_col).cast("long")).alias("first")).collect())
    guests = {row["first"]: firsts[k - 1]["__range"] for k, row in enumerate(firsts)}
    own = F.struct(F.col("__range").alias("r"), F.lit(False).alias("guest"))
    dealt = F.array(own)
    known = {k: v for k, v in guests.items() if k is not None}
    if known:
        to = F.element_at(F.from_json(F.lit("{" + ",".join(f'"{k}":{v}' for k, v in known.items()) + "}"), "map<string,int>"), F.col(id_col).cast("long").cast("string"))
        dealt = F.when(F.col(id_col).isin(*known), F.array(own, F.struct(to.alias("r"), F.lit(True).alias("guest")))).otherwise(dealt)
    if None in guests:
        dealt = F.when(F.col(id_col).isNull(), F.array(own, F.struct(F.lit(guests[None]).alias("r"), F.lit(True).alias("guest")))).otherwise(dealt)
    dealt = held.withColumn("__to", F.explode(dealt)).select("*", F.col("__to.r").alias("__r"), F.col("__to.guest").alias("__guest"))
    order = W.partitionBy("__r").orderBy("__guest", F.col(id_col).desc_nulls_last(), F.col(text_col).desc_nulls_last())
    out = dealt.select("*", *[F.lead(v).over(order).alias(f"next_{v}") for v in values])
    return out.filter(~F.col("__guest")).drop("__to", "__r", "__guest", "__range")


def _range(id: Column, splits: list[int]) -> Column:
    """The number of the range of an id, by descending ids; the splits are searched in two steps."""
    step = max(1, math.isqrt(len(splits)))
    listed = lambda x: F.from_json(F.lit(str(x)), "array<bigint>")
    at = F.size(F.filter(listed(splits[::step]), lambda s: s <= id)) - 1
    above = F.when(at < 0, 0).otherwise(at * step + F.size(F.filter(F.slice(listed(splits), F.greatest(at, F.lit(0)) * step + 1, step), lambda s: s <= id)))
    return F.coalesce(F.lit(len(splits)) - above, F.lit(len(splits) + 1)) if splits else F.when(id.isNull(), 1).otherwise(0)


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness: 1 for equal canonical bytes, else 0.

    The edited text has its last half replaced by as much of the next document.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("wide", digest(canonical(F.col("text"))))
    rows = beside_next(rows, ["text", "wide", "doc_id"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_wide", digest(canonical(F.col("edited"))))
    edited = F.when(F.col("edited_wide") != F.col("wide"), F.col("edited_wide")).otherwise(settled(F.col("edited_wide"), canonical(F.col("edited")), canonical(F.col("text"))))
    rows = rows.select("doc_id", "n_chars", "wide", "next_doc_id", "next_wide", F.sha2("edited", 256).alias("edited_sha256"), edited.alias("edited_fingerprint"))
    found = unlike(docs, id_col, text_col)
    rows = resolved(rows, found, "doc_id", "wide", "fingerprint")
    rows = resolved(rows, found, "next_doc_id", "next_wide", "next_fingerprint")
    like = lambda a: (F.col("fingerprint") == F.col(a)).cast("double")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
