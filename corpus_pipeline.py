"""The corpus pipeline over ``documents``.

Quality rules, near-dedup, pseudonyms and packing, in this order.  Each stage works on all that the
one before it kept; all but the last return the columns of ``documents``.  A null text fails the
quality rules.  Near-dedup decides by id and text: of repeated rows one stays, rows of one id with
other texts are judged apart, and a null id is an id like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import near_dup, packing, pii, quality
from quadrille.llm.common import cut, table
from quadrille.llm.queries import pseudonym_key

#: Rows to be removed are broadcast up to so many, at 48 bytes each; beyond that they are joined.
MAX_BROADCAST = 500_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject, and without lines above the limits."""
    return quality.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8; the one with the least id stays."""
    text = F.coalesce(docs["text"], F.lit(""))
    # a row is known by its id and two hashes of its text; one of them, with the id, is the node's id
    keyed = docs.withColumn("__row", F.struct(docs["doc_id"].alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("row"), text).alias("b")))
    keyed = keyed.withColumn("__node", F.xxhash64("__row"))
    found = near_dup.near_duplicates(keyed.select("__node", "text"), size=5, percent=80, id_col="__node")
    groups = found.filter("component_id <> __node").select("__node", F.col("component_id").alias("__group")).distinct()
    rows = cut(keyed.select("__row", "__node").groupBy("__row", "__node").agg(F.count(F.lit(1)).alias("n")))
    # the groups with two rows or more, with every row of theirs
    several = cut(groups.unionByName(groups.select(F.col("__group").alias("__node"), "__group").distinct()))
    members = cut(rows.join(several, "__node").select("__row", "__group"))
    # a sum that is made before rows are moved; sent to every task where it is small, so that no large group meets in one
    least = _few(members.groupBy("__group").agg(F.min_by("__row", F.struct(F.col("__row.id").isNull(), "__row")).alias("stays")))
    gone = members.join(least, "__group").filter(~F.col("__row").eqNullSafe(F.col("stays"))).select(F.col("__row").alias("__gone"))
    left = keyed.join(_few(gone), F.col("__row").eqNullSafe(F.col("__gone")), "left_anti")
    # repeated rows: one of each stays
    twice = _few(rows.filter("n > 1").select(F.col("__row").alias("__twice")))
    again = F.col("__row").eqNullSafe(F.col("__twice"))
    once = left.join(twice, again, "left_semi").groupBy("__row").agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return left.join(twice, again, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def _few(keys: DataFrame) -> DataFrame:
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced within their formats."""
    out = pii.pseudonymised(docs, pseudonym_key(spark), count="__n")
    n_chars = F.when(F.col("__n") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: a row for each piece of a document."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("pseudonyms", pseudonyms), ("packing", pack)]

#: Connected components, Unicode casing and tokenizers are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
