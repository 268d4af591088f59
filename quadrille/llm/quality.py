"""Quality rules: repetition within a document, and lines that recur across the documents of a host.

Within a text: words, symbols, repeated lines and words in repeated windows of five.
Across documents: lines are normalised (lower case, digits to 0, white space folded) and
hashed; a line's frequency is the number of distinct documents of its host that have
it.  Exact copies of a text count as one document, of a line and of the host alike; a hash of
the whole text, 128 bits, stands for the document.  Lines above the limits are removed, and a document is
rejected when too little is left of it.

Null texts have no words, and fail the base rule.  A null host is a host of its own.
Repeated rows get the same result each.  Only column expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import WORD, cut, let, words

SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 5
#: Keys of texts, or lines, are broadcast up to so many, at 40 bytes each; beyond that they are joined.
MAX_BROADCAST = 500_000


def repeated_words(found: Column) -> Column:
    """How many words lie in windows of five words that the array has twice or more.

    Windows are compared by hashes of the hashes of their words.  Their places are sorted by
    hash, so that a window that recurs stands beside its like.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, j: F.when(j == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get(places, j - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def recurring(pairs: Column) -> Column:
        return F.filter(pairs, lambda p, j: (p["h"] == F.get(pairs, j - 1)["h"]) | (p["h"] == F.get(pairs, j + 1)["h"]))

    def count(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(pairs, lambda s: F.array_sort(F.transform(recurring(s), lambda p: p["i"])))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(places, covered))

    hashes = F.transform(found, lambda w: F.xxhash64(w))
    return F.when(F.size(found) < WINDOW, 0).otherwise(let(let(hashes, windows), count)).cast("long")


def measured(text: Column) -> Column:
    """A struct of the counts within a text."""
    filled = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(filled, "\n"), lambda x: x.rlike(WORD))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(filled, SYMBOLS, "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def base_failed(base: Column, min_words: int = 10, max_repeat_percent: int = 20) -> Column:
    return (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat_percent * base["n_words"])


def line_hash(line: Column) -> Column:
    folded = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}", "0"), r"[\s\p{Z}]+", " "))
    return F.xxhash64(folded)


def text_key(text: Column) -> Column:
    """Stands for a document where documents are counted, and for its text where lines are removed: 128 bits that exact copies share."""
    filled = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(filled).alias("a"), F.xxhash64(F.lit("text"), filled).alias("b"))


def with_lines(docs: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """A row for each distinct normalised line of each document: host, text key, line, and its words there."""
    lines = F.filter(F.split(F.coalesce(docs[text_col], F.lit("")), "\n"), lambda x: x.rlike(WORD))
    out = docs.select(docs[host_col].alias("host"), text_key(docs[text_col]).alias("doc"), F.transform(lines, line_hash).alias("lines"))
    return out.select("host", "doc", F.explode(F.array_distinct("lines")).alias("line"))


def frequent_lines(lines: DataFrame, docs: DataFrame, host_col: str, text_col: str, min_docs: int, max_share: float) -> DataFrame:
    """``(host, line)`` of lines that more than ``min_docs`` documents and a share ``max_share`` of their host have.

    Rows are first brought together by host, line and text key, which spreads a
    common line and a large host over all tasks.
    """
    units = docs.select(docs[host_col].alias("host"), text_key(docs[text_col]).alias("doc")).groupBy("host", "doc").agg(F.lit(1).alias("one"))
    hosts = units.groupBy("host").agg(F.count(F.lit(1)).alias("of_host"))
    counts = lines.groupBy("host", "line", "doc").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    often = counts.filter(F.col("n_docs") > min_docs).alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
    return often.filter(F.col("n_docs") > max_share * F.col("of_host")).select(F.col("c.host").alias("host"), "line")


def _verdicts(docs: DataFrame, host_col: str, text_col: str, min_docs: int, max_share: float, min_left: float, max_broadcast: int) -> DataFrame:
    """``docs`` with ``__verdict``: what the rules say of each row, by its host and text."""
    lines = with_lines(docs, host_col, text_col)
    often = cut(frequent_lines(lines, docs, host_col, text_col, min_docs, max_share))
    often = F.broadcast(often) if often.count() <= max_broadcast else often
    hits = lines.alias("l").join(often.alias("o"), (F.col("l.line") == F.col("o.line")) & F.col("l.host").eqNullSafe(F.col("o.host")), "left_semi")
    # a document's own lines only, so the set is no longer than its document
    removed = cut(hits.groupBy(F.col("host").alias("__host"), F.col("doc").alias("__doc")).agg(F.collect_set("line").alias("__lines")))
    keyed = docs.withColumn("__key", text_key(docs[text_col]))
    same = keyed[host_col].eqNullSafe(F.col("__host")) & (F.col("__key") == F.col("__doc"))
    some = removed.select("__host", "__doc")
    if some.count() <= max_broadcast:
        # texts without a line to remove stay where they are
        found = keyed.join(F.broadcast(some), same, "left_semi").join(removed, same, "left")
        clean = keyed.join(F.broadcast(some), same, "left_anti").withColumn("__lines", F.lit(None).cast("array<bigint>"))
        out = clean.select(*docs.columns, "__lines").unionByName(found.select(*docs.columns, "__lines"))
    else:
        out = keyed.join(removed, same, "left").select(*docs.columns, "__lines")
    out = out.withColumn("__lines", F.coalesce("__lines", F.array().cast("array<bigint>"))).withColumn("__base", measured(F.col(text_col)))
    left = F.when(F.size("__lines") == 0, F.col("__base.n_words")).otherwise(F.size(words(without_lines(F.col(text_col), F.col("__lines")))).cast("long"))
    out = out.withColumn("__left", left).withColumn("__failed", base_failed(F.col("__base")))
    kept = ~F.col("__failed") & (F.col("__left") >= min_left * F.col("__base.n_words"))
    verdict = F.struct(F.col("__base").alias("base"), F.col("__failed").alias("base_failed"), F.col("__lines").alias("removed"), F.col("__left").alias("words_left"), kept.alias("kept"))
    # through a generator: a filter on the verdict is not pushed below the joins, where it would measure every text once more
    return out.select(*docs.columns, F.explode(F.array(verdict)).alias("__verdict"))


def judged(docs: DataFrame, host_col: str = "source", text_col: str = "text", min_docs: int = 10, max_share: float = 0.05, min_left: float = 0.3, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with ``base``, ``base_failed``, ``removed`` (hashes of its lines above the limits), ``words_left`` and ``kept``.

    A document is depleted when less than a share ``min_left`` of its words is left.  Columns of ``docs`` with
    these names are left out.
    """
    out = _verdicts(docs, host_col, text_col, min_docs, max_share, min_left, max_broadcast)
    new = ["base", "base_failed", "removed", "words_left", "kept"]
    return out.select(*[c for c in docs.columns if c not in new], *[F.col(f"__verdict.{c}").alias(c) for c in new])


def without_lines(text: Column, removed: Column) -> Column:
    """The text without its lines whose hashes are in ``removed``."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, line_hash(x))), "\n")


def filtered(docs: DataFrame, host_col: str = "source", text_col: str = "text", min_docs: int = 10, max_share: float = 0.05, min_left: float = 0.3, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The documents that are kept, without their lines above the limits; columns as in ``docs``."""
    out = _verdicts(docs, host_col, text_col, min_docs, max_share, min_left, max_broadcast).filter("__verdict.kept")
    whole, removed = F.size("__verdict.removed") == 0, F.col("__verdict.removed")
    out = out.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(without_lines(F.col(text_col), removed)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
