"""Names and phrases: similarity and normal forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trigrams(text) -> Column:
    """Distinct trigrams of the words of a text, each word with two blanks before and one after."""
    words = F.filter(F.split(F.lower(_c(text)), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def trigram_similarity(a, b) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def ngrams(text, n: int = 2) -> Column:
    """Distinct character n-grams without blanks; a shorter text is its own."""
    t = F.regexp_replace(F.lower(_c(text)), r"\s+", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def ngram_jaccard(a, b, n: int = 2) -> Column:
    return jaccard(ngrams(a, n), ngrams(b, n))


def correction_score(a, b) -> Column:
    """The greater of trigram similarity and 1 - distance / longer length."""
    a, b = _c(a), _c(b)
    return F.greatest(trigram_similarity(a, b), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def normal_name(text) -> Column:
    """Lower case, letters, digits, hyphen, apostrophe and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}\s'-]", " "), r"\s+", " "))


def tag_value(text) -> Column:
    return F.regexp_replace(F.trim(F.lower(_c(text))), r"\s+", "_")


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(text))), r"[^a-z0-9]+", "-"), "^-|-$", "")


def without_article(text) -> Column:
    return F.regexp_replace(_c(text), r"(?i)^(a|an|the) ", "")


def straight_quotes(text) -> Column:
    return F.translate(_c(text), "‘’“”", "''\"\"")


def plural_label(camel) -> Column:
    """Words of a camel-case label, the last one in the plural."""
    words = F.regexp_replace(_c(camel), "([a-z0-9])([A-Z])", "$1 $2")
    return F.when(words.rlike("[^aeiou]y$"), F.regexp_replace(words, "y$", "ies")).when(words.rlike("(s|x|z|ch|sh)$"), F.concat(words, F.lit("es"))).otherwise(F.concat(words, F.lit("s")))


def term_hits(text, terms: list[str]) -> Column:
    """How many of the terms the text contains."""
    found = F.lit(0)
    for t in terms:
        found = found + F.lower(_c(text)).contains(t.lower()).cast("int")
    return found


def latin(text) -> Column:
    """Without the diacritics of Latin letters; ligatures and sharp s are spelt out."""
    t = F.lower(_c(text))
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.translate(t, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def long_street(text, words: dict[str, str]) -> Column:
    """A name whose last word is an abbreviation, with a stop or not, with that word in full."""
    out = _c(text)
    for short, full in words.items():
        out = F.regexp_replace(out, rf"(?i)(?<=\s){short}\.?$", full)
    return out
