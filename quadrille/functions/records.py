"""Rules over the records of answers, phrases and plans, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: fragments that a phrase loses at its end, the first that fits
FRAGMENTS = (" are", " is", " near", " around", " close", " nearby", " within", " in", " of", " at", " vendors of", " vendors")
# fixed values: classes of structures and places, which aren't searched for
STRUCTURES = ("HIGHWAY", "PLACE", "WATERWAY", "NATURAL", "BOUNDARY", "ROUTE", "RAILWAY", "LANDUSE")
# fixed values: question words
QUESTION_WORDS = ("Which", "What", "Where", "When", "Who", "Why", "How", "Is", "Are", "Was", "Were", "Do", "Does", "Did", "Can", "Could", "Would", "Will", "Shall", "There", "Their", "Then", "Than", "Has", "Have", "Had")
# fixed values: phrases for any amenity
GENERIC = ("amenities", "amenity", "places", "services", "facilities", "shop", "shops", "store", "stores", "businesses")
# fixed values: keys that name a class, the first present wins
CLASS_KEYS = ("amenity", "building", "highway", "leisure", "landuse", "natural", "waterway", "railway", "aeroway", "place", "tourism", "historic", "shop", "office", "craft", "sport")
# fixed values: labels of continents, all others are "other"
CONTINENTS = {
    "africa": ("africa",),
    "antarctica": ("antarctica",),
    "asia": ("asia", "china"),
    "europe": ("europe", "france", "united_kingdom", "great-britain", "great_britain"),
    "north-america": ("north-america", "north_america", "central-america", "central_america"),
    "oceania": ("oceania", "australia", "australia-oceania", "australia_oceania"),
    "south-america": ("south-america", "south_america"),
}


def without_fragment(phrase: Column) -> Column:
    """A lower-case phrase without the first of the fragments that it ends in."""
    low = F.lower(F.trim(F.coalesce(phrase, F.lit(""))))
    out = F
    for f in FRAGMENTS:
        out = out.when(low.endswith(f), F.rtrim(F.substring(low, F.lit(1), F.length(low) - len(f))))
    return out.otherwise(low)


def is_generic(phrase: Column) -> Column:
    return without_fragment(phrase).isin(*GENERIC)


def tag_variants(text: Column) -> tuple[Column, Column]:
    """A value with blanks (lower-case) and with underscores; null for a blank text."""
    phrase = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    low = F.when(phrase != "", F.lower(F.replace(phrase, F.lit(" "), F.lit("_"))))
    return F.replace(low, F.lit("_"), F.lit(" ")), low


def is_poi(wkg_class: Column) -> Column:
    """Whether a class is one of points of interest, by the part after its last colon."""
    key = F.upper(F.trim(F.substring_index(F.coalesce(wkg_class, F.lit("")), ":", -1)))
    return ~key.isin("", "WKGOBJECT", *STRUCTURES)


def question_word(word: Column) -> Column:
    """The question word that a word of four letters or more begins with, or is the beginning of, at two edits at most; else the word."""
    low = F.lower(word)
    out = F.when(F.length(word) < 4, word)
    for q in QUESTION_WORDS:
        near = low.startswith(q.lower()) | F.lit(q.lower()).startswith(low)
        out = out.when(near & (low != q.lower()) & (F.levenshtein(low, F.lit(q.lower())) <= 2), F.lit(q))
    return out.otherwise(word)


def singulars(word: Column) -> Column:
    """What a plural may stand for, likeliest first; empty where it is none."""
    low = F.lower(word)
    cut = lambda k: F.substring(low, F.lit(1), F.length(low) - k)
    found = F.array(F.when(low.endswith("ies"), F.concat(cut(3), F.lit("y"))), F.when(low.endswith("es"), cut(2)), cut(1))
    return F.when(low.endswith("s") & (F.length(low) > 3), F.array_compact(found)).otherwise(F.array().cast("array<string>"))


def class_text(tags: Column) -> Column:
    """The value of the first key that names a class; empty without one."""
    return F.coalesce(*[F.nullif(F.element_at(tags, F.lit(k)), F.lit("")) for k in CLASS_KEYS], F.lit(""))


def continent(label: Column) -> Column:
    key = F.replace(F.lower(F.trim(label)), F.lit(" "), F.lit("_"))
    out = F
    for slug, names in CONTINENTS.items():
        out = out.when(key.isin(*names), F.lit(slug))
    return out.otherwise(F.lit("other"))


def coverage(error: Column, results: Column, mismatch: Column, repair: Column, evidence: Column) -> Column:
    """What became of a slot of a plan."""
    found = F.when(mismatch, "class_mismatch").when(repair.isNotNull(), "filled_by_repair").otherwise("filled")
    return F.when(error, "error").when(results > 0, found).when((repair == "fallback_evidence") & (evidence > 0), "missing_with_evidence").otherwise("missing")


def hashed_vector(text: Column, dims: int = 4, without: tuple[str, ...] = ()) -> Column:
    """Mean of the words' vectors, which follow from their digests; zeros without words."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: (w != "") & ~w.isin("", *without))
    part = lambda w, i: F.conv(F.substring(F.md5(w), 4 * i + 1, 4), 16, 10).cast("double") / 65535 - 0.5
    n = F.greatest(F.size(words), F.lit(1))
    total = lambda i: F.aggregate(words, F.lit(0.0), lambda s, w: s + part(w, i))
    return F.array(*[total(i) / n for i in range(dims)])
