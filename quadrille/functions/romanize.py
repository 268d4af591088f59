"""Latin forms of names by script, as an Arrow UDF: the first romanizer that knows the script is used."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Latin letters of Korean initial, medial and final sounds, in code order.
INITIALS = "g kk n d tt r m b pp s ss  j jj ch k t p h".split(" ")
MEDIALS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
FINALS = " k k k n n n t l k m l l l p l m p p t t ng t t k t p h".split(" ")
#: First and last syllable block.
FIRST, LAST = 0xAC00, 0xD7A3
# Letters that don't decompose.
SPECIAL = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i"}

_REGISTRY: list[tuple[str, Callable[[str], bool], Callable[[str], str]]] = []


def register(name: str, knows: Callable[[str], bool], spell: Callable[[str], str]) -> None:
    """Add a romanizer; those added later are asked first."""
    _REGISTRY.insert(0, (name, knows, spell))


def _plain(text: str) -> str:
    kept = "".join(c if c.isalnum() or c in "-' " else " " for c in text.lower())
    return " ".join(kept.split())


def _strip(text: str) -> str:
    spelt = "".join(SPECIAL.get(c, c) for c in text.lower())
    return _plain("".join(c for c in unicodedata.normalize("NFKD", spelt) if unicodedata.category(c) != "Mn"))


def _korean(text: str) -> str:
    out = []
    for c in unicodedata.normalize("NFC", text):
        n = ord(c) - FIRST
        out.append(INITIALS[n // 588] + MEDIALS[n % 588 // 28] + FINALS[n % 28] if 0 <= n <= LAST - FIRST else c)
    return _plain("".join(out))


register("identity", lambda t: True, _plain)
register("diacritics", lambda t: any(c in SPECIAL or unicodedata.decomposition(c)[:1] not in ("", "<") for c in t.lower()) and not any(FIRST <= ord(c) <= LAST for c in t), _strip)
register("hangul", lambda t: any(FIRST <= ord(c) <= LAST for c in t), _korean)


def romanize(text: str | None) -> str | None:
    if text is None:
        return None
    return next(spell for _, knows, spell in _REGISTRY if knows(text))(text)


@F.pandas_udf(StringType())
def romanized(names: pd.Series) -> pd.Series:
    return names.map(romanize, na_action="ignore")
