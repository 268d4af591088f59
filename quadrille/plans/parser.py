"""From a question to a plan: which template, what is asked for, around which place, and how far."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Patterns in order; the first that fits decides.
TEMPLATES = [
    ("distance", re.compile(r"\b(?:how far|distance)\b.*?\b(?:from|between)\s+(?P<a>.+?)\s+(?:to|and)\s+(?P<b>.+?)\??$", re.I)),
    ("bearing", re.compile(r"\b(?:which|what) direction\b.*?\b(?:is|lies?)\s+(?P<a>.+?)\s+(?:from|of)\s+(?P<b>.+?)\??$", re.I)),
    ("cone", re.compile(r"\bnearest\s+(?P<cls>.+?)\s+(?P<way>north|northeast|east|southeast|south|southwest|west|northwest)\s+of\s+(?P<b>.+?)\??$", re.I)),
    ("within", re.compile(r"\b(?P<cls>[\w# ]+?)\s+(?:are\s+|is\s+|lie\s+)?within\s+(?P<n>\d+(?:\.\d+)?)\s*(?P<unit>km|kilomet\w+|m|met\w+)\s+of\s+(?P<b>.+?)\??$", re.I)),
    ("nearest", re.compile(r"\b(?:nearest|closest)\s+(?P<cls>.+?)\s+(?:to|near)\s+(?P<b>.+?)\??$", re.I)),
    ("communities", re.compile(r"\bcommunit(?:y|ies)\b", re.I)),
    ("drift", re.compile(r"\b(?:change[ds]?|drift)\b.*?\bsince\s+(?P<since>\d{4}[-_]\d{2}[-_]\d{2})", re.I)),
    ("diffusion", re.compile(r"\b(?:spread|diffus\w+)\b.*?\bfrom\s+(?P<b>.+?)\??$", re.I)),
    ("spectrum", re.compile(r"\b(?:connectivity|spectr\w+)\b", re.I)),
]
#: The order in which the roles of a plan are worked out.
ROLES = ("extent", "condition", "support", "measure")
LEADING = re.compile(r"^(?:which|what|how many|list|show|find|the|all|any)\s+", re.I)


@dataclass(frozen=True)
class Plan:
    template: str
    slots: dict[str, str]
    radius_km: float | None = None
    steps: list[tuple[str, str]] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        """Whether the steps keep the order of roles and end in a measure."""
        at = [ROLES.index(r) for r, _ in self.steps]
        return at == sorted(at) and bool(at) and self.steps[-1][0] == "measure"


def singular(phrase: str) -> str:
    """Without the plural of its last word."""
    for pattern, to in ((r"ies$", "y"), (r"(s|x|z|ch|sh)es$", r"\1"), (r"(?<!s)s$", "")):
        changed = re.sub(pattern, to, phrase)
        if changed != phrase:
            return changed
    return phrase


def category(phrase: str, vocabulary: set[str]) -> str | None:
    """The vocabulary's form of a phrase: itself, its singular, or that of its last words."""
    low = {v.lower(): v for v in vocabulary}
    words = phrase.strip().lower().split()
    for k in range(len(words)):
        for form in (" ".join(words[k:]), singular(" ".join(words[k:]))):
            if form in low:
                return low[form]
    return None


def parse(question: str, vocabulary: set[str] = frozenset()) -> Plan:
    """The plan of a question; template ``search`` where no pattern fits."""
    text = " ".join(question.split())
    for name, pattern in TEMPLATES:
        m = pattern.search(text)
        if not m:
            continue
        slots = {k: v.strip() for k, v in m.groupdict().items() if v}
        if "cls" in slots:
            phrase = slots["cls"]
            while (shorter := LEADING.sub("", phrase)) != phrase:
                phrase = shorter
            slots["cls"] = category(phrase, vocabulary) or phrase
        radius = float(slots["n"]) / (1 if slots["unit"].lower().startswith("k") else 1000) if "n" in slots else None
        steps = [("extent", slots["b"])] if "b" in slots else []
        steps += [("condition", slots["cls"])] if "cls" in slots else []
        steps += [("support", f"{radius} km")] if radius else []
        return Plan(name, slots, radius, [*steps, ("measure", name)])
    return Plan("search", {"text": text}, None, [("measure", "search")])
