"""Count-only unigram tokenization: the number of tokens of the best segmentation.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each place of a
word.  Dynamic programming carries the best score and its number of pieces; nothing is
kept to trace the pieces back.  Ties follow the tokenizers library: places are reached from
left to right, and a later start replaces an earlier one only with a higher score, so
among equals the longest piece stays.  A character that no piece of its own covers scores 10 below
the least score, and counts one token for each of its UTF-8 bytes.

Every blank becomes a mark, with one more before the text.  A text is cut before a run
of marks, unless some piece reaches from another character over a mark, and what lies between cuts is
segmented apart, so a word that has been seen needs no second pass.  Pieces of several marks, for
runs of blanks, count like all others.  Nulls and empty texts have no tokens.

The scores are those that the model file gives.  Where its pieces come from byte-pair merges these
are negative ranks; the best segmentation is that of a unigram model with these scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 600_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces with their scores of a sentencepiece model, without control, unknown and byte pieces."""
    p = SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


class Unigram:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.least = min(s for _, s in pieces) if pieces else 0.0
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.known: dict[str, tuple[int, float]] = {}
        crossed = any(re.search(f"[^{MARK}]{MARK}", piece) for piece, _ in pieces)
        self.units = re.compile("(?s).+" if crossed else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def word(self, word: str) -> tuple[int, float]:
        """Number of tokens and score of the best segmentation of one marked word, or of any string."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.automaton):
            for end, match in self.automaton.iter(word):
                ends[end].append(match)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        unknown = self.least - UNKNOWN_PENALTY
        for end, found in enumerate(ends):
            top, pieces, alone = None, 0, False
            # the longest first: the one that starts first
            for size, score in sorted(found, reverse=True):
                alone = alone or size == 1
                total = best[end + 1 - size] + score
                if top is None or total > top:
                    top, pieces = total, count[end + 1 - size] + 1
            if not alone:
                total = best[end] + unknown
                if top is None or total > top:
                    top, pieces = total, count[end] + len(word[end].encode())
            best[end + 1], count[end + 1] = top, pieces
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        """Number of tokens and score of a whole text."""
        if not text:
            return 0, 0.0
        total, score, known = 0, 0.0, self.known
        if len(known) >= REMEMBERED:
            known.clear()
        for word in self.units.findall(MARK + text.replace(" ", MARK)):
            found = known.get(word)
            if found is None:
                found = self.word(word)
                if len(word) <= 64:
                    known[word] = found
            total += found[0]
            score += found[1]
        return total, score


@lru_cache(maxsize=4)
def model(path: str) -> Unigram:
    return Unigram(vocabulary(path))


def counted(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens long, score double)`` of every row's whole text under the vocabulary at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            found = [m.text(x or "") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["id", "n_tokens", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, score double").withColumnRenamed("id", id_col)
