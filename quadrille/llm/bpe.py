"""Byte-level BPE: encoding with a priority queue over a linked list of symbols, and decoding.

The vocabulary is a file of the public ``tokenizers`` format (its path is a
parameter).  A text is first cut at its special tokens, then into *chunks*: a run
of white space with the run of other characters after it.  No alternative of the
splitting pattern matches a visible character followed by white space, so the
pieces of a chunk never depend on its neighbours and chunks can be remembered.

Nulls and empty texts have no tokens.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Characters with the Unicode property White_Space (fixed values).
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"
CHUNK = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
#: A text without this is its first chunk and chunks of a blank and what follows up to the next.
IRREGULAR = re.compile(f" [{BLANKS}]|[{BLANKS}] | $|^ ")
#: Entries that a worker remembers before it starts anew.
REMEMBERED = 600_000


def printable_bytes() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes with a visible Latin-1 character stand for themselves, the others take
    the code points from 256 on in ascending order.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary with its merge ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        shown = printable_bytes()
        byte_of = {c: b for b, c in enumerate(shown)}
        self.start = [vocab[c] for c in shown]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = max(vocab.values()).bit_length()
        self.both = [vocab[a + b] for a, b in pairs]
        self.ranks = {vocab[a] << self.width | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.strings: dict[int, bytes] = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self._pieces: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece of the splitting pattern.

        The symbols form a doubly linked list; ``now`` has the rank of the pair that begins at
        each place, -1 for none.  A heap holds the rank above the place, so the
        lowest rank comes first and the leftmost place among equal ranks.  An entry
        whose pair has changed since it was pushed is stale and is skipped.
        """
        ids = [self.start[b] for b in piece.encode()]
        n, bits = len(ids), len(ids).bit_length()
        rank_of, width, both, place = self.ranks.get, self.width, self.both, (1 << bits) - 1
        now = [rank_of(a << width | b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        heap = [rank << bits | i for i, rank in enumerate(now) if rank >= 0]
        if not heap:
            return tuple(ids)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now.append(-1)
        while heap:
            top = heappop(heap)
            i, rank = top & place, top >> bits
            if now[i] != rank:
                continue
            j = after[i]
            after[i] = k = after[j]
            ids[i] = symbol = both[rank]
            ids[j] = now[j] = -1
            if k < n:
                before[k] = i
                now[i] = rank = rank_of(symbol << width | ids[k], -1)
                if rank >= 0:
                    heappush(heap, rank << bits | i)
            else:
                now[i] = -1
            if i:
                k = before[i]
                now[k] = rank = rank_of(ids[k] << width | symbol, -1)
                if rank >= 0:
                    heappush(heap, rank << bits | k)
        return tuple([x for x in ids if x >= 0])

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """The ids of a chunk."""
        known, out = self._pieces, ()
        for piece in self.pieces(chunk):
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece)
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text."""
        return [i for ids in _ids(self).text(text or "", self) for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: their vocabulary strings one after another."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Bpe:
    """The vocabulary at ``path``, loaded once in each Python process."""
    return Bpe(path)


class Remembered:
    """What ``make`` gives for a chunk and for a special token's id, each made once while it is remembered."""

    def __init__(self, make: Callable[[str], object], special: Callable[[int], object]):
        self.make, self.special, self.known = make, special, {}

    def chunks(self, keys: list[str], before: str) -> list:
        """For chunks that are ``before`` and a key each."""
        known = self.known
        out = list(map(known.get, keys))
        if None in out:
            if len(known) >= REMEMBERED:
                known.clear()
            for k, x in enumerate(out):
                if x is None:
                    key = keys[k]
                    x = known.get(key)
                    if x is None:
                        x = self.make(before + key)
                        if len(key) <= 64:
                            known[key] = x
                    out[k] = x
        return out

    def text(self, text: str, bpe: Bpe) -> list:
        """For the special tokens and chunks of a whole text, in order."""
        if bpe.cut and any(s in text for s in bpe.special):
            out = []
            for part in bpe.cut.split(text):
                if part:
                    out += [self.special(bpe.special[part])] if part in bpe.special else self.text(part, bpe)
            return out
        if IRREGULAR.search(text):
            return [self.make(c) for c in CHUNK.findall(text)]
        first, *rest = text.split(" ")
        out = [self.make(first)] if first else []
        return out + self.chunks(rest, " ")


@lru_cache(maxsize=4)
def _ids(bpe: Bpe) -> Remembered:
    return Remembered(bpe.chunk, lambda i: (i,))


@lru_cache(maxsize=4)
def _described(path: str) -> Remembered:
    """For a chunk: its ids joined by commas, their number, and the strings of the ids joined."""
    bpe = vocabulary(path)
    strings = bpe.strings.__getitem__

    def make(chunk: str) -> tuple[str, int, bytes]:
        ids = bpe.chunk(chunk)
        return ",".join(map(str, ids)), len(ids), b"".join(map(strings, ids))

    return Remembered(make, lambda i: (str(i), 1, strings(i)))


def digests(text: str | None, path: str) -> tuple[int, str, str]:
    """Number of tokens, sha256 of the ids joined by commas, sha256 of the decoded text."""
    bpe, described = vocabulary(path), _described(path)
    found = described.text(text or "", bpe)
    listed, counts, strings = zip(*found, strict=True) if found else ((), (), ())
    decoded = b"".join(strings).decode("utf-8", "replace")
    return sum(counts), hashlib.sha256(",".join(listed).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every row's whole text; null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([bpe.encode(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_column(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of every row's ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([bpe.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and give digests of both.

    ``(id, n_tokens long, ids_sha256, decoded_sha256)``, a row for each row of ``docs``.
    Nothing is shuffled; a task holds one batch and what it remembers of chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [digests(x, path) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
