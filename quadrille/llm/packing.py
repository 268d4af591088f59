"""Packing documents into training sequences by the online sum-of-squares rule.

A level array holds, for each fill level, how many windows are open at that level.  A
document goes into the level whose use leaves the smallest sum of squared counts;
an empty window is level 0, and among equal sums the fullest level wins.  What is
longer than a window first fills whole windows.  When as many windows are open as a
task may hold, the next document is cut to complete the fullest of them; at its
end a task fuses the windows still open, and cuts the rest of fewer ids than a
window into sequences whose lengths are powers of two, which need no padding.

Each task packs the rows of its partition in their order: nothing is shuffled, and a
repeated task gives the same sequences.  Null and empty texts hold the end id alone.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

CAPACITY = 1024
#: Windows that a task holds open; 4 bytes an id, so at most 2 MB.
MAX_OPEN = 512


class Piece:
    """Part of a document: its ids as little-endian unsigned 32-bit integers."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.total), Piece(self.doc, self.start + n, self.ids[4 * n :], self.total)


class SumOfSquares:
    """Online packing of pieces into windows; closed windows are lists of pieces."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.open = np.zeros(capacity + 1, np.int64)  # the level array; 0 and capacity stay 0
        self.windows: dict[int, list[list[Piece]]] = defaultdict(list)
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The fill level that a piece of ``size`` ids, fewer than a window, goes to."""
        levels = np.flatnonzero(self.open[: self.capacity - size + 1])
        counts = self.open[levels]
        there = self.open[levels + size]
        change = np.where(levels + size < self.capacity, 2 * there + 1, 0) - 2 * counts + 1
        if self.n_open < self.max_open:
            levels = np.append(levels, 0)
            change = np.append(change, 2 * self.open[size] + 1)
        if not len(levels):
            return -1
        best = change.min()
        return int(levels[change == best].max())

    def _take(self, level: int) -> list[Piece]:
        if not level:
            return []
        self.open[level] -= 1
        self.n_open -= 1
        return self.windows[level].pop()

    def _put(self, level: int, window: list[Piece]) -> None:
        self.open[level] += 1
        self.n_open += 1
        self.windows[level].append(window)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece; yields the windows that it completes."""
        while len(piece) >= self.capacity:
            head, piece = piece.cut(self.capacity)
            yield [head]
        while len(piece):
            level = self.level_for(len(piece))
            if level < 0:  # none has room and no more may be opened
                level = int(np.flatnonzero(self.open).max())
            room = self.capacity - level
            head, piece = piece.cut(room) if len(piece) > room else (piece, Piece(piece.doc, 0, b"", 0))
            window = [*self._take(level), head]
            if level + len(head) == self.capacity:
                yield window
            else:
                self._put(level + len(head), window)

    def finish(self) -> Iterator[list[Piece]]:
        """Fuse what is open; what remains is cut into powers of two."""
        window, room = [], self.capacity
        for level in sorted((x for x in self.windows if self.windows[x]), reverse=True):
            for piece in (p for w in self.windows[level] for p in w):
                while len(piece) >= room:
                    head, piece = piece.cut(room)
                    yield [*window, head]
                    window, room = [], self.capacity
                if len(piece):
                    window.append(piece)
                    room -= len(piece)
        left = self.capacity - room
        while left:
            size = room = 1 << (left.bit_length() - 1)
            left -= size
            now = []
            while room:
                piece = window.pop(0)
                if len(piece) > room:
                    piece, rest = piece.cut(room)
                    window.insert(0, rest)
                now.append(piece)
                room -= len(piece)
            yield now
        self.__init__(self.capacity, self.max_open)


class Ids:
    """Ids of whole texts, as bytes of little-endian unsigned 32-bit integers.

    ``path`` is the vocabulary of the tokenizers library.  Where ``ranks`` names the same
    vocabulary as merge ranks, tiktoken gives the same ids in a quarter of the time; what its
    pattern engine refuses (white space by the million) the tokenizers library does.
    """

    def __init__(self, path: str, ranks: str | None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fast = None
        if ranks:
            with open(ranks, "rb") as f:
                pairs = [line.split() for line in f]
            special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except ValueError:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str, ranks: str | None = None) -> Ids:
    return Ids(path, ranks)


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = 0, max_open: int = MAX_OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents; a row for each piece.

    ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: where the piece begins in its
    document, its ids, their CRC-32, the ids of the whole document with the end id, and
    its sequence and place there.  Repeated rows are packed each on its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = tokenizer(path, ranks), SumOfSquares(capacity, max_open)
        sequence = TaskContext.get().partitionId() << 36
        end, kind = np.array([end_id], "<u4").tobytes(), None
        rows: list[tuple] = []

        def closed(windows: Iterable[list[Piece]]) -> None:
            nonlocal sequence
            for window in windows:
                offset = 0
                for p in window:
                    rows.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, sequence, offset))
                    offset += len(p)
                sequence += 1

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 7
            batch = pa.record_batch([pa.array(c, kind if k == 0 else pa.int64()) for k, c in enumerate(columns)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return batch

        for b in batches:
            kind = b.schema.field(0).type
            keys, texts = b.column(0).to_pylist(), b.column(1)
            for key, text in zip(keys, texts, strict=True):
                ids = ids_of(text.as_py() or "")
                closed(packer.add(Piece(key, 0, ids + end, len(ids) // 4 + 1)))
                if len(rows) > 4000:
                    yield out()
        closed(packer.finish())
        if rows:
            yield out()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
