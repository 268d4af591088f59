"""Near duplicates by MinHash and an LSH forest.

Every distinct shingle set has 128 MinHash values.  Each of 16 trees sorts the sets by its own
8 values.

1. Documents with equal sets become one node.
2. In the first trees the neighbours in the order, which have the longest common prefixes, are
   brought together and confirmed: most groups of copies are then one component.
3. In all trees a region, the sets that share a prefix, is compared whole by sketches (two bits of
   each value) and sizes; sets of one component need no comparison.  Regions are adaptive: a
   prefix of two values, and of three where more than ``DENSE`` sets share two.  No window and no
   number of partners cuts them.
4. What the sketches bring together is confirmed on the full sets.  A group of sets is moved once to a
   cell and compared there whole, by counts of common shingles; groups that are too large for a cell
   are dealt to blocks, and each two blocks meet.

Only a spanning forest of each region's candidates, and of each cell's links, leaves its task,
so the rows that are moved grow with the sets and not with the pairs.  The comparisons
inside a dense region do grow with the square of its sets that aren't yet one component.

A pair with a similarity of 0.8 shares two values of none of the trees with a chance of
0.36 ** 16, about 1e-7 (three: 0.488 ** 16, 1e-5), and its sketches are too unlike with a chance of
1e-6; pairs that are likelier, or linked by a third set as well, are lost less often still.

Words are runs other than blanks; A-Z are lower-cased.  A text with fewer words than a shingle
has its whole sequence as its one shingle.  Null and empty texts have no shingle and are
linked with nothing.  Rows of one id count as one document; rows with a null id are linked
with nothing and not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.llm.common import cut
from quadrille.llm.components import components

TREES, DEPTH = 16, 8
VALUES = TREES * DEPTH
#: Words whose hashes a worker remembers before it starts anew.
REMEMBERED = 500_000
#: Ids are broadcast up to so many, at 8 bytes each; beyond that they are joined.
MAX_BROADCAST = 2_000_000
#: Sketches of sets with a similarity of 0.8 differ in 19 of 128 values on average, with a deviation of 4.
MAX_UNLIKE = 40
#: Trees whose neighbours are confirmed first, and how many places of an order make one cell where a group is large.
FIRST_TREES, PLACES = 4, 512
#: Sets that share two values of a tree, beyond which a region is those that share three.
DENSE = 16_384
#: Rows, and shingles of their sets, of a block; a group with more is dealt to several.
BLOCK, HEAVY = 2048, 2_000_000
#: Comparisons of sketches made at once.
CHUNK = 500_000

_RANDOM = np.random.default_rng(20240601)
_FACTORS = _RANDOM.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**63, VALUES, dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=size)], np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(_mixed(out))


def signature(found: np.ndarray) -> np.ndarray:
    """The 128 MinHash values of a set, its least under each hash."""
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(out, (found[at : at + 512, None] * _FACTORS + _TERMS).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def signed(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_shingles, digest, signature)`` of every row; the last two are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), size) for x in b.column(1)]
            yield pa.record_batch(
                [b.column(0), pa.array(map(len, sets), pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["id", "n_shingles", "digest", "signature"],
            )

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id long, n_shingles long, digest binary, signature binary")


def _planes(sig: np.ndarray) -> np.ndarray:
    """Two bits of each of the 128 values as two planes of bits: 32 bytes for each set."""
    return np.concatenate([np.packbits((sig >> k & 1).astype(np.uint8), axis=1) for k in (0, 1)], axis=1)


def _unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many values the sketches of two arrays of rows differ."""
    d = a ^ b
    half = d.shape[1] // 2
    return np.bitwise_count(d[:, :half] | d[:, half:]).sum(1, dtype=np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of equal length as a column of bytes."""
    n, width = rows.shape[0], rows.shape[1] * rows.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a column of bytes, all of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _orders(nodes: DataFrame, trees: int) -> DataFrame:
    """``(tree, place, two, three, sketch, id, component, n)``: a row for each node and tree.

    ``place`` is what the tree sorts by; ``two`` and ``three`` are hashes of the tree and the prefixes of
    so many values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            sig = _bytes(b.column(1), np.uint32)
            sketches = _binary(_planes(sig))
            values = sig.reshape(n, TREES, DEPTH)
            for t in range(trees):
                two = _mixed((values[:, t, 0].astype(np.uint64) << np.uint64(32) | values[:, t, 1]) + _TERMS[t])
                three = _mixed(two + values[:, t, 2] + np.uint64(1))
                columns = [pa.array(np.full(n, t, np.int32)), _binary(values[:, t].astype(">u4")), pa.array(two.view(np.int64)), pa.array(three.view(np.int64)), sketches, b.column(0), b.column(2), b.column(3)]
                yield pa.record_batch(columns, ["tree", "place", "two", "three", "sketch", "id", "component", "n"])

    return nodes.select("id", "signature", "component", "n").mapInArrow(run, "tree int, place binary, two long, three long, sketch binary, id long, component long, n long")


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest place that the pairs ``a``, ``b`` reach."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: An edge joins ``x`` and ``y`` in a group; an edge of a row with itself says that it stands there.  ``region`` is the group if the whole of what is joined is too large.
_EDGES = "x long, y long, region long, component long, n long"


def _edges(x: np.ndarray, y: np.ndarray, region: np.ndarray, component: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c.astype(np.int64)) for c in (x, y, region, component, n)], ["x", "y", "region", "component", "n"])


def _neighbours(nodes: DataFrame, trees: int, percent: int) -> DataFrame:
    """Edges between nodes that stand side by side in an order with a common prefix of two values and like sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, own = None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(0)[0].as_py() if own is None else own
            rows = pa.Table.from_batches([b] if last is None else [last, b]).combine_chunks()
            two, ids, n = (rows.column(c).to_numpy() for c in ("two", "id", "n"))
            planes = _bytes(rows.column("sketch").combine_chunks(), np.uint64)
            i = np.flatnonzero((two[:-1] == two[1:]) & (ids[:-1] != ids[1:]) & (100 * np.minimum(n[:-1], n[1:]) >= percent * np.maximum(n[:-1], n[1:])))
            i = i[_unlike(planes[i], planes[i + 1]) <= MAX_UNLIKE]
            region = (_mixed(two[i].view(np.uint64)) + ((at + i) // PLACES).astype(np.uint64)).view(np.int64)
            yield _edges(np.concatenate([ids[i], ids[i + 1]]), np.concatenate([ids[i + 1]] * 2), np.concatenate([region] * 2), np.concatenate([ids[i], ids[i + 1]]), np.concatenate([n[i], n[i + 1]]))
            at += rows.num_rows - 1
            last = rows.slice(rows.num_rows - 1).to_batches()[0]

    rows = _orders(nodes, trees).select("tree", "place", "two", "sketch", "id", "n")
    rows = rows.repartitionByRange("tree", "place", "id").sortWithinPartitions("tree", "place", "id")
    return rows.mapInArrow(run, _EDGES)


def _few(keys: DataFrame) -> DataFrame:
    """A table of keys to be broadcast, if it is small enough for that."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys


def _regions(nodes: DataFrame, percent: int, dense: int = DENSE, block: int = BLOCK) -> DataFrame:
    """Edges between nodes of different components whose sizes and sketches allow a link, from all regions of all trees.

    A region is compared whole: beyond ``block`` rows it is dealt to blocks, each two of which meet in one task.
    Only a spanning forest of what is alike is returned.
    """

    def compared(planes: np.ndarray, key: np.ndarray, ids: np.ndarray, comp: np.ndarray, size: np.ndarray, side: np.ndarray, cross: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = len(ids)
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.int64)
        # rows of a group are in order of their sizes; beyond the last row that is small enough nothing is alike
        place = (group << 40) + size
        end = np.searchsorted(place, (group << 40) + np.minimum(100 * size // percent, (1 << 40) - 1), "right")
        width = end - np.arange(total) - 1
        upto = np.cumsum(width)
        at = 0
        while at < total:
            done = upto[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, done + CHUNK, "right")))
            w = width[at:stop]
            i = np.repeat(np.arange(at, stop), w)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
            at = stop
            ok = (comp[i] != comp[j]) & (ids[i] != ids[j]) & (~cross[i] | (side[i] != side[j]))
            i, j = i[ok], j[ok]
            ok = _unlike(planes[i], planes[j]) <= MAX_UNLIKE
            i, j = i[ok], j[ok]
            if len(i):
                there, where = np.unique(np.concatenate([i, j]), return_inverse=True)
                root = there[_smallest(len(there), where[: len(i)], where[len(i) :])]
                yield _edges(ids[there], ids[root], _mixed(key[there].view(np.uint64)).view(np.int64), comp[there], size[there])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ready(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rows).combine_chunks()
            key, lo, hi, side, ids, comp, n = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "side", "id", "component", "n"))
            of = key ^ _mixed((lo.astype(np.uint64) << np.uint64(32)) + hi.astype(np.uint64)).view(np.int64)
            yield from compared(_bytes(t.column("sketch").combine_chunks(), np.uint64), of, ids, comp, n, side, lo != hi)

        for b in batches:
            if not b.num_rows:
                continue
            # the last group of a batch waits for the rest of it
            group = np.stack([b.column(c).to_numpy() for c in ("key", "lo", "hi")])
            low = int(np.argmax((group == group[:, -1:]).all(0)))
            if held and (low or [held[-1].column(c)[0].as_py() for c in ("key", "lo", "hi")] != group[:, 0].tolist()):
                yield from ready([*held, b.slice(0, low)])
                held = []
            elif low:
                yield from ready([b.slice(0, low)])
            held.append(b.slice(low))
        if held:
            yield from ready(held)

    rows = _orders(nodes, TREES).select("two", "three", "sketch", "id", "component", "n")
    long = cut(rows.groupBy("two").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block))
    rows = rows.withColumn("key", F.col("two"))
    if not long.isEmpty():
        deep = _few(long.filter(F.col("m") > dense).select("two", F.lit(True).alias("deep")))
        rows = rows.join(deep, "two", "left").withColumn("key", F.when(F.col("deep").isNotNull(), F.col("three")).otherwise(F.col("two")))
        deeper = rows.filter("deep").groupBy("three").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block).select(F.col("three").alias("key"), "m")
        rows = rows.join(_few(deeper.unionByName(long.filter(F.col("m") <= dense).select(F.col("two").alias("key"), "m"))), "key", "left")
        of = F.ceil(F.coalesce("m", F.lit(1)) / block).cast("int")
        rows = _met(rows, of, "id")
    else:
        rows = rows.select("*", F.lit(0).alias("side"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    rows = rows.select("key", "lo", "hi", "side", "sketch", "id", "component", "n").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n")
    return rows.mapInArrow(run, _EDGES)


def _met(rows: DataFrame, of, id_col: str) -> DataFrame:
    """``rows`` dealt to ``of`` blocks: a row for each two blocks ``lo``, ``hi`` of which its own, ``side``, is one."""
    rows = rows.withColumn("side", F.pmod(F.xxhash64(id_col, F.lit("block")), of).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), of - 1)))
    return rows.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other")).drop("other")


def _sets(docs: DataFrame, ids: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, shingles)`` of the documents ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([shingles(x.as_py(), size).tobytes() for x in b.column(1)], pa.binary())], ["id", "shingles"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).join(_few(ids), "id", "left_semi")
    return rows.mapInArrow(run, "id long, shingles binary").dropDuplicates(["id", "shingles"])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common, above the diagonal.

    Elements of many sets are counted by products of matrices, those of few by their pairs.
    """
    m = len(sets)
    out, product = np.zeros((m, m), np.float32), np.empty((m, m), np.float32)
    elements = np.concatenate(sets)
    order = np.argsort(elements, kind="stable")  # the rows of an element are in order, too
    elements = elements[order]
    r = np.repeat(np.arange(m, dtype=np.int32), [len(s) for s in sets])[order]
    first = np.concatenate([[True], elements[1:] != elements[:-1]])
    del elements, order
    v = np.cumsum(first, dtype=np.int32) - 1
    df = np.bincount(v)
    many = df > max(4, m // 16)
    width = max(64, 4_000_000 // m)
    ok = many[v]
    rows, c = r[ok], (np.cumsum(many, dtype=np.int32) - 1)[v[ok]]
    for low in range(0, int(many.sum()), width):
        x = np.zeros((m, min(width, int(many.sum()) - low)), np.float32)
        now = slice(*np.searchsorted(c, [low, low + width]))
        x[rows[now], c[now] - low] = 1
        out += np.matmul(x, x.T, out=product)
    del product, rows, c
    ok = ((df > 1) & ~many)[v]
    r, v = r[ok], v[ok]
    after = np.searchsorted(v, v, "right") - np.arange(len(v)) - 1
    upto = np.cumsum(after)
    at = 0
    while at < len(v):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        w = after[at:stop]
        i = np.repeat(np.arange(at, stop), w)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
        np.add.at(out.reshape(-1), r[i].astype(np.int64) * m + r[j], 1)
        at = stop
    return out


def linked(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, cross: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links ``100 * intersection >= percent * union`` between sets (``cross``: of different sides)."""
    n = np.array([len(s) for s in sets], np.int64)
    there = np.flatnonzero(n)
    sets, ids, side, n = [sets[k] for k in there], ids[there], side[there], n[there]
    if len(ids) < 2:
        return ids[:0], ids[:0]
    common = _common(sets)
    m = len(ids)
    a = b = np.empty(0, np.int64)
    for low in range(0, m, 256):
        c = common[low : low + 256, low:].astype(np.int64)
        ok = 100 * c >= percent * (n[low : low + 256, None] + n[None, low:] - c)
        ok &= np.arange(m - low)[None] > np.arange(len(c))[:, None]
        if cross:
            ok &= side[low : low + 256, None] != side[None, low:]
        i, j = np.nonzero(ok)
        # of the links so far only a spanning forest is held: a dense cell has millions
        root = _smallest(m, np.concatenate([a, i + low]), np.concatenate([b, j + low]))
        a = np.flatnonzero(root != np.arange(m))
        b = root[a]
    return ids[a], ids[b]


def _confirmed(edges: DataFrame, docs: DataFrame, trees: int, size: int, percent: int, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """Links ``(x, y)`` on the full sets between all that edges join.

    What edges join is a cell; where it has more rows than its regions in all trees would move, its
    regions are the cells.  A cell with more than ``block`` rows, or too many shingles, is dealt to
    blocks.  Components that fill blocks have blocks of their own, which need not meet.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, side = (t.column(c).to_numpy() for c in ("id", "side"))
        x, y = linked(ids, [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()], side, key[1].as_py() != key[2].as_py(), percent)
        return pa.table([pa.array(x), pa.array(y)], ["x", "y"])

    edges = cut(edges)
    joined = cut(components(edges))
    large = _few(joined.groupBy("component").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > trees * block).select(F.col("component").alias("whole"), F.lit(True).alias("large")))
    member = edges.select(F.col("x").alias("id"), "region", F.col("component").alias("of"), "n").join(joined.withColumnRenamed("component", "whole"), "id").join(large, "whole", "left")
    member = cut(member.select("id", "of", "n", F.when(F.col("large").isNotNull(), F.xxhash64("whole", "region")).otherwise(F.col("whole")).alias("cell")).groupBy("cell", "id").agg(F.max("n").alias("n"), F.min("of").alias("of")))
    full = member.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).filter((F.col("m") > block) | (F.col("s") > HEAVY))
    full = cut(full.select("cell"))
    if full.isEmpty():
        rows = member.select("cell", "id", F.lit(0).alias("side"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    else:
        small = member.join(_few(full), "cell", "left_anti").select("cell", "id", F.lit(0).alias("side"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
        rest = member.join(_few(full), "cell", "left_semi")
        # parts: the components that fill a block, and all others as one
        parts = rest.groupBy("cell", "of").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
        fills = (F.col("m") > block) | (F.col("s") > HEAVY)
        parts = parts.groupBy("cell", F.when(fills, F.col("of")).alias("part")).agg(F.sum("m").alias("m"), F.sum("s").alias("s"))
        parts = cut(parts.select("cell", "part", F.ceil(F.greatest(F.col("m") / block, F.col("s") / HEAVY)).cast("int").alias("k")))
        # blocks of a cell are numbered through; a part's begin at ``first``
        parts = parts.withColumn("first", F.coalesce(F.sum("k").over(W.partitionBy("cell").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")).withColumn("all", F.sum("k").over(W.partitionBy("cell")).cast("int"))
        rest = rest.join(_few(parts.filter("part is not null").select("cell", F.col("part").alias("of"), "k", "first", "all")), ["cell", "of"], "left")
        others = parts.filter("part is null").select("cell", F.col("k").alias("k0"), F.col("first").alias("f0"), F.col("all").alias("a0"))
        rest = rest.join(_few(others), "cell", "left").withColumn("own", F.col("k").isNotNull())
        rest = rest.select("cell", "id", "own", *[F.coalesce(a, b).alias(a) for a, b in (("k", "k0"), ("first", "f0"), ("all", "a0"))])
        rest = rest.withColumn("side", (F.col("first") + F.pmod(F.xxhash64("id", F.lit("block")), F.col("k"))).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
        rest = rest.filter(~F.col("own") | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("k")))
        rows = small.unionByName(rest.select("cell", "id", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi")))
    sets = _sets(docs, member.select("id").distinct(), size, id_col, text_col)
    return rows.join(sets, "id").select("cell", "lo", "hi", "id", "side", "shingles").groupBy("cell", "lo", "hi").applyInArrow(run, "x long, y long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of near duplicates: ``(id, n_shingles, component_id, kept)``, a row for each row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included; ``kept``
    says whether that is the row's own id.
    """
    rows = cut(signed(docs, size, id_col, text_col))
    groups = rows.filter("digest is not null and id is not null").groupBy("digest").agg(F.min(F.struct("id", "signature", "n_shingles")).alias("m"))
    nodes = cut(groups.select("digest", F.col("m.id").alias("id"), F.col("m.signature").alias("signature"), F.col("m.n_shingles").alias("n")))
    alone = nodes.select("id", "signature", "n", F.col("id").alias("component"))
    links = cut(_confirmed(_neighbours(alone, FIRST_TREES, percent), docs, FIRST_TREES, size, percent, id_col, text_col))
    of = _few(components(links).withColumnRenamed("component", "c"))
    labelled = cut(nodes.join(of, "id", "left").select("id", "signature", "n", F.coalesce("c", "id").alias("component")))
    links = links.unionByName(_confirmed(_regions(labelled, percent), docs, TREES, size, percent, id_col, text_col))
    # rows of one id with other texts are other nodes of the same id
    of = _few(components(links).withColumnRenamed("id", "node"))

    least = nodes.select("digest", F.col("id").alias("node")).join(of, "node", "left").select("digest", F.coalesce("component", "node").alias("least"))
    out = rows.select("id", "n_shingles", "digest").join(least, "digest", "left")
    component = F.coalesce("least", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
