"""Language-model scores of whole documents: a gated recurrent network over words.

Tokens are words (runs other than blanks, A-Z lower-cased) and one end for each document.
The network has one gated recurrent layer in numpy and a class-factored output: a softmax
over classes, and for a frequent word a softmax over the words of its class.  Frequent words are classed
by frequency; all others by a hash of their last two bytes, and within such a class the
probability is (c + 1) / (N + V + 1) of its own counts.  The last place stands for words not
seen, as in the base score, (c + 1) / (N + V + 1) over all counts.

Training covers every token of the training rows once, in rounds: rows are dealt to rounds by a
hash, every task trains on its rows by truncated backpropagation from the parameters of
the round before, and the tasks' parameters are averaged by their tokens.  Documents run in
lanes, one after another, and the state is carried over windows to the end of each.

The lexicon of the most frequent words is bounded in number and length and is broadcast.
Occurrences of all other words are joined with the table of counts, so scores use exact counts.
Texts are read twice: for the counts, and to write down what the lexicon reads of them, from
which the rounds learn and all rows are scored.  The parameters depend on how rows are dealt to
tasks; with the same partitions they are the same.

A row is held out when crc32 of its id's text leaves 2 modulo 7; a null id is a training
row.  Null and empty texts have the end alone.  Repeated rows count and score each.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import cut

END = b""
HIDDEN, EMBEDDED = 16, 8
#: Frequent words, words in one of their classes, classes of all other words.
HEAD, IN_CLASS, TAILS = 1024, 32, 32
HEADS = HEAD // IN_CLASS
#: The lexicon holds so many words of at most so many bytes each.
LEXICON, LONGEST = 400_000, 48
#: Steps of a window, lanes in training and in scoring, tokens of a buffer of documents.
WINDOW, LANES, SCORE_LANES, BUFFER = 32, 128, 256, 2_000_000
#: Tokens of one class whose softmax is taken together.
BUNCH = 32
#: Bytes of texts that are cut into words at once.
TEXTS = 12_000_000
#: Adagrad: the rate, and what its sums of squares start from.
RATE, SQUARES = 0.08, 3e-4
#: The share of rows that each round trains on, in eighths; together they are all rows.
ROUNDS = ((0,), (1, 2), (3, 4, 5, 6, 7))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``TEXTS`` bytes together."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXTS, "right")))
        yield at, stop
        at = stop


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after another, and how many each text has; A-Z lower-cased."""
    # taken, not sliced: the split loses words of an array that begins inside its buffers
    own = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(own, "")))
    flat, text = parts.flatten(), pc.list_parent_indices(parts)
    there = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(there).cast(pa.large_binary()), np.bincount(text.filter(there).to_numpy(), minlength=len(texts))


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def held_out(id_text):
    return F.coalesce(F.crc32(id_text.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word binary, n long)`` over the texts of ``docs``; the end is the empty word.

    A task sums what it reads before rows are moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, stop in slices(b.column(0)):
                words, _ = tokens(b.column(0).slice(at, stop - at))
                found = pc.value_counts(words)
                yield pa.record_batch([pa.concat_arrays([found.field("values").cast(pa.binary()), pa.array([END])]), pa.concat_arrays([found.field("counts"), pa.array([stop - at])])], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """The most frequent words with their counts, and the totals of all words and of each tail class."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, kinds: int, tail_total: np.ndarray, tail_kinds: np.ndarray):
        self.words, self.total, self.kinds = words, total, kinds
        self.end = words.index(END) if END in words else -1
        self.counts = counts
        n = len(words)
        self.head = min(HEAD, n)
        self.tail_log = np.log10(tail_total + tail_kinds + 1.0)
        self.tails = np.array([tail_class(w) for w in words], np.int32)
        order = np.arange(n)
        #: What the network reads for a word, and its class.
        self.symbol = np.where(order < self.head, order, HEAD + self.tails).astype(np.int16)
        self.base_log = math.log10(total + kinds + 1)
        self.base = np.log10(counts + 1.0) - self.base_log
        self.within = np.where(order < self.head, 0.0, np.log10(counts + 1.0) - self.tail_log[self.tails])
        share = np.zeros(HEADS + TAILS)
        np.add.at(share, order[: self.head] // IN_CLASS, counts[: self.head])
        share[HEADS:] = tail_total
        #: Logarithms of the frequencies of classes, and of frequent words within theirs.
        self.class_bias = np.log((share + 1.0) / (share + 1.0).sum())
        words_of = np.zeros(HEAD)
        words_of[: self.head] = counts[: self.head] + 1.0
        words_of = words_of.reshape(HEADS, IN_CLASS)
        self.word_bias = np.log(np.maximum(words_of / np.maximum(words_of.sum(1, keepdims=True), 1.0), 1e-12))

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """What it reads of texts, all their tokens with their ends one after another: how many each text has, places in the lexicon (-1 for none), symbols; and the words without a place, and how many each text has of them."""
        words, count = tokens(texts)
        n = count + 1
        last = np.cumsum(n) - 1
        at = np.full(int(n.sum()), -1, np.int32)
        inside = np.ones(len(at), bool)
        inside[last] = False
        place = pc.index_in(words, value_set=pa.array(self.words, pa.large_binary()))
        at[inside] = pc.fill_null(place, -1).to_numpy()
        at[last] = self.end
        symbols = self.symbol[at] if len(self.symbol) else np.zeros(len(at), np.int16)
        rare = np.flatnonzero(at < 0)
        others = words.filter(pc.is_null(place))
        listed = others.to_pylist() + [END] * (len(texts) if self.end < 0 else 0)
        symbols[rare[inside[rare]]] = HEAD + np.fromiter(map(tail_class, listed), np.int32, len(others))
        symbols[rare[~inside[rare]]] = HEAD + tail_class(END)
        text = np.repeat(np.arange(len(texts)), n)
        return n, at, symbols, others, np.bincount(text[rare[inside[rare]]], minlength=len(texts))


def lexicon(counts: DataFrame) -> Lexicon:
    """Totals are sums over the whole table; only the lexicon's words are sent to the driver.

    Words are counted by steps of their frequency, a sixteenth of a power of two each; the lexicon
    has all words of the highest steps that it can hold together.
    """
    tail = F.crc32(F.expr("substring(word, greatest(length(word) - 1, 1), 2)")) % TAILS
    short = counts.filter(F.length("word") <= LONGEST).withColumn("step", F.floor(16 * F.log2("n")).cast("int"))
    least, held = 1 << 30, 0
    for r in sorted(short.groupBy("step").agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r["step"]):
        held += r["v"]
        if held > LEXICON:
            break
        least = r["step"]
    rows = short.filter((F.col("step") >= least) | (F.length("word") == 0)).select("word", "n").toArrow()
    rows = rows.append_column("size", pc.binary_length(rows["word"])).sort_by([("n", "descending"), ("size", "ascending"), ("word", "ascending")])
    words = rows["word"].to_pylist()
    n = rows["n"].to_numpy().astype(np.float64)
    if END in words[HEAD:]:  # the end is always a frequent word
        k = words.index(END)
        words, n = [END, *words[:k], *words[k + 1 :]], np.concatenate([n[k : k + 1], n[:k], n[k + 1 :]])
    total, kinds = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.groupBy(tail.alias("t")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        total[r["t"]], kinds[r["t"]] = r["n"], r["v"]
    all_total, all_kinds = int(total.sum()), int(kinds.sum())
    for w, c in zip(words[:HEAD], n[:HEAD], strict=True):
        total[tail_class(w)] -= c
        kinds[tail_class(w)] -= 1
    return Lexicon(words, n, all_total, all_kinds, np.maximum(total, 0), np.maximum(kinds, 0))


def parameters(lex: Lexicon) -> dict[str, np.ndarray]:
    """The parameters before training, with Adagrad's sums: the network then gives the frequencies of classes and words."""
    r = np.random.default_rng(7)
    small = lambda *shape: (0.1 * r.standard_normal(shape)).astype(np.float32)
    p = {
        "embed": small(HEAD + TAILS, EMBEDDED),
        "in": small(EMBEDDED, 3 * HIDDEN),
        "in_bias": np.zeros(3 * HIDDEN, np.float32),
        "state": small(HIDDEN, 3 * HIDDEN),
        "class": small(HIDDEN, HEADS + TAILS),
        "class_bias": lex.class_bias.astype(np.float32),
        "word": small(HEADS, HIDDEN, IN_CLASS),
        "word_bias": lex.word_bias.astype(np.float32),
    }
    return p | {f"squares of {k}": np.full_like(v, SQUARES) for k, v in p.items()}


def table(p: dict[str, np.ndarray]) -> np.ndarray:
    """What each symbol adds to the gates."""
    return p["embed"] @ p["in"] + p["in_bias"]


def window(p: dict[str, np.ndarray], given: np.ndarray, read: np.ndarray, starts: np.ndarray, state: np.ndarray, target: np.ndarray, live: np.ndarray, grads: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """One window of ``read[steps, lanes]``: natural log-probabilities of ``target`` and the last state.

    ``given`` is the ``table`` of the parameters.  ``starts`` marks steps where a document begins: the
    state is 0 there.  Tokens that aren't ``live`` are padding.  With ``grads``, the gradients
    of the loss, over the tokens of a full window, are put there.
    """
    steps, lanes = read.shape
    n, h2 = steps * lanes, 2 * HIDDEN
    x = given[read]
    hs = np.empty((steps + 1, lanes, HIDDEN), np.float32)
    u = np.empty((steps, lanes, 3 * HIDDEN), np.float32)
    zr = np.empty((steps, lanes, h2), np.float32)
    new = np.empty((steps, lanes, HIDDEN), np.float32)
    before = np.empty((steps, lanes, HIDDEN), np.float32)
    keep = (~starts).astype(np.float32)[:, :, None]
    hs[0] = state
    for t in range(steps):
        h = np.multiply(hs[t], keep[t], out=before[t])
        np.matmul(h, p["state"], out=u[t])
        g, c = zr[t], new[t]
        np.add(x[t, :, :h2], u[t, :, :h2], out=g)
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        np.multiply(g[:, HIDDEN:], u[t, :, h2:], out=c)
        c += x[t, :, h2:]
        np.tanh(c, out=c)
        np.subtract(h, c, out=hs[t + 1])
        hs[t + 1] *= g[:, :HIDDEN]
        hs[t + 1] += c
    out = hs[1:].reshape(n, HIDDEN)
    wanted, ok = target.ravel().astype(np.intp), live.ravel()
    frequent = wanted < HEAD
    classes = np.where(frequent, wanted // IN_CLASS, HEADS + wanted - HEAD)
    logits = out @ p["class"] + p["class_bias"]  # states are within 1 and biases below 0, far from overflow
    np.exp(logits, out=logits)
    total = logits @ np.ones(HEADS + TAILS, np.float32)
    rows = np.arange(n)
    logp = np.log(np.maximum(logits[rows, classes] / total, 1e-30))
    if grads is not None:
        scale = np.float32(1 / (LANES * WINDOW))  # few lanes, and so a single long document, move little
        logits *= (ok * scale / total)[:, None]
        logits[rows, classes] -= ok * scale
        grads["class"] = out.T @ logits
        grads["class_bias"] = logits.sum(0)
        d_out = logits @ p["class"].T
        grads["word"], grads["word_bias"] = np.zeros_like(p["word"]), np.zeros_like(p["word_bias"])
    # frequent words in bunches of one class each, the last of a class filled up
    order = np.flatnonzero(frequent & ok)
    order = order[np.argsort(classes[order].astype(np.int16), kind="stable")]
    if len(order):
        own = classes[order]
        count = np.bincount(own, minlength=HEADS)
        bunches = -(-count // BUNCH)
        first = np.cumsum(bunches) - bunches
        slot = first[own] * BUNCH + np.arange(len(order)) - (np.cumsum(count) - count)[own]
        of = np.repeat(np.arange(HEADS), bunches)
        o = np.zeros((len(of) * BUNCH, HIDDEN), np.float32)
        o[slot] = out[order]
        o = o.reshape(len(of), BUNCH, HIDDEN)
        weight = p["word"][of]
        s = o @ weight
        s += p["word_bias"][of][:, None]
        np.exp(s, out=s)
        flat = s.reshape(-1, IN_CLASS)
        all_ = flat @ np.ones(IN_CLASS, np.float32)
        w = wanted[order] - own * IN_CLASS
        logp[order] += np.log(np.maximum(flat[slot, w] / all_[slot], 1e-30))
        if grads is not None:
            share = np.zeros(len(flat), np.float32)
            share[slot] = scale / all_[slot]
            flat *= share[:, None]
            flat[slot, w] -= scale
            there = np.flatnonzero(bunches)
            grads["word"][there] = np.add.reduceat(o.transpose(0, 2, 1) @ s, first[there], axis=0)
            grads["word_bias"][there] = np.add.reduceat(s.sum(1), first[there], axis=0)
            d_out[order] += (s @ weight.transpose(0, 2, 1)).reshape(-1, HIDDEN)[slot]
    if grads is not None:
        d_out = d_out.reshape(steps, lanes, HIDDEN)
        z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
        to_new = (1 - z) * (1 - new * new)
        to_z = (before - new) * z * (1 - z)
        to_r = u[:, :, h2:] * r * (1 - r)
        d_new = np.empty((steps, lanes, HIDDEN), np.float32)
        d_u = np.empty((steps, lanes, 3 * HIDDEN), np.float32)
        back = np.ascontiguousarray(p["state"].T)
        d = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            d += d_out[t]
            c, g = np.multiply(d, to_new[t], out=d_new[t]), d_u[t]
            np.multiply(d, to_z[t], out=g[:, :HIDDEN])
            np.multiply(c, to_r[t], out=g[:, HIDDEN:h2])
            np.multiply(c, r[t], out=g[:, h2:])
            d *= z[t]
            d += g @ back
            d *= keep[t]
        grads["state"] = before.reshape(n, HIDDEN).T @ d_u.reshape(n, 3 * HIDDEN)
        d_u[:, :, h2:] = d_new
        flat = d_u.reshape(n, 3 * HIDDEN)
        # gradients of each symbol's row of the table, and from there those of its factors
        ids = read.ravel()
        by = np.argsort(ids, kind="stable")
        ids = ids[by]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        rows_of = np.add.reduceat(flat[by], first, axis=0)
        there = ids[first]
        grads["in"] = p["embed"][there].T @ rows_of
        grads["in_bias"] = rows_of.sum(0)
        grads["embed"] = np.zeros_like(p["embed"])
        grads["embed"][there] = rows_of @ p["in"].T
    return logp.reshape(steps, lanes), hs[steps].copy()


def laned(docs: list[np.ndarray], lanes: int, late: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Documents one after another in lanes: symbols, number of the document (-1: padding), starts, all [steps, lanes], and the lanes' lengths, descending.

    All lanes begin together, or, ``late``, end together.
    """
    sizes = [len(d) for d in docs]
    heap = [(0, k) for k in range(max(1, min(lanes, len(docs))))]
    place: list[list[tuple[int, int]]] = [[] for _ in heap]
    for i in sorted(range(len(docs)), key=lambda i: -sizes[i]):
        used, k = heapq.heappop(heap)
        place[k].append((i, used))
        heapq.heappush(heap, (used + sizes[i], k))
    heap.sort(key=lambda x: (-x[0], x[1]))
    ends = [used for used, _ in heap]
    symbols = np.zeros((len(ends), ends[0]), np.int16)
    number = np.full(symbols.shape, -1, np.int32)
    starts = np.zeros(symbols.shape, bool)
    for lane, (_, k) in enumerate(heap):
        late_by = ends[0] - ends[lane] if late else 0
        for i, at in ((i, at + late_by) for i, at in place[k]):
            symbols[lane, at : at + sizes[i]] = docs[i]
            number[lane, at : at + sizes[i]] = i
            starts[lane, at] = True
    return symbols.T, number.T, starts.T, ends


def windows(p: dict[str, np.ndarray], docs: list[np.ndarray], lanes: int, learn=None) -> np.ndarray:
    """Natural log-probability of each document; ``learn`` takes the gradients of each window.

    A step reads the token before its target, and the end token where a document begins.
    Windows have the lanes that run there.  In training all lanes end together, so that
    the last steps learn from many documents and not from the longest.
    """
    symbols, number, starts, ends = laned(docs, lanes, late=learn is not None)
    read = np.zeros_like(symbols)
    read[1:] = symbols[:-1]
    read[starts] = docs[0][-1]
    total = np.zeros(len(docs) + 1)
    state = np.zeros((len(ends), HIDDEN), np.float32)
    given = table(p)
    for at in range(0, len(symbols), WINDOW):
        on = sum(e > ends[0] - at - WINDOW if learn else e > at for e in ends)
        now = (slice(at, at + WINDOW), slice(on))
        live = number[now] >= 0
        grads: dict[str, np.ndarray] | None = {} if learn else None
        logp, state[:on] = window(p, given, read[now], starts[now], state[:on], symbols[now], live, grads)
        if learn:
            learn(grads)
            given = table(p)
        total += np.bincount(number[now].ravel() + 1, weights=np.where(live, logp, 0).ravel(), minlength=len(docs) + 1)
    return total[1:]


def buffers(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[np.ndarray], list[pa.RecordBatch]]]:
    """The symbols of documents, in buffers of about ``BUFFER`` tokens, with the slices of rows they come from."""
    docs, slices, held = [], [], 0
    for b in batches:
        at = 0
        for k, x in enumerate(b.column(column)):
            docs.append(np.frombuffer(x.as_buffer(), np.int16))
            held += len(docs[-1])
            if held >= BUFFER:
                yield docs, [*slices, b.slice(at, k + 1 - at)]
                docs, slices, held, at = [], [], 0, k + 1
        if at < b.num_rows:
            slices.append(b.slice(at))
    if docs:
        yield docs, slices


def trained(symbols: DataFrame, start: dict[str, np.ndarray], sc) -> dict[str, np.ndarray]:
    """One round: parameters trained on the documents of ``symbols`` in every task from ``start``, averaged by tokens."""
    shared = sc.broadcast(start)
    names, blocks = list(start), 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = {k: v.copy() for k, v in shared.value.items()}
        seen = 0

        def learn(grads: dict[str, np.ndarray]) -> None:
            norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            small = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            for k, g in grads.items():
                g *= small
                squares = p[f"squares of {k}"]
                squares += g * g
                p[k] -= np.float32(RATE) * g / np.sqrt(squares)

        for docs, _ in buffers(batches, 0):
            windows(p, docs, LANES, learn)
            seen += sum(map(len, docs))
        if seen:
            flat = np.concatenate([p[k].ravel() for k in names]).astype(np.float64)
            parts = np.array_split(flat, blocks)
            yield pa.record_batch([pa.array(range(blocks), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * blocks, pa.int32()), pa.array([float(seen)] * blocks), pa.array([x.tolist() for x in parts], pa.list_(pa.float64()))], ["block", "part", "weight", "values"])

    def mean(table: pa.Table) -> pa.Table:
        weights = table["weight"].to_numpy()
        values = (weights[:, None] * np.array(table["values"].to_pylist())).sum(0) / weights.sum()
        return pa.table([table["block"][:1].combine_chunks(), pa.array([0], pa.int32()), pa.array([float(weights.sum())]), pa.array([values.tolist()], pa.list_(pa.float64()))], ["block", "part", "weight", "values"])

    schema = "block int, part int, weight double, values array<double>"
    each = symbols.select("symbols").mapInArrow(run, schema)
    got = each.groupBy("block", "part").applyInArrow(mean, schema).groupBy("block").applyInArrow(mean, schema).collect()
    shared.unpersist()
    if not got:
        return start
    flat = np.concatenate([np.array(r["values"]) for r in sorted(got, key=lambda r: r["block"])])
    out, at = {}, 0
    for k in names:
        out[k] = flat[at : at + start[k].size].reshape(start[k].shape).astype(np.float32)
        at += start[k].size
    return out


def read(rows: DataFrame, lex_b) -> DataFrame:
    """What the lexicon reads of ``(id, text, out, turn)``: symbols of all tokens, sums over the words that it holds, and the other words.

    ``base`` is complete but for the other words' counts; ``within`` is the part of the score that lies
    within the classes of other words, complete but for their counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lex_b.value
        key = TaskContext.get().partitionId() << 36
        for whole in batches:
            for low, stop in slices(whole.column(1)):
                b = whole.slice(low, stop - low)
                n, at, symbols, others, rare = lex.read(b.column(1))
                upto = np.cumsum(n)
                text = np.repeat(np.arange(len(n)), n)
                known = at >= 0
                sums = lambda x: np.bincount(text, weights=x, minlength=len(n))
                base = sums(np.where(known, lex.base[at], -lex.base_log) if len(lex.words) else np.full(len(at), -lex.base_log))
                within = sums(np.where(known, lex.within[at], -lex.tail_log[np.maximum(symbols - HEAD, 0)]) if len(lex.words) else -lex.tail_log[symbols - HEAD])
                kept = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], 2 * upto]).astype(np.int32)), pa.py_buffer(symbols.astype(np.int16))])
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)]).astype(np.int32)), others.cast(pa.binary()))
                keys = np.arange(key, key + len(n))
                key += len(n)
                columns = [pa.array(keys), b.column(0), *(b.column(k) for k in (2, 3)), kept, pa.array(n.astype(np.int64)), pa.array(sums(known).astype(np.int64) if lex.total else np.zeros(len(n), np.int64)), pa.array(base), pa.array(within), words]
                yield pa.record_batch(columns, ["key", "id", "out", "turn", "symbols", "n", "known", "base", "within", "rare"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "out", "turn").mapInArrow(run, f"key long, id {kind}, out boolean, turn int, symbols binary, n long, known long, base double, within double, rare array<binary>")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row for each row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    turn = F.pmod(F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit("round")), F.lit(8)).cast("int")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), held_out(docs[id_col]).alias("out"), turn.alias("turn"))
    counts = cut(word_counts(rows.filter(~F.col("out"))))
    lex = lexicon(counts)
    lex_b = sc.broadcast(lex)
    texts = cut(read(rows, lex_b))
    p = parameters(lex)
    for dealt in ROUNDS:
        p = trained(texts.filter(~F.col("out") & F.col("turn").isin(*dealt)), p, sc)
    shared = sc.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for symbols, slices in buffers(batches, 1):
            logs = windows(p, symbols, SCORE_LANES) / math.log(10)
            kept = [pa.concat_arrays([s.column(k) for s in slices]) for k in (0, 2, 3, 4, 5, 6)]
            yield pa.record_batch([*kept, pa.array(logs)], ["key", "id", "out", "n", "known", "sums", "log"])

    kind = rows.schema["id"].dataType.simpleString()
    first = texts.select("key", "symbols", "id", "out", "n", "known", F.struct("base", "within").alias("sums"))
    first = first.mapInArrow(run, f"key long, id {kind}, out boolean, n long, known long, sums struct<base:double,within:double>, log double")
    rare = texts.select("key", F.explode("rare").alias("word"))
    more = rare.join(counts, "word").groupBy("key").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count(F.lit(1)).alias("found"))
    done = first.join(more, "key", "left")
    more = F.coalesce("more", F.lit(0.0))
    return done.select(F.col("id").alias(id_col), F.col("out").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("sums.base") + more).alias("base_score"), (F.col("log") + F.col("sums.within") + more).alias("score"))
