"""Weighted undirected graphs as edge tables ``(src, dst, w)``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.sources.entities import shared_checkpoints

#: Vertices up to which a subgraph's spectrum is solved by a dense matrix.
DENSE = 1500

#: Numbers that a basis of Lanczos vectors holds.
BASIS = 20_000_000


def canonical(edges: DataFrame) -> DataFrame:
    """One row for each pair, the smaller end first; of parallel edges the heaviest."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("w").alias("w"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of canonical edges; a loop once."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("src", "dst", "w").unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, degree, strength)``: distinct neighbours and the sum of weights."""
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("degree"), F.sum("w").alias("strength"))


def laplacian(edges: DataFrame, normalised: bool) -> DataFrame:
    """Entries ``(row, col, value)`` of the combinatorial or the normalised Laplacian."""
    both = symmetric(edges.filter("src <> dst"))
    d = both.groupBy("src").agg(F.sum("w").alias("d"))
    if not normalised:
        return both.select(F.col("src").alias("row"), F.col("dst").alias("col"), (-F.col("w")).alias("value")).unionByName(d.select(F.col("src").alias("row"), F.col("src").alias("col"), F.col("d").alias("value")))
    ends = both.join(d.withColumnRenamed("d", "di"), "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("dj")), "dst")
    off = ends.select(F.col("src").alias("row"), F.col("dst").alias("col"), (-F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("value"))
    return off.unionByName(d.select(F.col("src").alias("row"), F.col("src").alias("col"), F.lit(1.0).alias("value")))


def dirichlet(edges: DataFrame, signal: DataFrame) -> DataFrame:
    """Energy of a signal ``(id, s)``: the sum of w (si - sj)^2 over edges."""
    a, b = signal.select(F.col("id").alias("src"), F.col("s").alias("si")), signal.select(F.col("id").alias("dst"), F.col("s").alias("sj"))
    return edges.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum(F.col("w") * F.pow(F.col("si") - F.col("sj"), 2)), F.lit(0.0)).alias("energy"))


def dirichlet_terms(edges: DataFrame, signal: DataFrame) -> DataFrame:
    """Each vertex's part of the energy, si (L s)i."""
    a, b = signal.select(F.col("id").alias("src"), F.col("s").alias("si")), signal.select(F.col("id").alias("dst"), F.col("s").alias("sj"))
    both = symmetric(edges.filter("src <> dst")).join(a, "src").join(b, "dst")
    return both.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("si") * (F.col("si") - F.col("sj"))).alias("term"))


def clustering(edges: DataFrame) -> DataFrame:
    """Clustering coefficient of each vertex: closed pairs of neighbours over all pairs.

    Edges point from the end of lower degree to the other, so a hub opens few pairs.
    """
    plain = edges.filter("src <> dst").select("src", "dst").distinct()
    deg = degrees(plain.withColumn("w", F.lit(1.0))).select("id", "degree")
    d = lambda c, n: deg.select(F.col("id").alias(c), F.col("degree").alias(n))
    e = plain.join(d("src", "ds"), "src").join(d("dst", "dd"), "dst")
    turn = (F.col("ds") > F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") > F.col("dst")))
    out = e.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("b"))
    wedges = out.alias("x").join(out.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b"))).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    closed = wedges.join(plain.select(F.least("src", "dst").alias("b"), F.greatest("src", "dst").alias("c")), ["b", "c"])
    triangles = closed.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    t = F.coalesce("t", F.lit(0))
    return deg.join(triangles, "id", "left").select("id", "degree", t.alias("triangles"), F.when(F.col("degree") > 1, 2 * t / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("coefficient"))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(id, component)``: labels fall to the least label of the neighbours and then jump to the label's label, until none falls."""
    shared_checkpoints(edges.sparkSession)
    both = symmetric(edges.withColumn("w", F.lit(1.0)).select("src", "dst", "w")).select("src", "dst").distinct().checkpoint()
    labels = vertices.select("id", F.col("id").alias("l")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "l"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("l").alias("m"))
        least = labels.join(near, "id", "left").select("id", "l", F.least("l", F.coalesce("m", "l")).alias("n"))
        jumped = least.join(least.select(F.col("id").alias("n"), F.col("n").alias("j")), "n", "left").select("id", "l", F.least("n", F.coalesce("j", "n")).alias("n")).checkpoint()
        labels = jumped.select("id", F.col("n").alias("l"))
        if jumped.filter("l <> n").isEmpty():
            break
    return labels.select("id", F.col("l").alias("component"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Newman's modularity of ``(id, community)``."""
    c = lambda a, b: communities.select(F.col("id").alias(a), F.col("community").alias(b))
    within = edges.join(c("src", "cs"), "src").join(c("dst", "cd"), "dst")
    total = within.agg(F.sum("w").alias("m"))
    inner = within.filter("cs = cd").groupBy(F.col("cs").alias("community")).agg(F.sum("w").alias("inside"))
    ends = within.select(F.explode(F.array(F.struct(F.col("cs").alias("community"), "w"), F.struct(F.col("cd").alias("community"), "w"))).alias("x")).groupBy("x.community").agg(F.sum("x.w").alias("ends"))
    parts = ends.join(inner, "community", "left").crossJoin(F.broadcast(total))
    return parts.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("ends") / (2 * F.col("m")), 2)).alias("modularity"))


def communities(edges: DataFrame, by: str = "subgraph") -> DataFrame:
    """Communities of each subgraph by Louvain's method: ``(by, id, community, modularity)``.

    Vertices move, in order, to the neighbouring community with the greatest gain, the lowest number among
    equals, until none moves; communities then become vertices, until a level changes nothing.
    A community's number is its smallest id.  A subgraph is worked on in one task.
    """

    def level(n: int, near: list[dict[int, float]], loops: np.ndarray) -> tuple[np.ndarray, bool]:
        strength = np.array([sum(x.values()) for x in near]) + 2 * loops
        double, total, own, moved = strength.sum(), strength.copy(), np.arange(n), False
        changed = double > 0
        while changed:
            changed = False
            for v in range(n):
                to: dict[int, float] = {own[v]: 0.0}
                for u, w in near[v].items():
                    to[own[u]] = to.get(own[u], 0.0) + w
                total[own[v]] -= strength[v]
                gain = {c: w - strength[v] * total[c] / double for c, w in to.items()}
                best = max(gain, key=lambda c: (gain[c], -c))
                if gain[best] <= gain[own[v]] + 1e-12:
                    best = own[v]
                total[best] += strength[v]
                if best != own[v]:
                    own[v], changed, moved = best, True, True
        return own, moved

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(pdf[["src", "dst"]].to_numpy(), return_inverse=True)
        heaviest: dict[tuple[int, int], float] = {}
        for (a, b), w in zip(np.sort(at.reshape(-1, 2), axis=1).tolist(), pdf["w"], strict=True):
            heaviest[a, b] = max(w, heaviest.get((a, b), 0.0))
        own, edges = np.arange(len(ids)), heaviest
        while True:
            n = int(own.max()) + 1
            near, loops = [{} for _ in range(n)], np.zeros(n)
            for (a, b), w in edges.items():
                if a == b:
                    loops[a] += w
                else:
                    near[a][b] = near[b][a] = w
            found, moved = level(n, near, loops)
            if not moved:
                break
            _, found = np.unique(found, return_inverse=True)
            own, merged = found[own], {}
            for (a, b), w in edges.items():
                key = tuple(sorted((int(found[a]), int(found[b]))))
                merged[key] = merged.get(key, 0.0) + w
            edges = merged
        whole = sum(heaviest.values())
        inside, ends = np.zeros(len(ids)), np.zeros(len(ids))
        for (a, b), w in heaviest.items():
            inside[own[a]] += w * (own[a] == own[b])
            ends[own[a]] += w
            ends[own[b]] += w
        q = float((inside / whole - (ends / (2 * whole)) ** 2).sum()) if whole else 0.0
        least = np.full(len(ids), ids.max())
        np.minimum.at(least, own, ids)
        return pd.DataFrame({by: pdf[by].iloc[0], "id": ids, "community": least[own], "modularity": q})

    kind = edges.schema[by].dataType.simpleString()
    return edges.groupBy(by).applyInPandas(solve, f"{by} {kind}, id long, community long, modularity double")


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of ``n`` vertices the least vertex that the links ``(a, b)`` connect it to."""
    least = np.arange(n)
    while len(a):
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]
        a, b = least[a], least[b]
        a, b = a[a != b], b[a != b]
    return least


def _largest(times: Callable[[np.ndarray], np.ndarray], n: int, k: int, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, of a symmetric operator on the vectors at right angles to ``held``, and the vectors as rows.

    Lanczos steps with all vectors kept orthogonal; a full basis starts anew from its best Ritz vectors, so it
    takes ``BASIS`` numbers at most, or three vectors for each one wanted.  One run finds an eigenvalue once:
    further runs beside what is found look for copies of it, until none is as large as the last one wanted.
    """
    r = np.random.default_rng(0)
    values, found = np.zeros(0), np.zeros((0, n))
    beside = np.array(held).reshape(len(held), n)

    def apart(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - beside.T @ (beside @ w) if len(beside) else w
            w = w - found.T @ (found @ w) if len(found) else w
        return w

    def run(want: int) -> tuple[np.ndarray, np.ndarray]:
        room = n - len(beside) - len(found)
        size = min(room, max(3 * want + 20, min(400, BASIS // n)))
        basis, t, kept = np.zeros((size, n)), np.zeros((size, size)), 0
        w = apart(r.standard_normal(n))
        basis[0] = w / np.linalg.norm(w)
        while True:
            for m in range(kept, size):
                w = apart(times(basis[m]))
                t[: m + 1, m] = t[m, : m + 1] = basis[: m + 1] @ w
                for _ in range(2):
                    w = w - basis[: m + 1].T @ (basis[: m + 1] @ w)
                w = apart(w)
                beta = np.linalg.norm(w)
                last = beta < 1e-12 or m + 1 == room
                if last or m + 1 == size or (m + 1) % 10 == 0:
                    x, y = np.linalg.eigh(t[: m + 1, : m + 1])
                    x, y = x[::-1], y[:, ::-1]
                    if last or (m + 1 > want and np.abs(beta * y[-1, :want]).max() < 1e-11):
                        return x[:want], y[:, :want].T @ basis[: m + 1]
                if m + 1 < size:
                    basis[m + 1] = w / beta
            kept = min(want + 8, size - 2)
            for c in range(0, n, 1 << 16):
                basis[:kept, c : c + (1 << 16)] = y[:, :kept].T @ basis[:, c : c + (1 << 16)]
            basis[kept] = w / beta
            t[:] = 0
            t[np.arange(kept), np.arange(kept)] = x[:kept]

    while len(beside) + len(found) < n:
        missing = max(1, k - len(found))
        x, v = run(missing)
        if len(values) >= k and x[0] <= values[k - 1] + 1e-9:
            break
        values, found = np.concatenate([values, x]), np.concatenate([found, v])
        order = np.argsort(-values, kind="stable")
        values, found = values[order], found[order]
    return values[:k], found[:k]


def spectrum(edges: DataFrame, k: int, by: str = "subgraph") -> DataFrame:
    """The ``k`` smallest non-trivial eigenvalues of the normalised Laplacian of each subgraph and the vertices' loadings.

    A subgraph is solved in one task, by connected components.  Each component has the eigenvalue 0 once, the largest
    come first, and the first is the trivial one; other eigenvalues are sought where 0 doesn't occur often enough.
    A component is solved by a dense matrix up to ``DENSE`` vertices, else by Lanczos steps over its edges: where it has
    two sides, on the smaller side alone.  A vector's largest part is made positive.
    """

    def dense(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, d: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        s = np.zeros((n, n))
        s[a, b] = s[b, a] = w / np.sqrt(d[a] * d[b])
        values, vectors = np.linalg.eigh(np.eye(n) - s)
        return values[1 : r + 1], vectors[:, 1 : r + 1].T

    def two_sided(side: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, d: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """By the singular values of the entries between the sides: s of them has the eigenvalues 1 - s and 1 + s."""
        few = side if 2 * side.sum() <= len(side) else ~side
        at = np.where(few, few.cumsum(), (~few).cumsum()) - 1
        x = w / np.sqrt(d[a] * d[b])
        i, j = at[np.where(few[a], a, b)], at[np.where(few[a], b, a)]
        small, large = int(few.sum()), int((~few).sum())
        over = lambda u: np.bincount(j, weights=x * u[i], minlength=large)
        back = lambda v: np.bincount(i, weights=x * v[j], minlength=small)
        first = np.sqrt(d / d.sum() * 2)
        _, u = _largest(lambda u: back(over(u)), small, min(r, small - 1), [first[few]])
        v = np.array([over(y) for y in u]).reshape(len(u), large)
        s = np.linalg.norm(v, axis=1)
        u, v, s = u[s > 1e-5], v[s > 1e-5], s[s > 1e-5]
        v = v / s[:, None]
        out = np.zeros((r, len(side)))
        out[: len(s), few], out[: len(s), ~few] = u / np.sqrt(2), v / np.sqrt(2)
        if len(s) < r:  # the larger side has vectors that the entries take to 0
            q = np.concatenate([first[~few][None], v, np.random.default_rng(0).standard_normal((r - len(s), large))])
            out[len(s) :, ~few] = np.linalg.qr(q.T)[0].T[len(s) + 1 :]
        return 1 - np.concatenate([s, np.zeros(r - len(s))]), out

    def wide(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, d: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        x = w / np.sqrt(d[a] * d[b])
        times = lambda y: np.bincount(a, weights=x * y[b], minlength=n) + np.bincount(b, weights=x * y[a], minlength=n)
        values, vectors = _largest(times, n, r, [np.sqrt(d / d.sum())])
        return 1 - values, vectors

    def solve(t: pa.Table) -> pa.Table:
        ends = np.concatenate([t[c].to_numpy() for c in ("src", "dst")]).astype("int64")
        ids, at = np.unique(ends, return_inverse=True)
        n, w = len(ids), t["w"].to_numpy().astype(float)
        a, b = np.minimum(*at.reshape(2, -1)), np.maximum(*at.reshape(2, -1))
        real = (a != b) & (w > 0)
        pairs, where = np.unique(a[real] * n + b[real], return_inverse=True)
        heaviest = np.zeros(len(pairs))
        np.maximum.at(heaviest, where, w[real])
        a, b, w = pairs // n, pairs % n, heaviest
        d = np.bincount(a, weights=w, minlength=n) + np.bincount(b, weights=w, minlength=n)
        # two copies of each vertex, linked crosswise: they fall apart where a component has two sides
        twice = _least(2 * n, np.concatenate([a, a + n]), np.concatenate([b + n, b]))
        root, even, side = np.minimum(twice[:n], twice[n:]), twice[:n] != twice[n:], twice[:n] > twice[n:]
        roots, sizes = np.unique(root, return_counts=True)
        roots = roots[np.lexsort((roots, -sizes))]
        k_, n_zero = min(k, n - 1), min(k + 1, len(roots))
        values, vectors = [0.0] * n_zero, np.zeros((k_ + 1, n))
        for c in range(n_zero):
            own = np.where(root == roots[c])[0]
            part = np.sqrt(d[own]) if len(own) > 1 else np.ones(1)
            vectors[c, own] = part / np.linalg.norm(part)
        found = []
        for c in roots if n_zero < k_ + 1 else []:
            own, e = np.where(root == c)[0], root[a] == c
            r = min(k_ + 1 - n_zero, len(own) - 1)
            if r:
                x, y = np.searchsorted(own, a[e]), np.searchsorted(own, b[e])
                if len(own) <= max(DENSE, 4 * k + 4):
                    more = dense(len(own), x, y, w[e], d[own], r)
                elif even[c]:
                    more = two_sided(side[own], x, y, w[e], d[own], r)
                else:
                    more = wide(len(own), x, y, w[e], d[own], r)
                found += [(float(v), own, z) for v, z in zip(*more, strict=True)]
        for value, own, z in sorted(found, key=lambda f: f[0])[: k_ + 1 - n_zero]:
            vectors[len(values), own] = z
            values.append(value)
        vectors = vectors[1:]
        if k_:
            vectors *= np.where(vectors[np.arange(k_), np.abs(vectors).argmax(1)] < 0, -1, 1)[:, None]
        return shown(t[by].slice(0, 1), ids, np.array(values[1:]).clip(0), vectors)

    def shown(key: pa.ChunkedArray, ids: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> pa.Table:
        out = []
        for c in range(0, len(ids), 1 << 14):
            part = ids[c : c + (1 << 14)]
            offsets = np.arange(len(part) + 1, dtype="int32") * len(values)
            loadings = np.ascontiguousarray(vectors[:, c : c + (1 << 14)].T).ravel()
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (np.tile(values, len(part)), loadings)]
            keys = pa.concat_arrays(key.chunks).take(pa.array(np.zeros(len(part), "int64")))
            out.append(pa.RecordBatch.from_arrays([keys, pa.array(part), *lists], [by, "id", "eigenvalues", "loadings"]))
        return pa.Table.from_batches(out)

    kind = edges.schema[by].dataType.simpleString()
    return edges.select(by, "src", "dst", "w").groupBy(by).applyInArrow(solve, f"{by} {kind}, id long, eigenvalues array<double>, loadings array<double>")


def heat_rank(loadings: DataFrame, anchor: DataFrame, t: float) -> DataFrame:
    """Heat-kernel scores from an anchor: the sum over k of exp(-t value_k) phi_k(anchor) phi_k(i)."""
    seed = anchor.select(F.zip_with("eigenvalues", "loadings", lambda v, p: F.exp(-t * v) * p).alias("weights"), F.col("id").alias("anchor"))
    scored = loadings.crossJoin(F.broadcast(seed.limit(1)))
    return scored.filter("id <> anchor").select("id", F.aggregate(F.zip_with("weights", "loadings", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("score"))
