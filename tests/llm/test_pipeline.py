"""The pipeline against a brute-force version of its stages, and the registered queries' contracts."""

import collections
import re
import zlib


import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from quadrille.llm import pii, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n):
    return " ".join("".join(r.choice(list("abcdefghij"), r.integers(3, 9))) for _ in range(n))


def corpus(spark):
    r = np.random.default_rng(11)
    menu, rows = "Shop Home About 7", []
    for i in range(40):
        rows.append((i, f"{menu}\n{sentence(r, 30)}\n{sentence(r, 25)}", "shop"))
    for i in range(40, 60):
        base = rows[int(r.integers(0, 20))][1].split(" ")
        base[12] = f"changed{i}"
        rows.append((i, " ".join(base), f"host{i % 4}"))
    rows += [(70, "too short", "shop"), (71, " ".join(["again and again we say"] * 9), "shop"), (72, None, None), (73, sentence(r, 40) + " call +1 (389) 555-5010 now", None), (74, sentence(r, 1500), "long"), (75, rows[3][1], "copy"), (None, sentence(r, 20), "shop")]
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], COLUMNS)


def normal(line):
    return re.sub(r"\s+", " ", re.sub(r"\d", "0", line.lower())).strip()


def brute_quality(rows):
    """A line goes if more than 10 different texts, and more than a twentieth of those, of its host have it; a text goes if it fails the base rule or keeps under 0.3 of its words."""
    having, of_host = collections.defaultdict(set), collections.defaultdict(set)
    for _, t, s in rows:
        of_host[s].add(t or "")
        for x in (t or "").split("\n"):
            if WORD.search(x):
                having[s, normal(x)].add(t)
    out = {}
    for i, t, s in rows:
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        left = "\n".join(x for x in (t or "").split("\n") if not (len(having[s, normal(x)]) > 10 and len(having[s, normal(x)]) > 0.05 * len(of_host[s])))
        if len(w) >= 10 and 100 * len(cover) <= 20 * len(w) and len(WORD.findall(left)) >= 0.3 * len(w):
            out[i] = left
    return out


def brute_dedup(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.lower().split()]}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)), key=lambda i: (i is None, i or 0))
                parent[y] = x
    return {i: t for i, t in texts.items() if root(i) == i}


def test_stages(spark, tmp_path):
    docs = corpus(spark)
    kept = brute_quality([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert 0 < len(kept) < docs.count()
    expected = brute_dedup(kept)
    assert len(expected) < len(kept)
    step, texts = docs, {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        step = stage(spark, step, "unused")
        step.write.parquet(str(tmp_path / str(k)))
        step = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert step.columns == docs.columns
            texts[k] = {r.doc_id: r.text for r in step.collect()}
            assert all(r.n_chars == len(r.text) for r in step.collect())
    assert texts[0] == kept and texts[1] == expected
    assert set(texts[2]) == set(expected) and {i for i in expected if texts[2][i] != expected[i]} == {73} and "555-5010" not in texts[2][73]
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(list)
    for r in step.collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(expected)
    for i, own in pieces.items():
        ids = np.array([*tk.encode(texts[2][i], add_special_tokens=False).ids, 0], "<u4")
        assert sorted((p.start, p.length, p.ids_crc32) for p in own) == [(p.start, p.length, zlib.crc32(ids[p.start : p.start + p.length].tobytes())) for p in sorted(own, key=lambda p: p.start)]
        assert sum(p.length for p in own) == len(ids)


def test_empty_documents_pass_through(spark):
    step = corpus(spark).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, "unused")
    assert step.count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(__spark_entry__.oracle_sql()) <= names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_near_dedup_by_rows(spark):
    a, b, c = (sentence(np.random.default_rng(k), 30) for k in range(3))
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, c), (None, None), (9, ""), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS)
    out = corpus_pipeline.near_dedup(spark, docs, "unused")
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter([(1, a), (5, b), (7, c), (None, None), (9, ""), (10, "")])
    assert out.columns == docs.columns


def test_pseudonyms_change_only_values(spark):
    df = corpus(spark)
    before, after = df.collect(), {r.doc_id: r.text for r in pii.pseudonymised(df, "k").collect()}
    assert [r.doc_id for r in before if after[r.doc_id] != r.text] == [73]
    assert pii.pseudonymised(df.withColumn("__n", F.lit(1)), "k").columns == [*df.columns, "__n"]
