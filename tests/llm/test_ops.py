"""Operators of the llm subpackage against brute force, libraries and edge cases."""

import collections
import hashlib
import math
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from quadrille.llm import bpe, chat, fingerprint, licenses, near_dup, packing, pii, quality, recurrent_lm, unigram
from quadrille.llm.components import components

BPE, RANKS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n", "a  b", "  x \n\n y  ", "it's  I'll\t\tgo\r\n ", "<|endoftext|>hi <|endoftext|> <|endoftext|>", "é 　ü 日本語テキスト 12345 !!!\x1c!! a\x1c b", "\x85 x y  ​z", "👩‍👩‍👧 " * 50, "x" * 5000, "a\x00b﻿", "Ⅷ½ ² ３ a", "'s 'S ''ll", "▁a ▁▁b"]
#: Clashing names of extra columns: those that the operators use inside.
EXTRA = ["id", "key", "wide", "n", "lines", "component", "found", "out"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def prose(n, seed, vocabulary=400):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abcdefgéß"), r.integers(2, 8))) for _ in range(vocabulary)]
    return " ".join(words[min(int(k), vocabulary - 1)] for k in r.zipf(1.4, n) - 1)


def frame(spark, rows):
    """Documents with nulls allowed everywhere and extra columns of clashing names."""
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for k, c in enumerate(EXTRA):
        df = df.withColumn(c, F.lit(k))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(60 + 13 * i, i), f"s{i % 3}") for i in range(12)]
    rows += [(100 + k, t, None) for k, t in enumerate(ODD)]
    rows += [(200, prose(20_000, 99, 3000), "s0"), (201, None, "s1"), (202, None, None), (None, prose(50, 7), "s1"), (None, None, None)]
    rows += [(300, prose(60, 0), "s0"), (300, prose(60, 0), "s0")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return docs.filter("false")


def got(df):
    return [r.asDict() for r in df.collect()]


def test_bpe_is_the_librarys(spark, docs, empty):
    tk = Tokenizer.from_file(BPE)
    v = bpe.vocabulary(BPE)
    for t in [*ODD, prose(300, 1)]:
        ids = tk.encode(t, add_special_tokens=False).ids
        assert v.encode(t) == ids and v.decode(ids) == tk.decode(ids, skip_special_tokens=False)
    texts = collections.Counter((r.doc_id, len(tk.encode(r.text or "", add_special_tokens=False).ids), sha(",".join(map(str, tk.encode(r.text or "", add_special_tokens=False).ids))), sha(r.text or "")) for r in docs.collect())
    assert collections.Counter(tuple(r) for r in bpe.round_trips(docs, BPE).collect()) == texts
    assert bpe.round_trips(empty, BPE).count() == 0
    back = bpe.decode_column(bpe.encode_column(docs.filter("doc_id < 200"), BPE), BPE)
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in docs.filter("doc_id < 200").collect()}


@pytest.mark.parametrize("max_open", [3, 512])
def test_packing(spark, docs, empty, max_open):
    tk = Tokenizer.from_file(BPE)
    rows = packing.pack(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), BPE, RANKS, capacity=256, max_open=max_open).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for key, g in rows.sort_values("start").groupby("doc_id"):
        ids = np.array([*tk.encode(texts.pop(key), add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not texts
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        at = 0
        for r in g.itertuples():
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack(empty, BPE, RANKS).count() == 0 and packing.pack(docs, BPE).count() > 0


def test_packing_level_rule():
    p = packing.SumOfSquares(8)
    for size in (5, 5, 3):
        assert list(p.add(packing.Piece(0, 0, b"\0\0\0\0" * size, size))) == [] or size == 3
    # 3 goes where it lowers the sum of squares: into a window at level 5
    assert p.open[5] == 1 and p.open[3] == 0
    assert packing.tokenizer(BPE, RANKS)(" " * 1_500_000) == packing.tokenizer(BPE)(" " * 1_500_000)


def test_unigram_is_the_librarys(spark, docs, empty):
    pieces = unigram.vocabulary(PIECES)
    tk = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    tk.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)

    def count(t):
        e = tk.encode(t, add_special_tokens=False)
        return sum(1 if i else len(t[a:b].encode()) for i, (a, b) in zip(e.ids, e.offsets, strict=True))

    m = unigram.model(PIECES)
    assert any("▁" in piece[1:] for piece, _ in pieces)  # runs of blanks have pieces of their own
    for t in [*ODD, prose(500, 2), "a   b" + " " * 40 + "c\n        return x", " " * 17]:
        if not t.startswith("▁"):
            assert m.text(t)[0] == count(t), t[:30]
    ties = unigram.Unigram([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0)])
    # equal scores: the longest piece that ends there stays
    assert ties.text("aa") == (2, -3.0)
    assert unigram.counted(docs, PIECES).count() == docs.count() and unigram.counted(empty, PIECES).count() == 0
    assert {r.n_tokens for r in unigram.counted(docs.filter("text is null or text = ''"), PIECES).collect()} == {0}


def near_brute(rows, size, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, empty, size):
    r = np.random.default_rng(4)
    rows = [(i, prose(80, i, 2000)) for i in range(15)]
    for i in range(60):  # a chain of copies of one text, each with some words changed
        words = rows[r.integers(0, len(rows))][1].split()
        for _ in range(r.integers(0, 7)):
            words[r.integers(0, len(words))] = f"w{r.integers(0, 10**9)}"
        rows.append((1000 + i, " ".join(words).upper() if i % 5 == 0 else "\t".join(words)))
    rows += [(2000, "one"), (2001, "ONE"), (2002, None), (2003, " \n"), (2004, "a b c"), (2005, "A b\tc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(1)).withColumn("id", F.lit("x"))
    out = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dup.near_duplicates(df, size=size).collect()}
    lower = [(i, t and "".join(c.lower() if c.isascii() else c for c in t)) for i, t in rows]
    assert out == near_brute(lower, size, 80)
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_nulls_and_repeats(spark, docs):
    out = got(near_dup.near_duplicates(docs, size=2))
    assert len(out) == docs.count()
    assert all(r["component_id"] is None and not r["kept"] for r in out if r["doc_id"] is None)
    assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] == 300] == [(0, False)] * 2  # the text of document 0


def test_near_duplicates_in_a_dense_region(spark):
    # texts on one template (similarity 0.74), each twentieth with a partner at 0.82: no window may hide it
    n, common = 1500, " ".join(f"c{k}" for k in range(85))
    own = lambda i: [f"o{i}x{k}" for k in range(15)]
    rows = [(i, " ".join([common, *own(i)])) for i in range(n)]
    rows += [(n + i, " ".join([common, *own(i)[:5], *own(n + i)[:10]])) for i in range(0, n, 20)]
    out = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1).collect()}
    assert out == {i: i if i < n else i - n for i, _ in rows}


def test_near_duplicates_in_blocks(spark):
    """Small blocks, deep regions and components of many steps give the same components."""
    r = np.random.default_rng(6)
    base = [f"c{k}" for k in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in r.choice(60, r.integers(0, 14), replace=False):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near_dup.signed(docs, 1, "doc_id", "text").selectExpr("id", "signature", "n_shingles as n", "id as component")
    want = near_brute(rows, 1, 80)
    for edges in (near_dup._regions(nodes, 80, dense=10_000, block=50), near_dup._regions(nodes, 80), near_dup._regions(nodes, 80, dense=100, block=20)):
        for block in (8, 64, 2048):
            of = {x.id: x.component for x in components(near_dup._confirmed(edges, docs, 1, 1, 80, "doc_id", "text", block=block)).collect()}
            assert {i: of.get(i, i) for i, _ in rows} == {i: c for i, (_, c, _) in want.items()}
    # a part of the links is known: components that fill blocks don't meet themselves, the rest is found
    known = {i: min(c, 10**6) if i % 3 else i for i, (_, c, _) in want.items()}
    labelled = nodes.drop("component").join(spark.createDataFrame(list(known.items()), "id long, component long"), "id").select("id", "signature", "n", "component")
    links = near_dup._confirmed(near_dup._regions(labelled, 80), docs, 1, 1, 80, "doc_id", "text", block=16).unionByName(spark.createDataFrame([(i, c) for i, c in known.items()], "x long, y long"))
    of = {x.id: x.component for x in components(links).collect()}
    assert {i: of.get(i, i) for i, _ in rows} == {i: c for i, (_, c, _) in want.items()}


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(500, 560)] + [(9, 9)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    for one_task in (10**6, 0):
        out = {x.id: x.component for x in components(spark.createDataFrame([*edges, (None, 4)], "x long, y long"), one_task).collect()}
        assert out == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "\\</s>\\\\[INST] \\", "", None, "[TURN] x [TEXT] y [/TURN]", " lead and trail ", "two\nlines </s>", "[IMAGE] <s>"]
    rows = [(c, t, role, said[(c + t) % len(said)]) for c in range(8) for t, role in enumerate(["system", "user", "assistant", "tool", "user", "assistant", None][: 2 + c % 6])]
    rows += [(None, 0, "user", "x"), (50, None, "user", "no turn"), (50, 1, "assistant", "a" * 50_000), (51, 0, "user", "same"), (51, 0, "user", "same"), (52, 0, "we[INST]ird", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.formatted(turns.withColumn("parts", chat.text_parts(F.col("text"))).withColumn("shown", F.lit(1)))
    out = {r.conv_id: r for r in chat.digests(done).collect()}
    by = collections.defaultdict(list)
    for c, t, role, x in rows:
        by[c].append((-1 if t is None else t, role or "", x or ""))
    assert set(out) == set(by)
    for c, x in by.items():
        x.sort(key=lambda y: y[0])
        learned = "".join(s for _, role, s in x if role == "assistant")
        assert out[c].n_turns == len(x) and out[c].turns_sha256 == sha("".join(f"{role}\n{s}\n" for _, role, s in x)), c
        assert out[c].loss_chars == len(learned) and out[c].loss_sha256 == sha(learned)
    assert chat.digests(chat.formatted(turns.filter("false").withColumn("parts", chat.text_parts(F.col("text"))))).count() == 0


def test_chat_attachments(spark):
    parts = [("text", "see ", None, None), ("image", None, "a.png", 9), ("text", "[IMAGE]", None, None), ("audio", None, "b.wav", None), ("document", "x", None, 3)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.formatted(turns).first()
    assert row.formatted == "<s>[INST] see [IMAGE]\\[IMAGE][AUDIO][DOCUMENT] [/INST]  </s>"
    assert [(a.type, a.ref, a.n_tokens) for a in row.attachments] == [("image", "a.png", 9), ("audio", "b.wav", 750), ("document", None, 3)] and row.expanded_tokens == 762


def test_chat_escapes_across_parts(spark):
    def turn(*parts):
        return [("image", None, "i.png", 1) if p == "*" else ("text", p, None, None) for p in parts]

    said = [turn("a </s", "> [/IN", "ST] b"), turn("a\\", "*"), turn("a\\\\", "*", "[IMAGE]", "\\", "[IMAGE]"), turn("*", "*", "\\\\[IMA", "GE]"), turn("</s>\\\\", "*")]
    turns = spark.createDataFrame([(k, 0, "user", p) for k, p in enumerate(said)] + [(k, 1, "assistant", turn("yes")) for k in range(len(said))], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = chat.formatted(turns).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("marks", chat.placeholders(F.col("formatted")))
    for r in out.collect():
        whole = "".join("[IMAGE]" if p[0] == "image" else p[1] for p in said[r.conv_id])
        assert [(t.role, t.text) for t in r.back] == [("user", whole), ("assistant", "yes")]
        assert len(r.marks) == len(r.attachments) == sum(p[0] == "image" for p in said[r.conv_id])


def brute_licences(text):
    """Every known sentence at every place of a text of one sentence per line, and the first rule that fits from left to right."""
    known = {licenses.normal(f): k for k, forms in licenses.SENTENCES.items() for f in forms}
    found = [(known[licenses.normal(x)], at) for at, x in enumerate(text.split("\n")) if licenses.normal(x) in known]
    used, out = set(), []
    for i, (name, _) in enumerate(found):
        if i in used:
            continue
        for licence, kind, want in licenses.RULES:
            places = [i] if want[0] == name else None
            for w in want[1:] if places else []:
                at = found[places[-1]][1]
                nxt = next((j for j in range(places[-1] + 1, min(len(found), places[-1] + 5)) if j not in used and found[j][0] == w and found[j][1] - at <= 4), None)
                places = None if nxt is None else [*places, nxt]
                if not places:
                    break
            if places:
                used.update(places)
                out.append((licence, kind))
                break
    return out


def test_licences_by_brute_force(spark):
    r = np.random.default_rng(5)
    plain = [(k, f) for k, forms in licenses.SENTENCES.items() for f in forms if not licenses.STOP.search(f)]
    texts = []
    for _ in range(300):
        lines = []
        while len(lines) < 25:
            name = licenses.RULES[r.integers(len(licenses.RULES))][2]
            for want in name:
                forms = [f for k, f in plain if k == want]
                if forms and r.random() < 0.95:
                    lines.append(forms[r.integers(len(forms))])
                lines += ["some other words about a licence"] * int(r.integers(0, 5) if r.random() < 0.3 else 0)
        texts.append(lines)
    df = spark.createDataFrame([(i, ".\n".join(x) + ".") for i, x in enumerate(texts)] + [(0, ".\n".join(texts[0]) + ".")], "doc_id long, text string")
    out = collections.defaultdict(list)
    for row in licenses.scanned(df).collect():
        out[row.doc_id].append(list(zip(row.licenses, row.kinds, strict=True)))
    for i, lines in enumerate(texts):
        assert all(x == brute_licences("\n".join(lines)) for x in out[i]) and len(out[i]) == 1 + (i == 0), lines


def test_licences_of_a_long_text_without_stops():
    known = licenses.rules(3)
    assert len(known.matched(known.recognised("The MIT License\n" * 60_000))) == 60_000


def canon(x):
    return " ".join(re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).casefold()).split())


def test_fingerprints(spark, docs, empty):
    texts = ["Ａbc  def", "abc DEF ", "ﬁne", "FINE", "Straße", "STRASSE", "é", "é", "x", None, ""]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    out = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (out[i] == out[j]) == (canon(a or "") == canon(b or "")), (a, b)
    assert fingerprint.fingerprints(empty).count() == 0 and fingerprint.with_edited(empty).count() == 0
    whole = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in whole.collect()), reverse=True)
    edited = {r.doc_id: r for r in fingerprint.with_edited(whole).collect()}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert edited[i].n_chars == len(t) and edited[i].edited_sha256 == sha(e) and edited[i].near_edited == (canon(t) == canon(e)) and edited[i].near_next == (canon(t) == canon(nxt))
    assert fingerprint.with_edited(docs).count() == docs.count()
    assert fingerprint.with_edited(whole.limit(1)).count() == 1


def test_fingerprints_compare_bytes(spark, monkeypatch):
    """With a digest that always collides, texts that differ still have other fingerprints."""
    monkeypatch.setattr(fingerprint, "digest", lambda c: F.lit("0" * 32))
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "B"), (4, "c")], "doc_id long, text string")
    out = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    assert out[2] == "0" * 32 and out[1] == out[3] and len({out[1], out[2], out[4]}) == 3


def test_licenses(spark, docs, empty):
    mit = "\n".join(["MIT License", "", "Copyright (c) 2020 X", "", *[licenses.SENTENCES[k][0].replace(", ", ",\n", 2) + "." for k in ("mit-grant", "mit-notice", "mit-warranty")]])
    df = spark.createDataFrame([(1, mit), (2, "words\nReleased under the MIT License.\nmore"), (3, "LICENSED UNDER CC BY-NC 4.0.### Licensed under the Apache License, Version 2.0."), (4, "the license is good"), (5, None), (6, "All rights reserved")], "doc_id long, text string")
    out = {r.doc_id: list(zip(r.licenses, r.kinds, strict=True)) for r in licenses.scanned(df).collect()}
    assert out == {1: [("MIT", "text")], 2: [("MIT", "reference")], 3: [("CC-BY-NC-4.0", "reference"), ("Apache-2.0", "reference")], 4: [], 5: [], 6: [("LicenseRef-all-rights-reserved", "reference")]}
    for form in (f for forms in licenses.SENTENCES.values() for f in forms):
        assert any(a in form.lower() for a in licenses.ANCHORS), form
    assert licenses.scanned(docs).count() == docs.count() and licenses.scanned(empty).count() == 0


def test_licenses_with_stops_inside():
    known = licenses.rules(3)
    find = lambda t: [licenses.RULES[k][0] for k in known.matched(known.recognised(t))]
    for tag, licence in {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-2.0-or-later": "GPL-2.0", "BSD-3-Clause": "BSD-3-Clause", "CC0-1.0": "CC0-1.0"}.items():
        assert find(f"words\n// SPDX-License-Identifier: {tag}\nmore words") == [licence]
    assert find("SPDX-License-Identifier: NCSA") == []
    for name, licence in (("gpl2-notice", "GPL-2.0-or-later"), ("gpl3-notice", "GPL-3.0-or-later")):
        for form in licenses.SENTENCES[name]:
            assert find(f"{form}.") == find("a b.\n" + form.replace(" the ", "\nthe ") + ".\n") == [licence], form
            assert find(form.replace("; ", ": ") + ". " + licenses.SENTENCES["gpl-warranty"][0] + ". " + licenses.SENTENCES["gpl-received"][0] + ".") == [licence]
    with pytest.raises(ValueError):
        licenses.Rules({"a": ["Some licence"], "b": ["some LICENCE."]}, [], 3)


def test_quality_base(spark, docs, empty):
    rows = got(quality.judged(docs))
    assert len(rows) == docs.count()
    for r in rows:
        t = r["text"] or ""
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        b = r["base"]
        assert (b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
    assert quality.judged(empty).count() == 0 and quality.filtered(docs).columns == docs.columns


def test_quality_lines(spark):
    menu, rows = "Home Products About 12", []
    for i in range(60):
        rows.append((i, f"{menu}\n{prose(40, i)}\n  HOME  products about 99", "shop"))
    rows += [(100, f"{menu}\na b c d e f g h i j", "other"), (101, f"{menu}\nonly these", "shop"), (102, f"{menu}\n" + prose(30, 500), None)]
    rows += [(200 + k, prose(50, 900), "copies") for k in range(50)]
    out = {r["doc_id"]: r for r in got(quality.judged(frame(spark, rows)))}
    assert all(len(out[i]["removed"]) == 1 and out[i]["kept"] == (not out[i]["base_failed"]) and out[i]["words_left"] == 40 for i in range(60))
    assert not out[101]["kept"] and not out[100]["removed"] and not out[102]["removed"]
    assert all(out[200 + k]["kept"] and not out[200 + k]["removed"] for k in range(50))  # copies count as one
    kept = {r["doc_id"]: r for r in got(quality.filtered(frame(spark, rows)))}
    assert not out[3]["base_failed"] and kept[3]["text"] == prose(40, 3) and kept[3]["n_chars"] == len(kept[3]["text"]) and 101 not in kept


def test_quality_keeps_clashing_names_and_joins(spark):
    rows = [(i, f"menu of the shop\n{prose(40, i)}", "shop") for i in range(30)] + [(50, None, None), (51, "", "shop"), (52, prose(30_000, 3), "shop")]
    df = frame(spark, rows).withColumn("base", F.lit("b")).withColumn("kept", F.lit(7)).withColumn("removed", F.create_map(F.lit("x"), F.lit(1)))
    out = quality.filtered(df)
    assert out.columns == df.columns and {(r.base, r.kept, r.removed["x"]) for r in out.collect()} == {("b", 7, 1)}
    same = lambda d: sorted((r.doc_id, r.text) for r in d.collect())
    assert same(out) == same(quality.filtered(df, max_broadcast=0))
    assert not any("menu of" in t for _, t in same(out))


def test_quality_counts_documents(spark):
    # a shared notice in the middle of documents that differ, and copies that must not dilute the share
    notice = "this notice stands in every document of the host and says the same in each of them"
    rows = [(i, f"{prose(6, i)}\n{notice}\n{prose(5, 500 + i)}", "shop") for i in range(60)]
    rows += [(1000 + k, prose(50, 900), "shop") for k in range(1500)]
    out = {r["doc_id"]: r for r in got(quality.judged(frame(spark, rows)))}
    assert all(len(out[i]["removed"]) == 1 and out[i]["words_left"] == 11 for i in range(60))
    assert not any(out[1000 + k]["removed"] for k in range(1500))


def test_language_model(spark, docs, empty):
    rows = got(recurrent_lm.scored(docs))
    assert len(rows) == docs.count()
    count = collections.Counter()
    outside = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    lower = lambda t: [*(t or "").encode().lower().split(), b""]
    for r in docs.collect():
        if not outside(r.doc_id):
            count.update(lower(r.text))
    total, kinds = sum(count.values()), len(count)
    want = collections.Counter()
    for r in docs.collect():
        w = lower(r.text)
        want[(r.doc_id, outside(r.doc_id), len(w), sum(x in count for x in w), total, round(sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w), 5))] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert recurrent_lm.scored(empty).count() == 0


def test_language_model_learns():
    """Probabilities that sum to 1, and held-out accuracy."""
    r = np.random.default_rng(0)
    words = [f"w{k}".encode() for k in range(1500)]
    counts = np.array([1 + 3000 // (k + 1) for k in range(1500)], float)
    tails = np.zeros((2, recurrent_lm.TAILS))
    for w, c in zip(words[recurrent_lm.HEAD :], counts[recurrent_lm.HEAD :], strict=True):
        tails[:, recurrent_lm.tail_class(w)] += c, 1
    lex = recurrent_lm.Lexicon(words, counts, int(counts.sum()), 1500, *tails)
    p = recurrent_lm.parameters(lex)
    # two languages that never mix: the state should tell which one a document is in
    docs = [np.concatenate([(r.integers(0, 30, 60) + 40 * (i % 2)), [0]]).astype(np.int16) for i in range(1500)]
    before = recurrent_lm.windows(p, docs[1200:], 64).sum()

    def learn(grads):
        for k, g in grads.items():
            s = p[f"squares of {k}"]
            s += g * g
            p[k] -= np.float32(recurrent_lm.RATE) * g / np.sqrt(s)

    recurrent_lm.windows(p, docs[:1200], 96, learn)
    assert recurrent_lm.windows(p, docs[1200:], 64).sum() > 0.8 * before
    assert np.allclose(recurrent_lm.windows(p, docs[1200:1240], 64), recurrent_lm.windows(p, docs[1200:1240], 3), rtol=1e-3)  # lanes don't matter
    symbols = np.arange(recurrent_lm.HEAD + recurrent_lm.TAILS, dtype=np.int16)[None, :]
    logp, _ = recurrent_lm.window(p, recurrent_lm.table(p), np.zeros_like(symbols), np.ones(symbols.shape, bool), np.zeros((symbols.shape[1], recurrent_lm.HIDDEN), np.float32), symbols, np.ones(symbols.shape, bool), None)
    assert abs(np.exp(logp).sum() - 1) < 1e-3


def test_language_model_gradients():
    """Every parameter's gradient against central differences of the loss."""
    r = np.random.default_rng(3)
    words = [f"w{k}".encode() for k in range(1200)]
    lex = recurrent_lm.Lexicon(words, np.ones(1200), 1200, 1200, np.ones(recurrent_lm.TAILS), np.ones(recurrent_lm.TAILS))
    p = {k: v.astype(np.float64) for k, v in recurrent_lm.parameters(lex).items()}
    read, target = (r.integers(0, recurrent_lm.HEAD + recurrent_lm.TAILS, (6, 5)).astype(np.int16) for _ in range(2))
    target[0] = 3
    starts = r.random((6, 5)) < 0.3
    live = r.random((6, 5)) < 0.8
    state = r.standard_normal((5, recurrent_lm.HIDDEN)).astype(np.float32)
    scale = 1 / (recurrent_lm.LANES * recurrent_lm.WINDOW)

    def loss():
        p32 = {k: v.astype(np.float32) for k, v in p.items()}
        logp, _ = recurrent_lm.window(p32, recurrent_lm.table(p32), read, starts, state, target, live, None)
        return -float(logp[live].astype(np.float64).sum()) * scale

    grads = {}
    p32 = {k: v.astype(np.float32) for k, v in p.items()}
    recurrent_lm.window(p32, recurrent_lm.table(p32), read, starts, state, target, live, grads)
    assert set(grads) == {k for k in p if not k.startswith("squares")}
    for k, g in grads.items():
        direction = np.sign(g) + (g == 0) * r.choice([-1.0, 1.0], g.shape)
        kept, step = p[k].copy(), 2e-2 / max(1.0, np.sqrt(g.size) / 4)
        p[k] = kept + step * direction
        up = loss()
        p[k] = kept - step * direction
        down = loss()
        p[k] = kept
        assert abs((up - down) / (2 * step) - float((g * direction).sum())) < 2e-2 * float(np.abs(g).sum()) + 1e-7, k


def test_language_model_beats_counts_on_held_out_texts(spark):
    rows = [(i, " ".join(f"{'ab'[i % 2]}{(i * 7 + k * (1 + i % 5)) % 40}" for k in range(120))) for i in range(700)]
    out = recurrent_lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert out[2] > 50 and out[0] > out[1]


def test_language_model_cuts_slices_whole(monkeypatch):
    monkeypatch.setattr(recurrent_lm, "TEXTS", 200)
    texts = [None, "", " a  B\nc ", *[prose(30, k) for k in range(40)], None, "x" * 900, "last one"]
    column = pa.array(["before it", *texts]).slice(1)
    counts = []
    for at, stop in recurrent_lm.slices(column):
        words, n = recurrent_lm.tokens(column.slice(at, stop - at))
        assert words.to_pylist() == [w for t in texts[at:stop] for w in (t or "").encode().lower().split()]
        counts += n.tolist()
    assert counts == [len((t or "").encode().lower().split()) for t in texts]


def test_language_model_of_repeated_rows(spark):
    rows = [(5, "the same text twice")] * 2 + [(6, "other words"), (6, "and more")]
    out = got(recurrent_lm.scored(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)))
    same = [r for r in out if r["doc_id"] == 5]
    assert len(out) == 4 and len(same) == 2 and same[0]["score"] == pytest.approx(same[1]["score"]) and same[0]["train_tokens"] == 10


def luhn(d):
    x = [int(c) for c in d][::-1]
    return (sum(x[::2]) + sum(sum(divmod(2 * k, 10)) for k in x[1::2])) % 10 == 0


def test_pii(spark, docs, empty):
    text = "write The.72@mail3.example.com or +1 (389) 555-5010, card 4845168114407329 (4845 1681 1440 7329), not 4845168114407328; 76.133.12.197 not 300.1.1.1; 123-45-6789 not 666-12-1234; on 2020-12-25, 25/12/2020, 31.12.1999, not 2020-13-45\n" 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!'
    other = "again 76.133.12.197 and 4845168114407329 and the.72@mail3.example.com"
    df = frame(spark, [(1, text, "s"), (2, other, "s"), (3, "clean text, 12 of 345", "s"), (4, None, "s"), (5, "", "s")])
    rows = {r.doc_id: r for r in pii.pseudonymised(df, "k", count="changed").collect()}
    out = rows[1].text
    for gone in ("The.72@", "389) 555-5010", "4845168114407329", "4845 1681 1440 7329", "76.133.12.197", "123-45-6789", "2020-12-25", "25/12/2020", "31.12.1999", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"):
        assert gone not in out, gone
    for stays in ("@mail3.example.com", "+1 (", "4845168114407328", "300.1.1.1", "666-12-1234", "2020-13-45", 'token = "'):
        assert stays in out, stays
    card, spaced = re.search(r"card (\d{16}) \((\d{4} \d{4} \d{4} \d{4})\)", out).groups()
    assert luhn(card) and spaced.replace(" ", "") == card and card in rows[2].text
    address = re.search(r"; (\d+\.\d+\.\d+\.\d+) not", out)[1]
    assert address in rows[2].text and max(map(int, address.split("."))) <= 255
    assert out.split(" ")[1].lower() == rows[2].text.split(" ")[-1]
    assert rows[3].text == "clean text, 12 of 345" and rows[4].text is None and rows[5].text == "" and [rows[k].changed for k in (3, 4, 5)] == [0, 0, 0]
    clean = docs.filter("doc_id < 100 or text is null")
    assert sorted(map(str, pii.pseudonymised(clean, "k").collect())) == sorted(map(str, clean.collect()))
    assert pii.pseudonymised(empty, "k").count() == 0


def test_pii_formats(spark):
    said = ["(000) 000-0000", "(212) 155-0100", "+1 (212) 155-0100", "+49 030.555.0100"]
    r = {x.doc_id: x.text for x in pii.pseudonymised(frame(spark, [(k, f"call {t} now", "s") for k, t in enumerate(said)]), "k").collect()}
    assert r == {k: f"call {t} now" for k, t in enumerate(said)}  # numbers that aren't valid stay
    valid = ["(212) 555-0100", "+1 (212) 555-0100", "+49 230.555.0100", "212.555.0100"]
    r = {x.doc_id: x.text for x in pii.pseudonymised(frame(spark, [(k, f"call {t} now " + "x y " * 30_000, "s") for k, t in enumerate(valid)]), "k").collect()}
    numbers = [re.search(r"call (.+?) now", r[k])[1] for k in range(4)]
    assert all(a != b and re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) for a, b in zip(numbers, valid, strict=True))
    assert numbers[1] == "+1 " + numbers[0] and re.sub(r"\D", "", numbers[3]) == re.sub(r"\D", "", numbers[0]) and re.match(r"\([2-9]\d\d\) [2-9]", numbers[0]) and numbers[2].startswith("+49 ")
    # dates with slashes: day and month, or month and day; no two share a pseudonym
    days = spark.range(2 * 365).select(F.date_add(F.lit("2003-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    both = days.select(F.date_format("d", "dd/MM/yyyy").alias("text")).union(days.filter("day(d) > 12").select(F.date_format("d", "MM/dd/yyyy").alias("text")))
    out = pii.pseudonymised(both, "k")
    assert out.distinct().count() == both.count() and out.filter(F.try_to_timestamp("text", F.lit("dd/MM/yyyy")).isNull() & F.try_to_timestamp("text", F.lit("MM/dd/yyyy")).isNull()).count() == 0
    rows = frame(spark, [(1, "seen 25/12/2020 and 12/25/2020", "s"), (1, "seen 25/12/2020 and 12/25/2020", "s"), (2, "12/25/2020", "s")])
    got_ = [x.text for x in pii.pseudonymised(rows, "k").orderBy("doc_id").collect()]
    assert got_[0] == got_[1] and got_[0].endswith(got_[2]) and got_[0] != pii.pseudonymised(rows, "other").orderBy("doc_id").first().text


def test_feistel_is_a_permutation(spark):
    for a, b in ((189, 773), (10, 100), (1, 7)):
        got = spark.range(a * b).select(pii.feistel(F.col("id"), a, b, "t", "k").alias("v")).agg(F.countDistinct("v"), F.min("v"), F.max("v")).first()
        assert tuple(got) == (a * b, 0, a * b - 1)
