"""Byte dedup against brute force: null and string ids, many equal rows, hot minimizers cut into parts."""

import random
from collections import Counter

import numpy as np

from inkstone.llm import byte_dedup


def brute(texts, least=200):
    c = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if c[t[i : i + least]] > 1:
                gone[i : i + least] = True
        out.append(bytes(x for x, g in zip(t, gone, strict=True) if not g))
    return out


def text(r, n):
    return "".join(r.choice("abcdefgh éü\n") for _ in range(n))


def corpus(seed):
    """Passages shared with different ends, so that their minimizers have many contexts, and texts that stand alone."""
    r = random.Random(seed)
    shared = text(r, 260)
    out = []
    for i in range(60):
        a, b = r.randrange(0, 40), r.randrange(215, 260)
        out.append(text(r, r.randrange(0, 300)) + shared[a:b] + text(r, r.randrange(0, 300)))
    return out + [text(r, 500) for _ in range(10)] + [None, "", "short", out[0], out[0], text(r, 30) * 20]


def test_rows_without_ids_keep_their_own_bytes(spark):
    texts = corpus(1)
    d = spark.createDataFrame([(t, None, 1) for t in texts], "text string, doc_id string, n int")
    want = Counter(brute([(t or "").encode() for t in texts]))
    assert Counter(bytes(r.kept) for r in byte_dedup.dedup_bytes(d).collect()) == want


def test_hot_minimizers_in_parts(spark):
    texts = corpus(2)
    d = spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    want = brute([(t or "").encode() for t in texts])
    for hot in (1, 2, 5):
        got = {r.doc_id: r for r in byte_dedup.dedup_bytes(d, hot).collect()}
        for i, (t, w) in enumerate(zip(texts, want, strict=True)):
            r = got[f"id{i}"]
            assert bytes(r.kept) == w, (hot, i)
            assert r.n_bytes - sum(x.b - x.a for x in r.removed) == len(w)
            assert all(x.b < y.a for x, y in zip(r.removed, r.removed[1:], strict=False))


def test_equal_rows_are_linear(spark):
    r = random.Random(3)
    t = text(r, 900)
    rows = [(7, t)] * 400 + [(8, text(r, 100) + t[300:600]), (9, text(r, 600))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = byte_dedup.dedup_bytes(d).collect()
    assert len(out) == 402 and all(bytes(x.kept) == b"" for x in out if x.doc_id == 7)
    assert {x.doc_id: len(x.removed) for x in out if x.doc_id > 7} == {8: 1, 9: 0}
