"""Every stage of the pipeline against a brute-force version of its own, on a fixture with copies, passages and junk."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from inkstone.llm import bpe, quality_classifier

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(12)
    pool = ["".join(r.choice("abcdeghilmnorstu") for _ in range(r.randrange(3, 9))) for _ in range(400)]
    sentence = lambda: " ".join(r.choice(pool) for _ in range(r.randrange(9, 16))).capitalize() + "."
    text = lambda n: " ".join(sentence() for _ in range(n))
    passage = text(5)
    out = [text(r.randrange(4, 9)) for _ in range(40)]
    out += [text(2) + " " + passage + " " + text(2) for _ in range(4)]
    out += [out[0], out[1]]
    for i in range(2, 8):  # near copies: some words changed
        w = out[i].split()
        for k in r.sample(range(len(w)), len(w) // 25 + 1):
            w[k] = r.choice(pool)
        out.append(" ".join(w))
    junk = ["| # $ | % & " * r.randrange(10, 40) for _ in range(16)]
    rows = [(t, 1) for t in out] + [(t, 0) for t in junk] + [(None, 0), ("", 0)]
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t), q) for i, (t, q) in enumerate(rows)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = documents()
    spark.createDataFrame([x[:5] for x in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(x[0], x[5], 0) for x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, d).cache()
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    whole = Counter(map(tuple, corpus_pipeline.run(spark, d).collect()))
    assert whole == Counter(map(tuple, out[-1][2]))
    machine = quality_classifier.trained(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    return {x[0]: x[1:] for x in out}, machine


def test_all_but_the_last_keep_the_columns(stages):
    for name, (_, _, before, after) in stages[0].items():
        assert name == "encode" or before == after


def test_quality(stages):
    (before, after, *_), m = stages[0]["quality"], stages[1]
    want = set()
    for x in before:
        ids, v, _ = quality_classifier.featurize([(x.text or "").encode()], quality_classifier.Buckets(), [x.n_chars])
        z = m.bias + float(m.linear[ids] @ v)
        z += sum(float(m.factors[ids[i]] @ m.factors[ids[j]]) * v[i] * v[j] for i in range(len(ids)) for j in range(i))
        if 1 / (1 + np.exp(-z)) >= 0.7:
            want.add(x.doc_id)
    assert {x.doc_id for x in after} == want and 40 <= len(want) < len(before)


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_near_dedup(stages):
    before, after, *_ = stages[0]["near_dedup"]
    words = {x.doc_id: (x.text or "").split() for x in before}
    label = {i: i for i in words}
    for i in sorted(words):
        for j in sorted(words):
            a, b = words[i], words[j]
            if j < i and a and b and label[i] != label[j] and lev(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if x == old else x for k, x in label.items()}
    assert {x.doc_id for x in after} == set(label.values()) and len(after) < len(before)


def test_substring_dedup(stages):
    import re

    before, after, *_ = stages[0]["substring_dedup"]
    got = {x.doc_id: x.text for x in after}
    first, removed = {}, 0
    for x in sorted(before, key=lambda x: x.doc_id):
        parts = re.findall(r"[^.!?\n]+[.!?]*[ \t\n\r\f]*|[.!?]+[ \t\n\r\f]*|\n[ \t\n\r\f]*", x.text or "")
        n = [len(p.split()) for p in parts]
        spans = set()
        for i in range(len(parts)):
            if n[i] >= 50:
                spans.add((i, i + 1))
                continue
            e = next((e for e in range(i + 2, len(parts) + 1) if sum(n[i:e]) >= 25), None)
            s = next((s for s in range(i - 1, -1, -1) if sum(n[s : i + 1]) >= 25), None)
            spans |= ({(i, e)} if e else set()) | ({(s, i + 1)} if s is not None else set())
        gone = set()
        for a, b in sorted(spans):
            key = tuple(" ".join(p.split()) for p in parts[a:b])
            if first.setdefault(key, (x.doc_id, a)) != (x.doc_id, a):
                gone |= set(range(a, b))
        removed += bool(gone)
        assert got[x.doc_id] == "".join(p for i, p in enumerate(parts) if i not in gone)
    assert removed >= 3 and all(x.n_chars == len(x.text) for x in after if x.text is not None)


def test_mix(stages):
    before, after, *_ = stages[0]["mix"]
    size = Counter()
    for x in before:
        size[x.source] += len((x.text or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, left = {}, 1.5 * sum(size.values())
    while True:  # water-filling as it is told
        todo = [s for s in order if s not in goal]
        over = [s for s in todo if left * weight[s] / sum(weight[t] for t in todo) > 2 * size[s]]
        if not over:
            goal |= {s: left * weight[s] / sum(weight[t] for t in todo) for s in todo}
            break
        goal |= {s: 2.0 * size[s] for s in over}
        left -= sum(goal[s] for s in over)
    taken, times = Counter(), Counter(x.doc_id for x in after)
    for x in after:
        taken[x.source] += len((x.text or "").split())
    longest = max(len((x.text or "").split()) for x in before)
    assert all(abs(taken[s] - goal[s]) <= longest for s in order) and max(times.values()) <= 2


def test_encode(stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    before, after, *_ = stages[0]["encode"]
    want = Counter()
    for x in before:
        ids = lib.encode(x.text or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[x.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in after) == want
