"""Corpus operators against brute force, libraries and round trips."""

import random
from collections import Counter

import numpy as np
import pytest

from inkstone.llm import bpe, byte_dedup, mixing, order_minhash, quality_classifier, quality_rules, sentence_dedup, transport_stream

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def words(r, n):
    return " ".join(r.choice(["river", "stone", "quiet", "lamp", "über", "été", "walk", "green", "seven", "light"]) + r.choice(["", "s", "ed", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    base = ". ".join(words(r, 12) for _ in range(8)) + "."
    near = base.split()
    near[40] = "changed"
    texts = [base, base, " ".join(near), None, "", " \n", "x", words(r, 300) + ".", "a" * 5000, "<|endoftext|> É ΑΣ 12", "\n".join([words(r, 30)] * 6)]
    texts += [". ".join(words(r, 15) for _ in range(6)) + "." for _ in range(12)]
    return [(i, t, "en", None if i % 5 == 0 else f"s{i % 4}", None, 1.0) for i, t in enumerate(texts)] + [(None, "no id here", "en", "s1", 3, 0.0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_library(docs, none, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: r for r in bpe.encode_decode(docs).collect()}
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(none).count() == 0


def brute_repeat(w, k=8):
    c = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return len({i + j for i in range(len(w) - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(k)})


def test_quality_rules(docs, none, rows):
    got = {r.doc_id: r for r in quality_rules.judge(docs, quality_rules.plan(docs)).collect()}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(w), brute_repeat(w), sum(len(x.decode()) for x in w))
        assert got[i].base_failed == (len(w) < 20 or 100 * brute_repeat(w) > 30 * len(w))
    other = list(reversed(quality_rules.RULES))
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs, other).collect()} == {i: r.kept for i, r in got.items()}
    assert quality_rules.judge(none, quality_rules.plan(none)).count() == 0


def test_sentence_dedup(docs, none, rows):
    assert all("".join(sentence_dedup.pieces(t or "")) == (t or "") for _, t, *_ in rows)
    out = {r.doc_id: r for r in sentence_dedup.dedup(docs).collect()}
    assert out[0].text == rows[0][1] and out[1].text == "" and out[3].text is None and out[0].score == 1.0
    assert all(out[i].text == rows[i][1] for i in range(11, 23))
    assert sentence_dedup.dedup(none).count() == 0


def test_transport_stream_round_trip(docs, rows):
    for n in (64, 128, 2048, 2112, 20480):
        payload = bytes(random.Random(n).randrange(256) for _ in range(n))
        media = transport_stream.mux(payload)
        s = transport_stream.demux(media)
        assert len(media) % 188 == 0 and s.payload == payload and not s.discontinuities and not s.crc_errors
        assert s.programs == {1: {0x100: 6}} and len(s.pts) == -(-n // 2048) and s.random_access[0]
    got = {r.doc_id: r for r in transport_stream.store(docs).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        assert bytes(got[i].payload) == raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0") and got[i].n_bytes == len(raw)


def test_mixing(docs, none):
    got = mixing.shares(docs).collect()
    total = 1.5 * sum(r.size for r in got)
    goals = {r.source: (r.target, r.source_size) for r in got}
    assert abs(sum(t for t, _ in goals.values()) - total) < 1e-6 and all(t <= 2 * s + 1e-9 for t, s in goals.values())
    assert all(0 <= r.copies <= 2 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.shares(docs).collect()))
    assert mixing.mix(docs).count() == sum(r.copies for r in got)
    assert mixing.shares(none).count() == 0


def test_factorisation_identity():
    r = np.random.default_rng(0)
    n = quality_classifier.BUCKETS + len(quality_classifier.STATS)
    m = quality_classifier.Machine(0.3, r.normal(size=n), r.normal(size=(n, 4)))
    ids, x = np.array([3, 9, 40, 7]), r.random(4)
    pairs = sum(m.factors[ids[i]] @ m.factors[ids[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert np.isclose(m.logits(ids, x, np.array([0, 4]))[0], 0.3 + m.linear[ids] @ x + pairs)


def test_classifier_learns(spark, none):
    r = random.Random(5)
    d = spark.createDataFrame([(i, words(r, 60) if i % 3 else " ".join("lamp###" for _ in range(60))) for i in range(150)], "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 150, 2)], "doc_id long, y int")
    s = {x.doc_id: x.score for x in quality_classifier.score(d, quality_classifier.train(d, y)).collect()}
    assert all((s[i] >= 0.7) == (i % 3 > 0) for i in range(1, 150, 2))
    assert quality_classifier.accepted(none, quality_classifier.fit(np.empty(0, int), np.empty(0), np.array([0]), np.empty(0))).count() == 0


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_alignment():
    r = random.Random(2)
    for _ in range(400):
        a = [r.randrange(40) for _ in range(r.randrange(5, 40))]
        b = list(a)
        for _ in range(r.randrange(5)):
            b[r.randrange(len(b)) : r.randrange(len(b)) + 1] = [r.randrange(40)] * r.randrange(3)
            b = b or [1]
        x, y, most, d = np.array(a, np.uint64), np.array(b, np.uint64), r.randrange(12), lev(a, b)
        assert order_minhash.edits_within(x, y, most) == (d if d <= most else None)
        c = order_minhash.chained(x, y, most)
        assert c > most or d <= c


def test_near_dedup(docs, none, rows):
    out = {r.doc_id: r for r in order_minhash.classes(docs).collect()}
    assert out[0].class_id == out[1].class_id == out[2].class_id == 0
    assert [i for i in range(3) if out[i].kept] == [0]
    assert all(out[i].class_id == i for i in range(3, 23))  # null and empty texts too
    assert order_minhash.deduped(docs).count() == len(rows) - 2
    assert order_minhash.classes(none).count() == 0


def brute_bytes(texts, least=200):
    c = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if c[t[i : i + least]] > 1:
                gone[i : i + least] = True
        out.append(bytes(x for x, g in zip(t, gone, strict=True) if not g))
    return out


def test_byte_dedup(docs, none, rows):
    got = {r.doc_id: bytes(r.kept) for r in byte_dedup.dedup_bytes(docs).collect()}
    want = brute_bytes([(t or "").encode() for _, t, *_ in rows])
    assert all(got[i] == w for (i, *_), w in zip(rows, want, strict=True))
    assert byte_dedup.dedup_bytes(none).count() == 0


def test_expansion_against_brute_force():
    r = random.Random(2)
    for _ in range(60):
        s = list(dict.fromkeys(bytes(r.choice(b"ab") for _ in range(r.randrange(6, 40))) for _ in range(r.randrange(1, 8))))
        kept = brute_bytes(s, 6)
        for t, k, runs in zip(s, kept, byte_dedup.repeated(s, [1] * len(s), 6), strict=True):
            gone = {i for a, b in runs for i in range(a, b)}
            assert bytes(x for i, x in enumerate(t) if i not in gone) == k


def test_first_occurrences_hash_alike_with_and_without_repeats():
    import numpy as np

    from inkstone.llm import order_minhash as om

    once = np.arange(100, 140, dtype=np.uint64)
    twice = np.r_[once, once[:1]]
    assert (om.labelled(once) == om.labelled(twice)[:-1]).all()
    assert om.labelled(twice)[-1] not in om.labelled(once)
