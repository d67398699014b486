"""Class language model against brute force: counts, classes, scores; clustering gains likelihood."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import class_lm as M


def corpus(n=120):
    r = random.Random(3)
    noun = [f"n{i}" for i in range(30)]
    verb = [f"v{i}" for i in range(30)]
    text = lambda: " ".join(f"{r.choice(['the', 'A'])} {r.choice(noun)} {r.choice(verb)}" for _ in range(r.randrange(5, 60)))
    return [(i, text(), i % 5 != 1) for i in range(n)] + [(n, None, True), (n + 1, "", False), (n + 2, "unseen Words", False), (None, "the n1 v1", True), (None, "the n1 v1", True)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, train boolean").cache()


def test_scores_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(M, "SHARE", 0.01)  # some words are units, some are not
    d = M.dealt(docs, 2000)
    model, known = M.train(d, 8)
    rows = [(r.doc_id, [*(r.text or "").lower().split()], r.train) for r in docs.collect()]
    count = Counter(w for _, w, t in rows if t for w in [*w, None])
    n, v = sum(count.values()), len(count)
    of = {bytes(r.word).decode() if bytes(r.word) != M.END else None: (r.c, r["class"]) for r in known.collect()}
    assert {w: c for w, (c, _) in of.items() if c} == count and (n, v) == (model.n, model.v)
    k = lambda w: of[w][1] if of[w][1] is not None else int(model.lumps[M.ending(w.encode())])
    own, types, m = Counter(), Counter(), Counter()
    for w, c in count.items():
        own[k(w)] += c
        types[k(w)] += 1
    for _, w, t in rows:
        if t:
            x = [None, *w, None]
            m.update((k(a), k(b)) for a, b in zip(x, x[1:], strict=False))
    after = Counter()
    for (a, _), c in m.items():
        after[a] += c
    got = Counter()
    for r in M.scored(d, model, known).collect():
        got[r.doc_id, r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6), round(r.score, 6)] += 1
        assert r.train_tokens == n
    want = Counter()
    for i, w, t in rows:
        base = score = 0.0
        before = None
        for x in [*w, None]:
            base += math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1)))
            a, b = k(before), k(x)
            prior = (own[b] + 0.5) / (n + 0.5 * 8)
            score += math.log10((m[a, b] + M.PRIOR * prior) / (after[a] + M.PRIOR)) + math.log10((count[x] + 0.5) / (own[b] + 0.5 * (types[b] + 1)))
            before = x
        want[i, len(w) + 1, sum(count[x] > 0 for x in [*w, None]), not t, round(base, 6), round(score, 6)] += 1
    assert got == want


def test_every_word_goes_where_its_neighbours_are_likeliest(docs, monkeypatch):
    monkeypatch.setattr(M, "SHARE", 0.02)
    monkeypatch.setattr(M, "WORDS", 5)  # many batches of one word
    sc = docs.sparkSession.sparkContext
    words = M.block_words(M.dealt(docs))
    vocab = words.where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))
    n = vocab.agg(F.sum("c")).first()[0]
    units = M.frequent(vocab, n)
    assert 2 < len(units.words) < 30
    assign, m, _ = M.clustered(M.pair_counts(docs, sc.broadcast(units)), units, 6)
    got = {bytes(r.word): r["class"] for r in M.own_classes(docs, sc.broadcast(units), assign, m, 100).collect()}
    of, near = units.cache(), {}
    for r in docs.collect():
        if r.train:
            x = [M.END, *M.tokens((r.text or "").encode()), M.END]
            for a, w, b in zip(x, x[1:], x[2:], strict=False):
                if w not in units.words:
                    y = near.setdefault(w, np.zeros((1, 2, 6)))
                    y[0, 0, assign[of[a]]] += 1
                    y[0, 1, assign[of[b]]] += 1
    assert set(got) == set(near) and len(got) > 20
    for w, y in near.items():
        g = M.gains(y, m)[0]
        assert g[got[w]] >= g.max() - 1e-9


def test_turns_gain_likelihood_until_they_stop(docs):
    units = M.Units({w: i for i, w in enumerate(sorted({x.encode() for r in corpus() for x in (r[1] or "").lower().split()} | {M.END}))}, np.zeros(0))
    pairs = M.pair_counts(docs, docs.sparkSession.sparkContext.broadcast(units)).cache()
    assign, m, seen = M.clustered(pairs, units, 4)
    assert len(seen) < M.TURNS and max(seen) > seen[0] + 100
    assert M.likelihood(m) == pytest.approx(max(seen))
    group = [assign[units.words[w]] for w in [*(b"n%d" % i for i in range(30)), *(b"v%d" % i for i in range(30))]]
    nouns, verbs = Counter(group[:30]).most_common(1)[0], Counter(group[30:]).most_common(1)[0]
    assert nouns[1] >= 25 and verbs[1] >= 25 and nouns[0] != verbs[0]


def test_classes_beat_the_base_on_held_out_text(docs):
    out = [r for r in M.class_scores(docs).collect() if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 100


def test_nothing_and_no_training(docs):
    assert M.class_scores(docs.limit(0)).count() == 0
    out = M.class_scores(docs.where("not train")).collect()
    assert out and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in out)


def test_texts_are_read_once_for_transitions_and_scores(docs):
    """Scores come from the stored classes of tokens: the plan that gives them deals out and reads no text."""
    out = M.class_scores(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "codes" in plan and "CoGroup" not in plan and "Exchange" not in plan
    d = M.dealt(docs).cache()
    model, known = M.train(d)
    key = lambda r: (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8))
    assert sorted(map(key, out.collect())) == sorted(map(key, M.scored(d, model, known).collect()))
