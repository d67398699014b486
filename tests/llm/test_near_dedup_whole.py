"""Near-dedup against all pairs: candidates down to the edit threshold, large buckets, classes, odd rows."""

import random

import numpy as np

from inkstone.llm import order_minhash as M
from inkstone.llm.components import components


def hashes(words):
    ids = M.WordHash()
    return np.array([ids[w.encode()] for w in words], np.uint64)


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def linked(a, b):
    return lev(a, b) <= int((1 - M.SIMILARITY) * max(len(a), len(b)) + 1e-9)


def test_pairs_of_a_large_bucket_are_found(spark):
    """Texts of one frame, mutually under 0.8, of which some have a near copy without five words in a row of its own."""
    r = random.Random(11)
    texts, originals = [], []
    for i in range(400):
        w = [f"frame{j}" for j in range(70)] + [f"w{i}x{j}" for j in range(30)]
        texts.append(" ".join(w))
        if i % 10 == 0:
            w[70::3] = [f"c{i}x{j}" for j in range(10)]
            originals.append(len(texts) - 1)
            texts.append(" ".join(w))
    place = list(range(len(texts)))
    r.shuffle(place)
    docs = spark.createDataFrame([(k, t) for k, t in zip(place, texts, strict=True)], "doc_id long, text string")
    out = {x.doc_id: x.class_id for x in M.classes(docs, 64).collect()}
    assert all(out[place[i]] == out[place[i + 1]] for i in originals)
    assert len(set(out.values())) == 400


def test_groups_pass_every_similar_pair():
    r = random.Random(3)
    base = [str(r.randrange(50)) for _ in range(60)]
    texts = []
    for _ in range(50):
        w = list(base)
        for _ in range(r.randrange(14)):
            w[r.randrange(len(w)) : r.randrange(len(w)) + 1] = [str(r.randrange(50))] * r.randrange(1, 3)
        texts.append(w)
    h = [hashes(w) for w in texts]
    bins = np.array([np.minimum(M.histogram(x), 255) for x in h], np.uint8)
    got = {frozenset(p) for p in zip(*map(np.ndarray.tolist, M.possible(np.array([len(w) for w in texts]), bins, np.arange(50))), strict=True)}
    want = {frozenset((i, j)) for i in range(50) for j in range(i) if linked(texts[i], texts[j])}
    assert want and want <= got
    assert all(M.similar(h[i], h[j]) == (frozenset((i, j)) in want) for i in range(50) for j in range(i))


def test_scattered_edits_meet():
    """Share of pairs that meet, by edit similarity; 0.9 is the least that counts as done."""
    r, met = random.Random(5), {}
    for least in (0.8, 0.85, 0.9, 0.95):
        hit = 0
        for t in range(200):
            n = r.randrange(20, 400)
            w = [f"t{t}w{j}" for j in range(n)]
            x = list(w)
            for j in sorted(r.sample(range(n), int((1 - least) * n + 1e-9)), reverse=True):
                kind = r.randrange(3)
                x[j : j + 1] = [] if kind == 0 else [f"t{t}new{j}"] if kind == 1 else x[j : j + 1]
            hit += bool(set(M.keys_of(hashes(w)).tolist()) & set(M.keys_of(hashes(x)).tolist()))
        met[least] = hit / 200
    assert min(met.values()) >= 0.9 and met[0.9] > 0.99, met


def test_short_texts_meet_whenever_they_are_linked():
    r, found = random.Random(6), 0
    for _ in range(3000):
        w = [r.choice("abcdefgh") for _ in range(r.randrange(1, M.SHORT + 1))]
        x = list(w)
        for _ in range(r.randrange(1, 4)):
            x[r.randrange(len(x)) : r.randrange(len(x)) + 1] = [r.choice("abcdefgh")] * r.randrange(3)
            x = x or ["a"]
        if len(x) <= M.SHORT and M.similar(hashes(w), hashes(x)):
            found += 1
            assert set(M.short_keys(hashes(w)).tolist()) & set(M.short_keys(hashes(x)).tolist())
    assert found > 300


def brute(texts):
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] and texts[j] and label[i] != label[j] and linked(texts[i], texts[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_classes_against_all_pairs(spark):
    """Near copies at each level, copies, frames, short and empty texts; string ids, repeated rows, an extra column."""
    r = random.Random(8)
    word = lambda: r.choice("river stone quiet lamp walk green seven light".split()) + str(r.randrange(40))
    texts = [[word() for _ in range(r.randrange(60, 120))] for _ in range(12)]
    for i in range(12):
        for share in (0.03, 0.08, 0.12):
            w = list(texts[i])
            for _ in range(int(share * len(w))):
                w[r.randrange(len(w))] = word()
            texts.append(w)
    frame = [word() for _ in range(60)]
    texts += [frame + [word() for _ in range(30)] for _ in range(15)] + [texts[3], texts[4] + ["end"], ["one"], ["one"], ["two"], [], []]
    want = brute(texts)
    for bucket in (M.BUCKET, 3):
        d = spark.createDataFrame([(i, " ".join(t), 1) for i, t in enumerate(texts)], "doc_id long, text string, class_id int")
        out = {x.doc_id: (x.class_id, x.kept) for x in M.classes(d, bucket).collect()}
        least = {}
        for i, x in enumerate(want):
            least.setdefault(x, i)
        assert {i: least[x] for i, x in enumerate(want)} == {i: c for i, (c, _) in out.items()}
        assert all(kept == (c == i) for i, (c, kept) in out.items())
    d = spark.createDataFrame([(f"id{i}", " ".join(t)) for i, t in enumerate(texts)] * 2, "doc_id string, text string")
    out = M.classes(d).collect()
    assert len(out) == 2 * len(texts) and len({x.class_id for x in out}) == len(set(want))
    assert M.deduped(d).count() == len(set(want))


def test_null_ids_are_not_one_class(spark):
    d = spark.createDataFrame([(None, "quite another text here"), (None, "some words of mine"), (None, None), (None, "some words of mine"), (5, "some words of mine")], "doc_id long, text string")
    out = sorted((x.class_id, x.kept) for x in M.classes(d).collect())
    assert len({c for c, _ in out}) == 3 and out.count((5, True)) == 1 and out.count((5, False)) == 2
    assert M.deduped(d).count() == 3


def test_pairs_of_a_large_bucket_without_a_rare_run_are_found(spark):
    """Texts of one frame whose own words a near copy replaces, so that all runs that both have are those of many texts."""
    r, texts = random.Random(12), []
    for i in range(40):
        w = [f"frame{j}" for j in range(60)] + ["own"] + [x for j in r.sample(range(30), 20) for x in (f"one{j}", f"two{j}", "own")]
        texts.append([f"{x}{i}.{j}" if x == "own" else x for j, x in enumerate(w)])
        if i % 8 == 0:
            texts.append([f"{x}{i}-{j}" if x == "own" else x for j, x in enumerate(w)])
    want = brute(texts)
    assert len(set(want)) == 40
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [x.class_id for x in M.classes(docs, 8).orderBy("doc_id").collect()] == want


def test_linked_nodes_share_an_entry_in_parts_too(spark):
    """Every linked pair of different labels is found however few nodes a part holds; one label's are never paired."""
    r = random.Random(13)
    base = [str(r.randrange(60)) for _ in range(70)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(22)):
            w[r.randrange(len(w)) : r.randrange(len(w)) + 1] = [str(r.randrange(60))]
        texts.append(w)
    packed = [(hashes(w) >> np.uint64(32)).astype(np.uint32).tobytes() for w in texts]
    labels = [0 if i % 2 else 1 if i % 4 else i for i in range(60)]
    rows = spark.createDataFrame([(i, labels[i], bytearray(p)) for i, p in enumerate(packed)], "id long, label long, words binary")
    want = {(i, j) for i in range(60) for j in range(i) if labels[i] != labels[j] and linked(texts[i], texts[j])}
    assert want
    for whole in (4096, 20, 6):
        got = {(x.a, x.b) for x in M.met(M.rare_entries(rows, whole)).collect()}
        assert want <= got and all(labels[a] != labels[b] for a, b in got)


def test_components_alike_at_the_driver_and_in_rounds(spark):
    r = random.Random(14)
    pairs = [(i + 1, i) for i in range(30)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(300, 900), (900, 5000), (400, 5000)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    out = [sorted((x.node, x.label) for x in components(edges, few).collect()) for few in (0, 1000)]
    assert out[0] == out[1] and (400, 300) in out[0] and (30, 0) in out[0]
    assert not components(edges.limit(0)).count()


def test_words_of_one_frame_make_few_entries(spark):
    """Texts of one long frame that are not linked: entries must not grow with the frame, and linked pairs all have one."""
    r, texts = random.Random(15), []
    frame = [f"frame{j}" for j in range(300)]
    for i in range(120):
        w = [x if r.random() < 0.98 else f"own{i}x{j}" for j, x in enumerate(frame)]
        r.shuffle(w)
        texts.append(w)
        if i % 10 == 0:
            texts.append([x if r.random() < 0.95 else f"new{i}x{j}" for j, x in enumerate(w)])
    packed = [(hashes(w) >> np.uint64(32)).astype(np.uint32).tobytes() for w in texts]
    rows = spark.createDataFrame([(i, i, bytearray(p)) for i, p in enumerate(packed)], "id long, label long, words binary")
    entries = M.rare_entries(rows).cache()
    assert entries.count() < 20 * len(texts)
    want = {(i, i - 1) for i in range(len(texts)) for w in texts[i] if w.startswith("new")}
    assert len(want) == 12 and all(linked(texts[a], texts[b]) for a, b in want)
    got = {(x.a, x.b) for x in M.met(entries).collect()}
    assert want <= got and all(linked(texts[a], texts[b]) for a, b in got)  # only links leave a bucket
    for whole, common in ((4096, 4), (20, 4), (20, 64)):
        assert want <= {(x.a, x.b) for x in M.met(M.rare_entries(rows, whole, common)).collect()}


def test_linked_texts_of_other_lengths_share_an_entry(spark):
    """The longer text of a pair may be allowed an edit more than the shorter."""
    r, texts = random.Random(16), []
    for i in range(25):
        w = [str(r.randrange(30)) for _ in range(r.randrange(4, 26))]
        texts.append(w)
        for _ in range(3):
            x = list(w)
            for _ in range(1 + len(w) // 5):
                k = r.randrange(len(x) + 1)
                x[k : k + r.randrange(2)] = [str(r.randrange(30))] * r.randrange(2)
            texts.append(x or ["0"])
    packed = [(hashes(w) >> np.uint64(32)).astype(np.uint32).tobytes() for w in texts]
    rows = spark.createDataFrame([(i, i, bytearray(p)) for i, p in enumerate(packed)], "id long, label long, words binary")
    want = {(i, j) for i in range(100) for j in range(i) if texts[i] != texts[j] and linked(texts[i], texts[j])}
    assert any(len(texts[i]) != len(texts[j]) for i, j in want)
    for whole, common in ((4096, 64), (10, 3)):
        assert want <= {(x.a, x.b) for x in M.met(M.rare_entries(rows, whole, common)).collect()}
