import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions.stem import stem
from inkstone.operators import corpus as C
from inkstone.operators import evaluation as E
from inkstone.operators import scoring as G
from inkstone.operators import selection as S
from inkstone.operators import wmd as W
from inkstone.sources import io


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_budget_rounds_half_to_even(spark):
    want = {1: 3, 5: 3, 60: 3, 61: 3, 70: 4, 80: 4, 83: 4, 90: 4, 110: 6, 130: 6, 1189: 59}
    got = spark.createDataFrame([(m,) for m in want], "m long").select("m", T.budget(F.col("m")).alias("k")).collect()
    assert {r.m: r.k for r in got} == want


def test_mmr_by_hand():
    eye = np.eye(5)
    assert S.mmr(np.array([0.3, 0.1, 0.8, 0.6, 0.5]), eye, 3, 1.0) == [2, 3, 4]
    # two of one direction: the better of them first, then the other direction although its score is less
    same = np.array([[2.0, 0], [1.0, 0], [0, 3.0]])
    assert S.mmr(np.array([0.75, 0.8, 0.6]), same, 2, 0.4) == [1, 2]
    assert S.mmr(np.array([0.75, 0.8, 0.6]), same, 2, 1.0) == [1, 0]
    assert S.mmr(np.array([]), np.empty((0, 3)), 2, 0.7) == []
    assert S.mmr(np.array([0.4, 0.4, 0.4]), np.eye(3), 1, 0.7) == [0]
    assert S.mmr(np.array([0.4, 0.9]), np.eye(2), 7, 0.7) == [1, 0]


def test_mmr_against_its_definition():
    r = np.random.default_rng(3)
    for _ in range(30):
        n, lam = int(r.integers(1, 12)), float(r.random())
        score, vec = r.random(n), r.normal(size=(n, 3))
        cos = lambda i, j: vec[i] @ vec[j] / np.linalg.norm(vec[i]) / np.linalg.norm(vec[j])  # noqa: B023, E731
        got = [int(score.argmax())]
        while len(got) < min(4, n):
            got.append(max((i for i in range(n) if i not in got), key=lambda i: lam * score[i] - (1 - lam) * max(cos(i, j) for j in got)))  # noqa: B023
        assert S.mmr(score, vec, 4, lam) == got


def test_mmr_over_documents(spark):
    df = spark.createDataFrame([(1, [0.9, 0.8, 0.7, 0.6], [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]), (2, [0.5], None)], "doc_id long, scores array<double>, vecs array<struct<sent_idx:int,vec:array<double>>>")
    out = {x.doc_id: (x.picked, x.ordered) for x in S.mmr_lists(df, 0.5).collect()}
    assert out == {1: ([0, 2, 3], [0, 2, 3]), 2: ([0], [0])}


def test_threshold_filter_against_its_definition():
    rng = np.random.default_rng(5)
    bags = [W.Bag([f"w{i}" for i in rng.integers(0, 40, n)]) for n in rng.integers(0, 14, 60)]

    def plain(delta, k):
        taken, seen, out = [], 0, 0
        for i, b in enumerate(bags):
            if len(taken) >= k:
                break
            seen += 1
            if all(float(W.finite(W.distances([(b, bags[j])]))[0]) >= delta for j in taken):
                taken.append(i)
            else:
                out += 1
        return taken, seen, out

    for delta in (0.0, 0.8, 1.0, 1.15, 3.0, 3.1):
        for block in (7, 128):
            assert W.threshold_filter(bags, delta, 6, block) == plain(delta, 6)


def test_transport_is_exact():
    r = np.random.default_rng(0)
    for _ in range(50):
        n = int(r.integers(1, 5))
        c, u = r.random((n, n)), np.full(n, 1 / n)
        best = min(sum(c[i, p[i]] for i in range(n)) / n for p in itertools.permutations(range(n)))
        assert abs(W.transport(u, u, c) - best) < 1e-9
        p, q, c = r.dirichlet(np.ones(4)), r.dirichlet(np.ones(6)), r.random((4, 6))
        x = W.transport(p, q, c)
        low, up = W.bounds(p[None], q, c[None])
        assert low[0] - 1e-9 <= x <= up[0] + 1e-9 and abs(x - W.transport(q, p, c.T)) < 1e-9


def linear_program(p, q, c):
    """Least cost by enumerating the bases of a small transport problem."""
    n, m = c.shape
    best = np.inf
    for cells in itertools.combinations(range(n * m), n + m - 1):
        a = np.zeros((n + m, len(cells)))
        for k, x in enumerate(cells):
            a[x // m, k] = a[n + x % m, k] = 1
        if np.linalg.matrix_rank(a) < n + m - 1:
            continue
        f = np.linalg.lstsq(a, np.r_[p, q], rcond=None)[0]
        if (f > -1e-9).all():
            best = min(best, float(sum(f[k] * c[x // m, x % m] for k, x in enumerate(cells))))
    return best


def test_distances_to_the_document_and_among_sentences():
    sents = [["rain", "falls"], [], ["sun", "shines", "sun"], ["rain", "falls"], ["wind"]]
    d, mask = W.to_document(sents)
    whole = [w for t in sents for w in t]
    words = list(dict.fromkeys(whole))
    assert mask.tolist() == [False, True, False, False, False] and d[1] == W.FALLBACK
    q = np.array([whole.count(w) / len(whole) for w in words])
    for i in (0, 2, 4):
        own = list(dict.fromkeys(sents[i]))
        p = np.array([sents[i].count(w) / len(sents[i]) for w in own])
        c = np.array([[np.linalg.norm(W.unit_vector(a) - W.unit_vector(b)) for b in words] for a in own])
        assert abs(d[i] - linear_program(p, q, c)) < 1e-9
    low, mask2 = W.relaxed_to_document(sents)
    assert (low <= d + 1e-9).all() and (mask2 == mask).all()
    m = W.matrix(sents)
    assert (m == m.T).all() and m[0, 3] == 0 and m[0, 1] == np.inf and m[1, 1] == 0
    assert abs(m[0, 4] - W.wmd(sents[0], sents[4])) < 1e-12


def test_protection(spark):
    assert one(spark, "from 3.11.1988 to 7/8.12.1991", T.protect_dates) == "from 3<PERIOD>11<PERIOD>1988 to 7/8<PERIOD>12<PERIOD>1991"
    assert one(spark, "1.2.3", T.protect_decimals) == "1<PERIOD>2.3"
    assert one(spark, "Q. W. Ferrow", T.protect_citations) == "Q<PERIOD> W<PERIOD> Ferrow"
    assert one(spark, "Mill vs. Brook", T.protect_citations) == "Mill vs<PERIOD> Brook"
    assert one(spark, "[2004] 7 S.C.R. 31 followed.", T.protect_citations) == "[2004] 7 S<PERIOD>C<PERIOD>R<PERIOD> 31 followed."
    assert one(spark, None, T.protect_citations) == ""
    assert one(spark, "Dr. Ferrow spoke. All heard.", T.legal_sentences) == ["Dr. Ferrow spoke.", "All heard."]


def test_blank_and_short(spark):
    assert one(spark, None, T.rule_sentences) == []
    assert one(spark, "  \n", T.rule_sentences) == []
    assert one(spark, "A b.\r\nC d! E", T.rule_sentences) == ["A b.", "C d!", "E"]


def test_overlap(spark):
    cases = [([1, 2, 3], [4, 5], 0.0), ([1, 2, 3, 9], [9, 11, 12], 1 / 6), ([4, 7], [7, 4], 1.0), ([], [], 1.0), ([], [3], 0.0)]
    for a, b, j in cases:
        x = spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(E.jaccard(F.col("a"), F.col("b")).alias("j")).first().j
        assert abs(x - j) < 1e-9


def test_self_bleu(spark):
    def bleu(*texts):
        df = spark.createDataFrame([(1, i, t.lower().split()) for i, t in enumerate(texts)], "doc_id long, sent_idx int, toks array<string>")
        return E.self_bleu_2(df).first().self_bleu_2

    same = "seven green boats crossed a wide river before noon"
    assert bleu(same, same) > 0.8
    assert bleu(same, "nobody in that old house ever heard what bells rang") < 0.3
    assert bleu(same) == 0.0


def test_distinct(spark):
    rows = spark.createDataFrame([(1, ["appeal"]), (2, []), (3, ["a", "b", "a", "b"])], "doc_id long, toks array<string>")
    assert {r.doc_id: r.distinct_2 for r in E.distinct_n(rows, 2).collect()} == {1: 1.0, 2: 0.0, 3: round(2 / 3, 6)}


def test_percentiles(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 5)], "v int")
    assert tuple(E.floor_percentiles(df, "v", [0.25, 0.5, 0.75]).first()) == (2, 3, 4)


def test_split_matches_order(spark):
    docs = spark.range(500).withColumnRenamed("id", "doc_id")
    got = {r["part"]: r["count"] for r in S.hash_split(docs).groupBy("part").count().collect()}
    assert got == {"test": 100, "val": 60, "train": 340}


def test_unknown_config():
    with pytest.raises(ValueError):
        G.features_of("C9")


def test_io(spark, tmp_path):
    for k in ("j", "h"):
        (tmp_path / k).mkdir()
    for i in ("2", "10", "x"):
        (tmp_path / "j" / f"{i}.txt").write_bytes(b"text \xff of " + i.encode())
    for i in ("2", "10"):
        (tmp_path / "h" / f"{i}.txt").write_text("head")
    pairs = io.read_pairs(spark, str(tmp_path / "j"), str(tmp_path / "h"))
    assert [r.doc_id for r in pairs.orderBy(*io.id_order()).collect()] == ["2", "10"]
    (tmp_path / "ids.txt").write_text(" 10 \n\n2\n")
    ids = io.read_ids(spark, str(tmp_path / "ids.txt"))
    assert {r.doc_id for r in io.read_split(pairs, ids, 1).collect()} == {"2"}
    (tmp_path / "c.json").write_text('{"1": ["a", {"text": "b"}, {"sentence": "c"}]}')
    assert [r.sent for r in io.read_sentence_cache(spark, str(tmp_path / "c.json")).orderBy("sent_idx").collect()] == ["a", "b", "c"]


def test_stem():
    # Examples of the published algorithm.
    pairs = "caresses caress ponies poni ties ti agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop filing file happy happi relational relat digitizer digit decisiveness decis triplicate triplic electrical electr adjustable adjust adoption adopt effective effect probate probat rate rate controll control was was".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]


def test_labels(spark):
    src = spark.createDataFrame([(1, 0, "Boats crossed the river"), (1, 1, ""), (1, 2, "the the"), (1, 3, "nothing alike"), (2, 0, "the river")], "doc_id long, sent_idx int, sent string")
    ref = spark.createDataFrame([(1, 0, "the boat crossing"), (1, 1, "a river, the river"), (1, 2, "the river")], "doc_id long, ref_idx int, sent string")
    got = {(x.doc_id, x.sent_idx): (x.y, x.match_idx, x.match_text) for x in C.labels(src, ref).collect()}
    assert got == {(1, 0): (round(4 / 6, 6), 2, "the river"), (1, 1): (0.0, -1, ""), (1, 2): (0.5, 2, "the river"), (1, 3): (0.0, -1, "")}
    got = {x.sent_idx: (x.y, x.match_idx) for x in C.labels(src, ref, stemmed=True).collect()}
    assert got[0] == (round(6 / 7, 6), 0) and got[2] == (0.5, 2)


def test_vectors_from_a_table(spark):
    """IO7, J7: words without a vector drop out, and sentences without a known word."""
    s = spark.createDataFrame([(1, 0, "rain falls"), (1, 1, "unknown"), (1, 2, "rain rain falls unknown")], "doc_id long, sent_idx int, sent string")
    v = spark.createDataFrame([("rain", [1.0, 0.0]), ("falls", [0.0, 1.0])], "word string, vec array<double>")
    out = {x.sent_idx: x.vec for x in C.sentence_vectors(s, vectors=v, dim=2).collect()}
    assert out == {0: [0.5, 0.5], 2: [pytest.approx(2 / 3), pytest.approx(1 / 3)]}


def test_kendall():
    r = np.random.default_rng(4)
    for _ in range(200):
        n = int(r.integers(0, 30))
        x, y = r.integers(0, 8, n).astype(float), r.integers(0, 8, n).astype(float)
        d = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(n) for j in range(i)]
        span = np.sqrt(sum(abs(a) for a, _ in d) * sum(abs(b) for _, b in d))
        want = sum(a * b for a, b in d) / span if span else 0.0
        assert abs(E.kendall(x, y) - want) < 1e-9
        rows, w = np.unique(np.stack([x, y], 1), return_counts=True, axis=0)
        assert abs(E.weighted_kendall(rows[:, 0], rows[:, 1], w) - want) < 1e-9


def test_p_values():
    # fixed values: tail areas of Student's t, two-sided: t = 2.228 at 10 degrees is 0.05, t = 12.706 at 1 degree is 0.05
    for t, df in ((2.2281389, 10), (12.7062047, 1), (1.9718963, 200)):
        r = t / np.sqrt(df + t * t)
        assert abs(E.p_value(r, df + 2) - 0.05) < 1e-6 and abs(E.p_value(-r, df + 2) - 0.05) < 1e-6
    assert E.p_value(0.0, 50) == 1.0 and E.p_value(1.0, 9) == 0.0 and E.p_value(0.5, 2) == 1.0


def test_scaling(spark):
    df = spark.createDataFrame([(i, float(i), 3.0) for i in range(5)], "k int, a double, b double")
    out, params = E.fit_transform(df, ["a", "b"], "standard")
    assert {(p.feature, p.center) for p in params.collect()} == {("a", 2.0), ("b", 3.0)}
    assert [round(x.a, 6) for x in out.orderBy("k").collect()] == [round((i - 2) / np.sqrt(2), 6) for i in range(5)] and out.first().b == 0.0
    with pytest.raises(ValueError):
        E.fit_transform(df, ["a"], "other")
    with pytest.raises(ValueError):
        E.scale(df, None, ["a"])


def test_audit_of_odd_values(spark):
    a = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, float("inf")), (4, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.5), (3, float("inf")), (4, 2.0), (5, 0.0)], "k int, v double")
    assert {x.check: x.n_bad for x in E.alignment(a, b, ["k"], ["v"]).collect()} == {"only_left": 1, "only_right": 1, "nan_v": 1, "inf_v": 1, "differs_v": 3}
    assert E.max_difference(a.where("k in (1, 4)"), b, ["k"], ["v"]).first().max_abs_diff == 0.5


def test_splits(spark):
    docs = spark.range(300).withColumnRenamed("id", "doc_id")
    import hashlib

    order = sorted(range(300), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    got = {x.doc_id: x.part for x in S.hash_split(docs, 0.2, 50).collect()}
    assert [got[i] for i in order] == ["test"] * 50 + ["val"] * 50 + ["train"] * 200
    with pytest.raises(ValueError):
        S.hash_split(docs, test=301)
    frozen = [docs.where("doc_id < 3"), docs.where("doc_id = 5")]
    got = {x.doc_id: x.part for x in S.hash_split(docs, ids=frozen).where("doc_id < 7").collect()}
    assert got == {0: "test", 1: "test", 2: "test", 3: "train", 4: "train", 5: "val", 6: "train"}
    assert S.overlap(docs.where("doc_id < 9"), spark.createDataFrame([("8",), ("x",)], "doc_id string")) == 1
    rows = spark.createDataFrame([("b", 4), ("a", 7), ("b", 9), ("a", 1)], "k string, place int")
    assert [(x.k, x.place) for x in S.first_seen(rows, "k", "place").collect()] == [("a", 1), ("b", 4)]
    strata = spark.createDataFrame([("x",), ("x",)], "stratum string")
    assert S.sample_is_whole(strata, {"x": 2}).count() == 2
    with pytest.raises(ValueError):
        S.sample_is_whole(strata, {"x": 2, "y": 1})


def test_models(spark, tmp_path):
    rows = spark.createDataFrame([(float(i % 17), float(i % 5), float(i % 17) + (i * i) % 7) for i in range(400)], "a double, b double, y double")
    m, n = (G.fit(rows, ["a", "b"], trees=4) for _ in range(2))
    assert G.same_scorer(m, n, rows, ["a", "b"]) and not G.same_scorer(m, G.fit(rows, ["a", "b"], trees=1), rows, ["a", "b"])
    G.save(m, str(tmp_path / "model"))
    assert G.same_scorer(m, G.load(str(tmp_path / "model")), rows, ["a", "b"])
    assert [x for x, _ in G.importances(m, ["a", "b"])] == ["a", "b"]
    assert G.predict(m, rows.limit(0), ["a", "b"]).count() == 0


def test_threshold_select(spark):
    rows = [(1, 0, 0.9, ["a", "b"]), (1, 1, 0.8, ["a", "b"]), (1, 2, 0.7, []), (1, 3, 0.6, []), (2, 0, 0.1, [])]
    df = spark.createDataFrame(rows, "doc_id long, sent_idx int, score double, toks array<string>")
    got = {(r.doc_id, r.delta): (r.selected, r.num_evaluated, r.num_rejected, r.under_filled) for r in S.threshold_select(df, (0.5, 3.0)).collect()}
    assert got == {(1, d): ([0, 2], 4, 2, True) for d in (0.5, 3.0)} | {(2, d): ([0], 1, 0, False) for d in (0.5, 3.0)}
    assert S.threshold_select(df.limit(0), (0.5,)).count() == 0


def test_row_offsets(spark):
    df = spark.createDataFrame([(5, 2), (1, 3), (70_000, 4), (9, 1)], "doc_id long, m int")
    got = {r.doc_id: (r.start_idx, r.end_idx, r.num_sentences) for r in C.row_offsets(df).collect()}
    assert got == {1: (0, 3, 3), 5: (3, 5, 2), 9: (5, 6, 1), 70_000: (6, 10, 4)}


def test_global_spearman(spark):
    df = spark.createDataFrame([(1.0, 9.0), (2.0, 7.0), (2.0, 7.0), (3.0, 8.0)], "x double, y double")
    want = round(float(np.corrcoef([1, 2.5, 2.5, 4], [4, 1.5, 1.5, 3])[0, 1]), 6)
    assert tuple(E.global_spearman(df, "x", "y").first()) == (4, want)
    assert tuple(E.global_spearman(df.limit(1), "x", "y").first()) == (1, 0.0)
    assert tuple(E.global_spearman(df.limit(0), "x", "y").first()) == (0, 0.0)


def test_writers(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    rows = spark.createDataFrame([(2, 0, 1.0), (1, 0, 2.0), (1, 1, 4.0)], "doc_id long, sent_idx int, tfidf double")
    scaled, params = E.fit_transform(rows, ["tfidf"])
    io.write_features(rows, scaled, params, at("f"), "C1")
    io.write_features(rows.limit(1), scaled, params, at("f"), "C2")
    assert io.read_features(spark, at("f"), "C1").count() == 3 and io.read_features(spark, at("f"), "C2").count() == 1
    assert io.read_features(spark, at("f"), "C1", "params").first().center == 2.0
    io.write_labels(rows, rows.groupBy().count(), at("l"))
    assert {(x.doc_id, x.start_idx, x.end_idx) for x in spark.read.parquet(at("l/boundaries")).collect()} == {(1, 0, 2), (2, 2, 3)}
    made = []
    make = lambda: made.append(1) or spark.createDataFrame([("a", 1.0)], "term string, idf double")
    assert io.saved_vocabulary(spark, at("v"), make).count() == io.saved_vocabulary(spark, at("v"), make).count() == 1 and made == [1]
    io.write_ids(rows, at("ids"), {"val": 0.15})
    assert [x.value for x in spark.read.text(at("ids")).collect()] == ["1", "1", "2"] and "0.15" in spark.read.text(at("ids.about")).first().value
    assert io.read_split(rows, io.read_ids(spark, at("ids")).where("doc_id = '2'")).first().doc_id == 2
    assert "| 2 | 0 | 1.0 |" in io.write_report(rows, at("r"), "Rows")
    with pytest.raises(ValueError):
        io.write_report(rows, at("r"), "Rows", 2)


def test_hooks(spark):
    s = spark.createDataFrame([(1, 0, "ab"), (1, 1, ""), (2, 0, "abcd")], "doc_id long, sent_idx int, sent string")
    load = lambda: lambda texts: [[len(t), 3.0] for t in texts]
    assert {tuple(x.vec) for x in io.encoded(s, load, 2).collect()} == {(2.0, 3.0), (0.0, 3.0), (4.0, 3.0)}
    assert (0.8, 0.6) in {tuple(x.vec) for x in io.encoded(s, load, unit=True).collect()} and io.encoded(s.limit(0), load).count() == 0
    docs = spark.createDataFrame([(1, "Mill Brook ran"), (2, " ")], "doc_id long, text string")
    assert [(x.text, x.label) for x in io.tagged(docs).collect()] == [("Mill Brook", "PROXY")]
    tag = lambda: lambda t: [(t.split()[0], "X")]
    assert [(x.doc_id, x.text, x.label) for x in io.tagged(docs, tag).collect()] == [(1, "Mill", "X")]
    assert io.tagger_name() == "rule" and io.tagger_name(tag) == "<lambda>"
    words = spark.createDataFrame([("boats",), ("red",)], "word string")
    lemmas = spark.createDataFrame([("boats", "boat")], "word string, lemma string")
    assert {x.word for x in io.lemmatized(words, lemmas).collect()} == {"boat", "red"} and io.lemmatized(words).count() == 2
    near = spark.createDataFrame([(" " * 60 + "x",), ("y" * 50,), (None,)], "t string").select(T.is_near_empty(F.col("t")).alias("n"), T.is_blank(F.col("t")).alias("b"))
    assert [(x.n, x.b) for x in near.collect()] == [(True, False), (False, False), (True, True)]


def test_features_by_configuration(spark):
    docs = spark.createDataFrame([(1, "Rain falls here. Sun shines. ..."), (2, "")], "doc_id long, text string")
    vocab = spark.createDataFrame([("rain", 1, 1.5), ("sun", 1, 1.5)], "term string, df long, idf double")
    lists = C.scored_lists(docs, vocab)
    c1 = {x.sent_idx: x for x in G.feature_rows(docs, lists, "C1", exact=True).collect()}
    assert set(c1) == {0, 1, 2} and c1[2].wmd == W.FALLBACK and c1[2].wmd_fallback and c1[0].tfidf == 1.0 and c1[1].position == round(1 / 3, 6)
    c3 = G.feature_rows(docs, lists, "C3")
    assert c3.columns == ["doc_id", "sent_idx", *G.CONFIGS["C3"]] and c3.count() == 3
    with pytest.raises(ValueError):
        G.feature_rows(docs, lists, "C4")


def test_relaxed_previous_against_its_definition():
    """Documents of odd sentences, taken whole and in runs of few cells; a pair of long sentences too."""
    rng = np.random.default_rng(9)
    docs = [[[f"w{i}" for i in rng.integers(0, 30, n)] for n in rng.integers(0, 9, m)] for m in (0, 1, 7, 12, 3)] + [[[f"v{i}" for i in rng.integers(0, 200, 150)], ["w1"], [f"v{i}" for i in rng.integers(0, 200, 90)], ["w2", "w2"], ["w2"]]]
    want = {}
    for d, sents in enumerate(docs):
        for k in range(1, len(sents)):
            if sents[k] and sents[k - 1]:
                a, b = W.Bag(sents[k]), W.Bag(sents[k - 1])
                want[d, k] = W.relaxed(a.share, b.share, a.costs(b))
    for cells in (200_000, 300, 1):
        got = {(d, k): x for d, k, x in zip(*map(np.ndarray.tolist, W.relaxed_previous(pa.array(docs, pa.list_(pa.list_(pa.string()))), cells)), strict=True)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_relaxed_previous_moves_no_words(spark):
    """The query's plan has the one exchange of a small input's documents, and neither joins nor sorts."""
    plan = __import__("inkstone.plans.catalog").plans.catalog.rwmd_previous(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_documents_filtered_in_step_as_by_themselves():
    """The threshold filter of many documents and deltas at once gives what its definition gives for each."""
    r = np.random.default_rng(21)
    documents = [[W.Bag([f"w{x}" for x in r.integers(0, 40, r.integers(0, 9))]) for _ in range(r.integers(1, 30))] for _ in range(12)]
    deltas = (0.6, 0.9, 1.2, 3.5)
    got = W.threshold_filters([(bags, 4) for bags in documents], deltas, 8)
    for bags, found in zip(documents, got, strict=True):
        for delta, (accepted, evaluated, rejected) in zip(deltas, found, strict=True):
            taken, seen = [], 0
            for i, b in enumerate(bags):
                if len(taken) >= 4:
                    break
                seen += 1
                if all(float(W.finite(W.distances([(b, bags[j])]))[0]) >= delta for j in taken):
                    taken.append(i)
            assert (accepted, evaluated, rejected) == (taken, seen, seen - len(taken))


def test_transports_of_a_batch_as_one_by_one():
    """Problems of other sizes and equal costs in one batch, padded: the cost of each alone, within its bounds."""
    r = np.random.default_rng(22)
    p, q, c = np.zeros((60, 9)), np.zeros((60, 14)), np.full((60, 9, 14), 4.0)
    for i in range(60):
        n, m = r.integers(1, 10), r.integers(1, 15)
        p[i, :n], q[i, :m] = r.multinomial(12, np.full(n, 1 / n)) / 12, r.multinomial(20, np.full(m, 1 / m)) / 20
        c[i, :n, :m] = r.integers(0, 5, (n, m)) if i % 2 else r.random((n, m))
    x = W.transport_batch(p, q, c)
    low, up = W.bounds(p, q, c)
    for i in range(60):
        a, b = p[i] > 0, q[i] > 0
        alone = W.transport(p[i, a], q[i, b], c[i][np.ix_(a, b)])
        back = W.transport(q[i, b], p[i, a], c[i][np.ix_(a, b)].T)
        assert abs(x[i] - alone) < 1e-9 and abs(x[i] - back) < 1e-9 and low[i] - 1e-9 <= x[i] <= up[i] + 1e-9
