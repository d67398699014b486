"""Transport within documents, as Column expressions, against the NumPy definitions."""

import numpy as np
from pyspark.sql import functions as F

from inkstone.functions import transport as X
from inkstone.operators import wmd as W
from inkstone.plans import catalog

KIND = "id long, toks array<array<string>>"


def sentences(seed: int, documents: int, most: int = 14) -> list[list[list[str]]]:
    """Documents of sentences that share words, some empty, equal, or with a word many times."""
    r = np.random.default_rng(seed)
    docs = [[[f"w{x}" for x in r.integers(0, 25, r.integers(0, most))] for _ in range(r.integers(1, 30))] for _ in range(documents)]
    docs[0] = [[], [], ["a"], ["a", "a"], ["b", "a"], ["a", "b"], ["é", "b"], [], [f"v{i}" for i in range(90)], [f"v{i}" for i in range(0, 240, 2)]]
    return docs


def test_distances_to_the_sentence_before(spark):
    docs = sentences(1, 25)
    got = spark.createDataFrame(list(enumerate(docs)), KIND).select("id", X.to_previous(spark, F.col("toks")).alias("d")).collect()
    assert len(got) == len(docs)
    for r in got:
        sents = docs[r.id]
        want = [0.0, *W.finite(W.distances([(W.Bag(b), W.Bag(a)) for a, b in zip(sents, sents[1:], strict=False)])).tolist()]
        assert np.allclose(r.d, want, rtol=0, atol=1e-9)


def test_wmd_exact_moves_no_words_and_leaves_the_engine_not(spark):
    """One exchange of a small input's documents, and no Python: 26 million pairs a GB do not pass through NumPy in time."""
    plan = catalog.wmd_exact(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


def test_filters_of_all_deltas_against_their_definition(spark):
    """Any order of deltas, one of them 0, and more sentences to pick than there are."""
    docs, deltas = sentences(2, 40, 24), (1.2, 0.7, 0.0, 1.0, 3.0, 3.5)
    x = spark.createDataFrame(list(enumerate(docs)), KIND)
    for k in (1, 4, 40):
        for r in x.select("id", X.filtered(spark, F.col("toks"), F.lit(k), deltas).alias("found")).collect():
            bags = [W.Bag(t) for t in docs[r.id]]
            want = [(d, *W.threshold_filter(bags, d, k)) for d in deltas]
            assert [(f.delta, f.picks, f.num_evaluated, f.num_rejected) for f in r.found] == want


def test_threshold_queries_leave_the_engine_not(spark):
    """No Python, and scores as arrays: documents stay in their rows after the scores."""
    for query in (catalog.threshold_select, catalog.delta_sweep):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_listed_scores_are_those_of_rows(spark):
    d = "/root/testdata/sf0.001"
    got = catalog._token_lists(spark, d).select("doc_id", F.explode("s").alias("r")).select("doc_id", "r.sent_idx", "r.score")
    want = catalog._scores(spark, d).select("doc_id", "sent_idx", "score")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
