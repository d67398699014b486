"""The query of boosted scores fits every tree on the features of a configuration."""

import inspect

import pytest

from inkstone.operators import scoring as G
from inkstone.plans import catalog


class Stop(Exception):
    pass


def test_gbt_scores_fits_all_trees_on_a_configuration(spark, monkeypatch):
    whole = inspect.signature(G.fit)

    def fit(*args, **kw):
        a = whole.bind(*args, **kw)
        a.apply_defaults()
        assert a.arguments["trees"] == 100 and tuple(a.arguments["features"]) in G.CONFIGS.values()
        raise Stop

    monkeypatch.setattr(G, "fit", fit)
    with pytest.raises(Stop):
        catalog.gbt_scores(spark, "/root/testdata/sf0.001")


def test_gbt_scores_reads_only_documents_with_references(spark, monkeypatch):
    """What it splits and scores are those documents, with the features that they have among all."""
    d, seen = "/root/testdata/sf0.001", {}

    def feature_rows(docs, *args, **kw):
        seen["docs"], seen["x"] = docs, whole(docs, *args, **kw)
        return seen["x"]

    def fit(*args, **kw):
        raise Stop

    want = catalog.c3_features(spark, d)
    whole = G.feature_rows
    monkeypatch.setattr(G, "feature_rows", feature_rows)
    monkeypatch.setattr(G, "fit", fit)
    with pytest.raises(Stop):
        catalog.gbt_scores(spark, d)
    refs = catalog._references(spark, d).select("doc_id").distinct()
    assert seen["docs"].count() and not seen["docs"].join(refs, "doc_id", "left_anti").count()
    want = want.join(refs, "doc_id", "left_semi")
    assert want.count() and sorted(want.collect()) == sorted(seen["x"].collect())
