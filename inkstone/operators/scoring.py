"""Gradient-boosted importance scores and the feature configurations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions import vectors as V
from inkstone.operators import corpus as C
from inkstone.operators import wmd as W

# fixed values: the order of features by configuration
CONFIGS = {
    "C1": ("tfidf", "ner", "position", "cosine_w2v", "wmd"),
    "C2": ("tfidf", "ner", "position", "cosine_w2v", "wmd"),
    "C3": ("tfidf", "ner", "position", "cosine_sbert"),
}


def features_of(config: str) -> tuple[str, ...]:
    """PF12: an unknown configuration raises."""
    if config not in CONFIGS:
        raise ValueError(f"unknown configuration {config!r}; known: {', '.join(CONFIGS)}")
    return CONFIGS[config]


def document_distances(lists: DataFrame, exact: bool = False) -> DataFrame:
    """M8: (doc_id, sent_idx, wmd, wmd_fallback) of (doc_id, sents) rows: distance of each sentence to its document.

    ``exact`` solves the transport; without it the relaxed distance, its lower bound, is taken.  A document is a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for doc, toks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d, mask = (W.to_document if exact else W.relaxed_to_document)(toks)
                for c, x in zip(cols, ([doc] * len(toks), range(len(toks)), np.round(d, 6).tolist(), mask.tolist()), strict=True):
                    c.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], ["doc_id", "sent_idx", "wmd", "wmd_fallback"])

    toks = lists.select("doc_id", F.transform("sents", T.tokens_a).alias("toks"))
    return toks.mapInArrow(run, f"doc_id {dict(lists.dtypes)['doc_id']}, sent_idx int, wmd double, wmd_fallback boolean")


def feature_rows(docs: DataFrame, lists: DataFrame, config: str, vectors: DataFrame | None = None, encoder=None, exact: bool = False) -> DataFrame:
    """ML1: (doc_id, sent_idx, the features of ``config``) from documents and their ``corpus.scored_lists``.

    C3 needs sentence embeddings: ``encoder`` maps (doc_id, sent_idx, sent) rows to (doc_id, sent_idx, vec) (IO9, M5);
    without one the mean of word vectors stands in.  C1 and C2 take word vectors, from ``vectors`` or by hash.
    """
    names = features_of(config)
    s = C.sentences(docs)
    sbert = "cosine_sbert" in names
    vecs = encoder(s) if sbert and encoder else C.sentence_vectors(s, vectors=vectors)
    cos = C.centroid_cosine(vecs, "doc_id", "sent_idx", "vec", V.DIM)
    per = cos.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("sent_idx", "cos"))).alias("cos"))
    x = lists.join(per, "doc_id", "left").select("doc_id", "cos", F.size("sents").alias("m"), F.posexplode(F.arrays_zip("sents", "tfidf")).alias("sent_idx", "x"))
    x = x.select(
        "doc_id", "sent_idx", F.col("x.tfidf").alias("tfidf"), T.ner_proxy(F.col("x.sents")).cast("double").alias("ner"), F.round(F.col("sent_idx") / F.col("m"), 6).alias("position"),
        F.coalesce(F.col("cos")[F.col("sent_idx")], F.lit(0.0)).alias("cosine_sbert" if sbert else "cosine_w2v"),
    )
    if "wmd" in names:
        x = x.join(document_distances(lists, exact), ["doc_id", "sent_idx"])
        return x.select("doc_id", "sent_idx", *names, "wmd_fallback")
    return x.select("doc_id", "sent_idx", *names)


def assemble(df: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error").transform(df)


def fit(df: DataFrame, features, label: str = "y", trees: int = 100, seed: int = 42) -> GBTRegressionModel:
    """ML5: squared loss, depth 4, 50 rows a leaf at least, 0.8 of the rows a tree."""
    gbt = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="y_hat", maxIter=trees, stepSize=0.1, maxDepth=4, minInstancesPerNode=50, subsamplingRate=0.8, lossType="squared", seed=seed)
    rows = assemble(df, features).select("_features", label).persist()  # every tree reads them
    try:
        return gbt.fit(rows)
    finally:
        rows.unpersist()


def predict(model: GBTRegressionModel, df: DataFrame, features) -> DataFrame:
    """ML6: ``y_hat``; an empty table stays empty."""
    return model.transform(assemble(df, features)).drop("_features")


def save(model: GBTRegressionModel, path: str) -> None:
    """ML7."""
    model.write().overwrite().save(path)


def load(path: str) -> GBTRegressionModel:
    return GBTRegressionModel.load(path)


def same_scorer(a: GBTRegressionModel, b: GBTRegressionModel, df: DataFrame, features, most: float = 1e-6) -> bool:
    """ML8: whether two models score ``df`` alike and weigh the features alike."""
    x = predict(a, df, features).withColumnRenamed("y_hat", "y_a")
    diff = predict(b, x, features).agg(F.max(F.abs(F.col("y_a") - F.col("y_hat")))).first()[0] or 0.0
    return diff <= most and all(abs(p - q) <= most for p, q in zip(a.featureImportances.toArray(), b.featureImportances.toArray(), strict=True))


def importances(model: GBTRegressionModel, features) -> list[tuple[str, float]]:
    """AG20."""
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def linear_proxy():
    """A fixed score for queries that SQL must repeat: weight by TF-IDF, less for late sentences."""
    return F.round(F.col("tfidf") - 0.5 * F.col("pos"), 7)
