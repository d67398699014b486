"""Selection of k sentences a document: top-k, MMR, threshold filter, samples and splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions import transport as X


def ranked(scores: DataFrame, key: str, item: str, score: str) -> DataFrame:
    """Rn, 1 for the best; ties go to the higher index.  m is the number of items, counted where the rows lack it."""
    w = Window.partitionBy(key)
    scores = scores.withColumn("rn", F.row_number().over(w.orderBy(F.desc(score), F.desc(item))))
    return scores if "m" in scores.columns else scores.withColumn("m", F.count("*").over(w))


def top_k(scores: DataFrame, key: str = "doc_id", item: str = "sent_idx", score: str = "score") -> DataFrame:
    """TK4 with TK3's budget."""
    return ranked(scores, key, item, score).where(F.col("rn") <= T.budget(F.col("m"))).select(key, item, "rn")


def budget_of(m: int) -> int:
    return max(3, round(0.05 * m))


def mmr(scores: np.ndarray, vectors: np.ndarray, k: int, lam: float) -> list[int]:
    """TK5: the best score, then the best lam * score - (1 - lam) * nearest cosine; ties go to the lower index.

    One pass of products a pick and a running maximum: memory is that of the vectors, not of all pairs.
    """
    n = len(scores)
    if not n:
        return []
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, length, out=np.zeros_like(vectors, dtype=float), where=length > 0)
    near, left, out = np.full(n, -np.inf), np.ones(n, bool), []
    for _ in range(min(k, n)):
        value = scores if not out else lam * scores - (1 - lam) * near
        pick = int(np.where(left, value, -np.inf).argmax())
        out.append(pick)
        left[pick] = False
        near = np.maximum(near, np.clip(unit @ unit[pick], -1, 1))
    return out


def mmr_select(df: DataFrame, key: str, item: str, score: str, vec: str, lam: float, k: int | None = None) -> DataFrame:
    """(key, step, item, under_filled): greedy MMR a key; items come in item order."""
    kinds = dict(df.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(item).reset_index(drop=True)
        want = budget_of(len(g)) if k is None else k
        picks = mmr(g[score].to_numpy(float), np.stack(g[vec].to_numpy()).astype(float), want, lam)
        return pd.DataFrame({key: g[key].iloc[0], "step": range(1, len(picks) + 1), item: g[item].iloc[picks].to_numpy(), "under_filled": len(picks) < min(want, len(g))})

    return df.select(key, item, score, vec).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, step int, {item} {kinds[item]}, under_filled boolean")


def mmr_lists(df: DataFrame, lam: float) -> DataFrame:
    """``df`` without ``scores`` and ``vecs``, with ``picked`` and ``ordered``: TK5 over rows that each hold a document.

    ``scores`` is an array, ``vecs`` holds (sent_idx, vec) of the sentences that have a vector.  A document is a row
    already, so nothing is grouped or moved.
    """
    kinds, kind = dict(df.dtypes), pa.list_(pa.int32())
    others = [c for c in df.columns if c not in ("scores", "vecs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index
            out = []
            for scores, vecs in zip(b.column(at("scores")), b.column(at("vecs")).to_pylist(), strict=True):
                x = scores.values.to_numpy(zero_copy_only=False)
                v = np.zeros((len(x), len(vecs[0]["vec"]) if vecs else 1))
                for r in vecs or ():
                    v[r["sent_idx"]] = r["vec"]
                out.append(mmr(x, v, budget_of(len(x)), lam))
            yield pa.RecordBatch.from_arrays([*(b.column(at(c)) for c in others), pa.array(out, kind), pa.array([sorted(x) for x in out], kind)], [*others, "picked", "ordered"])

    return df.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in others) + ", picked array<int>, ordered array<int>")


def threshold_select(x: DataFrame, deltas: tuple[float, ...]) -> DataFrame:
    """TK6 on exact transport, a row for each document and delta; (doc_id, sent_idx, score, toks) rows."""
    return threshold_lists(x.groupBy("doc_id").agg(F.collect_list(F.struct("score", "sent_idx", "toks")).alias("s")), deltas)


def threshold_lists(x: DataFrame, deltas: tuple[float, ...]) -> DataFrame:
    """``threshold_select`` of (doc_id, s) rows that each hold a document, s its (score, sent_idx, toks); nothing is moved.

    The best score comes first, ties to the higher index.
    """
    x = x.select("doc_id", F.sort_array("s", asc=False).alias("s"))
    k = F.least(T.budget(F.size("s")), F.size("s"))
    found = X.filtered(x.sparkSession, F.transform("s", lambda r: r["toks"]), k, deltas)
    x = x.select("doc_id", F.transform("s", lambda r: r["sent_idx"]).alias("at"), k.alias("k_i"), F.explode(found).alias("f"))
    x = x.select("doc_id", "f.delta", F.transform("f.picks", lambda i: F.get("at", i)).alias("selected"), "k_i", "f.num_evaluated", "f.num_rejected")
    n = F.size("selected")
    return x.select("doc_id", "delta", "selected", F.array_sort("selected").alias("ordered"), "k_i", "num_evaluated", "num_rejected", (n / F.col("k_i")).alias("budget_fulfillment"), (n < F.col("k_i")).alias("under_filled"))


def stratified_sample(sizes: DataFrame) -> DataFrame:
    """TK12: all short documents and 11 next to them, 20 of 50..350, 15 of over 500, by hash."""
    h = F.md5(F.col("doc_id").cast("string"))
    stratum = F.when(F.col("m") < 20, "short").when(F.col("m") <= 45, "edge").when(F.col("m").between(50, 350), "medium").when(F.col("m") > 500, "long")
    x = sizes.withColumn("stratum", stratum).where("stratum is not null")
    order = F.when(F.col("stratum") == "edge", F.lpad(F.col("m").cast("string"), 6, "0")).otherwise(h)
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("stratum").orderBy(order, "doc_id")))
    most = F.when(F.col("stratum") == "edge", 11).when(F.col("stratum") == "medium", 20).when(F.col("stratum") == "long", 15)
    return x.where((F.col("stratum") == "short") | (F.col("rn") <= most)).select("doc_id", "m", "stratum")


def hash_split(docs: DataFrame, val: float = 0.15, test: int = 100, ids: list[DataFrame] | None = None) -> DataFrame:
    """SO5/SO6: (doc_id, part): by md5 order the first ``test`` documents, then a ``val`` share of the rest, then train.

    ``ids`` are frozen lists (test, val) that replace the rule; fewer documents than ``test`` raise.  The cuts are two
    order statistics of the hashes, both narrowed at once by counts of 4,096 ranges: a scan or two of the ids, no
    row number over all documents, and at most 8,192 rows at the driver.
    """
    if ids is not None:
        known = ids[0].select("doc_id", F.lit("test").alias("part")).unionByName(ids[1].select("doc_id", F.lit("val").alias("part"))).distinct()
        return docs.select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("part", F.lit("train")).alias("part"))
    h = docs.select("doc_id", F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long").alias("h"))
    n = h.count()
    if n < test:
        raise ValueError(f"{n} documents are too few for {test} test documents")
    wants, cuts = [test, test + int((n - test) * val)], [(0, 0), (0, 0)]  # prefix, documents below it
    for bits in (48, 36, 24, 12, 0):
        prefixes = {p for p, _ in cuts}
        top = h.where(F.shiftright("h", bits + 12).isin(list(prefixes))).groupBy(F.shiftright("h", bits).alias("b")).count().collect()
        counts = {r.b: r["count"] for r in top}
        done = True
        for i, (p, below) in enumerate(cuts):
            at = p << 12
            while at < (p + 1) << 12 and below + counts.get(at, 0) < wants[i]:
                below += counts.get(at, 0)
                at += 1
            cuts[i] = (at, below)
            done = done and below + counts.get(at, 0) == wants[i]
        if done or not bits:
            break
    ends = [((p + 1) << bits) - 1 if want else -1 for (p, _), want in zip(cuts, wants, strict=True)]
    return h.select("doc_id", F.when(F.col("h") <= ends[0], "test").when(F.col("h") <= ends[1], "val").otherwise("train").alias("part"))


def first_seen(rows: DataFrame, key: str, place: str) -> DataFrame:
    """SO7: (key, place): distinct keys by where each is first."""
    return rows.groupBy(key).agg(F.min(place).alias(place)).orderBy(place, key)


def overlap(a: DataFrame, b: DataFrame, key: str = "doc_id") -> int:
    """How many keys, as text (J10), both tables hold; a split must have none."""
    return a.select(F.col(key).cast("string").alias("k")).intersect(b.select(F.col(key).cast("string").alias("k"))).count()


def sample_is_whole(sample: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """TK12's assertion: the sample, or an error where a stratum has other than its quota."""
    got = {r.stratum: r["count"] for r in sample.groupBy("stratum").count().collect()}  # a row a stratum
    wrong = {k: (got.get(k, 0), n) for k, n in quotas.items() if got.get(k, 0) != n}
    if wrong:
        raise ValueError(f"strata with other sizes than wanted: {wrong}")
    return sample
