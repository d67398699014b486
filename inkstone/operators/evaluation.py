"""Overlap, rank correlation, redundancy, statistics, alignment, scaling and scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators.selection import ranked


def jaccard(a: Column, b: Column) -> Column:
    """SO2: 1 if both are empty."""
    return F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))))


def recall(truth: Column, found: Column) -> Column:
    """SO3: 1 if the truth is empty."""
    return F.when(F.size(truth) == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(truth, found)), F.size(truth)))


def floor_percentiles(df: DataFrame, col: str, shares: list[float]) -> DataFrame:
    """AG3/AG4: sorted[int(n * p)], as counts of equal values summed up: a row a value, not a row a row."""
    counts = df.groupBy(F.col(col).alias("v")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v")))
    n = F.max("upto").over(Window.partitionBy())
    at = upto.withColumn("n", n)
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(p)), F.col("v"))).alias(f"p{round(p * 100)}") for p in shares]
    return at.agg(*picks)


def average_ranks(df: DataFrame, key: str, value: str, out: str) -> Column:
    """Rank within the key, ties share their mean rank."""
    w = Window.partitionBy(key)
    return (F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(key, value)) - 1) / 2.0).alias(out)


def inversions(y: np.ndarray) -> int:
    """How many pairs stand in falling order, by merging runs of doubling length, all runs of a length at once."""
    n, total, width = len(y), 0, 1
    y = np.unique(y, return_inverse=True)[1].astype(np.int64)
    while width < n:
        run = np.arange(n) // width
        key = (run // 2) * (n + 1) + y  # sorted inside every run of ``width``
        left = run % 2 == 0
        a, b = key[left], key[~left]
        ends = np.searchsorted(a, (run[~left] // 2 + 1) * (n + 1))  # behind the run's partner
        total += int((ends - np.searchsorted(a, b, side="right")).sum())
        y = y[np.lexsort((y, run // 2))]
        width *= 2
    return total


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b of any number of rows in n log n steps; 0 where undefined."""
    n = len(x)
    pairs = lambda c: int((c * (c - 1) // 2).sum())
    tied = [pairs(np.unique(v, return_counts=True, axis=0)[1]) for v in (x, y, np.stack([x, y], 1))] if n else [0, 0, 0]
    every = n * (n - 1) // 2
    order = np.lexsort((y, x))
    span = np.sqrt(float(every - tied[0])) * np.sqrt(float(every - tied[1]))
    return float((every - tied[0] - tied[1] + tied[2] - 2 * inversions(y[order])) / span) if span else 0.0


def rank_correlation(df: DataFrame, key: str, item: str, x: str, y: str) -> DataFrame:
    """M15/M16 by key: Spearman's rho and Kendall's tau-b; 0 where undefined; keys with two items or more."""
    r = df.select(key, x, y, average_ranks(df, key, x, "rx"), average_ranks(df, key, y, "ry"))
    n, sx, sy, sxy, sxx, syy = F.count("*"), F.sum("rx"), F.sum("ry"), F.sum(F.col("rx") * F.col("ry")), F.sum(F.col("rx") * F.col("rx")), F.sum(F.col("ry") * F.col("ry"))
    rho = F.try_divide(n * sxy - sx * sy, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))
    lists = r.groupBy(key).agg(n.alias("m"), rho.alias("rho"), F.collect_list(F.col(x).cast("double")).alias("xs"), F.collect_list(F.col(y).cast("double")).alias("ys")).where("m >= 2")

    def tau(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [kendall(p.values.to_numpy(zero_copy_only=False), q.values.to_numpy(zero_copy_only=False)) for p, q in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t, pa.float64())], [key, "rho", "tau_b"])

    out = lists.select(key, "rho", "xs", "ys").mapInArrow(tau, f"{key} {dict(df.dtypes)[key]}, rho double, tau_b double")
    return out.select(key, F.round(F.coalesce("rho", F.lit(0.0)), 6).alias("rho"), F.round("tau_b", 6).alias("tau_b"))


def global_kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """M16 over all rows: (n, tau_b), by counts of equal pairs; one task merges a row a distinct pair of values."""
    pairs = df.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("w")).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        a, b, w = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.empty(0), np.empty(0), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([int(w.sum())]), pa.array([weighted_kendall(a, b, w)])], ["n", "tau_b"])

    return pairs.mapInArrow(run, "n long, tau_b double").select("n", F.round("tau_b", 6).alias("tau_b"))


def weighted_kendall(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Tau-b of distinct (x, y) pairs that occur ``w`` times: a tree of sums counts the weight above each y among smaller x."""
    if not len(x):
        return 0.0
    total = int(w.sum())
    pairs = lambda c: int((c * (c - 1) // 2).sum())
    sums = lambda v: np.bincount(np.unique(v, return_inverse=True)[1], w).astype(np.int64)
    every, tx, ty, txy = total * (total - 1) // 2, pairs(sums(x)), pairs(sums(y)), pairs(w)
    ranks = np.unique(y, return_inverse=True)[1] + 1
    size, falling = int(ranks.max()) + 1, 0
    tree, seen = [0] * (size + 1), 0
    order = np.lexsort((y, x))
    xs, rs, ws = x[order], ranks[order].tolist(), w[order].tolist()
    edges = np.r_[np.flatnonzero(np.r_[True, xs[1:] != xs[:-1]]), len(xs)]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for k in range(a, b):
            i, below = rs[k], 0
            while i:
                below += tree[i]
                i &= i - 1
            falling += ws[k] * (seen - below)
        for k in range(a, b):
            i = rs[k]
            while i <= size:
                tree[i] += ws[k]
                i += i & -i
            seen += ws[k]
    span = np.sqrt(float(every - tx)) * np.sqrt(float(every - ty))
    return float((every - tx - ty + txy - 2 * falling) / span) if span else 0.0


def p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation of n rows, by Student's t with n - 2 degrees; 1 where undefined.

    The distribution is an incomplete beta function, by its continued fraction.
    """
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    a, b, x = (n - 2) / 2.0, 0.5, 1 - r * r  # p = I_x(a, b)

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        out = d
        for k in range(1, 10_000):
            for t in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
                d, c = 1 / (1 + t * d or 1e-300), 1 + t / c or 1e-300
                out *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x < 1 else 0.0
    if x < 1 and x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def global_spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """M15 over all rows: (n, rho), 0 where undefined.  Ranks come from counts of equal values: the ordered pass has a row a value."""

    def ranks(c: str) -> DataFrame:
        v = df.groupBy(F.col(c).alias(f"v_{c}")).agg(F.count("*").alias("c"))
        return v.select(f"v_{c}", (F.sum("c").over(Window.orderBy(f"v_{c}")) - (F.col("c") - 1) / 2.0).alias(f"r_{c}"))

    pairs = df.groupBy(x, y).agg(F.count("*").alias("w"))
    r = pairs.join(ranks(x), F.col(x) == F.col(f"v_{x}")).join(ranks(y), F.col(y) == F.col(f"v_{y}"))
    mid = r.agg(F.sum("w").alias("n"))
    a, b, w = (F.col(c) for c in ("a", "b", "w"))
    d = r.crossJoin(F.broadcast(mid)).select("n", "w", (F.col(f"r_{x}") - (F.col("n") + 1) / 2.0).alias("a"), (F.col(f"r_{y}") - (F.col("n") + 1) / 2.0).alias("b"))
    rho = F.try_divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a) * F.sum(w * b * b)))
    return d.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.round(F.coalesce(rho, F.lit(0.0)), 6).alias("rho"))


def chance(sizes: DataFrame) -> DataFrame:
    """M18 in closed form: expected recall k/M and expected Jaccard of two random k-sets."""
    k = F.least(T.budget(F.col("m")), F.col("m").cast("int"))
    d = sizes.select("doc_id", F.col("m").cast("double").alias("m"), k.alias("k"))
    # p(h) = p(h-1) * (k-h+1)^2 / (h * (m-2k+h)), from the first feasible h on
    lo = F.greatest(F.lit(0), 2 * F.col("k") - F.col("m").cast("int"))
    d = d.withColumn("h", F.explode(F.sequence(lo, F.col("k"))))
    lc = lambda n, r: F.aggregate(F.when(r > 0, F.sequence(F.lit(1), r)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.log((n - r + i).cast("double") / i))
    p = F.exp(lc(F.col("k"), F.col("h")) + lc(F.col("m").cast("int") - F.col("k"), F.col("k") - F.col("h")) - lc(F.col("m").cast("int"), F.col("k")))
    return d.groupBy("doc_id").agg(F.round(F.sum(p * F.col("h") / (2 * F.col("k") - F.col("h"))), 6).alias("ej"), F.round(F.max(F.col("k") / F.col("m")), 6).alias("er"))


def distinct_n(tokens: DataFrame, n: int) -> DataFrame:
    """AG13 over (doc_id, toks): distinct n-grams / n-grams; no tokens 0, fewer than n 1."""
    g = T.ngrams(F.col("toks"), n)
    return tokens.select("doc_id", F.round(F.when(F.size("toks") == 0, 0.0).when(F.size("toks") < n, 1.0).otherwise(F.try_divide(F.size(F.array_distinct(g)), F.size(g))), 6).alias(f"distinct_{n}"))


def self_bleu_2(sents: DataFrame) -> DataFrame:
    """M9/AG15: mean over sentences of BLEU-2 against the document's other sentences.

    (doc_id, sent_idx, toks) rows.  Clipped counts need, for each n-gram, the largest count in any *other* sentence:
    the largest of the document, or the second largest for the sentence that holds it.  So grams are grouped by
    (doc_id, gram) and no pair of sentences is made.  Smoothing: zero numerators count 0.1, but no common word gives 0.
    The brevity penalty takes the nearest other length, the shorter of two as near: a neighbour by length.
    """
    s = sents.where(F.size("toks") > 0).select("doc_id", "sent_idx", "toks", F.size("toks").alias("len"))
    w = Window.partitionBy("doc_id")
    by = w.orderBy("len", "sent_idx")
    s = s.withColumn("n", F.count("*").over(w)).withColumn("less", F.lag("len").over(by)).withColumn("more", F.lead("len").over(by))
    near = F.when(F.col("more").isNull() | (F.col("len") - F.col("less") <= F.col("more") - F.col("len")), F.col("less")).otherwise(F.col("more"))
    s = s.withColumn("ref", near).drop("less", "more")
    parts = []
    for k in (1, 2):
        g = s.select("doc_id", "sent_idx", F.explode(T.ngrams(F.col("toks"), k)).alias("g")).groupBy("doc_id", "sent_idx", "g").agg(F.count("*").alias("c"))
        best = Window.partitionBy("doc_id", "g").orderBy(F.desc("c"), "sent_idx")
        r = g.withColumn("rn", F.row_number().over(best)).withColumn("c1", F.first("c").over(best)).withColumn("c2", F.coalesce(F.nth_value("c", 2).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0)))
        clip = F.least("c", F.when(F.col("rn") == 1, F.col("c2")).otherwise(F.col("c1")))
        parts.append(r.groupBy("doc_id", "sent_idx").agg(F.sum(clip).alias(f"hit{k}"), F.sum("c").alias(f"all{k}")))
    x = s.join(parts[0], ["doc_id", "sent_idx"]).join(parts[1], ["doc_id", "sent_idx"], "left")
    p = [F.when(F.coalesce(F.col(f"hit{k}"), F.lit(0)) == 0, 0.1).otherwise(F.col(f"hit{k}").cast("double")) / F.greatest(F.coalesce(F.col(f"all{k}"), F.lit(0)), F.lit(1)) for k in (1, 2)]
    bp = F.when(F.col("len") > F.col("ref"), 1.0).otherwise(F.exp(1.0 - F.col("ref") / F.col("len")))
    bleu = F.when((F.col("n") < 2) | (F.col("hit1") == 0), 0.0).otherwise(bp * F.exp((F.log(p[0]) + F.log(p[1])) / 2))
    return x.groupBy("doc_id").agg(F.round(F.avg(bleu), 6).alias("self_bleu_2"))


def robust_params(df: DataFrame, features: list[str]) -> DataFrame:
    """AG22: (feature, center, scale): median and interquartile range, 1 if that is 0; exact percentiles."""
    q = df.agg(*[F.expr(f"percentile({f}, array(0.25, 0.5, 0.75))").alias(f) for f in features])
    long = q.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("q")) for f in features])).alias("x")).select("x.*")
    iqr = F.col("q")[2] - F.col("q")[0]
    return long.select("feature", F.col("q")[1].alias("center"), F.when(iqr == 0, 1.0).otherwise(iqr).alias("scale"))


def standard_params(df: DataFrame, features: list[str]) -> DataFrame:
    """ML2, standard: mean and population deviation."""
    rows = [df.agg(F.lit(f).alias("feature"), F.avg(f).alias("center"), F.stddev_pop(f).alias("scale")) for f in features]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


SCALERS = {"robust": robust_params, "standard": standard_params}


def scale(df: DataFrame, params: DataFrame, features: list[str]) -> DataFrame:
    """ML3: (x - center) / scale; the parameters are a row a feature."""
    wide = fitted(params).groupBy().pivot("feature", features).agg(F.first("center").alias("c"), F.first("scale").alias("s"))
    return df.crossJoin(F.broadcast(wide)).select(*[c for c in df.columns if c not in features], *[((F.col(f) - F.col(f"{f}_c")) / F.col(f"{f}_s")).alias(f) for f in features])


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """AG19, PF14."""
    e = F.col(y) - F.col(p)
    out = df.agg(F.count("*").alias("n"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count("*"))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return out.withColumn("negative_r2", F.col("r2") < 0)


def rank_diagnostics(df: DataFrame, key: str, item: str, y: str, p: str, high: float = 0.8) -> DataFrame:
    """W4-W6, W9 by key: percentile rank of the true best, ranks of high labels, how many of them are selected, spread of predictions."""
    r = ranked(df.select(key, item, y, F.col(p).alias("score"), *(["m"] if "m" in df.columns else [])), key, item, "score")
    best = F.max(F.struct(y, (-F.col("rn")).alias("r")))
    r = r.withColumn("ry", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(y), F.desc(item))))
    true_top = F.col("ry") <= T.budget(F.col("m"))
    hi, top = F.col(y) >= high, F.col("rn") <= T.budget(F.col("m"))
    return r.groupBy(key).agg(F.max("m").alias("m"), F.round(-best.getField("r") / F.max("m"), 6).alias("best_pct"), F.round(F.avg(F.when(true_top, F.col("rn"))) / F.max("m"), 6).alias("top_pct"), F.count(F.when(hi, 1)).alias("n_high"), F.count(F.when(hi & top, 1)).alias("n_high_top"), F.round(F.avg(F.when(hi, F.col("rn"))), 6).alias("mean_high_rank"), F.round(F.max("score") - F.min("score"), 7).alias("spread"), F.round(F.stddev_pop("score"), 4).alias("std"))


def alignment(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """J9, AG23, AG24: (check, n_bad): keys on one side only, NaN, infinite values, and values that differ."""
    x, y = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_a")), b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("_b"))
    j = x.join(y, keys, "full")
    checks = {"only_left": F.col("_b").isNull(), "only_right": F.col("_a").isNull()} | {f"nan_{c}": F.isnan(F.col(f"a_{c}").cast("double")) for c in cols} | {f"inf_{c}": F.abs(F.col(f"a_{c}").cast("double")) == float("inf") for c in cols} | {f"differs_{c}": ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in cols}
    sums = j.agg(*[F.count(F.when(v, 1)).alias(k) for k, v in checks.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n_bad")) for k in checks])).alias("x")).select("x.*")


def max_difference(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """AG24: (feature, max_abs_diff) over the keys that both tables hold; 0 without any."""
    j = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols]), keys)
    most = j.agg(*[F.coalesce(F.max(F.abs(F.col(f"a_{c}").cast("double") - F.col(f"b_{c}").cast("double"))), F.lit(0.0)).alias(c) for c in cols])
    return most.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("max_abs_diff")) for c in cols])).alias("x")).select("x.*")


def fitted(params: DataFrame | None) -> DataFrame:
    """ML3: scaling parameters, or an error before they were fitted."""
    if params is None:
        raise ValueError("the scaler is not fitted")
    return params


def fit_transform(df: DataFrame, features: list[str], kind: str = "robust") -> tuple[DataFrame, DataFrame]:
    """ML2-ML4: the scaled table and the parameters (feature, center, scale) that made it; an unknown kind raises."""
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind!r}; known: {', '.join(SCALERS)}")
    params = SCALERS[kind](df, features)
    return scale(df, params, features), params
