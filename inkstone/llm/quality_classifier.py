"""Quality classifier: a factorisation machine (operator 8).

Features: words hashed into ``BUCKETS`` (square root of the count, scaled to
unit length), statistics of structure and length, and metadata: the length that
the row declares (``n_chars``; the text's own where it has none), whether that is
another than the text's, and the shares of bytes outside ASCII and of bytes that
begin characters beyond Latin scripts.  Labels, lang, source and doc_id are never
inputs.  The machine has a weight
and ``FACTORS`` latent factors for each feature; the interactions of all pairs
are scored in linear time by the sum-of-squares identity
  sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

It is fitted on at most ``SAMPLE`` labelled documents, those of the least id
hashes, one text an id (the least of several, before anything is collected), whose
features (not texts) reach the driver: at most SAMPLE times
BUCKETS numbers, in practice some hundreds a document.

Defined results.  Null or empty text has only structure statistics, and a score.
Rows of ``labels`` without a 0/1 quality, and ids labelled both 0 and 1, are
ignored.  Without labelled rows, or
with one class alone, the score is the labels' share of 1 (0.5 without any).
Repeated rows score alike; extra input columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import slices, table, texts_of

BUCKETS, FACTORS, SAMPLE, EPOCHS, BATCH, SEED = 1 << 15, 8, 3000, 8, 32, 8
THRESHOLD = 0.7
STATS = ("words", "chars", "word_length", "symbols", "pipes", "exclaims", "upper", "digits", "repeat_lines", "stutter", "variety", "line_words", "declared", "misdeclared", "non_ascii", "far_scripts")
#: Words remembered by one worker before it starts afresh.
CACHE = 400_000


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = b = zlib.crc32(word) & (BUCKETS - 1)
        return b


def structure(raw: bytes, words: list[bytes], distinct: int, declared: int | None = None) -> list[float]:
    n, chars = max(len(words), 1), max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    joined = b"".join(words)
    upper = len(joined) - len(joined.translate(None, UPPER))
    digits = len(joined) - len(joined.translate(None, b"0123456789"))
    symbols = len(joined) - len(joined.translate(None, b"#*$%&|<>"))
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    high = raw.translate(None, ASCII)
    lead = len(high.translate(None, TAIL))  # bytes that begin a character beyond ASCII
    own = len(raw) - len(high) + lead
    # Every statistic lies in 0..1, so that none outweighs the words.
    return [
        min(np.log1p(len(words)) / 10, 1), min(np.log1p(len(raw)) / 14, 1), min(len(joined) / n / 15, 1), min(symbols / n, 1), min(raw.count(b"|") / n, 1), min(raw.count(b"!") / n, 1),
        upper / chars, digits / chars, 1 - len(set(lines)) / max(len(lines), 1), stutter / n, distinct / n, min(n / max(len(lines), 1) / 100, 1),
        min(np.log1p(max(own if declared is None else declared, 0)) / 14, 1), float(declared is not None and declared != own), len(high) / chars, len(high.translate(None, NEAR)) / chars,
    ]


UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII, TAIL = bytes(range(128)), bytes(range(128, 192))
NEAR = bytes(range(128, 0xCA))  # UTF-8 of Latin letters begins below 0xCA


def featurize(texts: list[bytes], buckets: Buckets, declared: list[int | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR of all texts: feature ids, values, and where each text begins; statistics follow the BUCKETS words."""
    if len(buckets) > CACHE:
        buckets.clear()
    ids, values, starts = [], [], [0]
    stats = np.arange(BUCKETS, BUCKETS + len(STATS))
    for raw, length in zip(texts, declared or [None] * len(texts), strict=True):
        words = raw.split()
        found, count = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), return_counts=True)
        x = np.sqrt(count.astype(np.float64))
        ids += [found, stats]
        values += [x / max(np.sqrt((x * x).sum()), 1e-12), np.array(structure(raw, words, len(found), length))]
        starts.append(starts[-1] + len(found) + len(stats))
    return np.concatenate(ids) if ids else np.empty(0, np.int64), np.concatenate(values) if values else np.empty(0), np.array(starts)


@dataclass
class Machine:
    """Weights of all features: bias, linear part, factors."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) < 2:
            return np.empty(0)
        v = self.factors[ids] * x[:, None]
        s, q = np.add.reduceat(v, starts[:-1]), np.add.reduceat(v * v, starts[:-1])
        return self.bias + np.add.reduceat(self.linear[ids] * x, starts[:-1]) + 0.5 * (s * s - q).sum(1)


def fit(ids: np.ndarray, x: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """Logistic loss, Adagrad, mini-batches in a seeded order."""
    rng, size = np.random.default_rng(seed), BUCKETS + len(STATS)
    share = float(y.mean()) if len(y) else 0.5
    m = Machine(float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
    if not 0 < share < 1:
        return Machine(0.0 if not len(y) else (30.0 if share else -30.0), np.zeros(size), np.zeros((size, FACTORS)))
    gl, gv, rate, decay = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 0.3, 1e-5
    lengths = np.diff(starts)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            take = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
            begin = np.r_[0, np.cumsum(lengths[rows])]
            i, v = ids[take], x[take]
            g = 1 / (1 + np.exp(-np.clip(m.logits(i, v, begin), -30, 30))) - y[rows]
            per = np.repeat(g, lengths[rows]) / len(rows)
            own = m.factors[i]
            total = np.repeat(np.add.reduceat(own * v[:, None], begin[:-1]), lengths[rows], axis=0)
            u, inv = np.unique(i, return_inverse=True)
            dl = np.bincount(inv, per * v, len(u)) + decay * m.linear[u]
            each = (per * v)[:, None] * (total - own * v[:, None])
            dv = np.stack([np.bincount(inv, each[:, f], len(u)) for f in range(FACTORS)], 1) + decay * m.factors[u]
            gl[u] += dl * dl
            gv[u] += dv * dv
            m.linear[u] -= rate * dl / np.sqrt(gl[u])
            m.factors[u] -= 0.1 * rate * dv / np.sqrt(gv[u])
            m.bias -= 0.05 * float(g.mean())
    return m


def _features(df: DataFrame) -> DataFrame:
    """(key, y, ids, x) of (key, y, text, n_chars) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in slices(batches):
            ids, x, starts = featurize(texts_of(b.column(2)), buckets, b.column(3).to_pylist())
            off = pa.array(starts.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(off, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(x.astype(np.float32)))], ["key", "y", "ids", "x"])

    return df.mapInArrow(run, "key long, y int, ids array<int>, x array<float>")


def declared(df: DataFrame) -> Column:
    """The length that a row declares, null where it has none."""
    return F.expr("try_cast(n_chars as bigint)") if "n_chars" in df.columns else F.lit(None).cast("long")


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits on at most ``sample`` labelled rows; ``labels`` has doc_id and a 0/1 ``y``."""
    picked = labels.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"), F.min("y").cast("int").alias("other")).where("y = other").drop("other")
    picked = picked.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("key", "doc_id").limit(sample)
    texts = df.select("doc_id", F.struct(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), declared(df).alias("n_chars")).alias("row"))
    one = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "key", "y").agg(F.min("row").alias("row"))  # at most ``sample`` ids are broadcast
    rows = _features(one.select("key", "y", "row.text", "row.n_chars")).collect()
    rows.sort(key=lambda r: (r.key, r.ids))
    starts = np.r_[0, np.cumsum([len(r.ids) for r in rows])].astype(np.int64)
    join = lambda k, t: np.concatenate([np.array(r[k], t) for r in rows]) if rows else np.empty(0, t)
    return fit(join("ids", np.int64), join("x", np.float64), starts, np.array([r.y for r in rows], np.float64))


def score(df: DataFrame, machine: Machine) -> DataFrame:
    """Adds ``score`` (0 to 1) to rows with a text and, if they have it, ``n_chars``; the machine is of fixed size and travels by broadcast."""
    model = df.sparkSession.sparkContext.broadcast(machine)
    others = [c for c in df.columns if c not in ("text", "n_chars")]
    df = df.select(*[F.col(f"`{c}`") for c in others], "text", declared(df).alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, m = Buckets(), model.value
        for b in slices(batches):
            own = [b.column(b.schema.get_field_index(c)) for c in ("text", "n_chars")]
            z = m.logits(*featurize(texts_of(own[0]), buckets, own[1].to_pylist()))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in others] + [pa.array(p)], [*others, "score"])

    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", score double")


def bucket_of(doc_id, modulus: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Machine:
    """The machine that operator and pipeline share: it never sees labels of the held-out quarter."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).where(bucket_of(F.col("doc_id"), 4) != 2)
    return train(docs, labels)


def accepted(df: DataFrame, machine: Machine, least: float = THRESHOLD) -> DataFrame:
    """Rows of ``df`` whose text scores ``least`` or more, columns as they were."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("text").cast("string").alias("text"), declared(df).alias("n_chars"))
    return score(rows, machine).where(F.col("score") >= least).select("row.*")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = score(docs.select("doc_id", F.col("text").cast("string").alias("text"), declared(docs).alias("n_chars")), trained(spark, docs, sf_dir))
    return s.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
