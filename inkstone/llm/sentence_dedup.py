"""Substring dedup by sliding sentence spans (operator 4).

A text is cut into sentences: runs up to the next . ! ? or line break, with the
white space behind them; joined, they are the text again.  From every sentence
the shortest run of consecutive sentences with ``MIN_WORDS`` words is a span,
forwards and backwards; a run of one sentence counts only with ``ALONE`` words.
Spans (their sentences, white space collapsed) are hashed to 128 bits and joined
over all documents.  A span's first occurrence is the one in the least doc_id,
there the earliest.  Sentences covered by any other occurrence are removed.

Only (hash, doc_id, place) rows are shuffled, first grouped with partial sums,
so that a span in a third of all documents is one row a task; the join back is
a plain sort-merge join, whose hot keys Spark splits.

Defined results.  Null text stays null, empty text empty, nothing removed.  Ids
that are whole numbers order documents; those without one, null or a word, come
last, each text by a hash, so that their copies are found like all others.  Rows
with one id number, or without one but with equal text, count as one document:
their copies of one span are all first, save what repeats inside a text.  Other columns pass
through ``dedup`` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import rank, slices, table

MIN_WORDS, ALONE = 25, 50
PIECE = re.compile(r"[^.!?\n]+[.!?]*[ \t\n\r\f]*|[.!?]+[ \t\n\r\f]*|\n[ \t\n\r\f]*")
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers of the two span hashes


def pieces(text: str) -> list[str]:
    return PIECE.findall(text)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def spans(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the spans among the sentences, end exclusive, by start and end, each once."""
    words = [len(p.split()) for p in parts]
    total = np.r_[0, np.cumsum(words)]
    n = len(parts)
    i = np.arange(n)
    alone = np.array(words) >= ALONE
    end = np.searchsorted(total, total[:-1] + MIN_WORDS)  # the shortest run from i
    end = np.where(alone, i + 1, np.maximum(end, i + 2))
    start = np.searchsorted(total, total[1:] - MIN_WORDS, side="right") - 1  # the shortest run that ends with i
    start = np.where(alone, i, np.minimum(start, i - 1))
    a, b = np.r_[i, start], np.r_[end, i + 1]
    keep = (a >= 0) & (b <= n)
    keep[n:] &= total[1:] >= MIN_WORDS
    key = np.unique(a[keep] * (n + 1) + b[keep])
    return key // (n + 1), key % (n + 1)


def hashed(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end and two 64-bit hashes of every span."""
    a, b = spans(parts)
    if not len(a):
        return a, b, a, b
    digests = b"".join(hashlib.md5(" ".join(p.split()).encode()).digest() for p in parts)
    own = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    out = []
    for k, base in enumerate(BASES):
        # h = sum of digest * base^place over the span, moved to place 0 by the inverse power
        inverse = pow(base, -1, 1 << 64)
        run = np.r_[np.zeros(1, np.uint64), np.cumsum(own[:, k] * _powers(base, len(own)), dtype=np.uint64)]
        out.append((run[b] - run[a]) * _powers(inverse, len(own))[a] + (b - a).astype(np.uint64))
    return a, b, out[0].view(np.int64), out[1].view(np.int64)


def _local(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which spans have an equal one before them in the same text."""
    order = np.lexsort((np.arange(len(h1)), h2, h1))
    same = np.r_[False, (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])] if len(h1) else np.empty(0, bool)
    out = np.zeros(len(h1), bool)
    out[order] = same
    return out


def _span_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, ths, cols = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), []
            for d, th, t in zip(ids, ths, b.column(2).to_pylist(), strict=True):
                a, e, h1, h2 = hashed(pieces(t))
                again = _local(h1, h2)
                cols.append((np.full(len(a), d), np.full(len(a), th), a, e, h1, h2, again))
            x = [np.concatenate(c) for c in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(x[2].astype(np.int32)), pa.array(x[3].astype(np.int32)), pa.array(x[4]), pa.array(x[5]), pa.array(x[6])], ["ord", "th", "a", "b", "h1", "h2", "again"])

    return docs.mapInArrow(run, "ord long, th long, a int, b int, h1 long, h2 long, again boolean")


def covered(df: DataFrame) -> DataFrame:
    """(ord, th, runs): for each text with non-first repeated spans, their places."""
    docs = df.select(rank(F.col("doc_id"), F.xxhash64("text")).alias("ord"), F.xxhash64("text").alias("th"), "text").where(F.col("text").isNotNull())
    rows = _span_rows(docs)
    first = rows.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    first = first.where(F.col("first") < F.col("last")).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    hit = rows.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left").where(F.col("again") | (F.col("first") < F.col("ord")))
    return hit.groupBy("ord", "th").agg(F.collect_set(F.struct("a", "b")).alias("runs"))  # at most the spans of one text


def dedup(df: DataFrame) -> DataFrame:
    """``df`` with the sentences removed from ``text``, plus n_sentences and n_removed (in a struct ``_dedup``)."""
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), rank(F.col("doc_id"), F.xxhash64(F.col("text").cast("string"))).alias("ord"), F.col("text").cast("string").alias("text"))
    runs = covered(df.select("doc_id", F.col("text").cast("string").alias("text")))
    src = src.withColumn("th", F.xxhash64("text"))
    joined = src.join(runs, ["ord", "th"], "left").select("row", "text", "runs")
    row = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, total, gone = [], [], []
            for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                parts = pieces(t or "")
                drop = np.zeros(len(parts) + 1, np.int64)
                for x in r or ():
                    drop[x["a"]] += 1
                    drop[x["b"]] -= 1
                out = np.cumsum(drop)[:-1] > 0
                texts.append("".join(p for p, o in zip(parts, out, strict=True) if not o) if r else t)
                total.append(len(parts))
                gone.append(int(out.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n", "gone"])

    done = joined.mapInArrow(run, f"row {row}, text string, n long, gone long")
    cols = [F.col("text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in df.columns]
    return done.select(*cols, F.struct(F.col("n").alias("n_sentences"), F.col("gone").alias("n_removed")).alias("_dedup"))


def op4_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "_dedup.n_sentences", "_dedup.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: From (doc_id, text) rows of {src}: doc_id, n, removed, kept.
SQL = r"""
p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]*[ \t\n\r\f]*|[.!?]+[ \t\n\r\f]*|\n[ \t\n\r\f]*') AS parts FROM {src}),
s AS (
  SELECT doc_id, i, piece, trim(regexp_replace(piece, '[ \t\n\r\f]+', ' ', 'g')) AS key,
         len(regexp_extract_all(piece, '[^ \t\n\r\f]+')) AS w
  FROM (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS piece FROM p)),
c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS upto FROM s),
f AS (
  SELECT x.doc_id, x.i AS a, min(y.i) AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i >= x.i
  WHERE (x.w >= 50 AND y.i = x.i) OR (x.w < 50 AND y.i > x.i AND y.upto - x.upto + x.w >= 25) GROUP BY ALL
  UNION
  SELECT x.doc_id, max(y.i) AS a, x.i AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i <= x.i
  WHERE (x.w >= 50 AND y.i = x.i) OR (x.w < 50 AND y.i < x.i AND x.upto - y.upto + y.w >= 25) GROUP BY x.doc_id, x.i),
k AS (SELECT f.doc_id, f.a, f.b, string_agg(c.key, chr(31) ORDER BY c.i) AS key FROM f JOIN c ON c.doc_id = f.doc_id AND c.i BETWEEN f.a AND f.b GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, a) AS occurrence FROM k),
g AS (SELECT DISTINCT c.doc_id, c.i FROM n JOIN c ON n.doc_id = c.doc_id AND c.i BETWEEN n.a AND n.b WHERE n.occurrence > 1),
z AS (
  SELECT c.doc_id, count(*) AS n, count(g.i) AS removed, coalesce(string_agg(c.piece, '' ORDER BY c.i) FILTER (WHERE g.i IS NULL), '') AS kept
  FROM c LEFT JOIN g ON c.doc_id = g.doc_id AND c.i = g.i GROUP BY c.doc_id)
"""
QUERIES = {"op4_sentence_dedup": op4_sentence_dedup}
ORACLE_SQL = {
    "op4_sentence_dedup": "WITH " + SQL.replace("{src}", "documents") + """
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_sentences, coalesce(z.removed, 0)::BIGINT AS n_removed, sha256(coalesce(z.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN z ON d.doc_id = z.doc_id
"""
}
