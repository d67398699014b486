"""Quality rules as a short-circuit cascade (operator 2).

``plan(df)`` runs every rule over a bounded sample of whole documents, measures
each rule's cost (seconds a document) and selectivity (share rejected), and
orders the rules by rejection per cost.  ``judge(df, order)`` applies them in
that order and stops at a document's first rejection.  A document is kept if no
rule rejects it, so the verdict does not depend on the measured order.

The sample is ``SAMPLE`` distinct texts of the least hashes: hashes alone are
sorted, and only those below a bound that holds some times as many; the texts
are then fetched, of at most ``LONG`` bytes each, so the driver gets a fixed
amount whatever the table's size.

Defined results.  Null or empty text: no words, base_failed, not kept.  Texts
under eight words have no repeated window.  Repeated rows give equal rows;
extra input columns are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import Ids, map_batches, table

#: Documents in the sample on which costs and selectivities are estimated.
SAMPLE = 256
#: Longer texts are not in the sample (they are judged like all others); how many times SAMPLE hashes are looked at.
LONG, SPARE = 1 << 18, 8
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
#: Odd multipliers of the window hash; equal windows are compared word by word afterwards.
ODD = [int(x) | 1 for x in np.random.default_rng(8).integers(1 << 20, 1 << 62, WINDOW)]


def repeat_words(ids: np.ndarray, w: int = WINDOW) -> int:
    """Words inside windows of ``w`` words that occur twice or more in the text, the first occurrence included."""
    n = len(ids) - w + 1
    if n < 2:
        return 0
    u = ids.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(w):
        h += (u[j : j + n] + np.uint64(j + 1)) * np.uint64(ODD[j])
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    if any((ids[a + j] != ids[b + j]).any() for j in range(w)):  # a hash collision: compare the windows themselves
        grid = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, w))
        _, inv, cnt = np.unique(grid, axis=0, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(cnt[inv.ravel()] > 1)
    else:
        hit = np.concatenate([a, b])
    edge = np.zeros(len(ids) + 1, np.int64)
    hit = np.unique(hit)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + w, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


class Facts:
    """What rules ask of a document; the contract's base counts are made at once, the rest on demand."""

    __slots__ = ("text", "words", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def __init__(self, text: str):
        self.text = text
        self.words = text.encode().split()
        self.n_words = len(self.words)
        self.word_chars = len(text) - sum(map(text.count, SPACES))
        self.n_symbols = sum(map(text.count, SYMBOLS))
        self.lines = [x for x in text.split("\n") if x.strip(SPACES)]
        self.n_dup_lines = len(self.lines) - len(set(self.lines))
        self.n_repeat_words = repeat_words(Ids().of(self.words)) if self.n_words > WINDOW else 0

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


def _letters(f: Facts) -> tuple[int, int]:
    return sum(map(str.isupper, f.text)), sum(map(str.isalpha, f.text))


def shouts(f: Facts) -> bool:
    upper, letters = _letters(f)
    return 10 * upper > 3 * letters


#: name -> does it reject the document?
RULES: dict[str, Callable[[Facts], bool]] = {
    "symbols": lambda f: 10 * f.n_symbols > f.n_words,
    "word_length": lambda f: not 2 * f.n_words <= f.word_chars <= 12 * f.n_words,
    "duplicate_lines": lambda f: f.n_dup_lines > 2 and 10 * f.n_dup_lines > 3 * len(f.lines),
    "bullet_lines": lambda f: 10 * sum(x.lstrip(SPACES)[:1] in ("-", "*", "•", "·") for x in f.lines) > 9 * len(f.lines),
    "ellipsis_lines": lambda f: 10 * sum(x.rstrip(SPACES).endswith(("...", "…")) for x in f.lines) > 3 * len(f.lines),
    "alphabetic_words": lambda f: 5 * sum(any(c > 127 or 65 <= c & 223 <= 90 for c in w) for w in f.words) < 4 * f.n_words,
    "stuttering": lambda f: 4 * sum(a == b for a, b in zip(f.words, f.words[1:], strict=False)) > f.n_words,
    "shouting": shouts,
    "exclamations": lambda f: 10 * f.text.count("!") > 3 * f.n_words,
}


def estimate(texts: list[str]) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) over the sample, best rejection per cost first."""
    facts = [f for f in map(Facts, texts) if not f.base_failed]
    found = []
    for name, rule in RULES.items():
        t = time.thread_time()
        rejected = sum(map(rule, facts))
        cost = (time.thread_time() - t) / max(len(facts), 1)
        found.append((name, max(cost, 1e-9), rejected / max(len(facts), 1)))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


def plan(df: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> list[str]:
    """The cascade's order from at most ``sample`` distinct texts; only they, and no more hashes than that, reach the driver."""
    t = F.col(f"`{text_col}`").cast("string")
    rows = df.select(t.alias("text")).where(t.isNotNull() & (F.octet_length(t) <= LONG)).withColumn("h", F.xxhash64("text"))
    n = df.count()
    bound = min((1 << 63) - 1, -(1 << 63) + int(SPARE * sample / max(n, 1) * (1 << 64)))
    least = [r.h for r in rows.where(F.col("h") <= bound).select("h").distinct().orderBy("h").limit(sample).collect()]
    found = rows.where(F.col("h").isin(least)).groupBy("h").agg(F.min("text").alias("text")).collect() if least else []
    return [name for name, _, _ in estimate([r.text for r in sorted(found, key=lambda r: r.h)])]


def judge(df: DataFrame, order: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, base_failed, kept, and ``rejected_by``: the first rule that rejected the document, null if none did."""
    rules = [(n, RULES[n]) for n in order]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        facts = [Facts(t or "") for t in b.column(1).to_pylist()]
        base = [f.base_failed for f in facts]
        by = ["base" if failed else next((n for n, rule in rules if rule(f)), None) for f, failed in zip(facts, base, strict=True)]
        cols = [pa.array([getattr(f, c) for f in facts], pa.int64()) for c in COUNTS]
        return pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(base), pa.array([x is None for x in by]), pa.array(by, pa.string())], ["doc_id", *COUNTS, "base_failed", "kept", "rejected_by"])

    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    return map_batches(src, run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, rejected_by string")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, plan(docs)).drop("rejected_by")  # which rule came first follows the measured order


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE_SQL: dict[str, str] = {}
