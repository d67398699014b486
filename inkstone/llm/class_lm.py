"""LM scoring with Brown class-based n-grams (operator 7).

Tokens are the words of a lower-cased text and one end.  P(word | before) =
P(class | class before) * P(word | class), both smoothed.  Exchange clustering
assigns the classes, distributed, in two steps:

1. Words with at least ``SHARE`` of all training tokens (so at most 1 / SHARE of
   them, whatever the corpus) are units of their own, all others are units by
   their last two bytes (``ENDINGS`` of them).  Counts of unit pairs lie in a
   table; each turn counts, in Spark, every unit's neighbours by class, and every
   unit of one half moves to the class in which its tokens are likeliest.  Turns
   end when both halves in a row gain no more than ``GAIN`` of the likelihood.
   The driver holds units by classes, never words by words.
2. Every other word of the vocabulary, however rare, moves by itself: its
   neighbours are counted by class over all its training tokens, and it goes to
   the class in which they are likeliest.  Words and counts stay distributed:
   one row a word and batch, one vector a word in the task that holds it.

Transitions between classes are then counted over all training tokens with the
classes that words ended up with.

Documents are dealt to blocks of about ``BLOCK`` bytes.  The distinct words of
each block with their counts are one table: summed by word it is the vocabulary,
and joined with it a block's documents get the counts and classes of their words.

Defined results.  Null or empty text: the end alone.  Repeated rows: each counts
and is scored.  No training documents: every count is 0, scores follow from the
smoothing.  Extra columns are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inkstone.llm.common import Ids, cut, forget, ready, slices, stored, table, texts_of

SHARE, ENDINGS, LEAST_CLASSES, MOST_CLASSES, BLOCK = 1e-4, 256, 32, 128, 16_000_000
TURNS, GAIN = 60, 1e-5
END = b" "  # no word holds a space
PRIOR, PAIRS = 8.0, 4_000_000
WORDS, BUCKET = 500_000, 200_000  # words remembered by a worker; words whose vectors one task holds, about


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def flat(texts: list[bytes]) -> list[bytes]:
    """All tokens in a row, an end before the first text and after each."""
    return [END, *chain.from_iterable((*tokens(t), END) for t in texts)]


def numbered(texts: list[bytes], ids: Ids) -> np.ndarray:
    """The numbers of ``flat(texts)``, text by text, so that a block's tokens are never objects all at once."""
    end, out = ids[END], []
    for t in texts:
        w = tokens(t)
        x = np.empty(len(w) + 1, np.int64)
        x[:-1] = np.fromiter(map(ids.__getitem__, w), np.int64, len(w))
        x[-1] = end
        out.append(x)
    return np.concatenate([np.array([end]), *out])


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def dealt(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, text, train, block of (doc_id, text, train)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.select("doc_id", "text", "train", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // block)))).cast("int").alias("block"))


def block_words(docs: DataFrame) -> DataFrame:
    """(block, word, c): the distinct words of a block, and how often they are in its training documents; ends count too."""

    def run(t: pa.Table) -> pa.Table:
        seen: Counter = Counter()
        for x, train in zip(texts_of(t.column("text").combine_chunks()), t.column("train").to_pylist(), strict=True):
            if train:
                seen.update(tokens(x))
                seen[END] += 1
            else:
                for w in {*tokens(x), END}:
                    seen[w] += 0
        return pa.table({"block": pa.array([t.column("block")[0].as_py()] * len(seen), pa.int32()), "word": pa.array(list(seen), pa.binary()), "c": pa.array(list(seen.values()), pa.int64())})

    return docs.groupBy("block").applyInArrow(run, "block int, word binary, c long")


@dataclass
class Units:
    """Frequent words and their numbers; all others are numbered by ending behind them."""

    words: dict[bytes, int]
    counts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.words) + ENDINGS

    def cache(self) -> dict:
        frequent = len(self.words)

        class Of(dict):
            def __missing__(self, w: bytes) -> int:
                self[w] = u = frequent + ending(w)
                return u

        return Of(self.words)


def pair_counts(docs: DataFrame, units) -> DataFrame:
    """(u, v, n): how often unit v follows unit u in training documents; texts begin and end with the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = units.value
        of, size, held, n = own.cache(), own.size, [], 0

        def rows() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((key // size).astype(np.int32)), pa.array((key % size).astype(np.int32)), pa.array(count.astype(np.int64))], ["u", "v", "n"])

        for b in slices(batches):
            w = flat(texts_of(b.column(0)))
            u = np.fromiter(map(of.__getitem__, w), np.int64, len(w))
            held.append(u[:-1] * size + u[1:])
            n += len(w)
            if len(of) > WORDS + len(own.words):
                of = own.cache()
            if n > PAIRS:
                yield rows()
                held, n = [], 0
        if held:
            yield rows()

    return docs.where("train").select("text").mapInArrow(run, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def neighbours(pairs: DataFrame, assign: np.ndarray, classes: int) -> np.ndarray:
    """[unit, 0, class]: tokens of the class before the unit; [unit, 1, class]: after it.  Bounded: units by classes."""
    sent = pairs.sparkSession.sparkContext.broadcast(assign)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, total = sent.value, np.zeros(len(sent.value) * 2 * classes, np.int64)
        for b in batches:
            u, v, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            np.add.at(total, v.astype(np.int64) * 2 * classes + a[u], n)
            np.add.at(total, u.astype(np.int64) * 2 * classes + classes + a[v], n)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    rows = pairs.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(assign) * 2 * classes)
    out[rows["k"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    sent.unpersist()
    return out.reshape(len(assign), 2, classes)


def transitions(near: np.ndarray, assign: np.ndarray) -> np.ndarray:
    """[class, class]: how often the second follows the first."""
    out = np.zeros((near.shape[2], near.shape[2]))
    np.add.at(out, assign, near[:, 0])
    return out.T


def likelihood(m: np.ndarray) -> float:
    """Log-likelihood of the classes' sequence, up to a part that no exchange changes."""
    x = lambda a: float((a * np.log(np.maximum(a, 1))).sum())
    return x(m) - x(m.sum(0)) - x(m.sum(1))


def gains(near: np.ndarray, m: np.ndarray) -> np.ndarray:
    """[word, class]: log-likelihood of the word's neighbours if it were in the class, by the transitions ``m``."""
    step = np.log((m + 0.1) / (m.sum(1) + 0.1 * len(m))[:, None])
    return near[:, 0] @ step + near[:, 1] @ step.T - near[:, 0].sum(1)[:, None] * np.log(m.sum(0) + 1.0)[None, :]


def exchange(near: np.ndarray, assign: np.ndarray, turn: int) -> np.ndarray:
    """Moves every second unit to the class in which its tokens are likeliest, all other units held."""
    gain = gains(near, transitions(near, assign))
    best = gain.argmax(1)
    half = (np.arange(len(assign)) + turn) % 2 == 0
    return np.where(half & (gain[np.arange(len(assign)), best] > gain[np.arange(len(assign)), assign]), best, assign)


def clustered(pairs: DataFrame, units: Units, classes: int, turns: int = TURNS, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the units, transitions, and the likelihood after each turn; turns end when two in a row gain too little."""
    assign = np.array([ending(w) % classes for w in units.words] + [e % classes for e in range(ENDINGS)])
    near = neighbours(pairs, assign, classes)
    best, seen, idle = assign, [likelihood(transitions(near, assign))], 0
    for turn in range(turns):
        assign = exchange(near, assign, turn)
        near = neighbours(pairs, assign, classes)
        now = likelihood(transitions(near, assign))
        idle = 0 if now > max(seen) + gain * abs(max(seen)) else idle + 1
        best = assign if now > max(seen) else best
        seen.append(now)
        if idle == 2:
            break
    return best, transitions(neighbours(pairs, best, classes), best), seen


def own_classes(docs: DataFrame, units, assign: np.ndarray, m: np.ndarray, vocabulary: int) -> DataFrame:
    """(word, class) of every training word that is no unit: that in which its neighbours are likeliest."""
    classes = len(m)
    sent = docs.sparkSession.sparkContext.broadcast((assign, m))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, a = units.value, sent.value[0]
        frequent, of = len(own.words), own.cache()
        ids, kind, held = Ids(), [], []

        def rows() -> pa.RecordBatch:
            x, before, after = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(x, kind="stable")
            codes = np.stack([before[order], after[order] + classes], 1).astype(np.uint8)
            words, first = np.unique(x[order], return_index=True)
            names = list(ids)
            stops = np.r_[first, len(x)] * 2
            data = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(stops.astype(np.int32).tobytes()), pa.py_buffer(codes.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in words.tolist()], pa.binary()), data], ["word", "codes"])

        for b in slices(batches):
            w = flat(texts_of(b.column(0)))
            x = ids.of(w)
            if len(ids) > len(kind):
                names = list(ids)[len(kind) :]
                kind += map(of.__getitem__, names)
                of = own.cache() if len(of) > WORDS + frequent else of
            u = np.array(kind)[x]
            tail = np.flatnonzero(u[1:-1] >= frequent) + 1
            held.append((x[tail], a[u[tail - 1]], a[u[tail + 1]]))
            if len(ids) > WORDS:
                yield rows()
                ids, kind, held = Ids(), [], []
        if held:
            yield rows()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total = Ids(), np.zeros((1024, 2 * classes), np.int32)
        for b in batches:
            row = ids.of(b.column(0).to_pylist())
            while len(ids) > len(total):
                total = np.concatenate([total, np.zeros_like(total)])
            codes = b.column(1).to_pylist()
            key = np.repeat(row, [len(c) for c in codes]) * 2 * classes + np.frombuffer(b"".join(codes), np.uint8)
            np.add.at(total.ravel(), key, 1)
        words = list(ids)
        for i in range(0, len(words), 50_000):
            near = total[i : min(i + 50_000, len(words))].reshape(-1, 2, classes)
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()), pa.array(gains(near, sent.value[1]).argmax(1).astype(np.int32))], ["word", "class"])

    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vocabulary // BUCKET))
    seen = docs.where("train").select("text").mapInArrow(contexts, "word binary, codes binary").repartition(buckets, "word")
    return seen.mapInArrow(best, "word binary, class int")


@dataclass
class ClassModel:
    lumps: np.ndarray  # class of each ending, for words that no training document has
    step: np.ndarray  # log10 P(class | class before)
    below: np.ndarray  # log10 of each class's emission denominator
    n: int
    v: int
    end: int  # class of the end


def frequent(words: DataFrame, n: int) -> Units:
    rows = words.where((F.col("c") >= max(1, SHARE * n)) | (F.col("word") == F.lit(END))).collect()  # at most 1 / SHARE + 1 words
    rows.sort(key=lambda r: (-r.c, bytes(r.word)))
    return Units({bytes(r.word): i for i, r in enumerate(rows)} or {END: 0}, np.array([r.c for r in rows] or [0]))


def coded(docs: DataFrame, known: DataFrame, lumps: np.ndarray, n: int, v: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, emitted, codes: what needs no transitions of classes, and the classes of
    a document's tokens, one byte each, so that its text is read once more and not twice."""
    sent = docs.sparkSession.sparkContext.broadcast(lumps)

    def run(docs_: pa.Table, words: pa.Table) -> pa.Table:
        if not (rows := docs_.num_rows):
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        ids, c, k = looked_up(words, sent.value)
        x = numbered(texts_of(docs_.column("text").combine_chunks()), ids)
        ends = np.flatnonzero(x == ids[END])
        starts, size = ends[:-1] + 1, np.diff(ends)
        total = lambda a: np.add.reduceat(a, starts)
        emitted = total(np.log10(c + 0.5)[x])
        base = emitted - np.log10(n + 0.5 * (v + 1)) * size
        at = np.r_[0, np.cumsum(size)].astype(np.int64)
        codes = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(k.astype(np.uint8)[x[1:]].tobytes())]).cast(pa.binary())
        held_out = [not t for t in docs_.column("train").to_pylist()]
        return pa.table({"doc_id": docs_.column("doc_id"), "held_out": pa.array(held_out, pa.bool_()), "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(total((c > 0)[x].astype(np.int64)), pa.int64()), "base_score": pa.array(base, pa.float64()), "emitted": pa.array(emitted, pa.float64()), "codes": codes})

    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emitted", "codes"]
    kinds = [to_arrow_type(docs.schema["doc_id"].dataType), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
    return docs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, codes binary")


def bytes_of(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a column of documents' tokens in a row, and how many each has."""
    x = codes.to_pylist()
    return np.frombuffer(b"".join(x), np.uint8).astype(np.int64), np.array([len(t) for t in x], np.int64)


def moved_transitions(docs: DataFrame, end: int, classes: int) -> np.ndarray:
    """[class, class] over all training tokens of what ``coded`` gives; ``end`` is the class of the end, that before a text too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(classes * classes, np.int64)
        for b in slices(batches):
            u, _ = bytes_of(b.column(0))
            n += np.bincount(np.r_[end, u[:-1]] * classes + u, minlength=len(n))  # a text's last is its end
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["k", "n"])

    rows = docs.where("not held_out").select("codes").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(classes * classes)
    for r in rows:
        out[r.k] = r.n
    return out.reshape(classes, classes)


def looked_up(words: pa.Table, lumps: np.ndarray) -> tuple[Ids, np.ndarray, np.ndarray]:
    """Numbers of a block's words, their counts and their classes."""
    names = words.column("word").to_pylist()
    ids = Ids(zip(names, range(len(names)), strict=True))
    k = words.column("class").to_numpy().astype(np.float64)
    for i in np.flatnonzero(np.isnan(k)).tolist():
        k[i] = lumps[ending(names[i])]
    return ids, words.column("c").to_numpy(), k.astype(np.int64)


def train(docs: DataFrame, classes: int | None = None, turns: int = TURNS) -> tuple[ClassModel, DataFrame]:
    """The model, and (block, word, c, class): of every block its words with count in all training documents and class.
    ``docs`` is what ``dealt`` gives."""
    return learned(docs, classes, turns)[:2]


def learned(docs: DataFrame, classes: int | None = None, turns: int = TURNS) -> tuple[ClassModel, DataFrame, DataFrame]:
    """As ``train``, and what ``coded`` gives for ``docs``."""
    sc = ready(docs.sparkSession).sparkContext
    words = stored(block_words(docs))
    vocab = cut(words.where("c > 0").groupBy("word").agg(F.sum("c").alias("c")))
    n, v = (x or 0 for x in vocab.agg(F.sum("c"), F.count("*")).first())
    units = frequent(vocab, n)
    sent = sc.broadcast(units)
    classes = classes or max(LEAST_CLASSES, min(MOST_CLASSES, math.isqrt(units.size)))
    pairs = cut(pair_counts(docs, sent))
    assign, m, _ = clustered(pairs, units, classes, turns)
    forget(pairs)
    fixed = docs.sparkSession.createDataFrame([(bytearray(w), int(assign[i])) for w, i in units.words.items()], "word binary, class int")  # at most 1 / SHARE + 1
    of = cut(vocab.join(own_classes(docs, sent, assign, m, v).unionByName(fixed), "word"))
    types, own = np.zeros(classes), np.zeros(classes)
    for r in of.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        types[r["class"]], own[r["class"]] = r.v, r.c
    known = stored(words.select("block", "word").join(of, "word", "left").select("block", "word", F.coalesce("c", F.lit(0)).cast("long").alias("c"), "class"))
    forget(words, vocab, of)
    lumps = assign[len(units.words) :]
    every = stored(coded(docs, known, lumps, int(n), int(v)))
    end = int(assign[units.words[END]] if n else lumps[ending(END)])
    m = moved_transitions(every, end, classes)
    prior = (own + 0.5) / (own.sum() + 0.5 * classes)
    step = np.log10((m + PRIOR * prior[None, :]) / (m.sum(1) + PRIOR)[:, None])
    return ClassModel(lumps, step, np.log10(own + 0.5 * (types + 1)), int(n), int(v), end), known, every


def scored(docs: DataFrame, model: ClassModel, known: DataFrame) -> DataFrame:
    """``summed`` of ``docs`` by what ``train`` gives."""
    return summed(coded(docs, known, model.lumps, model.n, model.v), model)


def summed(docs: DataFrame, model: ClassModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of what ``coded`` gives."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches):
            u, size = bytes_of(b.column(6))
            inner = m.step[np.r_[m.end, u[:-1]], u] - m.below[u]
            total = b.column(5).to_numpy() + np.add.reduceat(inner, np.cumsum(size) - size)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array([m.n] * len(size), pa.int64()), b.column(4), pa.array(total)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def class_scores(docs: DataFrame, classes: int | None = None, block: int = BLOCK) -> DataFrame:
    """Scores of (doc_id, text, train) rows by a model of the training ones."""
    model, known, every = learned(dealt(docs, block), classes)
    forget(known)
    return summed(every, model)


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return class_scores(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"), (~held_out).alias("train")))


QUERIES = {"op7_class_lm": op7_class_lm}
ORACLE_SQL: dict[str, str] = {}
