"""Near-dedup by order MinHash (operator 9).

Words are [^ \\t-\\r]+.  A document's k-mers are its runs of five words (of two
in texts of under ``LONG`` words; texts near that length have both), each
labelled with its occurrence; each of ``SKETCHES`` seeded orders picks the two
least labelled k-mers and hashes them in the order in which they stand in the
text.  Documents that agree in one such hash are candidates, so texts with the
same k-mers in another order are not.  A candidate pair is linked if the edit
similarity of its words, 1 - edits / length of the longer, is 0.8 or more by an
alignment banded to the edits that this allows.  Scattered edits down to 0.8
leave five-word runs a Jaccard similarity of about 0.2, and such texts meet in
one of the sketches with probability 1 - (1 - 0.2^2)^64, over 0.92; at 0.85 it is
0.99.  Of two-word runs 0.47 is left, for which ``FEW_SKETCHES`` orders are enough.  Texts of at most ``SHORT`` words also get a key for each way to leave out
the edits that their length allows, and meet whenever they are linked.  Classes
are the connected components.

Texts with the same words are one node from the start.  In a bucket of equal
hashes all nodes are compared with its least node, a pivot, first with that of
most common buckets, then with others unless links already join the two.  Copies
are in one component by then.  Buckets that still hold several:
 - of up to ``BUCKET`` nodes, all pairs of different components are compared;
 - larger ones hold texts around one passage or frame.  Their nodes are dealt
   anew, and exactly: of a text's pairs of neighbouring words a link leaves all but
   two an edit, so linked texts share one of the 2 n / 5 + 1 pairs that come first in
   any fixed order (the n-th occurrence of a pair is a pair of its own).  The
   order puts pairs first that few of these nodes have, by counts in at most
   2^``MOST_BITS`` hash slots, so the new buckets are small where texts have passages
   of their own.  Pairs of over ``COMMON`` nodes are known by the two least of these
   nodes in two seeded orders, so those of one frame are a few buckets and not one each.
   Nodes of one component are never compared; buckets of over ``BUCKET`` nodes are
   dealt in parts, and each pair of parts meets, but for those of one component.
Pairs are passed on only if lengths and word histograms allow the similarity;
both are bounds that no linked pair misses.

Defined results.  Null texts and texts without words link to nothing and are
their own class.  Texts of fewer words than a k-mer are one k-mer.  A class is known by
its least doc_id; rows with equal doc_id and text share it.  Ids that are no whole
numbers, null or words, come last, and stand in class_id as a number of 2^62 or
more that follows from id and text.  Extra columns are dropped; an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import cut, forget, keyed, rank, ready, slices, table, texts_of, without_broadcast
from inkstone.llm.components import components

FEW_SKETCHES = 24
K, FEW, LONG, SKETCHES, SHORT, ANCHOR, SIMILARITY, BUCKET, BINS = 5, 2, 50, 64, 14, 5, 0.8, 256, 256
PAIR, COMMON, LEAST_BITS, MOST_BITS, RUNS, MOST_32 = 2, 64, 12, 21, 64, 0x7FFFFFFF
CACHE, CHAINED = 400_000, 1_000
_RNG = np.random.default_rng(9)
MULTIPLY = _RNG.integers(1 << 32, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)
SHIFT = _RNG.integers(0, 1 << 63, (2, SKETCHES), dtype=np.uint64)
PLACES = _RNG.integers(1 << 32, 1 << 63, ANCHOR, dtype=np.uint64) | np.uint64(1)
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


class WordHash(dict):
    def __missing__(self, w: bytes) -> int:
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def kmers(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of k words; a shorter text is one run."""
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(h))):
        out += h[j : j + n] * PLACES[j]
    return mixed(out)


def labelled(x: np.ndarray) -> np.ndarray:
    """Mixes into each k-mer how often it has occurred before; a first occurrence gets one hash in all texts, with and without repeats."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    fresh = np.r_[True, s[1:] != s[:-1]]
    if fresh.all():
        return mixed(x)
    place = np.arange(len(s))
    nth = place - np.maximum.accumulate(np.where(fresh, place, 0))
    out = x.copy()
    out[order] = mixed(s + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def sketch(h: np.ndarray, k: int = K) -> np.ndarray:
    """One hash for each seeded order: its two least labelled k-mers, as they stand in the text."""
    x, many = labelled(kmers(h, k)), SKETCHES if k == K else FEW_SKETCHES
    shift = SHIFT[int(k != K), :many]
    if len(x) < 3:
        first = np.zeros(many, np.int64)
        second = np.full(many, len(x) - 1)
    else:
        first, second = np.empty(many, np.int64), np.empty(many, np.int64)
        step = max(1, min(many, 200_000 // len(x)))  # stays in the processor's cache
        for s in range(0, many, step):
            v = x[None, :] * MULTIPLY[s : min(s + step, many), None]
            a = v.argmin(1)
            v[np.arange(len(a)), a] = MOST
            b = v.argmin(1)
            first[s : s + step], second[s : s + step] = np.minimum(a, b), np.maximum(a, b)
    return mixed(mixed(shift * np.uint64(31) + x[first]) * np.uint64(31) + x[second]).view(np.int64)


def short_keys(h: np.ndarray) -> np.ndarray:
    """Hashes of what a short text leaves without up to as many words as edits are allowed: linked ones have a key in common."""
    if len(h) > SHORT:
        return np.empty(0, np.int64)
    most = int((1 - SIMILARITY) * len(h) + 1e-9)
    left = {tuple(np.delete(h, list(gone)).tolist()) for d in range(most + 1) for gone in combinations(range(len(h)), d)}
    return np.array([xxhash.xxh3_64_intdigest(np.array(x, np.uint64).tobytes()) for x in sorted(left)], np.uint64).view(np.int64)


def keys_of(h: np.ndarray) -> np.ndarray:
    """All bucket hashes of a text: linked texts on both sides of LONG or SHORT words lie within its quarter."""
    out = [short_keys(h)]
    if len(h) >= SIMILARITY * LONG:
        out.append(sketch(h))
    if SIMILARITY * (SHORT + 1) <= len(h) < LONG / SIMILARITY:
        out.append(sketch(h, FEW))
    return np.concatenate(out)


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two word sequences if it is at most ``most``, else None: a whole row of differences is two integers' bits."""
    if abs(len(a) - len(b)) > most:
        return None
    for step in (1, -1):  # without what both begin and end with
        size = min(len(a), len(b))
        differ = np.flatnonzero(a[::step][:size] != b[::step][:size])
        cut_ = int(differ[0]) if len(differ) else size
        a, b = (a[cut_:], b[cut_:]) if step == 1 else (a[: len(a) - cut_], b[: len(b) - cut_])
    if not len(a) or not len(b):
        return max(len(a), len(b))
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    every, last = (1 << len(a)) - 1, len(a) - 1
    up, down, d = every, 0, len(a)  # where the next word of ``a`` adds an edit and where it takes one; edits of all of ``a``
    room = most + len(b)
    for w in b.tolist():
        same = places.get(w, 0)
        x = same | down
        h = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(h | up)), up & h
        d += (more >> last & 1) - (less >> last & 1)
        room -= 1
        if d > room:  # each word left takes one at most
            return None
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(x | more)) & every, more & x & every
    return d if d <= most else None


def chained(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits of one alignment inside the band: through the k-mers that are single in both texts and in the same order."""
    x, y = kmers(a, ANCHOR), kmers(b, ANCHOR)
    ux, ix, cx = np.unique(x, return_index=True, return_counts=True)
    uy, iy, cy = np.unique(y, return_index=True, return_counts=True)
    _, p, q = np.intersect1d(ux[cx == 1], uy[cy == 1], assume_unique=True, return_indices=True)
    i, j = ix[cx == 1][p], iy[cy == 1][q]
    near = np.abs(i - j) <= most
    order = np.argsort(i[near])
    i, j = i[near][order], j[near][order]
    if len(i):
        up = j >= np.maximum.accumulate(j)
        i, j = i[up], j[up]
    # match single words at both ends of each k-mer run: a step of (di, dj) costs at most what is not on one diagonal
    i, j = np.r_[-1, np.repeat(i, 2), len(a)], np.r_[-1, np.repeat(j, 2), len(b)]
    size = min(ANCHOR, len(a), len(b))
    i[2:-1:2] += size - 1
    j[2:-1:2] += size - 1
    di, dj = np.diff(i), np.diff(j)
    # inside a k-mer, and where k-mers overlap on one diagonal, all words match; other gaps are rewritten whole
    gap = np.maximum(di, dj) - 1
    gap[1:-1:2] = 0
    over = (di == dj) & (di <= 0)
    gap[over] = 0
    bad = ~over & ((di <= 0) | (dj <= 0))
    if bad.any():
        return most + 1
    return int(np.maximum(gap, 0).sum())


def histogram(h: np.ndarray) -> np.ndarray:
    return np.bincount((h % np.uint64(BINS)).astype(np.int64), minlength=BINS)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sequences of word hashes have the edit similarity; an edit changes at most two bins of the histogram by one each."""
    long = max(len(a), len(b))
    most = int((1 - least) * long + 1e-9)
    if min(len(a), len(b)) < long - most or np.abs(histogram(a) - histogram(b)).sum() > 2 * most:
        return False
    if len(a) == len(b) and int((a != b).sum()) <= most:
        return True
    return long > CHAINED and chained(a, b, most) <= most or edits_within(a, b, most) is not None


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, node, sketch): node is a digest of the text's words, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordHash()
        for b in slices(batches):
            if len(ids) > CACHE:
                ids.clear()
            nodes, flat, n = [], [], [0]
            for t in texts_of(b.column(2)):
                w = t.split()
                nodes.append(hashlib.md5(b" ".join(w)).digest() if w else None)
                if w:
                    flat.append(keys_of(np.fromiter(map(ids.__getitem__, w), np.uint64, len(w))))
                n.append(n[-1] + (len(flat[-1]) if w else 0))
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(n, pa.int32()), values)], ["doc_id", "_th", "node", "sketch"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, _th long, node binary, sketch array<long>")


def hashed_words(texts: DataFrame) -> DataFrame:
    """(id, words) of (id, text): 32 bits of the hash of each word, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordHash()
        for b in slices(batches):
            if len(ids) > CACHE:
                ids.clear()
            words = []
            for t in texts_of(b.column(1)):
                w = t.split()
                words.append((np.fromiter(map(ids.__getitem__, w), np.uint64, len(w)) >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], ["id", "words"])

    return texts.mapInArrow(run, "id long, words binary")


def unpacked(words: bytes) -> np.ndarray:
    return np.frombuffer(words, np.uint32).astype(np.uint64)


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Of (a, b) pairs those whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, y = (list(map(unpacked, b.column(c).to_pylist())) for c in (2, 3))
            keep = pa.array([similar(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    left, right = (words.select(F.col("id").alias(k), F.col("words").alias(t)) for k, t in (("a", "wa"), ("b", "wb")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def binned(words: list[np.ndarray]) -> list[bytes]:
    """How many words of each text fall into each of ``BINS`` by hash, up to 255."""
    return [np.minimum(histogram(x), 255).astype(np.uint8).tobytes() for x in words]


def histograms(words: DataFrame) -> DataFrame:
    """(id, n, bins): the number of words, and their histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h = list(map(unpacked, b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in h], pa.int32()), pa.array(binned(h), pa.binary())], ["id", "n", "bins"])

    return words.mapInArrow(run, "id long, n int, bins binary")


def possible(n: np.ndarray, bins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels whose lengths and histograms allow a link: an edit changes at most two bins by one each."""
    left, right, order = [], [], np.argsort(n, kind="stable")
    n, bins, label = n[order], bins[order].astype(np.int16), label[order]
    most = np.floor((1 - SIMILARITY) * n + 1e-9).astype(np.int64)
    for j in range(1, len(n)):
        i = np.flatnonzero((n[:j] >= n[j] - most[j]) & (label[:j] != label[j]))
        if len(i):
            i = i[np.abs(bins[i] - bins[j]).sum(1) <= 2 * most[j]]
            left.append(order[i])
            right.append(np.full(len(i), order[j]))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def within(entries: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b): the pairs of nodes of one bucket that have different labels and may be linked.  ``entries``: h, id, label; at most BUCKET of an h."""
    return met(entries.join(histograms(words.join(entries.select("id").distinct(), "id", "left_semi")), "id"))


def met(x: DataFrame) -> DataFrame:
    """As ``within``, of (h, id, label, n, bins) rows; where these hold words too, only the pairs that are similar."""
    held = [c for c in ("id", "label", "n", "bins", "words") if c in x.columns]
    groups = x.groupBy("h").agg(F.collect_list(F.struct(*held)).alias("m"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2")

    def packed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.empty(0, np.int64) for k in (0, 1))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        a, b = a[keep], b[keep]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
        return pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(a)], pa.int32()), pa.array(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, size = [], 0
        for b in slices(batches, 16_000_000):
            for m in b.column(0):
                m = m.values
                id_, label = (m.field(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
                bins = np.frombuffer(b"".join(m.field("bins").to_pylist()), np.uint8).reshape(len(id_), -1)
                i, j = possible(m.field("n").to_numpy(zero_copy_only=False), bins, label)
                if "words" in held:
                    t = list(map(unpacked, m.field("words").to_pylist()))
                    keep = np.array([similar(t[p], t[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)
                    i, j = i[keep], j[keep]
                pairs.append((np.maximum(id_[i], id_[j]), np.minimum(id_[i], id_[j])))
                size += len(i)
                if size > 500_000:
                    yield packed(pairs)
                    pairs, size = [], 0
        yield packed(pairs)

    # a pair is found in each bucket that it shares: a node's partners travel in one row a task
    lists = groups.select("m").mapInArrow(run, "a long, b array<long>").groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("b"))).alias("b"))
    return lists.select("a", F.explode("b").alias("b"))


def occurrences(words: bytes) -> np.ndarray:
    """Hashes of a text's runs of ``PAIR`` words, those of later occurrences told apart: no two are equal."""
    return labelled(kmers(unpacked(words), PAIR))


def uint64(x: list[int]) -> np.ndarray:
    return np.array(x, np.int64).view(np.uint64)


def slots(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def tally(rows: DataFrame, items: Callable, marks: Callable, bits: int, finish: Callable = lambda n: n) -> np.ndarray:
    """By the slot of an item of ``items(x)`` of (id, label, x) rows: how many have it, the sum of the first of ``marks(id, label)``
    and the least of each other; of these rows what ``finish`` makes of them.  All are numbers of 31 bits."""
    size = 1 << bits
    run_ = max(1, size // RUNS)

    def empty(marked: int, n: int) -> np.ndarray:
        return np.repeat(np.array([0, 0, *[MOST_32] * (marked - 1)], np.int32)[:, None], n, 1)

    def add(n: np.ndarray, at: np.ndarray, x: list[np.ndarray]) -> None:
        for i, v in enumerate(x):
            (np.add if i < 2 else np.minimum).at(n[i], at, v.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = None
        for b in slices(batches, 1_000_000):
            x, m = list(map(items, b.column(2).to_pylist())), marks(b.column(0).to_numpy(), b.column(1).to_numpy())
            n = empty(len(m), size) if n is None else n
            many, at = [len(t) for t in x], slots(np.concatenate(x), bits)
            add(n, at, [np.ones(len(at), np.int32), *(np.repeat(v, many) for v in m)])
        if n is not None:
            at = np.flatnonzero(n[0])
            ends = np.searchsorted(at, np.arange(0, size + run_, run_))
            some = [(i, slice(*ends[i : i + 2])) for i in range(size // run_) if ends[i] < ends[i + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([np.vstack([at[s] % run_, n[:, at[s]]]).astype(np.int32).tobytes() for _, s in some], pa.binary()), pa.array([len(n)] * len(some), pa.int32())], ["at", "n", "k"])

    def added(t: pa.Table) -> pa.Table:
        k = t.column("k")[0].as_py()
        n = empty(k - 1, run_)
        for x in t.column("n").to_pylist():
            x = np.frombuffer(x, np.int32).reshape(k + 1, -1)
            add(n, x[0], list(x[1:]))
        n = finish(n)
        return pa.table({"at": t.column("at")[:1], "n": pa.array([n.astype(np.int32).tobytes()], pa.binary()), "k": pa.array([len(n)], pa.int32())})

    kind = "at long, n binary, k int"
    got = rows.mapInArrow(run, kind).groupBy("at").applyInArrow(added, kind).toArrow()  # 34 MB at most
    out = np.zeros((max(got.column("k").to_pylist(), default=1), size), np.int32)
    for at, n in zip(got.column("at").to_pylist(), got.column("n").to_pylist(), strict=True):
        out[:, at * run_ : (at + 1) * run_] = np.frombuffer(n, np.int32).reshape(len(out), run_)
    return out


def seeded(ids: np.ndarray) -> list[np.ndarray]:
    """Two orders of nodes."""
    return [(mixed(mixed(ids.astype(np.uint64) * PLACES[i] + PLACES[i + 1])) >> np.uint64(34)).astype(np.int64) for i in range(2)]


def prefixes(texts: DataFrame, bits: int, common: int) -> DataFrame:
    """(id, label, n, bins, words, keys): each node's keys; linked nodes of different labels have one in common.

    A key stands for runs of words: by itself for one of up to ``common`` nodes, for others by the two least of the nodes that
    have the run.  The runs of one frame are in the same texts, so they make a few keys and not one each.
    """
    found = tally(texts.select("id", "label", "words"), occurrences, lambda ids, _: [np.zeros(len(ids)), *seeded(ids)], bits)
    sent = texts.sparkSession.sparkContext.broadcast(found[[0, 2, 3]] if len(found) == 4 else np.zeros((3, 1 << bits), np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, least, other = sent.value
        for b in slices(batches, 1_000_000):
            out, h = [], list(map(unpacked, b.column(2).to_pylist()))
            for t in b.column(2).to_pylist():
                x = occurrences(t)
                at = slots(x, bits)
                c = count[at]
                # the longer of two texts may have a word more of which an edit more is allowed
                o = np.lexsort((x, c))[: PAIR * int((1 - SIMILARITY) * (len(t) // 4 + 1) + 1e-9) + 1]
                o = o[c[o] > 1]
                few, many = o[c[o] <= common], at[o[c[o] > common]]
                out.append(np.unique(np.concatenate([x[few], mixed(mixed(mixed(least[many].astype(np.uint64)) * np.uint64(31) + other[many].astype(np.uint64)))])))
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate(out).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in h], pa.int32()), pa.array(binned(h), pa.binary()), b.column(2), keys], ["id", "label", "n", "bins", "words", "keys"])

    return texts.select("id", "label", "words").mapInArrow(run, "id long, label long, n int, bins binary, words binary, keys array<long>")


def rare_entries(texts: DataFrame, whole: int = BUCKET, common: int = COMMON) -> DataFrame:
    """(h, id, label, n, bins, words) of (id, label, words) rows: linked nodes of different labels have an h in common.

    A node has an entry for each of its keys that nodes of another label have too.  A key of over ``whole`` nodes is dealt in
    parts of half as many: labels of over ``whole`` nodes by themselves, the rest together; an entry goes to every pair
    of parts with its own, but for those of one such label.
    """
    large = {r.label: r.size for r in texts.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") > whole).sort("label").collect()}
    total = texts.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    bits = max(LEAST_BITS, min(MOST_BITS, (total // 4).bit_length()))
    dealt = cut(prefixes(texts, bits, common))
    every = list(large)

    def labels(_, label: np.ndarray) -> list[np.ndarray]:
        low, high = label & MOST_32, label >> 31
        return [~np.isin(label, every), low, -low, high, -high]

    def several(n: np.ndarray) -> np.ndarray:
        """Counts, 0 where one label has the slot for itself, and counts without large labels."""
        return np.stack([np.where((n[2] == -n[3]) & (n[4] == -n[5]), 0, n[0]), n[1]])

    counts = tally(dealt.select("id", "label", "keys"), uint64, labels, bits, several)
    sent = texts.sparkSession.sparkContext.broadcast(counts if len(counts) == 2 else np.zeros((2, 1 << bits), np.int32))
    half = max(1, whole // 2)
    first, parts = {}, 0  # of each large label its first part behind those of the rest, and how many it has
    for x, size in large.items():
        first[x] = (parts, -(-size // half))
        parts += first[x][1]

    def keys(x: np.ndarray, rest: int, id_: int, label: int) -> np.ndarray:
        """One key's h: of each pair of parts that the node is in."""
        spot = int(mixed(np.array([id_], np.uint64))[0])
        at, own = (first[label][0] + rest, first[label][1]) if label in first else (0, 0)
        mine = at + spot % own if own else spot % rest
        q = np.arange(rest + parts, dtype=np.uint64)
        q = q[(q < at) | (q >= at + own)]
        return mixed(mixed(x + np.minimum(q, np.uint64(mine))) * np.uint64(31) + np.maximum(q, np.uint64(mine)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rest = sent.value
        for b in slices(batches, 1_000_000):
            out = []
            for id_, label, x in zip(*(b.column(c).to_pylist() for c in (0, 1, 5)), strict=True):
                x = uint64(x)
                at = slots(x, bits)
                hot = count[at] > whole
                out.append(np.concatenate([x[~hot & (count[at] > 1)], *(keys(y, -(-int(rest[i]) // half), id_, label) for y, i in zip(x[hot], at[hot], strict=True))]))
            n, every = np.repeat(np.arange(len(out)), [len(x) for x in out]), np.concatenate(out).view(np.int64)
            rows = b.select(["id", "label", "n", "bins", "words"])
            for i in range(0, len(n), 2_000):
                some = rows.take(pa.array(n[i : i + 2_000]))
                yield pa.RecordBatch.from_arrays([pa.array(every[i : i + 2_000]), *some.columns], ["h", *some.schema.names])

    return dealt.mapInArrow(run, "h long, id long, label long, n int, bins binary, words binary")


def classes(df: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, _th, class_id, kept) of (doc_id, text) rows; kept marks the one row of a class that stays."""
    with without_broadcast(ready(df.sparkSession)):
        return _classes(df, bucket)


def _classes(df: DataFrame, bucket: int) -> DataFrame:
    docs = keyed(df)
    marks = cut(sketches(docs))
    rows = cut(marks.select("doc_id", "_th", "node"))
    nodes = rows.where(F.col("node").isNotNull())
    one = marks.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "_th")).alias("x"), F.first("sketch").alias("sketch"))
    one = cut(one.withColumn("id", F.monotonically_increasing_id()))
    forget(marks)
    # entries are made anew where they are needed: written, they would be the largest table of all
    entries = one.select("id", F.explode(F.array_distinct("sketch")).alias("h"))
    pivots = entries.groupBy("h").agg(F.min("id").alias("pivot"), F.count("*").alias("size")).where("size > 1").select("h", "pivot")
    pairs = cut(entries.join(pivots, "h").where("id <> pivot").groupBy(F.col("id").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("common")))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(one.select("id", "x.*"), "id").select("id", F.col("doc_id").alias("d"), F.col("_th").alias("t"))
    texts = docs.join(wanted, docs.doc_id.eqNullSafe(F.col("d")) & (docs._th == F.col("t"))).select("id", "text")
    words = cut(hashed_words(texts).dropDuplicates(["id"]))
    # first each node with the pivot of most common buckets; then its other pivots, but for those of its component by then
    first = pairs.groupBy("a").agg(F.max(F.struct("common", "b")).alias("x")).select("a", "x.b")
    edges = cut(verified(first, words))
    labels = components(edges)
    of = [labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}")) for k in ("a", "b")]
    rest = pairs.join(of[0], "a", "left").join(of[1], "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "common")
    rest = cut(rest.join(first, ["a", "b"], "left_anti").select("a", "b"))
    forget(pairs)

    def linked(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges and labels with those of ``found`` that are similar."""
        new = cut(verified(found, words))
        if not new.limit(1).count():
            forget(new)
            return edges, labels
        every = cut(edges.union(new))
        made = components(every)
        forget(new, edges, labels)
        return every, made

    edges, labels = linked(rest)
    forget(rest)
    # what is still open: buckets of several components
    now = entries.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("h", "id", F.coalesce("label", "id").alias("label"))
    several = now.groupBy("h").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count("*").alias("size")).where("l1 <> l2").select("h", "size")
    now = cut(now.join(several, "h"))
    small, members = now.where(F.col("size") <= bucket), now.where(F.col("size") > bucket).select("id", "label").distinct()
    if small.limit(1).count():
        found = cut(within(small, words))
        edges, labels = linked(found)
        forget(found)
    if members.limit(1).count():
        members = cut(members.select("id").join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label")))
        texts = cut(words.join(members, "id").select("id", "label", "words"))
        found = cut(met(rare_entries(texts, bucket)))  # similar already: pairs of one frame are many, links few
        edges, labels = linked(found)
        forget(members, texts, found)
    forget(now, words)
    order = rank(F.col("doc_id"), F.col("_th"))
    full = nodes.join(one.select("node", "id"), "node").join(labels.select(F.col("node").alias("id"), "label"), "id", "left")
    full = full.select("doc_id", "_th", F.coalesce("label", "id").alias("label"), order.alias("rank"))
    least = full.groupBy("label").agg(F.min(F.struct("rank", "_th")).alias("first"))
    joined = full.join(least, "label").select("doc_id", "_th", F.col("first.rank").alias("class_id"), (F.struct("rank", "_th") == F.col("first")).alias("kept"))
    rest = rows.where(F.col("node").isNull()).select("doc_id", "_th", order.alias("class_id"), F.lit(True).alias("kept"))
    out = cut(joined.unionByName(rest))
    forget(rows, one, edges, labels)
    return out


def deduped(df: DataFrame) -> DataFrame:
    """Rows of ``df``, one of each class: that of the least doc_id; repeated rows are one."""
    text = F.col("text").cast("string")
    th = F.when(text.isNotNull(), F.xxhash64(text))
    keys = classes(df).where("kept").select(rank(F.col("doc_id"), F.col("_th")).alias("_o"), F.coalesce("_th", F.lit(0)).alias("_t"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), rank(F.col("doc_id"), th).alias("_o"), F.coalesce(th, F.lit(0)).alias("_t"))
    return rows.join(keys, ["_o", "_t"], "left_semi").dropDuplicates(["_o", "_t"]).select("row.*")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


QUERIES = {"op9_order_minhash": op9_order_minhash}
ORACLE_SQL: dict[str, str] = {}
