"""Suffix-array dedup of byte strings (operator 10).

A byte goes if it is covered by a ``LENGTH``-byte string that also starts
anywhere else in the corpus, the same document included.

Dealing out.  Every start of a LENGTH-byte string is owned by the string's
minimizer: of its 32-byte strings the one with the least hash, the leftmost of
equals.  Equal strings have equal minimizers at equal places, so only starts
whose minimizers are equal can match.  One row for each run of starts with one
owner: (minimizer, hash of the bytes under the run, text, first start, last
start).  Minimizers that occur once are dropped.  Of the others, runs with equal
bytes become one with their number (partial sums, so a passage in a third of all
documents is a row a task); where several different ones share a minimizer, the
bytes of one run of each are fetched and dealt to groups.

In a group, runs go that share 116 bytes around the minimizer, to its left or to
its right, with no other run: a LENGTH-byte string reaches that far on one side.
Then threshold-bounded interval expansion: the runs, separated, are one text;
its suffixes are sorted by their first 256 bytes and give a Burrows-Wheeler
transform.  Breadth first, from the empty string, intervals of strings are
extended backwards by every byte before them; an interval's right end gets the
string's length as common prefix when it is first reached, and only then is the
interval extended further.  That derives common prefixes by increasing value; it
stops at LENGTH, and the ends not reached by then are neighbours that share
LENGTH bytes or more.

A minimizer with more than ``HOT`` different runs is no group of its own: its
runs are cut into parts by how far a string reaches to the left of the minimizer
(``WIDTHS`` places a part), equal parts merge with their number, and a part's
group is the hash of the bytes that all strings of the part contain.  Parts that
still have over HOT different runs are cut again, down to single strings, where
equal group means equal bytes.  No run is dropped.

Defined results.  A text is known by 128 bits of its hash; rows with equal text
are occurrences of their own, each text's runs are stored once, and doc_id is
only carried along, whatever its type, null or repeated.  Null text is empty:
nothing removed.  Texts under LENGTH bytes keep all.  Extra columns are dropped;
an empty table gives an empty one.  Long texts are cut into overlapping chunks
for the minimizers only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import cut, forget, ragged, ready, slices, stored, table, texts_of

LENGTH, GRAM = 200, 32
WINDOW = LENGTH - GRAM + 1
HALF = WINDOW // 2  # a LENGTH-byte string reaches so far from its minimizer on one side at least
HOT, WIDTHS = 4096, (21, 3, 1)
KEYS = 1_000_000  # text keys that are broadcast at most; beyond that all texts are joined
CHUNK = 1 << 20  # places in a chunk take 20 bits of the sort key
GROUP = 2_000_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


UP, DOWN = _powers(BASE, CHUNK), _powers(INVERSE, CHUNK)
BYTES = np.random.default_rng(10).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def owners(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each run of starts with one owner, over one text: first start, last start, place of the minimizer from the
    first start, hash of the minimizer, hash of the bytes under the run."""
    out = []
    for at in range(0, max(len(raw) - LENGTH + 1, 0), CHUNK - LENGTH):
        x = raw[at : at + CHUNK - 1]
        if len(x) < LENGTH:
            break
        run = np.r_[np.zeros(1, np.uint64), np.cumsum(BYTES[x] * UP[: len(x)], dtype=np.uint64)]
        n = len(x) - GRAM + 1
        h = _mixed((run[GRAM:] - run[:-GRAM]) * DOWN[:n])
        key = (h & ~np.uint64(CHUNK - 1)) | np.arange(n, dtype=np.uint64)
        pad = -n % WINDOW
        grid = np.r_[key, np.full(pad, TOP)].reshape(-1, WINDOW)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - WINDOW + 1
        best = np.minimum(right[:starts], left[WINDOW - 1 : WINDOW - 1 + starts])
        starts = min(starts, CHUNK - LENGTH)  # the rest begins the next chunk
        own = (best[:starts] & np.uint64(CHUNK - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        last = np.r_[first[1:] - 1, starts - 1]
        whole = _mixed((run[last + LENGTH] - run[first]) * DOWN[first] + (last - first).astype(np.uint64))
        out.append((at + first, at + last, own[first] - first, h[own[first]].view(np.int64), whole.view(np.int64)))
    if not out:
        return (np.empty(0, np.int64),) * 5
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def suffixes(text: np.ndarray, depth: int = 256) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` symbols: by 8 symbols, then doubling what is still tied."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    padded = np.r_[text, np.zeros(8, np.uint8)]
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    s = key[order]
    head = np.r_[True, s[1:] != s[:-1]]
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = start
    rank[n] = -1
    del key, s
    have = 8
    while have < depth:
        tied = np.flatnonzero(~(head & np.r_[head[1:], True]))  # places in groups of two or more
        if not len(tied):
            break
        who = order[tied]
        second = rank[np.minimum(who + have, n)]
        pair = start[tied] * (n + 2) + second + 1
        by = np.argsort(pair, kind="stable")
        pair = pair[by]
        order[tied] = who[by]
        head[tied] = np.r_[True, pair[1:] != pair[:-1]]
        start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order[tied]] = start[tied]
        have *= 2
    return order


def shared(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """True at each place whose suffix shares ``least`` symbols or more, none a separator (0), with the one before it."""
    n = len(text)
    bwt = text[order - 1]  # the symbol before each suffix; before the first stands a separator
    by = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)
    back[by] = np.arange(n)
    same = bwt[by][1:] == bwt[by][:-1]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[by[1:][same]] = by[:-1][same]
    after[by[:-1][same]] = by[1:][same]
    real = bwt != 0
    prefix = np.full(n + 1, -1, np.int16)
    prefix[0] = prefix[n] = 0
    low, high = np.array([0]), np.array([n])
    for length in range(least):
        size = high - low
        at = ragged(low, size)
        lo, hi = np.repeat(low, size), np.repeat(high, size)
        ok = real[at]
        left = np.sort(back[at[ok & (before[at] < lo)]])
        right = np.sort(back[at[ok & (after[at] >= hi)]]) + 1
        new = prefix[right] < 0
        prefix[right[new]] = length
        low, high = left[new], right[new]
        if not len(low):
            break
    return prefix[:n] < 0


def repeated(strings: list[bytes], counts: list[int], least: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each string the (start, end) runs of bytes covered by least-byte strings that start twice or more."""
    if not strings:
        return []
    lengths = np.array([len(s) for s in strings], np.int64)
    joined = b"\0".join(strings) + b"\0"
    raw = np.frombuffer(joined, np.uint8)
    stops = np.cumsum(lengths + 1) - 1
    begins = stops - lengths
    # bytes 0 of the strings must differ from separators; symbols are bytes + 1, and byte 255 (in no UTF-8 text) stays
    text = np.minimum(raw.astype(np.uint16) + 1, 255).astype(np.uint8)
    text[stops] = 0
    order = suffixes(text)
    left = np.repeat(stops, lengths + 1)[order] - order  # bytes up to the separator
    valid = left >= least
    pair = shared(text, order, least) & valid & np.r_[False, valid[:-1]]
    hit = np.zeros(len(text), bool)
    hit[order[pair]] = True
    hit[order[np.flatnonzero(pair) - 1]] = True
    out = []
    for b, e, c in zip(begins, stops, counts, strict=True):
        if c > 1:
            out.append([(0, int(e - b))])
            continue
        at = np.flatnonzero(hit[b : e - least + 1])
        if not len(at):
            out.append([])
            continue
        cut = np.flatnonzero(np.diff(at) > least)
        out.append([(int(x), int(y) + least) for x, y in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]], strict=True)])
    return out


COVER = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
RUN = "m long, k long, lo int, more int, place int"


def _runs(docs: DataFrame) -> DataFrame:
    """(h1, h2, m, k, lo, more, place) of (h1, h2, text): a row for each run, k the hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            parts, n = [], []
            for t in texts_of(b.column(2)):
                parts.append(owners(np.frombuffer(t, np.uint8)))
                n.append(len(parts[-1][0]))
            row = pa.array(np.repeat(np.arange(b.num_rows), n))
            lo, hi, place, m, k = (np.concatenate(c) for c in zip(*parts, strict=True))
            small = [pa.array(x.astype(np.int32)) for x in (lo, hi - lo, place)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(m), pa.array(k), *small], ["h1", "h2", "m", "k", "lo", "more", "place"])

    return docs.mapInArrow(run, f"h1 long, h2 long, {RUN}")


def _strings(joined: DataFrame) -> DataFrame:
    """(m, k, n, place, s) of (text, wanted): the bytes under the wanted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1_000_000):
            wanted, texts = b.column(1), texts_of(b.column(0))
            each = wanted.flatten()
            lo, more = (each.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("lo", "more"))
            rows = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(wanted).to_numpy(zero_copy_only=False)).tolist()
            s = [texts[r][a : a + e + LENGTH] for r, a, e in zip(rows, lo, more, strict=True)]
            yield pa.RecordBatch.from_arrays([each.field("m"), each.field("k"), each.field("n"), each.field("place"), pa.array(s, pa.binary())], ["m", "k", "n", "place", "s"])

    return joined.mapInArrow(run, "m long, k long, n long, place int, s binary")


def partnered(m: list[int], place: list[int], s: list[bytes]) -> list[int]:
    """Numbers of the runs that share ``HALF`` bytes to the left or right of one minimizer, and itself, with another."""
    seen, keys = Counter(), []
    for g, p, x in zip(m, place, s, strict=True):
        left = (g, x[p - HALF : p + GRAM]) if p >= HALF else None
        right = (g, 1, x[p : p + GRAM + HALF]) if len(x) >= p + GRAM + HALF else None
        keys.append((left, right))
        seen[left] += 1
        seen[right] += 1
    del seen[None]
    return [i for i, (a, b) in enumerate(keys) if seen[a] > 1 or seen[b] > 1]


def _expanded(strings: DataFrame, groups: int) -> DataFrame:
    """(m, k, cover) of (m, k, n, place, s): what of each run other starts cover, group by group."""

    def expand(t: pa.Table) -> pa.Table:
        m, n, place, s = (t.column(c).to_pylist() for c in ("m", "n", "place", "s"))
        cover = [[(0, len(x))] if c > 1 else [] for x, c in zip(s, n, strict=True)]
        some = partnered(m, place, s)
        for i, x in zip(some, repeated([s[i] for i in some], [n[i] for i in some]), strict=True):
            cover[i] = x
        keep = [i for i, x in enumerate(cover) if x]
        at = pa.array(keep, pa.int64())
        return pa.table({"m": t.column("m").take(at), "k": t.column("k").take(at), "cover": pa.array([[{"a": a, "b": b} for a, b in cover[i]] for i in keep], COVER)})

    return strings.withColumn("g", F.pmod("m", F.lit(groups)).cast("int")).groupBy("g").applyInArrow(expand, "m long, k long, cover array<struct<a:int,b:int>>")


def _groups(strings: DataFrame, length) -> int:
    return max(1, -(-(strings.agg(F.sum(length)).first()[0] or 0) // GROUP))


def _parted(strings: DataFrame, width: int) -> DataFrame:
    """(m, k, off, m2, k2, n, place, s): runs cut by how far a string reaches to the left of the minimizer, ``width`` places a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200_000):
            rows = []
            for m, k, n, place, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for part in range(max(0, place - (len(s) - LENGTH)) // width, place // width + 1):
                    least, most = part * width, min((part + 1) * width - 1, WINDOW - 1)
                    far = min(place, most)
                    off = place - far
                    x = s[off : place - max(least, place - (len(s) - LENGTH)) + LENGTH]
                    core = s[place - least : place - most + LENGTH]  # in every string of the part
                    rows.append((m, k, off, xxhash.xxh3_64_intdigest(core, part) - (1 << 63), xxhash.xxh3_64_intdigest(x, far) - (1 << 63), n, far, x))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["m", "k", "off", "m2", "k2", "n", "place", "s"])

    return strings.select("m", "k", "n", "place", "s").mapInArrow(run, "m long, k long, off int, m2 long, k2 long, n long, place int, s binary")


def _split(strings: DataFrame, hot: int, widths: tuple[int, ...]) -> DataFrame:
    """(m, k, cover) of the runs of hot minimizers, by parts; at width 1 every group has one run."""
    strings = cut(strings)
    parts = _parted(strings, widths[0])  # made twice; its bytes are never written
    bare = cut(parts.groupBy("m2", "k2").agg(F.sum("n").alias("n"), F.first(F.struct("place", "s")).alias("x")).select(F.col("m2").alias("m"), F.col("k2").alias("k"), "n", "x.*"))
    one = bare.join(bare.groupBy("m").agg(F.count("*").alias("runs")), "m")
    whole = one.where("runs = 1 and n > 1").select("m", "k", F.array(F.struct(F.lit(0).alias("a"), F.length("s").alias("b"))).alias("cover"))
    small = one.where((F.col("runs") > 1) & (F.col("runs") <= hot)).drop("runs")
    cover = whole.unionByName(_expanded(small, _groups(small, F.length("s"))))
    rest = one.where(F.col("runs") > hot).drop("runs")
    if len(widths) > 1 and rest.limit(1).count():
        cover = cover.unionByName(_split(rest, hot, widths[1:]))
    cover = cover.select(F.col("m").alias("m2"), F.col("k").alias("k2"), "cover")
    moved = F.transform("cover", lambda c: F.struct((c["a"] + F.col("off")).alias("a"), (c["b"] + F.col("off")).alias("b")))
    out = cut(parts.select("m", "k", "off", "m2", "k2").join(cover, ["m2", "k2"]).select("m", "k", moved.alias("cover")))
    forget(strings, bare)
    return out


def spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(h1, h2, runs): for each text with bytes to remove, their (a, b) runs; ``docs`` is (h1, h2, text)."""
    rows = _runs(docs)
    twice = rows.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select(F.col("m").alias("g"))
    # each phase is written, so that its shuffle files are gone before the next one makes its own;
    # equal texts have equal runs: the set is one text's, and the number of rows tells how many texts there are
    found = rows.join(twice, F.col("m") == F.col("g")).groupBy("h1", "h2").agg(F.collect_set(F.struct("m", "k", "lo", "more", "place")).alias("found"), F.count("*").alias("rows"))
    found = stored(found)
    each = found.select("h1", "h2", (F.col("rows") / F.size("found")).cast("long").alias("n"), F.explode("found").alias("f")).select("h1", "h2", "n", "f.*")
    counted = stored(each.groupBy("m", "k").agg(F.sum("n").alias("n"), F.min(F.struct("h1", "h2", "lo", "more", "place")).alias("x")))
    one = counted.join(counted.groupBy("m").agg(F.count("*").alias("runs")), "m")
    whole = one.where("runs = 1 and n > 1").select("m", "k", F.array(F.struct(F.lit(0).alias("a"), (F.col("x.more") + LENGTH).alias("b"))).alias("cover"))
    need = one.where("runs > 1")

    def fetched(runs: DataFrame) -> DataFrame:
        wanted = runs.groupBy("x.h1", "x.h2").agg(F.collect_list(F.struct("m", "k", "n", "x.lo", "x.more", "x.place")).alias("wanted"))  # of one text
        keys = runs.select("x.h1", "x.h2").distinct()
        few = docs.join(F.broadcast(keys), ["h1", "h2"], "left_semi") if keys.count() <= KEYS else docs
        return _strings(few.dropDuplicates(["h1", "h2"]).join(wanted, ["h1", "h2"]).select("text", "wanted"))

    cool = need.where(F.col("runs") <= hot)
    covers = [cut(whole.unionByName(_expanded(fetched(cool), _groups(cool, F.col("x.more") + LENGTH))))]
    if need.where(F.col("runs") > hot).limit(1).count():
        covers.append(_split(fetched(need.where(F.col("runs") > hot)), hot, WIDTHS))
    forget(counted)
    cover = covers[0] if len(covers) == 1 else covers[0].unionByName(covers[1])
    cover = cover.select(F.col("m").alias("gm"), F.col("k").alias("gk"), "cover")
    places = each.join(cover, (F.col("m") == F.col("gm")) & (F.col("k") == F.col("gk"))).select("h1", "h2", "lo", F.explode("cover").alias("c"))
    runs = cut(places.groupBy("h1", "h2").agg(F.collect_set(F.struct((F.col("lo") + F.col("c.a")).alias("a"), (F.col("lo") + F.col("c.b")).alias("b"))).alias("runs")))
    forget(found, *covers)
    return runs


def dedup_bytes(df: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, removed (maximal (a, b) runs), kept (binary), one row per row of ``df``."""
    ready(df.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = df.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(10), text).alias("h2"), text.alias("text"))
    joined = docs.join(spans(docs.select("h1", "h2", "text"), hot), ["h1", "h2"], "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept, removed, texts = [], [], texts_of(b.column(1))
            for t, runs in zip(texts, b.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for x in sorted(((r["a"], r["b"]) for r in runs or ())):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append([*x])
                ends = [0, *(y for m in merged for y in m), len(t)]
                kept.append(b"".join(t[a:e] for a, e in zip(ends[::2], ends[1::2], strict=True)))
                removed.append([{"a": a, "b": e} for a, e in merged])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, COVER), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, n_bytes long, removed array<struct<a:int,b:int>>, kept binary")


def op10_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_byte_dedup": op10_byte_dedup}
ORACLE_SQL: dict[str, str] = {}
