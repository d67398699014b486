"""BPE encoding and decoding with numpy merge rounds (operator 1).

``encode_decode(df, path)`` returns, per row of ``df``: doc_id, ids
(array<int>) and decoded (string).  Encoding does what the ``tokenizers``
library does with the vocabulary file (NFC, white space, lower case, split,
byte symbols, end-of-word mark, merges), without that library: the symbols of
many distinct words lie in one flat array; every round looks up all adjacent
pairs by binary search in the sorted pair keys and merges, in each word, its
lowest-ranked pair.  Unicode's classes and cases come in versions: the driver
asks the library once for letters, numbers and lower case of every code point
(``unicode_tables``), and chunks with a code point on which Python's tables
differ take those; without the library, Python's hold.  Vocabulary and tables
travel to the workers by broadcast; their size is the vocabulary's.

Defined results.  Null or empty text, or white space only: no ids, empty
decoded text.  Repeated rows give equal rows.  Extra input columns are dropped.
Long texts: work is per white-space separated chunk, memory per slice of rows.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import ragged, slices, table

#: Chunks remembered by one worker before it starts afresh; bounds its memory.
CACHE = 200_000
#: Bytes of texts taken at once: places of symbols and of decoded bytes take some fifty times as many.
SLICE = 500_000
#: White space by Unicode's property, which is what the vocabulary's normalizer collapses.
SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: str.split() also splits at these, the normalizer does not.
ODD = regex.compile(r"[\x1c-\x1f]")
NONE = np.iinfo(np.int64).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


@lru_cache(maxsize=1)
def unicode_tables() -> tuple[str, str, dict[int, str], frozenset[int]]:
    """Letters and numbers that the library knows, as ranges of a character class, lower case where it differs from
    Python's, and all code points on which any of the three or the order of combining marks differ."""
    try:
        from tokenizers import Regex, normalizers, pre_tokenizers
    except ImportError:
        return r"\p{L}", r"\p{N}", {}, frozenset()
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]

    odd: set[int] = set()

    def members(one: str) -> str:
        split, found = pre_tokenizers.Split(Regex(one + "+"), "removed", invert=True), []
        for i in range(0, len(points), 20_000):
            found += [ord(c) for piece, _ in split.pre_tokenize_str("".join(points[i : i + 20_000])) for c in piece]
        odd.update(set(found).symmetric_difference(map(ord, regex.findall(one, "".join(points)))))
        x = np.unique(np.array(found))
        breaks = np.flatnonzero(np.diff(x) > 1)
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(x[np.r_[0, breaks + 1]].tolist(), x[np.r_[breaks, len(x) - 1]].tolist(), strict=True))

    plain = [c for c in points if c not in "\r\n"]
    low = normalizers.Lowercase().normalize_str("\n".join(plain)).split("\n")
    for frame in ("x\u0301{}\n", "x{}\u0323\n", "x{}\u0301\n", "x\u0323{}\n"):  # combining classes show in the order of marks
        for i in range(0, len(plain), 20_000):
            rows = "".join(map(frame.format, plain[i : i + 20_000]))
            found, own = normalizers.NFC().normalize_str(rows), unicodedata.normalize("NFC", rows)
            if found != own:
                odd.update(ord(c) for c, a, b in zip(plain[i : i + 20_000], found.split("\n"), own.split("\n"), strict=False) if a != b)
    lower = {ord(c): x for c, x in zip(plain, low, strict=True) if x != c.lower()}
    return members(r"\p{L}"), members(r"\p{N}"), lower, frozenset(odd | set(lower))


class WordBPE:
    """Vocabulary, merge table and caches of one worker."""

    def __init__(self, spec: bytes, tables: tuple[str, str, dict[int, str], frozenset[int]]):
        spec = json.loads(spec)
        letters, numbers, self.lower, self.odd = tables
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        try:  # code points that Python's tables lack may combine by the library's
            from tokenizers import normalizers

            self.compose = normalizers.NFC().normalize_str
        except ImportError:
            self.compose = lambda p: unicodedata.normalize("NFC", p)
        self.exact = pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.mark = regex.compile("|".join(regex.escape(s[0]) for s in self.special)) if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.int64)
        self.last = np.array([self.vocab[s + self.end] for s in symbols], np.int64)
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.base = size
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in map(self._pair, model["merges"])]
        a, b, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        key = a * size + b
        order = np.argsort(key, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = key[order][1:] != key[order][:-1]
        order = order[first]
        self.keys, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        # If every symbol is made by one merge only, all occurrences of a pair may merge in one round.
        self.all_at_once = len(np.unique(made)) == len(made)
        # Of each id the text it stands for, as the library decodes without a decoder: tokens joined by one space.
        names = [""] * size
        for s, i in (self.vocab | self.special).items():
            names[i] = s
        self.names = [n.encode() for n in names]
        self.name_len = np.array([len(n) for n in self.names], np.int64)
        self.name_at = np.cumsum(self.name_len) - self.name_len
        self.name_bytes = np.frombuffer(b"".join(self.names), np.uint8)
        self._forget()

    @staticmethod
    def _pair(m) -> tuple[str, str]:
        return tuple(m) if not isinstance(m, str) else tuple(m.split(" "))

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.ids, self.lengths, self.starts = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), lengths)
        sym = self.inner[raw]
        ends = np.cumsum(lengths)[lengths > 0] - 1
        sym[ends] = self.last[raw[ends]]
        out_sym, out_word = [], []
        while len(sym):
            key = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.where(ok, self.rank[at], NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(np.r_[rank, NONE], starts)
            which = np.cumsum(np.r_[True, word[1:] != word[:-1]]) - 1
            going = best != NONE
            hit = np.flatnonzero(ok & (rank == best[which[:-1]]))
            if self.all_at_once:
                # in a run of overlapping hits every second one merges, from the left
                fresh = np.r_[True, hit[1:] != hit[:-1] + 1] if len(hit) else np.empty(0, bool)
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0)) if len(hit) else hit
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            else:
                hit = hit[np.r_[True, which[hit][1:] != which[hit][:-1]]] if len(hit) else hit
            sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            done = ~going[which]
            out_sym.append(sym[done])
            out_word.append(word[done])
            keep &= ~done
            sym, word = sym[keep], word[keep]
        if not out_sym:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        s, w = np.concatenate(out_sym), np.concatenate(out_word)
        order = np.argsort(w, kind="stable")
        return s[order], np.bincount(w, minlength=len(words))

    def _parts(self, chunk: str) -> Iterator[str | int]:
        """Words of one chunk without white space; special tokens as their id."""
        pieces = self.cut.split(chunk) if self.mark and self.mark.search(chunk) else [chunk]
        for p in pieces:
            if p in self.special:
                yield self.special[p]
            elif p:
                odd = not p.isascii() and not self.odd.isdisjoint(map(ord, p))
                p = self.compose(p) if odd else unicodedata.normalize("NFC", p)
                if odd:
                    yield from (m.group() for m in regex.finditer(self.exact, "".join(self.lower.get(ord(c)) or c.lower() for c in p)))
                else:
                    p = "".join(c.lower() for c in p) if "Σ" in p else p.lower()
                    yield from (m.group() for m in self.split.finditer(p))

    def _learn(self, chunks: list[str]) -> None:
        words: dict[bytes, int] = {}
        plans = []
        for c in chunks:
            plans.append([-1 - x if isinstance(x, int) else words.setdefault(x.encode(), len(words)) for x in self._parts(c)])
        ids, n = self.merge(list(words))
        at = np.cumsum(n) - n
        ids = np.concatenate([ids, np.arange(self.base)])  # special tokens point behind the words' ids
        flat = np.array([x for p in plans for x in p], np.int64)
        plain = flat >= 0
        size, start = np.ones(len(flat), np.int64), len(ids) - self.base + (-1 - flat)
        if len(n):
            size[plain], start[plain] = n[flat[plain]], at[flat[plain]]
        made = ids[ragged(start, size)]
        of_chunk = np.repeat(np.arange(len(plans)), [len(p) for p in plans])
        lengths = np.bincount(of_chunk, weights=size, minlength=len(plans)).astype(np.int64)
        first = len(self.seen)
        self.seen.update((c, first + i) for i, c in enumerate(chunks))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.ids, self.lengths = np.concatenate([self.ids, made]), np.concatenate([self.lengths, lengths])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        chunks = [[c for c in SPACE.split(t) if c] if ODD.search(t) else t.split() for t in texts]
        if len(self.seen) > CACHE:
            self._forget()
        new = [c for c in dict.fromkeys(c for x in chunks for c in x) if c not in self.seen]
        if new:
            self._learn(new)
        n = [len(x) for x in chunks]
        at = np.fromiter((self.seen[c] for x in chunks for c in x), np.int64, sum(n))
        size = self.lengths[at]
        ids = self.ids[ragged(self.starts[at], size)]
        return ids, np.bincount(np.repeat(np.arange(len(texts)), n), weights=size, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each document's ids: their names joined by one space."""
        size = self.name_len[ids] + 1
        raw = np.full(int(size.sum()), 32, np.uint8)
        ends = np.cumsum(size)
        raw[ragged(ends - size, size - 1)] = self.name_bytes[ragged(self.name_at[ids], size - 1)]
        stop = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        blob = raw.tobytes()
        return [blob[a : max(a, b - 1)].decode() for a, b in zip(stop[:-1], stop[1:], strict=True)]


@lru_cache(maxsize=4)
def model(path: str) -> WordBPE:
    return WordBPE(Path(path).read_bytes(), unicode_tables())


#: The models of one worker, by the hash of their vocabulary.
_MODELS: dict[int, WordBPE] = {}


def encode_decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string, one row per row of ``df``; nothing is shuffled."""
    sent = df.sparkSession.sparkContext.broadcast((Path(path or default_path()).read_bytes(), unicode_tables()))
    key = hash(sent.value[0])

    def run(batches):
        if key not in _MODELS:
            _MODELS[key] = WordBPE(*sent.value)
        bpe = _MODELS[key]
        for b in slices(batches, SLICE):
            ids, n = bpe.encode([t or "" for t in b.column(1).to_pylist()])
            offsets = np.r_[0, np.cumsum(n)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(bpe.decode(ids, n), pa.string())], ["doc_id", "ids", "decoded"])

    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, ids array<int>, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """The contract's columns from ids and decoded text."""
    joined: Column = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode_decode(table(spark, sf_dir, "documents")))


QUERIES = {"op1_bpe": op1_bpe}
ORACLE_SQL: dict[str, str] = {}
