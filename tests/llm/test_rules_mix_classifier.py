"""Quality rules against an independent version, mixing without ids, classifier inputs, BPE on every code point."""

import random
from collections import Counter

import numpy as np
import pytest

from inkstone.llm import bpe, mixing, quality_classifier, quality_rules, sentence_dedup


def repeats(w, k=8):
    c = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return len({i + j for i in range(len(w) - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(k)})


def verdict(text):
    """Every rule in plain words, without the module's own counts."""
    w = [x for x in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in text).split(" ") if x]
    lines = [x for x in text.split("\n") if any(c not in " \t\r\x0b\x0c" for c in x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    dup = len(lines) - len(set(lines))
    n, chars = len(w), sum(map(len, w))
    failed = n < 20 or 100 * repeats(w) > 30 * n
    strip = lambda x: x.strip(" \t\r\x0b\x0c")
    letters = [c for c in text if c.isalpha()]
    bad = [
        symbols / n > 0.1 if n else True,
        n and not 2 <= chars / n <= 12,
        dup > 2 and dup / max(len(lines), 1) > 0.3,
        sum(strip(x)[:1] in ("-", "*", "•", "·") for x in lines) > 0.9 * len(lines),
        sum(strip(x).endswith(("...", "…")) for x in lines) > 0.3 * len(lines),
        sum(any(c.isascii() and c.isalpha() or not c.isascii() for c in x) for x in w) < 0.8 * n,
        sum(a == b for a, b in zip(w, w[1:], strict=False)) > 0.25 * n,
        sum(c.isupper() for c in text) > 0.3 * len(letters),
        text.count("!") > 0.3 * n,
    ]
    return symbols, dup, repeats(w), failed, not failed and not any(bad)


def documents():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeéü") for _ in range(r.randrange(2, 9)))
    text = lambda n=60: " ".join(word() for _ in range(n))
    out = [text() for _ in range(10)]
    out += ["# " * 20 + text(), text(30) + " " + "a" * 900, "\n".join([text(5)] * 9 + [text(50)]), "\n".join("- " + text(6) for _ in range(9)), "\n".join(text(7) + " ..." for _ in range(8)), text(20) + " 12 34" * 20]
    out += [" ".join(x for x in text(30).split() for _ in range(2)), text().upper(), text().replace(" ", "! "), "", "one", " \n\t", text(8) * 5, "same line here\n" * 12]
    return out


def test_verdicts_against_plain_rules(spark):
    texts = documents()
    rows = [(i, t, 1, True) for i, t in enumerate(texts)] + [(0, texts[0], 2, False), (None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean")
    out = quality_rules.judge(d, quality_rules.plan(d)).collect()
    assert len(out) == len(rows)
    kept = set()
    for x in out:
        t = texts[x.doc_id] if x.doc_id is not None else ""
        assert (x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept) == verdict(t), (x, t[:80])
        kept.add(x.kept)
    assert kept == {True, False}
    assert {x.rejected_by for x in out if x.rejected_by} >= {"base", "symbols", "word_length", "shouting", "exclamations"}


def test_order_is_rejection_per_cost_and_stops_early(monkeypatch):
    calls = Counter()

    def rule(name, spin, rejects):
        def f(facts):
            calls[name] += 1
            for _ in range(spin):
                pass
            return rejects(facts)

        return f

    monkeypatch.setattr(quality_rules, "RULES", {"dear": rule("dear", 200_000, lambda f: f.n_words % 2 == 0), "cheap": rule("cheap", 100, lambda f: f.n_words % 2 == 0), "never": rule("never", 1, lambda f: False)})
    texts = [" ".join(f"w{i}x{j}" for j in range(20 + i)) for i in range(30)]
    assert [n for n, _, _ in quality_rules.estimate(texts)] == ["cheap", "dear", "never"]


def test_sample_reaches_the_driver_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_rules, "estimate", lambda texts: seen.append(texts) or [])
    d = spark.createDataFrame([(i, f"text {i % 300}") for i in range(3000)] + [(-1, "x" * (quality_rules.LONG + 1)), (-2, None)], "doc_id long, text string")
    quality_rules.plan(d, sample=20)
    assert len(seen[0]) == len(set(seen[0])) <= 20 and all(len(t) < 20 for t in seen[0])


def test_mix_of_rows_without_ids(spark):
    """Half the ids null, and copies: each source still comes near its target."""
    r = random.Random(2)
    rows = [(None if i % 2 else i, " ".join(["w"] * r.randrange(1, 90)), f"s{i % 5}", 0) for i in range(1500)]
    rows += [(7, "one and the same text", "s1", 0)] * 300 + [(None, None, "s1", 0), (None, "a b", None, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, h int")
    got = mixing.shares(d).collect()
    assert len(got) == len(rows)
    taken, goal = Counter(), {}
    for x in got:
        taken[x.source] += x.copies * x.size
        goal[x.source] = x.target
        assert 0 <= x.copies <= 2
    assert all(abs(taken[s] - goal[s]) <= 90 for s in goal)
    key = lambda rows: Counter((x.doc_id, x.size, x.source, x.copies) for x in rows)
    again = mixing.shares(d.repartition(7)).collect()
    assert key(got) == key(again)
    assert mixing.mix(d).count() == sum(x.copies for x in got)


def test_salts():
    assert mixing.salts_for(100, 3) == 1 and mixing.salts_for(10**9, 20) == 1000 and mixing.salts_for(10**12, 10) == mixing.MOST_SALTS
    assert mixing.salts_for(10**9, 10**7) == 10


def test_classifier_takes_one_text_an_id(spark, monkeypatch):
    sizes = []
    fit = quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda ids, x, starts, y: sizes.append((len(starts) - 1, sorted(y))) or fit(ids, x, starts, y))
    d = spark.createDataFrame([(1, f"text number {i}") for i in range(200)] + [(2, "other words"), (3, "third")], "doc_id long, text string")
    y = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (None, 1), (4, 5)], "doc_id long, y int")
    quality_classifier.train(d, y)
    assert sizes == [(2, [0.0, 1.0])]


def test_classifier_metadata(spark):
    names = quality_classifier.STATS
    x = dict(zip(names, quality_classifier.structure("été да".encode(), ["été".encode(), "да".encode()], 2, 6), strict=True))
    assert x["misdeclared"] == 0.0 and x["non_ascii"] == 8 / 10 and x["far_scripts"] == 2 / 10
    assert dict(zip(names, quality_classifier.structure(b"abc", [b"abc"], 1, 9), strict=True))["misdeclared"] == 1.0
    m = quality_classifier.Machine(0.0, np.ones(quality_classifier.BUCKETS + len(names)), np.zeros((quality_classifier.BUCKETS + len(names), 2)))
    d = spark.createDataFrame([(1, "a b", "x", 3), (2, None, None, None)], "doc_id long, text string, score string, n_chars int").drop("score")
    assert {r.doc_id for r in quality_classifier.score(d, m).collect()} == {1, 2}


def test_sentence_dedup_without_numbers_for_ids(spark):
    r = random.Random(6)
    s = lambda: " ".join(r.choice("river stone lamp walk green seven light quiet".split()) + str(r.randrange(30)) for _ in range(14)) + ". "
    shared = s() + s() + s()
    texts = [s() + shared + s(), s() + shared, shared + s() + s(), s() + s() + s()]
    for ids in ([None] * 4, ["a", "b", "c", "d"]):
        d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id string, text string")
        out = [x.text for x in sentence_dedup.dedup(d).collect()]
        assert sum(shared in t for t in out) == 1 and sum(t in texts for t in out) == 2
    assert sentence_dedup.dedup(d.limit(0)).count() == 0


@pytest.mark.parametrize("block", range(0, 0x110000, 0x8800 * 4))
def test_bpe_on_every_code_point(block):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.model(bpe.default_path())
    points = [chr(c) for c in range(block, min(block + 0x8800 * 4, 0x110000)) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{''.join(points[i : i + 16])}b" for i in range(0, len(points), 16)] + [f"a{c}b {c}" for c in points[::61]]
    ids, n = own.encode(texts)
    ends = np.cumsum(n)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [ids[e - k : e].tolist() for e, k in zip(ends.tolist(), n.tolist(), strict=True)] == want
