"""Spelling variants against a brute-force version on whole small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, length=7, times=2, drop=31):
    found = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if drop and h % drop == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= times}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(words, factor=10):
    form, out = {}, []
    close = {w: [(-words[v], v) for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        m, v = min(close[w], default=(0, None))
        form[w] = v if v is not None and -m >= factor * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéöÿ") for _ in range(rng.choice([5, 7, 8, 9, 10, 12]))) for _ in range(60)]
    def word():
        w = base[min(int(rng.expovariate(0.08)), len(base) - 1)]
        if rng.random() < 0.1:
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1:]])
        return rng.choice([w, w, w.upper(), w.capitalize(), "x1" + w, w + "'s"])
    rows = [(i, " ".join(word() for _ in range(rng.choice([3, 80, 300])))) for i in range(40)]
    long = "".join(rng.choice("abc") for _ in range(40_000))
    rows += [(100, None), (101, ""), (102, "中文 ×÷×÷×÷× 1234567"), (None, rows[0][1]), (7, rows[7][1]), (7, rows[7][1]),
             (103, f"{long} {long} {long[:999] + 'd' + long[1000:]} {long[:-1]} {long[:-1]} {long[1:]}d"),
             (104, f"{long[:999] + 'd' + long[1000:]} {long[:999] + 'd' + long[1000:]}"),
             # Anagrams, which no plane of a tree can part.
             (105, " ".join(w for w in ("".join(rng.sample("abcdefg", 7)) for _ in range(150)) for _ in range(2)))]
    return rows


def docs_df(spark, rows):
    return spark.createDataFrame([(*r, "q", 1, "w") for r in rows], "doc_id long, text string, word string, n int, cell string")


@pytest.mark.parametrize("cell,sample", [(spelling.CELL, spelling.SAMPLE), (12, 10 ** 6), (5, 60)])
def test_equals_brute_force(spark, cell, sample, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = corpus(cell)
    words = spelling.word_counts(docs_df(spark, rows), 7, 2, 31)
    want = brute_words(rows)
    assert dict(words.collect()) == want
    found = spelling.spelling_variants(words, 10, cell, sample)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(tuple(r) for r in found.collect())
    assert [g[0] for g in got if g[1]], "some words have forms"
    assert got == brute(want)


def test_chains_of_forms_and_ties(spark):
    words = {"abcdefg": 10_000, "abcdefh": 900, "abcdehh": 80, "abcddhh": 7, "abxdefg": 1, "abydefg": 1, "zzzzzzz": 5,
             "zzzzzza": 50, "zzzzzzb": 50, "abcdef": 3, "abcdefgh": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(tuple(r) for r in spelling.spelling_variants(df).collect())
    assert got == brute(words)
    assert {g[0]: g[2] for g in got}["abcddhh"] == "abcdefg"
    assert {g[0]: g[1] for g in got}["zzzzzzz"] == "zzzzzza"


def test_nothing_to_do(spark):
    empty = docs_df(spark, [])
    assert spelling.spelling_variants(spelling.word_counts(empty, 7, 2, 31)).collect() == []
    words = spelling.word_counts(docs_df(spark, [(1, None), (2, ""), (3, "short words")]), 7, 2, 31)
    assert spelling.spelling_variants(words).collect() == []


def test_text_that_is_no_utf8(spark):
    from pyspark.sql import functions as F
    raw = spark.createDataFrame([(1, bytearray(b"lettersa\xff lettersa\xc3 lettersb"))], "doc_id long, raw binary")
    docs = raw.select("doc_id", F.col("raw").cast("string").alias("text"))
    assert dict(spelling.word_counts(docs, 7, 1).collect()) == {"lettersa": 2, "lettersb": 1}


def test_trees_reach_every_point_within_the_distance():
    rng = np.random.default_rng(5)
    p = rng.integers(0, 3, (500, spelling.DIMS)).astype(np.int16) * (np.arange(spelling.DIMS) < 5)
    tree = spelling.upper_tree(p[:200], 0.4, 10)
    home = {}
    for leaf, rows, far in spelling.visits(tree, p, 0):
        for r in rows.tolist():
            assert r not in home
            home[r] = leaf
    assert len(home) == len(p) and len(set(home.values())) > 10
    seen = {(leaf, r) for leaf, rows, _ in spelling.visits(tree, p, 2) for r in rows.tolist()}
    pairs = [(a, b) for a in range(100) for b in range(len(p)) if np.abs(p[a] - p[b]).sum() <= 2]
    assert all((home[b], a) in seen for a, b in pairs)
    found = {(int(x), int(y)) for xs, ys in spelling.at_distance(p, p[:100], 2) for x, y in zip(xs, ys)}
    assert found == {(a, b) for a, b in pairs if np.abs(p[a] - p[b]).sum() == 2}
