"""Decontamination against a plain search over all diagonals of all pairs."""

import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.llm import decontam

WORDS = [f"w{k}" for k in range(60)]


def plain_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum() or c == "_":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_best(same):
    """(matches, -length, -start) of the best stretch, tried from the definition
    of its ends: cut the sparser end until three quarters match."""
    best, at = (0, 0, 0), [k for k, s in enumerate(same) if s]
    runs, run = [], []
    for k in at:
        if run and k - run[-1] > 4:
            runs.append(run)
            run = []
        run.append(k)
    for run in [*runs, run]:
        while run:
            if 4 * len(run) >= 3 * (run[-1] + 1 - run[0]):
                if len(run) > best[0]:
                    best = (len(run), run[0] - run[-1] - 1, -run[0])
                break
            run = run[1:] if run[1] - run[0] >= run[-1] - run[-2] else run[:-1]
    return best


MASKS = ["1101101011", "1011010111", "1110011101", "1010111011"]


def plain(doc, item):
    """(start, item start, length, matches) or None."""
    d, t = plain_words(doc), plain_words(item)
    found = None
    for shift in range(-len(t), len(d) + 1):
        lo, hi = max(0, -shift), min(len(t), len(d) - shift)
        if hi <= lo:
            continue
        same = [t[k] == d[k + shift] for k in range(lo, hi)]
        if len(t) < 10:
            if len(t) >= 5 and len(same) == len(t) and all(same):
                got = (len(t), -len(t), -shift, 0)
            else:
                continue
        else:
            marks = "".join("1" if s else "0" for s in same)
            seed = any(all(marks[k + o] == "1" for o in range(10) if m[o] == "1")
                       for m in MASKS for k in range(len(marks) - 9))
            m, n, s = plain_best(same) if seed else (0, 0, 0)
            if m < min(12, max(5, 0.6 * len(t))):
                continue
            got = (m, n, -(lo - s + shift), -(lo - s))
        found = max(found, got) if found else got
    return found and (-found[2], -found[3], -found[1], found[0])


def corpus(seed):
    rng = random.Random(seed)
    def text(n): return [rng.choice(WORDS) for _ in range(n)]
    items = [text(n) for n in (10, 12, 14, 25, 60, 5, 9)] + [["same"] * 30, text(200)]
    docs = []
    for k in range(60):
        t = text(rng.randint(0, 60))
        w = list(items[k % len(items)])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "other"
        a = rng.randint(0, len(w) // 3)
        docs.append(" ".join(t + w[a if k % 3 == 0 else 0:] + text(rng.randint(0, 30))))
    return docs + ["same " * 80, "", None], [" ".join(w) for w in items] + [None, "", "w1 w2"]


@pytest.mark.parametrize("cell", [decontam.BLOCK, 30])
def test_same_overlaps_as_the_plain_search(spark, cell):
    docs, items = corpus(cell)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.length, r.matched)
           for r in decontam.contamination(d, b, cell).collect()}
    want = {(i, k): found for i, x in enumerate(docs) for k, y in enumerate(items) if (found := plain(x, y))}
    assert got == want and len(want) > 30


def test_copies_of_documents_and_items_give_every_pair(spark):
    rng = random.Random(2)
    leak = " ".join(rng.choice(WORDS) for _ in range(40))
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("x " + leak))
                                 .otherwise(F.concat(F.lit("clean text "), "id")).alias("text"))
    d = d.unionByName(spark.createDataFrame([(None, leak)], "doc_id long, text string"))
    b = spark.createDataFrame([(1, leak), (1, leak), (None, leak), (2, leak.upper())], "item_id long, text string")
    got = decontam.contamination(d, b)
    assert got.count() == 1001 * 4
    counts = {(r.item_id, r.n) for r in got.groupBy("item_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {(1, 2002), (None, 1001), (2, 1001)}


def test_long_runs_of_equal_tokens_are_one_diagonal_each():
    items = decontam.Items([(k, "same " * 200) for k in range(20)])
    ids = decontam.Tokens().of("same " * 5000)
    assert [(x[0], *x[2:]) for x in items.overlaps(ids)] == [(k, 0, 200, 200) for k in range(20)]


def test_bytes_that_are_no_text(spark):
    d = spark.sql("SELECT 1L AS doc_id, CAST(concat(CAST('a b c d e f ' AS BINARY), X'FF20', CAST('g h' AS BINARY)) AS STRING) AS text")
    b = spark.createDataFrame([(1, "b c d e f"), (2, "f g h i j")], "item_id long, text string")
    assert [(r.item_id, r.doc_start) for r in decontam.contamination(d, b).collect()] == [(1, 1)]


def test_short_items_by_parameter(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert decontam.contamination(d, b).count() == 0
    assert decontam.contamination(d, b, shortest=2).count() == 1


def test_query_on_the_whole_table(spark):
    """The registered query finds what the plain search finds."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()
    grams = [{tuple(w[k:k + 4]) for k in range(len(w) - 3)} for w in (plain_words(x.text) for x in items)]
    want = set()
    for r in docs:
        w = plain_words(r.text)
        mine = {tuple(w[k:k + 4]) for k in range(len(w) - 3)}
        # 12 matches at a density of 3/4 within one stretch hold four in a row.
        want |= {(r.doc_id, x.item_id) for x, g in zip(items, grams) if g & mine and plain(r.text, x.text)}
    got = entry.queries()["op2_decontamination"](spark, SMALL)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_filter_holds_two_bits_of_every_hash(spark):
    h = np.array([0, 1, -1, 2 ** 62, -2 ** 63, 123456789 << 20], np.int64)
    bits = decontam.hash_filter(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert len(bits) * 8 == 1 << decontam.FILTER_BITS
    at = np.concatenate(decontam.bits_of(h.view(np.uint64)))
    assert np.unpackbits(bits, bitorder="little").sum() == len(set(at.tolist()))
    assert all(bits[int(b) >> 3] >> (int(b) & 7) & 1 for b in at)
