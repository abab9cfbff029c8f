"""Suffix dedup against a brute-force version on whole small tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bwt

SCHEMA = "doc_id long, text string, key int, shard string, kept int, names string"


def brute(rows, length=50):
    data = [(d, (t or "").encode()) for d, t in rows]
    least: dict[bytes, float] = {}
    rank = lambda d: float("inf") if d is None else d
    for d, t in data:
        for k in range(len(t) - length + 1):
            g = t[k:k + length]
            least[g] = min(least.get(g, float("inf")), rank(d))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if least[t[k:k + length]] < rank(d):
                gone[k:k + length] = b"\1" * length
        spans = []
        for k, g in enumerate(gone):
            if g and (not k or not gone[k - 1]):
                spans.append([k, k])
            if g:
                spans[-1][1] = k + 1
        out.append((d, len(t), bytes(c for c, g in zip(t, gone) if not g), [tuple(s) for s in spans]))
    return sorted(out, key=str)


def removed(spark, rows, length=50, parts=4, **kw):
    df = spark.createDataFrame([(*r, 0, "a", 1, "b") for r in rows], SCHEMA).repartition(parts)
    got = bwt.remove_repeated(df, length, **kw).collect()
    return sorted(((r.doc_id, r.n_bytes, bytes(r.kept), [(s.start, s.stop) for s in r.spans]) for r in got), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["ab", "ba", "abab", "kéy", "lorem", "ipsum", "日本", "x", "a\x00b", "dolor", "sit"]
    prose = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(k))
    shared = [prose(rng.choice([20, 30, 60])) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [prose(rng.choice([0, 3, 30])) for _ in range(4)]
        for _ in range(rng.choice([1, 2, 4])):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts.insert(rng.randrange(len(parts)), s[a:a + rng.choice([49, 60, 400, 400])])
        rows.append((rng.randrange(n), "".join(parts)))
    rows += [(500, None), (501, ""), (502, "a" * 49), (503, "a" * 50), (504, "a" * 300), (2, "a" * 120), (505, "ab" * 200),
             (506, "ab" * 30), (507, rows[3][1]), (508, rows[3][1]), rows[5], rows[5], (None, rows[4][1]), (None, None),
             (None, rows[4][1] + rows[6][1]), (-9, rows[8][1]), (509, "\x00" * 70), (510, "\x00" * 60)]
    return rows


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"bucket_bytes": 700}), (3, {"bucket_bytes": 3000, "hot": 3}),
                                     (4, {"bucket_bytes": 100, "hot": 1})])
def test_equals_brute_force(spark, seed, kw):
    rows = corpus(seed)
    want = brute(rows)
    assert sum(bool(w[3]) for w in want) > 9 and sum(not w[3] for w in want) > 9
    assert removed(spark, rows, **kw) == want


@pytest.mark.parametrize("length", [20, 33, 64])
def test_other_lengths(spark, length):
    rows = corpus(5, 30)
    assert removed(spark, rows, length, bucket_bytes=2000) == brute(rows, length)


def test_a_group_of_copies_and_a_passage_in_a_third(spark):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    same, passage = noise(400), noise(80)
    rows = [(i, same) for i in range(0, 150, 3)] + [(i, noise(60) + passage + noise(60)) for i in range(1, 150, 3)]
    rows += [(i, noise(150)) for i in range(2, 150, 3)]
    want = brute(rows)
    assert removed(spark, rows) == want
    assert removed(spark, rows, hot=10) == want


def test_empty_table_and_the_query(spark, tmp_path):
    assert removed(spark, []) == []
    rows = corpus(6, 25)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    from tessera.llm import queries
    got = queries.queries()["op13_suffix_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted(((d, n, n - len(k), len(s), hashlib.sha256(k).hexdigest()) for d, n, k, s in brute(rows)), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_bytes_that_are_no_utf8_stay(spark):
    raw = b"\xff\xfe" * 40
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"x" + raw[:60]))], "doc_id long, raw binary")
    got = bwt.remove_repeated(df.select("doc_id", F.col("raw").cast("string").alias("text"))).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == [(1, raw), (2, b"x")]


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame(corpus(7, 20), "doc_id long, text string")
    plan = bwt.remove_repeated(df)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert not [x for x in plan.split("\n") if "Exchange" in x and "text" in x]


def test_chunks_of_a_long_text_lose_no_window(monkeypatch):
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([1200, 1230, 5000])
    whole = bwt.runs_of(buf, ends, 50)
    monkeypatch.setattr(bwt, "CHUNK", 300)
    cut = bwt.runs_of(buf, ends, 50)
    spread = lambda r: [(p, int(n)) for a, b, n in zip(*r) for p in range(a, b + 1)]
    assert spread(whole) == spread(cut)
    assert [p for p, _ in spread(whole)] == [p for p in range(4951) if p <= 1150 or p >= 1230]


def test_the_transform_sorts_whole_suffixes():
    rng = random.Random(4)
    strings = sorted({bytes(rng.choice(b"ab\x00") for _ in range(rng.choice([5, 20, 60]))) for _ in range(30)})
    strings += strings[:5]
    buf = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    out, whole = bwt.transform(buf, np.cumsum(size) - size, size)
    rows = sorted((s[k:], n, k) for n, s in enumerate(strings) for k in range(len(s) + 1))
    assert out.tolist() == [strings[n][k - 1] if k else 0 for _, n, k in rows]
    assert whole.tolist() == [r for r, (_, _, k) in enumerate(rows) if not k]


@pytest.mark.parametrize("bits", [bwt.RANK_BITS, 3])
def test_transform_sorts_suffixes_as_one_number_or_by_keys(bits, monkeypatch):
    """Equal suffixes stay in the order of their strings, whichever way they are sorted."""
    monkeypatch.setattr(bwt, "RANK_BITS", bits)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab\x00") for _ in range(rng.choice([1, 6, 7, 8, 14, 60]))).encode() for _ in range(80)]
    texts += texts[:9] + [b"a" * 50, b"a" * 57, b"\x00" * 21]
    size = np.array([len(t) for t in texts])
    out, whole = bwt.transform(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size)
    rows = sorted((t[k:], i, k) for i, t in enumerate(texts) for k in range(len(t) + 1))
    assert out.tolist() == [texts[i][k - 1] if k else 0 for _, i, k in rows]
    assert whole.tolist() == [at for at, (_, _, k) in enumerate(rows) if not k]


def test_runs_do_not_depend_on_the_chunks(monkeypatch):
    rng = np.random.RandomState(4)
    ends = np.cumsum([0, 30, 50, 400, 0, 49, 51, 900])
    buf = rng.randint(97, 100, ends[-1]).astype(np.uint8)

    def windows():
        first, last, name = bwt.runs_of(buf, ends, 50)
        return {(p, n) for a, b, n in zip(first.tolist(), last.tolist(), name.tolist()) for p in range(a, b + 1)}
    whole = windows()
    inside = [p for a, b in zip([0, *ends], ends) for p in range(a, b - 49)]
    assert sorted(p for p, _ in whole) == inside
    monkeypatch.setattr(bwt, "CHUNK", 64)
    assert windows() == whole
