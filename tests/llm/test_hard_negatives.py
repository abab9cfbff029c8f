"""Hard negatives against a brute-force version on whole small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, score string, slot int, grp string"


def brute(rows, is_anchor, positives=5, k=3, scale=256.0, low=50, high=95):
    size = max((len(r[1]) for r in rows if r[1]), default=0)
    good = []
    for i, v, y in rows:
        if i is None or y is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(scale * x) for x in v] + [0] * (size - len(v)), y))
    cut = lambda x: min(max(x, -2 ** 63), 2 ** 63 - 1)
    out = []
    for n, (i, v, y) in enumerate(good):
        if not is_anchor(i):
            continue
        others = [(-cut(sum(a * b for a, b in zip(v, w))), j, z) for m, (j, w, z) in enumerate(good) if m != n]
        for ps, p, _ in sorted(o for o in others if o[2] == y)[:positives]:
            fit = sorted(o for o in others if o[2] != y and low * -ps <= 100 * -o[0] <= high * -ps)[:k]
            out += [(i, p, r + 1, j, -ps, -s) for r, (s, j, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    found = hardneg.hard_negatives(df, F.col("vec_id") % 5 == 0, **kw)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def table(seed, n=400, labels=4, d=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), 0.25, 0.5]) for _ in range(d)], rng.randrange(labels)) for i in range(n)]
    rows += [(900, None, 1), (905, [], 1), (910, [float("nan")] * d, 1), (915, [None] * d, 1), (920, [1.0] * d, None),
             (None, [1.0] * d, 1), (925, [float("inf")] + [0.0] * (d - 1), 2), (930, [0.5], 0), (935, [0.0] * d, 3),
             (940, [-1.0] * d, 77)]
    # Repeated rows, a vec_id with several vectors, and ties.
    return rows + [rows[0], rows[0], rows[5], (5, rows[7][1], 2), *[(1000 + j, [0.5] * d, j % 2) for j in range(60)]]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    # Several groups, cells and blocks even on a small table.
    monkeypatch.setattr(hardneg, "ROWS", 64)
    monkeypatch.setattr(hardneg, "ANCHORS", 16)
    monkeypatch.setattr(hardneg, "BLOCK_BYTES", 8 * 6 * 20)
    rows = table(seed)
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 300
    assert mined(spark, rows) == want


def test_other_limits_and_one_label_for_a_third(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(0, 1) for _ in range(4)], 0 if i % 3 == 0 else rng.randrange(50)) for i in range(300)]
    want = brute(rows, lambda i: i % 5 == 0, positives=2, k=4, scale=8.0, low=20, high=110)
    assert mined(spark, rows, positives=2, k=4, scale=8.0, low=20, high=110) == want


def test_scores_beyond_a_long_are_cut(spark):
    rows = [(0, [3e9, 1.0], 0), (1, [2e9, 0.0], 0), (2, [1e9, 5.0], 1), (3, [1.2e9, 5.0], 1), (4, [1e300, 0.0], 1),
            (6, [2.0 ** 44, 0.0], 0)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, None, 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (5, [1.0], 2)]) == []
