"""Order-free sums of products of doubles, against exact fractions."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from conftest import coo_df
from tessera.functions import exact
from tessera.plans import chooser as ch

STRATEGIES = ["coo", "coo_merge", "coo_shuffle_hash", "coo_salted", "coo_broadcast", "coo_broadcast_rows",
              "coo_broadcast_left", "block", "block_broadcast", "auto"]
FEW = ["coo", "coo_broadcast_rows", "block"]


def as_double(x: Fraction) -> float:
    return float(x)      # fractions round to nearest


def brute(a, b):
    rows = {}
    for k, j, v in b:
        rows.setdefault(k, []).append((j, v))
    out = {}
    for i, k, x in a:
        for j, y in rows.get(k, ()):
            if x is not None and y is not None:
                out.setdefault((i, j), []).append((x, y))
    got = {}
    for cell, terms in out.items():
        if all(math.isfinite(x * y) for x, y in terms):
            v = as_double(sum((Fraction(x) * Fraction(y) for x, y in terms), Fraction(0)))
        else:
            v = sum(x * y for x, y in terms if not math.isfinite(x * y))
        if v != 0:
            got[cell] = v
    return got


def same(x, y):
    return x == y or (math.isnan(x) and math.isnan(y))


def check(spark, a, b, strategies):
    A, B = coo_df(spark, a).cache(), coo_df(spark, b).cache()
    want = brute(a, b)
    for s in strategies:
        got = {(r.i, r.j): r.v for r in ch.matmul(A, B, s, bs=5, tile_min_pairs=1).collect()}
        assert got.keys() == want.keys(), s
        bad = [(c, got[c], want[c]) for c in want if not same(got[c], want[c])]
        assert not bad, (s, bad[:3])
    return want


def cells(rng, n, m, make, share=0.7):
    return [(i, j, make(rng)) for i in range(n) for j in range(m) if rng.random() < share]


KINDS = {
    "cents": lambda r: r.randrange(-10 ** 6, 10 ** 6) / 100,
    "cancelling": lambda r: r.choice([1e16, -1e16, 1.0, -1.0, 2.0 ** -30, 3.0, 0.1]),
    "wide": lambda r: r.uniform(-1, 1) * 2.0 ** r.randrange(-120, 120),
    "whole": lambda r: float(r.randrange(-50, 50)),
}


@pytest.mark.parametrize("kind", KINDS)
def test_every_strategy_gives_the_rounded_exact_sum(spark, kind):
    rng = random.Random(kind)
    a, b = cells(rng, 12, 30, KINDS[kind]), cells(rng, 30, 9, KINDS[kind])
    assert len(check(spark, a, b, STRATEGIES if kind == "cancelling" else FEW)) > 50


def test_cells_that_cancel_are_not_stored(spark):
    a = [(i, k, v) for i in range(10) for k, v in enumerate([1e16, 1.0, -1e16, -1.0])]
    b = [(k, j, 1.0 if j % 2 else 0.1) for k in range(4) for j in range(10)]
    b += [(4, 3, 2.5)]
    a += [(2, 4, 1e-300)]
    want = check(spark, a, b, FEW)
    assert want == {(2, 3): 2.5e-300}


def test_nan_infinities_and_nulls(spark):
    nan, inf = float("nan"), float("inf")
    a = [(0, 0, 1.5), (0, 1, nan), (1, 0, inf), (1, 1, -inf), (2, 0, None), (2, 1, 2.0), (3, 0, 1e300), (3, 1, 1.0),
         (4, 0, None), (5, 0, -inf), (6, 1, 0.1), (6, 0, 0.1)]
    b = [(0, 0, 2.0), (1, 0, 3.0), (0, 1, 1e300), (1, 1, None), (0, 2, 0.0), (1, 2, 0.3), (0, 3, None)]
    want = check(spark, a, b, FEW)
    assert math.isnan(want[(0, 0)]) and math.isnan(want[(1, 0)]) and want[(3, 1)] == inf
    assert (4, 0) not in want and (2, 3) not in want


def test_values_that_span_all_of_double(spark):
    # Beyond 2^±1000 the products are rounded before they are summed.
    a = [(0, 0, 1e300), (0, 1, 1e-300), (0, 2, -1e300), (1, 0, 5e-324), (1, 1, 1.0)]
    b = [(0, 0, 1.0), (1, 0, 3.0), (2, 0, 1.0), (0, 1, 2.0)]
    first = None
    for s in FEW:
        got = sorted(tuple(r) for r in ch.matmul(coo_df(spark, a), coo_df(spark, b), s).collect())
        first = first or got
        assert got == first, s
    assert first == [(0, 0, 3e-300), (0, 1, 2e300), (1, 0, 3.0), (1, 1, 1e-323)]


def test_order_and_partitions_do_not_matter(spark):
    rng = random.Random(4)
    a, b = cells(rng, 4, 400, KINDS["wide"]), cells(rng, 400, 3, KINDS["wide"])
    first = None
    for seed in range(3):
        random.Random(seed).shuffle(a)
        random.Random(seed).shuffle(b)
        A, B = coo_df(spark, a).repartition(3 + seed), coo_df(spark, b).repartition(7 - seed)
        got = sorted(tuple(r) for r in ch.matmul(A, B, "coo").collect())
        first = first or got
        assert got == first


def test_limbs_round_to_nearest(spark):
    """Sums on both sides of a tie, and of all sizes and signs."""
    rng = random.Random(8)
    grid = exact.grid_of(exact.Range(60, -60, True), exact.Range(0, 0, True), 1000)
    unit = Fraction(2) ** grid.low
    values = [Fraction(2 ** 54 + 2 * k + d) for k in range(4) for d in (0, 1)] + [Fraction(2 ** 53 + 1) + unit, Fraction(2 ** 53 + 1) - unit]
    values += [Fraction(rng.randrange(-2 ** 130, 2 ** 130)) * unit for _ in range(40)] + [unit, -unit, Fraction(0)]
    rows = []
    for v in values:
        n = int(v / unit)
        limbs = []
        for t in range(grid.count - 1):
            limbs.append(n & ((1 << grid.width) - 1))
            n >>= grid.width
        rows.append((None, *limbs, n, float(v)))
    df = spark.createDataFrame(rows, "_odd double, " + ", ".join(f"s{t} long" for t in range(grid.count)) + ", want double")
    out = exact.rounded(df, grid)
    assert out.where("v <> want").count() == 0 and out.count() == len(values)


def test_ranges_and_grids(spark):
    def of(values):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        return exact.range_of(df.agg(*exact.range_columns(F.col("v"), "x")).first(), "x")
    assert of([1.0, -3.0, 0.0, None]) == exact.Range(2, 0, True)
    assert of([0.25, 100.0]) == exact.Range(7, -8, True)
    assert of([float("nan"), 2.0]).finite is False
    assert of([]) == exact.Range(0, 0, True) == of([0.0])
    assert of([0.1]).low == -56
    whole = exact.Range(20, 0, True)
    assert exact.grid_of(whole, whole, 1000).plain
    assert not exact.grid_of(whole, whole, 10 ** 6).plain
