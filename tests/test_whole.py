"""Sums of whole numbers that no bigint holds."""

import pytest
from pyspark.sql import functions as F

from conftest import coo_df
from tessera.functions import whole
from tessera.operators import multiply as mm

BIG = 3_000_000_000


def _sums(cells, other=None):
    out = {}
    for i, k, x in cells:
        for j, m, y in other or cells:
            if k == m and x is not None and y is not None:
                out[i, j] = out.get((i, j), 0) + x * y
    return out


@pytest.mark.parametrize("salt", [True, False])
def test_sums_beyond_a_bigint_are_whole(spark, salt):
    cells = [(0, 0, BIG), (0, 1, -BIG), (0, 2, 7), (1, 0, BIG), (1, 1, BIG), (1, 2, None), (2, 2, 1), (0, 3, BIG), (1, 3, 2 ** 63 - 1)]
    a = coo_df(spark, cells, "long")
    for out in (mm.gram(a, salt=salt), mm.matmul_abt(a, a, salt=salt), mm.gram(a, salt=salt, join="merge")):
        assert out.schema["v"].dataType.simpleString() == "decimal(38,0)"
        got = {(r.i, r.j): r.v for r in out.collect() if r.v is not None}
        assert {k: int(v) for k, v in got.items()} == _sums(cells)
    kept = mm.gram(a, eps=BIG ** 2).collect()
    assert {(r.i, r.j): int(r.v) for r in kept} == {k: v for k, v in _sums(cells).items() if abs(v) > BIG ** 2}


def test_sums_that_fit_stay_bigint(spark):
    # Two different sides whose bound passes a bigint though no sum does.
    a = [(0, 0, BIG), (0, 1, 5)]
    b = [(3, 0, 2), (3, 1, 2 * BIG), (4, 9, 2 * BIG)]
    left, right = coo_df(spark, a, "long"), coo_df(spark, b, "long")
    out = mm.matmul_abt(left, right)
    assert whole.may_overflow(left.withColumnsRenamed({"j": "k", "v": "av"}),
                              right.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("bv")))
    assert out.schema["v"].dataType.simpleString() == "bigint"
    assert {(r.i, r.j): r.v for r in out.collect()} == _sums(a, b)
    # Many values, none of whose rows is long: told apart by the second bound.
    diagonal = coo_df(spark, [(k, k, 1_500_000_000) for k in range(10)], "long")
    g = mm.gram(diagonal)
    assert g.schema["v"].dataType.simpleString() == "bigint" and g.count() == 10
    assert "wide-sums" not in g._jdf.queryExecution().toString()


def test_repeated_cells_count_towards_the_bound(spark):
    cells = [(0, 0, 1_500_000_000)] * 3
    assert [int(r.v) for r in mm.gram(coo_df(spark, cells, "long")).collect()] == [_sums(cells)[0, 0]]
    assert mm.gram(coo_df(spark, [(0, 0, None)], "long")).collect()[0].v is None
    assert mm.gram(coo_df(spark, [], "long")).count() == 0
