"""Threshold products against NumPy: the same cells as filtering the product,
with fewer multiplications."""

import numpy as np
import pytest
from conftest import MEDIUM, coo_df, to_dense
from pyspark.sql import functions as F

from tessera.functions import coo
from tessera.operators import multiply as mm
from tessera.operators import threshold as th
from tessera.sources import tables as tb


def random_cells(seed, n, m, density, lo=-9, hi=10):
    rng = np.random.default_rng(seed)
    keep = rng.random((n, m)) < density
    v = rng.integers(lo, hi, (n, m))
    return [(i, j, int(v[i, j])) for i, j in zip(*np.nonzero(keep))]


@pytest.mark.parametrize("eps", [0, 40, 200, 10_000])
def test_same_cells_as_filtered_product(spark, eps):
    a = coo_df(spark, random_cells(1, 40, 60, 0.3), "long")
    b = coo_df(spark, random_cells(2, 30, 60, 0.4), "long")
    want = mm.matmul_abt(a, b, eps=eps)
    got = th.matmul_abt_above(a, b, eps)
    assert sorted(got.collect()) == sorted(want.collect())
    assert sorted(th.gram_above(a, eps).collect()) == sorted(mm.matmul_abt(a, a, eps=eps).collect())


def products(left, right, found):
    x, y = th.heads(left, right)
    first = mm.partial_product_count(x.select("i", F.col("k").alias("j"), F.col("av").alias("v")),
                                     y.select(F.col("k").alias("i"), "j", F.col("bv").alias("v"))).first().pairs
    return first + th.rest_products(left, right, found).count()


def test_hot_column_of_small_values_is_not_multiplied(spark):
    """Every row has column 0 with a small value, and two rare, large ones."""
    cells = [(i, 0, 1) for i in range(300)] + [(i, 1 + i // 2, 50) for i in range(300)]
    cells += [(i, 1000 + i // 3, 40) for i in range(300)]
    a = coo_df(spark, cells, "long")
    left, right = th.sides(a, None, 100)
    found = th.candidates(left, right, 100)
    p = mm.partial_product_count(a, coo.transpose(a)).first().pairs
    assert products(left, right, found) < p / 20
    got = to_dense(th.gram_above(a, 100), (300, 300))
    d = to_dense(a, (300, 1200))
    full = d @ d.T
    assert np.array_equal(got, np.where(np.abs(full) > 100, full, 0))


def test_fewer_products_on_the_tables(spark):
    a = tb.supplier_part_quantity(spark, MEDIUM)
    norm = a.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("q")).agg(F.max("q")).first()[0]
    eps = 0.5 * float(norm)
    left, right = th.sides(a, None, eps)
    found = th.candidates(left, right, eps)
    assert products(left, right, found) < mm.partial_product_count(a, coo.transpose(a)).first().pairs


def test_odd_values(spark):
    a = coo_df(spark, [(0, 0, 3.0), (0, 1, None), (1, 0, float("nan")), (2, 0, 1e200), (2, 1, -1e200), (3, 5, 9.0)])
    want = mm.matmul_abt(a, a, eps=5.0).where("v IS NOT NULL")
    assert sorted(map(str, th.matmul_abt_above(a, a, 5.0).collect())) == sorted(map(str, want.collect()))
    assert th.gram_above(a.limit(0), 1.0).count() == 0
    with pytest.raises(ValueError):
        th.gram_above(a, -1.0)


def test_doubles_near_the_threshold_are_candidates(spark):
    """Cells just above eps pass although the tail's bound is exactly eps."""
    a = coo_df(spark, [(i, j, 0.1 * (1 + (i + j) % 3)) for i in range(20) for j in range(12)])
    d = to_dense(a, (20, 12))
    full = d @ d.T
    for eps in (0.3, 0.55, 0.7):
        got = to_dense(th.matmul_abt_above(a, a, eps), (20, 20))
        sure = np.abs(np.abs(full) - eps) > 1e-9
        assert np.allclose(got[sure], np.where(np.abs(full) > eps, full, 0)[sure])


@pytest.mark.parametrize("upper", [False, True])
def test_sums_are_made_in_the_task_of_their_row(spark, monkeypatch, upper):
    """No partial sum is shuffled, lists are cut and busy rows are dealt to several tasks."""
    monkeypatch.setattr(th, "LIST", 3)
    monkeypatch.setattr(th, "PAIRS", 50)
    cells = random_cells(5, 12, 40, 0.3) + [(12, j, 2) for j in range(40)]
    a = coo_df(spark, cells, "long")
    x = a.select("i", F.col("j").alias("k"), F.col("v").alias("av"))
    y = a.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("bv"))
    got = th._sums(x, y, upper)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(i" in plan and "hashpartitioning(i#" not in plan.split("Generate posexplode")[0]
    want = mm.matmul_abt(a, a).where("i <= j" if upper else "true")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 13


def test_lists_hold_values_exactly(spark):
    def kinds(cells, vtype="double"):
        return th._narrow(coo_df(spark, cells, vtype).select("j", F.col("v").alias("bv")))
    assert kinds([(0, 5, 3.0), (0, 7, -32767.0)]) == ("int", "smallint")
    assert kinds([(0, 5, 40000), (0, 1 << 31, 2)], "long") == ("bigint", "int")
    assert kinds([(0, 5, 0.5), (0, 6, 1.0)]) == ("int", "double")
    assert kinds([(0, 5, float("nan")), (0, 6, 1.0)])[1] == "double"
    assert kinds([(0, 5, float("inf"))])[1] == "double"
    assert kinds([(0, 5, 1 << 40)], "long")[1] == "bigint"
