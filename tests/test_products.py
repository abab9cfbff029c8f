"""Products against NumPy on small hand-made matrices, cross-strategy
equality and plan shapes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM, ROOT, coo_df, to_dense
from tessera.functions import coo
from tessera.operators import blocks as bl
from tessera.operators import multiply as mm
from tessera.operators import rows as rw
from tessera.plans import chooser as ch
from tessera.plans import skew
from tessera.sources import tables as tb


def rand_sparse(rng, n, m, d, signed=False):
    a = rng.integers(-5 if signed else 1, 6, size=(n, m)).astype(float)
    a[rng.random((n, m)) >= d] = 0
    return a


def cells_of(a):
    r, c = np.nonzero(a)
    return [(i, j, float(a[i, j])) for i, j in zip(r, c)]


STRATEGIES = ["coo", "coo_merge", "coo_shuffle_hash", "coo_salted", "coo_broadcast", "coo_broadcast_rows",
              "block", "block_broadcast"]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_rectangular_ragged_product_matches_numpy(spark, strategy):
    rng = np.random.default_rng(7)
    a, b = rand_sparse(rng, 10, 7, 0.4), rand_sparse(rng, 7, 9, 0.5)
    A, B = coo_df(spark, cells_of(a)), coo_df(spark, cells_of(b))
    out = ch.matmul(A, B, strategy=strategy, bs=4)
    np.testing.assert_allclose(to_dense(out, (10, 9)), a @ b)


def test_naive_and_abt_and_gram(spark):
    rng = np.random.default_rng(3)
    a, b = rand_sparse(rng, 6, 5, 0.6), rand_sparse(rng, 8, 5, 0.6)
    A, B = coo_df(spark, cells_of(a)), coo_df(spark, cells_of(b))
    np.testing.assert_allclose(to_dense(mm.matmul_naive(spark, A, coo.transpose(B)), (6, 8)), a @ b.T)
    np.testing.assert_allclose(to_dense(mm.matmul_abt(A, B), (6, 8)), a @ b.T)
    np.testing.assert_allclose(to_dense(mm.gram(A), (6, 6)), a @ a.T)


def test_non_symmetric_ab_differs_from_abt(spark):
    a = np.array([[1.0, 2.0], [0.0, 3.0]])
    b = np.array([[4.0, 0.0], [5.0, 6.0]])
    A, B = coo_df(spark, cells_of(a)), coo_df(spark, cells_of(b))
    np.testing.assert_allclose(to_dense(mm.matmul_coo(A, B), (2, 2)), a @ b)
    np.testing.assert_allclose(to_dense(mm.matmul_abt(A, B), (2, 2)), a @ b.T)


def test_cancelling_products_keep_explicit_zero_then_prune(spark):
    A = coo_df(spark, [(0, 0, 1.0), (0, 1, 1.0)])
    B = coo_df(spark, [(0, 0, 1.0), (1, 0, -1.0)])
    out = mm.matmul_coo(A, B)
    assert [tuple(r) for r in out.collect()] == [(0, 0, 0.0)]
    assert coo.prune(out).count() == 0


def test_contraction_index_on_one_side_only(spark):
    A = coo_df(spark, [(0, 5, 2.0)])
    B = coo_df(spark, [(4, 0, 3.0)])
    assert mm.matmul_coo(A, B).count() == 0


def test_empty_and_single_cell(spark):
    E = spark.createDataFrame([], "i long, j long, v double")
    one = coo_df(spark, [(0, 0, 3.0)])
    assert mm.matmul_coo(E, one).count() == 0
    assert [tuple(r) for r in mm.matmul_coo(one, one).collect()] == [(0, 0, 9.0)]
    row = coo_df(spark, [(0, k, float(k + 1)) for k in range(4)])
    col = coo.transpose(row)
    assert mm.matmul_coo(row, col).first().v == sum((k + 1) ** 2 for k in range(4))


def test_duplicates_sum_not_last_wins(spark):
    D = coo_df(spark, [(0, 0, 1.0), (0, 0, 2.0), (1, 1, 4.0)])
    c = {(r.i, r.j): r.v for r in coo.canonical(D).collect()}
    assert c == {(0, 0): 3.0, (1, 1): 4.0}
    t = bl.blockify(D, 2, 2, 2)
    assert {(r.i, r.j): r.v for r in bl.unblockify(t, 2).collect()} == c


def test_identity_and_transpose_algebra(spark):
    rng = np.random.default_rng(11)
    a, b, c = (rand_sparse(rng, 5, 5, 0.5) for _ in range(3))
    A, B, C = (coo_df(spark, cells_of(x)) for x in (a, b, c))
    I = coo_df(spark, [(k, k, 1.0) for k in range(5)])
    np.testing.assert_allclose(to_dense(mm.matmul_coo(A, I), (5, 5)), a)
    lhs = coo.transpose(mm.matmul_coo(A, B))
    rhs = mm.matmul_coo(coo.transpose(B), coo.transpose(A))
    np.testing.assert_allclose(to_dense(lhs, (5, 5)), to_dense(rhs, (5, 5)))
    dist = mm.matmul_coo(A, coo.canonical(B.unionByName(C)))
    np.testing.assert_allclose(to_dense(dist, (5, 5)), a @ (b + c))
    total = mm.sum_of_product(A, B).first().total
    assert total == pytest.approx((a @ b).sum())


def test_hot_contraction_key_is_split(spark):
    # One contraction key shared by 300 x 200 cells: 60,000 pairs.
    hot_a = [(i, 0, 1.0) for i in range(300)] + [(i, 1 + i % 7, 2.0) for i in range(50)]
    hot_b = [(0, j, 1.0) for j in range(200)] + [(1 + j % 7, j, 3.0) for j in range(40)]
    A, B = coo_df(spark, hot_a), coo_df(spark, hot_b)
    hot = skew.hot_keys(A.select("i", F.col("j").alias("k")), B.select(F.col("i").alias("k"), "j"), "k", 1000)
    rows = hot.collect()
    assert len(rows) == 1 and rows[0].k == 0 and rows[0]._s == 60
    salted = mm.matmul_coo(A, B, salt=True, target_pairs=1000)
    plain = mm.matmul_coo(A, B)
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_key_holding_a_third_of_cells_is_split_on_both_sides(spark):
    # Column 0 holds a third of all cells: 600 rows each have a cell there,
    # plus two cells per row elsewhere.  In A·Aᵀ that column is hot on both
    # sides (600 x 600 pairs).
    n = 600
    cells = [(i, 0, 1.0 + i % 3) for i in range(n)]
    cells += [(i, 1 + (i * 7 + t) % 40, float(1 + t)) for i in range(n) for t in (0, 1)]
    A = coo_df(spark, cells)
    a = np.zeros((n, 41))
    for i, j, v in cells:
        a[i, j] += v
    left = A.select("i", F.col("j").alias("k"), F.col("v").alias("av"))
    right = A.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("bv"))
    hot = skew.hot_keys(left, right, "k", 10_000).collect()
    assert [h.k for h in hot] == [0]
    h = hot[0]
    assert h._s == 36 and h._r * h._c >= h._s
    # Copies of the hot column: c*600 + r*600 on a grid, far fewer than the
    # 600 + 36*600 of splitting one side and copying the other.
    l2, r2, keys = skew.salt_join(left, right, "k", ["i"], ["j"], 10_000)
    copies = l2.where("k = 0").count() + r2.where("k = 0").count()
    assert copies == (h._r + h._c) * n < (1 + h._s) * n
    # Every pair still meets exactly once, on a join key of ~10,000 pairs.
    per_key = l2.join(r2, keys).groupBy(*keys).count().agg(F.max("count").alias("m"), F.sum("count").alias("t")).first()
    assert per_key.t == int(((a != 0).astype(int) @ (a != 0).astype(int).T).sum())
    assert per_key.m < 4 * 10_000
    expect = a @ a.T
    for out in (mm.gram(A, salt=True, target_pairs=10_000), mm.gram(A, salt=True, target_pairs=None),
                mm.matmul_abt(A, A, salt=True, target_pairs=10_000),
                mm.matmul_coo(A, coo.transpose(A), salt=True, target_pairs=10_000)):
        np.testing.assert_allclose(to_dense(out, (n, n)), expect)
    # Rectangular, hot on one side only: the grid degenerates to a split of
    # the big side and copies of the small one.
    B = coo_df(spark, [(0, j, 2.0) for j in range(5)] + [(k, k % 5, 1.0) for k in range(1, 41)])
    b = to_dense(B, (41, 5))
    hb = skew.hot_keys(left, B.select(F.col("i").alias("k"), "j"), "k", 500).collect()
    assert [(x.k, x._c) for x in hb] == [(0, 1)]
    np.testing.assert_allclose(to_dense(mm.matmul_coo(A, B, salt=True, target_pairs=500), (n, 5)), a @ b)


def test_fair_target():
    assert skew.fair_target(0, 8) == skew.MIN_TARGET_PAIRS
    assert skew.fair_target(10**12, 8) == skew.DEFAULT_TARGET_PAIRS
    assert skew.fair_target(64 * 10**6, 16) == 2 * 10**6
    # 24 equal keys: balanced on 8 slots, all hot on 4,000.
    p = 24 * 2 * 10**6
    assert 2 * 10**6 <= skew.fair_target(p, 8)
    assert 2 * 10**6 > skew.fair_target(p, 4000)


def test_block_split_grid_equals_plain(spark):
    rng = np.random.default_rng(5)
    a, b = rand_sparse(rng, 13, 6, 0.7, signed=True), rand_sparse(rng, 6, 11, 0.7, signed=True)
    A, B = coo_df(spark, cells_of(a)), coo_df(spark, cells_of(b))
    ta, tb_ = bl.blockify(A, 13, 6, 4), bl.blockify(B, 6, 11, 4)
    for split in (1, 2, 3):
        out = bl.unblockify(bl.matmul_block(ta, tb_, split=split), 4)
        np.testing.assert_allclose(to_dense(out, (13, 11)), a @ b)


def test_tile_roundtrip_ragged_and_transpose(spark):
    rng = np.random.default_rng(9)
    a = rand_sparse(rng, 10, 10, 0.5, signed=True)
    A = coo_df(spark, cells_of(a))
    t = bl.blockify(A, 10, 10, 4)
    geo = {(r.bi, r.bj): (r.nr, r.nc) for r in t.collect()}
    assert geo[(2, 2)] == (2, 2) and geo[(0, 2)] == (4, 2)
    np.testing.assert_allclose(to_dense(bl.unblockify(t, 4), (10, 10)), a)
    np.testing.assert_allclose(to_dense(bl.unblockify(bl.transpose_tiles(t), 4), (10, 10)), a.T)


def test_dense_rows_and_maps(spark):
    A = coo_df(spark, [(0, 1, 2.0), (0, 5, 3.0), (1, 0, 1.0)])
    rows = {(r.i, r.seg): list(r.row) for r in rw.dense_rows(A, 6, width=4).collect()}
    assert rows == {(0, 0): [0.0, 2.0, 0.0, 0.0], (0, 1): [0.0, 3.0], (1, 0): [1.0, 0.0, 0.0, 0.0], (1, 1): [0.0, 0.0]}
    maps = {(r.i, r.seg): dict(r.row) for r in rw.rows_as_maps(A, width=4).collect()}
    assert maps == {(0, 0): {1: 2.0}, (0, 1): {5: 3.0}, (1, 0): {0: 1.0}}


def test_rows_broadcast_matches_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = rand_sparse(rng, 5, 6, 0.5), rand_sparse(rng, 6, 3, 0.8)
    A, B = coo_df(spark, cells_of(a)), coo_df(spark, cells_of(b))
    out = {r.i: list(r.row) for r in rw.matmul_rows_broadcast(A, B, 3).collect()}
    for i, row in out.items():
        np.testing.assert_allclose(row, (a @ b)[i])


def test_gram_dense_keeps_computed_zeros(spark):
    X = coo_df(spark, [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, -1.0)])
    out = {(r.i, r.j): r.v for r in rw.gram_dense(X, 2, 2, bs=2).collect()}
    assert out == {(0, 0): 2.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 2.0}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    a = tb.supplier_part_quantity(spark, MEDIUM)
    assert "CartesianProduct" not in _plan(mm.matmul_naive(spark, a, coo.transpose(a)))
    assert "BroadcastNestedLoopJoin" not in _plan(mm.matmul_naive(spark, a, coo.transpose(a)))
    assert "SortMergeJoin" in _plan(mm.matmul_coo(a, coo.transpose(a), join="merge"))
    pm = tb.part_month_cents(spark, MEDIUM)
    assert "BroadcastHashJoin" in _plan(mm.matmul_coo(a, pm, join="broadcast"))
    # Over budget: the broadcast request falls back to a shuffle join.
    assert "BroadcastExchange" not in _plan(mm.matmul_coo(a, pm, join="broadcast", budget=1000).hint("no_op")) \
        or spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


def test_scan_pushdown(spark):
    plan = _plan(tb.supplier_part_quantity(spark, MEDIUM))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in plan


def test_chooser_rules():
    big_dense = ch.ProductStats(10**6, 10**6, (1000, 1000), (1000, 1000), 10**9, 10**6)
    assert ch.choose(big_dense, budget=1) == "block"
    wide = ch.ProductStats(10**6, 100, (10**4, 10**4), (10**4, 10**4), 5 * 10**6, 10, 100)
    assert ch.choose(wide) == "coo_broadcast_rows"
    narrow = ch.ProductStats(10**6, 100, (10**4, 10**4), (10**4, 3), 5 * 10**6, 10, 100)
    assert ch.choose(narrow, partitions=16) == "coo_broadcast"
    hot_row = ch.ProductStats(10**6, 100, (10**4, 10**4), (10**4, 10**4), 5 * 10**6, 10, 3 * 10**5)
    assert ch.choose(hot_row) == "coo_broadcast"
    skewed = ch.ProductStats(10**8, 10**8, (10**6, 10**6), (10**6, 10**6), 10**9, 10**9)
    assert ch.choose(skewed, budget=1) == "coo_salted"


def test_blockify_hot_duplicate_coordinate(spark):
    # One coordinate repeated many times plus a few others: pre-aggregated
    # per coordinate before packing; the tile holds the sums.
    cells = [(1, 2, 1.0)] * 3000 + [(0, 0, 5.0), (3, 3, 2.0)]
    D = coo_df(spark, cells)
    out = {(r.i, r.j): r.v for r in bl.unblockify(bl.blockify(D, 4, 4, 4), 4).collect()}
    assert out == {(1, 2): 3000.0, (0, 0): 5.0, (3, 3): 2.0}
    plan = _plan(bl.blockify(D, 4, 4, 4))
    assert plan.count("HashAggregate") >= 2


def test_rows_broadcast_segmented_path(spark):
    rng = np.random.default_rng(4)
    a, b = rand_sparse(rng, 5, 6, 0.6), rand_sparse(rng, 6, 5, 0.8)
    A, B = coo_df(spark, cells_of(a)), coo_df(spark, cells_of(b))
    got = np.zeros((5, 5))
    for r in rw.matmul_rows_broadcast(A, B, 5, width=2).collect():
        got[r.i, r.seg * 2: r.seg * 2 + len(r.row)] = r.row
    np.testing.assert_allclose(got, a @ b)


def test_pinned_partitions_follow_volume(spark):
    from tessera.plans import partitions as pt
    base = pt.pinned_partitions(spark)
    assert base >= 4 * spark.sparkContext.defaultParallelism
    assert pt.pinned_partitions(spark, 1000) == base
    per = pt.partition_bytes(spark)
    assert pt.pinned_partitions(spark, per * base * 10) == base * 10
    # 10 TB of coordinate rows: one partition per advisory partition size.
    assert mm.row_partitions(spark, 10**12 // pt.COO_ROW_BYTES * 10) == -(-10 * 10**12 // per)


def test_salted_plan_is_pinned_and_keyed(spark):
    uh = tb.user_hour_count(spark, MEDIUM)
    plan = _plan(mm.gram(uh, salt=True, target_pairs=2_000))
    assert "REPARTITION_BY_NUM" in plan and "_salt" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # 24 hour keys of ~20,000 pairs each do not straggle on this machine's
    # task slots: the adaptive target leaves the join unsalted.
    if spark.sparkContext.defaultParallelism <= 12:
        assert "_salt" not in _plan(mm.gram(uh, salt=True, target_pairs=None))
    # No hot key: the join is left unsalted.
    sp = tb.supplier_part_quantity(spark, MEDIUM)
    assert "_salt" not in _plan(mm.matmul_coo(sp, coo.transpose(sp), salt=True))


def test_forced_grid_split_on_user_hours_equals_plain(spark):
    # The given data with every hour key split (target far below a key's
    # ~20,000 pairs): same cells and sums as the unsplit products.
    uh = tb.user_hour_count(spark, MEDIUM)
    plain = mm.gram(uh)
    for out in (mm.gram(uh, salt=True, target_pairs=2_000),
                mm.matmul_coo(uh, coo.transpose(uh), salt=True, target_pairs=2_000)):
        assert "_salt" in _plan(out)
        assert out.exceptAll(plain).count() == 0 and plain.exceptAll(out).count() == 0


def test_self_product_shuffles_a_once(spark):
    # A·Aᵀ at a scale where nothing is broadcast: both join sides are the same
    # projection of A, so its shuffle on the contraction key is reused.
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        a = tb.supplier_part_quantity(spark, MEDIUM)
        for q in (mm.matmul_coo(a, coo.transpose(a)), mm.gram(a), mm.matmul_abt(a, a),
                  mm.matmul_naive(spark, a, coo.transpose(a))):
            r = q.agg(F.count(F.lit(1)).alias("n"))
            r.collect()
            plan = r._jdf.queryExecution().executedPlan().toString()
            # The reused exchange is the contraction-key shuffle itself, not
            # only the lineitem aggregation below it.
            assert any("ReusedExchange" in line and "l_suppkey" not in line for line in plan.splitlines())
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_row_forms_sum_repeated_coordinates(spark):
    # One coordinate repeated 3,000 times (a third of a larger input would
    # behave the same): summed per coordinate before any row is collected.
    A = coo_df(spark, [(1, 5, 1.0)] * 3000 + [(1, 0, 2.0), (0, 7, 3.0)])
    maps = {(r.i, r.seg): dict(r.row) for r in rw.rows_as_maps(A, width=4).collect()}
    assert maps == {(1, 1): {5: 3000.0}, (1, 0): {0: 2.0}, (0, 1): {7: 3.0}}
    rows = {(r.i, r.seg): list(r.row) for r in rw.dense_rows(A, 100, width=64).collect()}
    assert rows[(1, 0)][5] == 3000.0 and rows[(1, 0)][0] == 2.0 and rows[(0, 0)][7] == 3.0


def test_one_hot_key_of_a_million_pairs(spark):
    # One contraction key with 1,000 cells on each side (10^6 pairs) plus a
    # few cold keys; target 50,000 pairs per join key.
    A = coo_df(spark, [(i, 0, 1.0) for i in range(1000)] + [(i, 1 + i % 5, 2.0) for i in range(40)])
    B = coo_df(spark, [(0, j, 1.0) for j in range(1000)] + [(1 + j % 5, j, 3.0) for j in range(40)])
    left = A.select("i", F.col("j").alias("k"), F.col("v").alias("av"))
    right = B.select(F.col("i").alias("k"), "j", F.col("v").alias("bv"))
    l2, r2, keys = skew.salt_join(left, right, "k", ["i"], ["j"], 50_000)
    per_key = l2.join(r2, keys).groupBy(*keys).count()
    stats = per_key.agg(F.max("count").alias("m"), F.sum("count").alias("t"), F.count(F.lit(1)).alias("n")).first()
    # Same pairs as the plain join, spread over >= 20 keys of at most ~2x target.
    plain_pairs = left.join(right, "k").count()
    assert stats.t == plain_pairs and stats.n >= 20 and stats.m <= 2 * 50_000
    salted = mm.matmul_coo(A, B, salt=True, target_pairs=50_000)
    plain = mm.matmul_coo(A, B)
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


STRATEGIES = ["coo", "coo_merge", "coo_salted", "coo_broadcast", "coo_broadcast_rows", "coo_broadcast_left",
              "block", "block_broadcast", "auto"]


@pytest.mark.parametrize("vtype,make", [
    ("int", lambda r, k: int(r.integers(-2, 3))),
    ("bigint", lambda r, k: int(r.integers(-2, 3)) * (3 * 10 ** 8 + 1)),      # sums beyond 2**53
    ("double", lambda r, k: float(r.integers(-2, 3))),
    ("decimal(10,2)", lambda r, k: __import__("decimal").Decimal(int(r.integers(-2, 3))) / 4),
])
def test_one_result_for_every_strategy(spark, vtype, make):
    """Same cells, types and values: zeros from cancelling products are stored by none."""
    from tessera.plans import chooser as ch
    r = np.random.default_rng(5)
    a = spark.createDataFrame([(i, j, make(r, 0)) for i in range(25) for j in range(12) if r.random() < 0.5],
                              f"i int, j int, v {vtype}").cache()
    b = spark.createDataFrame([(i, j, make(r, 0)) for i in range(12) for j in range(9) if r.random() < 0.5],
                              f"i int, j int, v {vtype}").cache()
    first = None
    for s in STRATEGIES:
        got = ch.matmul(a, b, s, bs=5, tile_min_pairs=1)
        if first is None:
            first = got.cache()
            assert first.where("v = 0").count() == 0 and first.count() > 0
        assert got.dtypes == first.dtypes, s
        assert got.exceptAll(first).count() == 0 and first.exceptAll(got).count() == 0, s


def test_dense_rows_have_all_segments(spark):
    m = coo_df(spark, [(0, 0, 1.0), (0, 9, 2.0), (1, 4, 3.0)])
    got = {(r.i, r.seg): list(r.row) for r in rw.dense_rows(m, 10, width=3).collect()}
    want = {0: [1, 0, 0, 0, 0, 0, 0, 0, 0, 2], 1: [0, 0, 0, 0, 3, 0, 0, 0, 0, 0]}
    assert got == {(i, s): want[i][3 * s:3 * s + 3] for i in want for s in range(4)}


def test_registered_salted_products_are_salted(spark):
    import __spark_entry__ as e
    for name in ("matmul_coo_salted", "gram_hot_keys", "matmul_coo_hot_keys"):
        assert "_salt" in e.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().toString(), name


def test_many_even_keys_are_split_in_every_product(spark):
    """200,000 keys above the target: the table of hot keys is no literal and has no upper end."""
    n = 200_000
    a = spark.range(2 * n).select((F.col("id") % 2).alias("i"), F.expr("id div 2").alias("j"), F.lit(1).cast("bigint").alias("v"))
    b = coo.transpose(a)
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("av"))
    right = b.select("j", F.col("i").alias("k"), F.col("v").alias("bv"))
    for budget in (64 << 20, 1 << 20):       # the table is broadcast, or too large for that
        l2, r2, keys = skew.salt_join(left, right, "k", ["i"], ["j"], 3, budget=budget)
        assert keys == ["k", "_salt"] and "_salt" in _plan(l2) and "_salt" in _plan(r2)
        assert l2.join(r2, keys).count() == 4 * n
        assert l2.select("_salt").distinct().count() == 2
    assert "_salt" in _plan(mm.matmul_coo(a, b, target_pairs=3))
    assert "_salt" in _plan(mm.gram(a, target_pairs=3)) and "_salt" in _plan(mm.matmul_abt(a, a, target_pairs=3))
    assert [tuple(r) for r in mm.matmul_coo(a, b, target_pairs=3).orderBy("i", "j").collect()] == [
        (i, j, n) for i in range(2) for j in range(2)]


def test_heavy_and_other_hot_keys_meet_their_grid(spark):
    """A key with a third of the cells next to many hot keys, the table beyond its budget."""
    cells = [(i, 0, 1 + i % 3) for i in range(400)] + [(i % 9, 1 + i // 9, 2) for i in range(800)]
    a = coo_df(spark, cells, "long")
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("av"))
    right = a.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("bv"))
    l2, r2, keys = skew.salt_join(left, right, "k", ["i"], ["j"], 20, budget=0)
    plan = _plan(l2)
    assert "_hr" in plan and "SortMergeJoin" in plan
    got = l2.join(r2, keys).groupBy("i", "j").agg(F.sum(F.col("av") * F.col("bv")).alias("v"))
    plain = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("av") * F.col("bv")).alias("v"))
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
    most = l2.join(r2, keys).groupBy(*keys).count().agg(F.max("count")).first()[0]
    assert most < 400 * 400 / 50


def test_split_keys_are_counted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    a = coo_df(spark, [(i, k, 1) for i in range(20) for k in range(10)], "long")
    left = a.select("i", F.col("j").alias("k")).mapInArrow(count, "i long, k long")
    skew.salt_join(left, a.select(F.col("i").alias("j"), F.col("j").alias("k")), "k", ["i"], ["j"], 16)
    assert seen.value == 200


def test_products_split_hot_keys_by_default(spark):
    cells = [(i, 0, 1.0) for i in range(700)] + [(i, 1 + i, 2.0) for i in range(50)]
    a = coo_df(spark, cells)
    for out in (mm.matmul_coo(a, coo.transpose(a)), mm.matmul_abt(a, a), mm.gram(a), mm.partial_products(a, coo.transpose(a)),
                mm.matmul_naive(spark, a, coo.transpose(a)), mm.matmul_coo(a, coo.transpose(a), join="merge")):
        assert "_salt" in _plan(out)
    assert mm.partial_products(a, coo.transpose(a)).count() == 700 * 700 + 50


def test_two_level_tile_sum(spark):
    r = np.random.default_rng(2)
    cells = [(i, j, float(r.integers(1, 5))) for i in range(6) for j in range(6)]
    t = bl.blockify(coo_df(spark, cells), 6, 6, 4)
    many = t
    for _ in range(4):
        many = many.unionByName(many)
    got = to_dense(bl.unblockify(bl.block_sum(many, 1000), 4), (6, 6))
    assert np.array_equal(got, 16 * to_dense(coo_df(spark, cells), (6, 6)))


def test_tile_kernels_run_without_the_package_on_the_path(tmp_path):
    """Workers get the package from the session, not from their own path."""
    import subprocess
    import sys
    job = tmp_path / "job.py"
    job.write_text("import sys; sys.path.insert(0, %r)\n"
                   "from tessera.session import get_session\n"
                   "s = get_session('local[2]', 2)\n"
                   "sys.path.pop(0)\n"
                   "from tessera import catalog\n"
                   "print('ROWS', catalog.queries()['blockify_roundtrip'](s, '/root/testdata/sf0.001').count())\n" % ROOT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(job)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
