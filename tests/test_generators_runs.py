"""Generators: exact nnz, distinct cells, determinism across partitionings;
run analytics edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import runs as rn
from tessera.operators import blocks as bl
from tessera.sources import generate as gen


@pytest.mark.parametrize("fn", [gen.gen_coo_exact, gen.gen_coo_affine, gen.gen_coo_batched_union])
def test_exact_nnz_distinct(spark, fn):
    df = fn(spark, 30, 17, 0.1, 5)
    assert df.count() == int(30 * 17 * 0.1)
    assert df.select("i", "j").distinct().count() == df.count()
    assert df.where((F.col("i") >= 30) | (F.col("j") >= 17)).count() == 0


def test_empty_when_nnz_rounds_to_zero(spark):
    assert gen.gen_coo_exact(spark, 3, 3, 0.01).count() == 0
    assert gen.gen_coo_affine(spark, 3, 3, 0.01).count() == 0


def test_same_seed_same_rows_any_partitioning(spark):
    a = gen.gen_coo_exact(spark, 40, 40, 0.05, 1)
    b = gen.gen_coo_exact(spark, 40, 40, 0.05, 1).repartition(7)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    c = gen.gen_coo_exact(spark, 40, 40, 0.05, 2)
    assert a.exceptAll(c).count() > 0


def test_kth_smallest_matches_sort(spark):
    df = spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("h"), F.col("id").alias("cell"))
    rows = sorted((r.h, r.cell) for r in df.collect())
    for k in (1, 17, 2500, 5000):
        assert gen.kth_smallest(df, k, [("h", 60), ("cell", 63)]) == rows[k - 1]


def test_runs_only_failed_and_zero_divisor(spark):
    runs = spark.createDataFrame(
        [(1, "coo", 1000, 0.1, 100, 3, "Failed", "{}"), (2, "auto", 1000, 0.1, 0, 3, "Success", "{}"),
         (3, "coo", 1000, 0.1, 50, 3, "Success", "{}")],
        "run_id long, algorithm string, matrix_size long, density double, wall_cs long, "
        "stage_count long, status string, props string")
    assert rn.mean_by_size(runs.where("status = 'Failed'")).count() == 0
    r = rn.mode_ratio(runs).first()
    assert r.ratio is None and r.fast_wins is False
    p = {r.algorithm: r.first_wall_cs for r in rn.pivot_size_density(runs).collect()}
    assert p == {"coo": 50, "auto": 0}


def test_gen_blocks_hash_exact_per_block(spark):
    t = gen.gen_blocks_hash(spark, 10, 10, 0.5, 4, seed=3)
    got = {(r.bi, r.bj): r.nnz for r in t.collect()}
    assert got[(0, 0)] == 8 and got[(0, 2)] == 4 and got[(2, 2)] == 2
    again = {(r.bi, r.bj): (r.idx, r.val) for r in gen.gen_blocks_hash(spark, 10, 10, 0.5, 4, seed=3).collect()}
    assert again == {(r.bi, r.bj): (r.idx, r.val) for r in t.collect()}


def test_materialize_writes_under_checkpoint_dir(spark):
    from tessera.session import checkpoint_dir
    from tessera.sources import files
    df = spark.createDataFrame([(0, 1, 2.0), (3, 4, 5.0)], "i long, j long, v double")
    a, b = files.materialize(df, "m"), files.materialize(df, "m")
    base = checkpoint_dir(spark).rstrip("/")
    pa_, pb = a.inputFiles(), b.inputFiles()
    assert pa_ and all(base.split(":", 1)[-1] in f for f in pa_ + pb)
    assert set(pa_).isdisjoint(pb)
    assert sorted(a.collect()) == sorted(df.collect())


def test_delta_over_gaps_and_ranges(spark):
    ids = [1, 3, 4, 9, 50, 51, 700, 701, 5000]
    runs = spark.createDataFrame([(i, i * i, i % 7) for i in ids], "run_id long, wall_cs long, stage_count long")
    for rows in (1, 2, 100):
        got = {r.run_id: r.delta_wall_cs for r in rn.consecutive_delta(runs, rows).collect()}
        assert got == {i: (i * i - p * p if p is not None else None) for i, p in zip(ids, [None, *ids])}


def test_pivot_takes_its_densities_from_the_runs(spark):
    cols = "run_id long, algorithm string, matrix_size long, density double, wall_cs long, status string"
    runs = spark.createDataFrame([(1, "coo", 10, 0.5, 7, "Success"), (2, "coo", 20, 0.25, 9, "Success"),
                                  (3, "coo", 10, 0.5, 8, "Success"), (4, "coo", 10, 0.75, 8, "Failed")], cols)
    got = {(r.matrix_size, r.density): r.first_wall_cs for r in rn.pivot_size_density(runs).collect()}
    assert got == {(10, 0.5): 7, (10, 0.25): 0, (20, 0.25): 9, (20, 0.5): 0}


def test_batches_are_the_callers(spark):
    df = gen.gen_coo_batched_union(spark, 100, 100, 0.5, 5, batch=50)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 100
    assert df.exceptAll(gen.gen_coo_affine(spark, 100, 100, 0.5, 5)).count() == 0


def test_gen_blocks_hash_ranks_in_place(spark):
    """No cell is shuffled, and the kept ones are those with the smallest keys of their block."""
    t = gen.gen_blocks_hash(spark, 11, 9, 0.4, 4, seed=5)
    assert "Exchange" not in t._jdf.queryExecution().executedPlan().toString()
    rows = gen.cells(spark, 11, 9).select("i", "j", "cell", gen.order_key(5, F.col("cell")).alias("h"),
                                          gen.cell_value(5, F.col("cell")).alias("v")).collect()
    want = set()
    for bi in range(3):
        for bj in range(3):
            block = sorted((r.h, r.cell, r.i, r.j, r.v) for r in rows if (r.i // 4, r.j // 4) == (bi, bj))
            want |= {x[2:] for x in block[:int(len(block) * 0.4)]}
    assert {tuple(r) for r in bl.unblockify(t, 4).collect()} == want
    full = gen.gen_blocks_hash(spark, 5, 5, 1.0, 4, seed=5)
    assert sum(r.nnz for r in full.collect()) == 25


def test_cells_are_hashed_in_ranges(spark, monkeypatch):
    """Not a row of Spark's for each cell of the grid, of which most are dropped."""
    g = [gen.gen_bernoulli(spark, 600, 1000, 0.01, 9), gen.gen_rand_range(spark, 600, 1000, 0.01, -1.0, 1.0, 9),
         gen.gen_coo_exact(spark, 600, 1000, 0.01, 9)]
    for df in g:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Range (0, 3," in plan and "md5" not in plan
    c = gen.cells(spark, 600, 1000)
    mask = F.conv(F.substring(gen._digest(9, ":m", F.col("cell")), 1, 8), 16, 10).cast("bigint") / F.lit(gen.TWO32)
    want = c.where(mask < 0.01).select("i", "j", gen.cell_value(9, F.col("cell")).alias("v"))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, g[0].collect()))
    first = c.select("i", "j", gen.cell_value(9, F.col("cell")).alias("v"), gen.order_key(9, F.col("cell")).alias("h"), "cell")
    want = first.orderBy("h", "cell").limit(6000).select("i", "j", "v")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, g[2].collect()))


def test_smallest_keys_and_ties():
    keys = np.array([5, 1, 5, 0, 5, 1, 9])
    for k in range(1, len(keys) + 2):
        assert gen._smallest(keys, k).tolist() == sorted(np.argsort(keys, kind="stable")[:k].tolist())
