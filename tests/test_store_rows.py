"""Bucketed stores with release, and the stacked row product."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM, coo_df, to_dense
from tessera.operators import multiply as mm
from tessera.operators import rows as rw
from tessera.sources import tables as tb
from tessera.sources.store import MatrixStore


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_matrices_are_not_shuffled_on_the_contraction_index(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plain = mm.matmul_coo(tb.supplier_part_quantity(spark, MEDIUM), tb.part_month_cents(spark, MEDIUM))
        assert "hashpartitioning(k" in _plan(plain)
        with MatrixStore(spark) as store:
            a = store.put(tb.supplier_part_quantity(spark, MEDIUM), "j")
            b = store.put(tb.part_month_cents(spark, MEDIUM), "i")
            c = mm.matmul_coo(a, b)
            plan = _plan(c)
            assert "hashpartitioning(k" not in plan and plan.count("Bucketed: true") == 2
            assert plan.count("Exchange") == 1          # the sums per cell
            got = c.collect()
            folders = [p.replace("file:", "") for p in store.held.values()]
            assert all(os.path.exists(f) for f in folders) and len(folders) == 2
        assert not any(os.path.exists(f) for f in folders) and not store.held
        assert sorted(map(tuple, got)) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.set(key, old)


def test_a_store_releases_after_an_error_and_views_too(spark):
    with pytest.raises(ZeroDivisionError):
        with MatrixStore(spark, buckets=4) as store:
            v = store.materialize(spark.range(5).toDF("x"))
            assert v.count() == 5 and v.dtypes == [("x", "bigint")]
            store.put(spark.range(9).withColumnRenamed("id", "j"), "j")
            folders = [p.replace("file:", "") for p in store.held.values()]
            raise ZeroDivisionError
    assert len(folders) == 2 and not any(os.path.exists(f) for f in folders)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("matrix_")]


def dense_of(df, shape, width):
    out = np.zeros(shape)
    for r in df.collect():
        assert not out[r.i, r.seg * width:r.seg * width + len(r.row)].any()
        out[r.i, r.seg * width:r.seg * width + len(r.row)] = r.row
    return out


@pytest.mark.parametrize("vtype", ["double", "long"])
@pytest.mark.parametrize("db", [0.01, 0.5])
def test_stacked_rows_match_numpy(spark, vtype, db, monkeypatch):
    rng = np.random.default_rng(6)
    make = float if vtype == "double" else int
    a, b = rng.integers(-3, 4, (40, 70)), rng.integers(-3, 4, (70, 130)) * (rng.random((70, 130)) < db)
    b[5] = 0
    cells = lambda x: [(int(i), int(j), make(x[i, j])) for i, j in zip(*np.nonzero(x))]
    A, B = coo_df(spark, cells(a), vtype), coo_df(spark, cells(b) + [(500, 3, make(1))], vtype)
    A = A.unionByName(coo_df(spark, [(77, 5, make(1)), (78, 900, make(1))], vtype))     # meet no row of B
    rows = rw.matmul_rows_broadcast(A, B, 130, width=50)
    assert rows.schema["row"].dataType.elementType.typeName() == vtype
    np.testing.assert_array_equal(dense_of(rows, (40, 130), 50), a @ b)
    assert rows.select("i").distinct().count() <= 40 and rows.groupBy("i").count().where("count <> 3").count() == 0
    # The joined path, for a B beyond the budget, has the same rows.
    joined = rw.matmul_rows_broadcast(A, B, 130, width=50, budget=1)
    np.testing.assert_array_equal(dense_of(joined, (40, 130), 50), a @ b)


def test_a_hot_row_is_dealt_to_several_tasks(spark):
    a = coo_df(spark, [(0, j, 1.0) for j in range(5000)] + [(1 + j % 9, j, 2.0) for j in range(900)])
    b = coo_df(spark, [(j, j % 70, 1.0) for j in range(5000)])
    rows = rw.matmul_rows_broadcast(a, b, 70, width=40)
    assert "FlatMapGroupsInArrow" in _plan(rows)
    want = to_dense(mm.matmul_coo(a, b), (10, 70))
    np.testing.assert_array_equal(dense_of(rows, (10, 70), 40), want)


def test_each_input_is_read_once(spark):
    import __spark_entry__ as e
    plan = _plan(e.queries()["matmul_rows_broadcast"](spark, MEDIUM))
    assert plan.count("FileScan") == 1 and "Join" not in plan
