"""Rows of a product whose B is too large to be shipped whole."""

import numpy as np
import pyarrow as pa
import pytest

from conftest import coo_df
from tessera.operators import rowgroups as rg
from tessera.operators import rows as rw


def lines(df):
    return {(r.i, r.seg): list(r.row) for r in df.collect()}


def test_no_partial_product_is_shuffled(spark):
    a = coo_df(spark, [(i, k, 1.0) for i in range(20) for k in range(0, 60, 1 + i % 3)])
    b = coo_df(spark, [(k, j, 2.0) for k in range(60) for j in range(0, 100, 1 + k % 4)])
    out = rw.matmul_rows_broadcast(a, b, 100, width=40, budget=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    shipped = rw.matmul_rows_broadcast(a, b, 100, width=40)
    assert lines(out) == lines(shipped) and len(lines(out)) == 60


def test_odd_cells(spark):
    a = spark.createDataFrame([(None, 0, 3.0), (1, 0, 2.0), (1, 0, 5.0), (2, 1, None), (2, 0, None), (3, 4, 1.0), (4, None, 1.0), (5, 2, 1.0), (6, 3, 1.0),
                               (-7, 0, float("nan"))], "i long, j long, v double")
    b = spark.createDataFrame([(0, 5, 1.0), (0, 5, 2.0), (0, 69, 4.0), (1, 6, None), (2, None, 9.0), (3, 70, 9.0), (3, -1, 9.0), (None, 1, 1.0)],
                              "i long, j long, v double")
    got = lines(rw.matmul_rows_broadcast(a, b, 70, width=64, budget=1))
    assert {i for i, _ in got} == {None, 1, 2, 5, 6, -7} and len(got) == 12
    assert {k: x for k, row in got.items() for x in [{p: v for p, v in enumerate(row) if v}] if x and k[0] != -7} == {(1, 0): {5: 21.0}, (1, 1): {5: 28.0}}
    assert [p for p, v in enumerate(got[-7, 0]) if v != v] == [5]
    assert {len(row) for (_, s), row in got.items() if s == 1} == {6}


def test_a_hot_row_is_dealt_and_added_up(spark):
    a = coo_df(spark, [(0, j, 1) for j in range(5000)] + [(1 + j % 9, j, 2) for j in range(900)], "long")
    b = coo_df(spark, [(j, j % 70, 1) for j in range(5000)], "long")
    out = rw.matmul_rows_broadcast(a, b, 70, width=40, budget=1)
    assert out.schema["row"].dataType.elementType.typeName() == "long"
    assert lines(out) == lines(rw.matmul_rows_broadcast(a, b, 70, width=40))


def test_sums_beyond_a_bigint_raise(spark):
    a, b = (coo_df(spark, [(0, 0, 2 ** 40), (0, 1, 2 ** 40), (1, 0, 2 ** 40)], "long") for _ in range(2))
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW|long overflow"):
        rw.matmul_rows_broadcast(a, b, 70, budget=1).collect()


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_packets_of_any_chunk_give_the_product(chunk, monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-2, 3, (9, 12)), rng.integers(-2, 3, (12, 11))
    cells = sorted([(int(k), 0, int(j), float(b[k, j])) for k, j in zip(*np.nonzero(b))]
                   + [(int(k), 1, int(i), float(a[i, k])) for i, k in zip(*np.nonzero(a))], key=lambda c: c[:2])
    monkeypatch.setattr(rg, "CHUNK", chunk)
    monkeypatch.setattr(rg, "HELD_PRODUCTS", 5)
    monkeypatch.setattr(rg, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("At", (), {"partitionId": lambda s: 0})())}))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*cells[lo:lo + 4]), kinds)], ["k", "side", "x", "v"])
               for lo in range(0, len(cells), 4)]
    got = np.zeros((9, 11))
    packets = list(rg._packets(3, 1, 11, np.float64)(iter(batches)))
    for task in range(3):
        mine = [p for p in packets if p.column("task")[0].as_py() == task]
        for out in rg._multiplied(11, 4, np.float64)(iter(mine)):
            for i, seg, row in zip(*(out.column(c).to_pylist() for c in ("i", "seg", "row"))):
                got[i, 4 * seg:4 * seg + len(row)] += row
    np.testing.assert_array_equal(got, a @ b)


def test_packed_arrays_are_exact():
    for x, kind in (([0, 255], "u1"), ([0, 256], "u2"), ([-1, 70000], "i4"), ([2 ** 40], "i8"), ([], "i8")):
        y = rg.unpacked(rg.packed(np.array(x, np.int64)))
        assert y.tolist() == x and y.dtype.str[1:] == kind
    for x in ([0.5, 1.0], [-0.0], [float("inf")], [2.0 ** 31], [3.0, -2.0], [2.0]):
        y = rg.unpacked(rg.packed(np.array(x)))
        assert y.tolist() == x and np.signbit(y).tolist() == np.signbit(np.array(x)).tolist()
