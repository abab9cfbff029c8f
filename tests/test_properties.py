"""Property checks on random small matrices (hypothesis): every product
strategy equals NumPy, including signed values that cancel, ragged tiles
and hot keys split over a grid."""

import numpy as np
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st

from conftest import coo_df, to_dense
from tessera.functions import coo
from tessera.operators import multiply as mm
from tessera.plans import chooser as ch


@st.composite
def product_inputs(draw):
    n, k, m = (draw(st.integers(1, 7)) for _ in range(3))
    cell = st.integers(-3, 3)
    a = np.array(draw(st.lists(cell, min_size=n * k, max_size=n * k)), dtype=float).reshape(n, k)
    b = np.array(draw(st.lists(cell, min_size=k * m, max_size=k * m)), dtype=float).reshape(k, m)
    return a, b


def cells(x):
    r, c = np.nonzero(x)
    return [(i, j, float(x[i, j])) for i, j in zip(r, c)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(product_inputs())
@example((np.zeros((2, 3)), np.ones((3, 4))))                       # A has no stored cell
@example((np.array([[2.0]]), np.array([[-3.0]])))                    # 1 x 1
@example((np.array([[1.0, 1.0]]), np.array([[1.0], [-1.0]])))        # products cancel to 0
def test_every_strategy_equals_numpy(spark, ab):
    a, b = ab
    A, B = coo_df(spark, cells(a)), coo_df(spark, cells(b))
    expect = a @ b
    outs = [ch.matmul(A, B, strategy=s, bs=3) for s in ("coo", "coo_broadcast_rows", "block")]
    outs.append(mm.matmul_coo(A, B, salt=True, target_pairs=2))
    outs.append(mm.matmul_naive(spark, A, B))
    for out in outs:
        np.testing.assert_allclose(to_dense(out, expect.shape), expect)
    # Gram and A·Bᵀ against the same reference.
    g = a @ a.T
    np.testing.assert_allclose(to_dense(mm.gram(A, salt=True, target_pairs=2), g.shape), g)
    np.testing.assert_allclose(to_dense(mm.matmul_abt(A, A), g.shape), g)
    # (AB)ᵀ = BᵀAᵀ
    np.testing.assert_allclose(to_dense(mm.matmul_coo(coo.transpose(B), coo.transpose(A)), expect.T.shape),
                               expect.T)
