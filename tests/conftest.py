import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import checkpoint_dir, get_session
    s = get_session("local[*]", shuffle_partitions=8, app="tessera-tests")
    checkpoint_dir(s)
    yield s
    s.stop()


def coo_df(spark, cells, vtype="double"):
    return spark.createDataFrame([(int(i), int(j), v) for i, j, v in cells], f"i long, j long, v {vtype}")


def to_dense(df, shape):
    import numpy as np
    m = np.zeros(shape)
    for r in df.collect():
        m[r.i, r.j] += r.v
    return m
