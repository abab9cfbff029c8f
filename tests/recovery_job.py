"""Run by tests/test_recovery.py in its own process (``local[4,2]``: a task
may fail once and is retried).  A pass-through Arrow stage raises on the
first attempt of some tasks in front of the tile product and the salted
join; the retried tasks must recompute exactly the same rows."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.functions import coo  # noqa: E402
from tessera.operators import blocks as bl  # noqa: E402
from tessera.operators import multiply as mm  # noqa: E402
from tessera.session import get_session  # noqa: E402
from tessera.sources import tables as tb  # noqa: E402


def flaky(batches):
    ctx = TaskContext.get()
    if ctx.attemptNumber() == 0 and ctx.partitionId() % 2 == 0:
        raise RuntimeError("injected task loss")
    yield from batches


def products(spark, d, inject):
    a = tb.supplier_part_quantity(spark, d).repartition(4)
    if inject:
        a = a.mapInArrow(flaky, a.schema)
    n, m = tb.dimension_count(spark, d, "supplier"), tb.dimension_count(spark, d, "part")
    t = bl.blockify(a, n, m, 256, canonical=True)
    tiles = bl.unblockify(bl.matmul_block(t, bl.transpose_tiles(t), split=2), 256)
    salted = mm.matmul_coo(a, coo.transpose(a), salt=True, target_pairs=2_000)
    return [sorted(df.select("i", "j", F.col("v").cast("double")).collect()) for df in (tiles, salted)]


if __name__ == "__main__":
    spark = get_session("local[4,2]", shuffle_partitions=8, app="tessera-recovery")
    d = sys.argv[1]
    clean = products(spark, d, False)
    retried = products(spark, d, True)
    assert clean == retried, "retried tasks produced different rows"
    assert clean[0] == clean[1], "tile and salted products differ"
    print("RECOVERY-OK", len(clean[0]))
