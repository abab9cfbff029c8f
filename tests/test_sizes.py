"""Result sizes without a product, and ranges of runs."""

from pyspark.sql import functions as F

from conftest import MEDIUM, coo_df
from tessera.functions import runs as rn
from tessera.functions import sizes
from tessera.operators import multiply as mm
from tessera.sources import tables as tb


def test_bitmaps_count_the_cells_of_a_product(spark):
    a = coo_df(spark, [(0, 0, 1.0), (0, 1, 1.0), (0, 1, 2.0), (1, 1, 1.0), (2, 9, 1.0)])
    b = coo_df(spark, [(0, 0, 1.0), (0, 32768, -1.0), (0, 32769, 1.0), (1, 0, 1.0), (1, 70000, 1.0), (1, 70000, 2.0), (5, 3, 1.0)])
    out = sizes.result_nnz(a, b)
    assert out.first().nnz == 4 + 2 == mm.matmul_coo(a, b).count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_or_agg" in plan and "av" not in plan
    assert sizes.result_nnz(a.limit(0), b).first().nnz == 0


def test_sketches_come_close(spark):
    a, b = tb.supplier_part_quantity(spark, MEDIUM), tb.part_day_lines(spark, MEDIUM)
    exact = sizes.result_nnz(a, b).first().nnz
    assert abs(sizes.estimated_nnz(a, b) - exact) < 0.05 * exact
    pm = tb.part_month_cents(spark, MEDIUM)
    assert abs(sizes.estimated_nnz(a, pm) - 1200) < 0.05 * 1200


def test_a_lone_far_id_does_not_fill_a_range(spark):
    runs = spark.range(5001).select(F.when(F.col("id") == 5000, 10 ** 12).otherwise(F.col("id") * 3).alias("run_id"),
                                    (F.col("id") % 17).alias("wall_cs"), F.lit(2).cast("bigint").alias("stage_count"))
    held = []
    written = rn.materialize

    def seen(df, name):
        held.append(written(df, name))
        return held[-1]
    rn.materialize = seen
    try:
        got = {r.run_id: r.delta_wall_cs for r in rn.consecutive_delta(runs, 500).collect()}
    finally:
        rn.materialize = written
    most = held[0].groupBy("_part").count().agg(F.max("count"), F.count("*")).first()
    assert most[0] <= 1000 and most[1] >= 10
    assert got[0] is None and got[10 ** 12] == 5000 % 17 - 4999 % 17
    assert all(got[3 * k] == k % 17 - (k - 1) % 17 for k in range(1, 5000))
