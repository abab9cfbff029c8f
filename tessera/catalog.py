"""Registered queries: each is a Spark job over the provided tables plus the
equivalent SQL (DuckDB dialect) used as the correctness oracle.

Matrix views (see ``tessera.sources.tables``):
  sp  supplier x part, sum of quantity          uh  user x hour, event count
  sc  supplier x part, line count               eq  vec x component, floor(e*1000)
  pm  part x ship month, revenue cents          runs  run-metrics stand-in over events
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import coo
from tessera.functions import runs as rn
from tessera.functions import sizes
from tessera.session import apply_library_conf, shared_dir
from tessera.sources import files as fl
from tessera.sources import draws as dr
from tessera.sources import generate as gen
from tessera.operators import blocks as bl
from tessera.operators import multiply as mm
from tessera.operators import rows as rw
from tessera.operators import threshold as th
from tessera.plans import chooser as ch
from tessera.plans.partitions import pinned_partitions
from tessera.sources import tables as tb
from tessera.sources.store import MatrixStore

Query = Callable[[SparkSession, str], DataFrame]

# --------------------------------------------------------------------------
# Oracle views (DuckDB SQL), mirroring tessera.sources.tables.
SQL_VIEWS = {
    "sp": "SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2",
    "sc": "SELECT l_suppkey AS i, l_partkey AS j, count(*) AS v FROM lineitem GROUP BY 1, 2",
    "pm": ("SELECT l_partkey AS i, CAST(month(l_shipdate) AS BIGINT) AS j, "
           "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v "
           "FROM lineitem GROUP BY 1, 2"),
    "uh": "SELECT user_id AS i, CAST(hour(ts) AS BIGINT) AS j, count(*) AS v FROM events GROUP BY 1, 2",
    "pd": ("SELECT l_partkey AS i, CAST(dayofyear(l_shipdate) AS BIGINT) AS j, count(*) AS v FROM lineitem GROUP BY 1, 2"),
    "hd": "SELECT CAST(hour(ts) AS BIGINT) AS i, CAST(day(ts) AS BIGINT) AS j, count(*) AS v FROM events GROUP BY 1, 2",
    # Whole numbers times powers of two, as 128-bit integers: 2^10 of them are one.
    "ca": ("SELECT l_suppkey AS i, l_partkey AS j, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * "
           "CAST(round(l_extendedprice * 100) AS BIGINT)) AS HUGEINT) * (CAST(1 AS BIGINT) << CAST(12 * (l_partkey % 3) AS INTEGER)) AS v "
           "FROM lineitem WHERE l_partkey % 11 <> 0 GROUP BY 1, 2"),
    "cb": ("SELECT l_partkey AS i, CAST(month(l_shipdate) AS BIGINT) AS j, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * "
           "CAST(round(l_extendedprice * 100) AS BIGINT)) AS HUGEINT) * (CAST(1 AS BIGINT) << CAST(10 * (1 - l_partkey % 2) AS INTEGER)) AS v "
           "FROM lineitem GROUP BY 1, 2"),
    "eq": ("SELECT vec_id AS i, CAST(p AS BIGINT) AS j, CAST(floor(CAST(e AS DOUBLE) * 1000) AS BIGINT) AS v "
           "FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p "
           "FROM embeddings)"),
}


def with_views(body: str, *names: str) -> str:
    ctes = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    return f"WITH {ctes} {body}"


# --------------------------------------------------------------------------
# Spark side helpers
def sp(spark, d): return tb.supplier_part_quantity(spark, d)


def written(df: DataFrame, name: str) -> DataFrame:
    """Views feeding statistics jobs or broadcast probes are written once to
    the shared checkpoint folder (see files.materialize)."""
    return fl.materialize(df, name)
def sc(spark, d): return tb.supplier_part_lines(spark, d)
def pm(spark, d): return tb.part_month_cents(spark, d)
def uh(spark, d): return tb.user_hour_count(spark, d)
def hd(spark, d): return tb.hour_day_count(spark, d)
def eq(spark, d): return tb.quantised_embeddings(spark, d)


REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Sessions handed in by a cluster or driver may lack the settings
            # the operators rely on (byte-bounded Arrow batches, AQE skew join).
            apply_library_conf(spark)
            return fn(spark, sf_dir)
        run.__name__ = run.__qualname__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, sql)
        return fn
    return deco


# ---- products -------------------------------------------------------------
# Products contract over the long side, so their results stay small next to
# their inputs: SP·PM is supplier x month, the Gram matrices month x month,
# hour x hour and component x component.
SP_PM = with_views(
    "SELECT a.i AS i, b.j AS j, sum(a.v * b.v) AS v FROM sp a JOIN pm b ON a.j = b.i GROUP BY 1, 2", "sp", "pm")


def _self_sql(view: str) -> str:
    return with_views(f"SELECT x.j AS i, y.j AS j, CAST(sum(x.v * y.v) AS BIGINT) AS v FROM {view} x "
                      f"JOIN {view} y ON x.i = y.i GROUP BY 1, 2", view)


@register("matmul_coo", SP_PM)
def q_matmul_coo(spark, d):
    return mm.matmul_coo(written(sp(spark, d), "sp"), written(pm(spark, d), "pm"))


@register("matmul_coo_bucketed", SP_PM)
def q_matmul_coo_bucketed(spark, d):
    """Both sides written in buckets of the contraction index, which the join then needs no shuffle for."""
    store = MatrixStore(spark)
    return mm.matmul_coo(store.put(sp(spark, d), "j", "sp"), store.put(pm(spark, d), "i", "pm"), join="merge")


@register("stored_product_total", with_views(
    "SELECT count(*) AS nnz, CAST(sum(v) AS DOUBLE) AS total FROM (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM sp a "
    "JOIN pm b ON a.j = b.i GROUP BY 1, 2)", "sp", "pm"))
def q_stored_product_total(spark, d):
    """Inputs materialised, multiplied, reduced to one row, and released."""
    with MatrixStore(spark) as store:
        c = mm.matmul_coo(store.put(sp(spark, d), "j", "sp"), store.put(pm(spark, d), "i", "pm"))
        row = c.agg(F.count(F.lit(1)).alias("nnz"), F.sum("v").cast("double").alias("total")).first()
    return spark.createDataFrame([tuple(row)], "nnz long, total double")


@register("matmul_rect", with_views(
    "SELECT a.j AS i, b.j AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM pm a JOIN pd b ON a.i = b.i GROUP BY 1, 2", "pm", "pd"))
def q_matmul_rect(spark, d):
    """Months x parts times parts x days of the year: 12 x 366."""
    return mm.matmul_coo(coo.transpose(written(pm(spark, d), "pm")), written(tb.part_day_lines(spark, d), "pd"))


@register("matmul_coo_merge", SP_PM)
def q_matmul_coo_merge(spark, d):
    return mm.matmul_coo(written(sp(spark, d), "sp"), written(pm(spark, d), "pm"), join="merge")


@register("matmul_coo_salted", SP_PM)
def q_matmul_coo_salted(spark, d):
    """A low target of pairs a slice, so that keys are split on small tables too."""
    return mm.matmul_coo(written(sp(spark, d), "sp"), written(pm(spark, d), "pm"), salt=True, target_pairs=16)


@register("matmul_naive", SP_PM)
def q_matmul_naive(spark, d):
    return mm.matmul_naive(spark, written(sp(spark, d), "sp"), written(pm(spark, d), "pm"))


@register("matmul_abt", _self_sql("pm"))
def q_matmul_abt(spark, d):
    t = coo.transpose(written(pm(spark, d), "pm"))
    return mm.matmul_abt(t, t)


@register("matmul_gram", _self_sql("pm"))
def q_matmul_gram(spark, d):
    return mm.gram(coo.transpose(written(pm(spark, d), "pm")))


@register("matmul_coo_broadcast", SP_PM)
def q_matmul_coo_broadcast(spark, d):
    return mm.matmul_coo(sp(spark, d), written(pm(spark, d), "pm"), join="broadcast")


@register("matmul_coo_broadcast_rows", SP_PM)
def q_matmul_coo_broadcast_rows(spark, d):
    return mm.matmul_coo(written(sp(spark, d), "sp"), written(pm(spark, d), "pm"), join="broadcast_rows")


@register("partial_products", with_views(
    "SELECT a.i AS i, a.j AS k, b.j AS j, a.v * b.v AS v FROM sp a JOIN pm b ON a.j = b.i", "sp", "pm"))
def q_partial_products(spark, d):
    return mm.partial_products(written(sp(spark, d), "sp"), written(pm(spark, d), "pm"))


@register("partial_product_count", with_views(
    "SELECT CAST(coalesce(sum(ca * cb), 0) AS BIGINT) AS pairs, CAST(coalesce(max(ca * cb), 0) AS BIGINT) AS max_key_pairs "
    "FROM (SELECT j AS k, count(*) AS ca FROM sp GROUP BY 1) x JOIN (SELECT i AS k, count(*) AS cb FROM pm GROUP BY 1) y USING (k)",
    "sp", "pm"))
def q_partial_product_count(spark, d):
    return mm.partial_product_count(sp(spark, d), pm(spark, d))


@register("matmul_sum_rewrite", with_views(
    "SELECT sum(ca * rb) AS total FROM (SELECT j AS k, sum(v) AS ca FROM sp GROUP BY 1) x "
    "JOIN (SELECT i AS k, CAST(sum(v) AS BIGINT) AS rb FROM pm GROUP BY 1) y USING (k)", "sp", "pm"))
def q_matmul_sum_rewrite(spark, d):
    return mm.sum_of_product(sp(spark, d), pm(spark, d))


@register("result_nnz", with_views(
    "SELECT count(*) AS nnz FROM (SELECT a.i, b.j FROM sp a JOIN pm b ON a.j = b.i GROUP BY 1, 2)", "sp", "pm"))
def q_result_nnz(spark, d):
    return coo.nnz(mm.matmul_coo(written(sp(spark, d), "sp"), written(pm(spark, d), "pm")))


@register("result_nnz_bitmap", with_views(
    "SELECT count(*) AS nnz FROM (SELECT a.i, b.j FROM sp a JOIN pd b ON a.j = b.i GROUP BY 1, 2)", "sp", "pd"))
def q_result_nnz_bitmap(spark, d):
    """The cells of suppliers x days of the year, counted by unions of bitmaps."""
    return sizes.result_nnz(sp(spark, d), tb.part_day_lines(spark, d))


# ---- single-matrix operators ---------------------------------------------
@register("transpose", with_views("SELECT j AS i, i AS j, v FROM sp", "sp"))
def q_transpose(spark, d):
    return coo.transpose(sp(spark, d))


@register("matrix_sum", with_views("SELECT sum(v) AS total FROM sp", "sp"))
def q_matrix_sum(spark, d):
    return coo.matrix_sum(sp(spark, d))


@register("coo_canonical", "SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2")
def q_coo_canonical(spark, d):
    return coo.canonical(tb.lineitem_cells(spark, d))


@register("matrix_density", with_views(
    "SELECT nrows, ncols, nnz, d AS density, CAST(floor(nrows * ncols * CAST(0.1 AS DOUBLE)) AS BIGINT) AS requested_nnz FROM ("
    "SELECT coalesce(max(i), -1) + 1 AS nrows, coalesce(max(j), -1) + 1 AS ncols, count(*) AS nnz, "
    "CAST(count(*) AS DOUBLE) / CAST((coalesce(max(i), -1) + 1) * (coalesce(max(j), -1) + 1) AS DOUBLE) AS d FROM sp)",
    "sp"))
def q_matrix_density(spark, d):
    return coo.density(sp(spark, d), requested=0.1)


@register("matrix_size_mb", with_views(
    "SELECT nnz, nnz * 8 / 1048576.0 AS size_mb, nnz * 8 / 1048576.0 > 100 AS naive_warn, "
    "nnz * 8 / 1048576.0 > 500 AS broadcast_warn FROM (SELECT count(*) AS nnz FROM sp)", "sp"))
def q_matrix_size_mb(spark, d):
    return coo.size_mb(sp(spark, d))


@register("prune_small", _self_sql("eq") + " HAVING abs(sum(x.v * y.v)) > 1e-10")
def q_prune_small(spark, d):
    t = coo.transpose(written(eq(spark, d), "eq"))
    return mm.matmul_abt(t, t, eps=1e-10, join="merge")


# Suppliers whose products overlap more than by chance; by far most pairs fall below.
ABOVE = 120_000
ABOVE_LINES = 4_500


@register("gram_above", with_views(
    "SELECT x.i AS i, y.i AS j, sum(x.v * y.v) AS v FROM sp x JOIN sp y ON x.j = y.j GROUP BY 1, 2 "
    f"HAVING abs(sum(x.v * y.v)) > {ABOVE}", "sp"))
def q_gram_above(spark, d):
    return th.gram_above(written(sp(spark, d), "sp"), ABOVE)


@register("matmul_abt_above", with_views(
    "SELECT x.i AS i, y.i AS j, sum(x.v * y.v) AS v FROM sp x JOIN sc y ON x.j = y.j GROUP BY 1, 2 "
    f"HAVING abs(sum(x.v * y.v)) > {ABOVE_LINES}", "sp", "sc"))
def q_matmul_abt_above(spark, d):
    return th.matmul_abt_above(written(sp(spark, d), "sp"), written(sc(spark, d), "sc"), ABOVE_LINES)


@register("mask_zero", with_views("SELECT i, j, v FROM sp WHERE v > 50", "sp"))
def q_mask_zero(spark, d):
    return coo.mask_zero(sp(spark, d), F.col("v") > 50)


@register("linear_index", with_views(
    "SELECT i * n + j AS cell, (i * n + j) // n AS i, (i * n + j) % n AS j, v "
    "FROM sp, (SELECT max(p_partkey) + 1 AS n FROM part)", "sp"))
def q_linear_index(spark, d):
    return coo.linear_index(sp(spark, d), tb.dimension_count(spark, d, "part"))


@register("ewise_mul", with_views(
    "SELECT a.i AS i, a.j AS j, a.v * b.v AS v FROM sp a JOIN sc b ON a.i = b.i AND a.j = b.j", "sp", "sc"))
def q_ewise_mul(spark, d):
    return coo.ewise_mul(sp(spark, d), sc(spark, d))


@register("ewise_abs_sum", with_views(
    "SELECT sum(abs(a.v * b.v)) AS total FROM sp a JOIN sc b ON a.i = b.i AND a.j = b.j", "sp", "sc"))
def q_ewise_abs_sum(spark, d):
    return coo.ewise_abs_sum(sp(spark, d), sc(spark, d))


@register("sparse_dot", with_views(
    "SELECT a.i AS i, sum(a.v * b.v) AS dot, count(*) AS shared FROM sp a JOIN sc b "
    "ON a.i = b.i AND a.j = b.j GROUP BY 1", "sp", "sc"))
def q_sparse_dot(spark, d):
    return coo.row_dot(sp(spark, d), sc(spark, d))


@register("gram_coo_dense", _self_sql("eq"))
def q_gram_coo_dense(spark, d):
    """Pinned to a merge join: an exploded vector is larger than Catalyst's estimate from its file."""
    return mm.gram(coo.transpose(written(eq(spark, d), "eq")), join="merge")


@register("gram_hot_keys", _self_sql("eq"))
def q_gram_hot_keys(spark, d):
    """Every vector is a contraction key with 64 x 64 pairs; a target below
    that splits each over a grid on both sides."""
    return mm.gram(written(coo.transpose(eq(spark, d)), "eq"), salt=True, target_pairs=1000)


@register("matmul_coo_hot_keys", with_views(
    "SELECT a.i AS i, b.j AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM uh a JOIN hd b ON a.j = b.i GROUP BY 1, 2", "uh", "hd"))
def q_matmul_coo_hot_keys(spark, d):
    """Users x hours times hours x days: only 24 contraction keys, so each is
    hot as the data grows, and each is split over a grid."""
    return mm.matmul_coo(written(uh(spark, d), "uh"), written(hd(spark, d), "hd"), salt=True, target_pairs=1000)


# ---- tiles -----------------------------------------------------------------
TILE_BS = 256          # ragged at every scale: 2000 = 7*256 + 208
PRODUCT_BS = 32        # several ragged blocks of suppliers even on the smallest tables
RESULT_BS = 32


def _shape_sp(spark, d):
    return tb.dimension_count(spark, d, "supplier"), tb.dimension_count(spark, d, "part")


def _tiled(spark, a, b, m, k, n, bs, broadcast=False):
    """A·B on tiles, split and partitioned by the shape and the cell counts."""
    bounds = {"a_bytes_bound": bl.tile_bytes_bound(a.count(), m, k, bs),
              "b_bytes_bound": bl.tile_bytes_bound(b.count(), k, n, bs)}
    grid, slots = (bl.nblocks(m, bs), bl.nblocks(k, bs), bl.nblocks(n, bs)), spark.sparkContext.defaultParallelism
    target = bl.shape_target(bs)
    split = bl.shape_split(*grid, target_pairs=target, min_keys=slots)
    bounds["depth"] = bl.shape_depth(*grid, split, target_pairs=target, min_keys=slots)
    rows = bl.grid_rows(pinned_partitions(spark, bounds["a_bytes_bound"] + bounds["b_bytes_bound"]), grid[0],
                        bounds["b_bytes_bound"], 8 * m * n)
    # No copies of A for groups of columns, or of B for groups of rows, that are not there.
    split = min(max(split, rows), grid[0]), min(split, grid[2])
    return bl.matmul_block(bl.blockify(a, m, k, bs, canonical=True), bl.blockify(b, k, n, bs, canonical=True),
                           broadcast=broadcast, split=split, nbk=bl.nblocks(k, bs), **bounds)


@register("matmul_block", SP_PM)
def q_matmul_block(spark, d):
    n, m = _shape_sp(spark, d)
    return bl.unblockify(_tiled(spark, written(sp(spark, d), "sp"), written(pm(spark, d), "pm"), n, m, 13, PRODUCT_BS), PRODUCT_BS)


@register("matmul_block_broadcast", SP_PM)
def q_matmul_block_broadcast(spark, d):
    n, m = _shape_sp(spark, d)
    return bl.unblockify(_tiled(spark, written(sp(spark, d), "sp"), written(pm(spark, d), "pm"), n, m, 13, PRODUCT_BS,
                                broadcast=True), PRODUCT_BS)


@register("matmul_auto", SP_PM + " HAVING sum(a.v * b.v) <> 0")
def q_matmul_auto(spark, d):
    return ch.matmul(written(sp(spark, d), "sp"), written(pm(spark, d), "pm"), strategy="auto", canonical=True)


@register("matmul_auto_cancelling", with_views(
    "SELECT a.i AS i, b.j AS j, CAST(sum(a.v * b.v) AS DOUBLE) / 1024 AS v FROM ca a JOIN cb b ON a.j = b.i "
    "GROUP BY 1, 2 HAVING sum(a.v * b.v) <> 0", "ca", "cb"))
def q_matmul_auto_cancelling(spark, d):
    """Signed doubles of very different sizes, some without a value: sums that
    need more than 53 bits and partly cancel."""
    return ch.matmul(written(tb.signed_supplier_part(spark, d), "ca"), written(tb.signed_part_month(spark, d), "cb"),
                     strategy="auto", canonical=True)


@register("matmul_auto_dense", _self_sql("eq") + " HAVING sum(x.v * y.v) <> 0")
def q_matmul_auto_dense(spark, d):
    """Dense and signed: the chooser takes tiles, from fewer pairs on than by default."""
    a = written(eq(spark, d), "eq")
    return ch.matmul(coo.transpose(a), a, strategy="auto", canonical=True, tile_min_pairs=1_000_000)


@register("gram_dense", _self_sql("eq"))
def q_gram_dense(spark, d):
    n = tb.dimension_count(spark, d, "embeddings")
    return rw.gram_dense(coo.transpose(eq(spark, d)), 64, n, bs=TILE_BS, canonical=True)


@register("blockify_roundtrip", with_views("SELECT i, j, v FROM sp", "sp"))
def q_blockify_roundtrip(spark, d):
    n, m = _shape_sp(spark, d)
    return bl.unblockify(bl.blockify(sp(spark, d), n, m, TILE_BS, canonical=True), TILE_BS)


@register("block_sum", with_views(
    "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM sp UNION ALL SELECT i, j, CAST(v AS DOUBLE) FROM sc) "
    "GROUP BY 1, 2", "sp", "sc"))
def q_block_sum(spark, d):
    n, m = _shape_sp(spark, d)
    tiles = bl.blockify(sp(spark, d), n, m, TILE_BS, canonical=True).unionByName(bl.blockify(sc(spark, d), n, m, TILE_BS, canonical=True))
    return bl.unblockify(bl.block_sum(tiles), TILE_BS)


@register("result_blocks", with_views(
    f"SELECT count(*) AS blocks FROM (SELECT DISTINCT a.i // {RESULT_BS}, b.j // {RESULT_BS} "
    "FROM sp a JOIN pm b ON a.j = b.i)", "sp", "pm"))
def q_result_blocks(spark, d):
    """Only the blocks' numbers meet; no product is computed to count them."""
    a = sp(spark, d).select(F.expr(f"i div {RESULT_BS}").alias("bi"), F.col("j").alias("k")).distinct()
    b = pm(spark, d).select(F.col("i").alias("k"), F.expr(f"j div {RESULT_BS}").alias("bj")).distinct()
    return a.join(b, "k").select("bi", "bj").distinct().agg(F.count(F.lit(1)).alias("blocks"))


@register("block_grid",
          f"SELECT bi, bj, CAST(least({TILE_BS}, n - bi * {TILE_BS}) AS INTEGER) AS nr, "
          f"CAST(least({TILE_BS}, m - bj * {TILE_BS}) AS INTEGER) AS nc "
          f"FROM (SELECT DISTINCT s_suppkey // {TILE_BS} AS bi FROM supplier), "
          f"(SELECT DISTINCT p_partkey // {TILE_BS} AS bj FROM part), "
          "(SELECT max(s_suppkey) + 1 AS n FROM supplier), (SELECT max(p_partkey) + 1 AS m FROM part)")
def q_block_grid(spark, d):
    n, m = _shape_sp(spark, d)
    return bl.block_grid(spark, n, m, TILE_BS)


@register("block_geometry", with_views(
    f"SELECT g.bi AS bi, g.bj AS bj, g.nr AS nr, g.nc AS nc, coalesce(c.cells, 0) AS cells, "
    "coalesce(c.cells, 0) / CAST(g.nr * g.nc AS DOUBLE) AS fill FROM ("
    f"SELECT bi, bj, CAST(least({TILE_BS}, n - bi * {TILE_BS}) AS INTEGER) AS nr, "
    f"CAST(least({TILE_BS}, m - bj * {TILE_BS}) AS INTEGER) AS nc "
    f"FROM (SELECT DISTINCT s_suppkey // {TILE_BS} AS bi FROM supplier), "
    f"(SELECT DISTINCT p_partkey // {TILE_BS} AS bj FROM part), "
    "(SELECT max(s_suppkey) + 1 AS n FROM supplier), (SELECT max(p_partkey) + 1 AS m FROM part)) g "
    f"LEFT JOIN (SELECT i // {TILE_BS} AS bi, j // {TILE_BS} AS bj, count(*) AS cells FROM sp GROUP BY 1, 2) c "
    "ON g.bi = c.bi AND g.bj = c.bj", "sp"))
def q_block_geometry(spark, d):
    n, m = _shape_sp(spark, d)
    return bl.geometry_with_counts(spark, sp(spark, d), n, m, TILE_BS)


# ---- rows --------------------------------------------------------------------
def _dense_rows_sql(view: str, ncols: str, width: int = rw.DEFAULT_WIDTH, total: str = "BIGINT") -> str:
    return (f"SELECT r.i AS i, c.j // {width} AS seg, CAST(count(*) AS INTEGER) AS width, "
            "string_agg(CAST(coalesce(x.v, 0) AS VARCHAR), ',' ORDER BY c.j) AS row_text, "
            f"CAST(sum(coalesce(x.v, 0)) AS {total}) AS total "
            f"FROM (SELECT DISTINCT i FROM {view}) r CROSS JOIN (SELECT unnest(range({ncols})) AS j) c "
            f"LEFT JOIN {view} x ON x.i = r.i AND x.j = c.j GROUP BY 1, 2")


@register("dense_rows", with_views(_dense_rows_sql("sp", "(SELECT max(p_partkey) + 1 FROM part)", 64, "DOUBLE"), "sp"))
def q_dense_rows(spark, d):
    """Suppliers x parts as rows of 64 columns a segment, most of them partly or wholly empty."""
    return rw.render_rows(rw.dense_rows(sp(spark, d), tb.dimension_count(spark, d, "part"), 64, canonical=True, mark_empty=True))


@register("dense_rows_narrow", with_views(_dense_rows_sql("uh", "24"), "uh"))
def q_dense_rows_narrow(spark, d):
    return rw.render_rows(rw.dense_rows(uh(spark, d), 24, canonical=True))


@register("rows_as_maps", with_views(
    f"SELECT i, j // {rw.DEFAULT_WIDTH} AS seg, CAST(count(*) AS INTEGER) AS n, min(j) AS min_j, max(j) AS max_j, "
    "sum(v) AS total FROM sp GROUP BY 1, 2", "sp"))
def q_rows_as_maps(spark, d):
    return rw.map_row_stats(rw.rows_as_maps(sp(spark, d), canonical=True))


def _prod_sql(view: str, ncols: str, width: int) -> str:
    return ("WITH " + ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in ("sp", view)) +
            f", prod AS (SELECT a.i AS i, b.j AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM sp a JOIN {view} b "
            "ON a.j = b.i GROUP BY 1, 2) " + _dense_rows_sql("prod", ncols, width))


def _whole(rows: DataFrame) -> DataFrame:
    return rw.render_rows(rows.select("i", "seg", F.transform("row", lambda x: x.cast("bigint")).alias("row")))


@register("matmul_rows_broadcast", _prod_sql("pd", "367", 100))
def q_matmul_rows_broadcast(spark, d):
    """B is parts x days of the year: 367 columns, four segments."""
    return _whole(rw.matmul_rows_broadcast(written(sp(spark, d), "sp"), written(tb.part_day_lines(spark, d), "pd"), 367, width=100))


@register("matmul_rows_broadcast_partitioned", _prod_sql("pm", "13", rw.DEFAULT_WIDTH))
def q_matmul_rows_broadcast_partitioned(spark, d):
    return _whole(rw.matmul_rows_broadcast(written(sp(spark, d), "sp"), written(pm(spark, d), "pm"), 13, partition_rows=True))


# ---- run-metrics analytics -------------------------------------------------
SQL_VIEWS["runs"] = (
    "SELECT event_id AS run_id, CASE user_id % 6 WHEN 0 THEN 'coo' WHEN 1 THEN 'coo_broadcast' "
    "WHEN 2 THEN 'block' WHEN 3 THEN 'block_broadcast' WHEN 4 THEN 'rows_broadcast' ELSE 'auto' END AS algorithm, "
    "CAST(CASE WHEN event_id % 9 < 3 THEN 1000 WHEN event_id % 9 < 6 THEN 3000 ELSE 5000 END AS BIGINT) AS matrix_size, "
    "CASE event_id % 3 WHEN 0 THEN CAST(0.01 AS DOUBLE) WHEN 1 THEN CAST(0.1 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS density, "
    "CAST(round(value * 100) AS BIGINT) AS wall_cs, CAST(2 + event_id % 4 AS BIGINT) AS stage_count, "
    "CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Success' END AS status, props FROM events")


def runs(spark, d):
    return rn.runs_view(tb.table(spark, d, "events"))


RUN_COLS = "run_id, algorithm, matrix_size, density, wall_cs, stage_count, status, props"


@register("runs_success", with_views(f"SELECT {RUN_COLS} FROM runs WHERE status = 'Success'", "runs"))
def q_runs_success(spark, d):
    return rn.success(runs(spark, d))


@register("runs_slice", with_views(
    f"SELECT {RUN_COLS} FROM runs WHERE status = 'Success' AND density = 0.1", "runs"))
def q_runs_slice(spark, d):
    return rn.slice_eq(rn.success(runs(spark, d)), density=0.1)


@register("runs_mean_by_size", with_views(
    "SELECT matrix_size, avg(wall_cs) AS mean_wall_cs, avg(wall_cs) / 100 AS mean_wall_s, count(*) AS runs "
    "FROM runs WHERE status = 'Success' GROUP BY 1", "runs"))
def q_runs_mean_by_size(spark, d):
    return rn.mean_by_size(runs(spark, d))


@register("runs_stage_histogram", with_views(
    "SELECT stage_count, count(*) AS runs FROM runs WHERE status = 'Success' GROUP BY 1", "runs"))
def q_runs_stage_histogram(spark, d):
    return rn.stage_histogram(runs(spark, d))


@register("runs_distinct_axes", with_views(
    "SELECT DISTINCT * FROM (SELECT 'matrix_size' AS axis, CAST(matrix_size AS DOUBLE) AS value FROM runs "
    "UNION ALL SELECT 'density' AS axis, density AS value FROM runs) ORDER BY 1, 2", "runs"))
def q_runs_distinct_axes(spark, d):
    return rn.distinct_axes(runs(spark, d))


@register("runs_first", with_views(
    "SELECT algorithm, density, matrix_size, arg_min(wall_cs, run_id) AS first_wall_cs, min(run_id) AS first_run "
    "FROM runs WHERE status = 'Success' GROUP BY 1, 2, 3", "runs"))
def q_runs_first(spark, d):
    return rn.first_per_group(runs(spark, d))


@register("runs_pivot", with_views(
    "SELECT g.algorithm, g.matrix_size, d.density, coalesce(f.w, 0) AS first_wall_cs "
    "FROM (SELECT DISTINCT algorithm, matrix_size FROM runs WHERE status = 'Success') g "
    "CROSS JOIN (SELECT DISTINCT density FROM runs WHERE status = 'Success') d "
    "LEFT JOIN (SELECT algorithm, matrix_size, density, arg_min(wall_cs, run_id) AS w FROM runs "
    "WHERE status = 'Success' GROUP BY 1, 2, 3) f "
    "ON f.algorithm = g.algorithm AND f.matrix_size = g.matrix_size AND f.density = d.density", "runs"))
def q_runs_pivot(spark, d):
    return rn.pivot_size_density(runs(spark, d))


@register("runs_delta", with_views(
    "SELECT run_id, wall_cs - lag(wall_cs) OVER w AS delta_wall_cs, stage_count - lag(stage_count) OVER w AS delta_stages, "
    "(wall_cs - lag(wall_cs) OVER w) / 100 AS delta_wall_s FROM runs WHERE status = 'Success' WINDOW w AS (ORDER BY run_id)", "runs"))
def q_runs_delta(spark, d):
    """Successful runs only, so run_id has gaps."""
    return rn.consecutive_delta(rn.success(runs(spark, d)), rows_per_task=1000)


@register("runs_ratio", with_views(
    "SELECT matrix_size, density, ratio, coalesce(ratio > 5, false) AS fast_wins FROM ("
    "SELECT matrix_size, density, avg(wall_cs) FILTER (WHERE algorithm = 'coo') / "
    "nullif(avg(wall_cs) FILTER (WHERE algorithm = 'auto'), 0) AS ratio "
    "FROM runs WHERE status = 'Success' GROUP BY 1, 2)", "runs"))
def q_runs_ratio(spark, d):
    return rn.mode_ratio(runs(spark, d))


@register("runs_labels", with_views(
    "SELECT run_id, algorithm || '_Exp_' || CAST(matrix_size AS VARCHAR) || 'x' || CAST(matrix_size AS VARCHAR) "
    "|| '_D' || CAST(CAST(floor(density * 100) AS INTEGER) AS VARCHAR) AS label, floor((wall_cs + 5) / 10) / 10 AS wall_s, "
    "floor(wall_cs / stage_count + 0.5) / 100 AS stage_mean_s, "
    "CASE WHEN status = 'Success' THEN 'Success' ELSE 'Failed: ' || substr(props, 1, 50) || '...' END AS note "
    "FROM runs", "runs"))
def q_runs_labels(spark, d):
    return rn.labels(runs(spark, d))


@register("runs_sorted", with_views(f"SELECT {RUN_COLS} FROM runs ORDER BY matrix_size, run_id", "runs"))
def q_runs_sorted(spark, d):
    return rn.sorted_runs(runs(spark, d))


GRID_SQL = ("SELECT matrix_size, density, CASE WHEN matrix_size <= 1000 THEN 500 ELSE 1000 END AS block_size, "
            "CAST(floor(matrix_size * matrix_size * density) AS BIGINT) AS requested_nnz, count(*) AS runs "
            "FROM runs GROUP BY 1, 2")


@register("experiment_grid", with_views(GRID_SQL, "runs"))
def q_experiment_grid(spark, d):
    return rn.experiment_grid(runs(spark, d))


# ---- generators (shape of the supplier x part matrix) ------------------------
GEN_SEED, GEN_DENSITY = 42, 0.1
_SHAPE = "(SELECT max(s_suppkey) + 1 AS n FROM supplier) ns, (SELECT max(p_partkey) + 1 AS m FROM part) nm"
_VAL = "('0x' || substr(md5('{seed}{tag}:' || CAST(cell AS VARCHAR)), 1, {k}))::BIGINT"


def _val(k=8, tag=""):
    return _VAL.format(seed=GEN_SEED, tag=tag, k=k)


@register("gen_coo_exact",
          f"WITH g AS (SELECT s_suppkey AS i, p_partkey AS j, s_suppkey * m + p_partkey AS cell FROM supplier, part, {_SHAPE}), "
          f"r AS (SELECT i, j, cell, row_number() OVER (ORDER BY {_val(15)}, cell) AS rn FROM g) "
          f"SELECT i, j, {_val()} / 4294967296.0::DOUBLE AS v FROM r "
          f"WHERE rn <= (SELECT CAST(floor(CAST(count(*) AS DOUBLE) * {GEN_DENSITY}) AS BIGINT) FROM g)")
def q_gen_coo_exact(spark, d):
    n, m = _shape_sp(spark, d)
    return gen.gen_coo_exact(spark, n, m, GEN_DENSITY, GEN_SEED)


AFFINE_SQL = (
    f"WITH p AS (SELECT n * m AS total, m, CAST(floor(CAST(n * m AS DOUBLE) * {GEN_DENSITY}) AS BIGINT) AS nnz FROM {_SHAPE}), "
    f"st AS (SELECT min(x) AS a FROM p, range(CAST(floor({gen.GOLDEN} * total) AS BIGINT), "
    f"CAST(floor({gen.GOLDEN} * total) AS BIGINT) + 100000) t(x) WHERE gcd(x, total) = 1), "
    f"c AS (SELECT CAST((CAST(t.range AS HUGEINT) * a + {GEN_SEED} % total) % total AS BIGINT) AS cell, m "
    f"FROM p, st, range(p.nnz) t) "
    f"SELECT cell // m AS i, cell % m AS j, {_val()} / 4294967296.0::DOUBLE AS v FROM c")


@register("gen_coo_affine", AFFINE_SQL)
def q_gen_coo_affine(spark, d):
    n, m = _shape_sp(spark, d)
    return gen.gen_coo_affine(spark, n, m, GEN_DENSITY, GEN_SEED)


@register("gen_coo_batched_union", AFFINE_SQL)
def q_gen_coo_batched_union(spark, d):
    n, m = _shape_sp(spark, d)
    return gen.gen_coo_batched_union(spark, n, m, GEN_DENSITY, GEN_SEED, batch=max(1000, n * m // 400))


_BERN = (f"FROM (SELECT s_suppkey AS i, p_partkey AS j, s_suppkey * m + p_partkey AS cell FROM supplier, part, {_SHAPE}) "
         f"WHERE {_val(tag=':m')} / 4294967296.0::DOUBLE < {GEN_DENSITY}")


@register("gen_bernoulli", f"SELECT i, j, {_val()} / 4294967296.0::DOUBLE AS v {_BERN}")
def q_gen_bernoulli(spark, d):
    n, m = _shape_sp(spark, d)
    return gen.gen_bernoulli(spark, n, m, GEN_DENSITY, GEN_SEED)


@register("gen_rand_range", f"SELECT i, j, -1.0 + ({_val()} / 4294967296.0::DOUBLE) * 2.0 AS v {_BERN}")
def q_gen_rand_range(spark, d):
    n, m = _shape_sp(spark, d)
    return gen.gen_rand_range(spark, n, m, GEN_DENSITY, -1.0, 1.0, GEN_SEED)


@register("gen_blocks_hash",
          f"WITH g AS (SELECT s_suppkey AS i, p_partkey AS j, s_suppkey * m + p_partkey AS cell, n, m "
          f"FROM supplier, part, {_SHAPE}), "
          f"b AS (SELECT i, j, cell, i // {TILE_BS} AS bi, j // {TILE_BS} AS bj, "
          f"least({TILE_BS}, n - (i // {TILE_BS}) * {TILE_BS}) * least({TILE_BS}, m - (j // {TILE_BS}) * {TILE_BS}) AS sz FROM g), "
          f"r AS (SELECT i, j, cell, sz, row_number() OVER (PARTITION BY bi, bj ORDER BY {_val(15)}, cell) AS rn FROM b) "
          f"SELECT i, j, {_val()} / 4294967296.0::DOUBLE AS v FROM r "
          f"WHERE rn <= floor(sz * CAST({GEN_DENSITY} AS DOUBLE))")
def q_gen_blocks_hash(spark, d):
    n, m = _shape_sp(spark, d)
    return bl.unblockify(gen.gen_blocks_hash(spark, n, m, GEN_DENSITY, TILE_BS, GEN_SEED), TILE_BS)


_SPAN = dr.range_cells(GEN_DENSITY)
_U = "((({draw}) >> 12)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"
_JUMPS = (
    f"(WITH s AS (SELECT n * m AS total, m FROM {_SHAPE}), "
    f"r AS (SELECT t.range AS r, least({_SPAN}, total - t.range * {_SPAN}) AS size, m "
    f"FROM s, range(CAST(ceil(total / {_SPAN}.0) AS BIGINT)) t), "
    f"u AS (SELECT r, size, m, q.range AS q, {_U.format(draw=dr.draw_sql(GEN_SEED, 'r', 'q.range'))} AS u FROM r, range(size) q), "
    f"p AS (SELECT r, size, m, sum(CAST(floor(ln(u) / {math.log1p(-GEN_DENSITY)!r}::DOUBLE) + 1 AS BIGINT)) "
    f"OVER (PARTITION BY r ORDER BY q ROWS UNBOUNDED PRECEDING) - 1 AS place FROM u) "
    f"SELECT CAST(r * {_SPAN} + place AS BIGINT) AS cell, m FROM p WHERE place < size)")


@register("gen_bernoulli_gaps", f"SELECT cell // m AS i, cell % m AS j, {_val()} / 4294967296.0::DOUBLE AS v FROM {_JUMPS}")
def q_gen_bernoulli_gaps(spark, d):
    n, m = _shape_sp(spark, d)
    return dr.gen_bernoulli_gaps(spark, n, m, GEN_DENSITY, GEN_SEED)


@register("gen_rand_gaps",
          f"SELECT cell // m AS i, cell % m AS j, -1.0 + ({_val()} / 4294967296.0::DOUBLE) * 2.0 AS v FROM {_JUMPS}")
def q_gen_rand_gaps(spark, d):
    n, m = _shape_sp(spark, d)
    return dr.gen_rand_gaps(spark, n, m, GEN_DENSITY, -1.0, 1.0, GEN_SEED)


@register("gen_blocks_drawn",
          f"WITH s AS (SELECT n, m, (m + {TILE_BS} - 1) // {TILE_BS} AS nbc, (n + {TILE_BS} - 1) // {TILE_BS} AS nbr FROM {_SHAPE}), "
          f"b AS (SELECT t.range AS b, t.range // nbc AS bi, t.range % nbc AS bj, n, m FROM s, range(nbr * nbc) t), "
          f"z AS (SELECT b, bi, bj, least({TILE_BS}, n - bi * {TILE_BS}) * least({TILE_BS}, m - bj * {TILE_BS}) AS size, "
          f"least({TILE_BS}, m - bj * {TILE_BS}) AS nc FROM b), "
          f"d AS (SELECT b, bi, bj, nc, size, q.range AS q, "
          f"CAST({dr.draw_sql(GEN_SEED, '(2 * b)', 'q.range')} % size::UHUGEINT AS BIGINT) AS place FROM z, range(size) q), "
          f"f AS (SELECT b, bi, bj, nc, size, place, min(q) AS q FROM d GROUP BY ALL), "
          f"k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY q) AS rn FROM f) "
          f"SELECT bi * {TILE_BS} + place // nc AS i, bj * {TILE_BS} + place % nc AS j, "
          f"{_U.format(draw=dr.draw_sql(GEN_SEED, '(2 * b + 1)', 'place'))} AS v FROM k "
          f"WHERE rn <= floor(size * CAST({GEN_DENSITY} AS DOUBLE))")
def q_gen_blocks_drawn(spark, d):
    n, m = _shape_sp(spark, d)
    return bl.unblockify(dr.gen_blocks_drawn(spark, n, m, GEN_DENSITY, TILE_BS, GEN_SEED), TILE_BS)


# ---- files -------------------------------------------------------------------
@register("csv_roundtrip", with_views("SELECT i, j, v FROM sp", "sp"))
def q_csv_roundtrip(spark, d):
    path = shared_dir(spark, "csv-roundtrip")
    fl.write_csv(sp(spark, d), path)
    return fl.read_csv(spark, path, "i long, j long, v double")


def queries() -> dict[str, Query]:
    return {k: fn for k, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql is not None}
