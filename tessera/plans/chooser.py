"""Product strategy chooser (``matmul(..., strategy="auto")``).

One contract holds for every strategy and size.  Cells without a value are not
stored.  Whole numbers give exact bigint sums, decimals decimal sums; doubles
give the exact sum of the exact products, rounded once (see
:mod:`tessera.functions.exact`), NaN and infinities as double arithmetic has
them.  A cell whose sum is zero is not stored.  Tiles compute in doubles, so
they are taken only while no sum can need more than 53 bits and all values are
finite, and by decimals never.

Decides at plan-build time from cheap statistics, each one small Spark
aggregation: per-side nnz and shape, and the exact partial-product count
P = sum_k nnzA(k)·nnzB(k) with its largest single-key share.

Rules (thresholds measured on local runs, see README):
  * P large and the dense work m*k*n within FLOPS_PER_PAIR * P
                                       -> tiles (B's tiles broadcast when they
                                          provably fit);
  * B's coordinate rows fit the budget
                                       -> coordinate join with B broadcast, A
                                          partitioned by row (sums need no
                                          shuffle) unless one row is hot;
  * A's coordinate rows fit the budget -> the same with sides exchanged,
                                          (Bᵀ·Aᵀ)ᵀ, A broadcast;
  * otherwise                          -> shuffled coordinate join, splitting
                                          hot contraction keys over a grid when
                                          one key alone exceeds a fair share of P
                                          per task slot (skew.fair_target).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import coo, exact
from tessera.operators import blocks
from tessera.operators import multiply as mm
from tessera.plans import guard, skew

TILE_MIN_PAIRS = 10_000_000
# One partial product through a Spark join + aggregation costs about as much
# as this many multiply-adds inside a dense tile product (measured locally).
FLOPS_PER_PAIR = 500
COO_ROW_BYTES = 40
# Doubles hold whole numbers exactly below this.
EXACT = 2 ** 53


@dataclass
class ProductStats:
    nnz_a: int
    nnz_b: int
    shape_a: tuple[int, int]
    shape_b: tuple[int, int]
    pairs: int
    max_key_pairs: int
    max_row_nnz: int = 0
    max_abs_a: float = 0
    max_abs_b: float = 0
    kind: str = "double"
    range_a: exact.Range | None = None
    range_b: exact.Range | None = None

    @property
    def grid(self) -> exact.Grid | None:
        """How doubles are summed; None for other kinds."""
        if self.kind != "double" or self.range_a is None:
            return None
        return exact.grid_of(self.range_a, self.range_b, self.pairs)

    @property
    def tiles_exact(self) -> bool:
        """Tiles give the same sums as the coordinate join."""
        if self.kind == "bigint":
            return self.max_abs_a * self.max_abs_b * max(1, self.shape_a[1]) < EXACT
        if self.kind != "double":
            return False
        return self.grid is None or self.grid.plain and self.range_a.finite and self.range_b.finite

    @property
    def density(self) -> float:
        da = self.nnz_a / max(1, self.shape_a[0] * self.shape_a[1])
        db = self.nnz_b / max(1, self.shape_b[0] * self.shape_b[1])
        return min(da, db)


def result_kind(a: DataFrame, b: DataFrame) -> str:
    kinds = {x.schema["v"].dataType.typeName() for x in (a, b)}
    if kinds <= {"byte", "short", "integer", "long"}:
        return "bigint"
    return "decimal" if "decimal" in kinds and not kinds & {"double", "float"} else "double"


def product_stats(a: DataFrame, b: DataFrame) -> ProductStats:
    """All chooser statistics in one job: per contraction key, A's cell count
    and largest row index, B's cell count and largest column index; a full
    outer join of the two (small) per-key tables then gives nnz, shapes,
    P = sum ca*cb and the largest single-key share.  A's largest row comes
    from a per-row count in the same job (a union of two one-row aggregates)."""
    kind = result_kind(a, b)
    ranged = kind == "double"
    a_range, b_range = (exact.range_columns(F.col("v"), t) if ranged else [] for t in ("ra", "rb"))
    ka = a.groupBy(F.col("j").alias("k")).agg(F.count(F.lit(1)).alias("ca"), F.max("i").alias("mi"),
                                              F.max(F.abs(F.col("v").cast("double"))).alias("va"), *a_range)
    kb = b.groupBy(F.col("i").alias("k")).agg(F.count(F.lit(1)).alias("cb"), F.max("j").alias("mj"),
                                              F.max(F.abs(F.col("v").cast("double"))).alias("vb"), *b_range)
    pairs = F.coalesce(F.col("ca") * F.col("cb"), F.lit(0))
    keys = (ka.join(kb, "k", "full")
              .agg(F.lit(0).alias("part"),
                   F.coalesce(F.sum("ca"), F.lit(0)).alias("na"), F.coalesce(F.sum("cb"), F.lit(0)).alias("nb"),
                   F.max("mi").alias("mi"), F.max("mj").alias("mj"), F.max("k").alias("mk"),
                   F.max("va").alias("va"), F.max("vb").alias("vb"),
                   *((exact.merged_columns("ra") + exact.merged_columns("rb")) if ranged else []),
                   F.coalesce(F.sum(pairs), F.lit(0)).alias("p"), F.coalesce(F.max(pairs), F.lit(0)).alias("mp")))
    rows = (a.groupBy("i").agg(F.count(F.lit(1)).alias("c"))
              .agg(F.lit(1).alias("part"), F.max("c").alias("mr")))
    got = {r.part: r for r in keys.unionByName(rows, allowMissingColumns=True).collect()}
    r, mr = got[0], got[1].mr
    k = (r.mk if r.mk is not None else -1) + 1
    return ProductStats(r.na, r.nb, ((r.mi if r.mi is not None else -1) + 1, k),
                        (k, (r.mj if r.mj is not None else -1) + 1), r.p, r.mp, mr or 0,
                        r.va or 0, r.vb or 0, kind, *((exact.range_of(r, t) for t in ("ra", "rb")) if ranged else ()))


def choose(st: ProductStats, budget: int = guard.DEFAULT_BUDGET,
           target_pairs: int | None = None, partitions: int = 200,
           tile_min_pairs: int = TILE_MIN_PAIRS) -> str:
    dense_work = st.shape_a[0] * st.shape_a[1] * st.shape_b[1]
    if st.tiles_exact and st.pairs >= tile_min_pairs and dense_work <= FLOPS_PER_PAIR * st.pairs:
        tile_bytes = min(st.nnz_b * 12, st.shape_b[0] * st.shape_b[1] * 8)
        return "block_broadcast" if tile_bytes <= budget else "block"
    if st.nnz_b * COO_ROW_BYTES <= budget:
        hot_row = st.max_row_nnz > skew.HOT_ROW_FACTOR * st.nnz_a / max(1, partitions)
        # Partial sums shuffled by a plain broadcast join: at most P, at most
        # every task holding every result cell.  Partitioning A by row costs
        # one shuffle of A instead and sums in place.
        partial_rows = min(st.pairs, partitions * st.shape_a[0] * st.shape_b[1])
        return "coo_broadcast_rows" if not hot_row and st.nnz_a < partial_rows else "coo_broadcast"
    if st.nnz_a * COO_ROW_BYTES <= budget:
        return "coo_broadcast_left"
    if target_pairs is None:
        target_pairs = skew.fair_target(st.pairs, partitions)
    return "coo_salted" if st.max_key_pairs > target_pairs else "coo"


def matmul(a: DataFrame, b: DataFrame, strategy: str = "auto", bs: int = blocks.DEFAULT_BS,
           budget: int = guard.DEFAULT_BUDGET, stats: ProductStats | None = None,
           canonical: bool = False, tile_min_pairs: int = TILE_MIN_PAIRS) -> DataFrame:
    """A·B in coordinate form with the requested (or chosen) strategy; the
    result is the same for all of them (see the module's contract).  Tiles
    that could not be exact give way to the coordinate join.

    ``canonical``: both inputs hold one row per coordinate (lets the tile
    path skip its per-coordinate pre-aggregation)."""
    a, b = (coo.as_coo(x).where(F.col("v").isNotNull()) for x in (a, b))
    if strategy in ("auto", "block", "block_broadcast") or result_kind(a, b) == "double":
        stats = stats or product_stats(a, b)
    parts = mm.row_partitions(a.sparkSession, stats.nnz_a + stats.nnz_b if stats else None)
    slots = a.sparkSession.sparkContext.defaultParallelism
    if strategy == "auto":
        strategy = choose(stats, budget, partitions=parts, tile_min_pairs=tile_min_pairs,
                          target_pairs=skew.fair_target(stats.pairs, slots))
    if strategy in ("block", "block_broadcast") and not stats.tiles_exact:
        strategy = "coo_salted"
    return _stored(_product(a, b, strategy, bs, budget, stats, canonical, slots))


def _stored(c: DataFrame) -> DataFrame:
    return c.where(F.col("v") != 0)


def _product(a: DataFrame, b: DataFrame, strategy: str, bs: int, budget: int, stats: ProductStats | None,
             canonical: bool, slots: int) -> DataFrame:
    grid = stats.grid if stats else None
    if strategy in ("coo", "coo_merge", "coo_shuffle_hash", "coo_salted"):
        target = skew.fair_target(stats.pairs, slots) if stats else None
        # With statistics it is known whether any key is hot.
        salt = stats is None or strategy == "coo_salted" or stats.max_key_pairs > target
        join = {"coo_merge": "merge", "coo_shuffle_hash": "shuffle_hash"}.get(strategy)
        return mm.matmul_coo(a, b, join=join, salt=salt, target_pairs=target, grid=grid)
    if strategy == "coo_broadcast_left":
        bound = stats.nnz_a * COO_ROW_BYTES if stats else None
        return coo.transpose(mm.matmul_coo(coo.transpose(b), coo.transpose(a), join="broadcast", budget=budget,
                                           b_bytes_bound=bound, grid=grid)).select("i", "j", "v")
    if strategy in ("coo_broadcast", "coo_broadcast_rows"):
        bound = stats.nnz_b * COO_ROW_BYTES if stats else None
        join = "broadcast" if strategy == "coo_broadcast" else "broadcast_rows"
        return mm.matmul_coo(a, b, join=join, budget=budget, b_bytes_bound=bound,
                             rows_checked=stats is not None, a_rows=stats.nnz_a if stats else None, grid=grid)
    if strategy in ("block", "block_broadcast"):
        (m, k), (_, n) = stats.shape_a, stats.shape_b
        ta, tb_ = blocks.blockify(a, m, k, bs, canonical), blocks.blockify(b, k, n, bs, canonical)
        nbi, nbk, nbj = blocks.nblocks(m, bs), blocks.nblocks(k, bs), blocks.nblocks(n, bs)
        split = blocks.shape_split(nbi, nbk, nbj, min_keys=slots)
        prod = blocks.matmul_block(ta, tb_, broadcast=strategy == "block_broadcast", split=split,
                                   depth=blocks.shape_depth(nbi, nbk, nbj, split, min_keys=slots),
                                   budget=budget,
                                   b_bytes_bound=blocks.tile_bytes_bound(stats.nnz_b, k, n, bs),
                                   a_bytes_bound=blocks.tile_bytes_bound(stats.nnz_a, m, k, bs),
                                   nbk=nbk)
        return blocks.unblockify(prod, bs, integral=stats.kind == "bigint")
    raise ValueError(f"unknown strategy {strategy!r}")
