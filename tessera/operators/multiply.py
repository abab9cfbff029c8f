"""Coordinate-form products.

``C = A · B`` is a join on the contraction index followed by a sum per output
cell.  Catalyst plans the join (sort-merge, shuffled hash or broadcast), AQE
splits skewed join partitions, and the sum runs as partial + final hash
aggregation so partial products are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exact, whole
from tessera.plans import guard, partitions, skew

JOIN_HINTS = ("shuffle_hash", "merge")


def _left(a: DataFrame) -> DataFrame:
    return a.select("i", F.col("j").alias("k"), F.col("v").alias("av"))


def _right(b: DataFrame) -> DataFrame:
    # Same column order as _left (other index, contraction index, value): for
    # B = Aᵀ both sides are then the same projection of A, and Spark reuses
    # one shuffle of A for both sides of the join.
    return b.select("j", F.col("i").alias("k"), F.col("v").alias("bv"))


def row_partitions(spark, rows: int | None = None) -> int:
    """Partitions for row-partitioned products: the session's shuffle width,
    at least four per core so row groups stay small per task, and enough
    that ``rows`` coordinate rows (when known) fit the per-task byte target."""
    return partitions.pinned_partitions(spark, None if rows is None else rows * partitions.COO_ROW_BYTES)


def _joined(a: DataFrame, b: DataFrame, join: str | None, salt: bool,
            target_pairs: int | None, budget: int, b_bytes_bound: int | None = None,
            rows_checked: bool = False, a_rows: int | None = None) -> DataFrame:
    left, right = _left(a), _right(b)
    ok = False
    if join == "broadcast_rows":
        right, ok = guard.checked_broadcast(right, budget, upper_bound=b_bytes_bound)
        balanced = True
        if ok and not rows_checked:
            hottest, a_rows = skew.row_counts(a)
            balanced = skew.is_balanced(hottest, a_rows, row_partitions(a.sparkSession, a_rows))
        parts = row_partitions(a.sparkSession, a_rows)
        if ok and balanced:
            # A hash-partitioned by output row: the (i, j) aggregation after
            # the broadcast join is co-located, so partial products are summed
            # in place and never shuffled.
            left = _left(a.repartition(parts, "i"))
    elif join == "broadcast":
        right, ok = guard.checked_broadcast(right, budget, upper_bound=b_bytes_bound)
    elif join not in (None, "auto", *JOIN_HINTS):
        raise ValueError(f"unknown join kind {join!r}")
    keys = ["k"]
    if salt and not ok:         # a broadcast side meets every slice of the other anyway
        left, right, keys = skew.salt_join(left, right, "k", ["i"], ["j"], target_pairs)
    return left.join(right.hint(join) if join in JOIN_HINTS else right, keys)


def matmul_coo(a: DataFrame, b: DataFrame, join: str | None = None, salt: bool = True,
               target_pairs: int | None = None,
               budget: int = guard.DEFAULT_BUDGET, b_bytes_bound: int | None = None,
               rows_checked: bool = False, a_rows: int | None = None,
               grid: exact.Grid | None = None) -> DataFrame:
    """A·B in coordinate form (M2; M6 with ``join="broadcast"``).

    ``join``: None lets Catalyst/AQE choose; ``"shuffle_hash"`` / ``"merge"``
    pin the join; ``"broadcast"`` ships B when a size probe proves it fits
    ``budget`` and keeps the shuffle join otherwise; ``"broadcast_rows"``
    also hash-partitions A by row so the final sums need no shuffle — only
    after a check (skipped when ``rows_checked``; ``a_rows`` is then A's
    cell count, which sizes the partitioning) that no single row holds a
    dominant share of A; with a hot row it stays a plain broadcast join.  ``salt`` splits hot
    contraction keys of a shuffle join over a grid (see :mod:`tessera.plans.skew`);
    ``target_pairs=None`` derives the per-slice pair target from the total work.
    ``grid`` sums doubles exactly (see :mod:`tessera.functions.exact`).
    """
    j = _joined(a, b, join, salt, target_pairs, budget, b_bytes_bound, rows_checked, a_rows)
    return exact.sum_products(j, ["i", "j"], "av", "bv", grid)


def partial_products(a: DataFrame, b: DataFrame) -> DataFrame:
    """The un-aggregated cell products ``(i, k, j, a_ik * b_kj)`` (P7), hot
    keys split as in :func:`matmul_coo`."""
    return (_joined(a, b, None, True, None, guard.DEFAULT_BUDGET)
              .select("i", "k", "j", (F.col("av") * F.col("bv")).alias("v")))


def partial_product_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """P = sum_k nnzA(k)·nnzB(k): the exact number of partial products a
    coordinate join creates, from two per-key counts (no product built)."""
    kp = skew.key_pairs(_left(a), _right(b), "k")
    return kp.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("pairs"),
                  F.coalesce(F.max("pairs"), F.lit(0)).cast("bigint").alias("max_key_pairs"))


def matmul_naive(spark: SparkSession, a: DataFrame, b: DataFrame) -> DataFrame:
    """M1: the product spelled as a filtered cartesian product in SQL.

    The predicate ``a.j = b.i`` sits in WHERE; Catalyst turns it into the
    equi-join key, so the physical plan is the same keyed join as M2 and no
    cartesian product is executed.  Hot keys carry a salt that has to agree too.
    """
    left, right, keys = skew.salt_join(_left(a), _right(b), "k", ["i"], ["j"])
    where = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return spark.sql("SELECT a.i AS i, b.j AS j, sum(a.av * b.bv) AS v FROM {a} a, {b} b "
                     f"WHERE {where} GROUP BY a.i, b.j", a=left, b=right)


def matmul_abt(a: DataFrame, b: DataFrame, eps: float | None = None,
               join: str | None = None, salt: bool = True,
               target_pairs: int | None = None) -> DataFrame:
    """A·Bᵀ: dot products of A's rows with B's rows over shared columns (M7).

    ``eps`` drops results with |v| <= eps; ``salt`` splits hot shared columns
    as in :func:`matmul_coo`.  Sums of whole numbers that no bigint holds are
    decimal(38,0) (see :mod:`tessera.functions.whole`).
    """
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("av"))
    right = b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("bv"))
    wide = whole.may_overflow(left, right, same=a is b)
    ok = False
    if join == "broadcast":
        right, ok = guard.checked_broadcast(right)
    keys = ["k"]
    if salt and not ok:
        left, right, keys = skew.salt_join(left, right, "k", ["i"], ["j"], target_pairs)
    if join in JOIN_HINTS:
        right = right.hint(join)
    out = left.join(right, keys).groupBy("i", "j").agg(F.sum(_term("av", "bv", wide)).alias("v"))
    if wide:
        out = whole.narrowed(out)
    if eps is not None:
        out = out.where(F.abs("v") > F.lit(eps))
    return out


def _term(a: str, b: str, wide: bool) -> Column:
    return whole.product(F.col(a), F.col(b)) if wide else F.col(a) * F.col(b)


def gram(a: DataFrame, eps: float | None = None, salt: bool = True,
         target_pairs: int | None = None, join: str | None = None) -> DataFrame:
    """A·Aᵀ using symmetry: only pairs with i <= i' are multiplied and summed,
    then each off-diagonal cell is emitted twice.  Halves the aggregation
    input and the shuffle of the product.  ``salt`` splits hot columns; a
    column is hot on both sides of a Gram matrix, so the grid split copies
    its cells about ``2*sqrt(s)`` times, not ``s`` times.  ``join`` pins the
    kind of join, where Catalyst's estimate of a side would be wrong.  Sums of
    whole numbers are as wide as in :func:`matmul_abt`."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("av"))
    right = a.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("bv"))
    wide = whole.may_overflow(left, right, same=True)
    keys = ["k"]
    if salt:
        left, right, keys = skew.salt_join(left, right, "k", ["i"], ["j"], target_pairs)
    if join in JOIN_HINTS:
        right = right.hint(join)
    x, y = left.alias("x"), right.alias("y")
    cond = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in keys] + [F.col("x.i") <= F.col("y.j")]
    upper = (x.join(y, cond).groupBy(F.col("x.i").alias("i"), F.col("y.j").alias("j"))
              .agg(F.sum(_term("x.av", "y.bv", wide)).alias("v")))
    if wide:
        upper = whole.narrowed(upper)
    if eps is not None:
        upper = upper.where(F.abs("v") > F.lit(eps))
    me = F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col("v").alias("v"))
    mirror = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("v"))
    both = F.when(F.col("i") < F.col("j"), F.array(me, mirror)).otherwise(F.array(me))
    return upper.select(F.explode(both).alias("c")).select("c.i", "c.j", "c.v")


def sum_of_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """sum(A·B) = sum_k colSum_A(k) · rowSum_B(k) (M9): two aggregations and a
    join of per-key sums; the product itself is never built."""
    ca = a.groupBy(F.col("j").alias("k")).agg(F.sum("v").alias("ca"))
    rb = b.groupBy(F.col("i").alias("k")).agg(F.sum("v").alias("rb"))
    return ca.join(rb, "k").agg(F.sum(F.col("ca") * F.col("rb")).alias("total"))
