"""Splitting hot contraction keys.

A product joins A's column k with B's row k; key k alone produces
nnzA(k) * nnzB(k) partial products.  When one key holds a large share of
the cells, that work would land in one task.  A hot key is spread over an
``r x c`` grid of join keys: A's cells of the key are split into ``r``
slices by a hash of their row, B's cells into ``c`` slices by a hash of
their column, and slice pair ``(x, y)`` meets under salt ``x*c + y``.  Each
A cell is therefore copied ``c`` times and each B cell ``r`` times, and every
pair still meets exactly once.  ``r`` and ``c`` are picked so that
``r*c >= s = ceil(pairs / target)`` while the copies ``c*nnzA(k) +
r*nnzB(k)`` stay near their minimum ``2*sqrt(s*nnzA(k)*nnzB(k))``: a key hot
on both sides (a Gram matrix, a self-join) costs ``2*sqrt(s)`` copies of its
cells instead of ``s``; a key hot on one side only degenerates to splitting
that side and copying the small side.  Cold keys get salt 0 and are not
copied.

Nothing here grows on the driver: one aggregation tells whether any key is hot,
and the keys to split are written once and stay a DataFrame.  It is broadcast where its size, counted
first, fits the budget.  Beyond that it is joined in two steps that no key can
skew: keys with more than 1/HEAVY of a side's cells, of which a side has at
most HEAVY, are broadcast; all others meet the cells in a shuffle join, where
none fills a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import guard
from tessera.plans.partitions import COO_ROW_BYTES, pinned_partitions
from tessera.sources.files import materialize

# Partial products one task should produce for one key slice.
DEFAULT_TARGET_PAIRS = 20_000_000
# Lower end of the adaptive target: below this a slice is not worth a task.
MIN_TARGET_PAIRS = 10_000
# Slices of work per concurrent task slot the adaptive target aims for.
SLICES_PER_SLOT = 2
# A key is heavy that holds more than this share of a side's cells.
HEAVY = 1024
# Bytes of a row of the table of hot keys.
HOT_ROW_BYTES = 64


def key_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Per contraction key: cells on each side and the pairs it generates."""
    ca = left.groupBy(key).agg(F.count(F.lit(1)).alias("ca"))
    cb = right.groupBy(key).agg(F.count(F.lit(1)).alias("cb"))
    return ca.join(cb, key).withColumn("pairs", F.col("ca") * F.col("cb"))


def fair_target(total_pairs: int, slots: int) -> int:
    """Per-slice pair target from the total work: a key is hot when it alone
    exceeds a fair share of the pairs per concurrent task slot (it would
    outlast the stage's other tasks), capped at DEFAULT_TARGET_PAIRS and
    floored at MIN_TARGET_PAIRS.  Slots, not partitions: with 24 equal keys
    on 8 cores nothing straggles, on 4,000 cores every key does."""
    share = total_pairs // max(1, SLICES_PER_SLOT * slots)
    return int(min(DEFAULT_TARGET_PAIRS, max(MIN_TARGET_PAIRS, share)))


def hot_keys(left: DataFrame, right: DataFrame, key: str,
             target_pairs: int = DEFAULT_TARGET_PAIRS) -> DataFrame:
    """Keys whose pair count exceeds ``target_pairs``, with the number of
    slices ``_s`` and the grid ``_r`` (A slices) x ``_c`` (B slices)."""
    return hot_keys_of(key_pairs(left, right, key), key, target_pairs)


def hot_keys_of(kp: DataFrame, key: str, target_pairs: int) -> DataFrame:
    """:func:`hot_keys` from a per-key table ``(key, ca, cb, pairs)``."""
    kp = kp.where(F.col("pairs") > F.lit(target_pairs))
    ca, cb = F.col("ca"), F.col("cb")
    s = F.least(F.ceil(F.col("pairs") / F.lit(target_pairs)), F.col("pairs")).cast("long")
    # Balanced grid: r ~ sqrt(s * ca / cb), r <= ca; c = ceil(s / r) <= cb;
    # then r is widened again if c hit its cap.
    r0 = F.least(F.greatest(F.round(F.sqrt(s * ca / cb)), F.lit(1)), ca)
    c = F.least(F.greatest(F.ceil(s / r0), F.lit(1)), cb)
    r = F.least(F.greatest(F.ceil(s / c), F.lit(1)), ca)
    return kp.select(key, s.cast("int").alias("_s"), r.cast("int").alias("_r"), c.cast("int").alias("_c"),
                     ca.alias("_ca"), cb.alias("_cb"))


def salt_join(left: DataFrame, right: DataFrame, key: str, left_spread: list[str],
              right_spread: list[str], target_pairs: int | None = None,
              partitions: int | None = None,
              budget: int = guard.DEFAULT_BUDGET) -> tuple[DataFrame, DataFrame, list[str]]:
    """Add a ``_salt`` column to both sides; join on ``[key, "_salt"]``.

    ``left_spread`` / ``right_spread`` are the columns hashed to pick a
    cell's slice on each side.  ``target_pairs=None`` derives the target
    from the exact pair count (:func:`fair_target`), read from the same
    per-key table as the hot keys.  Without a hot key the sides come back as
    they are, to be joined on ``[key]``; otherwise hash-partitioned on
    ``(key, _salt)`` into ``partitions`` parts.  ``budget`` bounds the
    broadcast of the table of hot keys.
    """
    spark = left.sparkSession
    kp, given = key_pairs(left, right, key), target_pairs is not None
    if given:       # Keys are meant to be split, so their table is needed again: cells are counted once.
        kp = materialize(kp, "key-pairs")
    zero = F.lit(0).cast("bigint")
    r = kp.agg(*[F.coalesce(x, zero).alias(n) for x, n in (
        (F.sum("pairs"), "p"), (F.max("pairs"), "top"), (F.sum("ca"), "a"), (F.sum("cb"), "b"))]).first()
    if target_pairs is None:
        target_pairs = fair_target(r.p, spark.sparkContext.defaultParallelism)
    if r.top <= target_pairs:
        return left, right, [key]
    # Written once: read for the copies' number and by the joins of both sides.
    hot = hot_keys_of(kp, key, target_pairs)
    if not given:
        hot = materialize(hot, "hot-keys")
    # Extra rows the grid adds: each hot A cell is copied c times, each hot B
    # cell r times.
    extra = hot.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("_c") - 1) * F.col("_ca") + (F.col("_r") - 1) * F.col("_cb")),
                                                       zero).alias("x")).first()
    heavy = (F.col("_ca") * HEAVY > F.lit(r.a)) | (F.col("_cb") * HEAVY > F.lit(r.b))
    parts = max(partitions or 0, pinned_partitions(spark, (r.a + r.b + extra.x) * COO_ROW_BYTES))

    def spread(cols: list[str], n):
        return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), n.cast("long")).cast("int")

    def with_grid(df: DataFrame, cols: list[str]) -> DataFrame:
        """``df`` with _r and _c of its hot keys, null for the others."""
        grid = hot.select(key, "_r", "_c")
        if extra.n * HOT_ROW_BYTES <= budget:
            return df.join(F.broadcast(grid), key, "left")
        most = hot.where(heavy).select(key, F.col("_r").alias("_hr"), F.col("_c").alias("_hc"))
        # Cells of heavy keys pass the second join on values that match nothing.
        d = df.join(F.broadcast(most), key, "left")
        d = d.withColumn("_t", F.when(F.col("_hr").isNull(), 0).otherwise(1 + spread(cols, F.lit(HEAVY))))
        rest = hot.where(~heavy).select(key, "_r", "_c", F.lit(0).alias("_t"))
        d = d.join(rest.hint("merge"), [key, "_t"], "left")
        return d.withColumns({"_r": F.coalesce("_hr", "_r"), "_c": F.coalesce("_hc", "_c")}).drop("_t", "_hr", "_hc")

    row, col = F.col("_r"), F.col("_c")
    x = spread(left_spread, row)
    left_salts = F.when(row.isNull(), F.array(F.lit(0))).otherwise(F.sequence(x * col, x * col + col - 1))
    y = spread(right_spread, col)
    right_salts = F.when(col.isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), row - 1), lambda t: t * col + y))

    def salted(df: DataFrame, cols: list[str], salts) -> DataFrame:
        # The join inputs are small next to the pairs they produce, so AQE's
        # byte-based coalescing would fold the spread keys back into a few
        # tasks; a repartition with an explicit count is never coalesced, and
        # the join on (key, _salt) reuses it.
        return (with_grid(df, cols).withColumn("_salt", F.explode(salts)).drop("_r", "_c")
                .repartition(parts, key, "_salt"))

    return salted(left, left_spread, left_salts), salted(right, right_spread, right_salts), [key, "_salt"]


HOT_ROW_FACTOR = 2


def row_counts(df: DataFrame, key: str = "i") -> tuple[int, int]:
    """(rows of the largest ``key`` group, all rows), one small aggregation."""
    r = df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("m"), F.sum("c").alias("n")).first()
    return int(r.m or 0), int(r.n or 0)


def is_balanced(hottest: int, total: int, partitions: int) -> bool:
    """True when no single key holds more than HOT_ROW_FACTOR times an even
    per-partition share of the rows, i.e. partitioning by that key cannot put
    a dominant share of the work in one task."""
    return total == 0 or hottest <= HOT_ROW_FACTOR * total / max(1, partitions)

