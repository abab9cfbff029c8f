"""How large a product will be, without its products.

A cell of A·B is stored where some contraction index meets row i of A and
column j of B, so a result row's columns are the union of the columns of B's
rows that A's row selects.  Unions of bitmaps count them exactly, unions of
sketches about; no partial product is built or summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# log2 of a sketch's registers: about 1.6 % of error for one row.
LG_K = 12
# Columns that a bitmap stands for, so that few stored columns take few bytes.
SEGMENT = 512


def _columns_met(a: DataFrame, b: DataFrame, held: Column, *segment: Column) -> DataFrame:
    """B's columns per contraction index (and segment) as ``held``, joined with
    the rows of A that select them."""
    per_key = b.groupBy(F.col("i").alias("k"), *segment).agg(held.alias("held"))
    return a.select("i", F.col("j").alias("k")).distinct().join(per_key, "k")


def result_nnz(a: DataFrame, b: DataFrame) -> DataFrame:
    """nnz: the stored cells of A·B, computed zeros included.

    B's columns are cut into segments of SEGMENT; a bitmap stands for a row's
    columns within one, so a group holds one bitmap however many contraction
    indices it meets.  Spark aggregates bitmaps in buffers of 4 KiB: both sides
    are dealt by their groups before, so that only the SEGMENT bits in use are
    joined, sorted and shuffled."""
    segment = F.expr(f"shiftright(j, {SEGMENT.bit_length() - 1})")
    b = b.select(F.col("i"), segment.alias("seg"), F.pmod("j", F.lit(SEGMENT)).alias("j")).repartition("i", "seg")
    bits = F.substring(F.bitmap_construct_agg("j"), 1, SEGMENT // 8)
    met = _columns_met(a, b, bits, F.col("seg")).select("i", "seg", "held").repartition("i", "seg")
    rows = met.groupBy("i", "seg").agg(F.bitmap_count(F.bitmap_or_agg("held")).alias("n"))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("nnz"))


def estimated_row_nnz(a: DataFrame, b: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(i, nnz): about how many cells each row of A·B stores, by sketches of a
    bounded size per contraction index and row, whatever B's width."""
    met = _columns_met(a, b, F.hll_sketch_agg("j", lg_k))
    return met.groupBy("i").agg(F.hll_sketch_estimate(F.hll_union_agg("held")).cast("bigint").alias("nnz"))


def estimated_nnz(a: DataFrame, b: DataFrame, lg_k: int = LG_K) -> int:
    """About how many cells A·B stores, for partition counts and choices."""
    return estimated_row_nnz(a, b, lg_k).agg(F.coalesce(F.sum("nnz"), F.lit(0))).first()[0]
