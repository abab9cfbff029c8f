"""Sums of products of doubles that do not depend on the order of the terms.

A double sum rounds after every addition, so another join, another number of
partitions or a retried task may end in another last digit, or in a cell that
does not quite cancel.  Here each product is written exactly, as the rounded
product and its rounding error, on a fixed grid of whole numbers ("limbs") that
reaches from the lowest bit any product can have to the highest.  Limbs are
summed as bigint, which is exact in any order and combines before the shuffle;
each cell's limbs are rounded to a double once, to nearest, at the end (the one
step in Python, over batches of finished cells).

The grid comes from one pass over both matrices (:func:`range_columns`): most
inputs need three or four limbs.  Where all sums fit 53 bits, as for whole
numbers held as doubles, a plain sum is exact already and no limbs are used.

Products that are not finite (and so those of NaN and infinities) are summed
as doubles, which is order-free for them: the cell is NaN or infinite.  If the
values of both sides together span more than about 2^±1000, products are
rounded to double before they are summed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Values that are whole multiples of 2^-s for one of these s need no lower bits.
SCALES = (0, 8, 16, 24, 32, 40)
LOWEST, HIGHEST = -1074, 1024
SPLIT = 134217729.0     # 2^27 + 1, parts a double into two halves


@dataclass(frozen=True)
class Range:
    """Finite values are whole multiples of 2^low below 2^top in size."""
    top: int
    low: int
    finite: bool


@dataclass(frozen=True)
class Grid:
    """``count`` limbs of ``width`` bits from 2^low on; no limbs: sums of
    doubles are exact.  ``errors``: products need their rounding errors."""
    low: int
    width: int
    count: int
    errors: bool

    @property
    def plain(self) -> bool:
        return self.count == 0


def range_columns(v: Column, tag: str) -> list[Column]:
    """Aggregates that :func:`range_of` reads."""
    x = v.cast("double")
    size = F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.abs(x))
    whole = [F.max((size * F.lit(2.0 ** s) != F.rint(size * F.lit(2.0 ** s)))).alias(f"{tag}_part{s}") for s in SCALES]
    return [F.max(size).alias(f"{tag}_max"), F.min(F.when(size > 0, size)).alias(f"{tag}_min"),
            F.max(x.isNotNull() & size.isNull()).alias(f"{tag}_odd"), *whole]


def merged_columns(tag: str) -> list[Column]:
    """The same aggregates over rows that hold them already."""
    return [F.max(f"{tag}_max").alias(f"{tag}_max"), F.min(f"{tag}_min").alias(f"{tag}_min"),
            F.max(f"{tag}_odd").alias(f"{tag}_odd"),
            *[F.max(f"{tag}_part{s}").alias(f"{tag}_part{s}") for s in SCALES]]


def range_of(row, tag: str) -> Range:
    most, least = row[f"{tag}_max"], row[f"{tag}_min"]
    finite = not row[f"{tag}_odd"]
    if not most:
        return Range(0, 0, finite)
    whole = next((s for s in SCALES if not row[f"{tag}_part{s}"]), None)
    low = -whole if whole is not None else max(LOWEST, math.frexp(least)[1] - 53)
    return Range(math.frexp(most)[1], low, finite)


def grid_of(a: Range, b: Range, terms: int) -> Grid:
    """The grid for sums of at most ``terms`` products of the two sides."""
    top, low = a.top + b.top, a.low + b.low
    errors = top - low > 53
    if top > 1000 or low < -1000 or max(a.top, b.top) > 990 or min(a.low, b.low) < -1000:
        top, low, errors = HIGHEST, LOWEST, False
    bits = max(1, terms).bit_length() + 1
    if top - low + bits <= 53:
        return Grid(low, 0, 0, False)
    width = max(8, min(36, 62 - bits))
    return Grid(low, width, max(1, -(-(top - low) // width)), errors)


def _limb(x: Column, t: int, grid: Grid) -> Column:
    """What limb ``t`` holds of ``x``: the difference of two neighbouring
    roundings, each a whole number that a double holds exactly.  A quotient
    beyond the range of doubles belongs to an ``x`` without bits that low."""
    q = F.rint(x / F.lit(2.0 ** (grid.low + t * grid.width)))
    if t == grid.count - 1:
        return q
    up = F.rint(x / F.lit(2.0 ** (grid.low + (t + 1) * grid.width)))
    return F.when(F.abs(q) < F.lit(float("inf")), q - up * F.lit(2.0 ** grid.width)).otherwise(0.0)


def sum_products(df: DataFrame, keys: list[str], a: str, b: str, grid: Grid | None) -> DataFrame:
    """``df`` grouped by ``keys``, with v = the sum of a * b."""
    if grid is None or grid.plain:
        return df.groupBy(*keys).agg(F.sum(F.col(a) * F.col(b)).alias("v"))
    d = df.select(*keys, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    p, odd = F.col("_a") * F.col("_b"), F.isnan("_p") | (F.abs("_p") == F.lit(float("inf")))
    # Veltkamp's halves and Dekker's product give the rounding error exactly.
    high = lambda x: F.col(x) * F.lit(SPLIT) - (F.col(x) * F.lit(SPLIT) - F.col(x))
    d = d.select(*keys, p.alias("_p"), "_a", "_b", *([high("_a").alias("_ah"), high("_b").alias("_bh")] if grid.errors else []))
    if grid.errors:
        al, bl = F.col("_a") - F.col("_ah"), F.col("_b") - F.col("_bh")
        e = (((F.col("_ah") * F.col("_bh") - F.col("_p")) + F.col("_ah") * bl) + al * F.col("_bh")) + al * bl
    else:
        e = F.lit(0.0)
    d = d.select(*keys, F.when(odd, F.col("_p")).alias("_odd"), F.when(odd, 0.0).otherwise(F.col("_p")).alias("_p"),
                 F.when(odd, 0.0).otherwise(e).alias("_e"))
    limb = lambda t: _limb(F.col("_p"), t, grid) + (_limb(F.col("_e"), t, grid) if grid.errors else 0.0)
    sums = d.groupBy(*keys).agg(F.sum("_odd").alias("_odd"),
                                *[F.sum(limb(t).cast("bigint")).alias(f"s{t}") for t in range(grid.count)])
    return rounded(sums, grid)


def rounded(sums: DataFrame, grid: Grid) -> DataFrame:
    """The rows of ``sums`` with v in place of their limbs s0, s1, ...: the
    double nearest to the number they stand for, or _odd where that is set."""
    limbs = [f"s{t}" for t in range(grid.count)]
    keep = [c for c in sums.columns if c != "_odd" and c not in limbs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [0] * batch.num_rows
            for t, name in enumerate(limbs):
                shift = t * grid.width
                whole = [n + (x << shift) for n, x in zip(whole, batch.column(name).to_pylist())]
            values = [odd if odd is not None else nearest(n, grid.low)
                      for odd, n in zip(batch.column("_odd").to_pylist(), whole)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values, pa.float64())], [*keep, "v"])
    schema = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in keep)
    return sums.mapInArrow(run, schema + ", v double")


def nearest(n: int, low: int) -> float:
    """n * 2^low as a double, to nearest."""
    try:
        return n / (1 << -low) if low < 0 else float(n << low)
    except OverflowError:
        return math.inf if n > 0 else -math.inf
