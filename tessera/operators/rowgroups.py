"""Rows of A·B where B is too large to be shipped whole.

Both sides meet by the contraction index once, but no product is made there.
The rows of A belong to groups, one a task, whose result rows fit ACC_BYTES.
Where a chunk of cells of A meets B, each group is sent its cells of A and the
rows of B that these use, as arrays of the smallest exact types; the task of
the group multiplies what it gets and adds up in place.  So what is shuffled
follows the stored cells (a row of B goes to a group at most once a chunk), not
the partial products, and a task holds its result rows and one such packet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tiles import HELD_PRODUCTS
from tessera.plans import skew
from tessera.plans.partitions import COO_ROW_BYTES, pinned_partitions

# Result rows that a task adds up.
ACC_BYTES = 64 * 1024 * 1024
# Bytes of result rows in one batch.
OUT_BYTES = 16 * 1024 * 1024
# Cells of both sides that are dealt to the groups at a time.
CHUNK = 1 << 20
# Fixed value: a multiplier that spreads row numbers over the groups.
SPREAD = np.uint64(0x9E3779B97F4A7C15)

PACKET = ("ids", "row", "av", "na", "col", "bv", "nb")
PACKET_SCHEMA = "task int, empty boolean, " + ", ".join(f"{c} binary" for c in PACKET)
SMALL = (np.dtype("u1"), np.dtype("<u2"), np.dtype("<i4"))


def packed(x: np.ndarray) -> bytes:
    """The array in the smallest type that holds each value exactly, behind
    that type's name."""
    if len(x):
        whole = x if x.dtype.kind != "f" else None
        # A -0.0 or a number that is not whole stays a double.
        if whole is None and (np.abs(x) < 1 << 31).all() and (x == np.rint(x)).all() and not np.signbit(x[x == 0]).any():
            whole = x.astype(np.int64)
        if whole is not None:
            lo, hi = whole.min(), whole.max()
            kind = next((t for t in SMALL if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max), None)
            x = whole if kind is None else whole.astype(kind)
    name = x.dtype.newbyteorder("<").str.encode()
    return name + x.astype(name.decode(), copy=False).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, b[:3].decode(), offset=3)


def group_of(i: np.ndarray, groups: int) -> np.ndarray:
    return ((i.astype(np.uint64) * SPREAD) >> np.uint64(33)).astype(np.int64) % groups


def _lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the runs of ``x`` and their lengths."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + n[0] - 1, starts[1] .. and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def _packets(groups: int, deals: int, ncols: int, kind):
    """Cells in the order of (k, side), those of B first: a packet for each
    group that has cells of A in a chunk."""
    def dealt(k, side, x, v, known_x, known_v, deal) -> Iterator[tuple]:
        a, b = side == 1, side == 0
        rows_of_b = _lengths(k[b])[0]
        kept = known_x[b] & known_v[b] & (x[b] >= 0) & (x[b] < ncols)
        bk, bj, bv = k[b][kept], x[b][kept], v[b][kept]
        at = np.searchsorted(rows_of_b, k[a])
        met = at < len(rows_of_b)
        met[met] = rows_of_b[at[met]] == k[a][met]
        at, i, av, known_i, known_av = (y[met] for y in (at, x[a], v[a], known_x[a], known_v[a]))
        count = np.diff(np.searchsorted(bk, np.append(rows_of_b, rows_of_b[-1:] + 1))) if len(rows_of_b) else np.zeros(0, np.int64)
        start = np.cumsum(count) - count
        if not known_i.all():
            yield 0, True, *(np.zeros(0, np.int64),) * 2, np.zeros(0, kind), *(np.zeros(0, np.int64),) * 2, np.zeros(0, kind), np.zeros(0, np.int64)
            at, i, av, known_av = (y[known_i] for y in (at, i, av, known_av))
        g = group_of(i, groups)
        by = np.argsort(g, kind="stable")       # still by k within a group
        bounds = np.searchsorted(g[by], np.arange(groups + 1))
        for n in range(groups):
            mine = by[bounds[n]:bounds[n + 1]]
            if not len(mine):
                continue
            ids, row = np.unique(i[mine], return_inverse=True)
            made = known_av[mine]               # a cell without a value makes a row, not a product
            used, na = _lengths(at[mine][made])
            nb = count[used]
            cells = _ranges(start[used], nb)
            yield n * deals + deal, False, ids, row[made], av[mine][made], na, bj[cells], bv[cells], nb

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = TaskContext.get().partitionId() % deals
        held, n = [], 0

        def out():
            k, side, x, v, kx, kv = (np.concatenate(y) for y in zip(*held))
            for task, empty, *arrays in dealt(k, side, x, v, kx, kv, deal):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task], pa.int32()), pa.array([empty]), *(pa.array([packed(y)], pa.binary()) for y in arrays)],
                    ["task", "empty", *PACKET])
            # Later cells of A may belong to the last row of B.
            last = (side == 0) & (k == k[-1])
            return [tuple(y[last] for y in (k, side, x, v, kx, kv))]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, v = batch.column("x"), batch.column("v")
            held.append((batch.column("k").to_numpy(), batch.column("side").to_numpy(), x.fill_null(0).to_numpy(),
                         v.fill_null(0).to_numpy(), x.is_valid().to_numpy(zero_copy_only=False), v.is_valid().to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= CHUNK:
                held, n = (yield from out()), 0
        if held:
            yield from out()
    return run


def _multiplied(ncols: int, width: int, kind):
    """The packets of a group: its result rows, in segments."""
    def add(acc: np.ndarray, slot: np.ndarray, av, na, col, bv, nb) -> None:
        place = np.repeat(np.arange(len(na)), na)       # row of B of each cell of A
        start, m = (np.cumsum(nb) - nb)[place], nb[place]
        done, lo = np.concatenate([[0], np.cumsum(m)]), 0
        while lo < len(m):
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] + HELD_PRODUCTS, side="right")) - 1)
            at = _ranges(start[lo:hi], m[lo:hi])
            np.add.at(acc, np.repeat(slot[lo:hi] * ncols, m[lo:hi]) + col[at], np.repeat(av[lo:hi], m[lo:hi]) * bv[at])
            lo = hi

    def segments(ids: pa.Array, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, OUT_BYTES // (8 * ncols))
        for lo in range(0, len(rows), step):
            for seg in range(-(-ncols // width)):
                part = np.ascontiguousarray(rows[lo:lo + step, seg * width:(seg + 1) * width])
                ends = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(part)), pa.array(np.full(len(part), seg)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))], ["i", "seg", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, slots = np.zeros(0, np.int64), np.zeros(0, np.int64)       # ascending, and their places in acc
        acc, empty = np.zeros((0, ncols), kind), False
        for batch in batches:
            for r in range(batch.num_rows):
                empty |= batch.column("empty")[r].as_py()
                new, row, av, na, col, bv, nb = (unpacked(batch.column(c)[r].as_py()) for c in PACKET)
                unknown = np.setdiff1d(new, ids, assume_unique=True)
                if len(unknown):
                    slots = np.concatenate([slots, len(ids) + np.arange(len(unknown))])
                    ids = np.concatenate([ids, unknown])
                    by = np.argsort(ids)
                    ids, slots = ids[by], slots[by]
                    if len(ids) > len(acc):
                        acc = np.concatenate([acc, np.zeros((max(len(ids) - len(acc), len(acc) // 4), ncols), kind)])
                slot = slots[np.searchsorted(ids, new)][row]
                add(acc.reshape(-1), slot, av.astype(kind), na.astype(np.int64), col, bv.astype(kind), nb.astype(np.int64))
        if len(ids):
            order = np.argsort(slots)
            yield from segments(pa.array(ids[order], pa.int64()), acc[:len(ids)])
        if empty:
            yield from segments(pa.array([None], pa.int64()), np.zeros((1, ncols), kind))
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in the order of (i, seg), with those of one row added up."""
    key, total = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()),
                                           pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))],
                                          ["i", "seg", "row"])
    for batch in batches:
        for i, seg, row in zip(batch.column("i").to_pylist(), batch.column("seg").to_pylist(), batch.column("row")):
            part = row.values.to_numpy()
            if (i, seg) == key:
                total = total + part
                continue
            if key is not None:
                yield out()
            key, total = (i, seg), part
    if key is not None:
        yield out()


def grouped_product(a: DataFrame, b: DataFrame, ncols: int, width: int, sql: str) -> DataFrame:
    """(i, seg, row array): the rows of A·B, zero-filled, of every i with a cell
    whose column is a row of B.  ``sql``: the type of their values.

    A row that holds a large share of A is dealt to several tasks by its
    columns, whose partial rows are added up."""
    spark, kind = a.sparkSession, np.int64 if sql == "bigint" else np.float64
    per = a.groupBy("i").agg(F.count(F.lit(1)).alias("c"))
    r = per.agg(F.count(F.lit(1)).alias("rows"), F.max("c").alias("top"), F.sum("c").alias("n")).first()
    rows, top, n = r.rows, int(r.top or 0), int(r.n or 0)
    cores = spark.sparkContext.defaultParallelism
    groups = cores * max(1, math.ceil(rows * ncols * 8 / (ACC_BYTES * cores)))
    deals = 1 if skew.is_balanced(top, n, groups) else min(groups, math.ceil(top * groups / n))

    def side(df: DataFrame, k: str, x: str, which: int) -> DataFrame:
        return df.where(F.col(k).isNotNull()).select(F.col(k).alias("k"), F.lit(which).alias("side"), F.col(x).alias("x"),
                                                     F.col("v").cast(sql).alias("v"))
    parts = pinned_partitions(spark, (n + b.count()) * COO_ROW_BYTES)
    met = side(a, "j", "i", 1).unionByName(side(b, "i", "j", 0)).repartition(parts, "k").sortWithinPartitions("k", "side")
    packets = met.mapInArrow(_packets(groups, deals, ncols, kind), PACKET_SCHEMA)
    schema = f"i long, seg long, row array<{sql}>"
    out = packets.repartitionById(groups * deals, "task").mapInArrow(_multiplied(ncols, width, kind), schema)
    if deals == 1:
        return out
    return out.repartition(parts, "i").sortWithinPartitions("i", "seg").mapInArrow(_added, schema)
