"""Exact top-k inner products of stated queries over all vectors.

Vectors are turned into integers (floor of ``scale`` times each component) and
packed into blocks by falling length.  An orthogonal rotation, from the singular
vectors of a bounded sample, moves most of a vector's length into its first
coordinates.  A group of queries meets the blocks of a range one after the
other, the longest vectors first, and keeps its k best all along: the k-th of
them is the query's threshold, which rises from block to block.  A block whose
longest vector cannot reach any threshold is passed over; in the others, pairs
whose lengths' product stays below the threshold go; then partial sums over
the first rotated coordinates plus the Cauchy-Schwarz bound of the rest must
reach it, with more coordinates each step; what is left gets its exact integer
product.  Blocks are dealt to ranges in turn, so each range begins with long
vectors; a range's blocks go once to each group of queries, which bounds a
task however many vectors there are.  The rotation only decides how much is
pruned, never the result.

Defined results.  Vectors that are null or hold a null or non-finite component,
and rows without vec_id, take no part.  Shorter vectors count as padded with
zeros.  Every row is a query or a candidate of its own: a repeated row asks and
is found each time, and only a query's own row is never its neighbour.  Ties go
to the smaller vec_id.  Scores are exact; beyond the range of a long they are
cut to it.  Vectors of any width are held whole.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import durable, small_batches

BLOCK = 256           # vectors of a block
BLOCKS = 128          # blocks of a range, about
QUERIES = 512         # queries of a group
SAMPLE = 4096         # vectors the rotation is fitted on
EXACT = float(2 ** 53)


def _integers(scale: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, vs, norms = [], [], []
            for n, x in enumerate(batch.column(2).to_pylist()):
                if x is None or any(c is None for c in x):
                    continue
                v = np.zeros(size)
                v[:len(x)] = np.floor(scale * np.array(x, np.float64))
                if np.isfinite(v).all():
                    kept.append(n)
                    vs.append(v.tobytes())
                    norms.append(float(np.sqrt(v @ v)))
            b = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vs, pa.binary()),
                                              pa.array(norms, pa.float64())], ["id", "asks", "v", "norm"])
    return run


def _packed(most: int):
    """Rows of a partition, in order, as numbered blocks of at most ``most`` vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, number = TaskContext.get().partitionId(), [], 0

        def block():
            uids, ids, vs, norms = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number]), pa.array([max(norms)], pa.float64()),
                 pa.array([np.array(uids, np.int64).tobytes()], pa.binary()),
                 pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(vs)], pa.binary())],
                ["block", "top", "uids", "ids", "vs"])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == most:
                    yield block()
                    held, number = [], number + 1
        if held:
            yield block()
    return run


def exact_products(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (rows, cols), as int64."""
    out = np.empty(len(rows), np.int64)
    small = len(q) and len(c) and (np.abs(q).max() * np.abs(c).max() * q.shape[1]) < EXACT
    for lo in range(0, len(rows), 1 << 16):
        a, b = rows[lo:lo + (1 << 16)], cols[lo:lo + (1 << 16)]
        if small:
            out[lo:lo + len(a)] = np.einsum("ij,ij->i", q[a], c[b]).astype(np.int64)
        else:
            whole = [sum(int(x) * int(y) for x, y in zip(q[i].tolist(), c[j].tolist())) for i, j in zip(a, b)]
            out[lo:lo + len(a)] = [min(max(x, -2 ** 63), 2 ** 63 - 1) for x in whole]
    return out


def search(q: np.ndarray, q_uids: np.ndarray, floor: np.ndarray, c: np.ndarray, c_uids: np.ndarray, rotation: np.ndarray):
    """(query row, candidate row, score) arrays of the pairs of different rows
    that reach the query's ``floor``."""
    with np.errstate(over="ignore", invalid="ignore"):
        rq, rc = q @ rotation, c @ rotation
        d = q.shape[1]
        steps = sorted({max(1, d * s // 4) for s in (1, 2, 3)})
        rest = lambda m, h: np.sqrt(np.maximum((m[:, h:] ** 2).sum(1), 0))
        nq, nc = rest(rq, 0), rest(rc, 0)
        slack = 1e-9 * nq.max(initial=0) * nc.max(initial=0) + 1e-6
        alive = np.outer(nq, nc) >= (floor - slack)[:, None]
        alive &= q_uids[:, None] != c_uids[None, :]
        partial, done = np.zeros(alive.shape), 0
        for h in steps:
            r, s = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(r):
                return (np.zeros(0, np.int64),) * 3
            at = np.ix_(r, s)
            partial[at] += rq[r, done:h] @ rc[s, done:h].T
            done = h
            reach = partial[at] + np.outer(rest(rq[r], h), rest(rc[s], h))
            alive[at] &= ~(reach < (floor[r] - slack)[:, None])
    rows, cols = np.nonzero(alive)
    score = exact_products(q, c, rows, cols)
    keep = score >= floor[rows]
    return rows[keep], cols[keep], score[keep]


def _vectors(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, -1) if n else np.zeros((0, 1))


class Group:
    """Queries with the k best rows they have met, and the k-th score as floor."""

    def __init__(self, uids: bytes, ids: bytes, vs: bytes, k: int):
        self.uids, self.ids, self.k = np.frombuffer(uids, np.int64), np.frombuffer(ids, np.int64), k
        self.vs = _vectors(vs, len(self.uids))
        self.norm = np.sqrt((self.vs ** 2).sum(1))
        self.floor = np.full(len(self.uids), -np.inf)
        self.row, self.found, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.products = 0          # computed exactly

    def meet(self, top: float, uids: np.ndarray, ids: np.ndarray, vs: np.ndarray, rotation: np.ndarray) -> None:
        """A block of vectors no longer than ``top``."""
        with np.errstate(over="ignore", invalid="ignore"):
            open_ = ~(self.norm * top * (1 + 1e-9) + 1e-6 < self.floor)
        if not open_.any():
            return
        at = np.flatnonzero(open_)
        row, col, score = search(self.vs[at], self.uids[at], self.floor[at], vs, uids, rotation)
        self.products += len(row)
        row, found, score = (np.concatenate(x) for x in ((self.row, at[row]), (self.found, ids[col]), (self.score, score)))
        order = np.lexsort((found, np.invert(score), row))      # ~x falls as x grows, without overflow
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order, full = order[rank < self.k], row[rank == self.k - 1]
        self.floor[full] = score[order[rank[rank < self.k] == self.k - 1]]
        self.row, self.found, self.score = row[rank < self.k], found[order], score[order]

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.uids[self.row]), pa.array(self.ids[self.row]), pa.array(self.found),
                                           pa.array(self.score)], ["uid", "query_id", "vec_id", "score"])


def _met(rotation: np.ndarray, k: int):
    """Rows sorted by (grp, rng, side, falling length): a group of queries, then
    the blocks of a range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, group = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["grp"], row["rng"]) != cell:
                    if group is not None:
                        yield group.result()
                    cell, group = (row["grp"], row["rng"]), None
                if row["side"] == 0:
                    group = Group(row["uids"], row["ids"], row["vs"], k)
                elif group is not None:
                    uids = np.frombuffer(row["uids"], np.int64)
                    group.meet(row["top"], uids, np.frombuffer(row["ids"], np.int64), _vectors(row["vs"], len(uids)), rotation)
        if group is not None:
            yield group.result()
    return run


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k greatest integer inner products
    of every row of ``vectors`` (vec_id, embedding) that ``is_query`` marks."""
    v = small_batches(vectors).select(F.col("vec_id").cast("long"), F.coalesce(is_query, F.lit(False)).alias("asks"), "embedding")
    v = v.where("vec_id is not null")
    size = max(1, v.agg(F.max(F.size("embedding"))).first()[0] or 1)
    rows = v.mapInArrow(_integers(scale, size), "id long, asks boolean, v binary, norm double")
    # Written once, so that every later use sees the same numbers of rows.
    rows = durable(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    sample = rows.select("v").orderBy(F.xxhash64("id"), "v").limit(SAMPLE).collect()
    rotation = np.eye(size)
    if len(sample) >= 2:
        m = np.stack([np.frombuffer(r.v, np.float64) for r in sample])
        rotation = np.linalg.svd(m / max(1.0, float(np.abs(m).max())), full_matrices=True)[2].T
    schema = "block long, top double, uids binary, ids binary, vs binary"

    def packed(df: DataFrame, most: int, name: str) -> DataFrame:
        parts = max(1, -(-df.count() // (8 * most)))
        df = df.select("uid", "id", "v", "norm").repartitionByRange(parts, F.desc("norm"), "uid")
        return durable(df.sortWithinPartitions(F.desc("norm"), "uid").mapInArrow(_packed(most), schema), name)

    blocks, groups = packed(rows, BLOCK, "blocks"), packed(rows.where("asks"), QUERIES, "queries")
    ranges = max(1, -(-blocks.count() // BLOCKS))
    # Blocks in the order of length take turns, by their number within and across partitions.
    turn = F.pmod(F.col("block").bitwiseAND(F.lit(2 ** 32 - 1)) + F.shiftright("block", 32) * 8, F.lit(ranges))
    cols = ["top", "uids", "ids", "vs"]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long")))
    left = groups.select(F.col("block").alias("grp"), every.alias("rng"), F.lit(0).alias("side"), *cols)
    names = groups.agg(F.sort_array(F.collect_list("block"))).first()[0]      # one number a group of queries
    right = blocks.select(F.explode(F.lit(names).cast("array<long>")).alias("grp"), turn.cast("long").alias("rng"),
                          F.lit(1).alias("side"), *cols)
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cells = left.unionByName(right).repartition(max(1, min(16 * width, len(names) * ranges)), "grp", "rng")
    cells = cells.sortWithinPartitions("grp", "rng", "side", F.desc("top"))
    found = cells.mapInArrow(_met(rotation, k), "uid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
