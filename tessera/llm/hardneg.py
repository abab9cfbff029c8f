"""Hard negatives of stated anchors by slot-decomposed selection.

A row's score is its exact integer inner product with the anchor.  An anchor's
positives are its best rows of the same label.  Each positive asks for the best
rows of other labels whose score lies between ``low`` and ``high`` percent of
its own, so an anchor has several overlapping windows of scores.

1. Anchors meet the groups of rows that share a label with them; tasks keep
   the best few per anchor, which are merged into its positives.
2. The upper limits of an anchor's windows, in falling order, split the scores
   into disjoint slots.  Anchors meet all groups of rows whose longest vector
   can reach the least limit (Cauchy-Schwarz); each task keeps, per anchor and
   slot, only the best k rows of other labels.
3. The slots' lists are merged from the lowest slot upwards: the best k below a
   slot's upper limit are its own list followed by what the slots below it
   have.  One such descending suffix serves every window with that upper
   limit; its lower limit cuts the list.

Rows and anchors are dealt into groups in the order of their labels.  A cell is
a group of anchors with a group of rows: its anchors come first and stay in the
task, its rows stream past in blocks, so a cell's memory does not depend on
the rows, nor on how many share a label.

Defined results.  Rows with a null vec_id or label, and vectors that are null,
empty or hold a null or non-finite component, take no part.  Shorter vectors
count as padded with zeros.  A repeated row counts each time, as anchor and as
candidate; only an anchor's own row is never its positive.  Ties go to the
smaller vec_id.  Scores beyond the range of a long are cut to it.  Anchors
without a positive, and windows without a row, give no rows.  Vectors of any
width are held whole, a block holds fewer of wider ones.  Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import durable, small_batches

BLOCK_BYTES = 512 * 1024     # of the vectors of one block
ANCHORS = 4096               # of a group of anchors, about
ROWS = 4096                  # of a group of rows, about
EXACT = float(2 ** 53)
LEAST, MOST = -2 ** 63, 2 ** 63 - 1


def _integers(scale: float, size: int):
    """Whole-number vectors of the rows that take part, with their lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, vs, norms = [], [], []
            for k, x in enumerate(batch.column(batch.schema.get_field_index("embedding")).to_pylist()):
                if not x or any(c is None for c in x):
                    continue
                v = np.zeros(size)
                with np.errstate(over="ignore", invalid="ignore"):
                    v[:len(x)] = np.floor(scale * np.array(x, np.float64))
                    if np.isfinite(v).all():
                        kept.append(k)
                        vs.append(v.tobytes())
                        norms.append(float(np.sqrt(v @ v)))
            b = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), b.column("asks"), pa.array(vs, pa.binary()),
                 pa.array(norms, pa.float64())], ["vec_id", "label", "asks", "v", "norm"])
    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all rows of ``b``."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in r] for r in a.tolist()], [[int(x) for x in r] for r in b.tolist()]
    return np.array([[min(max(sum(x * y for x, y in zip(r, s)), LEAST), MOST) for s in whole[1]]
                     for r in whole[0]], np.int64)


def best(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each key, in order."""
    order = np.lexsort((ids, np.invert(score), key))     # ~x falls as x grows, without overflow
    s = key[order]
    return order[np.arange(len(s)) - np.searchsorted(s, s) < k]


def _packed(most: int):
    """The rows of a partition, sorted by group, as blocks of at most ``most``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block():
            grp, uid, ids, labels, vs, norms, extra = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array([grp[0]], pa.int64()), pa.array([np.array(uid, np.int64).tobytes()], pa.binary()),
                 pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                 pa.array([np.array(labels, np.int64).tobytes()], pa.binary()), pa.array([b"".join(vs)], pa.binary()),
                 pa.array([max(norms)], pa.float64()), pa.array([b"".join(extra)], pa.binary())],
                ["grp", "uid", "ids", "labels", "vs", "top", "limits"])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[0][0] != row[0] or len(held) >= most):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()
    return run


BLOCKS = "grp long, uid binary, ids binary, labels binary, vs binary, top double, limits binary"


class _Anchors:
    """The anchors of a cell, and what it has kept for them."""

    def __init__(self):
        self.parts: list[dict] = []
        self.ready = False

    def add(self, row: dict) -> None:
        self.parts.append(row)

    def settle(self, slots: int) -> None:
        if self.ready:
            return
        ints = lambda c: np.concatenate([np.frombuffer(p[c], np.int64) for p in self.parts])
        self.uid, self.ids, self.labels = ints("uid"), ints("ids"), ints("labels")
        self.vs = np.concatenate([np.frombuffer(p["vs"], np.float64) for p in self.parts]).reshape(len(self.uid), -1)
        if slots:
            self.limits = ints("limits").reshape(len(self.uid), slots + 1)
        n = len(self.uid) * max(1, slots)
        self.floor = np.full(n, LEAST)
        self.key, self.score, self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts, self.ready = [], True

    def keep(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> None:
        """Merge new entries into the k best of each key and raise its floor."""
        key, score, ids = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.found, ids)))
        at = best(key, score, ids, k)
        self.key, self.score, self.found = key[at], score[at], ids[at]
        full = np.flatnonzero(np.arange(len(at)) - np.searchsorted(self.key, self.key) == k - 1)
        self.floor[self.key[full]] = self.score[full]


def _cells(slots: int, k: int):
    """Per anchor (and slot) of each cell the k best rows.  Without slots the
    rows of the anchor's own label count, with slots those of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, _Anchors()

        def out():
            held.settle(slots)
            a = held.key // max(1, slots)
            return pa.RecordBatch.from_arrays(
                [pa.array(held.uid[a]), pa.array((held.key % max(1, slots)).astype(np.int32)), pa.array(held.score),
                 pa.array(held.found)], ["anchor", "slot", "score", "vec_id"])
        for batch in batches:
            for row in batch.to_pylist():
                if (row["a"], row["c"]) != cell:
                    if cell is not None:
                        yield out()
                    cell, held = (row["a"], row["c"]), _Anchors()
                if row["side"] == 0:
                    held.add(row)
                    continue
                held.settle(slots)
                if not len(held.uid):
                    continue
                uid, ids, labels = (np.frombuffer(row[c], np.int64) for c in ("uid", "ids", "labels"))
                vs = np.frombuffer(row["vs"], np.float64).reshape(len(uid), -1)
                for lo in range(0, len(held.uid), 512):      # bounds the matrix of products
                    hi = min(lo + 512, len(held.uid))
                    s = products(held.vs[lo:hi], vs)
                    if slots:
                        lim = held.limits[lo:hi]
                        ok = (labels[None, :] != held.labels[lo:hi, None]) & (s <= lim[:, :1]) & (s >= lim[:, -1:])
                        r, c = np.nonzero(ok)
                        x = s[r, c]
                        slot = (x[:, None] <= lim[r, :-1]).sum(1) - 1      # the last limit it stays below
                        key = (r + lo) * slots + slot
                    else:
                        ok = labels[None, :] == held.labels[lo:hi, None]
                        ok &= (uid[None, :] != held.uid[lo:hi, None]) & (s >= held.floor[lo:hi, None])
                        r, c = np.nonzero(ok)
                        x, key = s[r, c], r + lo
                    good = x >= held.floor[key]
                    held.keep(key[good], x[good], ids[c[good]], k)
        if cell is not None:
            yield out()
    return run


def _meet(pairs: DataFrame, anchors: DataFrame, rows: DataFrame, slots: int, k: int) -> DataFrame:
    """The cells (a, c) of ``pairs`` worked off: each group of blocks goes once
    to every cell it is part of, anchors in front."""
    cols = ["uid", "ids", "labels", "vs", "limits"]
    pairs = durable(pairs, "cells")
    left = pairs.join(anchors.withColumnRenamed("grp", "a"), "a").select("a", "c", F.lit(0).alias("side"), *cols)
    right = pairs.join(rows.withColumnRenamed("grp", "c"), "c").select("a", "c", F.lit(1).alias("side"), *cols)
    n = pairs.count()
    width = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cells = left.unionByName(right).repartition(max(1, min(n, 16 * width)), "a", "c")
    cells = cells.sortWithinPartitions("a", "c", "side")
    return cells.mapInArrow(_cells(slots, k), "anchor long, slot int, score long, vec_id long")


def _windows(low: int, high: int, slots: int):
    """The limits of an anchor's windows from its positives: the falling,
    different upper limits, filled up with the last, then the least lower one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, limits, needs = [], [], []
            for uid, scores in zip(*(c.to_pylist() for c in batch.columns)):
                spans = [(-(-low * s // 100), high * s // 100) for s in scores]
                spans = [(max(a, LEAST), b) for a, b in spans if a <= b]
                if not spans:
                    continue
                upper = sorted({min(b, MOST) for _, b in spans}, reverse=True)
                least = min(a for a, _ in spans)
                # An unused slot lies below every score that counts.
                upper += [least - 1 if least > LEAST else LEAST] * (slots - len(upper))
                uids.append(uid)
                limits.append(np.array([*upper, least], np.int64).tobytes())
                needs.append(float(least))
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(limits, pa.binary()),
                                              pa.array(needs, pa.float64())], ["uid", "limits", "need"])
    return run


def _merged(low: int, high: int, k: int):
    """Descending suffix merge of an anchor's slots, and its windows' rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        for batch in batches:
            out: list[tuple] = []
            for anchor, positives, found in zip(*(c.to_pylist() for c in batch.columns)):
                slots: dict[int, list] = {}
                for f in found:
                    slots.setdefault(f["slot"], []).append((-f["score"], f["vec_id"]))
                below, suffix = [], {}
                for s in sorted(slots, reverse=True):         # the lowest scores first
                    below = suffix[s] = (sorted(slots[s]) + below)[:k]
                for p in positives:
                    a, b = -(-low * p["score"] // 100), high * p["score"] // 100
                    s = min((s for s, x in suffix.items() if -x[0][0] <= b), default=None)
                    fit = [x for x in suffix.get(s, ()) if -x[0] >= a]
                    out += [(anchor, p["vec_id"], r + 1, i, p["score"], -x) for r, (x, i) in enumerate(fit)]
            cols = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)
    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, k: int = 3,
                   scale: float = 256.0, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score: for every row of ``vectors`` (vec_id, embedding, label)
    that ``is_anchor`` marks, and each of its ``positives`` best rows of the
    same label, the ``k`` best rows of other labels whose score lies between
    ``low`` and ``high`` percent of the positive's."""
    v = small_batches(vectors).select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", (F.col("label") if label is None else label)
        .cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    v = v.where("vec_id is not null and label is not null")
    size = max(1, v.agg(F.max(F.size("embedding"))).first()[0] or 1)
    rows = v.mapInArrow(_integers(scale, size), "vec_id long, label long, asks boolean, v binary, norm double")
    # Written once, so that every later use sees the same numbers of rows.
    rows = durable(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    n, asked = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    most = max(1, BLOCK_BYTES // (8 * size))

    def grouped(df: DataFrame, count: int, per: int, name: str) -> DataFrame:
        """Groups of about ``per`` rows in the order of the labels, as blocks."""
        parts = max(1, -(-count // per))
        dealt = df.repartitionByRange(parts, "label", "uid")
        # Never more groups than that, even if the session deals out more partitions.
        dealt = dealt.withColumn("grp", F.pmod(F.spark_partition_id(), F.lit(parts)).cast("long"))
        return durable(dealt.select("grp", "uid", "vec_id", "label", "v", "norm", "limits")
                       .mapInArrow(_packed(most), BLOCKS), name)

    plain = rows.withColumn("limits", F.lit(b"").cast("binary"))
    blocks = grouped(plain, n, ROWS, "row-blocks")
    anchors = grouped(plain.where("asks"), asked, ANCHORS, "anchor-blocks")
    labels = lambda b, name: b.select("grp", "labels").mapInArrow(_labels, "grp long, label long").distinct() \
        .withColumnRenamed("grp", name)
    same = labels(anchors, "a").join(labels(blocks, "c"), "label").select("a", "c").distinct()
    near = _meet(same, anchors, blocks, 0, positives)
    order = W.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    near = near.select("*", F.row_number().over(order).alias("r")).where(F.col("r") <= positives)
    pos = durable(near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("r", "score", "vec_id"))).alias("p")),
                  "positives")
    windows = pos.select("anchor", F.col("p.score").alias("s")).mapInArrow(
        _windows(low, high, positives), "uid long, limits binary, need double")
    windows = durable(windows, "windows")
    with_limits = rows.join(windows, "uid")
    reach = with_limits.agg(F.count("*")).first()[0]
    anchors = grouped(with_limits, reach, ANCHORS, "anchor-blocks")
    # A group of anchors needs the groups whose longest vector can reach the
    # least of its limits: |x| >= limit / |anchor|.
    need = _needs(anchors)
    tops = blocks.groupBy("grp").agg(F.max("top").alias("top")).withColumnRenamed("grp", "c")
    last = blocks.agg(F.max("grp")).first()[0] or 0
    pairs = need.select(F.col("grp").alias("a"), "need", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("c"))
    pairs = pairs.withColumn("c", F.col("c").cast("long")).join(tops, "c").where(
        F.col("top") * (1 + 1e-9) >= F.col("need")).select("a", "c")
    found = _meet(pairs, anchors, blocks, positives, k)
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    found = found.select("*", F.row_number().over(order).alias("r")).where(F.col("r") <= k)
    found = found.groupBy("anchor").agg(F.collect_list(F.struct("slot", "score", "vec_id")).alias("found"))
    names = rows.where("asks").select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    both = pos.join(found, "anchor").join(names, "anchor").select("anchor_id", "p", "found")
    return both.mapInArrow(_merged(low, high, k), "anchor_id long, positive_id long, rank int, negative_id long, "
                                                  "positive_score long, negative_score long")


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different labels of each block."""
    for batch in batches:
        for grp, labels in zip(*(c.to_pylist() for c in batch.columns)):
            found = np.unique(np.frombuffer(labels, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), grp)), pa.array(found)], ["grp", "label"])


def _needs(anchors: DataFrame) -> DataFrame:
    """Per group of anchors the length that a vector needs to matter to any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, uid, limits, vs in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(uid) // 8
                v = np.frombuffer(vs, np.float64).reshape(n, -1)
                with np.errstate(over="ignore"):
                    norm = np.sqrt((v * v).sum(1))
                least = np.frombuffer(limits, np.int64).reshape(n, -1)[:, -1].astype(np.float64)
                need = np.where(least > 0, least / np.maximum(norm, 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([float(need.min())])], ["grp", "need"])
    return anchors.select("grp", "uid", "limits", "vs").mapInArrow(run, "grp long, need double") \
        .groupBy("grp").agg(F.min("need").alias("need"))
