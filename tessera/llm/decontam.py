"""Benchmark decontamination by spaced-seed hashing.

Fixed masks lay over a window of ten tokens and ignore three of them each, so
a passage still meets its benchmark item when some tokens were replaced.
Window hashes of the items are joined with those of all documents; around each
hit the two token sequences are compared along the hit's diagonal, and the
best stretch that tolerates replaced tokens decides.

The documents are read once: a window's hash leaves its task only if a filter
of fixed size (``FILTER_BITS``), made of the benchmark's hashes, lets it
through.  What is left is joined with the benchmark's hashes in Spark, and the
texts of each joined pair are compared in cells of bounded size.  Equal texts,
of documents and of items, are compared once.

Defined results.  Tokens are runs of letters, digits and underscores, lower
case.  Null, empty and tokenless texts overlap with nothing.  An item shorter
than the window must occur whole and unchanged if it has at least
``shortest`` tokens, and is left alone below.  Rows without item_id or doc_id
take part and carry their null.  Repeated items each give their own row, a
repeated document row too.  Very long texts are treated whole; a text is held
with at most a cell's items (or one, if longer).  Of equally good stretches with
an item the shortest, then the first in the document counts, then the first in
the item.  Bytes that are no UTF-8 count as U+FFFD.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, small_batches, strings
from tessera.plans.skew import salt_join
from tessera.session import apply_library_conf

# Fixed masks: the token offsets they look at.
MASKS = ((0, 1, 3, 4, 6, 8, 9), (0, 2, 3, 5, 7, 8, 9), (0, 1, 2, 5, 6, 7, 9), (0, 2, 4, 5, 6, 8, 9))
WINDOW = 10
SHORTEST = 5
MATCHED = 12             # matching tokens of a stretch that make a document leak,
SHARE = 0.6              # or this share of a shorter item
DENSITY = 0.75           # matching share of a stretch, at least
GAP = 3                  # replaced tokens in a row that a stretch may cross
BLOCK = 250_000        # tokens of items that meet a document in one cell
FILTER_BITS = 26       # 2^26 bits: 8 MB
HELD_HITS = 1 << 20    # hits compared at a time
CACHED_WORDS = 200_000
TOKEN = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)
_BUCKET = 4096 * 8       # bits of a bitmap of Spark's aggregation


class Tokens(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        found = TOKEN.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def windows(ids: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """Hash of the masked tokens of each window."""
    n = max(len(ids) - WINDOW + 1, 0)
    h = np.full(n, salt, np.uint64)
    for o in mask:
        h ^= ids[o:o + n]
        h *= _P
        h ^= h >> np.uint64(29)
    return h


def stretch(same: np.ndarray, gap: int = GAP, density: float = DENSITY) -> tuple[int, int, int]:
    """(first, last + 1, matches) of the stretch with most matches that begins
    and ends with a match, crosses at most ``gap`` mismatches in a row, and is
    dense enough; its ends are cut back until it is."""
    at = np.flatnonzero(same)
    best = (0, 0, 0)
    for part in np.split(at, np.flatnonzero(np.diff(at) > gap + 1) + 1):
        lo, hi = 0, len(part)
        while hi - lo > best[2]:
            if hi - lo >= density * (part[hi - 1] + 1 - part[lo]):
                best = (int(part[lo]), int(part[hi - 1]) + 1, hi - lo)
                break
            left, right = part[lo + 1] - part[lo], part[hi - 1] - part[hi - 2]
            lo, hi = (lo + 1, hi) if left >= right else (lo, hi - 1)
    return best


class Items:
    """Benchmark items of a cell: their tokens, and window hashes with the
    place each comes from."""

    def __init__(self, rows: list[tuple[int, str | None]], shortest: int = SHORTEST):
        tokens = Tokens()
        self.ids = [r[0] for r in rows]
        self.tokens = [tokens.of(r[1]) for r in rows]
        self.lengths = sorted({len(t) for t in self.tokens if shortest <= len(t) < WINDOW})
        self.tables = [self._table(hash_of, [hash_of(t) if n is None or len(t) == n else t[:0] for t in self.tokens])
                       for n, hash_of in hashes(self.lengths)]

    @staticmethod
    def _table(hash_of, parts):
        h = np.concatenate([*parts, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        pos = np.concatenate([*(np.arange(len(p)) for p in parts), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        return hash_of, h[order], item[order], pos[order]

    def hits(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(item, document place less item place) of every equal window, once each."""
        longest = max(map(len, self.tokens), default=0)
        width = len(ids) + longest + 1
        found = np.zeros(0, np.int64)
        for hash_of, h, item, pos in self.tables:
            own = hash_of(ids)
            lo, n = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            n -= lo
            at = np.flatnonzero(n)
            ends = np.cumsum(n[at])
            # Equal tokens meet very often on few diagonals: in parts, each reduced to its diagonals.
            for part in np.split(at, np.searchsorted(ends, np.arange(HELD_HITS, ends[-1] if len(ends) else 0, HELD_HITS))):
                many = n[part]
                k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[part], many)
                key = item[k] * width + (np.repeat(part, many) - pos[k] + longest)
                found = np.union1d(found, key)
        return [(k, d - longest) for k, d in zip((found // width).tolist(), (found % width).tolist())]

    def overlaps(self, ids: np.ndarray):
        """Best verified stretch per item: (item, start in the document, start
        in the item, length, matching tokens)."""
        best: dict[int, tuple] = {}
        for item, d in self.hits(ids):
            t = self.tokens[item]
            lo, hi = max(0, -d), min(len(t), len(ids) - d)
            need = min(MATCHED, max(SHORTEST, SHARE * len(t))) if len(t) >= WINDOW else len(t)
            same = t[lo:hi] == ids[lo + d:hi + d]
            # A stretch has no more matches than its diagonal.
            if np.count_nonzero(same) < max(need, best[item][0][0] if item in best else 0):
                continue
            a, b, m = stretch(same)
            if m >= need:
                key = (m, -(b - a), -(lo + a + d), -(lo + a))
                if item not in best or key > best[item][0]:
                    best[item] = (key, lo + a + d, lo + a, b - a, m)
        return [(k, *v[1:]) for k, v in sorted(best.items())]


def whole(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n tokens."""
    m = max(len(ids) - n + 1, 0)
    h = np.full(m, 1000 + n, np.uint64)
    for o in range(n):
        h ^= ids[o:o + m]
        h *= _P
        h ^= h >> np.uint64(29)
    return h


def hashes(lengths: list[int]):
    """(length of the items it is for, or None; function from tokens to the
    hashes of their windows) of every mask and every length of short items."""
    masked = [(None, lambda t, m=m, k=k: windows(t, m, k)) for k, m in enumerate(MASKS)]
    return masked + [(n, lambda t, n=n: whole(t, n)) for n in lengths]


def _item_windows(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                t = tokens.of(text)
                short = [len(t)] if shortest <= len(t) < WINDOW else []
                h = np.unique(np.concatenate([f(t) for _, f in hashes(short)])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.string()), pa.array(h),
                                                  pa.array(np.full(len(h), len(t), np.int32))], ["ikey", "h", "n"])
    return run


def bits_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in the filter."""
    return h >> np.uint64(64 - FILTER_BITS), (h >> np.uint64(8)) & np.uint64((1 << FILTER_BITS) - 1)


def hash_filter(windows_of_items: DataFrame) -> np.ndarray:
    """A bitmap of 2^FILTER_BITS bits with two of each hash, merged in Spark
    from parts of 4 KB; its size doesn't grow with the benchmark."""
    h = F.col("h")
    low = F.shiftrightunsigned(h, 8).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = windows_of_items.select(F.explode(F.array(F.shiftrightunsigned(h, 64 - FILTER_BITS), low)).alias("b"))
    parts = (bit.groupBy(F.expr(f"b div {_BUCKET}").alias("at"))
             .agg(F.bitmap_construct_agg(F.pmod("b", F.lit(_BUCKET))).alias("bits")))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r["at"] * _BUCKET // 8:(r["at"] + 1) * _BUCKET // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _hopeful(bitmap, lengths: list[int]):
    """Documents with a window that passes the filter: their different hashes that do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, tokens = bitmap.value, Tokens()
        for batch in batches:
            docs, texts, found = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                t = tokens.of(text)
                mine = []
                for _, hash_of in hashes(lengths):
                    h = hash_of(t)
                    for b in (0, 1):
                        at = bits_of(h)[b]
                        h = h[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).view(bool)]
                        if not len(h):
                            break
                    else:
                        mine.append(h)
                if mine:
                    docs.append(doc)
                    texts.append(text)
                    found.append(np.unique(np.concatenate(mine)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.string()),
                                              pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text", "hs"])
    return run


PLACES = "dkey string, ikey string, doc_start int, item_start int, length int, matched int, item_tokens int"


def _verify(shortest: int):
    """A cell: one text and its items."""
    def run(key, texts: pa.Table, items: pa.Table) -> pa.Table:
        t = Tokens()
        rows = []
        if texts.num_rows:
            found = Items(sorted(zip(items["ikey"].to_pylist(), strings(items["itext"]))), shortest)
            dkey = texts["dkey"][0].as_py()
            rows = [(dkey, found.ids[k], *place, len(found.tokens[k]))
                    for k, *place in found.overlaps(t.of(strings(texts["text"])[0]))]
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.string()] * 2 + [pa.int32()] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                    [x.split()[0] for x in PLACES.split(", ")])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, cell: int = BLOCK, shortest: int = SHORTEST) -> DataFrame:
    """One row per document and benchmark item that it repeats: where, how
    long (in tokens), and how many tokens match.  ``cell``: tokens of items
    that a text meets at a time."""
    spark = docs.sparkSession
    apply_library_conf(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = durable(items.where("text is not null").withColumn("ikey", F.md5("text")), "items")
    item_texts = durable(items.groupBy("ikey").agg(F.first("text").alias("itext")), "item-texts")
    asked = durable(item_texts.mapInArrow(_item_windows(shortest), "ikey string, h long, n int"), "item-windows")
    lengths = sorted(r.n for r in asked.where(F.col("n") < WINDOW).select("n").distinct().collect())
    bitmap = spark.sparkContext.broadcast(hash_filter(asked))

    d = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hopeful = d.mapInArrow(_hopeful(bitmap, lengths), "doc_id long, text string, hs array<long>")
    hopeful = durable(hopeful.withColumn("dkey", F.md5("text")), "hopeful")
    texts = durable(hopeful.groupBy("dkey").agg(F.first("text").alias("text"), F.first("hs").alias("hs")), "texts")

    x, y, keys = salt_join(texts.select("dkey", F.explode("hs").alias("h")), asked.select("ikey", "h"),
                           "h", ["dkey"], ["ikey"])
    pairs = durable(x.join(y, keys).select("dkey", "ikey").distinct(), "pairs")
    sized = pairs.join(asked.groupBy("ikey").agg(F.max("n").alias("n")), "ikey")
    cells = sized.groupBy("dkey").agg(F.ceil(F.sum("n") / F.lit(cell)).alias("cells"))
    dealt = durable(pairs.join(cells, "dkey").select(
        "dkey", "ikey", F.pmod(F.xxhash64("ikey"), F.col("cells")).alias("cell")), "cells")
    wanted = dealt.select(F.col("dkey").alias("key"), F.col("cell").alias("part")).distinct()
    left = texts.join(wanted, F.col("dkey") == F.col("key")).select("dkey", "part", "text")
    right = dealt.join(item_texts, "ikey")
    places = (left.groupBy("dkey", "part").cogroup(right.groupBy("dkey", "cell"))
              .applyInArrow(_verify(shortest), PLACES))
    places = durable(places, "places")

    x, y, keys = salt_join(places, items.select("ikey", "item_id"), "ikey", ["dkey"], ["item_id"])
    named = durable(x.join(y, keys).drop(*keys), "leaks")
    x, y, keys = salt_join(named, hopeful.select("dkey", "doc_id"), "dkey", ["item_id"], ["doc_id"])
    return x.join(y, keys).select("doc_id", "item_id", "doc_start", "item_start", "length", "matched", "item_tokens")
