"""Exact substring dedup by merged Burrows-Wheeler transforms.

Every byte goes that a string of ``length`` bytes covers which also starts in a
document with a smaller doc_id; strings are judged on the input.

1. Documents are written once, in shards of bounded size, bucketed by shard, so
   that no later step shuffles a text.
2. Which parts of a shard can matter: every window of ``length`` bytes is named
   by the smallest hash of its grams of GRAM bytes, which equal windows share.
   Shards send the different hashes, four bytes each, to buckets; those found
   in one document only drop out.
3. Windows in a row with the same smallest gram form one short string, from
   the first byte of the first to the last byte of the last.  A shard sorts the
   suffixes of its strings once per bucket and sends the Burrows-Wheeler
   transform of each bucket, equal strings once.
4. A bucket merges its shards' transforms without sorting suffixes again: the
   interleave of the rows that begin ``length`` bytes behind a window's start is
   refined by stable sorts of the preceding symbols, two or four symbols a round,
   each round stepping to the suffix that begins with them.  Rows that stay together
   over ``length`` symbols are an interval of a common prefix of that length;
   its smallest doc_id decides over all its windows.
5. Shards get back the smallest doc_ids, mark their bytes and cut them out.

A name that occurs very often (HOT) would fill one bucket: its windows are then
sent one by one, each to the bucket of its own hash.

Defined results.  A null text counts as empty, and like any text of fewer than
``length`` bytes is kept whole.  A null doc_id comes after all others.  A row
that occurs twice is one document and is returned twice; texts of one doc_id
never remove each other.  Very long texts are worked on whole.  Texts are bytes:
what is left may end inside a character, and bytes that are no UTF-8 are kept.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable
from tessera.session import shared_dir

LENGTH = 50
GRAM = 20
PARTS = 8                   # shards of an input split
BUCKET_BYTES = 2 << 20      # of text a bucket stands for
HOT = 1 << 16               # windows' runs of one name that are still sent as strings
CHUNK = 1 << 16             # positions worked on at a time: few enough for a core's cache
POSITION = np.uint64((1 << 21) - 1)
RANK_BITS = 21              # of a place, a rank and a group in one number
LAST = 2 ** 63 - 1          # stands for a null doc_id
_M = np.uint64(0x9E3779B97F4A7C15)
# Masks of the first 0 to 7 of seven bytes.
_HEADS = np.array([(1 << 56) - (1 << 8 * (7 - k)) for k in range(8)], np.uint64)
# Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA0761D6478BD642F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def gram_hashes(buf: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A hash of the ``n`` bytes from each position on."""
    if len(buf) < n:
        return np.zeros(0, np.uint64)
    have, width, out, done = _BYTES[buf], 1, None, 0
    while True:
        if n & width:      # append the next ``width`` bytes
            part = have[done:]
            out = part if out is None else out[:len(part)] * np.uint64(pow(int(_M), width, 2 ** 64)) + part[:len(out)]
            done += width
        if 2 * width > n:
            return _mix(out[:len(buf) - n + 1])
        have = have[:-width] * np.uint64(pow(int(_M), width, 2 ** 64)) + have[width:]
        width *= 2


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` values in a row."""
    size = 1
    while 2 * size <= n:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[:len(x) - (n - size)], x[n - size:]) if size < n else x


def runs_of(buf: np.ndarray, ends: np.ndarray, length: int):
    """(first, last, name) of the runs of windows that share their smallest
    gram; no window crosses one of the ``ends`` of the documents."""
    out = []
    total = len(buf) - length + 1
    wide = length - GRAM + 1
    # Windows that begin in the last bytes of a document cross its end.
    begin = np.append(0, ends[:-1])
    short = np.maximum(begin, ends - length + 1)
    inside = np.ones(len(buf) + 1, bool)
    n = ends - short
    inside[np.repeat(short, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = False
    for lo in range(0, max(0, total), CHUNK):
        part = buf[lo:min(lo + CHUNK, total) + length - 1]
        h = gram_hashes(part)
        spot = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
        at = (_least(spot, wide) & POSITION).astype(np.int64)
        p = np.flatnonzero(inside[lo:lo + len(at)])
        at = at[p]
        p += lo
        if not len(p):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)]))
        out.append((p[new], p[np.append(new[1:], len(p)) - 1], _mix(h[at[new]] + _M)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


class Shard:
    """The different documents of a shard, in the order of doc_id and hash."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks()
        doc = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
        key = table.column("key").to_numpy()
        texts = table.column("text").to_pylist()
        order = np.lexsort((key, doc))
        d, k = doc[order], key[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]) if len(d) else np.zeros(0, bool)
        self.row_of = np.empty(len(d), np.int64)
        self.row_of[order] = np.cumsum(new) - 1           # document of each row of the table
        first = order[new]
        self.ids = ids
        self.doc = doc[first]
        self.texts = [texts[i] for i in first.tolist()]
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.buf = np.frombuffer(b"".join(self.texts), np.uint8)

    def runs(self, length: int):
        return runs_of(self.buf, self.ends, length)

    def doc_at(self, positions: np.ndarray) -> np.ndarray:
        return self.doc[np.searchsorted(self.ends, positions, side="right")]


def _place(name: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and upper half of a name in one number."""
    return (name % np.uint64(buckets)) << np.uint64(32) | (name >> np.uint64(32))


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for a, b in zip(cut, np.append(cut[1:], len(bucket)).tolist() if len(bucket) else []):
        yield int(bucket[a]), int(a), int(b)


def _names(length: int, buckets: int):
    """Per bucket the different names of a shard, how often each occurs (up to
    32,767) and, in the upper bit, whether in several documents."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        s = Shard(table)
        first, _, name = s.runs(length)
        place, doc = _place(name, buckets), s.doc_at(first)
        order = np.argsort(place, kind="stable")
        place, doc = place[order], doc[order]
        rows: list[list] = [[], [], [], []]
        if len(place):
            at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            n = np.minimum(np.diff(np.append(at, len(place))), 32767).astype(np.uint16)
            n |= (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)).astype(np.uint16) << np.uint16(15)
            place = place[at]
            half = place.astype(np.uint32)
            for b, i, j in _slices((place >> np.uint64(32)).astype(np.int64)):
                for c, x in zip(rows, (b, key[0].as_py(), half[i:j].tobytes(), n[i:j].tobytes())):
                    c.append(x)
        return pa.table([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()),
                         pa.array(rows[3], pa.binary())], ["bucket", "shard", "names", "counts"])
    return run


def _joined(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a binary column end to end, and their lengths."""
    parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.array([len(p) for p in parts], np.int64)


def _shared(hot_from: int):
    """For each shard its names that several documents hold; ``counts`` says
    which of them occur ``hot_from`` times or more."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _of_several(key, table, hot_from)
    return run


def _of_several(key: tuple, table: pa.Table, hot_from: int) -> pa.Table:
    name, sizes = _joined(table, "names", np.uint32)
    n, _ = _joined(table, "counts", np.uint16)
    order = np.argsort(name, kind="stable")
    x = name[order]
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    size = np.diff(np.append(at, len(x)))
    often = np.add.reduceat((n & np.uint16(32767)).astype(np.int64)[order], at)
    several = (size > 1) | (np.maximum.reduceat(n[order], at) > 32767)
    keep, hot = np.zeros(len(name), bool), np.zeros(len(name), np.uint8)
    keep[order] = np.repeat(several, size)
    hot[order] = np.repeat((often >= hot_from).astype(np.uint8), size)
    rows: list[list] = [[], [], [], []]
    lo = 0
    for shard, m in zip(table.column("shard").to_pylist(), sizes.tolist()):
        k = keep[lo:lo + m]
        if k.any():
            for c, v in zip(rows, (shard, key[0].as_py(), name[lo:lo + m][k].tobytes(), hot[lo:lo + m][k].tobytes())):
                c.append(v)
        lo += m
    return pa.table([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()),
                     pa.array(rows[3], pa.binary())], ["shard", "bucket", "names", "counts"])


class Strings:
    """The short strings of a shard that its shared names ask for.  ``which``
    is the string of each occurrence, ``first`` where the occurrence begins."""

    def __init__(self, s: Shard, found: pa.Table, length: int, buckets: int):
        first, last, name = s.runs(length)
        place = _place(name, buckets)
        half, sizes = _joined(found, "names", np.uint32)
        hot, _ = _joined(found, "counts", np.uint8)
        known = np.repeat(found.column("bucket").to_numpy().astype(np.uint64), sizes) << np.uint64(32) | half
        order = np.argsort(known)
        known, hot = known[order], hot[order].astype(bool)
        if not len(known) or not len(place):
            at, ok = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        else:
            at = np.minimum(np.searchsorted(known, place), len(known) - 1)
            ok = known[at] == place
        first, last, name, at = first[ok], last[ok], name[ok], at[ok]
        if len(at) and (single := hot[at]).any():        # windows one by one
            n = last[single] - first[single] + 1
            p = np.repeat(first[single], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = self._marks(s.buf, p, length)
            first, last, name = (np.concatenate([x[~single], y]) for x, y in ((first, p), (last, p), (name, own)))
        bucket = (name % np.uint64(buckets)).astype(np.int64)
        print_ = self._marks(s.buf, first, last - first + length)
        order = np.lexsort((print_, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (bucket[order][1:] != bucket[order][:-1]) | (print_[order][1:] != print_[order][:-1])
        self.first = first[order]
        self.which = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.bucket = bucket[order][at]
        self.start, self.size = self.first[at], (last - first)[order][at] + length
        doc = s.doc_at(self.first)
        self.least = np.minimum.reduceat(doc, at) if len(at) else doc
        self.most = np.maximum.reduceat(doc, at) if len(at) else doc

    @staticmethod
    def _marks(buf: np.ndarray, start: np.ndarray, size) -> np.ndarray:
        """A hash of buf[start:start + size], eight bytes a step."""
        if not len(start):
            return np.zeros(0, np.uint64)
        size = np.broadcast_to(np.asarray(size, np.int64), start.shape)
        h = np.zeros(len(start), np.uint64)
        words = np.ndarray(len(buf), "<u8", np.append(buf, np.zeros(7, np.uint8)).tobytes(), strides=(1,))
        for k in range(0, int(size.max()), 8):      # at most length / 4 steps over all strings at once
            on = k < size
            w = words[np.minimum(start + k, len(buf) - 1)] & _FIRST[np.clip(size - k, 0, 8)]
            x = (h ^ w) * _M
            h = np.where(on, _mix(x ^ x >> np.uint64(29)), h)
        return _mix(h ^ size.astype(np.uint64))


def transform(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of the strings buf[start:start + size]:
    the byte before each suffix in suffix order (the end of a string sorts
    first, equal suffixes in the order of the strings), and the rows of whole
    strings, which have none."""
    # The strings one after the other, each with a place for its end.
    n = size + 1
    stop = np.cumsum(n)
    off = np.arange(stop[-1]) - np.repeat(stop - n, n)
    rest = np.repeat(size, n) - off
    text = np.zeros(len(off) + 7, np.uint8)
    text[:len(off)] = buf[np.minimum(np.repeat(start, n) + off, len(buf) - 1)]
    # The next seven bytes of each place, then how many of them there are.
    wide = text.astype(np.uint64)
    ahead = np.zeros(len(off), np.uint64)
    for k in range(7):
        ahead = ahead << np.uint64(8) | wide[k:len(off) + k]
    left = np.minimum(rest, 7)
    ahead = (ahead & _HEADS[left]) << np.uint64(8) | left.astype(np.uint64)

    # Sorting numbers is faster than sorting places by them, so places, ranks
    # and groups are sorted as one number where they fit.
    fits = len(off) <= 1 << RANK_BITS
    low = np.uint64(RANK_BITS)
    mask = (np.uint64(1) << low) - np.uint64(1)
    order = np.argsort(ahead, kind="quicksort" if fits else "stable")
    key = ahead[order]
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    if fits:                                  # equal ones in the order of their places
        order = (np.sort(group.astype(np.uint64) << low | order.astype(np.uint64)) & mask).astype(np.int64)
    rank = np.empty(len(order), np.int64)     # of a place's next seven bytes
    rank[order] = group
    more = left == 7                          # the string may go on behind them
    place, depth = order, 7
    spots = np.arange(len(order))             # places in the order not settled yet
    while len(spots):
        same = group[1:] == group[:-1]
        tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        tied &= more[place]                   # whoever ended is settled
        spots, group = spots[tied], group[tied]
        if not len(spots):
            break
        rows = order[spots]
        place = rows + np.minimum(depth, rest[rows])    # past the end, the end itself
        key = rank[place]
        if fits:
            group = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))
            both = (group << RANK_BITS | key).astype(np.uint64)
            both = np.sort(both << low | np.arange(len(both), dtype=np.uint64))
            by = (both & mask).astype(np.int64)
            both >>= low
            new = both[1:] != both[:-1]
        else:
            by = np.lexsort((key, group))
            key, group = key[by], group[by]
            new = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        order[spots] = rows[by]
        place = place[by]
        group = np.cumsum(np.concatenate([[False], new]))
        depth += 7
    whole = off[order] == 0
    return np.where(whole, 0, text[order - 1]), np.flatnonzero(whole).astype(np.int32)


def _transforms(length: int, buckets: int):
    """A row per bucket of a shard: its strings' transform, sizes and doc_ids."""
    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        s = Shard(docs)
        t = Strings(s, found, length, buckets)
        rows: list[list] = [[] for _ in range(8)]
        for b, i, j in _slices(t.bucket):
            out, whole = transform(s.buf, t.start[i:j], t.size[i:j])
            for c, x in zip(rows, (b, key[0].as_py(), i, t.size[i:j].astype(np.uint16).tobytes(), out.tobytes(),
                                   whole.tobytes(), t.least[i:j].tobytes(), t.most[i:j].tobytes())):
                c.append(x)
        kinds = [pa.int64()] * 3 + [pa.binary()] * 5
        return pa.table([pa.array(r, k) for r, k in zip(rows, kinds)],
                        ["bucket", "shard", "string", "sizes", "bwt", "whole", "least", "most"])
    return run


def merged(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int):
    """(string, window, interval) of every window of the strings of several
    transforms (sizes, bwt, whole) whose ``length`` bytes also begin another
    window: windows of one interval are equal.  Strings are numbered through
    all shards."""
    step, symbol, ends, base, rows = [], [], [], 0, 0
    for sizes, bwt, whole in shards:
        lf = np.zeros(len(bwt), np.int64)
        inner = np.ones(len(bwt), bool)
        inner[whole] = False
        at = np.flatnonzero(inner)
        # The k-th row of a symbol steps to the k-th suffix that begins with it;
        # the suffixes that are empty come before all others.
        lf[at[np.argsort(bwt[at], kind="stable")]] = np.arange(len(at)) + len(sizes)
        step.append(lf + rows)
        symbol.append(bwt)
        ends.append(np.arange(len(sizes)) + rows)
        rows += len(bwt)
        base += len(sizes)
    step, symbol, row = np.concatenate(step), np.concatenate(symbol), np.concatenate(ends)
    if rows < 2 ** 31:
        step = step.astype(np.int32)
    size = np.concatenate([s[0] for s in shards]).astype(np.int64)
    # The rows ``length`` bytes behind each window's start, walked to from the ends.
    string = np.arange(base)
    found = []
    while len(row):
        found.append((row, string, np.full(len(row), len(found))))
        more = size[string] - length > len(found) - 1
        row, string = step[row[more]], string[more]
    row, string, back = (np.concatenate(x) for x in zip(*found))
    window = size[string] - length - back
    # Several symbols a round: (how many, numbers in their order, the step over them).
    two, pair = step[step], symbol[step].astype(np.uint16) << np.uint16(8) | symbol
    rounds = [(2, pair, two), (1, symbol, step)]
    there = np.bincount(pair, minlength=1 << 16) > 0
    kinds, number = int(there.sum()), np.cumsum(there, dtype=np.int32) - np.int32(1)
    if kinds <= 4096:
        own = number[pair]
        both = own[two] * np.int32(kinds) + own
        there = np.zeros(kinds * kinds, bool)
        there[both] = True
        if there.sum() <= 1 << 16:       # else their numbers do not fit 16 bits
            rounds.insert(0, (4, (np.cumsum(there) - 1)[both].astype(np.uint16), two[two]))
    kind = np.int32 if len(row) < 2 ** 31 else np.int64
    at, group = np.arange(len(row), dtype=kind), np.zeros(len(row), kind)
    depth = checked = 0
    while depth < length:
        symbols, s, forward = next(r for r in rounds if depth + r[0] <= length)
        s, depth = s[row], depth + symbols
        by = np.argsort(s, kind="stable")
        s, group, at, row = s[by], group[by], at[by], forward[row[by]]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (group[1:] != group[:-1])]) if len(s) else np.zeros(0, bool)
        group = np.cumsum(new, dtype=kind)
        if depth >= checked + 10 or depth == length:          # what stands alone stays so
            checked = depth
            alone = new & np.append(new[1:], True) if len(new) else new
            at, row, group = at[~alone], row[~alone], group[~alone]
    return string[at], window[at], group


def _merge(length: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        sizes, count = _joined(table, "sizes", np.uint16)
        least, _ = _joined(table, "least", np.int64)
        most, _ = _joined(table, "most", np.int64)
        parts = [[np.frombuffer(x, k) for x in table.column(c).to_pylist()]
                 for c, k in (("sizes", np.uint16), ("bwt", np.uint8), ("whole", np.int32))]
        string, window, group = merged(list(zip(*parts)), length)
        n = sizes.astype(np.int64) - length + 1
        begin = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n)), n)
        best = least[owner]
        if len(group):
            cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            low = np.minimum.reduceat(least[string], cut)
            best[begin[string] + window] = np.repeat(low, np.diff(np.append(cut, len(group))))
        # Windows in a row of one string with one smallest doc_id.
        hit = np.flatnonzero(best < most[owner])
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit][1:] != owner[hit][:-1]) | (best[hit][1:] != best[hit][:-1])
        a = hit[new]
        b = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1] if len(hit) else hit
        who = owner[a]
        lo, hi, doc = (a - begin[who]).astype(np.uint16), (b - begin[who]).astype(np.uint16), best[a]
        edge = np.cumsum(count)
        shard_of = np.searchsorted(edge, who, side="right")
        number = (who - (edge - count)[shard_of] + table.column("string").to_numpy()[shard_of]).astype(np.int32)
        rows: list[list] = [[] for _ in range(5)]
        names = table.column("shard").to_pylist()
        for k, i, j in _slices(shard_of):
            for c, x in zip(rows, (names[k], number[i:j].tobytes(), lo[i:j].tobytes(), hi[i:j].tobytes(),
                                   doc[i:j].tobytes())):
                c.append(x)
        return pa.table([pa.array(rows[0], pa.int64())] + [pa.array(r, pa.binary()) for r in rows[1:]],
                        ["shard", "string", "low", "high", "doc"])
    return run


def _cut(length: int, buckets: int):
    """The shard's rows with their removed ranges and what is left."""
    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        s = Shard(docs)
        named = found.filter(pa.compute.is_valid(found.column("names")))
        hits = found.filter(pa.compute.is_valid(found.column("string")))
        gone = np.zeros(len(s.buf), bool)
        if hits.num_rows:
            t = Strings(s, named, length, buckets)
            number, _ = _joined(hits, "string", np.int32)
            low, high, doc = (_joined(hits, c, k)[0] for c, k in (("low", np.uint16), ("high", np.uint16), ("doc", np.int64)))
            order = np.argsort(number, kind="stable")
            number, low, high, doc = number[order], low[order].astype(np.int64), high[order].astype(np.int64), doc[order]
            a, b = np.searchsorted(number, t.which), np.searchsorted(number, t.which, side="right")
            n = b - a
            who = np.repeat(np.arange(len(n)), n)
            hit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            at = t.first[who]
            ok = doc[hit] < s.doc_at(at)
            at, hit = at[ok], hit[ok]
            edges = np.bincount(at + low[hit], minlength=len(gone) + 1) - np.bincount(at + high[hit] + length,
                                                                                      minlength=len(gone) + 1)
            gone = np.cumsum(edges)[:-1] > 0
        kept, spans, lo = [], [], 0
        for text, hi in zip(s.texts, s.ends.tolist()):
            g = gone[lo:hi]
            if g.any():
                turn = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                spans.append([{"start": x, "stop": y} for x, y in turn.reshape(-1, 2).tolist()])
                text = s.buf[lo:hi][~g].tobytes()
            else:
                spans.append([])
            kept.append(text)
            lo = hi
        row = s.row_of.tolist()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table([s.ids, pa.array([len(s.texts[r]) for r in row], pa.int64()),
                         pa.array([kept[r] for r in row], pa.binary()), pa.array([spans[r] for r in row], kind)],
                        ["doc_id", "n_bytes", "kept", "spans"])
    return run


def _sharded(docs: DataFrame) -> DataFrame:
    """The documents, written once and bucketed by shard.  A shard is a part,
    by hash, of one input split."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    d = d.withColumn("key", F.xxhash64("text")).withColumn(
        "shard", F.spark_partition_id().cast("long") * PARTS + F.pmod(F.xxhash64("doc_id", "key"), F.lit(PARTS)))
    name = "documents_" + uuid.uuid4().hex
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), docs.rdd.getNumPartitions())
    path = shared_dir(spark, "sharded")
    d.write.format("parquet").option("path", path).bucketBy(width, "shard").saveAsTable(name)
    return spark.table(name)


def remove_repeated(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes left) and spans (start and stop of the
    removed runs) of every row of ``docs`` (doc_id, text)."""
    if not GRAM <= length <= 1000:
        raise ValueError(f"length must lie between {GRAM} and 1000")
    d = _sharded(docs)
    total = d.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1 + total // bucket_bytes
    names = d.groupBy("shard").applyInArrow(_names(length, buckets), "bucket long, shard long, names binary, counts binary")
    found = names.groupBy("bucket").applyInArrow(_shared(hot), "shard long, bucket long, names binary, counts binary")
    found = durable(found, "shared-names")
    parts = d.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(
        _transforms(length, buckets), "bucket long, shard long, string long, sizes binary, bwt binary, whole binary, "
                                      "least binary, most binary")
    hits = durable(parts.groupBy("bucket").applyInArrow(
        _merge(length), "shard long, string binary, low binary, high binary, doc binary"), "repeated-windows")
    back = found.unionByName(hits, allowMissingColumns=True)
    return d.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(
        _cut(length, buckets), "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, stop: long>>")
