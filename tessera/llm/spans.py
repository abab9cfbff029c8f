"""Substring dedup by sliding sentence spans.

A text is cut into sentences; every run of several consecutive sentences with
enough words is hashed, the hashes are joined over all documents, and each
sentence covered by a repeated run that is not the run's first occurrence is
removed.  First is the smallest (doc_id, hash of the text, position).

A sentence ends at ``. ! ? , ; :`` before white space, at a line break, and
after about one word in EVERY, chosen by the word's hash; where GAP words in a
row have none chosen, the smallest hash of any NEAR of them is.  That cuts
finer than grammar does: a passage copied out of running text begins and ends
inside sentences, and has to hold whole ones to be found.  The chosen ends
depend on the words alone, so every copy has them, whatever stands around it.
Runs are compared by their lower-cased words, without marks or white space.
In scripts without spaces, and in tokens of more than LONG characters, words
are pieces of a few characters, cut by a hash of two neighbours.

A task first settles the repeats among the rows it reads, and shuffles one row
per hash, so a span that a third of the corpus shares is no hot key.

Defined results.  Null and empty texts stay as they are; a text that only
repeats others becomes empty.  A document is its doc_id with a hash of its
text, so a row that occurs twice counts as one document and keeps its text,
and one doc_id may have several texts.  Rows without doc_id come after all
others.  Very long texts are cut whole; bytes that are no UTF-8 become U+FFFD.
Other columns pass through; columns removed and ranges are replaced, a column
n_chars is set anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import durable, hand_back, small_batches, strings

SENTENCES, WORDS = 2, 16        # of a run, at least
CHUNK = 200_000                 # runs a task settles at a time
CACHED_WORDS = 200_000
LENGTH_BITS = 24                # a place is a run's start, then its length in these bits
LAST = 2 ** 63 - 1              # stands for a null doc_id
EVERY = 5                       # words an end by hash, on average
GAP, NEAR = 12, 8
LONG = 40
MARKS = ".!?,;:\"'()"
# Thai, Lao, Tibetan, Burmese, Khmer, Chinese and Japanese letters and marks.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\uff00-\uff9f"
                      "\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
# No smaller character is, or has a lower case, that UNSPACED matches.
FIRST_UNSPACED = 0xe00
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
_STOP = np.array([chr(c) in ".!?,;:" for c in range(128)])
_P = 0x9E3779B97F4A7C15
_Q = pow(_P, -1, 2 ** 64)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            grow = lambda x: np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))])
            self.up, self.down = grow(_P), grow(_Q)
        return self.up[:n], self.down[:n]


class Words(dict):
    """Hash of each word without its marks, 0 for a word of marks alone."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        w = word.strip(MARKS)
        h = self[word] = xxhash.xxh3_64_intdigest(w) | 1 if w else 0
        return h


def pieces(token: str) -> list[str]:
    """A token without spaces in pieces that depend on its characters alone,
    about four of an unspaced script and eight of others."""
    c = np.frombuffer(token.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (c[:-1] * np.uint64(_P) ^ c[1:]) * np.uint64(_Q) >> np.uint64(40)
    wide = np.array([bool(UNSPACED.match(x)) for x in token[1:]])
    ends = (np.flatnonzero(h % np.where(wide, np.uint64(4), np.uint64(8)) == 0) + 2).tolist()
    return [token[a:b] for a, b in zip([0, *ends], [*ends, len(token)]) if a < b]


def parted(text: str, known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, stop, last) of the text's words: hash, 0 for marks alone; end,
    with the white space that follows; whether a sentence ends there."""
    low = text.lower()
    if len(low) != len(text):          # a few letters change length in lower case
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    tokens = low.split()
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE.take(codes, mode="clip")
    # Where words and white space begin, and the end: a word, then the space after it.
    turn = np.empty(2 * len(tokens), np.int64)
    inner = (space[1:] != space[:-1]).nonzero()[0]
    first = int(not space[0])
    turn[0], turn[-1] = 0, len(text)
    turn[first:first + len(inner)] = inner + 1
    start, over = turn[::2], turn[1::2]
    stop = np.empty_like(start)
    stop[:-1], stop[-1] = start[1:], len(text)
    last = _STOP.take(codes[over - 1], mode="clip")
    last[-1] &= over[-1] < len(text)
    lines = (codes == 10).nonzero()[0]
    if len(lines):
        last |= lines.searchsorted(stop) > lines.searchsorted(over)
    if (over - start).max() > LONG or codes.max() >= FIRST_UNSPACED and UNSPACED.search(low):
        some, ends, flags = [], [], []
        for t, a, b, e in zip(tokens, start.tolist(), stop.tolist(), last.tolist()):
            p = pieces(t) if len(t) > LONG or UNSPACED.search(t) else [t]
            some += p
            ends += [*(a + np.cumsum([len(x) for x in p[:-1]], dtype=int)).tolist(), b]
            flags += [True] * (len(p) - 1) + [e]
        tokens, stop, last = some, np.array(ends), np.array(flags)
    ids = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    at = ids.nonzero()[0]
    real = ids[at]
    chosen = ((real >> np.uint64(40)) % np.uint64(EVERY) == 0).nonzero()[0]
    last[at[chosen]] = True
    edges = np.empty(len(chosen) + 2, np.int64)
    edges[0], edges[1:-1], edges[-1] = -1, chosen, len(real)
    size = edges[1:] - edges[:-1]
    wide = (size > GAP).nonzero()[0]
    if len(wide):
        # The first words of all places of NEAR words between two ends.
        n = size[wide] - NEAR
        near = np.arange(n.sum()) + np.repeat(edges[wide] + 1 - (n.cumsum() - n), n)
        least, place = real[near], near
        for k in range(1, NEAR):
            x = real[near + k]
            place = np.where(x <= least, near + k, place)        # the last of equal ones
            least = np.minimum(x, least)
        last[at[place]] = True
    return ids, stop, last


def cut(text: str, known: Words | None = None) -> list[int]:
    """Ends of the text's sentences; each starts where the last one ended."""
    _, stop, last = parted(text, Words() if known is None else known)
    ends = stop[last].tolist()
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def runs(text: str, sentences: int, words: int, powers: Powers, known: Words):
    """(start, end, hash) arrays: for each sentence the shortest run from it
    that has enough sentences and words."""
    ids, _, last = parted(text, known)
    if len(ids) < words:
        return None
    last[-1] = True
    total = np.concatenate([[0], np.cumsum(ids != 0)[last]])
    ids = ids[ids != 0]
    n = len(total) - 1
    if n < sentences or len(ids) < words:
        return None
    stop = np.maximum(np.searchsorted(total, total[:-1] + words), np.arange(n) + sentences)
    start = np.flatnonzero(stop <= n)
    if not len(start):
        return None
    stop = stop[start]
    up, down = powers.get(len(ids) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * up[:-1])])
    a, b = total[start], total[stop]
    h = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return start, stop, (h * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _settled(*parts) -> pa.RecordBatch:
    """The runs of a chunk, in the order of its documents, which compresses
    well; ``later`` marks those with an earlier equal run in the chunk."""
    doc, key, start, stop, h = (np.concatenate(x) for x in parts)
    later = np.zeros(len(h), bool)
    # Most hashes occur once; only the others need the order of their places.
    order = h.argsort()
    same = h[order[1:]] == h[order[:-1]]
    some = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    if len(some):
        some = some[np.lexsort((start[some], key[some], doc[some], h[some]))]
        d, k, s, x = doc[some], key[some], start[some], h[some]
        same = np.concatenate([[False], x[1:] == x[:-1]])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(x))))
        later[some] = same & ((d != d[head]) | (k != k[head]) | (s != s[head]))
    return pa.RecordBatch.from_arrays(
        [pa.array(h), pa.array(doc), pa.array(key), pa.array(start.astype(np.int32)),
         pa.array((stop - start).astype(np.int32)), pa.array(later)], ["h", "doc", "key", "start", "size", "later"])


def _runs(sentences: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        powers, known = Powers(), Words()
        parts: tuple[list, ...] = ([], [], [], [], [])
        held = 0
        for batch in batches:
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2))):
                found = runs(text, sentences, words, powers, known) if text else None
                if found is None:
                    continue
                a, b, h = found
                for p, x in zip(parts, (np.full(len(a), doc, np.int64), np.full(len(a), key, np.int32), a, b, h)):
                    p.append(x)
                held += len(a)
                if held >= CHUNK:
                    yield _settled(*parts)
                    parts, held = ([], [], [], [], []), 0
        if held:
            yield _settled(*parts)
    return run


def _named(docs: DataFrame) -> list:
    """The two columns that name a document."""
    key = F.coalesce(F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(2 ** 31 - 1)), F.lit(0))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"), key.cast("int").alias("_key")]


def repeated(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(doc, key, start, stop): every run of sentences that is not the first
    of its kind, named by doc_id (the largest long for null) and text hash."""
    d = docs.select(*_named(docs), F.col("text").cast("string").alias("text"))
    found = d.mapInArrow(_runs(sentences, words), "h long, doc long, key int, start int, size int, later boolean")
    place = F.shiftleft(F.col("start").cast("long"), LENGTH_BITS).bitwiseOR(F.col("size").cast("long"))
    found = found.select("h", "doc", "key", place.alias("place"), "later")
    # Runs that their task has settled go along to places of their own, so one
    # shuffle carries all and a run found everywhere is still one row per task.
    found = found.withColumn("h", F.when(F.col("later"), F.xxhash64("doc", "key", "place")).otherwise(F.col("h")))
    first = W.partitionBy("h", "later").orderBy("doc", "key", "place")
    both = found.select("doc", "key", "place", "later", F.rank().over(first).alias("r")).where("later or r > 1")
    start = F.shiftright("place", LENGTH_BITS).cast("int")
    size = F.col("place").bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)).cast("int")
    return both.select("doc", "key", start.alias("start"), (start + size).alias("stop"))


def covered(spans: DataFrame) -> DataFrame:
    """(doc, key, gone): per document its disjoint removed ranges of
    sentences, as an ordered array of start and stop."""
    w = W.partitionBy("doc", "key").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int")
    s = spans.select("*", opens.alias("new"))
    s = s.select("*", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("island"))
    s = s.groupBy("doc", "key", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return s.groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gone"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hand_back()
    known = Words()
    for batch in batches:
        t, g = batch.schema.get_field_index("text"), batch.schema.get_field_index("_gone")
        texts, counts = [], []
        for text, gone in zip(strings(batch.column(t)), batch.column(g).to_pylist()):
            if text and gone:
                at = [0, *cut(text, known)]
                kept, last = [], 0
                for s in gone:
                    kept.append(text[at[last]:at[s["start"]]])
                    last = s["stop"]
                kept.append(text[at[last]:])
                text = "".join(kept)
            texts.append(text)
            counts.append(sum(s["stop"] - s["start"] for s in gone or ()))
        columns = [pa.array(texts, pa.string()) if k == t else c for k, c in enumerate(batch.columns) if k != g]
        names = [x for x in batch.schema.names if x != "_gone"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], [*names, "_removed"])


def _cut_out(rows: DataFrame) -> DataFrame:
    """Rows with text and _gone: the text without its removed ranges, and
    their number of sentences as _removed."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_gone")
    return rows.mapInArrow(_removed, schema + ", _removed int")


def remove_repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS,
                   only_changed: bool = False, report: bool = True) -> DataFrame:
    """``docs`` with repeated runs of sentences cut out of ``text``, and
    columns ``removed`` (sentences cut) and ``ranges`` (which), in place of
    columns of these names; without ``report`` just the columns of ``docs``.
    ``only_changed`` leaves out documents that keep all."""
    docs = small_batches(docs)
    if report:
        docs = docs.drop("removed", "ranges")
    gone = durable(covered(repeated(docs, sentences, words)), "gone")
    rows = docs.withColumn("text", F.col("text").cast("string")).select("*", *_named(docs))
    how = "inner" if only_changed else "left"
    rows = rows.join(gone.hint("merge"), (rows["_doc"] == gone["doc"]) & (rows["_key"] == gone["key"]), how).select(
        *(rows[c] for c in docs.columns), gone["gone"].alias("_gone"), gone["gone"].alias("_ranges"))
    out = _cut_out(rows)
    out = out.withColumnsRenamed({"_removed": "removed", "_ranges": "ranges"}) if report else out.drop("_removed", "_ranges")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
