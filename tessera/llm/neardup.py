"""Near-duplicate documents by HyperMinHash sketches, bands and exact checks.

A document's set holds its distinct runs of ``words`` words (A-Z lower-cased,
words split at ASCII white space); a shorter text is one run.  Documents are
linked if the Jaccard similarity of their sets reaches ``percent`` / 100.

1. Sketch: the hashed set is split into 128 buckets; a bucket keeps the
   leading-zero count and ten mantissa bits of its smallest hash.  Empty
   buckets borrow from the first filled one in a fixed order of their own.
2. Texts with equal sets form a class; one sketch a class goes on.
3. 32 bands of four registers give bucket keys.  In each key's group every
   class meets the group's pivot, so candidates grow with the rows, not with
   the square of a group.
4. A candidate goes on if sizes allow the similarity and the estimate, with
   random register collisions taken off, is not hopelessly low; then the full
   sets are compared.
5. Connected components of the links.  In groups whose classes are still in
   several components, each class outside the group's largest component meets
   every other member, in cells of bounded size: first sketches mark who has a
   hopeful partner, then the marked meet with their full sets, and only links
   leave the cell.  So no link inside a group is lost, no group is cut off,
   and no pair is listed that is not a link.

Defined results.  Null, empty or wordless texts have an empty set and no
links; rows without a doc_id neither.  Equal texts are always linked.  Rows
that share a doc_id are judged each by its own text.  Other columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, durable, hand_back, small_batches

REGISTERS, BAND, MANTISSA = 128, 4, 10
BANDS = REGISTERS // BAND
REST = 57                      # bits of a hash below its bucket number
CELL = 512                     # members of a cell in the last round
CACHED_WORDS = 200_000         # word hashes a worker keeps before it starts anew
# Fixed value: share of random register collisions for equal, large sets
# (HyperMinHash paper).
COLLISION = 0.1699194871
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_EDGES = (np.arange(REGISTERS, dtype=np.uint64) << np.uint64(REST))
_LOW = np.uint64((1 << REST) - 1)


def _orders() -> np.ndarray:
    rng = np.random.RandomState(20)
    return np.array([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, words: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word runs."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    k = min(words, len(found))
    h = np.full(len(found) - k + 1, k, np.uint64)
    for j in range(k):
        h ^= ids[j:len(found) - k + 1 + j]
        h *= _MIX
        h ^= h >> np.uint64(31)
    h *= _MIX2
    h ^= h >> np.uint64(29)
    return np.unique(h)


def registers(hashes: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set: per bucket the leading zeros and mantissa
    of its smallest hash, as one 16-bit number."""
    at = np.searchsorted(hashes, _EDGES)
    filled = at < np.append(at[1:], len(hashes))
    rest = hashes[np.minimum(at, len(hashes) - 1)] & _LOW
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    bits = np.where(rest == 0, 1, bits)
    down = np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64)
    up = np.maximum(MANTISSA + 1 - bits, 0).astype(np.uint64)
    mantissa = ((rest >> down) << up) & np.uint64((1 << MANTISSA) - 1)
    reg = (np.clip(REST - bits, 0, 63).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    if not filled.all():
        lender = orders[np.arange(REGISTERS), filled[orders].argmax(1)]
        reg = np.where(filled, reg, reg[lender])
    return reg.astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of sketches, less expected random collisions."""
    ratio = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    chance = COLLISION * 2.0 ** -MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def hopeful(a, b, na, nb, percent: int) -> np.ndarray:
    """Pairs that may reach the similarity: by size for certain, by estimate
    unless it lies six standard deviations below."""
    j = percent / 100
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    spread = 6 * np.sqrt(j * (1 - j) / np.minimum(REGISTERS, np.maximum(small / 2, 1)))
    return (100 * small >= percent * large) & (estimate(a, b, na, nb) >= j - spread)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        cache, orders = WordHashes(), _orders()
        for batch in batches:
            ns, fps, sigs = [], [], []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                s = shingle_set(text, words, cache)
                ns.append(len(s))
                fps.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(registers(s, orders).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())],
                ["doc_id", "n", "fp", "sig"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        cache = WordHashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                sets = [shingle_set(t, words, cache)
                        for t in batch.column(0).slice(k, 256).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "items"])
    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _keep_hopeful(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                ok = hopeful(_matrix(t.column(2)), _matrix(t.column(3)),
                             t.column(4).to_numpy(), t.column(5).to_numpy(), percent)
                yield t.select(["a", "b"]).filter(pa.array(ok))
    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _alive(i: int, members, comp, n, sig, band: int, percent: int) -> np.ndarray:
    """Members of a cell that the late row i has to be compared with: of
    another component, hopeful, and not met in an earlier band already."""
    m = members[comp[members] != comp[i]]
    m = m[hopeful(sig[m], sig[i][None], n[m], n[i], percent)]
    same = (sig[m].reshape(len(m), BANDS, BAND) == sig[i].reshape(BANDS, BAND)).all(2)
    return m[same.argmax(1) == band]


def _facts(t: pa.Table):
    ids, comp, n = (t.column(c).to_numpy() for c in ("id", "comp", "n"))
    late = t.column("late").to_numpy(zero_copy_only=False)
    return ids, comp, n, np.flatnonzero(late), np.flatnonzero(~late), _matrix(t.column("sig"))


def _cell_marks(percent: int):
    """Ids of a cell that have a hopeful partner in it."""
    def run(key, t):
        t = t.combine_chunks()
        ids, comp, n, late, members, sig = _facts(t)
        band, hit = t.column("band")[0].as_py(), np.zeros(len(ids), bool)
        for i in late:
            m = _alive(i, members, comp, n, sig, band, percent)
            hit[m] = True
            hit[i] |= len(m) > 0
        found = np.unique(ids[hit])
        return pa.table({"key": pa.array(np.full(len(found), key[0].as_py(), np.int64)), "id": pa.array(found)})
    return run


def _cell_links(percent: int):
    """One link of each late row of a cell to each component that it is linked to in it."""
    def run(key, t):
        t = t.combine_chunks()
        ids, comp, n, late, members, sig = _facts(t)
        band, column = t.column("band")[0].as_py(), t.column("items")
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // 8
        items = np.frombuffer(column.buffers()[2], np.uint64) if len(ids) else np.zeros(0, np.uint64)
        one, two = [], []
        for i in late:
            m = _alive(i, members, comp, n, sig, band, percent)
            own = items[ends[i]:ends[i + 1]]
            seen: set[int] = set()
            for j in m:
                if comp[j] in seen:
                    continue
                other = items[ends[j]:ends[j + 1]]
                at = np.searchsorted(own, other)
                both = int((own[np.minimum(at, len(own) - 1)] == other).sum())
                if 100 * both >= percent * (len(own) + len(other) - both):
                    seen.add(comp[j])
                    one.append(min(ids[i], ids[j]))
                    two.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})
    return run


class _Search:
    """One search for links: the classes, their candidates, and the texts to
    check them on."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.words, self.percent = words, percent
        self.docs = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
        rows = self.docs.mapInArrow(_sketches(words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
                                                      "n long, fp binary, sig binary")
        self.rows = durable(rows.withColumn("id", F.xxhash64("fp")), "sketches")
        self.classes = durable(
            self.rows.where("n > 0 and doc_id is not null").groupBy("id")
            .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"),
                 F.min("sig").alias("sig")), "classes")

    def bands(self) -> DataFrame:
        width = 2 * BAND
        keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                           lambda i: F.xxhash64(i, F.substring("sig", i * width + 1, F.lit(width))))
        return self.classes.select("id", F.posexplode(keys).alias("band", "key"))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(id, items): full sets of the classes in ``wanted`` (id), made anew from their texts."""
        reps = durable(self.classes.join(wanted.distinct(), "id", "left_semi").select("rep"), "wanted")
        texts = self.docs.join(reps, F.col("doc_id") == F.col("rep"), "left_semi").select("text")
        return durable(texts.mapInArrow(_sets(self.words), "fp binary, items binary")
                       .select(F.xxhash64("fp").alias("id"), "items"), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked, by estimate and then full sets."""
        one = self.classes.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
        two = self.classes.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
        likely = durable(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", "na", "nb")
                         .mapInArrow(_keep_hopeful(self.percent), "a long, b long"), "likely")
        sets = self.sets(likely.select(F.explode(F.array("a", "b")).alias("id")))
        return durable(
            likely.join(sets.select(F.col("id").alias("a"), F.col("items").alias("xa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("items").alias("xb")), "b")
            .select("a", "b", "xa", "xb").mapInArrow(_linked(self.percent), "a long, b long"), "linked")

    def open_members(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """(key, band, id, comp) in the groups that span several components."""
        m = (members.join(comps.withColumnRenamed("node", "_n"), F.col("id") == F.col("_n"), "left")
             .select("key", "band", "id", F.coalesce("component", "id").alias("comp")))
        m = durable(m, "grouped")
        several = durable(m.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
                          .where("x <> y").select("key"), "open-keys")
        return durable(m.join(several, "key", "left_semi"), "open")

    def rest(self, left: DataFrame) -> DataFrame:
        """The links (a, b) between components inside open groups."""
        facts = self.classes.select(F.col("id").alias("_i"), "n", "sig")
        rows = _cells(left).join(facts, F.col("id") == F.col("_i")).drop("_i")
        marks = durable(rows.groupBy("key", "cell").applyInArrow(_cell_marks(self.percent), "key long, id long")
                        .distinct(), "marks")
        left = durable(left.join(marks, ["key", "id"], "left_semi"), "marked")
        sets = self.sets(left.select("id")).withColumnRenamed("id", "_j").dropDuplicates(["_j"])
        rows = (_cells(left).join(facts, F.col("id") == F.col("_i")).join(sets, F.col("id") == F.col("_j"))
                .drop("_i", "_j"))
        return durable(rows.groupBy("key", "cell").applyInArrow(_cell_links(self.percent), "a long, b long"), "late-links")


def _cells(left: DataFrame) -> DataFrame:
    """Open members dealt into cells (key, cell).  The members of a group make
    rows of CELL and those outside its largest component (``late``) columns of
    CELL; a cell is where a row and a column meet, so it is of bounded size."""
    per = durable(left.groupBy("key", "comp").agg(F.count("*").alias("m")), "open-sizes")
    big = per.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("m").alias("size"),
                                 F.max("m").alias("most"))
    slots = lambda c: F.ceil(c / CELL).cast("int")
    big = durable(big.select(F.col("key").alias("_k"), "main", slots(F.col("size")).alias("g"),
                             slots(F.col("size") - F.col("most")).alias("h")), "open-mains")
    m = left.join(big, F.col("key") == F.col("_k")).select("key", "band", "id", "comp", "main", "g", "h")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    row = lambda late, cells: F.transform(cells, lambda c: F.struct(F.lit(late).alias("late"), c.alias("cell")))
    member = row(False, F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda c: own(F.col("g")) * F.col("h") + c))
    late = row(True, F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda c: c * F.col("h") + own(F.col("h"))))
    cells = F.when(F.col("comp") == F.col("main"), member).otherwise(F.concat(member, late))
    return m.select("key", "band", "id", "comp", F.explode(cells).alias("c")).select("key", "band", "id", "comp", "c.late", "c.cell")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``
    (doc_id, text).  The component is its smallest doc_id; ``kept`` marks that
    document.  Rows without doc_id have no component and are kept."""
    s = _Search(docs, words, percent)
    bands = s.bands()
    groups = durable(bands.groupBy("key").agg(F.min("id").alias("pivot"),
                                              F.count("*").alias("c")).where("c > 1"), "groups")
    members = durable(bands.join(groups, "key").select("key", "band", "id", "pivot"), "members")
    pairs = durable(members.where("id <> pivot").select(*_ordered("id", "pivot")).distinct(), "pairs")
    links = s.links(pairs)
    comps = components(links)
    more = s.rest(s.open_members(members.drop("pivot"), comps))
    if more.limit(1).count():
        comps = components(links.unionByName(more))

    # Component labels are class ids; name each by its smallest document.
    named = s.classes.join(comps.withColumnRenamed("node", "_n"), F.col("id") == F.col("_n"), "left")
    named = durable(named.select("id", "rep", "copies", "component").where("copies > 1 or component is not null"),
                    "grouped-classes")
    least = durable(named.where("component is not null").groupBy("component")
                    .agg(F.min("rep").alias("first")).withColumnRenamed("component", "_c"), "first-of-component")
    named = durable(named.join(least, F.col("component") == F.col("_c"), "left")
                    .select(F.col("id").alias("_id"), F.coalesce("first", "rep").alias("first")), "named-classes")
    out = s.rows.join(named, F.col("id") == F.col("_id"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    return (out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
