"""Spelling variants of the words of a corpus, by k-d trees over letter counts.

1. Tasks count the words of whole texts; counts are added up per word.
2. A word is a point: how often each letter occurs in it.  One replaced letter
   moves a point by exactly two in L1 distance, one inserted or deleted letter
   by exactly one, to a word of a neighbouring length.  So words are searched
   per pair of lengths: (n, n) at distance two, (n, n + 1) at distance one.
3. The upper levels of one k-d tree a length, fitted on a bounded hashed sample
   of the words, deal the points into cells.  A word visits every cell whose
   box lies within the distance, whatever the sample was.  Cells that the
   sample could not cut finely enough are split over a grid of slices of their
   points and of their visitors, each pair of slices in one group.
4. A group builds the lower levels over its points, prunes by boxes, and
   verifies the order of the letters of what is left.
5. A word's form is its near word with the largest count, if that is ``factor``
   times its own; forms are followed to the root by doubling pointers.

Defined results.  Null texts have no words; a null doc_id counts as empty text
in the hash that picks letters to drop.  Bytes that are no UTF-8 end a word.
Documents count as often as they occur.  Very long texts are read whole, very
long words compared whole.  Ties for a form go to the smallest word in the
order of code points.  Other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, small_batches, strings

SAMPLE = 100_000       # words that the upper levels of the trees are fitted on, about
CELL = 32_768          # points of a cell, about
VISITORS = 8           # visitors of a group, as a multiple of CELL
LEAF = 24              # points below which boxes are no longer cut
HELD = 300_000         # words a task counts before it hands them on
# A run of letters is A-Z, a-z and U+00C0 to U+00FF, in which A-Z is lower-cased.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
_DIM = np.zeros(256, np.int64)
_DIM[97:123], _DIM[192:256] = np.arange(26), 26 + np.arange(64)
DIMS = 90
SHIFT = 24             # a cell is a length, then a leaf in so many bits


def words_of(text: str) -> list[bytes]:
    """The lower-cased runs of letters of a text, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def _counted(length: int, drop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())],
                ["word", "n"])
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                if not text:
                    continue
                start = zlib.crc32((doc + ":").encode())
                for w, n in Counter(words_of(text)).items():
                    if len(w) < length:
                        continue
                    if drop:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % drop == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1:]
                            if len(w) < length:
                                continue
                    found[w] += n
                if len(found) >= HELD:
                    yield out()
                    found.clear()
        if found:
            yield out()
    return run


def word_counts(docs: DataFrame, length: int = 7, times: int = 2, drop: int = 0) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) with at least ``length``
    letters and ``times`` occurrences.  With ``drop``, a word of a document
    whose crc32 of ``<doc_id>:<word>`` it divides loses the letter at that
    crc32 modulo its length, as misspelt words do."""
    d = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                                   F.col("text").cast("string").alias("text"))
    found = d.mapInArrow(_counted(length, drop), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def letters(words: list[bytes], length: int) -> np.ndarray:
    """The words of one length as rows of codes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def points(codes: np.ndarray) -> np.ndarray:
    """Letter counts of each row of codes."""
    n, length = codes.shape
    kind = np.int16 if length < 2 ** 14 else np.int32
    out = np.empty((n, DIMS), kind)
    step = max(1, (1 << 22) // max(1, length))
    for k in range(0, n, step):
        part = _DIM[codes[k:k + step]]
        at = (part + np.arange(len(part))[:, None] * DIMS).ravel()
        out[k:k + step] = np.bincount(at, minlength=len(part) * DIMS).reshape(-1, DIMS)
    return out


def _split(p: np.ndarray) -> tuple[int, int] | None:
    """(letter, count) that halves the points best; the left half has at most
    so many of the letter.  None if all points are equal."""
    low, high = p.min(0), p.max(0)
    some = np.flatnonzero(low < high)
    if not len(some):
        return None
    q = p[:, some]
    cut = np.minimum(np.median(q, axis=0).astype(np.int64), high[some] - 1)
    left = (q <= cut).sum(0)
    best = int(np.abs(2 * left - len(p)).argmin())
    return int(some[best]), int(cut[best])


def upper_tree(p: np.ndarray, share: float, cell: int):
    """(letter, count, left, right) nested, with numbered leaves that hold
    about ``cell`` points, of which ``p`` is the given share."""
    leaves = 0

    def grow(part):
        nonlocal leaves
        at = _split(part) if len(part) > max(1.0, cell * share) else None
        if at is None:
            leaves += 1
            return leaves - 1
        left = part[:, at[0]] <= at[1]
        return (*at, grow(part[left]), grow(part[~left]))
    return grow(p)


def visits(tree, q: np.ndarray, reach: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows, distances): for each leaf the rows of ``q`` whose distance
    to its box is at most ``reach``."""
    out = []
    todo = [(tree, np.arange(len(q)), np.zeros(len(q), np.int64), {})]
    while todo:
        node, rows, far, box = todo.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            out.append((node, rows, far))
            continue
        d, cut, left, right = node
        x = q[rows, d].astype(np.int64)
        low, high = box.get(d, (0, 1 << 40))
        before = np.maximum(low - x, 0) + np.maximum(x - high, 0)
        for child, a, b in ((left, low, min(high, cut)), (right, max(low, cut + 1), high)):
            now = far - before + np.maximum(a - x, 0) + np.maximum(x - b, 0)
            ok = now <= reach
            todo.append((child, rows[ok], now[ok], box | {d: (a, b)}))
    return out


def _routed(trees):
    """Every word in its own cell (kind 0) and in the others it visits, of its
    own length (1) and of the next one (2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trees.value
        for batch in batches:
            word, n = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(zero_copy_only=False)
            size = np.array([len(w) for w in word])
            for length in np.unique(size).tolist():
                at = np.flatnonzero(size == length)
                p = points(letters([w.encode("latin-1") for w in word[at]], length))
                cells, kinds, rows = [], [], []
                for leaf, r, far in visits(known.get(length, 0), p, 2):
                    cells.append(np.full(len(r), length << SHIFT | leaf))
                    kinds.append((far > 0).astype(np.int8))
                    rows.append(r)
                for leaf, r, _ in visits(known.get(length + 1, 0), p, 1):
                    cells.append(np.full(len(r), (length + 1) << SHIFT | leaf))
                    kinds.append(np.full(len(r), 2, np.int8))
                    rows.append(r)
                r = at[np.concatenate(rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cells).astype(np.int64)), pa.array(np.concatenate(kinds)),
                     pa.array(word[r].tolist(), pa.string()), pa.array(n[r])], ["cell", "kind", "word", "n"])
    return run


def at_distance(p: np.ndarray, q: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of q, rows of p) at exactly this L1 distance: the points are
    halved letter by letter, rows of q that their box cannot reach are left."""
    todo = [(np.arange(len(p)), np.arange(len(q)))]
    while todo:
        ps, qs = todo.pop()
        if not len(ps) or not len(qs):
            continue
        part, ask = p[ps], q[qs]
        low, high = part.min(0), part.max(0)
        far = (np.maximum(low - ask, 0) + np.maximum(ask - high, 0)).sum(1)
        qs = qs[far <= distance]
        if not len(qs):
            continue
        at = _split(part) if len(ps) > LEAF else None
        if at is not None:
            left = part[:, at[0]] <= at[1]
            todo += [(ps[left], qs), (ps[~left], qs)]
            continue
        step = max(1, (1 << 18) // len(ps))
        for k in range(0, len(qs), step):
            some = q[qs[k:k + step]]
            total = np.zeros((len(some), len(ps)), p.dtype)
            for d in range(p.shape[1]):
                total += np.abs(some[:, d, None] - part[None, :, d])
            a, b = np.nonzero(total == distance)
            yield qs[k + a], ps[b]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of codes differ by one replaced letter (equal widths), or
    ``b`` by one inserted (one wider)."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    n = a.shape[1]
    head, tail = a == b[:, :-1], a == b[:, 1:]
    lead = np.where(head.all(1), n, (~head).argmax(1)) if n else np.zeros(len(a), int)
    rest = np.where(tail.all(1), n, (~tail[:, ::-1]).argmax(1)) if n else np.zeros(len(a), int)
    return lead + rest >= n


def _near(key: tuple, table: pa.Table) -> pa.Table:
    """Partial results of a group: per word its near words here and the best."""
    length = key[0].as_py() >> SHIFT
    kind = table.column("kind").to_numpy()
    word = np.array(table.column("word").to_pylist(), object)
    n = table.column("n").to_numpy()
    raw = np.array([w.encode("latin-1") for w in word], object)
    mine = np.flatnonzero((kind == 0) | (kind == 3))
    out: dict[str, list] = {}

    def note(w, m, other):
        """``other`` occurs m times and is near w; the best has the largest
        count, then the smallest word."""
        f = out.get(w)
        if f is None:
            out[w] = [1, m, other]
        else:
            f[0] += 1
            if m > f[1] or m == f[1] and other < f[2]:
                f[1], f[2] = m, other
    if len(mine):
        own = letters(raw[mine].tolist(), length)
        p = points(own)
        for kinds, size, distance in (((0, 1), length, 2), ((2,), length - 1, 1)):
            ask = np.flatnonzero(np.isin(kind, kinds))
            if not len(ask) or not size:
                continue
            codes = letters(raw[ask].tolist(), size)
            q = points(codes).astype(p.dtype)
            used = np.flatnonzero(p.any(0) | q.any(0))
            step = max(1, (1 << 22) // length)
            for a, b in at_distance(np.ascontiguousarray(p[:, used]), np.ascontiguousarray(q[:, used]), distance):
                for k in range(0, len(a), step):
                    ok = one_edit(codes[a[k:k + step]], own[b[k:k + step]])
                    x, y = ask[a[k:k + step][ok]], mine[b[k:k + step][ok]]
                    for i, j in zip(x.tolist(), y.tolist()):
                        note(word[i], n[j], word[j])
                        if distance == 1:
                            note(word[j], n[i], word[i])
    ws = list(out)
    return pa.table([pa.array(ws, pa.string()), pa.array([out[w][0] for w in ws], pa.int64()),
                     pa.array([int(out[w][1]) for w in ws], pa.int64()), pa.array([out[w][2] for w in ws], pa.string())],
                    ["word", "near", "best_n", "best"])


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, n_near, best_n, best): for each of ``words`` (word, n) that has
    any, its number of near words and the one with the largest count."""
    spark = words.sparkSession
    total = words.count()
    share = min(1.0, sample / max(1, total))
    spot = F.pmod(F.xxhash64("word", F.lit("sample")), F.lit(2 ** 31)) < int(share * 2 ** 31) + 1
    by_length: dict[int, list[bytes]] = {}
    for r in words.where(spot).select("word").collect():       # about ``sample`` words
        by_length.setdefault(len(r.word), []).append(r.word.encode("latin-1"))
    trees = {k: upper_tree(points(letters(ws, k)), share, cell) for k, ws in sorted(by_length.items())}
    routed = durable(words.select("word", "n").mapInArrow(_routed(spark.sparkContext.broadcast(trees)),
                                                          "cell long, kind byte, word string, n long"), "routed")
    count = lambda c: F.sum(c.cast("long"))
    sizes = routed.groupBy("cell").agg(count(F.col("kind") == 0).alias("p"), F.count("*").alias("q"))
    grid = sizes.select("cell", F.ceil(F.col("p") / (2 * cell)).alias("r"), F.ceil(F.col("q") / (VISITORS * cell)).alias("c"))
    grid = durable(grid.where("p > 0").where("r > 1 or c > 1"), "split-cells")
    one = lambda k: F.lit(k).cast("long")
    groups = routed.withColumns({"x": one(0), "y": one(0)})
    if grid.limit(1).count():
        whole = groups.join(grid, "cell", "left_anti")
        parts = routed.join(grid, "cell")
        slot = lambda n: F.pmod(F.xxhash64("word"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        own = parts.where("kind = 0").select("cell", one(3).cast("byte").alias("kind"), "word", "n",
                                             slot("r").alias("x"), every("c").alias("y"))
        ask = parts.select("cell", F.greatest(F.col("kind"), F.lit(1)).cast("byte").alias("kind"), "word", "n",
                           every("r").alias("x"), slot("c").alias("y"))
        groups = whole.unionByName(own).unionByName(ask)
    found = groups.groupBy("cell", "x", "y").applyInArrow(_near, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form) with a form: where
    its forms end.  Forms must not run in circles."""
    up = durable(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(64):
        on = up.select(F.col("word").alias("w"), F.col("root").alias("next"))
        step = durable(up.join(on, F.col("root") == F.col("w"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return up
    raise RuntimeError("forms run in circles")


def spelling_variants(words: DataFrame, factor: int = 10, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every one of ``words`` (word, n)."""
    words = durable(words.select("word", "n"), "words")
    near = near_words(words, cell, sample).withColumnRenamed("word", "w")
    found = words.join(near, F.col("word") == F.col("w"), "left")
    good = F.col("best_n") >= factor * F.col("n")
    found = durable(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                 F.when(good, F.col("best")).alias("form"),
                                 F.when(good, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(found).withColumnRenamed("word", "w")
    return found.join(ends, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
