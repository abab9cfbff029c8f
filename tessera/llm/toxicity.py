"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

1. Learn: a bounded, hashed sample of the learnable labelled rows gives, per
   term (a word or a prefix of one), the toxic and other documents it occurs
   in, on either side at most as many as the different neighbourhoods it has
   there, so that copies of one text do not count again.  Terms that mark
   toxic documents beyond chance become the vocabulary.
2. One pass over all whole texts writes each document's vocabulary counts;
   document frequencies over all documents give the weights.
3. The sampled documents are the examples, in an inverted index whose blocks
   of examples carry the greatest weight per term.  A query visits blocks by
   falling upper bound and stops when no block can reach its k-th neighbour,
   so its neighbours are exact.
4. Similarity-weighted votes of the neighbours, calibrated by a logistic fit
   on the examples' own leave-one-out votes, are the score; the neighbours
   are its evidence.

Defined results.  A null, empty or wordless text, like one without vocabulary
terms, gets the toxic rate of examples without such terms.  Ties among
neighbours go to the smaller example id.  Null labels, and labels without a
document, teach nothing; several labels of a document give their mean rounded
up from a half.  Without any label the score is 0.25.  Repeated rows are
scored each but teach once: a doc_id is one example, of several texts the one
whose terms come first.  Very long texts are read whole; bytes that are no
UTF-8 become U+FFFD.  Other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_of, durable, hand_back, small_batches, strings

POSITIVES, OTHERS = 6_000, 24_000   # bounds of the labelled sample, on average
TERMS = 8_192                       # most terms of the vocabulary
PREFIXES = range(3, 9)
LEAST = 3            # toxic documents of a term
PLACES = 500_000     # neighbourhoods a task gathers before it drops repeated ones
NEIGHBOURHOODS = 1_024   # documents from which on a term's neighbourhoods are estimated from a share of them
PART_BYTES = 1 << 20     # of the taught texts a task reads
NEIGHBOURS = 15
BLOCK = 64           # examples of a block
FIRST = 8            # blocks of the first turn
CALIBRATED = 1_500   # examples whose leave-one-out votes are taken
CACHED_WORDS = 100_000
CACHED_SCORES = 4_000
MARKS = string.punctuation + "«»“”‘’„…–—¡¿"


def terms_of(token: str) -> list[str]:
    """A word and its prefixes, marked by a trailing star."""
    w = token.strip(MARKS)
    return [w, *(w[:n] + "*" for n in PREFIXES if n < len(w))] if w else []


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: term, toxic documents and other documents."""
    found: dict[str, list[int]] = {}
    for batch in batches:
        for text, y in zip(strings(batch.column(0)), batch.column(1).to_pylist()):
            for t in {t for w in set((text or "").lower().split()) for t in terms_of(w)}:
                if (f := found.get(t)) is None:
                    f = found[t] = [0, 0]
                f[0 if y else 1] += 1
    rows = list(found.items())
    for k in range(0, len(rows), 50_000):
        part = rows[k:k + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in part], pa.string()), pa.array([f[0] for _, f in part], pa.int64()),
             pa.array([f[1] for _, f in part], pa.int64())], ["term", "pos", "neg"])


def _places(terms):
    """Term number, label and 32-bit hash of a neighbourhood (words before and
    after) in one long, each once per chunk of occurrences.  Of a term and
    label only the hashes below its limit count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        names, limits = terms.value          # limits: a row of two (other, toxic) a term
        look = _Lookup(names)
        ids, spots, held = [], [], 0

        def chunk():
            pairs = np.unique(np.concatenate(ids).astype(np.int64) << 33 | np.concatenate(spots))
            return pa.RecordBatch.from_arrays([pa.array(pairs)], ["place"])
        for batch in batches:
            for text, y in zip(strings(batch.column(0)), batch.column(1).to_pylist()):
                words = (text or "").lower().split()
                found = [look[w] for w in words]
                n = np.array([len(f) for f in found], np.int64)
                if not n.any():
                    continue
                spot = np.array([xxhash.xxh32_intdigest(a + " " + b) if f else 0 for a, b, f in
                                 zip(["", *words], [*words[1:], ""], found)], np.int64)
                term, spot = np.fromiter(chain.from_iterable(found), np.int32, int(n.sum())), np.repeat(spot, n)
                counts = spot < limits[term, 1 if y else 0]
                ids.append(term[counts])
                spots.append(spot[counts] | (1 << 32 if y else 0))
                held += len(ids[-1])
                if held >= PLACES:
                    yield chunk()
                    ids, spots, held = [], [], 0
        if held:
            yield chunk()
    return run


def term_evidence(texts: DataFrame) -> DataFrame:
    """term, pos, neg: the toxic and other documents of ``texts`` (text, y)
    with the term, on either side at most as many as the different
    neighbourhoods it has there.  Terms of fewer than LEAST toxic documents
    are left out.

    Neighbourhoods are counted by their hashes.  Where a side has more than
    NEIGHBOURHOODS documents with the term, only the share of hashes counts
    that leaves about one in each of so many documents, and the number is scaled up."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = texts.repartition(1 + size // PART_BYTES, F.xxhash64("text"))
    counts = (texts.select("text", "y").mapInArrow(_term_counts, "term string, pos long, neg long")
              .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    counts = durable(counts.where(F.col("pos") >= LEAST), "term-counts")
    rows = counts.orderBy("term").collect()     # at most the words of the sample's toxic texts
    seen = np.array([(r.neg, r.pos) for r in rows], np.float64).reshape(-1, 2)
    share = np.minimum(1.0, NEIGHBOURHOODS / np.maximum(seen, 1))
    terms = spark.sparkContext.broadcast(([r.term for r in rows], (share * 2 ** 32).astype(np.int64)))
    places = texts.select("text", "y").mapInArrow(_places(terms), "place long").distinct()
    places = places.groupBy(F.shiftright("place", 32).alias("k")).count().collect()     # two rows a term
    differ = np.zeros(2 * len(rows), np.int64)
    for r in places:
        differ[r["k"]] = round(r["count"] / share[r["k"] // 2, r["k"] % 2])
    return spark.createDataFrame([(r.term, min(r.pos, int(differ[2 * i + 1])), min(r.neg, int(differ[2 * i])))
                                  for i, r in enumerate(rows)], "term string, pos long, neg long")


def choose_terms(counts: DataFrame, positives: int, others: int, most: int = TERMS) -> list[str]:
    """The terms that mark toxic documents beyond chance: the log-likelihood
    ratio of their two rates must outweigh the number of terms tried."""
    if not positives or not others:
        return []
    p, n = F.lit(float(positives)), F.lit(float(others))
    a, c = F.col("pos").cast("double"), F.col("neg").cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    t = counts.select("term", a.alias("a"), c.alias("c")).where(F.col("a") >= LEAST)
    t = t.select("*", (2 * (part(F.col("a"), (F.col("a") + F.col("c")) * p / (p + n))
                            + part(F.col("c"), (F.col("a") + F.col("c")) * n / (p + n)))).alias("g"))
    t = durable(t.where(F.col("a") * n > F.col("c") * p * 3), "terms")
    tried = max(1, t.count())
    best = t.where(F.col("g") > 2 * math.log(tried) + 1).orderBy(F.desc("g"), "term").limit(most)
    return [r.term for r in best.select("term").collect()]


class _Lookup(dict):
    """Token -> indices of its vocabulary terms."""

    def __init__(self, vocabulary: list[str]):
        super().__init__()
        self.index = {t: i for i, t in enumerate(vocabulary)}

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        f = self[token] = tuple(self.index[t] for t in terms_of(token) if t in self.index)
        return f


def _features(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        look = _Lookup(vocabulary.value)
        for batch in batches:
            terms, counts = [], []
            for text in strings(batch.column(1)):
                seen: Counter = Counter()
                for w, n in Counter((text or "").lower().split()).items():
                    for t in look[w]:
                        seen[t] += n
                terms.append(sorted(seen))
                counts.append([seen[t] for t in terms[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                ["doc_id", "terms", "counts"])
    return run


def unit(terms: list[int], counts: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit TF-IDF vector of a document as (terms, weights)."""
    t = np.asarray(terms, np.int64)
    w = (1 + np.log(np.asarray(counts, np.float64))) * idf[t]
    norm = math.sqrt(float(w @ w))
    return t, (w / norm if norm else w)


class Examples:
    """Inverted index over unit vectors with the greatest weight per term and
    block of examples."""

    def __init__(self, ids, ys, vectors, idf: np.ndarray):
        """Vectors without terms only count towards the rate of such texts."""
        rows = sorted((i, y, v) for i, y, v in zip(ids, ys, vectors))
        bare = [y for _, y, (t, _) in rows if not t]
        self.bare = (sum(bare) + 0.5) / (len(bare) + 2)
        rows = [r for r in rows if r[2][0]]
        self.idf = idf
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.ys = np.array([r[1] for r in rows], np.float64)
        units = [unit(*r[2], idf) for r in rows]
        n_blocks = -(-len(rows) // BLOCK)
        self.most = np.zeros((len(idf), max(1, n_blocks)))
        lists: dict[int, list] = {}
        for k, (t, w) in enumerate(units):
            for a, b in zip(t.tolist(), w.tolist()):
                lists.setdefault(a, []).append((k, b))
                self.most[a, k // BLOCK] = max(self.most[a, k // BLOCK], b)
        self.lists = {}
        for t, p in lists.items():
            at = np.array([k for k, _ in p])
            self.lists[t] = (at, np.array([w for _, w in p]), at // BLOCK)
        self.units = units

    def _similarity(self, t, w, blocks: np.ndarray) -> np.ndarray:
        """Exact similarities of the examples in the marked blocks, 0 elsewhere."""
        at, sim = [np.zeros(0, np.int64)], [np.zeros(0)]
        for term, weight in zip(t.tolist(), w.tolist()):
            if term in self.lists:
                ks, ws, bs = self.lists[term]
                inside = blocks[bs]
                at.append(ks[inside])
                sim.append(weight * ws[inside])
        return np.bincount(np.concatenate(at), np.concatenate(sim), len(self.ids))

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, skip: int = -1):
        """(positions, similarities) of the k nearest examples with a positive
        similarity, ties to the smaller position.  The blocks with the highest
        bounds come first; of the others only those follow whose bound reaches
        the k-th similarity found."""
        bound = w @ self.most[t]
        at, sim = np.zeros(0, np.int64), np.zeros(0)
        todo = bound > 0
        turn = np.zeros(len(bound), bool)
        turn[np.argsort(-bound, kind="stable")[:FIRST]] = True
        while (turn & todo).any():
            acc = self._similarity(t, w, turn & todo)
            todo &= ~turn
            if skip >= 0:
                acc[skip] = 0
            hit = np.flatnonzero(acc > 0)
            at, sim = np.concatenate([at, hit]), np.concatenate([sim, acc[hit]])
            if len(sim) > k:
                keep = np.argpartition(-sim, k - 1)
                keep = np.flatnonzero(sim >= sim[keep[k - 1]] - 1e-11)
                at, sim = at[keep], sim[keep]
            keep = np.lexsort((at, -np.round(sim, 12)))[:k]
            at, sim = at[keep], sim[keep]
            turn = todo & (bound >= sim[-1] - 1e-12) if len(sim) == k else todo
        return at, sim

    def vote(self, at: np.ndarray, sim: np.ndarray) -> float:
        """Share of similarity that toxic neighbours hold, drawn to the rate
        of texts without terms where neighbours are few or far."""
        w = sim ** 2
        return float((w @ self.ys[at] + 0.25 * self.bare) / (w.sum() + 0.25))

    def calibrate(self) -> tuple[float, float]:
        """Slope and shift of a logistic fit of the labels on leave-one-out votes."""
        if len(self.ys) < 20 or len(set(self.ys.tolist())) < 2:
            return 1.0, 0.0
        some = range(0, len(self.units), max(1, len(self.units) // CALIBRATED))
        x = np.array([_logit(self.vote(*self.nearest(*self.units[k], skip=k))) for k in some])
        ys = self.ys[list(some)]
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([x @ (p - ys) + 0.1 * (a - 1), (p - ys).sum() + 0.1 * b])
            v = p * (1 - p)
            h = np.array([[v @ (x * x) + 0.1, v @ x], [v @ x, v.sum() + 0.1]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def _scores(model, evidence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        index, slope, shift = model.value
        known: dict = {}

        def judge(terms, counts):
            at, sim = index.nearest(*unit(terms, counts, index.idf))
            z = slope * _logit(index.vote(at, sim)) + shift
            return 1 / (1 + math.exp(-z)), index.ids[at[:evidence]].tolist(), sim[:evidence].tolist()
        for batch in batches:
            scores, ids, sims = [], [], []
            for terms, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                key = (tuple(terms), tuple(counts))
                if key not in known:
                    if len(known) >= CACHED_SCORES:
                        known.clear()
                    known[key] = judge(terms, counts) if terms else (index.bare, [], [])
                for out, x in zip((scores, ids, sims), known[key]):
                    out.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int64())),
                 pa.array(sims, pa.list_(pa.float64()))], ["doc_id", "score", "evidence", "similarity"])
    return run


def sample_labels(labels: DataFrame, label: str, mod: int, held: int, most: dict[int, int]) -> DataFrame:
    """(id, y) of learnable labelled rows, by hash, about ``most[y]`` of a class."""
    y = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("double").alias("_y"))
         .where("_y is not null and id is not null").where(F.pmod(crc_of(F.col("id")), F.lit(mod)) != held)
         .groupBy("id").agg((F.avg("_y") >= 0.5).cast("int").alias("y")))
    y = durable(y, "labels")
    n = {r.y: r.n for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    cut = [int(min(1.0, most[k] / max(1, n.get(k, 0))) * 2 ** 31) for k in (0, 1)]
    spot = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(2 ** 31))
    return durable(y.where(spot < F.when(F.col("y") == 1, cut[1]).otherwise(cut[0])), "sample")


def score_toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0,
                   positives: int = POSITIVES, others: int = OTHERS, evidence: int = 5) -> DataFrame:
    """doc_id, held_out, score, evidence (nearest examples) and their
    similarity of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    d = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = sample_labels(labels, "toxic", mod, held, {0: others, 1: positives})
    ids = F.broadcast(sample)          # at most about positives + others rows
    texts = d.join(ids, d.doc_id == ids.id).groupBy(F.xxhash64("text").alias("_t"), "y")
    # Equal texts teach once.
    texts = durable(texts.agg(F.min("text").alias("text")).select("text", "y"), "taught")
    n = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    vocabulary = choose_terms(term_evidence(texts), n.get(1, 0), n.get(0, 0))
    words = spark.sparkContext.broadcast(vocabulary)
    feats = durable(d.mapInArrow(_features(words), "doc_id long, terms array<int>, counts array<int>"), "features")
    total = feats.count()
    df = np.zeros(len(vocabulary))
    for r in feats.select(F.explode("terms").alias("t")).groupBy("t").count().collect():   # one row a term
        df[r["t"]] = r["count"]
    idf = np.log((1 + total) / (1 + df)) + 1
    # One example per doc_id, however often it occurs: no more than the sample has rows.
    rows = (feats.join(ids, feats.doc_id == ids.id).groupBy("doc_id").agg(F.min(F.struct("y", "terms", "counts")).alias("e"))
            .select("doc_id", "e.*").collect())
    index = Examples([r.doc_id for r in rows], [r.y for r in rows], [(r.terms, r.counts) for r in rows], idf)
    model = spark.sparkContext.broadcast((index, *index.calibrate()))
    out = feats.mapInArrow(_scores(model, evidence), "doc_id long, score double, evidence array<long>, "
                                                     "similarity array<double>")
    held_out = F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(mod)) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "similarity")
