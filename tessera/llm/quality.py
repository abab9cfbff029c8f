"""Quality by a byte-level convolutional network, trained and run in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Learned filters look at every window of five bytes, and at one more channel:
how many words in a row begin like the word before them.  Each chunk keeps a
filter's greatest response; the greatest and the mean over the chunks go
through a learned layer to one probability.

Training runs on a bounded, hashed sample of the learnable labelled rows, in
one task, with fixed seeds; the filters then score every whole text where it
lies, without a shuffle.

Defined results.  Null and empty texts are one chunk of padding.  Null labels,
and labels without a document, teach nothing; several labels of a document
give their mean rounded up from a half.  Without labels, or with one class
only, the score is the smoothed rate of good rows.  Repeated rows are scored
each; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_of, durable, small_batches
from tessera.llm.toxicity import sample_labels

GOOD, BAD = 2_000, 2_000        # bounds of the labelled sample, on average
TEXT_BYTES = 12_000_000         # bound of the sample's text
FILTERS, WIDTH = 16, 5
CHUNK, STRIDE = 1024, 896       # bytes; neighbours share 128
EPOCHS, RATE, DECAY = 8, 0.01, 1e-4
RUN = 12                        # words in a row that the last channel counts at most
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_runs(b: np.ndarray) -> np.ndarray:
    """Per byte, 0 but at the start of a word: the number of words before it
    in a row whose first bytes, up to eight, equal its own, scaled to 1."""
    out = np.zeros(len(b), np.float32)
    space = _SPACE[b]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(start) < 2:
        return out
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    head = np.lib.stride_tricks.sliding_window_view(padded, 8)[start]
    end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    head = np.where(np.arange(8) < (end - start)[:, None], head, 0)
    same = np.concatenate([[False], (head[1:] == head[:-1]).all(1)])
    at = np.arange(len(start))
    out[start] = np.minimum(at - np.maximum.accumulate(np.where(same, 0, at)), RUN) / RUN
    return out


def prepared(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer((text or "").encode(), np.uint8)
    if len(b) < WIDTH:
        b = np.concatenate([b, np.zeros(WIDTH - len(b), np.uint8)])
    return b, word_runs(b)


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks over n filter positions; the last one ends at n."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    s = np.arange(0, n - CHUNK, STRIDE)
    return np.append(s, n - CHUNK)


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.RandomState(seed)
        self.table = (rng.randn(WIDTH, 256, FILTERS) * 0.1).astype(np.float32)
        self.run = (rng.randn(FILTERS) * 0.1).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = (rng.randn(2 * FILTERS) * 0.1).astype(np.float32)
        self.shift = np.float32(0)

    def params(self) -> list[np.ndarray]:
        return [self.table, self.run, self.bias, self.out]

    def pooled(self, b: np.ndarray, r: np.ndarray):
        """(greatest response, its position) of each filter in each chunk."""
        n = len(b) - WIDTH + 1
        starts = chunk_starts(n)
        best = np.empty((len(starts), FILTERS), np.float32)
        where = np.empty((len(starts), FILTERS), np.int64)
        for k, s in enumerate(starts):
            e = min(s + CHUNK, n)
            z = np.multiply.outer(r[s:e], self.run)
            for j in range(WIDTH):
                z += self.table[j][b[s + j:e + j]]
            at = z.argmax(0)
            best[k], where[k] = z[at, np.arange(FILTERS)], s + at
        return best + self.bias, where

    def features(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        on = np.maximum(best, 0)
        return np.concatenate([on.max(0), on.mean(0)]), on

    def score(self, text: str | None) -> float:
        f, _ = self.features(self.pooled(*prepared(text))[0])
        return float(1 / (1 + np.exp(-float(f @ self.out + self.shift))))

    def fit(self, texts: list[str | None], ys: list[int], epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam on single documents' log loss, classes weighted evenly.  Only
        the bytes under a chunk's greatest response get a gradient."""
        rng = np.random.RandomState(seed)
        data = [prepared(t) for t in texts]
        y = np.array(ys)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params()]
        s1 = s2 = 0.0
        step = 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(data))
            for lo in range(0, len(order), 16):
                grads = [np.zeros_like(p) for p in self.params()]
                g_shift = 0.0
                part = order[lo:lo + 16]
                for i in part:
                    b, r = data[i]
                    best, where = self.pooled(b, r)
                    f, on = self.features(best)
                    p = 1 / (1 + np.exp(-float(f @ self.out + self.shift)))
                    d = np.float32((p - y[i]) * weight[i] / len(part))
                    grads[3] += d * f
                    g_shift += d
                    top, mean = self.out[:FILTERS] * d, self.out[FILTERS:] * d / len(best)
                    g = np.repeat(mean[None], len(best), 0)
                    g[on.argmax(0), np.arange(FILTERS)] += top
                    g *= best > 0
                    ks, fs = np.nonzero(g)
                    v, pos = g[ks, fs], where[ks, fs]
                    for j in range(WIDTH):
                        np.add.at(grads[0][j], (b[pos + j], fs), v)
                    np.add.at(grads[1], fs, v * r[pos])
                    np.add.at(grads[2], fs, v)
                step += 1
                fix = np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                for p, g, (m, v) in zip(self.params(), grads, state):
                    g += DECAY * p
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    p -= rate * fix * m / (np.sqrt(v) + 1e-8)
                s1 = 0.9 * s1 + 0.1 * g_shift
                s2 = 0.999 * s2 + 0.001 * g_shift ** 2
                self.shift = np.float32(self.shift - rate * fix * s1 / (np.sqrt(s2) + 1e-8))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All sampled rows of the one training task: one row, the network."""
    rows = [(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    rows.sort(key=lambda r: (r[1], r[0] or ""))
    texts, ys = [t for t, _ in rows], [y for _, y in rows]
    if len(set(ys)) == 2:
        net = Network()
        net.fit(texts, ys)
    else:
        net = (sum(ys) + 0.5) / (len(ys) + 1)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(model.value)
        for batch in batches:
            scores = [net.score(t) if isinstance(net, Network) else net for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])
    return run


def score_quality(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1,
                  good: int = GOOD, bad: int = BAD, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``
    (doc_id, text)."""
    spark = docs.sparkSession
    d = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = sample_labels(labels, "quality", mod, held, {0: bad, 1: good})
    taught = durable(d.join(F.broadcast(sample), d.doc_id == sample.id).select("doc_id", "text", "y"), "taught")
    size = taught.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    share = int(min(1.0, text_bytes / max(1, size)) * 2 ** 31)
    part = taught.where(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(2 ** 31)) < share)
    net = part.select("text", "y").coalesce(1).mapInArrow(_trained, "net binary").first()
    net = net["net"] if net else pickle.dumps(0.5)
    out = d.mapInArrow(_scored(spark.sparkContext.broadcast(net)), "doc_id long, score double")
    held_out = F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(mod)) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
