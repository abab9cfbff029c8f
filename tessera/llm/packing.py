"""Packing by concatenation and cuts at fixed places.

Pass one tokenizes every document and notes its place in the token stream of
its partition; prefix sums over the partitions' totals give each partition its
offset.  Pass two adds the two, so every document knows its place in the one
stream of the whole corpus without any task having seen more than its own
rows, and cuts it at the multiples of the sequence length.  Documents that
cross a cut become several pieces, marked as boundary records.

Only the last sequence can be padded.  Tokens written in pass one make the
order binding, whatever is lost and computed anew later.

Defined results.  A null or empty text has only the end token.  Repeated rows
are packed each; rows without doc_id too.  Other columns are ignored; an empty
table has no piece.
"""

from __future__ import annotations

import array
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import durable, small_batches

LENGTH = 2048
END = 1
CACHED_WORDS = 250_000        # in each of two generations
LATIN = "\u0250"          # letters below are Latin, each with one lower case


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable
    Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """Token ids of texts.

    With ``by_word`` the tokenizer must drop white space and join nothing
    across it; then the ids of white-space separated words are kept and used
    again.  A new word of Latin letters goes straight to the vocabulary's
    merges, after the tokenizer's own steps for such words (lower case, split
    into letters, digits and marks, bytes as letters); if that gives other ids
    than the tokenizer on the probe words, or the word has other letters, the
    tokenizer itself encodes it.  Otherwise whole texts are encoded."""

    # Fixed value: how the vocabulary's tokenizer splits a word.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    PROBES = ["Word", "été,", "don't", "a1b22c", "ÀÖ--x", "(Ñandú)!!", "l'ß", "x" * 40, "###", "'re"]

    def __init__(self, path: str, by_word: bool):
        from tokenizers import Tokenizer
        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.merges = self.tokenizer.model
        self.letters = byte_letters()
        self.known = Known(self.word)
        self.quick = by_word and all(self._merged(w) == self._whole([w])[0] for w in self.PROBES)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, word: str) -> bytes:
        ids: list[int] = []
        for piece in self.PIECES.findall(word.lower()):
            ids += [t.id for t in self.merges.tokenize("".join([self.letters[b] for b in piece.encode()]))]
        return array.array("I", ids).tobytes()

    def word(self, w: str) -> bytes:
        """Ids of a word that is not known yet."""
        if not (self.quick and (w.isascii() or (max(w) < LATIN and unicodedata.is_normalized("NFC", w)))
                and "<|" not in w and w.isprintable()):
            return self._whole([w])[0]
        low = w.lower()
        if low != w:
            return self.known[low]
        if len(w) > 1 and w[-1] in ",.!" and w[-2].isalpha():      # a mark after a letter is a piece of its own
            return self.known[w[:-1]] + self.known[w[-1]]
        return self._merged(w)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return self._whole([t or "" for t in texts])
        get = self.known.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) if t else b""
                for t in texts]


class Known(dict):
    """Ids of words; the words known longest without being asked for go first."""

    def __init__(self, word):
        super().__init__()
        self.word, self.old = word, {}

    def __missing__(self, w: str) -> bytes:
        ids = self.old.get(w)
        if ids is None:
            ids = self.word(w)
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[w] = ids
        return ids


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_word: bool) -> Encoder:
    """The worker's encoder, kept from task to task with the words it knows."""
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = Encoder(path, by_word)
    return _ENCODERS[path, by_word]


def _tokenized(path: str, by_word: bool, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part, at = encoder(path, by_word), TaskContext.get().partitionId(), 0
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                piece = batch.slice(k, 500)
                ids = [x + tail for x in encode(piece.column(1).to_pylist())]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(sizes)
                starts = at + ends - sizes
                at += int(ends[-1])
                every = np.frombuffer(b"".join(ids), "<u4")
                wide = every.max() > 0xFFFF
                if not wide:
                    narrow = every.astype("<u2").tobytes()
                    ids = [narrow[2 * (e - n):2 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts),
                     pa.array(sizes), pa.array([4 if wide else 2] * len(ids), pa.int32()),
                     pa.array(ids, pa.binary())], ["doc_id", "part", "at", "n", "width", "ids"])
    return run


def _cut(length: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            c = {n: batch.column(n) for n in ("doc_id", "at", "first", "width", "ids")}
            for doc, at, first, width, ids in zip(*(c[n].to_pylist() for n in ("doc_id", "at", "first", "width", "ids"))):
                ids = np.frombuffer(ids, f"<u{width}").astype("<u4")
                place, start = first + at, 0
                while start < len(ids):
                    size = min(length - (place + start) % length, len(ids) - start)
                    piece = ids[start:start + size].tobytes()
                    for col, x in zip(cols, (doc, start, size, zlib.crc32(piece), len(ids), (place + start) // length,
                                             (place + start) % length, size < len(ids),
                                             piece if keep_ids else None)):
                        col.append(x)
                    start += size
            kinds = [batch.schema.field("doc_id").type, *[pa.int64()] * 6, pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], NAMES)
    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary", "ids"]


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, by_word: bool = True,
         keep_ids: bool = True) -> DataFrame:
    """The pieces of all documents: doc_id, start and length in the document,
    crc32 of the piece's ids, doc_tokens, sequence_id and offset in it, whether
    a cut bounds the piece, and its ids (unsigned 32-bit, little-endian)."""
    d = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tokens = durable(d.mapInArrow(_tokenized(tokenizer, by_word, end),
                                  "doc_id long, part int, at long, n long, width int, ids binary"), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)     # one row a partition
    first = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    placed = tokens.join(F.broadcast(first), "part").select("doc_id", "at", "first", "width", "ids")
    return placed.mapInArrow(_cut(length, keep_ids),
                             "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                             "sequence_id long, offset long, boundary boolean, ids binary")


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, ids, padding): the pieces of each sequence in order; a
    group holds at most ``length`` tokens."""
    s = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"),
                                          F.sum("length").alias("n"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return s.select("sequence_id", joined.alias("ids"), (F.lit(length) - F.col("n")).cast("int").alias("padding"))
