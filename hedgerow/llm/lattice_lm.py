"""Language-model scores from a lattice over the pieces of an existing vocabulary.

A word is spelled by every sequence of pieces whose bytes, put together, are the word
behind its white-space marker. Each piece has a probability; the word's is the sum over
all of its segmentations, by the forward recursion in log space over byte positions, and
a text's is the product over its words and one end symbol. Pieces never cross a word,
so each distinct word of the corpus is worked on once, many words at a time.

The vocabulary, never changed here, gives pieces and scores: a unigram model's scores
are log probabilities; those of a merge model are negative ranks, which stand for
weights of one over the rank. Where the corpus says nothing these scores decide alone;
what the training texts add are the expected counts of the pieces under those scores
(forward and backward over the same lattices, weighted by the words' counts), and the
scores weigh in as ``STRENGTH`` pseudo-counts a piece. Single bytes are pieces too, so
every text has a probability. All sums of pieces and end symbol are one: it is a
distribution over sequences of pieces.

The words of a corpus are counted with partial sums before the shuffle. Words above
one in ``HEAVY`` of all tokens - fewer than ``HEAVY``, whatever the table - are broadcast
with their counts and scores; the others are joined by word, of which none is frequent.

Defined cases: a null or empty text is the end symbol alone; a text or word of any
length is read whole, a long word in blocks of positions; ids may be null (held out) or
repeat, each row gives a row; an empty table gives an empty one; without a training text
counts are 0 and the vocabulary's scores stand as they are; columns other than id and
text are not read, whatever their names. Words are told apart by 64-bit hashes inside a
text and in the table of frequent words, by their bytes elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, keep, small_batches, utf8, words
from .sp_codec import _BYTE, _CONTROL, _UNIGRAM, _UNKNOWN, MARK, _proto

ROUNDS = 2
STRENGTH = 1.0
HEAVY = 1 << 17
#: Words and bytes that are worked on at a time, and the cells (ends times lengths) of a block.
BATCH_WORDS = 20_000
BATCH_BYTES = 1 << 18
CELLS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = 32
_LN10 = float(np.log(10))


@dataclass
class Pieces:
    """Different byte strings of the vocabulary with their log probabilities; the last entry is the end symbol."""

    surfaces: list[bytes]
    logp: np.ndarray
    #: By length: (sorted hashes, indexes of the strings, filter on the upper bits).
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @property
    def longest(self) -> int:
        return max(self.tables)

    def weighted(self, logp: np.ndarray) -> Pieces:
        return Pieces(self.surfaces, logp, self.tables)


def _hash(x: bytes) -> np.uint64:
    h, power = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for b in reversed(x):
            h += np.uint64(b + 1) * power
            power *= _BASE
    return h


def pieces_of(weights: dict[bytes, float]) -> Pieces:
    """Pieces of byte strings (a marker is a blank) with weights; missing single bytes and the end get the least weight."""
    least = min(weights.values(), default=1.0)
    whole = dict(weights)
    for b in range(256):
        whole[bytes([b])] = whole.get(bytes([b]), 0.0) + least
    surfaces = sorted(whole)
    w = np.array([*(whole[s] for s in surfaces), least])
    tables, by = {}, {}
    for i, s in enumerate(surfaces):
        by.setdefault(len(s), []).append((int(_hash(s)), i))
    for k, rows in by.items():
        rows.sort()
        hashes = np.array([h for h, _ in rows], np.uint64)
        some = np.zeros(1 << 16, bool)
        some[(hashes * _SPREAD) >> np.uint64(48)] = True
        tables[k] = hashes, np.array([i for _, i in rows], np.int32), some
    return Pieces(surfaces, np.log(w / w.sum()), tables)


def vocabulary_pieces(model: bytes) -> Pieces:
    """The pieces of a model file by its scores."""
    m = _proto(model)
    weights: dict[bytes, float] = {}
    normal = [p for p in m.pieces if p.type not in (_UNKNOWN, _CONTROL, _BYTE)]
    last = len(normal) + 2
    for p in normal:
        w = float(np.exp(p.score)) if m.trainer_spec.model_type == _UNIGRAM else 1 / (1 + min(max(-p.score, 1.0), last))
        s = p.piece.replace(MARK, " ").encode()
        weights[s] = weights.get(s, 0.0) + w
    return pieces_of(weights)


class Lattice:
    """All segmentations of some words at once; ``raw`` holds each word behind a marker byte."""

    def __init__(self, raw: np.ndarray, size: np.ndarray, pieces: Pieces):
        """``size`` counts the bytes of each word with its marker."""
        self.pieces, self.raw = pieces, raw
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        self.byte = (np.cumsum(size) - size)[self.order]
        self.node = np.cumsum(self.size + 1) - self.size - 1
        longest = int(self.size[0])
        self.active = np.searchsorted(-self.size, -np.arange(1, longest + 1), "right")
        most = max(1, CELLS // pieces.longest)
        self.blocks, at = [], 1
        while at <= longest:  # places whose ends fit into a block, one place at least
            to, ends = at, 0
            while to <= longest and (to == at or ends + self.active[to - 1] <= most):
                ends += self.active[to - 1]
                to += 1
            self.blocks.append((at, to))
            at = to
        self.cache: dict[int, tuple] = {}

    def arcs(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log probability, piece) of [end x length] of a block, and the first end of each place."""
        if b in self.cache:
            return self.cache[b]
        at, to = self.blocks[b]
        n = self.active[at - 1 : to - 1]
        first = np.concatenate([[0], np.cumsum(n)])
        end = np.concatenate([self.byte[:a] + j for j, a in zip(range(at, to), n, strict=True)])
        width = min(self.pieces.longest, to - 1)
        logp, piece = np.full((len(end), width), -np.inf), np.full((len(end), width), -1, np.int32)
        h, power = np.zeros(len(end), np.uint64), np.uint64(1)
        for k in range(1, width + 1):
            lo = first[max(0, k - at)]  # ends at place k or later
            h[lo:] += (self.raw[end[lo:] - k].astype(np.uint64) + np.uint64(1)) * power
            with np.errstate(over="ignore"):
                power *= _BASE
            if k in self.pieces.tables:
                hashes, index, some = self.pieces.tables[k]
                maybe = lo + np.flatnonzero(some[(h[lo:] * _SPREAD) >> np.uint64(48)])
                place = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                hit = hashes[place] == h[maybe]
                piece[maybe[hit], k - 1] = index[place[hit]]
                logp[maybe[hit], k - 1] = self.pieces.logp[index[place[hit]]]
        if len(self.blocks) <= 8:
            self.cache[b] = logp, piece, first
        return logp, piece, first

    def forward(self) -> np.ndarray:
        """Log probability of every prefix of every word; ``logp_of`` picks the whole words."""
        alpha = np.full(int(self.node[-1] + self.size[-1] + 1), -np.inf)
        alpha[self.node] = 0
        for b, (at, to) in enumerate(self.blocks):
            logp, _, first = self.arcs(b)
            for j in range(at, to):
                k = np.arange(1, min(j, logp.shape[1]) + 1)
                here = self.node[: self.active[j - 1]] + j
                x = alpha[here[:, None] - k] + logp[first[j - at] : first[j - at + 1], : len(k)]
                top = x.max(1)
                alpha[here] = top + np.log(np.exp(x - top[:, None]).sum(1))
        self.alpha = alpha
        return alpha

    def logp_of(self) -> np.ndarray:
        """Log probability of each word, in the order of the words given."""
        out = np.empty(len(self.size))
        out[self.order] = self.forward()[self.node + self.size]
        return out

    def expected(self, counts: np.ndarray) -> np.ndarray:
        """Expected number of times each piece is used in the words, each weighted by its count."""
        alpha, total = self.forward(), np.zeros(len(self.pieces.logp))
        beta = np.full(len(alpha), -np.inf)
        beta[self.node + self.size] = 0
        weight, whole = counts[self.order].astype(np.float64), alpha[self.node + self.size]
        for b in range(len(self.blocks) - 1, -1, -1):
            at, to = self.blocks[b]
            logp, piece, first = self.arcs(b)
            for j in range(to - 1, at - 1, -1):
                n = self.active[j - 1]
                k = np.arange(1, min(j, logp.shape[1]) + 1)
                start = (self.node[:n] + j)[:, None] - k
                arc = logp[first[j - at] : first[j - at + 1], : len(k)] + beta[self.node[:n] + j][:, None]
                beta[start] = np.logaddexp(beta[start], arc)
                share = np.exp(alpha[start] + arc - whole[:n, None]) * weight[:n, None]
                used = piece[first[j - at] : first[j - at + 1], : len(k)]
                some = used >= 0
                total += np.bincount(used[some], share[some], minlength=len(total))
        return total


def _marked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the words, each behind a marker; their sizes with it)."""
    raw, off = utf8(texts)
    size = np.diff(off) + 1
    out = np.full(int(size.sum()), _SPACE, np.uint8)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(size) - size] = False
    out[inside] = raw
    return out, size


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to some thousand words."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.column("word").nbytes
        if rows >= BATCH_WORDS or size >= BATCH_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _taken(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Strings of the given bytes."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(raw[at].tobytes())).cast(pa.string())


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lower-cased bytes, word hashes, text of each word, start, end)."""
    low = _LOWER[raw]
    w, first, start, end = words(low, off)
    return low, w, np.repeat(np.arange(len(off) - 1), np.diff(first)), start, end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of some texts: in training texts, and in all."""
    for batch in batches:
        raw, off = utf8(batch.column("text"))
        train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        for at, to in chunks(off):
            low, w, doc, start, end = _words(raw[off[at] : off[to]], off[at : to + 1])
            _, one, which = np.unique(w, return_index=True, return_inverse=True)
            c = np.bincount(which, train[at:to][doc], minlength=len(one)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_taken(low, start[one], end[one]), pa.array(c), pa.array(np.bincount(which, minlength=len(one)).astype(np.int64))], ["word", "c", "n"])


@dataclass
class Corpus:
    #: word, c (in training texts), n (in all), logp: one row for each different word.
    table: DataFrame
    train_docs: int
    train_tokens: int
    distinct: int
    tokens: int
    end_logp: float


def held_out_1(doc_id: str) -> F.Column:
    """True for the fold that nothing is learned from: crc32 of the id as text, modulo 5, is 1; a null id belongs to it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(True))


def learn(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Corpus:
    """Count the words of all texts, fit the pieces to those of the training texts, score every different word."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(text_col).alias("text"), (~held_out_1(id_col)).alias("train"))
    train_docs = rows.where("train").count()
    counted = keep(rows.mapInArrow(_count, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-counts")
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    pieces = vocabulary_pieces(model)
    prior = np.exp(pieces.logp)
    for _ in range(rounds if train_docs else 0):
        shared = spark.sparkContext.broadcast(pieces)  # the vocabulary's size

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value.logp))
            for batch in _gathered(batches):
                total += Lattice(*_marked(batch.column("word")), shared.value).expected(batch.column("c").to_numpy())
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "x"])

        count = np.zeros(len(prior))
        # one number for each piece of the vocabulary
        for r in counted.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect():
            count[r["piece"]] = r["x"]
        count[-1] = train_docs
        weight = count + STRENGTH * len(prior) * prior
        pieces = pieces.weighted(np.log(weight / weight.sum()))
    shared = spark.sparkContext.broadcast(pieces)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            yield batch.append_column("logp", pa.array(Lattice(*_marked(batch.column("word")), shared.value).logp_of() / _LN10))

    table = keep(counted.mapInArrow(score, "word string, c long, n long, logp double"), "lm-words")
    return Corpus(table, train_docs, sums["c"] + train_docs, sums["v"] + (train_docs > 0), sums["n"], float(pieces.logp[-1]) / _LN10)


def score(docs: DataFrame, corpus: Corpus, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    heavy = F.col("n") > corpus.tokens // HEAVY
    few = corpus.table.where(heavy).toPandas()  # fewer than HEAVY
    whole = corpus.train_tokens + 0.5 * (corpus.distinct + 1)
    base_of = lambda c: F.log10((c + F.lit(0.5)) / F.lit(whole))
    known, off = utf8(pa.array(few["word"], pa.string()))
    hashes = words(known, off)[0]  # one word each
    order = np.argsort(hashes)
    c = few["c"].to_numpy(np.float64)[order]
    shared = spark.sparkContext.broadcast((hashes[order], c > 0, np.log10((c + 0.5) / whole), few["logp"].to_numpy()[order]))
    kind = docs.schema[id_col].dataType
    end = (1, int(corpus.train_docs > 0), float(np.log10((corpus.train_docs + 0.5) / whole)), corpus.end_logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums for each text, under a key that is no word, and one for each of its words that isn't frequent."""
        table, of_known, of_base, of_logp = shared.value
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            row = batch.column("row").to_numpy()
            for at, to in chunks(off):
                low, w, doc, start, stop = _words(raw[off[at] : off[to]], off[at : to + 1])
                n = to - at
                place = np.minimum(np.searchsorted(table, w), max(len(table) - 1, 0)) if len(table) else np.zeros(len(w), np.int64)
                hit = table[place] == w if len(table) else np.zeros(len(w), bool)
                d, p = doc[hit], place[hit]
                tokens = np.bincount(doc, minlength=n) + end[0]
                sums = [tokens, np.bincount(d, of_known[p], n).astype(np.int64) + end[1], np.bincount(d, of_base[p], n) + end[2], np.bincount(d, of_logp[p], n) + end[3]]
                texts = pa.StructArray.from_arrays([batch.column("doc_id").slice(at, n), batch.column("held_out").slice(at, n), *map(pa.array, sums)], ["doc_id", "held_out", "n_tokens", "n_known", "base", "logp"])
                yield pa.RecordBatch.from_arrays([pa.array(row[at:to]), pa.array([f" {r}" for r in row[at:to]]), pa.array(np.zeros(n, np.int64)), texts], ["row", "key", "times", "sums"])
                rest = np.flatnonzero(~hit)
                if len(rest):
                    rest = rest[np.lexsort((w[rest], doc[rest]))]
                    new = np.flatnonzero(np.concatenate([[True], (w[rest[1:]] != w[rest[:-1]]) | (doc[rest[1:]] != doc[rest[:-1]])]))
                    one, times = rest[new], np.diff(np.append(new, len(rest)))
                    yield pa.RecordBatch.from_arrays([pa.array(row[at + doc[one]]), _taken(low, start[one], stop[one]), pa.array(times), pa.nulls(len(one), texts.type)], ["row", "key", "times", "sums"])

    inner = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), *[T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known")], *[T.StructField(x, T.DoubleType()) for x in ("base", "logp")]])
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", T.StringType()), T.StructField("times", T.LongType()), T.StructField("sums", inner)])
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), held_out_1(id_col).alias("held_out"), F.col(text_col).alias("text"))
    parts = source.mapInArrow(run, out).join(corpus.table.where(~heavy).select(F.col("word").alias("key"), "c", "logp"), "key", "left")
    word = F.col("sums").isNull()
    add = lambda own, x: F.sum(F.when(word, F.col("times") * x).otherwise(F.col(f"sums.{own}")))
    return parts.groupBy("row").agg(
        F.max("sums.doc_id").alias("doc_id"),
        F.max("sums.held_out").alias("held_out"),
        F.sum("sums.n_tokens").alias("n_tokens"),
        add("n_known", (F.col("c") > 0).cast("long")).alias("n_known"),
        F.lit(corpus.train_tokens).cast("long").alias("train_tokens"),
        add("base", base_of(F.col("c"))).alias("base_score"),
        add("logp", F.col("logp")).alias("score"),
    ).drop("row")


def lattice_scores(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn outside the fold of remainder 1 and score every text."""
    return score(docs, learn(docs, model, id_col, text_col), id_col, text_col)
