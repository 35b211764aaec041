"""Quality classifier by positive-unlabelled learning.

Trusted positives (quality 1) and unlabelled web text train a small network by
the non-negative unbiased risk: with class prior p, p * loss(positives as 1) +
max(0, loss(unlabelled as 0) - p * loss(positives as 0)); where the second term
goes negative, its gradient is reversed. The prior is estimated from positives and
unlabelled text alone: a network that tells the two apart is fitted on one half of
each, and on the other halves the share of unlabelled rows above a score, divided
by that of the positives, is taken where its upper confidence bound is lowest.

Scores become probabilities by the same three things: out-of-fold scores of positives
and unlabelled rows, and the prior p. With the logistic loss the unbiased risk of a
score g = slope z + offset is the mean of log(1 + e^g) over unlabelled rows less p times
the mean of g over positives, which is convex; its minimum fixes slope and offset, and
there the mean probability of unlabelled rows is the prior. The weight of the hashed
features is the one of ``WEIGHTS`` whose networks have the least such risk on rows they
were not fitted on. So a labelled negative is never read, nor any held-out label.

Features are byte frequencies, hashed words, hashed character trigrams and some
measures of words of the whole text, never id, language, source or labels.

Bounds (parameters): ``max_positive`` trusted and ``max_unlabelled`` unlabelled
rows; every text is scored as a whole.

Defined cases: a null text is an empty one and gets a score too; a text of any
length is read whole; texts with equal features get equal scores; an empty table
gives an empty one; without trusted positives every score is 0.5; with fewer than
``LEAST`` positives or unlabelled rows the prior is 0.5; without unlabelled rows
the labelled ones, their labels unread, are the web text; ids may be null or
repeat, each row gives a row, a null id counts as held out, and of several labels
of an id each one counts; columns other than those named are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, grams, held_out, mix, released, small_batches, spread, utf8, words

MAX_POSITIVE = 4000
MAX_UNLABELLED = 10_000
CUT = 0.3
HIDDEN = 24
EPOCHS = 40
#: Cells of hashed words and of hashed trigrams; the weights beside the other features to choose from.
CELLS = 256
PLAIN = 264
WEIGHTS = (0.05, 0.1, 0.2)
#: Rows of either kind below which no prior is estimated.
LEAST = 20


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float
    slope: float
    offset: float
    weight: float


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes of each document."""
    if not len(h):
        return np.zeros(n)
    key = mix(h + mix(doc.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(key, return_index=True)
    return np.bincount(doc[at], minlength=n).astype(np.float64)


def _cells(of: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """Square root of each cell's share of the text, in steps of 1/255."""
    counts = np.bincount(of * CELLS + cell, minlength=n * CELLS).reshape(n, CELLS)
    return np.rint(255 * np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)))


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[texts x (256 byte frequencies, 8 measures, cells of words, cells of trigrams)] of the texts."""
    off = off - off[0]
    n, size = len(off) - 1, np.diff(off)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 256 + raw, minlength=n * 256).reshape(n, 256).astype(np.float64)
    w, first, start, end = words(raw, off)
    nw = np.diff(first)
    of = np.repeat(np.arange(n), nw)
    per = np.maximum(nw, 1)
    length = np.bincount(of, end - start, n) / per
    g = grams(w, 8)
    inside = first[1:][of[: len(g)]] - np.arange(len(g)) >= 8
    windows = np.maximum(nw - 7, 0)
    upper = counts[:, 65:91].sum(1)
    letters = np.maximum(upper + counts[:, 97:123].sum(1), 1)
    more = np.stack([
        np.log1p(nw),
        length / 8,
        1 - _distinct(w, of, n) / per,
        1 - np.where(windows > 0, _distinct(g[inside], of[: len(g)][inside], n) / np.maximum(windows, 1), 1),
        upper / letters,
        counts[:, 10] / per,
        np.log1p(np.bincount(of, (end - start) > 20, n) / per * 10),
        (size == 0).astype(np.float64),
    ], 1)
    r = raw.astype(np.uint32)
    three = ((r[:-2] * np.uint32(0x9E3779B1)) ^ (r[1:-1] * np.uint32(0x85EBCA6B)) ^ (r[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    same = doc[:-2] == doc[2:]
    lexical = [_cells(of, (w >> np.uint64(56)).astype(np.int64), n), _cells(doc[:-2][same], (three[same] >> np.uint32(24)).astype(np.int64), n)]
    return np.concatenate([np.sqrt(counts / np.maximum(size, 1)[:, None]), more, *lexical], 1).astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = utf8(batch.column("text"))
        for at, to in chunks(off):
            x = features(raw[off[at] : off[to]], off[at : to + 1])
            packed = [a.tobytes() + b.tobytes() for a, b in zip(x[:, :PLAIN], x[:, PLAIN:].astype(np.uint8), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y").slice(at, to - at), batch.column("h").slice(at, to - at), pa.array(packed, pa.binary())], ["y", "h", "x"])


def _unpacked(rows: list[bytes]) -> np.ndarray:
    flat = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return np.concatenate([np.ascontiguousarray(flat[:, : 4 * PLAIN]).view(np.float32), flat[:, 4 * PLAIN :]], 1, dtype=np.float32)


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, weight: float) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    z[:, PLAIN:] *= weight
    return z


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    h = np.tanh(x @ a + b)
    return h, (h @ c)[:, 0] + x @ d[:-1] + d[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nn_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of some scores, and the gradients to follow for positives and unlabelled ones."""
    sp, su = _sigmoid(zp), _sigmoid(zu)
    rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    value = prior * np.logaddexp(0, -zp).mean() + max(0.0, rest)
    if rest >= 0:
        return value, prior * (sp - 1) / len(zp) - prior * sp / len(zp), su / len(zu)
    # the risk of the negatives can't be below 0: step back from what overfits it
    return value, prior * sp / len(zp), -su / len(zu)


def apart_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The plain logistic risk of telling positives from unlabelled rows."""
    return (np.logaddexp(0, -zp).mean() + np.logaddexp(0, zu).mean()) / 2, (_sigmoid(zp) - 1) / len(zp) / 2, _sigmoid(zu) / len(zu) / 2


def _fit_network(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int, epochs: int = EPOCHS, risk=nn_risk) -> list[np.ndarray]:
    """Adam on a risk of positives and unlabelled rows."""
    rng = np.random.default_rng(seed)
    d = pos.shape[1]
    layers = [x.astype(np.float32) for x in (rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, 1)), np.zeros(d + 1))]
    first, second, step = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers], 0
    batches = max(1, len(unl) // 512)
    for epoch in range(epochs):
        rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-5
        for p, u in zip(np.array_split(rng.permutation(len(pos)), batches), np.array_split(rng.permutation(len(unl)), batches), strict=True):
            if not len(p):
                p = rng.integers(0, len(pos), 64)
            x = np.concatenate([pos[p], unl[u]])
            h, z = _forward(x, layers)
            g = np.concatenate(risk(z[: len(p)], z[len(p) :], prior)[1:]).astype(np.float32)
            back = np.outer(g, layers[2][:, 0]) * (1 - h**2)
            grads = [x.T @ back + 1e-4 * layers[0], back.sum(0), h.T @ g[:, None] + 1e-4 * layers[2], np.append(x.T @ g, g.sum()) + 1e-4 * layers[3]]
            step += 1
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                layers[i] -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return layers


def share_of_positives(zp: np.ndarray, zu: np.ndarray, doubt: float = 0.1) -> float:
    """The prior by scores of rows that the scorer was not fitted on: the lowest upper bound over all cuts."""
    cut = np.sort(zp)[::-1]
    of_p = np.arange(1, len(cut) + 1) / len(cut)
    of_u = 1 - np.searchsorted(np.sort(zu), cut, "left") / len(zu)
    slack = np.sqrt(np.log(4 / doubt) / 2 / len(zu)) + np.sqrt(np.log(4 / doubt) / 2 / len(zp))
    best = ((of_u + 1.01 * slack) / of_p).argmin()
    return float(of_u[best] / of_p[best])


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int) -> float:
    """Share of positives among the unlabelled rows, from the two halves in turn."""
    if min(len(pos), len(unl)) < LEAST:
        return 0.5
    found = []
    for a in (0, 1):
        layers = _fit_network(pos[a::2], unl[a::2], 0.5, seed, 15, apart_risk)
        found.append(share_of_positives(_forward(pos[1 - a :: 2], layers)[1], _forward(unl[1 - a :: 2], layers)[1]))
    return float(np.clip(np.mean(found), 0.02, 0.98))


def pu_loss(gp: np.ndarray, gu: np.ndarray, prior: float) -> float:
    """Unbiased logistic risk of scores by positives and unlabelled rows."""
    return float(np.logaddexp(0, gu).mean() - prior * gp.mean())


def calibrate(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope (not negative) and offset of least unbiased risk, by Newton steps; a weak pull towards slope 1 keeps it finite."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * zu + b)
        w = p * (1 - p) + 1e-9
        grad = np.array([(p * zu).mean() - prior * zp.mean() + 1e-3 * (a - 1), p.mean() - prior])
        hess = np.array([[(w * zu * zu).mean() + 1e-3, (w * zu).mean()], [(w * zu).mean(), w.mean() + 1e-9]])
        da, db = np.linalg.solve(hess, grad)
        size = max(1.0, abs(da), abs(db))
        a, b = max(0.0, a - da / size), b - db / size
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def out_of_fold(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of either half by a network that was fitted on the other."""
    zp, zu = np.empty(len(pos)), np.empty(len(unl))
    for a in (0, 1):
        layers = _fit_network(pos[1 - a :: 2], unl[1 - a :: 2], prior, seed)
        zp[a::2], zu[a::2] = _forward(pos[a::2], layers)[1], _forward(unl[a::2], layers)[1]
    return zp, zu


def fit(pos: np.ndarray, unl: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int) -> Model:
    """Prior, weight of the hashed features, network, slope and offset of some features of positives and unlabelled rows."""
    at = lambda w: (_scaled(pos, mean, scale, w), _scaled(unl, mean, scale, w))
    middle = WEIGHTS[len(WEIGHTS) // 2]
    prior = estimate_prior(*at(middle), seed)
    best = None
    for w in WEIGHTS if min(len(pos), len(unl)) >= LEAST else ():
        zp, zu = out_of_fold(*at(w), prior, seed)
        slope, offset = calibrate(zp, zu, prior)
        risk = pu_loss(slope * zp + offset, slope * zu + offset, prior)
        if best is None or risk < best[0]:
            best = risk, w, slope, offset
    _, w, slope, offset = best or (0, middle, 1.0, 0.0)
    return Model(mean, scale, _fit_network(*at(w), prior, seed), prior, slope, offset, w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, seed: int = 5) -> Model | None:
    """Fit on bounded samples of the rows outside the held-out fold: labelled positives, and rows without a label.

    The samples are the rows of least seeded hashes of id and text, so they do not depend
    on files or order; rows that repeat count each, up to four times the bound.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(~held_out("id") & F.col("y").isin(0, 1))
    seen = known.where("y = 1").count()
    if not seen:
        return None
    part = lambda n, most: min(1.0, 1.2 * most / max(n, 1))
    unit = lambda c: F.shiftrightunsigned(c, 11) / float(1 << 53)
    # at most so many rows, so the join below sends a bounded table
    picked = known.where((F.col("y") == 1) & (unit(spread("id", seed)) < part(seen, max_positive))).orderBy(spread("id", seed), "id").limit(max_positive)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), id_col, text_col).alias("h")).where(~held_out("id"))
    total = plain.count()
    featured = lambda rows, most: [(r["h"], bytes(r["x"])) for r in rows.mapInArrow(released(_featured), "y int, h long, x binary").orderBy("h", "x").limit(most).select("h", "x").collect()]
    pos = featured(plain.join(F.broadcast(picked), "id").select("y", "h", "text"), 4 * max_positive)
    some = plain.where(unit(F.col("h")) < part(total, max_unlabelled))
    unl = featured(some.join(known.select("id").distinct(), "id", "left_anti").select(F.lit(-1).alias("y"), "h", "text"), 2 * max_unlabelled)
    if not pos:
        return None
    # all rows are labelled: the labelled ones, their labels unread, are the web text
    unl = unl or featured(some.select(F.lit(-1).alias("y"), "h", "text"), 2 * max_unlabelled)
    pos, unl = (_unpacked([x for _, x in sorted(rows)]) for rows in (pos, unl))
    return fit(pos, unl, unl.mean(0), np.maximum(unl.std(0), 1e-3), seed)


def _scores(raw: np.ndarray, off: np.ndarray, m: Model) -> np.ndarray:
    z = _forward(_scaled(features(raw, off), m.mean, m.scale, m.weight), m.layers)[1].astype(np.float64)
    return _sigmoid(m.slope * z + m.offset)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for at, to in chunks(off):
                s = np.full(to - at, 0.5) if m is None else _scores(raw[off[at] : off[to]], off[at : to + 1], m)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(id_col, text_col).mapInArrow(released(run), out)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Train outside the held-out fold and score all: doc_id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, label_col)
    return score(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = CUT) -> DataFrame:
    """The documents that score at least ``cut``, with all their columns."""
    model = train(docs, labels, id_col, text_col, label_col)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, off = utf8(batch.column(text_col))
            good = np.ones(batch.num_rows, bool)
            for at, to in chunks(off) if m is not None else ():
                good[at:to] = _scores(raw[off[at] : off[to]], off[at : to + 1], m) >= cut
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(released(run), docs.schema)
