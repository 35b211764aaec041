"""Language identification by string kernels.

The kernel of two texts is the cosine of their blended-spectrum presence vectors:
which byte n-grams of orders 1 to 4 of the lower-case text occur, hashed into a
fixed number of cells. A bounded sample of labelled rows gives Nystroem landmarks
and a one-versus-rest kernel ridge regression on the landmark features. As the
kernel is a product of presence vectors, landmarks and regression fold into one
matrix [cells x languages], and texts are scored by batched matrix products.

Bounds (parameters): ``max_train`` labelled rows, spread evenly over languages but
at least two of each where there are, and ``max_landmarks`` of them, at least one
of each. More than ``MAX_LANGUAGES`` labels are refused, as the matrix would not fit
the driver; no label is left out. Every text is scored as a whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a
null label is no label; without any label all texts are ``und``; of equal votes the
label first in the alphabet wins; an empty table gives an empty one; a text of any
length is read whole; ids may be null or repeat, each row gives a row, and a null id
counts as held out; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, held_out, small_batches, spread, utf8

CELL_BITS = 15
ORDERS = 4
MAX_TRAIN = 3000
MAX_LANDMARKS = 256
RIDGE = 1e-3
#: Labels whose matrix fits the driver.
MAX_LANGUAGES = 1500
#: Rows of a presence matrix: bounds a worker's memory.
ROWS = 64


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # [cells x languages]


def presence(raw: np.ndarray, off: np.ndarray, bits: int = CELL_BITS, orders: int = ORDERS) -> np.ndarray:
    """[texts x cells] 1 where an n-gram of the text falls into the cell."""
    off = off - off[0]
    n = len(off) - 1
    out = np.zeros(n << bits, np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int64) << bits, np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(raw))
    h = np.zeros(len(raw), np.uint32)
    for k in range(1, orders + 1):
        if len(raw) < k:
            break
        h = h[: len(raw) - k + 1] * np.uint32(257) + raw[k - 1 :]
        cell = ((h + np.uint32(k * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        ok = left[: len(h)] >= k
        out[row[: len(h)][ok] + cell[ok]] = 1
    return out.reshape(n, 1 << bits)


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(texts.cast(pa.large_string())))


def _spans(off: np.ndarray) -> Iterator[tuple[int, int]]:
    for at, to in chunks(off):
        for i in range(at, to, ROWS):
            yield i, min(to, i + ROWS)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = _lowered(batch.column("text"))
        for at, to in _spans(off):
            bits = np.packbits(presence(raw[off[at] : off[to]], off[at : to + 1]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(at, to - at), pa.array([x.tobytes() for x in bits], pa.binary())], ["label", "bits"])


def _unit(bits: list[bytes]) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_train: int = MAX_TRAIN, max_landmarks: int = MAX_LANDMARKS, seed: int = 11) -> Model:
    """Fit on at most ``max_train`` of the rows or two of each language, the same number for each where there are enough."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), spread(id_col, seed).alias("h"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {label_col}; merge labels first")
    if not counts:
        return Model([], np.zeros((1 << CELL_BITS, 0), np.float32))
    each = max(2, max_train // len(counts))
    # about twice the wanted rows pass the hash, then exactly the smallest hashes of each language stay
    share = F.coalesce(F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, 2 * each / n))])[F.col("label")], F.lit(0.0))
    near = rows.where((F.shiftrightunsigned("h", 11) / float(1 << 53)) < share)
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))).where(F.col("k") <= each)
    got = first.select("label", "text").mapInArrow(_packed, "label string, bits binary").collect()
    got.sort(key=lambda r: (r["label"], bytes(r["bits"])))
    languages = sorted({r["label"] for r in got})
    by = {x: [i for i, r in enumerate(got) if r["label"] == x] for x in languages}
    rng = np.random.default_rng(seed)
    per = max(1, max_landmarks // len(languages))
    marks = [got[i]["bits"] for x in languages for i in rng.permutation(by[x])[:per]]
    land = _unit(marks)
    near_marks = np.concatenate([_unit([r["bits"] for r in got[i : i + 256]]) @ land.T for i in range(0, len(got), 256)]).astype(np.float64)
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    some = values > 1e-6 * values[-1]
    root = vectors[:, some] / np.sqrt(values[some])
    phi = near_marks @ root
    y = np.array([[float(r["label"] == x) for x in languages] for r in got])
    beta = np.linalg.solve(phi.T @ phi + RIDGE * len(got) * np.eye(phi.shape[1]), phi.T @ y)
    return Model(languages, (land.T @ (root @ beta)).astype(np.float32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (share of the best language in the positive votes)."""
    # cells x languages: bounded by the hash and the label set, whatever the corpus
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights = shared.value
        for batch in batches:
            raw, off = _lowered(batch.column(1))
            letters = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for at, to in _spans(off):
                if languages:
                    x = presence(raw[off[at] : off[to]], off[at : to + 1]).astype(np.float32)
                    votes = np.clip((x @ weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)), 1e-6, None)
                    best = votes.argmax(1)
                    score = votes[np.arange(len(votes)), best] / votes.sum(1)
                ok = letters[at:to] & bool(languages)
                names = [languages[best[i]] if ok[i] else "und" for i in range(to - at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(names), pa.array(np.where(ok, score if languages else 0.0, 0.0).astype(np.float64))], ["doc_id", "lang_pred", "score"])

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(id_col, text_col).mapInArrow(run, out)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Train on the rows outside the held-out fold and predict all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, label_col)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
