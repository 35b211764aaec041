"""Whitening of embeddings by the eigenvectors of their exactly centred covariance.

An entry c becomes the whole number floor(64 c) + 1,000,000, so the sums S over all
n vectors are exact, and n x - S, the centred vector times n, is a whole number too.
Divided by n once, rows of that kind go through MLlib's ``RowMatrix``, whose Gramian
divided by n is the covariance. Its eigenvectors are found on the driver (a matrix of
dimensions by dimensions, whatever the number of rows) and broadcast; the rows are
whitened in ``mapInPandas``. What was whitened goes through a ``RowMatrix`` once more,
centred by its own mean, and gives the largest deviation from the identity.

Nothing is shuffled but one row of sums per partition and dimension.

Defined cases: vectors that are null, empty or hold null or non-finite entries take no
part, nor do those of another length than most (of lengths as frequent, the longest
stays); ids may be null or repeat, and equal rows count each; an empty table gives an
empty result, and so does one of equal vectors, which have no direction of any
variance; of a covariance without full rank only the components above its rounding
are returned; columns other than id and vector are not read, whatever their names.
Entries that 64 c takes beyond 2^40, more than ``MAX_DIMENSIONS`` dimensions, and
deviations beyond a long are refused, not rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 40
MAX_DIMENSIONS = 4096


@dataclass
class Whitener:
    n: int
    sums: np.ndarray
    #: Columns are unit eigenvectors, by falling eigenvalue.
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def whole(rows: pd.Series | list) -> np.ndarray:
    """[rows x dimensions] of whole numbers."""
    c = np.stack(rows).astype(np.float64) * SCALE
    if np.abs(c).max(initial=0) > LARGEST:
        raise ValueError(f"an entry is beyond {LARGEST / SCALE:.3g}")
    return np.floor(c).astype(np.int64) + SHIFT


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their length."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fine))
    most = rows.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("x")).first()["x"]
    d = most["d"] if most else 0
    if d > MAX_DIMENSIONS:
        raise ValueError(f"more than {MAX_DIMENSIONS} dimensions")
    return rows.where(F.size("v") == d), d


def exact_sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of vectors and the sum of each dimension: a partition sends one row for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(d, np.int64)
        for batch in batches:
            if len(batch):
                n, total = n + len(batch), total + whole(batch["v"]).sum(0)
        yield pd.DataFrame({"dimension": np.arange(-1, d, dtype=np.int32), "x": np.concatenate([[n], total])})

    # d + 1 rows come to the driver
    got = {r["dimension"]: int(r["x"]) for r in rows.select("v").mapInPandas(run, "dimension int, x long").groupBy("dimension").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(d)], np.int64)


def covariance(rows: DataFrame, column: str, n: int, d: int) -> np.ndarray:
    """Gramian of centred rows (an array column) divided by n."""
    vector = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    return RowMatrix(vector, n, d).computeGramianMatrix().toArray() / n


def centred(n: int, sums: np.ndarray, v: str = "v"):
    """The centred vector as an expression: (n x - S) / n with whole numbers up to the division."""
    s = F.array(*[F.lit(int(x)) for x in sums])
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT))
    return F.zip_with(x, s, lambda a, b: (a * F.lit(n) - b).cast("double") / F.lit(float(n)))


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of all rows (vec_id, v) of length d; None without rows."""
    n, sums = exact_sums(rows, d)
    if not n:
        return None
    if n * (2 * (LARGEST + SHIFT)) >= 1 << 63 and n * int(np.abs(sums).max()) >= 1 << 63:
        raise ValueError("too many vectors for whole numbers of 64 bits")
    v = covariance(rows.select(centred(n, sums).alias("c")), "c", n, d)
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    real = values > max(values[0], 0) * d * np.finfo(float).eps * 16
    some = np.flatnonzero(real)[:components]
    return Whitener(n, sums, vectors[:, some], values[some], float(np.trace(v)))


def _whitened(w: Whitener, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S, whitened rows)."""
    times_n = x * w.n - w.sums
    return times_n, (times_n / w.n) @ (w.vectors / np.sqrt(w.values))


def _deviation(times_n: np.ndarray) -> np.ndarray:
    """Exact sums of squares; those that could pass a long are summed as unbounded integers."""
    large = (times_n.astype(np.float64) ** 2).sum(1) > 2.0**62
    out = np.where(large, 0, (times_n * times_n).sum(1))
    for i in np.flatnonzero(large):
        exact = sum(int(x) ** 2 for x in times_n[i])
        if exact >= 1 << 63:
            raise ValueError("a deviation is beyond a long")
        out[i] = exact
    return out


def apply(rows: DataFrame, w: Whitener) -> DataFrame:
    """vec_id, deviation, whitened (an array, one entry for each component) of each row."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(w)  # dimensions x components

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                times_n, z = _whitened(shared.value, whole(batch["v"]))
                yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation": _deviation(times_n), "whitened": list(z)})

    out = T.StructType([rows.schema["vec_id"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInPandas(run, out)


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest entry of |covariance - identity| of all whitened rows, centred by their own mean."""
    mean = whitened.agg(*[F.avg(F.col("whitened")[i]) for i in range(k)]).first()
    rest = whitened.select(F.zip_with("whitened", F.array(*map(F.lit, mean)), lambda a, m: a - m).alias("c"))
    return float(np.abs(covariance(rest, "c", n, k) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = vectors.schema[id_col].dataType
    out = T.StructType([T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("n", "deviation")], *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    small_batches(vectors.sparkSession)
    rows, d = usable(vectors, id_col, vector_col)
    w = fit(rows, d, components) if d else None
    if w is None or not len(w.values):
        return vectors.sparkSession.createDataFrame([], out)
    found = apply(rows, w)
    error = identity_error(found, w.n, len(w.values))
    explained = F.array(*[F.lit(float(e / w.trace)) for e in w.values])
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
