"""Risk-coverage areas under many sets of cluster weights at once (BST1-BST4, MET12).

A replicate weighs clusters, so it is a column of a matrix of clusters by replicates. Rows,
summed to (slice, score, cluster) beforehand, are range-sorted by slice and score and
written once. Every range sums its weighted rows and errors to vectors with one entry
for each replicate; elementwise prefix sums over the ranges, a few numbers each, give what
lies before a range; then each range goes through its rows once more and adds up its part
of the area for all replicates. What is shuffled are the rows and one vector for each range
and slice: rows are never multiplied by replicates.

Leaving out each cluster in turn is the same with weights of one less a unit vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import checkpointed

#: Entries of the weight matrix that are broadcast at most, two bytes each.
MAX_WEIGHTS = 1 << 27
#: Rows, and weighted rows (rows times replicates), that are worked on at a time. A block has some dozen arrays of
#: so many doubles, half a MB each, so that a worker's memory doesn't grow with the rows of its range.
ROWS = 1024
CELLS = 1 << 16
_TABLE = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, 1024))])


def harmonic(n: np.ndarray) -> np.ndarray:
    """1 + 1/2 + ... + 1/n of whole numbers: a table, then the asymptotic series."""
    x = np.maximum(n, 1)
    series = np.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x**4)
    return np.where(n < len(_TABLE), _TABLE[np.minimum(n, len(_TABLE) - 1).astype(np.int64)], series)


@dataclass
class Weights:
    """Weights of ``size`` replicates; without a matrix, replicate k leaves out cluster k."""

    size: int
    matrix: np.ndarray | None = None

    def of(self, cluster: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """[rows x replicates from lo to hi] for the clusters of some rows."""
        if self.matrix is not None:
            return self.matrix[cluster, lo:hi].astype(np.float64)
        out = np.ones((len(cluster), hi - lo))
        own = (cluster >= lo) & (cluster < hi)
        out[np.flatnonzero(own), cluster[own] - lo] = 0
        return out


def _blocks(rows: int, width: int) -> Iterator[tuple[int, int]]:
    step = max(1, CELLS // max(rows, 1))
    yield from ((lo, min(lo + step, width)) for lo in range(0, width, step))


def add_up(m: np.ndarray, e: np.ndarray, cluster: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of rows and errors in each replicate."""
    out = np.zeros((2, w.size))
    for at in range(0, len(m), ROWS):
        part = slice(at, at + ROWS)
        for lo, hi in _blocks(len(m[part]), w.size):
            weight = w.of(cluster[part], lo, hi)
            out[0, lo:hi] += m[part] @ weight
            out[1, lo:hi] += e[part] @ weight
    return out[0], out[1]


def areas(first: np.ndarray, m: np.ndarray, e: np.ndarray, cluster: np.ndarray, before: np.ndarray, w: Weights) -> np.ndarray:
    """What some groups of tied rows (starting at ``first``) add to each replicate's area; ``before`` (rows, errors) is moved on."""
    total = np.zeros(w.size)
    for lo, hi in _blocks(len(m), w.size):
        weight = w.of(cluster, lo, hi)
        rows, errors = np.add.reduceat(weight * m[:, None], first), np.add.reduceat(weight * e[:, None], first)
        n1 = before[0, lo:hi] + np.cumsum(rows, 0)
        c1 = before[1, lo:hi] + np.cumsum(errors, 0)
        n0, c0 = n1 - rows, c1 - errors
        share = errors / np.maximum(rows, 1)
        total[lo:hi] += np.where(rows > 0, errors + (c0 - share * n0) * (harmonic(n1) - harmonic(n0)), 0).sum(0)
        before[0, lo:hi], before[1, lo:hi] = n1[-1], c1[-1]
    return total


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Consecutive rows with equal keys."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy() for k in keys]
        edge = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], 0)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            yield tuple(batch.column(k)[a].as_py() for k in keys), batch.slice(a, b - a)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def replicate_areas(rows: DataFrame, by: list[str], order: list[str], w: Weights) -> DataFrame:
    """by, replicate, aurc of rows with ``order``, cluster (its number), m and e; rows that agree in ``order`` tie."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(w)  # bounded by MAX_WEIGHTS, or just a number
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = [T.StructField(c, rows.schema[c].dataType) for c in by]
    vectors = T.StructType([T.StructField("part", T.IntegerType()), *kinds, T.StructField("rows", T.BinaryType()), T.StructField("errors", T.BinaryType())])
    ranged = checkpointed(rows.repartitionByRange(parts, *by, *order).select("*", F.spark_partition_id().alias("part")), "weighted-rows")
    keys = ["part", *by]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(columns)] + [pa.array([v[i].tobytes() for v in held.values()], pa.binary()) for i in (0, 1)], schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(k) for k in keys] + [pa.field("rows", pa.binary()), pa.field("errors", pa.binary())])
            for key, run in _runs([batch], keys):
                got = np.stack(add_up(*_numbers(run, "m", "e", "cluster"), shared.value))
                held[key] = held[key] + got if key in held else got
            if len(held) > 64:  # their sum doesn't depend on where they are cut
                yield out()
                held = {}
        if held:
            yield out()

    def prefix(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        part = table.column("part").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))
        got = [np.add.reduceat(np.frombuffer(b"".join(table.column(c).to_pylist()), np.float64).reshape(len(part), -1), first) for c in ("rows", "errors")]
        before = [np.cumsum(x, 0) - x for x in got]
        out = table.take(pa.array(first)).combine_chunks()
        for c, x in zip(("rows", "errors"), before, strict=True):
            out = out.set_column(out.schema.get_field_index(c), c, pa.array([v.tobytes() for v in x], pa.binary()))
        return out.select(vectors.names)

    own = ranged.select(*keys, *order, "cluster", "m", "e")
    sorted_ = own.sortWithinPartitions(*keys)
    # one row for each range and slice in it
    before = sorted_.mapInArrow(sums, vectors).groupBy(*by).applyInArrow(prefix, vectors)
    offset = before.select(*keys, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order], F.lit(0).cast("int").alias("cluster"), F.lit(0.0).alias("m"), F.lit(0.0).alias("e"), "rows", "errors", F.lit(0).alias("kind"))
    both = own.select(*keys, *order, F.col("cluster").cast("int").alias("cluster"), F.col("m").cast("double").alias("m"), F.col("e").cast("double").alias("e"), F.lit(None).cast("binary").alias("rows"), F.lit(None).cast("binary").alias("errors"), F.lit(1).alias("kind")).union(offset)
    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions(*keys, "kind", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, state, schema = shared.value, None, None
        held: list[pa.RecordBatch] = []
        total, now, key = np.zeros(w.size), np.zeros((2, w.size)), None

        def use(whole: bool) -> None:
            """Add up the rows held; unless ``whole`` the last tied group may go on and waits."""
            nonlocal held, total
            table = pa.Table.from_batches(held).combine_chunks()
            codes = [table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() for c in order]
            new = np.concatenate([[True], np.any([np.diff(c) != 0 for c in codes], 0)])
            first = np.flatnonzero(new)
            stop = table.num_rows if whole else int(first[-1])
            if stop:
                m, e, cluster = (table.column(c).to_numpy()[:stop] for c in ("m", "e", "cluster"))
                total += areas(first[first < stop], m, e, cluster, now, w)
            held = table.slice(stop).to_batches() if stop < table.num_rows else []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], schema.field(i).type) for i, k in enumerate(key)] + [pa.array([total.tobytes()], pa.binary()), pa.array([now[0].tobytes()], pa.binary())], schema=schema)

        for k, batch in _runs(batches, [*keys, "kind"]):
            schema = schema or pa.schema([batch.schema.field(c) for c in keys] + [pa.field("rows", pa.binary()), pa.field("errors", pa.binary())])
            if k[:-1] != key:
                if key is not None and state:
                    if held:
                        use(True)
                    yield out()
                key, held, total, state = k[:-1], [], np.zeros(w.size), True
            if k[-1] == 0:
                now = np.stack([np.frombuffer(batch.column(c)[0].as_py(), np.float64) for c in ("rows", "errors")]).copy()
            else:
                for at in range(0, batch.num_rows, ROWS):
                    held.append(batch.slice(at, ROWS))
                    if sum(b.num_rows for b in held) >= ROWS:
                        use(False)
        if state:
            if held:
                use(True)
            yield out()

    result = T.StructType([*kinds, T.StructField("replicate", T.IntegerType()), T.StructField("aurc", T.DoubleType())])

    def whole(table: pa.Table) -> pa.Table:
        """The last range of a slice knows its number of weighted rows."""
        area, rows_ = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.float64).reshape(table.num_rows, -1) for c in ("rows", "errors"))
        area, n = area.sum(0), rows_.max(0)
        some = np.flatnonzero(n > 0)
        slice_ = [pa.array([table.column(c)[0].as_py()] * len(some), table.schema.field(c).type) for c in by]
        return pa.Table.from_arrays([*slice_, pa.array(some.astype(np.int32)), pa.array(area[some] / n[some])], names=[*by, "replicate", "aurc"])

    return dealt.mapInArrow(run, vectors).groupBy(*by).applyInArrow(whole, result)
