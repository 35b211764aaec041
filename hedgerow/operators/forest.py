"""Extremely randomised trees (MDL4): one random cut for each drawn feature, the best of them splits a node.

A node's draws follow from seed, tree and the node's path alone, and costs from whole
counts of rows by class, so a tree doesn't depend on how it was grown. A training matrix of
bounded size is sent to the executors and each grows whole trees; a larger table stays
where it lies and all trees grow level by level: one pass finds each open node's ranges of
the features, the next counts the classes left of its cuts; either sends one row for each
partition, tree and node. Once a node has no more rows than that bound, they are dealt by
tree and node and one task grows what is below it. All ways give the same trees.

What comes to the driver is the forest, of at most ``MAX_NODES`` nodes. A tree is an array
of ``NODE`` (14 bytes a node) in the order root, left, right; as such it is sent, saved and
walked through, never as Python objects.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import checkpointed

#: Trees that grow together over a large table.
TREES_AT_A_TIME = 64
MAX_NODES = 40_000_000
#: A node: feature (-1: leaf), how far on its right child is (the left one is next), cut or a leaf's value.
NODE = np.dtype([("feature", "<i2"), ("right", "<i4"), ("number", "<f8")])
#: Rows that are worked on at a time in a pass.
ROWS = 8192


def draws(seed: int, tree: int, path: int, lo: np.ndarray, hi: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, cuts) that a node tries, from its ranges; a path is 1 at the root and doubles on the way down."""
    rng = np.random.default_rng([seed, tree, path])
    features = rng.permutation(np.flatnonzero(hi > lo))[:count]
    return features, rng.uniform(lo[features], hi[features])


def value(rows: np.ndarray, weight: np.ndarray) -> float:
    """Weighted share of label 1 among rows by class."""
    return float(rows[1] * weight[1] / (rows * weight).sum())


def choose(left: np.ndarray, rows: np.ndarray, weight: np.ndarray, leaf: int) -> int | None:
    """The cut of least impurity that leaves ``leaf`` rows on either side, the first in ties; ``left`` is [cuts x classes]."""
    best = None
    for i, part in enumerate(left):
        other = rows - part
        if min(part.sum(), other.sum()) < leaf:
            continue
        cost = sum(t * p * (1 - p) for t, p in (((s * weight).sum(), value(s, weight)) for s in (part, other)))
        if best is None or cost < best[0]:
            best = cost, i
    return best[1] if best else None


def open_node(rows: np.ndarray, leaf: int) -> bool:
    return rows.sum() >= 2 * leaf and rows.min() > 0


@dataclass
class Tree:
    """Inner nodes by path: feature and cut; rows by class of every node."""

    cuts: dict[int, tuple[int, float]] = field(default_factory=dict)
    rows: dict[int, np.ndarray] = field(default_factory=dict)

    def order(self, root: int = 1) -> list[int]:
        """Paths from a node on, the node first and left before right."""
        out, todo = [], [root]
        while todo:
            path = todo.pop()
            out.append(path)
            if path in self.cuts:
                todo += [2 * path + 1, 2 * path]
        return out

    def nodes(self, weight: np.ndarray) -> list[tuple]:
        """(feature, threshold, left, right, value), the root first and left before right; a leaf has feature -1."""
        order = self.order()
        at = {path: i for i, path in enumerate(order)}
        return [(*self.cuts[p], at[2 * p], at[2 * p + 1], value(self.rows[p], weight)) if p in self.cuts else (-1, 0.0, -1, -1, value(self.rows[p], weight)) for p in order]

    def packed(self, weight: np.ndarray, root: int = 1, below: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """The nodes as an array; ``below`` holds what was grown elsewhere, by the path it stands at."""
        below, parts, size = below or {}, [], {}
        for path in reversed(self.order(root)):  # children before their parents
            if path in below:
                part = below[path]
                size[path] = len(part)
            elif path in self.cuts:
                part = np.array([(self.cuts[path][0], 1 + size[2 * path], self.cuts[path][1])], NODE)
                size[path] = 1 + size.pop(2 * path) + size.pop(2 * path + 1)
            else:
                part, size[path] = np.array([(-1, 0, value(self.rows[path], weight))], NODE), 1
            parts.append(part)
        return np.concatenate(parts[::-1])


def grown(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int, tree: int, leaf: int, share: float, root: int = 1) -> Tree:
    """A tree, or what is below one of its nodes, of a matrix that is at hand; ``y`` holds 0 and 1, ``weight`` one number for each."""
    out, count = Tree(), max(1, int(share * x.shape[1]))
    todo = [(root, np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        out.rows[path] = np.bincount(y[rows], minlength=2)
        if not open_node(out.rows[path], leaf):
            continue
        part = x[rows]
        features, cuts = draws(seed, tree, path, part.min(0), part.max(0), count)
        below = part[:, features] <= cuts
        left = np.stack([(below & (y[rows] == k)[:, None]).sum(0) for k in (0, 1)], 1)
        best = choose(left, out.rows[path], weight, leaf)
        if best is not None:
            out.cuts[path] = int(features[best]), float(cuts[best])
            todo += [(2 * path + 1, rows[~below[:, best]]), (2 * path, rows[below[:, best]])]
    return out


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int, tree: int, leaf: int, share: float) -> list[tuple]:
    """The nodes of one whole tree."""
    return grown(x, y, weight, seed, tree, leaf, share).nodes(weight)


def unpacked(nodes: np.ndarray) -> list[tuple]:
    """(feature, threshold, left, right, value) of a packed tree; only leaves have a value."""
    rows = enumerate(nodes.tolist())
    return [(-1, 0.0, -1, -1, number) if f < 0 else (f, number, i + 1, i + right, None) for i, (f, right, number) in rows]


def _places(x: np.ndarray, cuts: dict[int, tuple[int, float]], open_: list[int]) -> list[tuple[int, np.ndarray]]:
    """The rows that stand at each of some open nodes."""
    wanted, out = set(open_), []
    needed = {p >> k for p in open_ for k in range(p.bit_length())}
    todo = [(1, np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        if not len(rows) or path not in needed:
            continue
        if path in wanted:
            out.append((path, rows))
        elif path in cuts:
            feature, cut = cuts[path]
            left = x[rows, feature] <= cut
            todo += [(2 * path, rows[left]), (2 * path + 1, rows[~left])]
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column("x").flatten().to_numpy().reshape(part.num_rows, -1), part.column("y").to_numpy()


def _ranges(rows: DataFrame, trees: dict[int, Tree], open_: dict[int, list[int]], width: int) -> dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]:
    """Least and largest value of each feature at each open node."""
    shared = rows.sparkSession.sparkContext.broadcast(({t: trees[t].cuts for t in open_}, open_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, wanted = shared.value
        held: dict[tuple, list[np.ndarray]] = {}
        for x, _ in _blocks(batches):
            for t, paths in wanted.items():
                for path, at in _places(x, cuts[t], paths):
                    lo, hi = x[at].min(0), x[at].max(0)
                    if (t, path) in held:
                        lo, hi = np.minimum(held[t, path][0], lo), np.maximum(held[t, path][1], hi)
                    held[t, path] = [lo, hi]
        columns = [pa.array([t for t, _ in held], pa.int32()), pa.array([str(p) for _, p in held], pa.string())]
        columns += [pa.array([v[side][i] for v in held.values()], pa.float64()) for side in (0, 1) for i in range(width)]
        yield pa.RecordBatch.from_arrays(columns, names)

    names = ["tree", "path", *[f"lo{i}" for i in range(width)], *[f"hi{i}" for i in range(width)]]
    found = rows.mapInArrow(run, "tree int, path string, " + ", ".join(f"{n} double" for n in names[2:]))
    got = found.groupBy("tree", "path").agg(*[F.min(f"lo{i}").alias(f"lo{i}") for i in range(width)], *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(width)]).toPandas()
    table = got[names[2:]].to_numpy()
    return {(int(t), p): (table[i, :width], table[i, width:]) for i, (t, p) in enumerate(zip(got["tree"], got["path"], strict=True))}


def _left(rows: DataFrame, trees: dict[int, Tree], tries: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]) -> dict[tuple[int, str], np.ndarray]:
    """[cuts x classes] of the rows at or below each drawn cut of each open node."""
    shared = rows.sparkSession.sparkContext.broadcast(({t: trees[t].cuts for t in tries}, tries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, wanted = shared.value
        held: dict[tuple, np.ndarray] = {}
        for x, y in _blocks(batches):
            for t, nodes in wanted.items():
                for path, at in _places(x, cuts[t], list(nodes)):
                    below = x[at][:, nodes[path][0]] <= nodes[path][1]
                    got = np.stack([(below & (y[at] == k)[:, None]).sum(0) for k in (0, 1)], 1)
                    held[t, path] = held[t, path] + got if (t, path) in held else got
        flat = [(t, str(p), i, int(a), int(b)) for (t, p), v in held.items() for i, (a, b) in enumerate(v)]
        columns = list(zip(*flat, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["tree", "path", "i", "n0", "n1"])

    got = rows.mapInArrow(run, "tree int, path string, i int, n0 long, n1 long").groupBy("tree", "path", "i").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas().sort_values("i")
    return {(int(t), p): part[["n0", "n1"]].to_numpy() for (t, p), part in got.groupby(["tree", "path"])}


def _below(rows: DataFrame, weight: np.ndarray, trees: dict[int, Tree], small: dict[int, list[int]], seed: int, leaf: int, share: float) -> dict[int, dict[int, np.ndarray]]:
    """What grows below some nodes, each in one task that gets the node's rows."""
    shared = rows.sparkSession.sparkContext.broadcast(({t: trees[t].cuts for t in small}, small))
    kinds = rows.schema["y"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, wanted = shared.value
        for x, y in _blocks(batches):
            for t, paths in wanted.items():
                for path, at in _places(x, cuts[t], paths):
                    x_ = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * x.shape[1], pa.int32()), pa.array(x[at].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array([str(path)] * len(at)), x_, pa.array(y[at])], ["tree", "path", "x", "y"])

    def run(table: pa.Table) -> pa.Table:
        t, path = table.column("tree")[0].as_py(), table.column("path")[0].as_py()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        tree = grown(x, table.column("y").to_numpy().astype(np.int64), weight, seed, t, leaf, share, int(path))
        return pa.table({"tree": pa.array([t], pa.int32()), "path": [path], "nodes": pa.array([tree.packed(weight, int(path)).tobytes()], pa.binary())})

    found = rows.mapInArrow(deal, f"tree int, path string, x array<double>, y {kinds}").groupBy("tree", "path").applyInArrow(run, "tree int, path string, nodes binary")
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in checkpointed(found, "below").collect():  # a row for each node, a part of the forest
        out.setdefault(r["tree"], {})[int(r["path"])] = np.frombuffer(r["nodes"], NODE)
    return out


def grow_by_levels(rows: DataFrame, weight: np.ndarray, width: int, ids: list[int], seed: int, leaf: int, share: float, most_rows: int = 0) -> list[np.ndarray]:
    """The trees of a table (x array, y 0 or 1), all open nodes of a level in two passes; nodes of ``most_rows`` rows at most are one task's each."""
    all_rows = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    root = np.array([all_rows.get(0, 0), all_rows.get(1, 0)])
    trees, count = {t: Tree(rows={1: root}) for t in ids}, max(1, int(share * width))
    open_ = {t: [1] for t in ids} if open_node(root, leaf) else {}
    small: dict[int, list[int]] = {}
    while open_:
        ranges = _ranges(rows, trees, open_, width)
        tries = {t: {p: draws(seed, t, p, *ranges[t, str(p)], count) for p in paths} for t, paths in open_.items()}
        left = _left(rows, trees, {t: {p: d for p, d in nodes.items() if len(d[0])} for t, nodes in tries.items()})
        new: dict[int, list[int]] = {}
        for t, nodes in tries.items():
            for p, (features, cuts) in nodes.items():
                best = choose(left[t, str(p)], trees[t].rows[p], weight, leaf) if len(features) else None
                if best is None:
                    continue
                trees[t].cuts[p] = int(features[best]), float(cuts[best])
                trees[t].rows[2 * p] = left[t, str(p)][best]
                trees[t].rows[2 * p + 1] = trees[t].rows[p] - left[t, str(p)][best]
                for q in (2 * p, 2 * p + 1):
                    if open_node(trees[t].rows[q], leaf):
                        (new if trees[t].rows[q].sum() > most_rows else small).setdefault(t, []).append(q)
        open_ = {t: paths for t, paths in new.items() if paths}
        _few(sum(len(t.rows) for t in trees.values()))
    below = _below(rows, weight, trees, small, seed, leaf, share) if small else {}
    return [trees[t].packed(weight, 1, below.get(t)) for t in ids]


def _few(nodes: int) -> None:
    if nodes > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes; ask for larger leaves")


def tree_values(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    f, right, v = nodes["feature"], nodes["right"], nodes["number"]
    at, i = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(i := i[f[at[i]] >= 0]):
        n = at[i]
        at[i] = n + np.where(x[i, f[n]] <= v[n], 1, right[n])
    return v[at]


@dataclass
class Forest:
    packed: list[np.ndarray]

    @property
    def trees(self) -> list[list[tuple]]:
        return [unpacked(t) for t in self.packed]

    def digest(self) -> str:
        whole = hashlib.sha256()
        for t in self.packed:
            whole.update(len(t).to_bytes(8, "little") + t.tobytes())
        return whole.hexdigest()

    def save(self, spark: SparkSession, folder: str) -> None:
        """Write the trees as a table of (tree, nodes)."""
        for at in range(0, len(self.packed), TREES_AT_A_TIME):
            some = [(at + i, bytearray(t.tobytes())) for i, t in enumerate(self.packed[at : at + TREES_AT_A_TIME])]
            spark.createDataFrame(some, "tree int, nodes binary").write.mode("append" if at else "overwrite").parquet(folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Forest:
        return Forest(_collected(spark.read.schema("tree int, nodes binary").parquet(folder)))

    def score(self, df: DataFrame, array: str = "features_array") -> Column:
        shared = df.sparkSession.sparkContext.broadcast(self.packed)  # bounded by MAX_NODES

        @F.pandas_udf("double")
        def mean(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=float)
            x, total = np.stack(rows.to_list()), np.zeros(len(rows))
            for t in shared.value:
                total += tree_values(t, x)
            return pd.Series(total / len(shared.value))

        return mean(F.col(array))


def _collected(table: DataFrame) -> list[np.ndarray]:
    """The trees of a written table, some at a time."""
    out, nodes, n = [], 0, table.count()
    for at in range(0, n, TREES_AT_A_TIME):
        for r in table.where(F.col("tree").between(at, at + TREES_AT_A_TIME - 1)).orderBy("tree").collect():
            out.append(np.frombuffer(r["nodes"], NODE))
            nodes += len(out[-1])
            _few(nodes)
    return out


def fit_forest(train: DataFrame, y: str = "y", trees: int = 600, leaf: int = 20, share: float = 0.7, seed: int = 1, most_rows: int = 200_000) -> Forest:
    """Extremely randomised trees with balanced classes.

    Up to ``most_rows`` training rows are sent to executors that grow whole trees; more of
    them are never collected. Rows without a label are left out.
    """
    spark = train.sparkSession
    rows = checkpointed(train.where(F.col(y).isNotNull()).select(F.col("features_array").cast("array<double>").alias("x"), F.col(y).cast("int").alias("y")), "forest-rows")
    per = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not per or not set(per) <= {0, 1}:
        raise ValueError("a forest needs labels 0 and 1")
    n = sum(per.values())
    weight = np.array([n / (len(per) * per[k]) if k in per else 1.0 for k in (0, 1)])
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if n > most_rows:
        made: list[np.ndarray] = []
        for at in range(0, trees, TREES_AT_A_TIME):
            made += grow_by_levels(rows, weight, width, list(range(at, min(at + TREES_AT_A_TIME, trees))), seed, leaf, share, most_rows)
            _few(sum(map(len, made)))
        return Forest(made)
    held = rows.toPandas()
    shared = spark.sparkContext.broadcast((np.stack(held["x"].to_list()), held["y"].to_numpy(np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, labels = shared.value
        for batch in batches:
            for i in batch["id"]:
                yield pd.DataFrame({"id": [i], "nodes": [grown(x, labels, weight, seed, int(i), leaf, share).packed(weight).tobytes()]})

    found = spark.range(trees).repartition(min(trees, 64)).mapInPandas(run, "id long, nodes binary")
    return Forest(_collected(checkpointed(found.select(F.col("id").cast("int").alias("tree"), "nodes"), "trees")))
