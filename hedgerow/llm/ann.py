"""Nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors are dealt to lists by k-means centroids that were fitted on a bounded
sample; every vector is indexed. A query scans its nearest lists. Inside a list
vectors are rotated by a random orthogonal matrix and laid out in column blocks;
the distance is summed block by block, and after each block a hypothesis test on
the rotated partial distance (its expectation is the block share of the whole,
its spread shrinks with the dimensions seen) abandons candidates that can hardly
be among the k nearest. What is left gets its exact distance on the original
vectors, in double precision.

Equal vectors are one entry: only the k + 1 smallest ids of each can ever be in a
result, and a filter on the rank before the shuffle keeps it at that. Equal
queries are searched once. Lists above ``LIST_ROWS`` entries, and the queries of a
list above ``QUERY_ROWS``, are split by a hash, so a task holds a bounded piece of both.

Defined cases: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, as query or as
candidate; ties go to the smaller id; of rows with the same id and vector one
takes part, rows that share an id but not the vector are candidates each, never
of a query with their id; an empty table or no query gives an empty result; a table with fewer candidates than k gives all of them
if the probed lists hold them, and lists are few for small tables so that they do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, spread

K = 10
SAMPLE = 20_000
MAX_LISTS = 4096
#: Lists of about this many entries where there are enough for that.
PER_LIST = 200
#: Share of the sample's own neighbours that the probed lists must hold; sets the number of probes.
COVERAGE = 0.97
MIN_PROBES = 8
LIST_ROWS = 20_000
QUERY_ROWS = 20_000
BLOCK = 16
#: Width of the test: larger abandons later.
EPSILON = 2.1


@dataclass
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int


def valid(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(v, ids): each different vector with its ``k + 1`` smallest ids."""
    v = F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0)).alias("v")  # one zero
    rows = vectors.where(F.col(id_col).isNotNull() & valid(vector_col)).select(F.col(id_col).cast("long").alias("id"), v).select("*", F.xxhash64("v").alias("h"))
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("h").orderBy("id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def fit(entries: DataFrame, n: int, seed: int = 3, sample: int = SAMPLE) -> Index:
    """Centroids from at most ``sample`` entries, and the rotation."""
    part = min(1.0, 1.2 * sample / max(n, 1))
    rows = entries.where((F.shiftrightunsigned(spread("h", seed), 11) / float(1 << 53)) < part).select("h", "v").orderBy(spread("h", seed), "v").limit(sample).collect()
    x = np.array([r["v"] for r in rows], np.float64)
    lists = int(min(MAX_LISTS, max(1, n // PER_LIST), max(1, len(x) // 20)))
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(12):
        near = _distances(x, centre).argmin(1)
        size = np.bincount(near, minlength=lists)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), lists)])
    rotation, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
    return Index(centre, rotation, _probes(x, centre, rng))


def _probes(x: np.ndarray, centre: np.ndarray, rng: np.random.Generator) -> int:
    """Fewest lists that hold ``COVERAGE`` of the neighbours of some sample vectors within the sample.

    The sample is sparser than the table, so its neighbours lie farther off and
    the number is on the safe side.
    """
    some = rng.permutation(len(x))[:300]
    of, order = _distances(x, centre).argmin(1), np.argsort(_distances(x[some], centre), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centre))[None, :], 1)
    ranks = []
    for i, s in enumerate(some):
        d = _distances(x[s : s + 1], x)[0]
        d[s] = np.inf
        ranks.append(place[i, of[np.argsort(d)[:K]]])
    need = int(np.quantile(np.concatenate(ranks), COVERAGE)) + 1
    return min(len(centre), max(MIN_PROBES, need))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :], 0)


def scan(queries: np.ndarray, base: np.ndarray, rotation: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query: positions and exact distances of about the k nearest rows of ``base``."""
    d = base.shape[1]
    columns = np.ascontiguousarray((base @ rotation).T)  # one row for each rotated dimension
    turned = queries @ rotation
    out = []
    for q, t in zip(queries, turned, strict=True):
        # a first block of candidates gives the bound that the others are tested against
        head = min(len(base), max(4 * k, 64))
        exact = np.sqrt(((base[:head] - q) ** 2).sum(1))
        pos, dist = np.arange(head), exact
        bound = np.partition(exact, k - 1)[k - 1] if head >= k else np.inf
        alive = np.arange(head, len(base))
        partial = np.zeros(len(alive))
        for lo in range(0, d, BLOCK):
            hi = min(d, lo + BLOCK)
            partial += ((columns[lo:hi, alive] - t[lo:hi, None]) ** 2).sum(0)
            if hi < d:
                ok = partial * (d / hi) <= (bound * (1 + EPSILON / np.sqrt(hi))) ** 2
                alive, partial = alive[ok], partial[ok]
        alive = alive[partial <= bound**2 * (1 + 1e-9) + 1e-12]
        if len(alive):
            pos = np.concatenate([pos, alive])
            dist = np.concatenate([dist, np.sqrt(((base[alive] - q) ** 2).sum(1))])
        if len(dist) > k:  # ties with the k-th stay
            near = dist <= np.partition(dist, k - 1)[k - 1]
            pos, dist = pos[near], dist[near]
        out.append((pos, dist))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest rows of ``vectors`` but itself."""
    spark = vectors.sparkSession
    entries = keep(distinct_vectors(vectors, id_col, vector_col, k), "ann-entries")
    sizes = entries.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n = sizes["width"], sizes["count"]
    right = entries.where(F.size("v") == width)
    index = fit(right, n)
    # centroids and rotation: at most MAX_LISTS vectors, whatever the table
    shared = spark.sparkContext.broadcast(index)
    wide = probes or index.probes

    def lists(count: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centre = shared.value.centroids
            for batch in batches:
                if len(batch):
                    far = _distances(np.stack(batch["v"].to_list()), centre)
                    batch["lists"] = np.argsort(far, axis=1, kind="stable")[:, :count].astype(np.int32).tolist()
                    yield batch

        return run

    base = keep(right.select("h", "v", "ids").mapInPandas(lists(1), "h long, v array<double>, ids array<long>, lists array<int>").select("h", "v", "ids", F.col("lists")[0].alias("list")), "ann-lists")
    parts = base.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("parts"))  # MAX_LISTS rows at most
    q = queries.where(F.col(id_col).isNotNull() & valid(vector_col) & (F.size(vector_col) == width)).select(F.col(id_col).cast("long").alias("query_id"), F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0)).alias("v")).distinct()
    q = keep(q.select("query_id", "v", F.xxhash64("v").alias("q")), "ann-queries")
    asked = q.groupBy("q", "v").agg(F.count(F.lit(1)).alias("n")).select("q", "v")
    asked = asked.mapInPandas(lists(wide), "q long, v array<double>, lists array<int>").select("q", "v", F.explode("lists").alias("list"))
    asked = keep(asked, "ann-asked")
    pieces = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("pieces"))
    cut = parts.join(pieces, "list")  # a list that no query asks for is not scanned
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    left = base.join(F.broadcast(cut), "list").select("h", "v", "list", F.pmod(F.hash("h"), F.col("parts")).alias("part"), every("pieces", "piece"))
    asked = asked.join(F.broadcast(cut), "list").select("q", "v", "list", every("parts", "part"), F.pmod(F.hash("q"), F.col("pieces")).alias("piece"))

    def search(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(wanted):
            return pd.DataFrame({"q": [], "h": [], "score": []})
        found = scan(np.stack(wanted["v"].to_list()), np.stack(rows["v"].to_list()), shared.value.rotation, k + 1)
        h, q_ = rows["h"].to_numpy(), wanted["q"].to_numpy()
        return pd.DataFrame({"q": np.repeat(q_, [len(p) for p, _ in found]), "h": np.concatenate([h[p] for p, _ in found]), "score": np.concatenate([s for _, s in found])})

    hits = left.groupBy("list", "part", "piece").cogroup(asked.groupBy("list", "part", "piece")).applyInPandas(search, "q long, h long, score double")
    # of the hits of all lists, the k + 1 nearest vectors and those as far as the last
    near = hits.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy("score"))).where(F.col("r") <= k + 1).drop("r")
    members = near.join(base.select("h", "ids"), "h").select("q", "score", F.explode("ids").alias("vec_id"))
    # k + 1 ids of each distinct query, so that one is left over for the query's own
    best = members.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    packed = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    own = q.join(packed, "q").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
