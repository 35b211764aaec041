"""Paired cluster bootstrap (BST1-BST5).

Draws are a small table (replicate, cluster, weight): a cluster drawn twice counts
twice, so replicates are weights and rows are never copied. Rows are first summed
to (cluster, method, score); ``replicates`` then weighs those sums for all replicates at
once. Where the draws are too many to be broadcast as a matrix, weights are joined to
the sums instead. Statistics that are only added up need no table of draws: their hash
draws are weighed in blocks of clusters. All methods share the draws.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgerow.functions.hashing import SEED

from . import replicates as R
from .metrics import _harmonic
from .order import numbered, running

#: Clusters whose draws are made on the driver.
MAX_CLUSTERS = 100_000

#: Clusters whose weights are one row of a replicate's hash draws.
BLOCK = 1024


def numpy_draws(spark: SparkSession, clusters: list, replicates: int = 2000, seed: int = SEED) -> DataFrame:
    """Draws of the sorted clusters by numpy's generator, in its order: replicate, cluster, weight.

    The cluster list comes from the caller; it bounds this table. More than
    ``MAX_CLUSTERS`` are refused, ``hash_draws`` works for any number.
    """
    if len(clusters) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters for draws on the driver; use hash_draws")
    rng, keys, rows = np.random.default_rng(seed), sorted(clusters), []
    for b in range(replicates):
        picked, times = np.unique(rng.choice(len(keys), len(keys), replace=True), return_counts=True)
        rows += [(b, keys[i], int(n)) for i, n in zip(picked, times, strict=True)]
    kind = "long" if keys and isinstance(keys[0], int) else "string"
    return spark.createDataFrame(rows, f"replicate int, cluster {kind}, weight int")


def hash_draws(clusters: DataFrame, replicates: int, seed: int = SEED, within: list[str] | None = None) -> DataFrame:
    """Draws by seeded hashes: draw d of replicate b is cluster number hash(b:d) mod count, in cluster order.

    ``clusters`` has distinct rows: one column, and those ``within`` which the clusters
    are numbered and drawn apart.
    """
    within = within or []
    (name,) = [c for c in clusters.columns if c not in within]
    rows = clusters.withColumnRenamed(name, "cluster")
    if within:
        w = Window.partitionBy(*within)
        placed = rows.select("*", (F.row_number().over(w.orderBy("cluster")) - 1).cast("long").alias("place"), F.count(F.lit(1)).over(w).alias("n"))
    else:
        numbered_ = numbered(rows, ["cluster"], "place")
        placed = numbered_.crossJoin(F.broadcast(numbered_.agg(F.count(F.lit(1)).alias("n"))))
    asked = _asked(placed.groupBy(*within).agg(F.count(F.lit(1)).alias("n")), replicates)
    kinds = T.StructType([*[rows.schema[c] for c in within], T.StructField("replicate", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("weight", T.IntegerType())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (b, n) in enumerate(zip(batch.column("replicate").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                times = drawn(b, n, seed)
                some = np.flatnonzero(times)
                own = [pa.repeat(batch.column(c)[i], len(some)) for c in within]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(some), b, np.int32)), pa.array(some), pa.array(times[some].astype(np.int32))], kinds.names)

    picked = asked.select(*within, "replicate", "n").mapInArrow(draw, kinds)
    # Spark takes the draws for as few rows as the replicates, and would broadcast them
    return picked.join(placed.drop("n").hint("shuffle_hash"), [*within, "place"]).select(*within, "replicate", "cluster", "weight")


def _asked(sizes: DataFrame, replicates: int) -> DataFrame:
    """A row for each slice and replicate, over as many tasks as shuffle partitions."""
    spark = sizes.sparkSession
    return spark.range(0, replicates, 1, max(1, min(replicates, int(spark.conf.get("spark.sql.shuffle.partitions"))))).select(F.col("id").cast("int").alias("replicate")).crossJoin(F.broadcast(sizes))


def drawn(replicate: int, n: int, seed: int) -> np.ndarray:
    """How often each of n places is drawn in a replicate: the hashes of ``stable_u64``, modulo n."""
    out = np.zeros(n, np.int64)
    for at in range(0, n, 1 << 16):
        hashes = b"".join(hashlib.sha256(b"%d:%d:%d" % (seed, replicate, d)).digest()[:8] for d in range(at, min(at + (1 << 16), n)))
        np.add.at(out, (np.frombuffer(hashes, ">u8") % np.uint64(n)).astype(np.int64), 1)
    return out


def _weights(draws: DataFrame, clusters: list[str]) -> tuple[DataFrame, list, R.Weights] | None:
    """(numbers of the clusters, names of the replicates, weights); None where the matrix would be too large to send."""
    names = sorted(r[0] for r in draws.select("replicate").distinct().collect())
    count = draws.select(*clusters).distinct().count()
    if count * len(names) > R.MAX_WEIGHTS:
        return None
    got = draws.select(*clusters, "replicate", "weight").toPandas()
    code = got.groupby(clusters, sort=True, dropna=False).ngroup().to_numpy() if len(got) else np.empty(0, int)
    matrix = np.zeros((count, len(names)), np.uint16)
    if len(got):
        if got["weight"].max() > np.iinfo(np.uint16).max:
            return None
        np.add.at(matrix, (code, np.searchsorted(np.array(names), got["replicate"])), got["weight"].to_numpy(np.uint16))
    got["number"] = code
    table = got.drop_duplicates("number")[[*clusters, "number"]]
    numbers = draws.sparkSession.createDataFrame(table.to_dict("records"), draws.select(*clusters).withColumn("number", F.lit(0).cast("int")).schema) if len(got) else None
    return numbers, names, R.Weights(len(names), matrix)


def _areas(sums: DataFrame, draws: DataFrame, clusters: list[str], by: list[str], order: list[str]) -> DataFrame | None:
    """replicate, by, aurc of sums (m rows, e errors) of each cluster; None where the draws are too many for it."""
    found = _weights(draws, clusters)
    if not found or found[0] is None:
        return None
    numbers, names, w = found
    on = F.lit(True)
    for c in clusters:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    numbered_ = numbers.withColumnsRenamed({c: f"_{c}" for c in clusters})
    rows = sums.join(F.broadcast(numbered_), on).select(*by, *order, F.col("number").alias("cluster"), F.col("m").cast("double").alias("m"), F.col("e").cast("double").alias("e"))
    out = R.replicate_areas(rows, by, order, w)
    if names == list(range(len(names))):
        return out
    return out.withColumn("replicate", F.element_at(F.array(*map(F.lit, names)), F.col("replicate") + 1))


def bootstrap_aurc(scores: DataFrame, draws: DataFrame, method: str = "method", cluster: str = "cluster", y: str = "y", score: str = "score", within: list[str] | None = None) -> DataFrame:
    """Expected-tie AURC of each (replicate, method) over known labels, apart for each value of ``within``."""
    within = within or []
    sums = scores.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*within, method, cluster, score).agg(F.count(F.lit(1)).alias("m"), F.sum(F.col(y).cast("double")).alias("e"))
    found = _areas(sums, draws.withColumnRenamed("cluster", cluster), [*within, cluster], [*within, method], [score])
    if found is not None:
        return found.select("replicate", *within, method, "aurc")
    drawn = sums.join(draws.withColumnRenamed("cluster", cluster), [*within, cluster])
    per = drawn.groupBy("replicate", *within, method, score).agg(F.sum(F.col("m") * F.col("weight")).alias("m"), F.sum(F.col("e") * F.col("weight")).alias("e"))
    t = running(per, ["replicate", *within, method], [score], {"n1": "m", "c1": "e"}).select("*", (F.col("n1") - F.col("m")).alias("n0"), (F.col("c1") - F.col("e")).alias("c0"))
    part = F.col("e") + (F.col("c0") - F.col("e") / F.col("m") * F.col("n0")) * (_harmonic(F.col("n0") + F.col("m")) - _harmonic(F.col("n0")))
    return t.groupBy("replicate", *within, method).agg((F.sum(part) / F.sum("m")).alias("aurc"))


def paired_interval(per_replicate: DataFrame, method: str, first: str, second: str, value: str = "aurc", level: float = 0.95, within: list[str] | None = None) -> DataFrame:
    """Interval of the difference first - second over the replicates that have both (BST1, BST2), for each value of ``within``."""
    within = within or []
    both = per_replicate.groupBy(*within, "replicate").agg(F.max(F.when(F.col(method) == first, F.col(value))).alias("a"), F.max(F.when(F.col(method) == second, F.col(value))).alias("b"))
    d = F.col("a") - F.col("b")
    tail = (1 - level) / 2
    return both.where(d.isNotNull()).groupBy(*within).agg(F.count(F.lit(1)).alias("replicates"), F.avg(d).alias("mean_difference"), F.percentile(d, F.lit(tail)).alias("low"), F.percentile(d, F.lit(1 - tail)).alias("high"))


def bootstrap_operating_point(rows: DataFrame, draws: DataFrame, cluster: str = "cluster", y: str = "y", a: str = "keep_a", b: str = "keep_b") -> DataFrame:
    """Difference of known risk and of coverage between two fixed selections in each replicate."""
    known = F.col(y).isNotNull()
    cells = {f"{n}_{s}": F.sum(f.cast("long")) for s, k in (("a", F.col(a)), ("b", F.col(b))) for n, f in (("kept", k), ("known", k & known), ("err", k & known & (F.col(y) == 1)))}
    sums = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in cells.items()])
    per = sums.join(draws.withColumnRenamed("cluster", cluster), cluster).groupBy("replicate").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("n", *cells)])
    ratio = lambda s: F.col(f"err_{s}") / F.nullif(F.col(f"known_{s}"), F.lit(0))
    return per.select("replicate", (ratio("a") - ratio("b")).alias("risk_difference"), ((F.col("kept_a") - F.col("kept_b")) / F.col("n")).alias("coverage_difference"))


def _weighed(sums: DataFrame, replicates: int, columns: list[str], cluster: str, seed: int = SEED) -> DataFrame:
    """Weighted sums of each replicate of ``hash_draws``, without a row for each draw.

    A replicate's weights are cut into blocks of ``BLOCK`` clusters, a row each; a block's weights
    of all replicates meet the block's sums in one product.
    """
    placed = numbered(sums, [cluster], "place")
    asked = _asked(placed.agg(F.count(F.lit(1)).alias("n")), replicates)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n in zip(batch.column("replicate").to_pylist(), batch.column("n").to_pylist(), strict=True):
                times = drawn(b, n, seed).astype("<u4")
                blocks = [times[at : at + BLOCK].tobytes() for at in range(0, n, BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), b, np.int32)), pa.array(np.arange(len(blocks), dtype=np.int64)), pa.array(blocks, pa.binary())], ["replicate", "block", "weights"])

    def weigh(draws: pa.Table, stats: pa.Table) -> pa.Table:
        weights = np.frombuffer(b"".join(draws.column("weights").to_pylist()), "<u4").reshape(draws.num_rows, -1)
        own = weights[:, stats.column("at").to_numpy()].astype(np.int64)
        return pa.table([draws.column("replicate"), *[pa.array(own @ stats.column(c).to_numpy()) for c in columns]], ["replicate", *columns])

    drawn_ = asked.select("replicate", "n").mapInArrow(draw, "replicate int, block long, weights binary")
    # as in a join with the draws, a null cluster has a place, but no sums
    own = placed.where(F.col(cluster).isNotNull()).select(F.floor(F.col("place") / BLOCK).alias("block"), (F.col("place") % BLOCK).alias("at"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])
    kinds = T.StructType([T.StructField("replicate", T.IntegerType()), *[sums.schema[c] for c in columns]])
    parts = drawn_.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(weigh, kinds)
    return parts.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in columns])


def bootstrap_sums(stats: DataFrame, draws: DataFrame | int, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """Weighted sums of additive statistics in each replicate, summed by cluster first (BST5).

    ``draws`` may be the number of replicates: hash draws of all clusters of ``stats``, of which no table is made.
    """
    sums = stats.groupBy(cluster).agg(*[F.sum(c).alias(c) for c in columns])
    if isinstance(draws, int):
        return _weighed(sums, draws, columns, cluster)
    return sums.join(draws.withColumnRenamed("cluster", cluster), cluster).groupBy("replicate").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in columns])


def bootstrap_chrf(counts: DataFrame, draws: DataFrame | int, cluster: str = "cluster", orders: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF of each replicate (MET21, BST5): n-gram counts are summed by cluster once, and the sums weighed.

    ``counts`` has the cluster and ``chrf``, the counts of ``functions.text.chrf_counts``; ``draws`` as in ``bootstrap_sums``.
    Orders that don't occur on both sides are left out; 0 where none does.
    """
    names = [f"{c}_{n}" for n in range(orders) for c in ("hyp", "ref", "match")]
    wide = counts.select(cluster, *[F.get("chrf", n)[c].alias(f"{c}_{n}") for n in range(orders) for c in ("hyp", "ref", "match")])
    sums = bootstrap_sums(wide, draws, names, cluster)
    there = [(F.col(f"hyp_{n}") > 0) & (F.col(f"ref_{n}") > 0) for n in range(orders)]
    used = sum((t.cast("int") for t in there), F.lit(0))
    mean = lambda side: sum((F.when(t, F.col(f"match_{n}") / F.col(f"{side}_{n}")).otherwise(0.0) for n, t in enumerate(there)), F.lit(0.0)) / F.nullif(used, F.lit(0))
    b = beta * beta
    scored = sums.select("replicate", mean("hyp").alias("p"), mean("ref").alias("r"))
    d = b * F.col("p") + F.col("r")
    return scored.select("replicate", F.coalesce(F.when(d > 0, 100 * (1 + b) * F.col("p") * F.col("r") / d), F.lit(0.0)).alias("chrf"))


def by_condition(scores: DataFrame, condition: str, cluster: str, replicates: int, first: str, second: str, method: str = "method", seed: int = SEED) -> DataFrame:
    """Interval of first - second within each condition, over draws of the clusters that the condition has (BST3): one plan for all."""
    known = scores.where(F.col(condition).isNotNull())
    draws = hash_draws(known.select(condition, cluster).distinct(), replicates, seed, [condition])
    per = bootstrap_aurc(known, draws, method, cluster, within=[condition])
    return paired_interval(per, method, first, second, within=[condition]).withColumnRenamed(condition, "condition")


def bootstrap_row_order(scores: DataFrame, draws: DataFrame, position: str, method: str = "method", cluster: str = "cluster", y: str = "y", score: str = "score") -> DataFrame:
    """The older AURC of each (replicate, method), ties in row order (BST4).

    A cluster drawn several times counts its rows as often, one after another, so a
    row of weight w is w equal terms: the mean of running risks over its w ranks.
    """
    known = scores.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select(method, cluster, F.col(y).cast("double").alias("y"), score, position)
    # a row is a tied group of its own
    found = _areas(known.select(method, cluster, score, position, F.lit(1.0).alias("m"), F.col("y").alias("e")), draws.withColumnRenamed("cluster", cluster), [cluster], [method], [score, position])
    if found is not None:
        return found.select("replicate", method, "aurc")
    drawn = known.join(draws.withColumnRenamed("cluster", cluster), cluster)
    run = running(drawn, ["replicate", method], [score, position], {"n1": "weight", "e1": F.col("y") * F.col("weight")})
    n0, e0 = F.col("n1") - F.col("weight"), F.col("e1") - F.col("y") * F.col("weight")
    # sum over i = 1..w of (e0 + i y) / (n0 + i) = w y + (e0 - n0 y) (H(n0 + w) - H(n0))
    part = F.col("weight") * F.col("y") + (e0 - n0 * F.col("y")) * (_harmonic(F.col("n1")) - _harmonic(n0))
    return run.groupBy("replicate", method).agg((F.sum(part) / F.sum("weight")).alias("aurc"))
