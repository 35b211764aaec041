"""Connected components of an edge table by alternating star contractions.

Every round rewrites each node's edges towards the smallest node it can see,
once over all neighbours and once over the smaller ones. The number of rounds
grows with the logarithm of the longest path, the table never grows, minima are
pre-aggregated before each shuffle. Each star and its minima are written to the folder
that ``spark.checkpoint.dir`` names, so a lost executor costs one step at most, and no
plan holds another's: a round in one plan has some 90 exchanges, which the driver plans
anew whenever one of them ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A node has many neighbours above this number, and above this share of all edges.
HOT_ROWS = 1000
HOT_NODES = 10_000


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Each edge (u, v) with m of its u. Nodes with many edges, of which there can't be ``HOT_NODES``, are broadcast: a star is not one task's."""
    hot = F.col("n") > max(HOT_ROWS, total // HOT_NODES)
    few = least.where(hot).drop("n")
    if few.isEmpty():
        return edges.join(least.drop("n"), "u")
    return edges.join(F.broadcast(few), "u").unionByName(edges.join(F.broadcast(few.select("u")), "u", "left_anti").join(least.where(~hot).drop("n"), "u"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, total: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = keep(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    return keep(_with_least(both.where(F.col("v") > F.col("u")), least, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")


def _small_star(edges: DataFrame, total: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = keep(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    moved = _with_least(down, least, total).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return keep(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the smallest node of its component.

    ``edges`` has two columns of one ordered type, taken as undirected; loops and
    rows with a null end are ignored. ``keep`` writes a table and reads it again.
    """
    u, v = edges.columns
    now = keep(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "edges")
    before = _state(now)
    for _ in range(rounds if before[0] else 0):
        now = _small_star(_large_star(now, before[0], keep), 2 * before[0], keep)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def shared_root(spark) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only in local mode may the setting be missing: on a cluster each executor would
    write to a disk of its own.
    """
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/hedgerow"


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again."""
    import uuid

    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
