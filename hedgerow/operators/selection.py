"""Top shares under a coverage, with reproducible ties (TOP1, TOP2, SRT2, SRT3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.functions.hashing import stable_hex

from .order import running


def kept_count(n: Column, coverage: float | Column) -> Column:
    """How many of n rows a coverage keeps: rounded half to even, one at least (MTH6)."""
    share = F.lit(coverage) if isinstance(coverage, float) else coverage
    return F.least(n, F.greatest(F.lit(1).cast("long"), F.bround(share.cast("double") * n, 0).cast("long")))


def ranked(df: DataFrame, by: list[str], score: str, id_: str) -> DataFrame:
    """Adds ``rank`` (from 1, lowest score first, ties by seeded hash of the id) and ``n`` of the group."""
    return running(df, by, [F.col(score), stable_hex(id_)], {"rank": F.lit(1)}, ["rank"]).withColumnRenamed("total_rank", "n")


def keep_top(df: DataFrame, by: list[str], score: str, id_: str, coverage: float) -> DataFrame:
    """Adds ``keep``: whether a row is among the share of its group with the lowest scores.

    The group's cut is found on counts per distinct score, aggregated before the
    shuffle; only rows tied at the cut are ordered by hash. So a group that holds
    most of the table is not sorted in one task.
    """
    per = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_m"))
    upto = running(per, by, [score], {"_upto": "_m"}, ["_upto"]).withColumnRenamed("total__upto", "_n")
    cut = upto.where(F.col("_upto") >= kept_count(F.col("_n"), coverage)).groupBy(*by).agg(F.min(F.struct(F.col(score).alias("s"), (kept_count(F.col("_n"), coverage) - (F.col("_upto") - F.col("_m"))).alias("room"))).alias("_cut"))
    on = F.lit(True)
    cut = cut.select(*[F.col(b).alias(f"_{b}") for b in by], "_cut")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    joined = df.join(cut, on, "left").drop(*[f"_{b}" for b in by])
    tied = F.col(score) == F.col("_cut.s")
    place = F.when(tied, F.row_number().over(Window.partitionBy(*by, score, tied).orderBy(stable_hex(id_))))
    return joined.select("*", (F.coalesce(F.col(score) < F.col("_cut.s"), F.lit(False)) | F.coalesce(place <= F.col("_cut.room"), F.lit(False))).alias("keep")).drop("_cut")


def keep_first(df: DataFrame, by: list[str], score: str, position: str, coverage: float) -> DataFrame:
    """The older rule: ties by row position."""
    run = running(df, by, [F.col(score), F.col(position)], {"_rank": F.lit(1)}, ["_rank"])
    return run.select(*df.columns, (F.col("_rank") <= kept_count(F.col("total__rank"), coverage)).alias("keep"))
