"""Bounds and label-flip budgets of differences between selections (SEN1-SEN3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _weights(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Adds the weight of each row in mean(a) - mean(b); selections' sizes come from one pre-aggregated row per group."""
    sizes = df.groupBy(*by).agg(F.nullif(F.count_if(a), F.lit(0)).alias("_na"), F.nullif(F.count_if(b), F.lit(0)).alias("_nb"))
    w = F.col(a).cast("double") / F.col("_na") - F.col(b).cast("double") / F.col("_nb")
    joined = df.join(sizes, by) if by else df.crossJoin(F.broadcast(sizes))
    return joined.select(*df.columns, w.alias("w"))


def difference_bounds(df: DataFrame, by: list[str], y: str = "y", a: str = "keep_a", b: str = "keep_b") -> DataFrame:
    """Range of the risk difference over all labels of unresolved items, one shared label each; NULL if a selection is empty."""
    w = _weights(df, by, a, b)
    fixed = F.sum(F.when(F.col(y).isNotNull(), F.col("w") * F.col(y)).otherwise(F.when(F.col("w").isNotNull(), 0.0)))
    loose = lambda f: F.sum(F.when(F.col(y).isNull(), f("w", F.lit(0.0))).otherwise(0.0))
    return w.groupBy(*by).agg((fixed + loose(F.least)).alias("lower"), (fixed + loose(F.greatest)).alias("upper"))


def flip_budget(df: DataFrame, by: list[str], y: str = "y", a: str = "keep_a", b: str = "keep_b") -> DataFrame:
    """Fewest flips of known labels that erase a strict improvement of a over b, and the most that keep it.

    Items with the same gain are one row with a count: gains take few values, as
    weights depend only on the two selections.
    """
    w = _weights(df, by, a, b)
    known = w.where(F.col(y).isNotNull())
    gains = known.select(*by, F.greatest(F.col("w") * (1 - 2 * F.col(y)), F.lit(0.0)).alias("gain")).groupBy(*by, "gain").agg(F.count(F.lit(1)).alias("m"))
    bounds = difference_bounds(df, by, y, a, b)
    joined = gains.join(bounds, by) if by else gains.crossJoin(F.broadcast(bounds))
    run = Window.partitionBy(*by).orderBy(F.desc("gain"))
    t = joined.select(*by, "gain", "m", "upper", (F.sum("m").over(run) - F.col("m")).alias("before"), (F.sum(F.col("gain") * F.col("m")).over(run) - F.col("gain") * F.col("m")).alias("moved"))
    # inside a run of equal gains the crossing is where upper + moved + j * gain reaches 0
    need = F.greatest(F.lit(0), F.ceil((-1e-12 - F.col("upper") - F.col("moved")) / F.nullif(F.col("gain"), F.lit(0.0))))
    first = F.when(F.col("upper") >= -1e-12, F.lit(0)).when((F.col("gain") > 0) & (F.col("upper") + F.col("moved") + F.col("gain") * F.col("m") >= -1e-12), F.col("before") + need)
    return t.groupBy(*by).agg(F.min(first).cast("long").alias("flips_to_erase"), F.sum("m").alias("known")).select(*by, "known", "flips_to_erase", F.coalesce(F.col("flips_to_erase") - 1, F.col("known")).alias("flips_tolerated"))


def mask_pairs(df: DataFrame, keys: list[str], condition: str, first: str, second: str, y: str, score: str) -> DataFrame:
    """Pairs of two conditions on the same item: pairs, both decidable, mean differences (JN10, MET17)."""
    side = lambda name, x: df.where(F.col(condition) == name).select(*keys, F.col(y).alias(f"y{x}"), F.col(score).alias(f"s{x}"))
    both = side(first, 1).join(side(second, 2), keys)
    known = F.col("y1").isNotNull() & F.col("y2").isNotNull()
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(known).alias("decidable"), F.avg(F.when(known, F.col("y1") - F.col("y2"))).alias("label_difference"), F.avg(F.col("s1") - F.col("s2")).alias("score_difference"))


def interval_class(low: Column, high: Column) -> Column:
    """Conclusion of an interval of a difference; a reversed interval is an error (BST6)."""
    return (
        F.when(low.isNull() | high.isNull(), "not_computed")
        .when(low > high, F.raise_error(F.lit("interval is reversed")).cast("string"))
        .when(high < 0, "full_lower")
        .when(low > 0, "full_higher")
        .otherwise("cannot_exclude")
    )


def cohort_bundle(scores: DataFrame, primary: str, baselines: list[str], coverages: tuple[float, ...] = (0.8, 0.9, 0.95), y: str = "y", score: str = "raw", id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """(bounds of primary against each baseline at each share, flip budget of the primary's best 90 % against all rows) (SEN3).

    ``scores`` is long: id, method, y, score.
    """
    from functools import reduce

    from .selection import keep_top

    kept = {c: keep_top(scores, ["method"], score, id_, c) for c in coverages}
    parts = []
    for c, rows in kept.items():
        mine = rows.where(F.col("method") == primary).select(id_, y, F.col("keep").alias("keep_a"))
        other = rows.where(F.col("method").isin(baselines)).select(id_, F.col("method").alias("baseline"), F.col("keep").alias("keep_b"))
        parts.append(difference_bounds(mine.join(other, id_), ["baseline"], y).select("baseline", F.lit(c).alias("coverage"), "lower", "upper"))
    every = keep_top(scores.where(F.col("method") == primary), ["method"], score, id_, 0.9).select("method", y, F.col("keep").alias("keep_a"), F.lit(True).alias("keep_b"))
    return reduce(DataFrame.union, parts), flip_budget(every, ["method"], y)
