"""Summaries of metric rows and label rows: seeds, folds, comparisons, agreement, exclusions, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running


def seed_distribution(df: DataFrame, by: list[str], seed: str, value: str, seeds: int = 5) -> DataFrame:
    """Mean, sample deviation and range over training seeds; ``complete`` tells whether all seeds are there and finite (AGG6)."""
    finite = ~F.isnan(F.col(value)) & (F.abs(F.col(value)) < float("inf"))
    return df.groupBy(*by).agg(
        F.count_distinct(F.when(finite, F.col(seed))).alias("seeds"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    ).withColumn("complete", F.col("seeds") == seeds)


def matched(df: DataFrame, keys: list[str], method: str, first: str, second: str, value: str) -> DataFrame:
    """Values of two methods side by side where both have the key, and their difference (JN15)."""
    side = lambda m: F.max(F.when(F.col(method) == m, F.col(value)))
    both = df.where(F.col(method).isin(first, second)).groupBy(*keys).agg(side(first).alias("first"), side(second).alias("second"))
    return both.where("first is not null and second is not null").withColumn("difference", F.col("first") - F.col("second"))


def fold_summary(per_fold: DataFrame, pooled: DataFrame, value: str) -> DataFrame:
    """Pooled value beside the mean and the population deviation of the folds' values (MET22)."""
    folds = per_fold.agg(F.count(value).alias("folds"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return pooled.select(F.col(value).alias("pooled")).crossJoin(F.broadcast(folds))


def retained_difference(df: DataFrame, by: list[str], a: str = "keep_a", b: str = "keep_b") -> DataFrame:
    """How two retained sets overlap (SET4)."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(a) & F.col(b)).alias("both"),
        F.count_if(F.col(a) & ~F.col(b)).alias("only_a"),
        F.count_if(~F.col(a) & F.col(b)).alias("only_b"),
        F.count_if(F.col(a) != F.col(b)).alias("differing"),
    )


def percentages(counts: DataFrame) -> DataFrame:
    """Bounds of count records (n, k, e, u) in percent and their width; a record that is no selection is an error (MET15)."""
    sound = (F.col("e") >= 0) & (F.col("u") >= 0) & (F.col("e") + F.col("u") <= F.col("k")) & (F.col("k") <= F.col("n"))
    k = F.when(sound, F.nullif(F.col("k"), F.lit(0))).otherwise(F.raise_error(F.lit("counts are no selection")).cast("long"))
    return counts.select("*", (100 * F.col("e") / k).alias("lower_percent"), (100 * (F.col("e") + F.col("u")) / k).alias("upper_percent")).withColumn("width", F.col("upper_percent") - F.col("lower_percent"))


def agreement(df: DataFrame, by: list[str], automatic: str, first: str, second: str) -> DataFrame:
    """Filled cells of two annotators, their agreement with the automatic label and with each other; NULL without pairs (MET16)."""
    return df.groupBy(*by).agg(
        F.count(first).alias("filled_first"),
        F.count(second).alias("filled_second"),
        F.avg((F.col(first) == F.col(automatic)).cast("double")).alias("first_automatic"),
        F.avg((F.col(second) == F.col(automatic)).cast("double")).alias("second_automatic"),
        F.avg((F.col(first) == F.col(second)).cast("double")).alias("first_second"),
    )


def historical(df: DataFrame, history: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Adds ``reason``: the first history whose values hold the row's column, else NULL (JN17).

    ``history`` lists (reason, column of ``df``, one-column frame); nulls overlap with nothing.
    """
    out = df
    for i, (_, column, values) in enumerate(history):
        known = values.select(F.col(values.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct().withColumn(f"_h{i}", F.lit(True))
        out = out.join(known, column, "left")
    flags = [F.when(F.col(f"_h{i}"), reason) for i, (reason, _, _) in enumerate(history)]
    return out.select(*df.columns, F.coalesce(*flags).alias("reason"))


def last_per_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row of each key, at the place of its first (JN18)."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, position).alias("_x"), F.min(position).alias("first_position")).select(*keys, "_x.*", "first_position")


def resharded(position: str | Column, parent_stride: int, children: int) -> Column:
    """The child lane of a row: child = parent + s * stride, for row s of the parent's lane modulo ``children`` (SPL12)."""
    p = F.col(position) if isinstance(position, str) else position
    parent = F.pmod(p, F.lit(parent_stride))
    return parent + F.pmod(F.floor(p / parent_stride).cast("long"), F.lit(children)) * parent_stride


def external_overlap(df: DataFrame, external: DataFrame, text: str, external_text: str, normal) -> DataFrame:
    """Distinct normalised texts of the rows that an external table holds too (SPL4, SET3)."""
    a = df.select(normal(F.col(text)).alias("t")).where("t is not null").distinct()
    b = external.select(normal(F.col(external_text)).alias("t")).where("t is not null").distinct()
    return a.join(b.withColumn("_in", F.lit(True)), "t", "left").agg(F.count(F.lit(1)).alias("texts"), F.count("_in").alias("external"))


def latencies(df: DataFrame, by: list[str], bare: str, parts: list[str]) -> DataFrame:
    """Mean of each serial part, of their sum, and the sum's ratio to the bare part (AGG7)."""
    total = sum((F.avg(p) for p in parts), F.avg(bare))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(p).alias(p) for p in (bare, *parts)], total.alias("serial"), (total / F.nullif(F.avg(bare), F.lit(0.0))).alias("ratio"))


def running_mean(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Running sum over rank (WIN1)."""
    run = running(df, by, order, {"_sum": value, "_rank": F.lit(1)})
    return run.select(*df.columns, (F.col("_sum") / F.col("_rank")).alias("running_mean"))
