"""Report tables and their provenance (RPT1-RPT3, RPT5, BST7, GEN2, AGG9, SNK9, SNK10, DTE1).

Reports are projections and pivots of long metric tables. Figures are given as the
data of their curves; drawing is left to whoever prints them.
"""

from __future__ import annotations

import datetime
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(long: DataFrame, rows: str, columns: str, value: str, order: list[str], only: list[str] | None = None) -> DataFrame:
    """One row per method in a given order, one column per cohort or metric (RPT1)."""
    place = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(order) for x in (n, i)]), F.col(rows))
    kept = long.where(F.col(rows).isin(order))
    wide = (kept.groupBy(rows).pivot(columns, only) if only else kept.groupBy(rows).pivot(columns)).agg(F.first(value))
    return wide.withColumn("_place", place).orderBy("_place").drop("_place")


def bounds_cell(e: str | Column, u: str | Column, k: str | Column, digits: int = 2) -> Column:
    """``lower-upper`` in per cent of the retained, ``--`` where nothing is retained (RPT2, FMT2)."""
    e, u, k = (F.col(x) if isinstance(x, str) else x for x in (e, u, k))
    percent = lambda x: F.format_number(100 * x / k, digits)
    return F.when(F.coalesce(k, F.lit(0)) == 0, "--").otherwise(F.concat(percent(e), F.lit("-"), percent(e + u)))


def publication(records: DataFrame, cohorts: list[str], methods: list[str], at: int = 90) -> DataFrame:
    """Per method and cohort: error area and bounds at a share, as text (RPT2, RPT3)."""
    cell = F.concat_ws(" ", F.format_number("aurc", 4), bounds_cell(f"errors{at}", f"unresolved{at}", f"kept{at}"))
    return table(records.select("method", "cohort", cell.alias("cell")), "method", "cohort", "cell", methods, cohorts)


def snapshot(metrics: DataFrame, sources: DataFrame, eligible: bool) -> DataFrame:
    """One row: all metric rows, the digests of what they were made from, and whether the protocol was formal (RPT5)."""
    rows = metrics.agg(F.array_sort(F.collect_list(F.to_json(F.struct(*metrics.columns)))).alias("metrics"))
    files = sources.agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("sources"))
    return rows.crossJoin(files).select("metrics", "sources", F.lit(eligible).alias("formal_eligible"))  # a row on either side


def with_intervals(differences: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """All comparisons with their intervals where one was computed; a conclusion for each (BST7)."""
    from .sensitivity import interval_class

    joined = differences.join(intervals.select(*keys, "low", "high", "clusters"), keys, "left")
    return joined.withColumn("conclusion", interval_class(F.col("low"), F.col("high")))


def union_summaries(parts: dict[str, DataFrame], name: str = "cohort") -> DataFrame:
    """Tables of several cohorts as one, each row with its cohort; columns that a part lacks are NULL (BST7)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.select(F.lit(n).alias(name), "*") for n, df in parts.items()))


def preparation_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of a prepared manifest, and the total (GEN2); writes nothing."""
    cells = F.array(F.struct(F.lit("*").alias("column"), F.lit("*").alias("value")), *[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def correct_but_disagreeing(df: DataFrame, by: list[str], y: str, disagreement: str | Column) -> DataFrame:
    """Rows without an error whose samples or evidence still disagree, and all rows without an error (AGG9)."""
    d = F.col(disagreement) if isinstance(disagreement, str) else disagreement
    return df.groupBy(*by).agg(F.count_if(F.col(y) == 0).alias("correct"), F.count_if((F.col(y) == 0) & (d > 0)).alias("disagreeing"))


def run_metrics(spark: SparkSession, run: str, values: dict[str, float], step: int = 0) -> DataFrame:
    """(run, name, step, value, at): scalars of a training run as rows (SNK9)."""
    return spark.createDataFrame([(run, n, step, float(v)) for n, v in values.items()], "run string, name string, step int, value double").withColumn("at", F.current_timestamp())


def figure_data(curves: dict[str, DataFrame], x: str, y: str) -> DataFrame:
    """(series, x, y): the points of a figure's curves (SNK10)."""
    return reduce(DataFrame.union, (df.select(F.lit(n).alias("series"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for n, df in curves.items()))


def utc_now() -> str:
    """UTC time to the second (DTE1)."""
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def fresh_id() -> str:
    return uuid.uuid4().hex
