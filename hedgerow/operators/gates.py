"""Gates over finished experiments as tables of failures (GAT3-GAT5, GAT7-GAT9, INF10, ORC11).

A gate is a table (gate, failures); ``contracts.require`` or ``failures`` turn it into
an error or a list. Gates on documents for print (fonts, pages) are out of scope.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contracts

RAW_TOLERANCE, CALIBRATED_TOLERANCE, REPLAY_TOLERANCE = 1e-12, 1e-6, 1e-5


def stale_files(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, problem) of expected digests whose file is missing or has changed (GAT3, GAT7)."""
    both = expected.select("path", F.col("sha256").alias("_want")).join(listing.select("path", "sha256"), "path", "left")
    return both.where(~F.col("_want").eqNullSafe(F.col("sha256"))).select("path", F.when(F.col("sha256").isNull(), "missing").otherwise("changed").alias("problem"))


def reproduction(previous: DataFrame, now: DataFrame, by: list[str], id_: str = "id") -> DataFrame:
    """One row per head: ids and labels that differ, largest differences of raw and calibrated risks, changed selections, verdict (GAT8)."""
    a = previous.select(*by, id_, F.col("y").alias("_y"), F.col("raw").alias("_raw"), F.col("calibrated").alias("_cal"), F.col("threshold").alias("_t"))
    both = a.withColumn("_a", F.lit(True)).join(now.withColumn("_b", F.lit(True)), [*by, id_], "full_outer")
    out = both.groupBy(*by).agg(
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("ids_differ"),
        F.count_if(F.col("_a") & F.col("_b") & ~F.col("_y").eqNullSafe(F.col("y"))).alias("labels_differ"),
        F.max(F.abs(F.col("_raw") - F.col("raw"))).alias("raw_error"),
        F.max(F.abs(F.col("_cal") - F.col("calibrated"))).alias("calibrated_error"),
        F.count_if((F.col("_cal") < F.col("_t")) != (F.col("calibrated") < F.col("threshold"))).alias("selections_differ"),
    )
    same = (F.col("ids_differ") + F.col("labels_differ") + F.col("selections_differ") == 0) & (F.col("raw_error") <= RAW_TOLERANCE) & (F.col("calibrated_error") <= CALIBRATED_TOLERANCE)
    return out.withColumn("passed", F.coalesce(same, F.lit(False)))


def design_gate(records: DataFrame, axes: dict[str, list], value: str) -> DataFrame:
    """(gate, failures): cells that are missing, unexpected or repeated, and values that aren't finite (GAT4)."""
    cells = contracts.design_contract(records, axes)
    v = F.col(value).cast("double")
    bad = records.agg(F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("n"))
    return reduce(
        DataFrame.union,
        [
            cells.groupBy().agg(F.count_if(F.col("problem") == "missing").alias("failures")).select(F.lit("missing_cells").alias("gate"), "failures"),
            cells.groupBy().agg(F.count_if(F.col("problem") == "unexpected").alias("failures")).select(F.lit("unexpected_cells"), "failures"),
            contracts.duplicates(records, list(axes)).groupBy().agg(F.count(F.lit(1)).alias("failures")).select(F.lit("repeated_cells"), "failures"),
            bad.select(F.lit("values_not_finite"), "n"),
        ],
    )


def replay(cached: DataFrame, replayed: DataFrame, value: str, id_: str = "id", atol: float = REPLAY_TOLERANCE, limit: int = 32) -> DataFrame:
    """Counts and the largest error of replayed values against cached ones; at most ``limit`` rows are replayed (INF10)."""
    both = replayed.select(id_, F.col(value).alias("_new")).join(cached.select(id_, F.col(value).alias("_old")), id_, "left")
    error = F.abs(F.col("_new") - F.col("_old"))
    out = both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_).alias("ids"), F.count_if(F.col("_old").isNull()).alias("not_cached"), F.count_if(~F.coalesce(error <= atol, F.lit(False))).alias("beyond"), F.max(error).alias("largest"))
    return out.withColumn("passed", (F.col("n") == F.col("ids")) & (F.col("n") <= limit) & (F.col("beyond") == 0))


def replay_sample(cache: DataFrame, position: str, n: int = 16) -> DataFrame:
    """The first rows of a cache, which are what is replayed (TOP6)."""
    return cache.orderBy(position).limit(n)


def cohort_gate(expected: DataFrame, features: DataFrame, predictions: DataFrame, counts: DataFrame, id_: str = "id") -> DataFrame:
    """(gate, failures) of one evaluated cohort (GAT5): ids of features and predictions, labels, and rows counted by method.

    ``counts`` has (method, n).
    """
    ids = lambda a, b, name: a.select(id_).exceptAll(b.select(id_)).union(b.select(id_).exceptAll(a.select(id_))).agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("gate"), "failures")
    labels = features.select(id_, F.col("y").alias("_y")).join(predictions.select(id_, "y"), id_).agg(F.count_if(~F.col("_y").eqNullSafe(F.col("y"))).alias("failures"))
    total = expected.agg(F.count(F.lit(1)).alias("_n"))
    wrong = counts.crossJoin(F.broadcast(total)).agg(F.count_if(F.col("n") != F.col("_n")).alias("failures"))  # one row on the right
    return reduce(DataFrame.union, [ids(expected, features, "feature_ids"), ids(expected, predictions, "prediction_ids"), labels.select(F.lit("labels"), "failures"), wrong.select(F.lit("method_counts"), "failures")])


def retained_gate(quality: DataFrame, share: float = 0.9) -> DataFrame:
    """Methods whose retained count is not the rounded share of their cohort (GAT5); ``quality`` has (cohort, method, n, retained)."""
    return quality.where(F.col("retained") != F.bround(F.col("n") * F.lit(share), 0).cast("long"))


def protocol_gate(spark: SparkSession, found: dict, frozen: dict) -> DataFrame:
    """(key, found, frozen) of frozen fields that a result doesn't repeat (GAT4, GAT5)."""
    text = lambda x: None if x is None else json.dumps(x, sort_keys=True)
    rows = [(k, text(found.get(k)), text(v)) for k, v in frozen.items() if found.get(k) != v]
    return spark.createDataFrame(rows, "key string, found string, frozen string")


def release_counts(artifacts: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(artifact, expected, observed) of artifacts with another number of rows (GAT7)."""
    counts = [df.agg(F.lit(n).alias("artifact"), F.lit(expected.get(n)).cast("long").alias("expected"), F.count(F.lit(1)).alias("observed")) for n, df in artifacts.items()]
    return reduce(DataFrame.union, counts).where(~F.col("expected").eqNullSafe(F.col("observed")))


def blank_columns(sheet: DataFrame, human: list[str]) -> DataFrame:
    """Rows of an annotation sheet, and cells of human columns that are filled before anyone has judged (GAT7)."""
    filled = [F.sum((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").cast("long")).alias(c) for c in human]
    return sheet.agg(F.count(F.lit(1)).alias("rows"), *filled)


def closure(spark: SparkSession, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that can be reached from the roots, with the fewest steps: a dependency closure (GAT9).

    ``edges`` has (parent, child), ``roots`` has (node).
    """
    from .graph import checkpointed

    kind = edges.schema["child"].dataType
    found = checkpointed(roots.select(F.col("node").cast(kind).alias("node"), F.lit(0).alias("steps")).distinct(), "closure")
    last, steps = found, 0
    while not last.isEmpty():
        steps += 1
        new = last.join(edges, last["node"] == edges["parent"]).select(F.col("child").alias("node")).where("node is not null").distinct()
        last = checkpointed(new.join(found.select("node"), "node", "left_anti").select("node", F.lit(steps).alias("steps")), "closure")
        found = checkpointed(found.union(last), "closure")
    return found


def failures(checks: dict[str, bool], mode: str = "technical", author_only: tuple[str, ...] = ("author_information_supplied",)) -> list[str]:
    """Names of checks that fail; what only the authors can supply counts for a submission alone (ORC11)."""
    if mode not in ("technical", "submission"):
        raise ValueError(f"unknown mode {mode}")
    return [k for k, ok in checks.items() if not ok and (mode == "submission" or k not in author_only)]


def verdicts(checks: dict[str, Column]) -> Column:
    """A map of check to result, and nothing for checks that hold."""
    return F.map_filter(F.create_map(*[x for k, c in checks.items() for x in (F.lit(k), F.coalesce(c, F.lit(False)))]), lambda _, ok: ~ok)
