"""Requests to neural scorers and what comes back (INF1, INF3, INF4, INF8, INF9, INF11, HSH5).

The networks are not part of this engine: a backend is a function that yields a
table for batches of requests (``mapInPandas``). What is here is what surrounds it:
requests with their owners, answers put together by owner, language directions,
exact-input caches and paired timings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.functions.hashing import fingerprint

from .contracts import ContractError, pending, require

Backend = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def requests(manifest: DataFrame, probes: str = "probes", samples: int = 0) -> DataFrame:
    """One request for each base input, probe and sample, with its owner's id and a role (INF1).

    ``probes`` holds (name, audio).
    """
    base = F.array(F.struct(F.lit("base").alias("role"), F.col("audio").alias("audio"), F.lit(0).alias("place")))
    probed = F.transform(F.coalesce(F.col(probes), F.expr("array()").cast(manifest.schema[probes].dataType)), lambda p, i: F.struct(F.concat(F.lit("probe:"), p["name"]).alias("role"), p["audio"].alias("audio"), (i + 1).alias("place")))
    sampled = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: F.struct(F.concat(F.lit("sample:"), i.cast("string")).alias("role"), F.col("audio").alias("audio"), i.alias("place"))) if samples else F.slice(base, 1, 0)
    return manifest.select(F.col("id").alias("owner"), F.explode(F.concat(base, probed, sampled)).alias("x")).select("owner", "x.*")


def scored(asked: DataFrame, backend: Backend, schema: str, direction: tuple[str, str] | None = None) -> DataFrame:
    """Answers of a backend; rows of one language direction share a partition, as a batch must have one direction (INF3, INF4, INF8)."""
    rows = asked.repartition(*direction).sortWithinPartitions(*direction) if direction else asked

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts() -> Iterator[pd.DataFrame]:
            for batch in batches:
                if direction is None:
                    yield batch
                else:
                    yield from (part for _, part in batch.groupby(list(direction), sort=False, dropna=False))

        return backend(parts())

    return rows.mapInPandas(run, schema)


def regrouped(answers: DataFrame, text: str = "translation") -> DataFrame:
    """Answers by owner: base text, probes and samples in their order (INF1); an owner without a base answer is an error."""
    out = answers.groupBy(F.col("owner").alias("id")).agg(
        F.max(F.when(F.col("role") == "base", F.col(text))).alias(text),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role").startswith("probe:"), F.struct("place", F.substring_index("role", ":", -1).alias("name"), F.col(text).alias("translation"))))), lambda x: F.struct(x["name"].alias("name"), x["translation"].alias("translation"))).alias("probe_translations"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role").startswith("sample:"), F.struct("place", F.col(text).alias("t"))))), lambda x: x["t"]).alias("sample_translations"),
    )
    return out.withColumn(text, F.when(F.col(text).isNull(), F.raise_error(F.lit("no base answer")).cast("string")).otherwise(F.col(text)))


def cached(rows: DataFrame, cache: DataFrame, inputs: list[str], id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to score, cached rows that hold): a cached row under other inputs is an error (INF9, HSH5)."""
    now = rows.withColumn("input_fingerprint", fingerprint(*inputs))
    there = cache.select(id_, F.col("input_fingerprint").alias("_was"))
    require(now.join(there, id_).agg(F.count_if(F.col("_was") != F.col("input_fingerprint")).alias("stale")), "cache")
    return pending(now, cache, id_), cache.join(now.select(id_), id_, "left_semi")


def in_chunks(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Rows with their chunk number, in order (INF9)."""
    from .order import numbered

    return numbered(rows, [order], "_at").withColumn("chunk", F.floor(F.col("_at") / size)).drop("_at")


def paired_timings(timings: DataFrame, warm_up: int = 2, run: str | None = None) -> DataFrame:
    """(item, first, second, ratio): two ways timed on the same items in alternating order, without the warm-up (INF11).

    ``timings`` has item (from 0), way ('a' or 'b'), place (0 or 1) and seconds. An item that is
    timed several times has a row for each ``run``, a column that tells them apart. An item whose
    two ways did not alternate, or that has a way twice in a run, is an error. A first way of no
    time at all gives an infinite ratio, or none (NaN) if the second took none either.
    """
    kept = timings.where(F.col("item") >= warm_up)
    way = {w: F.col("way") == w for w in ("a", "b")}
    wide = kept.groupBy("item", *([run] if run else [])).agg(*[F.max(F.when(way[w], F.col("seconds"))).alias(n) for w, n in (("a", "first"), ("b", "second"))], F.max(F.when(way["a"], F.col("place"))).alias("_place"), F.greatest(*map(F.count_if, way.values())).alias("_times"))
    require(wide.agg(F.count_if(F.col("_place") != F.col("item") % 2).alias("not_alternating"), F.count_if(F.col("first").isNull() | F.col("second").isNull()).alias("not_paired"), F.count_if(F.col("_times") > 1).alias("repeated")), "timings")
    first, second = F.col("first"), F.col("second")
    below = first.cast("string") == "-0.0"
    unmeasured = F.when(F.isnan(second) | (second == 0), float("nan")).when((second > 0) != below, float("inf")).otherwise(float("-inf"))
    return wide.select("item", "first", "second", F.when(first == 0, unmeasured).otherwise(second / first).alias("ratio"))


def checked_outputs(answers: DataFrame, text: str = "translation") -> DataFrame:
    """Answers of an extension backend; an empty base text is an error (INF6)."""
    if answers.where(F.trim(F.coalesce(F.col(text), F.lit(""))) == "").limit(1).count():
        raise ContractError("a backend gave an empty text")
    return answers


def fingerprints(kind: str, *columns: str) -> Column:
    """Digest of what attention or likelihood was computed from; the kind is part of it (HSH5)."""
    return F.sha2(F.concat_ws("|", F.lit(kind), fingerprint(*columns)), 256)
