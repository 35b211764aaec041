"""Join contracts and gates as tables of violation counts (JN1-JN7, JN11-JN14, SET1-SET7, GAT1-GAT3).

A contract returns counts; ``require`` raises where one is not zero. Both sides
are summed to one row per id before they meet, so a repeated id can't multiply.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A contract's violation counts."""


def require(counts: DataFrame, what: str) -> None:
    """Raise if any count of a one-row table is not zero."""
    row = counts.first().asDict()
    bad = {k: v for k, v in row.items() if v}
    if bad:
        raise ContractError(f"{what}: {bad}")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count (JN1)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys, keys that repeat and rows too many."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.sum(F.col("n") - 1).alias("extra_rows"))


def _per_id(df: DataFrame, id_: str, side: str, *more: Column) -> DataFrame:
    return df.groupBy(F.col(id_).alias("_id")).agg(F.count(F.lit(1)).alias(f"_{side}"), *more)


def id_contract(left: DataFrame, right: DataFrame, id_: str = "id", stale: list[tuple[str, str]] | None = None) -> DataFrame:
    """Counts of ids only left, only right, repeated on a side, and matched with differing columns (JN2, JN5, JN11, JN12)."""
    stale = stale or []
    a = _per_id(left, id_, "l", *[F.first(x).alias(f"_lv{i}") for i, (x, _) in enumerate(stale)])
    b = _per_id(right, id_, "r", *[F.first(x).alias(f"_rv{i}") for i, (_, x) in enumerate(stale)])
    both = a.join(b, "_id", "full_outer")
    met = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    differ = [F.count_if(met & ~F.col(f"_lv{i}").eqNullSafe(F.col(f"_rv{i}"))).alias(f"stale_{x}") for i, (x, _) in enumerate(stale)]
    return both.agg(
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
        F.count_if(F.col("_l") > 1).alias("left_repeated"),
        F.count_if(F.col("_r") > 1).alias("right_repeated"),
        *differ,
    )


def contract_join(manifest: DataFrame, required: DataFrame, id_: str = "id", optional: Iterable[DataFrame] = ()) -> DataFrame:
    """Manifest with a required part (an error if an id has none) and optional parts (JN3)."""
    missing = manifest.join(required.select(id_), id_, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    require(missing, "required rows")
    out = manifest.join(required, id_)
    for part in optional:
        out = out.join(part, id_, "left")
    return out


def pending(rows: DataFrame, done: DataFrame, id_: str = "id") -> DataFrame:
    """Rows not done yet; null and empty ids are never done (JN6, SRC9)."""
    return rows.join(done.where(F.col(id_).isNotNull() & (F.col(id_).cast("string") != "")).select(id_).distinct(), id_, "left_anti")


def stale(rows: DataFrame, done: DataFrame, id_: str, fingerprint: str) -> DataFrame:
    """Rows that are done under another fingerprint: a restart must fail on them (STR2)."""
    old = done.select(F.col(id_), F.col(fingerprint).alias("_done"))
    return rows.join(old, id_).where(~F.col(fingerprint).eqNullSafe(F.col("_done"))).drop("_done")


def overlay(old: DataFrame, new: DataFrame, id_: str = "id") -> DataFrame:
    """Old and new rows by id, new ones winning as a whole (JN7)."""
    a = old.select(F.col(id_), F.struct(*old.columns).alias("_old"))
    b = new.select(F.col(id_), F.struct(*[F.col(c) for c in old.columns]).alias("_new"))
    picked = F.coalesce("_new", "_old").alias("x")
    return a.join(b, id_, "full_outer").select(picked).select("x.*")


def shard_of(position: Column, shards: int) -> Column:
    """Shard of a row by its place in the manifest (SPL12)."""
    return F.pmod(position, F.lit(shards))


def shard_contract(manifest: DataFrame, parts: DataFrame, shards: int, id_: str = "id", position: str = "_pos", shard: str = "shard") -> DataFrame:
    """One row per shard: expected and found rows, and found rows that are unknown, repeated or in the wrong shard (JN13)."""
    want = manifest.select(F.col(id_), shard_of(F.col(position), shards).cast("int").alias("want"))
    got = parts.groupBy(id_, F.col(shard).cast("int").alias("got")).agg(F.count(F.lit(1)).alias("m"))
    both = want.join(got, id_, "full_outer")
    at = F.coalesce("got", "want").alias("shard")
    met = F.col("want").isNotNull() & F.col("got").isNotNull()
    return both.groupBy(at).agg(
        F.count_if(F.col("want") == F.coalesce("got", "want")).alias("expected"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("found"),
        F.count_if(F.col("want").isNull()).alias("unknown"),
        F.count_if(F.col("m") > 1).alias("repeated"),
        F.count_if(met & (F.col("want") != F.col("got"))).alias("misplaced"),
        F.count_if(F.col("got").isNull()).alias("missing"),
    )


def leakage(df: DataFrame, fields: list[str], split: str = "split") -> DataFrame:
    """For each field, values that occur in more than one split (SPL2, SPL4, SET3); all fields in one pass."""
    long = df.select(split, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(split, "x.*").where("value is not null")
    per = long.groupBy("field", "value").agg(F.min(split).alias("lo"), F.max(split).alias("hi"))
    return per.groupBy("field").agg(F.count(F.lit(1)).alias("values"), F.count_if(F.col("lo") != F.col("hi")).alias("leaking"))


def tolerance(expected: DataFrame, actual: DataFrame, keys: list[str], value: str, atol: float = 1e-12) -> DataFrame:
    """Metric rows that are missing on a side or differ by more than ``atol``; two NULLs agree (GAT3, MTH7)."""
    a = expected.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("_e"))
    b = actual.select(*keys, F.col(value).alias("actual"), F.lit(True).alias("_a"))
    same = (F.abs(F.col("expected") - F.col("actual")) <= atol) | (F.col("expected").isNull() & F.col("actual").isNull())
    return a.join(b, keys, "full_outer").where(F.col("_e").isNull() | F.col("_a").isNull() | ~F.coalesce(same, F.lit(False))).drop("_e", "_a")


def design_contract(found: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Cells of a full design that are missing, and rows outside of it (SET6)."""
    spark, grid = found.sparkSession, None
    for name, values in axes.items():
        axis = spark.createDataFrame([(v,) for v in values], [name])
        grid = axis if grid is None else grid.crossJoin(axis)
    have = found.select(*axes).distinct()
    missing = grid.join(have, list(axes), "left_anti").select(*axes, F.lit("missing").alias("problem"))
    return missing.union(have.join(grid, list(axes), "left_anti").select(*axes, F.lit("unexpected").alias("problem")))
