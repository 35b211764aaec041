"""Cohort funnels, filters and row expansion (FLT1-FLT12, FLT15-FLT17, GEN1, GEN3, GEN4, GEN6-GEN9, WIN5, SRC5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered

AMBIGUOUS = r"(?iU)\d\s*(?:[-–:/]|\.\d|,\d|%|€|\$)|\b(?:percent|prozent|pour cent|to|bis)\b\s*\d"


def funnel(df: DataFrame, reasons: list[tuple[str, Column]], duplicate_keys: list[str] | None = None, order: list[Column] | None = None, duplicate_reason: str = "duplicate") -> DataFrame:
    """Adds ``reason``: the first that holds, or NULL for a row that stays (FLT6, FLT7).

    Duplicates are judged last, among the rows that no other reason excludes: the
    first in order stays. Excluded rows don't enter that window.
    """
    case = None
    for name, test in reasons:
        test = F.coalesce(test, F.lit(False))
        case = F.when(test, name) if case is None else case.when(test, name)
    out = df.select("*", (F.lit(None).cast("string") if case is None else case).alias("reason"))
    if not duplicate_keys:
        return out
    stays = out.where("reason is null")
    later = F.row_number().over(Window.partitionBy(*duplicate_keys).orderBy(*(order or []))) > 1
    judged = stays.select(*df.columns, F.when(later, duplicate_reason).alias("reason"))
    return out.where("reason is not null").union(judged)


def funnel_counts(judged: DataFrame) -> DataFrame:
    """Rows per reason; rows that stay count as ``kept``."""
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def refine_numeric(df: DataFrame, text: str, numeric: str, general: str) -> DataFrame:
    """Ambiguous forms lose the numeric flag; rows with neither flag go (FLT8, FLT9, FLT10)."""
    out = df.withColumn(numeric, F.col(numeric) & ~F.col(text).rlike(AMBIGUOUS))
    return out.where(F.col(numeric) | F.col(general))


def first_match(files: list[DataFrame], keys: DataFrame, key: str) -> DataFrame:
    """For each wanted key the row of the first file that has it (SRC5)."""
    ranked = None
    for rank, part in enumerate(files):
        part = part.join(keys.select(key).distinct(), key, "left_semi").withColumn("_rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(key).orderBy("_rank"))
    return ranked.select("*", place.alias("_place")).where("_place = 1").drop("_rank", "_place")


def availability(df: DataFrame, split: str, features: list[str]) -> DataFrame:
    """For each feature the splits in which it has no value; one pass (FLT12, FEA7)."""
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), 1)
    per = df.groupBy(split).agg(*[F.count(finite(c)).alias(c) for c in features])
    long = per.select(split, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("present")) for c in features])).alias("x")).select(split, "x.*")
    return long.groupBy("feature").agg(F.sum("present").alias("present"), F.count_if(F.col("present") == 0).alias("empty_splits")).withColumn("available", F.col("empty_splits") == 0)


def expand(df: DataFrame, id_: str, sides: list[str], conditions: list[str]) -> DataFrame:
    """One row per pair, side and condition, with the id ``pair::side::condition`` (GEN1, GEN3, GEN4)."""
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(c).alias("condition")) for s in sides for c in conditions]))
    return df.select("*", grid.alias("_x")).select(*df.columns, "_x.side", "_x.condition", F.concat_ws("::", F.col(id_).cast("string"), "_x.side", "_x.condition").alias("row_id"))


def imported(manifest: DataFrame, predictions: DataFrame, id_: str, base: str, probes: str) -> DataFrame:
    """Manifest with imported texts; probes that are blank or repeat the base text go (GEN8)."""
    out = manifest.join(predictions.select(id_, base, probes), id_, "left")
    return out.withColumn(probes, F.filter(probes, lambda p: (F.trim(p) != "") & (p != F.col(base))))


def guarded(df: DataFrame, label_only: list[str]) -> DataFrame:
    """The frame without columns that only labels may use (FLT17)."""
    return df.drop(*label_only)


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``_pos``, the row's place (from 0) in the given order."""
    return numbered(df, list(order))


def of_kinds(df: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """Rows of some kinds, case aside; a row without a kind has none (FLT1)."""
    return df.where(F.lower(F.coalesce(F.col(column), F.lit(""))).isin([k.lower() for k in kinds]))


def aligned_only(df: DataFrame, alignments: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """(rows with an alignment, one row with the number of those without) (FLT2)."""
    keys = alignments.select(id_).distinct()
    return df.join(keys, id_, "left_semi"), df.join(keys, id_, "left_anti").agg(F.count(F.lit(1)).alias("excluded"))


def partition_rows(df: DataFrame, split: str | None = None, kind: str | None = None) -> DataFrame:
    """Rows of a split, of a kind of fact, or of both (FLT4)."""
    out = df if split is None else df.where(F.col("split") == split)
    return out if kind is None else out.where(F.col("fact_type") == kind)


def missing_conditions(df: DataFrame, required: list[str], condition: str = "condition") -> DataFrame:
    """Required conditions that no row has (FLT11)."""
    wanted = df.sparkSession.createDataFrame([(c,) for c in required], f"{condition} string")
    return wanted.join(df.select(condition).distinct(), condition, "left_anti")


def annotation_flags(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a text matches, in their order: why a person should look at it (FLT15)."""
    return F.filter(F.array(*[F.when(text.rlike(p), n) for n, p in patterns.items()]), lambda x: x.isNotNull())


def second_backend(df: DataFrame, kind: str = "number", rewrites: dict[str, str] | None = None) -> DataFrame:
    """The controlled rows that a second backend is asked about, with its settings in place of the first one's (FLT16)."""
    out = df.where(F.col("fact_type") == kind)
    return out.withColumns({c: F.lit(v) for c, v in (rewrites or {}).items()})


def probes_of(df: DataFrame, names: list[str], folder: str, id_: str = "id") -> DataFrame:
    """Adds ``probes``: (name, audio) of each derived signal, at a path made of the row's safe id (GEN6)."""
    from hedgerow.functions.hashing import safe_id

    paths = [F.struct(F.lit(n).alias("name"), F.concat(F.lit(f"{folder}/{n}/"), safe_id(id_), F.lit(".wav")).alias("audio")) for n in names]
    return df.withColumn("probes", F.array(*paths))


def revised(manifest: DataFrame, rebuilt: DataFrame, digest: list[str], id_: str = "id", content: str = "audio_sha256") -> DataFrame:
    """Manifest with rebuilt rows in place of old ones; ``requires_fresh_prediction`` where the content changed, and a digest of each row (GEN7)."""
    from hedgerow.functions.hashing import fingerprint

    from .contracts import overlay

    was = manifest.select(F.col(id_), F.col(content).alias("_was"))
    out = overlay(manifest, rebuilt, id_).join(was, id_, "left")
    return out.select(*manifest.columns, (~F.col(content).eqNullSafe(F.col("_was"))).alias("requires_fresh_prediction"), fingerprint(*digest).alias("row_digest"))


def annotation_sheet(df: DataFrame, shown: list[str], human: list[str], annotators: int, seed: int, id_: str = "id") -> DataFrame:
    """Blinded rows in a seeded order of each annotator, human columns blank (GEN9).

    The order is that of a hash, not of another language's generator.
    """
    from hedgerow.functions.hashing import stable_hex

    who = df.select(F.col(id_), *shown, F.explode(F.sequence(F.lit(1), F.lit(annotators))).alias("annotator"))
    keyed = who.withColumn("_key", stable_hex(F.concat_ws(":", "annotator", F.col(id_).cast("string")), seed))
    placed = numbered(keyed, ["annotator", "_key"], "_at")
    start = Window.partitionBy("annotator")
    blind = placed.select("annotator", (F.col("_at") - F.min("_at").over(start) + 1).alias("row"), *shown, *[F.lit("").alias(h) for h in human], F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_).cast("string")), 256).alias("item"))
    return blind.withColumn("item", F.substring("item", 1, 12))
