"""Feature assembly as one projection (FEA1-FEA9, MAP1, TXT15, FMT3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.functions import text as X

#: The fused features, in their order.
FEATURES = [
    "sequence_nll", "token_entropy", "beam_margin_risk", "output_length",
    "perturb_mean_distance", "perturb_max_distance", "sample_mean_distance", "sample_number_disagreement", "sample_negation_disagreement",
    "asr_sequence_nll", "asr_token_entropy", "cascade_sequence_nll",
    "evidence_text_distance", "evidence_number_mismatch", "evidence_negation_mismatch", "evidence_coverage_gap",
    "audio_duration", "audio_rms_db", "audio_zero_fraction", "audio_spectral_entropy", "audio_clipping_fraction",
]


def number_or_null(c: str | Column) -> Column:
    """A float, NULL if it is none, NaN or infinite (FMT3, MTH7)."""
    v = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def perturbation(base: str, probes: str, keep_blank: bool = False) -> Column:
    """(mean, max) normalised distance of the base text to its probes (FEA3); blank probes count only if asked (FEA8)."""
    kept = F.col(probes) if keep_blank else F.filter(probes, lambda p: F.trim(p) != "")
    u = lambda c: X.units(X.normalize(c, form=False))
    d = X.let(u(F.col(base)), lambda b: F.transform(kept, lambda p: X.normalized_distance(b, u(p))))
    mean = lambda d: F.aggregate(d, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(d), F.lit(0))
    return X.let(d, lambda d: F.struct(mean(d).alias("mean"), F.array_max(d).alias("max")))


def evidence(translation: str, cascade: str) -> Column:
    """(distance, coverage gap) to the evidence text; NULL without one."""
    u = lambda c: X.units(X.normalize(F.col(c), form=False))
    there = F.trim(F.coalesce(F.col(cascade), F.lit(""))) != ""
    both = F.when(there, F.struct(u(cascade).alias("c"), u(translation).alias("t")))
    of = lambda p, made: F.when(p.isNotNull(), made(p["c"], p["t"]))
    return X.let(both, lambda p: F.struct(of(p, X.normalized_distance).alias("distance"), of(p, X.coverage_gap).alias("gap")))


def feature_rows(df: DataFrame, translation: str = "translation", probes: str = "probes", cascade: str = "cascade") -> DataFrame:
    """Text features of joined manifest, prediction and evidence rows; a missing translation is an error, an empty one is not (FEA2)."""
    checked = F.when(F.col(translation).isNull(), F.raise_error(F.lit("missing translation")).cast("string")).otherwise(F.trim(translation))
    base = df.withColumn(translation, checked)
    return base.select(
        *df.columns,
        X.word_total(translation).cast("double").alias("output_length"),
        perturbation(translation, probes).alias("_p"),
        evidence(translation, cascade).alias("_e"),
    ).select(*df.columns, "output_length", F.col("_p.mean").alias("perturb_mean_distance"), F.col("_p.max").alias("perturb_max_distance"), F.col("_e.distance").alias("evidence_text_distance"), F.col("_e.gap").alias("evidence_coverage_gap"))


def validation(df: DataFrame, split: str, y: str) -> DataFrame:
    """Rows by split and label, unresolved ones included (FEA7, AGG3)."""
    return df.groupBy(split, F.coalesce(F.col(y).cast("string"), F.lit("unresolved")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def deployment_features(df: DataFrame, id_: str, translation: str = "translation", samples: str = "sample_translations", evidence_text: str = "cascade_translation") -> DataFrame:
    """(id, sample_*_disagreement, evidence_*_mismatch) (FEA4): one row per text is read once, samples are exploded for it."""
    texts = F.concat(F.array(F.coalesce(F.col(translation), F.lit(""))), F.coalesce(F.col(samples), F.expr("cast(array() as array<string>)")))
    long = df.select(F.col(id_), F.posexplode(texts).alias("at", "t"))
    signed = long.select(id_, "at", F.to_json(X.signature("t", "number")).alias("number"), F.to_json(X.signature("t", "negation")).alias("negation"))
    share = lambda k: F.when(F.max("at") > 0, (F.count_distinct(k) - 1) / F.max("at")).alias(f"sample_{k}_disagreement")
    own = lambda k: F.max(F.when(F.col("at") == 0, F.col(k))).alias(f"_{k}")
    per = signed.groupBy(id_).agg(share("number"), share("negation"), own("number"), own("negation"))
    e = df.select(F.col(id_), F.when(F.trim(F.coalesce(F.col(evidence_text), F.lit(""))) != "", F.col(evidence_text)).alias("e"))
    e = e.select(id_, *[F.when(F.col("e").isNotNull(), F.to_json(X.signature("e", k))).alias(f"_e_{k}") for k in ("number", "negation")])
    mismatch = lambda k: (F.col(f"_{k}") != F.col(f"_e_{k}")).cast("double").alias(f"evidence_{k}_mismatch")
    return per.join(e, id_).select(id_, "sample_number_disagreement", "sample_negation_disagreement", mismatch("number"), mismatch("negation"))


def corrected(old: DataFrame, repaired: DataFrame, labels: DataFrame, id_: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved rows, unresolved rows, coverage) after repaired rows and new labels are in place (FEA5).

    ``labels`` has (id, y, status); every row needs one.
    """
    from .contracts import contract_join, overlay

    rows = contract_join(overlay(old, repaired, id_), labels, id_)
    coverage = rows.groupBy(F.col("y").isNotNull().alias("included"), "split", "status").agg(F.count(F.lit(1)).alias("n"))
    return rows.where("y is not null"), rows.where("y is null"), coverage


def external(manifest: DataFrame, predictions: DataFrame, evidence_rows: DataFrame, scores: DataFrame, id_: str = "id") -> DataFrame:
    """Features of an external cohort: exact id sets, estimator scores of the same inputs, no counterfactual (FEA6).

    ``scores`` has (id, score, input_fingerprint) and ``predictions`` the fingerprint of
    what was scored; ``unsupported`` is NULL where a row has no contrast.
    """
    from .contracts import id_contract, require

    for name, part, stale in (("predictions", predictions, None), ("evidence", evidence_rows, None)):
        require(id_contract(manifest, part, id_, stale), name)
    require(id_contract(predictions, scores, id_, [("input_fingerprint", "input_fingerprint")]), "estimator scores")
    rows = manifest.join(predictions.drop("input_fingerprint"), id_).join(evidence_rows, id_).join(scores.select(id_, F.col("score").alias("qe_risk")), id_)
    return feature_rows(rows, "translation", "probes", "cascade_translation").withColumn("unsupported", F.when(F.trim(F.coalesce("contrast_slot", F.lit(""))) != "", F.col("contrast_value_present")))
