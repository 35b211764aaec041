"""Training, transfer and checkpoints of risk heads (MDL9, MDL10, MDL12-MDL16, MET9, MET10, SNK8, SRC10, SPL3, FLT13, FLT14).

A head is a preparation, a model, a calibration and a threshold. Heads are fitted one
after another, as each is a set of Spark jobs over the whole training split; what
they score is one long table (id, method, raw, calibrated, threshold), and metrics
of all heads and slices come from one grouped pass over it.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.functions.hashing import SEED

from . import contracts, heads, metrics, selection
from .cohorts import availability
from .graph import checkpointed

# Groups of features, the heads made of them, and the shares that are reported.
TEXT = ["sequence_nll", "token_entropy", "beam_margin_risk", "output_length"]
SPEECH = ["asr_sequence_nll", "asr_token_entropy"]
WAVE = ["audio_duration", "audio_rms_db", "audio_zero_fraction", "audio_spectral_entropy", "audio_clipping_fraction"]
PROBES = ["perturb_mean_distance", "perturb_max_distance"]
SAMPLES = ["sample_mean_distance", "sample_number_disagreement", "sample_negation_disagreement"]
EVIDENCE = ["cascade_sequence_nll", "evidence_text_distance", "evidence_number_mismatch", "evidence_negation_mismatch", "evidence_coverage_gap"]
GROUPS = {"text": TEXT, "speech": SPEECH, "wave": WAVE, "probes": PROBES, "samples": SAMPLES, "evidence": EVIDENCE}
FIXED = (0.8, 0.9, 0.95)
THRESHOLD_QUANTILE = 0.9
SEEDS = (20260906, 20260907, 20260908, 20260909, 20260910)


def without(*left_out: str) -> list[str]:
    return [f for g, names in GROUPS.items() if g not in left_out for f in names]


#: Heads by their features (FLT14); the first part of a name is the kind of model.
REGISTRY: dict[str, list[str]] = {
    "et_full": without(),
    "et_evidence": EVIDENCE,
    "et_asr_evidence": SPEECH + EVIDENCE,
    "et_without_acoustic": without("speech", "wave"),
    "et_without_stability": without("probes", "samples"),
    "et_without_evidence": without("evidence"),
    "et_without_waveform": without("wave"),
    "et_without_sampling": without("samples"),
    "et_without_probes": without("probes"),
    "lr_full": without(),
    "hgb_full": without(),
    "lr_sequence_probability": ["sequence_nll"],
    "lr_token_entropy": ["token_entropy"],
    "lr_asr": SPEECH,
    "lr_qe": ["qe_risk"],
    "lr_self_consistency": SAMPLES,
    "lr_perturbation": PROBES,
    "lr_evidence": EVIDENCE,
}


def legacy_registry(present: Iterable[str] | None = None, formal: bool = False) -> dict[str, list[str]]:
    """The older methods; heads over all features drop those without any value unless the protocol is formal (FLT13)."""
    fact = ["evidence_text_distance", "evidence_fact_mismatch", "evidence_coverage_gap"]
    acoustic, stability = SPEECH + WAVE, ["perturb_mean_distance", "perturb_max_distance", "sample_mean_distance", "sample_fact_disagreement"]
    evidence = ["cascade_sequence_nll", *fact]
    full = TEXT + acoustic + stability + evidence
    usable = full if formal or present is None else [f for f in full if f in set(present)]
    out = {
        "sequence_probability": TEXT[:1], "token_entropy": TEXT[1:2], "beam_margin": TEXT[2:3], "asr_confidence": SPEECH, "qe": ["qe_risk"],
        "self_consistency": stability[2:], "perturbation_only": PROBES, "entailment_only": fact,
        "ablation_text": TEXT, "ablation_text_acoustic": TEXT + acoustic, "ablation_text_acoustic_stability": TEXT + acoustic + stability,
        "logreg_model_agnostic": acoustic + PROBES + evidence,
    }
    return out | {f"{kind}_audio_grounded": usable for kind in ("logreg", "mlp", "hgb", "interaction")}


def kind_of(method: str) -> str:
    """et, hgb, mlp or lr."""
    first = method.split("_")[0]
    return {"interaction": "et", "et": "et", "hgb": "hgb", "mlp": "mlp"}.get(first, "lr")


# ------------------------------------------------------------------- checks


def split_check(df: DataFrame, group: str, y: str = "y", split: str = "split") -> None:
    """Raise unless groups stay in one split, ids are no issue, and train and calibration hold both labels (SPL3)."""
    contracts.require(contracts.leakage(df, [group], split).agg(F.sum("leaking").alias("shared_groups")), "splits")
    kinds = df.where(F.col(split).isin("train", "calibration") & F.col(y).isNotNull()).groupBy(split).agg(F.count_distinct(y).alias("n"))
    found = {r[split]: r["n"] for r in kinds.collect()}
    if any(found.get(s, 0) < 2 for s in ("train", "calibration")):
        raise contracts.ContractError("training and calibration must hold both labels")


# --------------------------------------------------------------------- heads


@dataclass
class Head:
    """A fitted head: everything that scoring needs, and what it was fitted with."""

    name: str
    features: list[str]
    preparation: heads.Preparation
    model: object
    a: float
    b: float
    threshold: float
    seed: int = SEED
    protocol: str = ""
    more: dict = field(default_factory=dict)

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """The kept columns, method, raw and calibrated risk, and the threshold."""
        ready = self.preparation.apply(df)
        raw = self.model.scored(ready, "raw") if isinstance(self.model, heads.Fitted) else ready.withColumn("raw", self.model.score(ready))
        calibrated = heads.sigmoid(F.lit(self.a) * heads.logit("raw") + F.lit(self.b))
        return raw.select(*keep, F.lit(self.name).alias("method"), "raw", calibrated.alias("calibrated"), F.lit(self.threshold).alias("threshold"))


def _fit(kind: str, ready: DataFrame, width: int, y: str, seed: int, trees: int) -> object:
    if kind == "et":
        return heads.fit_forest(ready, y, trees, seed=seed)
    if kind == "hgb":
        return heads.Fitted(heads.fit_boosting(ready, y, seed=seed))
    if kind == "mlp":
        return heads.Fitted(heads.fit_perceptron(ready, width, y, seed))
    return heads.fit_logistic(ready, y)


def fit_head(train: DataFrame, calibration: DataFrame, name: str, features: list[str], y: str = "y", seed: int = SEED, trees: int = 600, protocol: str = "", legacy: bool = False) -> Head:
    """Fit on train, calibrate on calibration, threshold at a quantile of the calibrated risk; unlabelled rows are left out."""
    train, calibration = (d.where(F.col(y).isNotNull()) for d in (train, calibration))
    preparation = heads.prepare(train, features)
    model = _fit(kind_of(name), preparation.apply(train), len(preparation.columns), y, seed, trees)
    blank = Head(name, features, preparation, model, 1.0, 0.0, 0.5, seed, protocol)
    raw = checkpointed(blank.score(calibration, [y]), "calibration")
    a, b = heads.fit_platt(raw, ["method"], y, legacy=legacy).select("a", "b").first()
    calibrated = raw.select("method", heads.sigmoid(F.lit(a) * heads.logit("raw") + F.lit(b)).alias("p"))
    if legacy:
        threshold = metrics.quantile_higher(calibrated, ["method"], "p", THRESHOLD_QUANTILE).first()["threshold"]
    else:
        threshold = calibrated.agg(metrics.quantile_linear("p", THRESHOLD_QUANTILE).alias("t")).first()["t"]
    return dataclasses.replace(blank, a=float(a), b=float(b), threshold=float(threshold))


def train_heads(df: DataFrame, registry: dict[str, list[str]], group: str, keep: list[str], y: str = "y", split: str = "split", seed: int = SEED, trees: int = 600, legacy: bool = False) -> tuple[dict[str, Head], DataFrame, dict[str, str]]:
    """Fit every head whose features have values in all splits: (heads, scores of the test split, reasons of the others) (MDL9, MDL10)."""
    split_check(df, group, y, split)
    names = sorted({f for fs in registry.values() for f in fs if f in df.columns})
    empty = {r["feature"] for r in availability(df, split, names).where("not available").collect()} if names else set()
    parts = {s: df.where(F.col(split) == s) for s in ("train", "calibration", "test")}
    fitted, reasons = {}, {}
    for name, features in registry.items():
        missing = [f for f in features if f not in df.columns or f in empty]
        if missing or not features:
            reasons[name] = f"{missing[0]} is entirely missing in a split" if missing else "no usable features"
            continue
        fitted[name] = fit_head(parts["train"], parts["calibration"], name, features, y, seed, trees, legacy=legacy)
    return fitted, score_all(parts["test"], fitted.values(), keep), reasons


def score_all(df: DataFrame, fitted: Iterable[Head], keep: list[str]) -> DataFrame:
    """Long scores of all heads."""
    parts = [h.score(df, keep) for h in fitted]
    if not parts:
        raise contracts.ContractError("no head could be fitted")
    return reduce(DataFrame.union, parts)


def select_by_folds(train: DataFrame, candidates: dict[str, list[str]], group: str, y: str = "y", folds: int = 5, seed: int = SEED, trees: int = 600) -> tuple[str, DataFrame]:
    """The candidate with the lowest error area over folds of groups of the training split; earlier names win ties (MDL10)."""
    from .splits import folds_by_size

    known = train.where(F.col(y).isNotNull())
    dealt = checkpointed(known.join(folds_by_size(known, group, folds), group), "folds")
    scored = None
    for name, features in candidates.items():
        for k in range(folds):
            inside = dealt.where(F.col("fold") != k)
            preparation = heads.prepare(inside, features)
            model = _fit(kind_of(name), preparation.apply(inside), len(preparation.columns), y, seed, trees)
            one = Head(name, features, preparation, model, 1.0, 0.0, 0.5).score(dealt.where(F.col("fold") == k), [y, "fold"])
            scored = one if scored is None else scored.union(one)
    areas = metrics.aurc(scored, ["method"], y, "raw")
    order = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(candidates) for x in (n, i)]), F.col("method"))
    best = areas.select("method", "aurc", order.alias("place")).orderBy("aurc", "place").first()["method"]
    return best, areas


# --------------------------------------------------------------- checkpoints


def digest_of(payload: object) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, default=str).encode()).hexdigest()


def head_digest(head: Head) -> str:
    """Digest of what the head was fitted to; the same fit gives the same digest."""
    return digest_of(_document(head))


def _document(head: Head) -> dict:
    model = {"forest": head.model.digest()} if isinstance(head.model, heads.Forest) else {"coefficients": head.model.coefficients, "intercept": head.model.intercept} if isinstance(head.model, heads.Logistic) else {"class": type(head.model.model).__name__, "text": getattr(head.model.model, "toDebugString", "")}
    return {"name": head.name, "features": head.features, "preparation": dataclasses.asdict(head.preparation), "model": model, "a": head.a, "b": head.b, "threshold": head.threshold, "seed": head.seed, "protocol": head.protocol, "more": head.more}


def save_head(spark: SparkSession, head: Head, folder: str) -> str:
    """Write a head below a folder of any Hadoop file system; its digest (SNK8). The document is last, so a half-written head has none.

    A forest is a table of its trees, of which the document holds the digest.
    """
    if isinstance(head.model, heads.Forest):
        head.model.save(spark, f"{folder}/{head.name}/model")
    if isinstance(head.model, heads.Fitted):
        head.model.model.write().overwrite().save(f"{folder}/{head.name}/model")
    spark.createDataFrame([(head_digest(head), json.dumps(_document(head), sort_keys=True))], "digest string, document string").coalesce(1).write.mode("overwrite").json(f"{folder}/{head.name}/head")
    return head_digest(head)


def load_head(spark: SparkSession, folder: str, name: str, digest: str | None = None) -> Head:
    """Read a head back (SRC10); another digest than the wanted one is refused."""
    row = spark.read.schema("digest string, document string").json(f"{folder}/{name}/head").first()
    if digest is not None and row["digest"] != digest:
        raise contracts.ContractError(f"{name} differs from the frozen head")
    d = json.loads(row["document"])
    m = d["model"]
    if "forest" in m:
        model: object = heads.Forest.load(spark, f"{folder}/{name}/model")
        if model.digest() != m["forest"]:
            raise contracts.ContractError(f"the trees of {name} differ from its document")
    elif "coefficients" in m:
        model = heads.Logistic(m["coefficients"], m["intercept"])
    else:
        from pyspark.ml import classification

        model = heads.Fitted(getattr(classification, m["class"]).load(f"{folder}/{name}/model"))
    return Head(d["name"], d["features"], heads.Preparation(**d["preparation"]), model, d["a"], d["b"], d["threshold"], d["seed"], d["protocol"], d["more"])


# -------------------------------------------------------------------- records


def describe(scores: DataFrame, by: list[str], y: str = "y", raw: str = "raw", calibrated: str = "calibrated", threshold: str = "threshold", id_: str = "id", clean: Column | None = None, fixed: tuple[float, ...] = FIXED) -> DataFrame:
    """One record per slice: counts, ranking, calibration, fixed shares and the operating point (MET9).

    ``by`` names the slice (method, cohort, condition). Metrics that are not defined
    are NULL.
    """
    known = scores.where(F.col(y).isNotNull())
    over = (F.lit(True) if clean is None else clean) & (F.col(y) == 0)
    base = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(y).isNull()).alias("unresolved"),
        F.avg(F.col(y).cast("double")).alias("base_known_risk"),
        F.avg(F.when(over, (F.col(calibrated) >= F.col(threshold)).cast("double"))).alias("clean_over_abstention"),
    )
    operating = metrics.selective(scores.withColumn("_keep", F.col(calibrated) < F.col(threshold)), by, y, "_keep")
    parts = [
        metrics.aurc(scores, by, y, raw).select(*by, F.col("aurc").alias("aurc_known")),
        metrics.auroc(scores, by, y, raw).select(*by, F.col("auroc").alias("auroc_known")),
        metrics.brier(known, by, y, raw).select(*by, F.col("brier").alias("brier_raw")),
        metrics.brier(known, by, y, calibrated).select(*by, F.col("brier").alias("brier_calibrated")),
        metrics.ece(scores, by, y, raw, id_).select(*by, F.col("ece").alias("ece_raw")),
        metrics.ece(scores, by, y, calibrated, id_).select(*by, F.col("ece").alias("ece_calibrated")),
        operating.select(*by, *[F.col(c).alias(f"operating_{c}") for c in ("k", "e", "u", "coverage", "known_risk", "risk_lower", "risk_upper", "capture")]),
    ]
    grid = metrics.retained_grid(scores, by, list(fixed), y, raw, id_)
    at = lambda c, f: F.max(F.when(F.col("target") == f, F.col(c))).alias(f"{c}_at_{round(100 * f)}")
    parts.append(grid.groupBy(*by).agg(*[at(c, f) for f in fixed for c in ("k", "e", "u", "risk_lower", "risk_upper")]))
    # few rows each: one for each slice
    return reduce(lambda a, b: a.join(b, by, "left"), parts, base)


def flattened(records: DataFrame, cohort: Column, seed: Column, at: int = 90) -> DataFrame:
    """The columns of a record that a table of cohorts, methods and seeds shows (ORC10)."""
    renamed = {"aurc": "aurc_known", f"kept{at}": f"k_at_{at}", f"errors{at}": f"e_at_{at}", f"unresolved{at}": f"u_at_{at}", f"lower{at}": f"risk_lower_at_{at}", f"upper{at}": f"risk_upper_at_{at}"}
    renamed |= {f"frozen_{n}": f"operating_{c}" for n, c in (("coverage", "coverage"), ("kept", "k"), ("errors", "e"), ("unresolved", "u"), ("lower", "risk_lower"), ("upper", "risk_upper"))}
    return records.select(cohort.alias("cohort"), "method", seed.alias("seed"), *[F.col(c).alias(n) for n, c in renamed.items()])


# ------------------------------------------------------------------- transfer


def transfer(df: DataFrame, fitted: dict[str, Head], frozen: dict[str, str], keep: list[str], split: str = "split", kind: str = "fact_type") -> tuple[DataFrame, dict[str, str]]:
    """Score an external cohort with frozen heads: nothing is fitted, a head that differs from the protocol is refused (MDL12, MDL14)."""
    contracts.require(df.agg(F.count_if(F.col(split) != "test").alias("not_test"), F.count_if(F.col(kind) != "number").alias("not_number")), "external cohort")
    changed = [n for n, h in fitted.items() if frozen.get(n) != head_digest(h)]
    if changed:
        raise contracts.ContractError(f"heads differ from the frozen protocol: {changed}")
    names = sorted({f for h in fitted.values() for f in h.features if f in df.columns})
    empty = {r["feature"] for r in availability(df, split, names).where("not available").collect()}
    reasons = {n: "an entire feature is missing" for n, h in fitted.items() if any(f in empty or f not in df.columns for f in h.features)}
    return score_all(df, [h for n, h in fitted.items() if n not in reasons], keep), reasons


def freeze(fitted: dict[str, Head], manifest: str) -> dict:
    """What an external evaluation must not change: the digests of the heads and of the cohort's manifest (MDL14, GAT1)."""
    return {"heads": {n: head_digest(h) for n, h in fitted.items()}, "manifest": manifest}


def array_head(train: DataFrame, calibration: DataFrame, array: str, width: int, name: str, y: str = "y") -> Head:
    """A logistic baseline over the cells of an array column, such as attention or likelihood summaries (MDL13)."""
    cells = [f"{array}_{i}" for i in range(width)]
    spread = lambda d: d.select("*", *[F.get(F.col(array), i).alias(c) for i, c in enumerate(cells)])
    head = fit_head(spread(train), spread(calibration), f"lr_{name}", cells, y)
    return dataclasses.replace(head, more={"array": array, "width": width})


def score_array(head: Head, df: DataFrame, keep: list[str]) -> DataFrame:
    array, width = head.more["array"], head.more["width"]
    return head.score(df.select("*", *[F.get(F.col(array), i).alias(f"{array}_{i}") for i in range(width)]), keep)


def extension_report(scores: DataFrame, keys: list[str], y: str = "y", value: str = "calibrated") -> DataFrame:
    """Diagnostics of an extension's scores by method, overall and by each key (MDL15, AGG5)."""
    sets = [[F.col("method")], *[[F.col("method"), F.col(k)] for k in keys]]
    return scores.groupingSets(sets, "method", *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("error_rate"), F.avg(value).alias("mean_value"))


# ----------------------------------------------------------------- seed grids


def seed_grid(cohorts: dict[str, DataFrame], training: dict[str, DataFrame], registry: dict[str, list[str]], folder: str, protocol: dict, backend_of: dict[str, str], keep: list[str], seeds: tuple[int, ...] = SEEDS, trees: int = 600) -> DataFrame:
    """Records of every cohort, method and seed (MDL16).

    A head that the folder holds is used again if its protocol is the same, and
    refused otherwise; there is no choice of a best seed. A logistic head draws nothing, so it is
    fitted once for all seeds. The scores of all heads are one table, described in one grouped pass.
    """
    spark = next(iter(training.values())).sparkSession
    wanted, scored = digest_of(protocol), []
    for backend, df in training.items():
        parts = {s: df.where(F.col("split") == s) for s in ("train", "calibration")}
        seedless: dict[str, Head] = {}
        for seed in seeds:
            for name, features in registry.items():
                place = f"{folder}/{backend}/{seed}"
                if exists(spark, f"{place}/{name}/head/_SUCCESS"):
                    head = load_head(spark, place, name)
                    if head.protocol != wanted:
                        raise contracts.ContractError(f"{place}/{name} is of another protocol")
                else:
                    head = seedless.get(name) or fit_head(parts["train"], parts["calibration"], name, features, seed=seed, trees=trees, protocol=wanted)
                    head = dataclasses.replace(head, seed=seed)
                    save_head(spark, head, place)
                if kind_of(name) == "lr":
                    seedless[name] = head
                for cohort in (c for c, b in backend_of.items() if b == backend):
                    scored.append(head.score(cohorts[cohort], keep).select(F.lit(cohort).alias("cohort"), F.lit(seed).alias("seed"), "*"))
    scores = checkpointed(reduce(DataFrame.union, scored), "seed-scores")
    return flattened(describe(scores, ["cohort", "seed", "method"]), F.col("cohort"), F.col("seed")).orderBy("cohort", "seed", "method")  # few rows


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def empty_sensitivity(original: DataFrame, included: DataFrame, by: list[str], y: str = "y", id_: str = "id", atol: float = 1e-12) -> DataFrame:
    """Two score tables of the same rows under two feature variants, compared by method (SEN4).

    Changed risks, change of the error area, and how far the retained sets differ.
    """
    a = original.select(*by, id_, y, F.col("raw").alias("raw_a"), F.col("calibrated").alias("cal_a"), "threshold")
    both = a.join(included.select(*by, id_, F.col("raw").alias("raw_b"), F.col("calibrated").alias("cal_b")), [*by, id_])
    contracts.require(original.select(*by, id_).exceptAll(both.select(*by, id_)).agg(F.count(F.lit(1)).alias("rows_without_a_partner")), "variants")
    top = selection.keep_top(both, by, "raw_a", id_, 0.9).withColumnRenamed("keep", "top_a")
    top = selection.keep_top(top, by, "raw_b", id_, 0.9).withColumnRenamed("keep", "top_b")
    counts = top.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.abs(F.col("raw_a") - F.col("raw_b")) > atol).alias("changed_rows"),
        F.count_if(F.col("top_a") != F.col("top_b")).alias("top90_difference"),
        F.count_if((F.col("cal_a") < F.col("threshold")) != (F.col("cal_b") < F.col("threshold"))).alias("operating_difference"),
    )
    area = metrics.aurc(both, by, y, "raw_b").select(*by, F.col("aurc").alias("b")).join(metrics.aurc(both, by, y, "raw_a").select(*by, F.col("aurc").alias("a")), by)
    return counts.join(area.select(*by, (F.col("b") - F.col("a")).alias("delta_aurc")), by, "left")
