"""Risk heads and calibration (MDL1-MDL8, MDL11, MTH1, MTH2).

Imputation and scaling parameters are SQL aggregates; logistic heads are
pyspark.ml; extremely randomised trees are those of ``forest``; Platt scaling is Newton steps whose sums are grouped
aggregates, so no group is ever gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forest import Forest, fit_forest  # noqa: F401  (heads like the others)

#: Fixed value: the inverse strength of the older calibration.
LEGACY_RIDGE = 1e-6


# ---------------------------------------------------------------- preparation


@dataclass
class Preparation:
    """Medians, means and scales fitted on training rows; indicator columns for features with missing values then."""

    features: list[str]
    median: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]
    indicators: list[str]

    @property
    def columns(self) -> list[str]:
        return [*self.features, *[f"{f}_missing" for f in self.indicators]]

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds the array ``features_array``: imputed and scaled values, then the indicators (not scaled)."""
        values = [(F.coalesce(_finite(f), F.lit(self.median[f])) - self.mean[f]) / self.scale[f] for f in self.features]
        flags = [_finite(f).isNull().cast("double") for f in self.indicators]
        return df.withColumn("features_array", F.array(*values, *flags))


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def prepare(train: DataFrame, features: list[str]) -> Preparation:
    """Exact medians (midpoint of an even count) and population deviations after imputation (MDL1, MDL2)."""
    first = train.agg(*[F.percentile(_finite(f), F.lit(0.5)).alias(f"m{i}") for i, f in enumerate(features)], *[F.count_if(_finite(f).isNull()).alias(f"n{i}") for i, f in enumerate(features)]).first()
    usable = [f for i, f in enumerate(features) if first[f"m{i}"] is not None]
    median = {f: first[f"m{features.index(f)}"] for f in usable}
    filled = {f: F.coalesce(_finite(f), F.lit(median[f])) for f in usable}
    second = train.agg(*[F.avg(filled[f]).alias(f"a{i}") for i, f in enumerate(usable)], *[F.stddev_pop(filled[f]).alias(f"s{i}") for i, f in enumerate(usable)]).first()
    return Preparation(
        usable, median, {f: second[f"a{i}"] for i, f in enumerate(usable)}, {f: second[f"s{i}"] or 1.0 for i, f in enumerate(usable)}, [f for f in usable if first[f"n{features.index(f)}"]]
    )


def balanced(train: DataFrame, y: str) -> DataFrame:
    """Adds ``weight`` so that both classes weigh the same and all weights sum to the row count."""
    counts = {r[y]: r["count"] for r in train.where(F.col(y).isNotNull()).groupBy(y).count().collect()}
    n = sum(counts.values())
    case = F.lit(None).cast("double")
    for k, c in counts.items():
        case = F.when(F.col(y) == k, n / (len(counts) * c)).otherwise(case)
    return train.withColumn("weight", case)


# ---------------------------------------------------------------------- heads


@dataclass
class Logistic:
    coefficients: list[float]
    intercept: float

    def score(self, df: DataFrame, array: str = "features_array") -> Column:
        z = F.aggregate(F.zip_with(array, F.array(*map(F.lit, self.coefficients)), lambda a, b: a * b), F.lit(self.intercept), lambda t, x: t + x)
        return sigmoid(z)


def fit_logistic(train: DataFrame, y: str = "y", strength: float = 1.0, iterations: int = 2000) -> Logistic:
    """Ridge logistic regression with balanced classes; the penalty matches C = ``strength`` on a weighted sum of losses (MDL3)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = balanced(train.where(F.col(y).isNotNull()), y).select(F.col(y).cast("double").alias("label"), "weight", array_to_vector("features_array").alias("features"))
    n = data.count()
    model = LogisticRegression(maxIter=iterations, regParam=1 / (strength * n), elasticNetParam=0.0, standardization=False, weightCol="weight", tol=1e-10).fit(data)
    return Logistic([float(v) for v in model.coefficients], float(model.intercept))


@dataclass
class Fitted:
    """A model of pyspark.ml; its score is the probability of label 1."""

    model: object

    def score(self, df: DataFrame, array: str = "features_array") -> Column:
        raise TypeError("a pyspark.ml model scores a table; use scored")

    def scored(self, df: DataFrame, name: str, array: str = "features_array") -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        made = self.model.transform(df.withColumn("features", array_to_vector(array)))
        return made.select(*df.columns, vector_to_array("probability")[1].alias(name))


def fit_boosting(train: DataFrame, y: str = "y", rounds: int = 150, rate: float = 0.05, depth: int = 3, seed: int = 1):
    """Gradient-boosted trees of depth 3 (about seven leaves) by pyspark.ml (MDL5)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    data = balanced(train.where(F.col(y).isNotNull()), y).select(F.col(y).cast("double").alias("label"), "weight", array_to_vector("features_array").alias("features"))
    return GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=depth, minInstancesPerNode=20, weightCol="weight", seed=seed).fit(data)


def fit_perceptron(train: DataFrame, width: int, y: str = "y", seed: int = 1):
    """A perceptron with layers of 32 and 16 units by pyspark.ml (MDL6)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    data = train.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("label"), array_to_vector("features_array").alias("features"))
    return MultilayerPerceptronClassifier(layers=[width, 32, 16, 2], seed=seed, maxIter=200).fit(data)


# ---------------------------------------------------------------- calibration


def logit(p: str | Column) -> Column:
    """Log odds, clipped at 1e-6 (MTH1)."""
    p = F.col(p) if isinstance(p, str) else p
    low = lambda v: F.least(F.greatest(v, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(low(p) / F.least(F.greatest(1 - p, F.lit(1e-6)), F.lit(1.0)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def fit_platt(scores: DataFrame, by: list[str], y: str = "y", raw: str = "raw", steps: int = 40, legacy: bool = False) -> DataFrame:
    """(by, a, b) of sigmoid(a * logit(raw) + b) with a >= 0, a ridge of 1e-8 on the slope (MDL8).

    The ``legacy`` form has a free slope with a weak ridge on the sum of losses, and
    refuses scores whose labels are all the same (MDL7).

    Rows are summed per distinct score first; each Newton step is one grouped
    aggregate over those sums. Where the slope would be negative it is 0, and b is
    the log odds of the mean label.
    """
    spark = scores.sparkSession
    cells = scores.where(F.col(y).isNotNull()).groupBy(*by, logit(raw).alias("x")).agg(F.count(F.lit(1)).alias("m"), F.sum(F.col(y).cast("double")).alias("e")).cache()
    if legacy and cells.groupBy(*by).agg(F.sum("e").alias("e"), F.sum("m").alias("m")).where("e = 0 or e = m").count():
        raise ValueError("a calibration set must hold both labels")
    now = {tuple(r[c] for c in by): (1.0, 0.0) for r in cells.select(*by).distinct().collect()}
    kinds = ", ".join(f"{c} {scores.schema[c].dataType.simpleString()}" for c in by)
    table = lambda: spark.createDataFrame([(*k, a, b) for k, (a, b) in now.items()], f"{kinds}, a double, b double")
    for _ in range(steps):
        p = sigmoid(F.col("a") * F.col("x") + F.col("b"))
        w, g = F.col("m") * p * (1 - p), F.col("m") * p - F.col("e")
        sums = cells.join(F.broadcast(table()), by).groupBy(*by).agg(*[F.sum(v).alias(n) for n, v in {"n": F.col("m"), "e": F.col("e"), "gx": g * F.col("x"), "g": g, "wxx": w * F.col("x") * F.col("x"), "wx": w * F.col("x"), "w": w}.items()]).collect()
        moved = 0.0
        for r in sums:
            key = tuple(r[c] for c in by)
            a, b = now[key]
            ridge = LEGACY_RIDGE if legacy else 2e-8 * r["n"]
            hess = np.array([[r["wxx"] + ridge, r["wx"]], [r["wx"], r["w"]]]) + 1e-12 * np.eye(2)
            da, db = np.linalg.solve(hess, [r["gx"] + ridge * a, r["g"]])
            size = max(1.0, abs(da) / 5, abs(db) / 5)
            a2, b2 = a - da / size, b - db / size
            if a2 <= 0 and not legacy:
                mean = min(max(r["e"] / r["n"], 1e-6), 1 - 1e-6)
                a2, b2 = 0.0, float(np.log(mean / (1 - mean)))
            moved = max(moved, abs(a2 - a) + abs(b2 - b))
            now[key] = (float(a2), float(b2))
        if moved < 1e-10:
            break
    cells.unpersist()
    return table()


def apply_platt(scores: DataFrame, parameters: DataFrame, by: list[str], raw: str = "raw") -> DataFrame:
    """Adds ``calibrated``; the parameters are one row per head and are broadcast."""
    return scores.join(F.broadcast(parameters), by).select(*scores.columns, sigmoid(F.col("a") * logit(raw) + F.col("b")).alias("calibrated"))


def preselect(metrics: DataFrame, by: list[str], method: str, value: str, exclude: list[str]) -> DataFrame:
    """The method with the smallest value among those allowed, earlier names first in ties; a NULL value never wins (MDL11, TOP5)."""
    return metrics.where(F.col(value).isNotNull() & ~F.col(method).isin(exclude)).groupBy(*by).agg(F.min(F.struct(value, method)).alias("x")).select(*by, F.col(f"x.{method}").alias(method), F.col(f"x.{value}").alias(value))
