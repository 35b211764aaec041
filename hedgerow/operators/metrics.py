"""Ranking, calibration and selective metrics (MET1-MET22, AGG4, TOP3, TOP4, WIN1-WIN3).

Inputs are long tables with one row per item: a label y that is 0, 1 or NULL
(unresolved), scores, and columns that name the slice. Rank metrics work on
counts per distinct score, which partial aggregation shrinks before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.functions.hashing import stable_hex

from .order import running
from .selection import kept_count, ranked

_EXACT = 64


def _harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: a table up to 63, from there the asymptotic series (error below 1e-13)."""
    table, total = [0.0], 0.0
    for i in range(1, _EXACT):
        total += 1 / i
        table.append(total)
    x = n.cast("double")
    series = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0)))
    return F.when(n < _EXACT, F.element_at(F.array(*map(F.lit, table)), (n + 1).cast("int"))).otherwise(series)


def tie_groups(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """Known labels by distinct score: m rows and e errors, n0 and c0 of those before."""
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    per = known.groupBy(*by, score).agg(F.count(F.lit(1)).alias("m"), F.sum(F.col(y).cast("double")).alias("e"))
    upto = running(per, by, [score], {"n1": "m", "c1": "e"})
    return upto.select(*per.columns, (F.col("n1") - F.col("m")).alias("n0"), (F.col("c1") - F.col("e")).alias("c0"))


def aurc(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Area under the risk-coverage curve, expected over random order of ties (MET1, MET2)."""
    t = tie_groups(df, by, y, score)
    p = F.col("e") / F.col("m")
    part = F.col("e") + (F.col("c0") - p * F.col("n0")) * (_harmonic(F.col("n0") + F.col("m")) - _harmonic(F.col("n0")))
    return t.groupBy(*by).agg((F.sum(part) / F.sum("m")).alias("aurc"), F.sum("m").alias("known"))


def aurc_row_order(df: DataFrame, by: list[str], y: str, score: str, position: str) -> DataFrame:
    """The older definition: ties in row order (MET3)."""
    known = df.where(F.col(y).isNotNull()).select(*by, score, position, F.col(y).cast("double").alias("_y"))
    run = running(known, by, [score, position], {"_e": "_y", "_n": F.lit(1)}).select(*by, (F.col("_e") / F.col("_n")).alias("r"))
    return run.groupBy(*by).agg(F.avg("r").alias("aurc"))


def auroc(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Probability that an error scores above a correct item, ties one half; NULL with one class (MET6)."""
    t = tie_groups(df, by, y, score)
    wins = F.col("e") * (F.col("n0") - F.col("c0") + 0.5 * (F.col("m") - F.col("e")))
    errors, rest = F.sum("e"), F.sum(F.col("m") - F.col("e"))
    return t.groupBy(*by).agg((F.sum(wins) / F.nullif(errors * rest, F.lit(0.0))).alias("auroc"))


def average_precision(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Step-wise area under precision and recall over distinct thresholds, highest first (MET7)."""
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    per = known.groupBy(*by, score).agg(F.count(F.lit(1)).alias("m"), F.sum(F.col(y).cast("double")).alias("e"))
    upto = running(per, by, [-F.col(score)], {"n1": "m", "c1": "e"})
    steps = upto.select(*by, "e", (F.col("c1") / F.col("n1")).alias("precision"))
    return steps.groupBy(*by).agg((F.sum(F.col("e") * F.col("precision")) / F.nullif(F.sum("e"), F.lit(0.0))).alias("average_precision"))


def brier(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Mean squared error of probabilities over known labels (MET5)."""
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"))


def bin_of(rank: Column, n: Column, bins: int) -> Column:
    """Equal-count bin (from 1) of a rank; the first ``n mod bins`` bins have one row more (WIN3)."""
    b = F.least(F.lit(bins).cast("long"), n)
    small = F.floor(n / b)
    more = n % b
    edge = more * (small + 1)
    return F.when(rank <= edge, F.ceil(rank / (small + 1))).otherwise(more + F.ceil((rank - edge) / small)).cast("int")


def reliability(df: DataFrame, by: list[str], y: str, p: str, id_: str, bins: int) -> DataFrame:
    """Bins of equal counts: mean probability and mean label of known items, ties by hash (TOP4)."""
    r = ranked(df.where(F.col(y).isNotNull()), by, p, id_).select(*by, y, p, bin_of(F.col("rank"), F.col("n"), bins).alias("bin"))
    return r.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def ece(df: DataFrame, by: list[str], y: str, p: str, id_: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over bins of equal counts (MET4)."""
    r = reliability(df, by, y, p, id_, bins)
    return r.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_y") - F.col("mean_p"))) / F.sum("n")).alias("ece"))


def selective(df: DataFrame, by: list[str], y: str = "y", keep: str = "keep") -> DataFrame:
    """Counts, bounds and capture of a selection; unresolved items stay in the denominator (MET8, MET13, MET15)."""
    k, e = F.count_if(keep), F.coalesce(F.sum(F.when(F.col(keep), F.col(y))), F.lit(0))
    u = F.count_if(F.col(keep) & F.col(y).isNull())
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), k.alias("k"), e.cast("long").alias("e"), u.alias("u"), F.coalesce(F.sum(F.when(~F.col(keep), F.col(y))), F.lit(0)).cast("long").alias("_lost")
    )
    some = F.nullif(F.col("k"), F.lit(0))
    return out.select(
        *by,
        "n",
        "k",
        "e",
        "u",
        (F.col("k") / F.col("n")).alias("coverage"),
        (F.col("e") / F.nullif(F.col("k") - F.col("u"), F.lit(0))).alias("known_risk"),
        (F.col("e") / some).alias("risk_lower"),
        ((F.col("e") + F.col("u")) / some).alias("risk_upper"),
        (F.col("_lost") / F.nullif(F.col("e") + F.col("_lost"), F.lit(0))).alias("capture"),
    )


def retained_grid(df: DataFrame, by: list[str], coverages: list[float], y: str = "y", score: str = "score", id_: str = "id") -> DataFrame:
    """Bounds at several coverages from one ranking: coverages look up running counts by rank (MET9, TOP3).

    One order of each slice; the grid is joined to the running counts at its own
    ranks only, so rows are never multiplied by the number of coverages.
    """
    counts = {"rank": F.lit(1), "e": F.coalesce(F.col(y), F.lit(0)), "u": F.col(y).isNull().cast("long")}
    run = running(df.select(*by, y, score, id_), by, [F.col(score), stable_hex(id_)], counts, ["rank"]).withColumnRenamed("total_rank", "n")
    points = run.select(*by, "rank", "n", "e", "u", F.explode(F.filter(F.array(*map(F.lit, coverages)), lambda c: kept_count(F.col("n"), c) == F.col("rank"))).alias("target"))
    return points.select(*by, "target", "n", F.col("rank").alias("k"), F.col("e").cast("long").alias("e"), F.col("u").cast("long").alias("u"), (F.col("e") / F.col("rank")).alias("risk_lower"), ((F.col("e") + F.col("u")) / F.col("rank")).alias("risk_upper"))


def slices(df: DataFrame, condition: str, name: str = "slice") -> DataFrame:
    """Each row once for the slice ALL and once for its condition, so that ranks are slice-local (MET11)."""
    return df.select("*", F.explode(F.array(F.lit("ALL"), F.col(condition).cast("string"))).alias(name)).where(F.col(name).isNotNull())


def leave_one_out(df: DataFrame, cluster: str, y: str = "y", score: str = "score") -> DataFrame:
    """AURC without each cluster in turn (MET12): all of them in one pass over rows summed to (score, cluster).

    Clusters are numbered in order; what moves are those sums and one vector with an
    entry for each cluster from every range of scores. A null cluster is one too.
    """
    from .order import numbered
    from .replicates import Weights, replicate_areas

    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    own = known.groupBy(score, cluster).agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum(F.col(y).cast("double")).alias("e"))
    names = numbered(own.select(F.col(cluster).alias("left_out")).distinct(), ["left_out"], "number")
    rows = own.join(names, F.col(cluster).eqNullSafe(F.col("left_out"))).select(F.lit(0).alias("all"), score, F.col("number").cast("int").alias("cluster"), "m", "e")
    areas = replicate_areas(rows, ["all"], [score], Weights(names.count()))
    return areas.join(names, F.col("replicate") == F.col("number")).select("left_out", "aurc")


def quantile_linear(score: str | Column, q: float) -> Column:
    """Quantile between order statistics, as an aggregate (MET18)."""
    return F.percentile(score, F.lit(q))


def quantile_higher(df: DataFrame, by: list[str], score: str, q: float) -> DataFrame:
    """The order statistic at or above the quantile's place (MET19), from counts per distinct score."""
    some = df.where(F.col(score).isNotNull())
    per = some.groupBy(*by, score).agg(F.count(F.lit(1)).alias("m"))
    upto = running(per, by, [score], {"upto": "m"}, ["upto"]).withColumnRenamed("total_upto", "n")
    return upto.where(F.col("upto") >= F.ceil((F.col("n") - 1) * F.lit(q)) + 1).groupBy(*by).agg(F.min(score).alias("threshold"))


def mark_threshold(df: DataFrame, by: list[str], score: str, accept_below: str, share: float) -> DataFrame:
    """Quantile 1 - share of the scores below a row's accept threshold, that threshold where there are none (MET20)."""
    inside = F.when(F.col(score) < F.col(accept_below), F.col(score))
    return df.groupBy(*by).agg(F.coalesce(F.percentile(inside, F.lit(1 - share)), F.max(accept_below)).alias("mark"))


def over_abstention(df: DataFrame, by: list[str], y: str, p: str, clean: Column, threshold: float) -> DataFrame:
    """Share of clean, correct items at or above the threshold; NULL without such items (MET14)."""
    return df.groupBy(*by).agg(F.avg(F.when(clean & (F.col(y) == 0), (F.col(p) >= threshold).cast("double"))).alias("over_abstention"))


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks over complete pairs; NULL if a side is constant (AGG8)."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)

    def rank_of(c: str) -> DataFrame:
        per = both.groupBy(*by, c).agg(F.count(F.lit(1)).alias("m"))
        upto = running(per, by, [c], {"upto": "m"})
        return upto.select(*by, c, (F.col("upto") - (F.col("m") - 1) / 2).alias(f"rank_{c}"))

    joined = both.join(rank_of(a), [*by, a]).join(rank_of(b), [*by, b])
    rho = F.corr(f"rank_{a}", f"rank_{b}")
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(~F.isnan(rho), rho).alias("rho"))


def diagnostics(df: DataFrame, keys: list[str], y: str, value: str) -> DataFrame:
    """Count, error rate and mean value overall and by each key, in one pass of grouping sets (AGG1, AGG5)."""
    spark = df.sparkSession
    sets = "(), " + ", ".join(f"({k})" for k in keys)
    return spark.sql(
        f"select {', '.join(keys)}, count(*) n, avg(cast({y} as double)) error_rate, avg({value}) mean_value from {{df}} group by grouping sets ({sets})",
        df=df.select(*keys, y, value),
    )


def tie_hex(id_: str) -> Column:
    return stable_hex(id_)
