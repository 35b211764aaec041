"""Registered queries of fitted heads and of the quality of what they retain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.functions import text as X
from hedgerow.operators import graph, reporting, resample, selection, training

from . import bindings as B
from .catalogue import REPLICATES, query, rounded
from .experiments import _split_numeric

FEATURES = ["length", "upper", "symbols"]


@query()
def fold_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error areas of three candidates over folds of the training split; the best one comes first (MDL10)."""
    d = _split_numeric(spark, sf_dir).where("split = 'train'")
    best, areas = training.select_by_folds(d, {"lr_full": FEATURES, "lr_length": ["length"], "et_full": FEATURES}, "id", trees=60)
    return rounded(areas).withColumn("selected", F.col("method") == best)


@query()
def array_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic baseline over the cells of vectors, by label parity (MDL13)."""
    e = B.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("cells"), (F.col("label") % 2).alias("y"), B.split_of("vec_id").alias("split"))
    head = training.array_head(e.where("split = 'train'"), e.where("split = 'cal'"), "cells", 16, "vectors")
    return rounded(training.score_array(head, e.where("split = 'test'"), ["id", "y"]))


@query()
def frozen_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's document is frozen with a cohort's manifest and scores the cohort unchanged (MDL14)."""
    d = _split_numeric(spark, sf_dir)
    fitted, _, _ = training.train_heads(d, {"lr_length": ["length"]}, "id", ["id", "y"])
    frozen = training.freeze(fitted, "documents")
    scores, reasons = training.transfer(d.where("split = 'test'"), fitted, frozen["heads"], ["id", "y"])
    return rounded(scores).withColumn("unavailable", F.lit(len(reasons)))


@query()
def seed_grid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two cohorts by seed, head and backend; heads are kept and found again by protocol (MDL16)."""
    d = _split_numeric(spark, sf_dir)
    folder = f"{graph.shared_root(spark)}/grid-{reporting.fresh_id()}"
    training_sets = {"first": d, "second": d.where("length is not null")}
    cohorts = {"clean": d.where("split = 'test'"), "all": d}
    args = (cohorts, training_sets, {"lr_full": FEATURES, "lr_length": ["length"]}, folder, {"features": FEATURES}, {"clean": "first", "all": "second"}, ["id", "y"])
    training.seed_grid(*args, seeds=(1, 2))
    return rounded(training.seed_grid(*args, seeds=(1, 2)))  # from the folder's heads


_PAIRS = r"""with q0 as (select conv_id as cluster, conv_id::varchar || ':' || turn::varchar as id, length(text) as score, regexp_replace(text, '\s+', '', 'g') as h, lead(regexp_replace(text, '\s+', '', 'g')) over (partition by conv_id order by turn) as r, turn, lead(turn) over (partition by conv_id order by turn) as nt from conversations where text is not null),
q1 as (select * from q0 where nt = turn + 1), """


@query(
    _PAIRS
    + f"""k0 as (select *, row_number() over (order by score, {B.tie('id')}) <= least(count(*) over (), greatest(1, round_even(0.9::double * count(*) over (), 0))) as keep from q1), q as (select cluster, id, h, r from k0 where keep),
o as (select *, unnest(range(1, 7)) as n from q),
rg as (select id, n, substr(r, i::int, n::int) as g, count(*) as c from (select id, n, r, unnest(range(1, greatest(length(r) - n + 2, 1))) as i from o) group by all),
hg as (select id, n, substr(h, i::int, n::int) as g, count(*) as c from (select id, n, h, unnest(range(1, greatest(length(h) - n + 2, 1))) as i from o) group by all),
m as (select id, n, sum(least(rg.c, hg.c)) as k from rg join hg using (id, n, g) group by id, n),
s as (select o.cluster, o.n, sum(greatest(length(h) - n + 1, 0)) as hyp, sum(greatest(length(r) - n + 1, 0)) as ref, sum(coalesce(k, 0))::double as k from o left join m using (id, n) group by o.cluster, o.n),
cl as (select cluster, row_number() over (order by cluster) - 1 as place, count(*) over () as n from (select distinct cluster from q)),
dr as (select b.b, (('0x' || substr(sha256('20260906:' || b.b || ':' || c.place), 1, 16))::ubigint % c.n::ubigint)::bigint as place from cl c cross join (select unnest(range({REPLICATES})) as b) b),
wt as (select b, cluster, count(*) as w from dr join cl using (place) group by b, cluster),
t as (select b, s.n, sum(hyp * w) as hyp, sum(ref * w) as ref, sum(k * w) as k from s join wt using (cluster) group by b, s.n),
a as (select b, avg(k / hyp) filter (hyp > 0 and ref > 0) as p, avg(k / ref) filter (hyp > 0 and ref > 0) as r from t group by b),
f as (select coalesce(case when 4 * p + r > 0 then 500 * p * r / (4 * p + r) end, 0) as chrf from a)
select count(*) as replicates, round(quantile_cont(chrf, 0.025), 6) as low, round(quantile_cont(chrf, 0.5), 6) as middle, round(quantile_cont(chrf, 0.975), 6) as high from f"""
)
def retained_chrf_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrF of the 90 % of turns that are kept, each against the turn that follows, with a cluster interval (MET21, BST5)."""
    c = B.read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "text")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    pairs = c.join(n, ["conv_id", "turn"]).select(F.lit(1).alias("all"), F.col("conv_id").alias("cluster"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.length("text").alias("score"), F.col("text").alias("hypothesis"), "reference")
    kept = selection.keep_top(pairs, ["all"], "score", "id", 0.9).where("keep")
    counts = X.chrf_counts(kept, "reference", "hypothesis", spaces=False, lower=False).select("cluster", "chrf")
    per = resample.bootstrap_chrf(graph.checkpointed(counts, "chrf-counts"), REPLICATES)
    at = lambda q, name: F.round(F.percentile("chrf", F.lit(q)), 6).alias(name)
    return per.agg(F.count(F.lit(1)).alias("replicates"), at(0.025, "low"), at(0.5, "middle"), at(0.975, "high"))
