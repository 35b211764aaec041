"""Registered queries of the risk operators and their SQL oracles.

Every query runs over its whole tables; fractions are rounded to nine digits so
that two engines' sums can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.functions import hashing, labels, numbers, signal
from hedgerow.functions import text as X
from hedgerow.operators import cohorts, contracts, decide, features, graph, heads, metrics, resample, selection, sensitivity, splits

from . import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r9(c: str | Column) -> Column:
    """Nine digits as the SQL engine rounds, in doubles; Spark's own round goes by the shortest decimal, which differs next to half a unit."""
    x = F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    return F.when(F.abs(x) < 1e299, F.round(x * 1e9) / 1e9).otherwise(x)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r9(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# ------------------------------------------------------------- selection, ranks

_TOP = """with {base}, r as (select *, row_number() over (partition by cond order by score, {tie}) as rk, count(*) over (partition by cond) as n from {t}),
k as (select *, rk <= least(n, greatest(1, round_even({c} * n::double, 0)::bigint)) as keep from r) """
_SELECTIVE = """select cond, count(*) as n, count(*) filter (keep) as k, coalesce(sum(y) filter (keep), 0)::bigint as e, count(*) filter (keep and y is null) as u,
round(count(*) filter (keep)::double / count(*), 9) as coverage, round(coalesce(sum(y) filter (keep), 0)::double / nullif(count(*) filter (keep and y is not null), 0), 9) as known_risk,
round(coalesce(sum(y) filter (keep), 0)::double / nullif(count(*) filter (keep), 0), 9) as risk_lower,
round((coalesce(sum(y) filter (keep), 0) + count(*) filter (keep and y is null))::double / nullif(count(*) filter (keep), 0), 9) as risk_upper,
round(coalesce(sum(y) filter (not keep), 0)::double / nullif(coalesce(sum(y), 0), 0), 9) as capture from k group by cond"""


@query(_TOP.format(base=B.SQL["d"], t="d", tie=B.tie("id"), c=0.9) + _SELECTIVE.replace("cond,", "cond as lang,", 1).replace("round(count(*) filter (keep)::double / count(*), 9) as coverage, ", "").split("round(coalesce(sum(y) filter (keep), 0)::double / nullif(count(*) filter (keep and y is not null), 0), 9) as known_risk,")[0] + " round(coalesce(sum(y) filter (keep), 0)::double / nullif(count(*) filter (keep), 0), 9) as risk_lower, round((coalesce(sum(y) filter (keep), 0) + count(*) filter (keep and y is null))::double / nullif(count(*) filter (keep), 0), 9) as risk_upper from k group by cond")
def retained_bounds_top90_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = selection.keep_top(B.documents(spark, sf_dir), ["cond"], "score", "id", 0.9)
    return rounded(metrics.selective(kept, ["cond"])).select(F.col("cond").alias("lang"), "n", "k", "e", "u", "risk_lower", "risk_upper")


@query(_TOP.format(base=B.SQL["e"], t="e", tie=B.tie("id"), c=0.8) + _SELECTIVE)
def selective_bounds_top80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.selective(selection.keep_top(B.events(spark, sf_dir), ["cond"], "score", "id", 0.8), ["cond"]))


@query(f"with {B.SQL['o']}, k as (select *, coalesce(score < 150000, false) as keep from o) " + _SELECTIVE)
def selective_operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection by a fixed threshold instead of a share."""
    return rounded(metrics.selective(B.orders(spark, sf_dir).withColumn("keep", F.coalesce(F.col("score") < 150000, F.lit(False))), ["cond"]))


_SLICED = "s as (select *, 'ALL' as slice from {t} union all select *, cond as slice from {t} where cond is not null)"
_GRID = """with {base}, {sliced}, r as (select *, row_number() over w as rk, count(*) over (partition by slice) as n,
coalesce(sum(y) over (partition by slice order by score, {tie} rows unbounded preceding), 0) as e, sum((y is null)::int) over (partition by slice order by score, {tie} rows unbounded preceding) as u
from s window w as (partition by slice order by score, {tie})), c as (select unnest({cov}) as target)
select slice, target, n, rk as k, e::bigint as e, u::bigint as u, round(e::double / rk, 9) as risk_lower, round((e + u)::double / rk, 9) as risk_upper
from r join c on rk = least(n, greatest(1, round_even(target * n::double, 0)::bigint))"""


@query(_GRID.format(base=B.SQL["e"], sliced=_SLICED.format(t="e"), tie=B.tie("id"), cov="[0.8::double, 0.9::double, 0.95::double]"))
def retained_bounds_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.retained_grid(metrics.slices(B.events(spark, sf_dir), "cond"), ["slice"], [0.8, 0.9, 0.95]))


COVERAGES = [round(0.05 + 0.005 * i, 3) for i in range(191)]


@query(_GRID.format(base=B.SQL["d"], sliced=_SLICED.format(t="d"), tie=B.tie("id"), cov="list_transform(range(191), lambda i: round(0.05::double + 0.005::double * i, 3))"))
def risk_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.retained_grid(metrics.slices(B.documents(spark, sf_dir), "cond"), ["slice"], COVERAGES))


_AURC = """a as (select {by}, avg(y::double) over (partition by {by}, score) as p, row_number() over (partition by {by} order by score, id) as rk, score, id from {t} where y is not null),
b as (select {by}, sum(p) over (partition by {by} order by rk rows unbounded preceding) / rk as v from a)"""


@query(f"with {B.SQL['o']}, {_AURC.format(by='cond', t='o')} select cond, round(avg(v), 9) as aurc, count(*) as known from b group by cond")
def aurc_expected_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.aurc(B.orders(spark, sf_dir), ["cond"]))


@query(f"with {B.SQL['e']}, {_SLICED.format(t='e')}, {_AURC.format(by='slice', t='s')} select slice, round(avg(v), 9) as aurc, count(*) as known from b group by slice")
def aurc_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.aurc(metrics.slices(B.events(spark, sf_dir), "cond"), ["slice"]))


@query(f"with {B.SQL['e']}, r as (select cond, sum(y::double) over w / row_number() over w as v from e where y is not null window w as (partition by cond order by score, id rows unbounded preceding)) select cond, round(avg(v), 9) as aurc from r group by cond")
def aurc_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.aurc_row_order(B.events(spark, sf_dir), ["cond"], "y", "score", "id"))


@query(f"with {B.SQL['d']}, x as (select distinct cluster as left_out from d where y is not null), s as (select d.*, left_out from d join x on d.cluster <> left_out), {_AURC.format(by='left_out', t='s')} select left_out, round(avg(v), 9) as aurc from b group by left_out")
def aurc_leave_one_cluster_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.leave_one_out(B.documents(spark, sf_dir), "cluster"))


_BINS = """r as (select cond, y, p, row_number() over (partition by cond order by p, {tie}) as rk, count(*) over (partition by cond) as n from e where y is not null),
z as (select *, least({bins}, n) as b from r),
q as (select cond, y, p, case when rk <= (n % b) * (n // b + 1) then ceil(rk / (n // b + 1)) else n % b + ceil((rk - (n % b) * (n // b + 1)) / (n // b)) end::int as bin from z),
g as (select cond, bin, count(*) as n, avg(p) as mean_p, avg(y::double) as mean_y from q group by cond, bin)"""


@query(f"with {B.SQL['e']}, {_BINS.format(tie=B.tie('id'), bins=10)} select cond, bin, n, round(mean_p, 9) as mean_p, round(mean_y, 9) as mean_y from g")
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.reliability(B.events(spark, sf_dir), ["cond"], "y", "p", "id", 10))


@query(f"with {B.SQL['e']}, {_BINS.format(tie=B.tie('id'), bins=15)} select cond, round(sum(n * abs(mean_y - mean_p)) / sum(n), 9) as ece from g group by cond")
def ece_equal_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ece(B.events(spark, sf_dir), ["cond"], "y", "p", "id", 15))


@query(f"with {B.SQL['e']} select cond, round(avg((p - y) * (p - y)), 9) as brier from e group by cond")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.brier(B.events(spark, sf_dir), ["cond"]))


@query(f"with {B.SQL['e']}, r as (select cond, y, rank() over (partition by cond order by score) + (count(*) over (partition by cond, score) - 1) / 2.0::double as rk from e where y is not null) select cond, round((sum(rk) filter (y = 1) - (count(*) filter (y = 1)) * ((count(*) filter (y = 1)) + 1) / 2.0::double) / nullif((count(*) filter (y = 1))::double * (count(*) filter (y = 0)), 0), 9) as auroc from r group by cond")
def auroc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auroc(B.events(spark, sf_dir), ["cond"]))


@query(f"with {B.SQL['e']}, g as (select cond, score, count(*) as m, sum(y)::double as e from e where y is not null group by cond, score), w as (select cond, e, sum(e) over v / sum(m) over v as pr from g window v as (partition by cond order by score desc)) select cond, round(sum(e * pr) / nullif(sum(e), 0), 9) as average_precision from w group by cond")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(B.events(spark, sf_dir), ["cond"]))


@query(f"with {B.SQL['e']} select cond, round(quantile_cont(score::double, 0.9), 9) as threshold from e group by cond")
def quantile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.events(spark, sf_dir).groupBy("cond").agg(metrics.quantile_linear("score", 0.9).alias("threshold")))


@query(f"with {B.SQL['e']}, r as (select cond, score, row_number() over (partition by cond order by score) as rk, count(*) over (partition by cond) as n from e where score is not null) select cond, round(score, 9) as threshold from r where rk = ceil((n - 1) * 0.9::double) + 1")
def quantile_higher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.quantile_higher(B.events(spark, sf_dir), ["cond"], "score", 0.9))


@query(f"with {B.SQL['e']}, t as (select cond, quantile_cont(p::double, 0.9) as tau from e group by cond) select cond, round(coalesce(quantile_cont(p::double, 0.8) filter (p < tau), max(tau)), 9) as mark from e join t using (cond) group by cond")
def mark_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.events(spark, sf_dir)
    tau = e.groupBy("cond").agg(metrics.quantile_linear("p", 0.9).alias("tau"))
    return rounded(metrics.mark_threshold(e.join(F.broadcast(tau), "cond"), ["cond"], "p", "tau", 0.2))


@query(f"with {B.SQL['e']} select cond, round(avg((p >= 0.95)::int) filter (y = 0 and cluster % 2 = 0), 9) as over_abstention from e group by cond")
def over_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.over_abstention(B.events(spark, sf_dir), ["cond"], "y", "p", F.col("cluster") % 2 == 0, 0.95))


@query(f"with {B.SQL['e']}, r as (select cond, rank() over (partition by cond order by score) + (count(*) over (partition by cond, score) - 1) / 2.0::double as a, rank() over (partition by cond order by cluster) + (count(*) over (partition by cond, cluster) - 1) / 2.0::double as b from e where score is not null and cluster is not null) select cond, count(*) as n, round(corr(a, b), 9) as rho from r group by cond")
def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.spearman(B.events(spark, sf_dir), ["cond"], "score", "cluster"))


@query("select o_orderpriority, o_orderstatus, count(*) as n, round(avg(case o_orderstatus when 'F' then 1.0::double when 'O' then 0 end), 9) as error_rate, round(avg(o_totalprice), 6) as mean_value from orders group by grouping sets ((), (o_orderpriority), (o_orderstatus))")
def grouped_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.read(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0))
    d = metrics.diagnostics(o, ["o_orderpriority", "o_orderstatus"], "y", "o_totalprice")
    return d.select("o_orderpriority", "o_orderstatus", "n", r9("error_rate").alias("error_rate"), F.round("mean_value", 6).alias("mean_value"))


# --------------------------------------------------------- bounds, sensitivity


def _two_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = selection.keep_top(B.events(spark, sf_dir), ["cond"], "score", "id", 0.9).withColumnRenamed("keep", "keep_a")
    return selection.keep_top(a.withColumn("other", F.col("cluster") % 7), ["cond"], "other", "id", 0.8).withColumnRenamed("keep", "keep_b")


_TWO = f"""with {B.SQL['e']}, r as (select *, row_number() over (partition by cond order by score, {B.tie('id')}) as ra, row_number() over (partition by cond order by cluster % 7, {B.tie('id')}) as rb, count(*) over (partition by cond) as n from e),
k as (select *, ra <= round_even(0.9::double * n, 0) as keep_a, rb <= round_even(0.8::double * n, 0) as keep_b from r),
w as (select *, keep_a::int::double / sum(keep_a::int) over (partition by cond) - keep_b::int::double / sum(keep_b::int) over (partition by cond) as w from k)"""


@query(_TWO + " select cond, round(sum(case when y is null then least(w, 0) else w * y end), 9) as lower, round(sum(case when y is null then greatest(w, 0) else w * y end), 9) as upper from w group by cond")
def difference_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sensitivity.difference_bounds(_two_selections(spark, sf_dir), ["cond"]))


@query(
    _TWO
    + """, b as (select cond, sum(case when y is null then greatest(w, 0) else w * y end) as upper from w group by cond),
g as (select cond, greatest(w * (1 - 2 * y), 0) as gain, row_number() over (partition by cond order by greatest(w * (1 - 2 * y), 0) desc, id) as i from w where y is not null),
c as (select cond, i, upper, upper + sum(gain) over (partition by cond order by i rows unbounded preceding) as worst from g join b using (cond)),
f as (select cond, count(*) as known, case when max(upper) >= -1e-12 then 0 else min(i) filter (worst >= -1e-12) end as flips_to_erase from c group by cond)
select cond, known, flips_to_erase::bigint as flips_to_erase, coalesce(flips_to_erase - 1, known)::bigint as flips_tolerated from f"""
)
def label_flip_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.flip_budget(_two_selections(spark, sf_dir), ["cond"])


@query(f"with {B.SQL['e']} select cond, case when p >= 0.97 then 'abstain' when p >= 0.9 then 'mark_uncertain' else 'translate' end as action, count(*) as n from e group by all")
def actions_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.events(spark, sf_dir).select("cond", decide.action("p", 0.9, 0.97).alias("action")).groupBy("cond", "action").agg(F.count(F.lit(1)).alias("n"))


REPLICATES = 2000


def _methods(d: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct(F.lit("length").alias("method"), F.col("score").cast("double").alias("s")), F.struct(F.lit("id").alias("method"), (F.col("id") % 97).cast("double").alias("s")))).alias("x")
    return d.select("cluster", "y", "cond", both).select("cluster", "y", "cond", F.col("x.method").alias("method"), F.col("x.s").alias("score"))


_BOOT = f"""with {B.SQL['d']}, cl as (select cluster, row_number() over (order by cluster) - 1 as place, count(*) over () as n from (select distinct cluster from d)),
dr as (select b.b, (('0x' || substr(sha256('20260906:' || b.b || ':' || c.place), 1, 16))::ubigint % c.n::ubigint)::bigint as place from cl c cross join (select unnest(range({REPLICATES})) as b) b),
wt as (select b, cluster, count(*) as w from dr join cl using (place) group by b, cluster),
m as (select cluster, y, 'length' as method, score::double as score from d where y is not null union all select cluster, y, 'id', (id % 97)::double from d where y is not null),
g as (select b, method, score, sum(w)::bigint as m, sum(w * y)::double as e from m join wt using (cluster) group by b, method, score),
x as (select b, method, e / m as p, unnest(range(m)) as i, score from g),
v as (select b, method, sum(p) over (partition by b, method order by score, i rows unbounded preceding) / row_number() over (partition by b, method order by score, i) as v from x),
a as (select b, method, avg(v) as aurc from v group by b, method),
q as (select b, max(aurc) filter (method = 'length') - max(aurc) filter (method = 'id') as d from a group by b),
i as (select count(*) as replicates, avg(d) as mean_difference, quantile_cont(d, 0.025) as low, quantile_cont(d, 0.975) as high from q where d is not null)
select replicates, round(mean_difference, 9) as mean_difference, round(low, 9) as low, round(high, 9) as high, case when high < 0 then 'full_lower' when low > 0 then 'full_higher' else 'cannot_exclude' end as conclusion from i"""


@query(_BOOT)
def cluster_bootstrap_delta_aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.documents(spark, sf_dir)
    draws = resample.hash_draws(d.select("cluster").distinct(), REPLICATES)
    per = resample.bootstrap_aurc(_methods(d), draws)
    out = resample.paired_interval(per, "method", "length", "id")
    return rounded(out.withColumn("conclusion", sensitivity.interval_class(F.col("low"), F.col("high"))))


@query()
def cluster_bootstrap_numpy_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with draws of numpy's generator over the sorted clusters, 2,000 replicates."""
    d = B.documents(spark, sf_dir)
    clusters = [r[0] for r in d.select("cluster").distinct().orderBy("cluster").limit(resample.MAX_CLUSTERS + 1).collect()]
    per = resample.bootstrap_aurc(_methods(d), resample.numpy_draws(spark, clusters, 2000))
    return rounded(resample.paired_interval(per, "method", "length", "id"))


# ------------------------------------------------------------------- contracts


@query("with g as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by all) select sum(n)::bigint as rows, count(*) as keys, count(*) filter (n > 1) as repeated_keys, sum(n - 1)::bigint as extra_rows from g")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.duplicate_summary(B.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("with a as (select o_orderkey as id, any_value(o_orderstatus) as s, count(*) as n from orders group by 1), b as (select l_orderkey as id, min(l_linestatus) as s, count(*) as n from lineitem group by 1) select count(*) filter (b.id is null) as left_only, count(*) filter (a.id is null) as right_only, count(*) filter (a.n > 1) as left_repeated, count(*) filter (b.n > 1) as right_repeated, count(*) filter (a.id is not null and b.id is not null and a.s is distinct from b.s) as stale_s from a full join b on a.id = b.id")
def id_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    l = B.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.min("l_linestatus").over(_by("l_orderkey")).alias("s"))
    return contracts.id_contract(o, l, "id", [("s", "s")])


def _by(*c: str):
    from pyspark.sql import Window

    return Window.partitionBy(*c)


@query("select doc_id, lang, source from documents where doc_id not in (select doc_id from labels)")
def pending_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.pending(B.read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), B.read(spark, sf_dir, "labels"), "doc_id")


@query("select coalesce(b.c_custkey, a.c_custkey) as c_custkey, case when b.c_custkey is not null then b.c_acctbal else a.c_acctbal end as c_acctbal, case when b.c_custkey is not null then b.c_mktsegment else a.c_mktsegment end as c_mktsegment from (select * from customer where c_custkey % 5 <> 0) a full join (select c_custkey, -c_acctbal as c_acctbal, 'REPAIRED' as c_mktsegment from customer where c_custkey % 3 = 0) b using (c_custkey)")
def overlay_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", (-F.col("c_acctbal")).alias("c_acctbal"), F.lit("REPAIRED").alias("c_mktsegment"))
    return contracts.overlay(c.where("c_custkey % 5 <> 0"), new, "c_custkey")


@query("with m as (select doc_id, (doc_id % 4)::int as want from documents), p as (select doc_id, ((doc_id + (doc_id % 50 = 0)::int) % 4)::int as got, count(*) as m from documents where doc_id % 60 <> 7 group by all), b as (select m.doc_id as a, p.doc_id as b, want, got, m from m full join p using (doc_id)) select coalesce(got, want) as shard, count(*) filter (want = coalesce(got, want)) as expected, coalesce(sum(m), 0)::bigint as found, count(*) filter (want is null) as unknown, count(*) filter (m > 1) as repeated, count(*) filter (want <> got) as misplaced, count(*) filter (got is null) as missing from b group by 1")
def shard_merge_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with planted faults: some ids are missing, some in the next shard."""
    d = B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("_pos"))
    parts = d.where("id % 60 <> 7").select("id", ((F.col("id") + (F.col("id") % 50 == 0).cast("int")) % 4).alias("shard"))
    return contracts.shard_contract(d, parts, 4)


_SPLIT = "case when doc_id % 10 < 6 then 'train' when doc_id % 10 < 8 then 'cal' else 'test' end"


@query(f"with s as (select *, {_SPLIT} as split from documents), x as (select split, 'source' as field, source as value from s union all select split, 'text', text from s union all select split, 'doc_id', doc_id::varchar from s), g as (select field, value, min(split) as lo, max(split) as hi from x where value is not null group by all) select field, count(*) as values, count(*) filter (lo <> hi) as leaking from g group by field")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.read(spark, sf_dir, "documents").withColumn("split", B.split_of("doc_id"))
    return contracts.leakage(d, ["source", "text", "doc_id"])


@query(f"select {_SPLIT} as split, count(*) as n, count(distinct source) as distinct_source, count(distinct lang) as distinct_lang from documents group by 1")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_report(B.read(spark, sf_dir, "documents").withColumn("split", B.split_of("doc_id")), "split", ["source", "lang"])


@query(f"select {_SPLIT} as split, coalesce((1 - quality)::varchar, 'unresolved') as label, count(*) as n from documents left join labels using (doc_id) group by all")
def split_label_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.validation(B.documents(spark, sf_dir).withColumn("split", B.split_of("id")), "split", "y")


@query(f"with s as (select {_SPLIT} as split, case when doc_id % 10 < 6 then n_chars end as only_train, quality from documents left join labels using (doc_id)), g as (select split, count(only_train) as only_train, count(quality) as quality from s group by split), x as (select 'only_train' as feature, only_train as present from g union all select 'quality', quality from g) select feature, sum(present)::bigint as present, count(*) filter (present = 0) as empty_splits, count(*) filter (present = 0) = 0 as available from x group by feature")
def feature_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.documents(spark, sf_dir).select(B.split_of("id").alias("split"), F.when(F.col("id") % 10 < 6, F.col("score")).alias("only_train"), (1 - F.col("y")).alias("quality"))
    return cohorts.availability(d, "split", ["only_train", "quality"])


@query("with a as (select o_orderpriority as k, avg(o_totalprice) as v from orders group by 1), b as (select o_orderpriority as k, avg(case when o_orderkey % 2 = 0 then o_totalprice end) as v from orders where o_orderpriority <> '5-LOW' group by 1) select coalesce(a.k, b.k) as k, round(a.v, 6) as expected, round(b.v, 6) as actual from a full join b on a.k = b.k where a.k is null or b.k is null or not coalesce(abs(a.v - b.v) <= 1e-12, a.v is null and b.v is null)")
def metric_tolerance_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.read(spark, sf_dir, "orders")
    a = o.groupBy(F.col("o_orderpriority").alias("k")).agg(F.avg("o_totalprice").alias("v"))
    b = o.where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("k")).agg(F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).alias("v"))
    return contracts.tolerance(a, b, ["k"], "v").select("k", F.round("expected", 6).alias("expected"), F.round("actual", 6).alias("actual"))


# ------------------------------------------------------- samples, donors, graph


@query(f"select doc_id, lang from documents order by {B.tie('doc_id')}, doc_id limit 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hash_sample(B.read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100)


@query(f"select doc_id, source, depth from (select doc_id, source, row_number() over (partition by source order by {B.tie('doc_id')}, doc_id) as depth from documents) order by depth, {B.tie('source')}, source limit 150")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.round_robin_sample(B.read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 150)


@query(f"with a as (select doc_id, lang, source, (row_number() over (partition by lang, source order by {B.tie('doc_id')}, doc_id) > 10)::int as late from documents), b as (select *, row_number() over (partition by lang order by late, {B.tie('doc_id')}, doc_id) as place from a) select doc_id, lang, source, place from b where place <= 20")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_sample(B.read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id")


_DONOR = """with c as (select c_custkey as id, c_nationkey as sp, c_mktsegment as split from customer),
n as (select a.id, (('0x' || substr(sha256('20260906:' || a.id || ':donor'), 1, 16))::ubigint % count(*)::ubigint)::bigint as k from c a join c b on {on} group by a.id),
r as (select a.id, a.sp, a.split, b.id as donor_id, b.sp as donor_sp, row_number() over (partition by a.id order by b.id) - 1 as i from c a join c b on {on})
select r.id, r.donor_id, r.donor_sp, {more} from r join n on n.id = r.id and n.k = r.i"""


@query(_DONOR.format(on="a.split = b.split and a.sp <> b.sp", more="r.split"))
def donor_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("sp"), F.col("c_mktsegment").alias("split"))
    return splits.donors(c, "id", "sp", "split", position="id").where("donor_id is not null").select("id", "donor_id", F.col("donor_speaker").alias("donor_sp"), "split")


@query(_DONOR.format(on="a.sp <> b.sp", more="r.split <> (select split from c where c.id = r.donor_id) as crosses_split"))
def donor_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant without a split; whether the donor is of another split."""
    c = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("sp"), F.col("c_mktsegment").alias("split"))
    got = splits.donors(c, "id", "sp", None, position="id").where("donor_id is not null")
    return got.join(c.select(F.col("id").alias("donor_id"), F.col("split").alias("_s")), "donor_id").select("id", "donor_id", F.col("donor_speaker").alias("donor_sp"), (F.col("split") != F.col("_s")).alias("crosses_split"))


@query("with recursive e as (select doc_id as u, doc_id - n_chars % 11 as v from documents where n_chars % 3 = 0 and n_chars % 11 > 0), s as (select u, v from e union select v, u from e), r(node, root) as (select u, u from s union select s.v, r.root from r join s on s.u = r.node) select node, min(root) as root from r group by node")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = B.read(spark, sf_dir, "documents").where("n_chars % 3 = 0 and n_chars % 11 > 0").select(F.col("doc_id").alias("u"), (F.col("doc_id") - F.col("n_chars") % 11).alias("v"))
    return graph.components(edges, graph.checkpointed)


@query()
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to splits by the best of 20,000 seeded orders."""
    return splits.grouped_split(B.read(spark, sf_dir, "documents"), "source", ["lang"], {"train": 0.6, "cal": 0.2, "test": 0.2})


@query("with recursive g as (select source, count(*) as n, row_number() over (order by count(*) desc, source) as i from documents group by source), r(i, sums, source, fold) as (select 0::bigint, [0, 0, 0, 0, 0]::bigint[], null::varchar, -1 union all select g.i, list_transform(sums, lambda v, j: case when j = list_position(sums, list_min(sums)) then v + g.n else v end), g.source, (list_position(sums, list_min(sums)) - 1)::int from r join g on g.i = r.i + 1) select source, fold from r where i > 0")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.folds_by_size(B.read(spark, sf_dir, "documents"), "source", 5)


@query("with b as (select doc_id, text, case when quality is null then 'unlabelled' when lang <> 'en' then 'not_english' when regexp_matches(text, '[0-9][-/:][0-9]') then 'range' end as reason from documents left join labels using (doc_id)), k as (select *, row_number() over (partition by text order by doc_id) as i from b where reason is null), f as (select reason from b where reason is not null union all select case when i > 1 then 'duplicate' end from k) select coalesce(reason, 'kept') as reason, count(*) as n from f group by 1")
def exclusion_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.read(spark, sf_dir, "documents").join(B.read(spark, sf_dir, "labels"), "doc_id", "left")
    reasons = [("unlabelled", F.col("quality").isNull()), ("not_english", F.col("lang") != "en"), ("range", F.col("text").rlike("[0-9][-/:][0-9]"))]
    return cohorts.funnel_counts(cohorts.funnel(d, reasons, ["text"], [F.col("doc_id")]))


@query("select p_partkey::varchar || '::' || side || '::' || cond as row_id, side, cond as condition, p_partkey from part, (select unnest(['original', 'counterfactual']) as side), (select unnest(['clean', 'noise', 'mask']) as cond)")
def condition_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.expand(B.read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", ["original", "counterfactual"], ["clean", "noise", "mask"]).select("row_id", "side", "condition", "p_partkey")


# ------------------------------------------------------------------------ text


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's tokens (lower case, letters and digits only)."""
    t = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    return B.read(spark, sf_dir, "conversations").select("conv_id", "turn", X.units(t).alias("t"))


_TURNS = r"t0 as (select conv_id, turn, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') as s from conversations), t as (select conv_id, turn, (case when s = '' then [] when contains(s, ' ') then string_split(s, ' ') else string_split(s, '') end) as t from t0)"


@query()
def token_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of consecutive turns; the SQL engine's distance counts bytes, so a test compares with brute force."""
    t = _turns(spark, sf_dir)
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("y"))
    return t.join(n, ["conv_id", "turn"]).select("conv_id", F.col("turn").alias("turn_a"), X.token_distance("t", "y").alias("distance"), r9(X.normalized_distance("t", "y")).alias("normalized"))


@query()
def pairwise_mean_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of all pairs of turns of a conversation; compared with brute force like the above."""
    return rounded(X.pairwise_mean(_turns(spark, sf_dir), "conv_id", "t"))


@query(f"with {_TURNS}, p as (select a.conv_id, a.turn, list_distinct(a.t) as x, list_distinct(b.t) as y from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1), c as (select *, len(list_intersect(x, y))::double as i from p) select conv_id, turn, round(case when len(x) + len(y) = 0 then 1 else i / greatest(len(y), 1) end, 9) as precision, round(case when len(x) + len(y) = 0 then 1 else i / greatest(len(x), 1) end, 9) as recall from c")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("y"))
    c = t.join(n, ["conv_id", "turn"]).select("conv_id", "turn", X.coverage("t", "y").alias("c"))
    return c.select("conv_id", "turn", r9("c.precision").alias("precision"), r9("c.recall").alias("recall"))


def _chrf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against documents of the same number."""
    b = B.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("reference"))
    d = B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("hypothesis"))
    return d.join(b, "id")


_CHRF = r"""with q as (select doc_id as id, lang, trim(regexp_replace({low}(b.text), '\s+', '{sp}', 'g'), ' ') as r, trim(regexp_replace({low}(d.text), '\s+', '{sp}', 'g'), ' ') as h from documents d join benchmark b on doc_id = item_id),
o as (select *, unnest(range(1, 7)) as n from q),
rg as (select id, n, substr(r, i::int, n::int) as g, count(*) as c from (select id, n, r, unnest(range(1, greatest(length(r) - n + 2, 1))) as i from o) group by all),
hg as (select id, n, substr(h, i::int, n::int) as g, count(*) as c from (select id, n, h, unnest(range(1, greatest(length(h) - n + 2, 1))) as i from o) group by all),
m as (select id, n, sum(least(rg.c, hg.c)) as k from rg join hg using (id, n, g) group by id, n),
s as (select o.id, o.lang, o.n, greatest(length(h) - n + 1, 0) as hyp, greatest(length(r) - n + 1, 0) as ref, coalesce(k, 0)::double as k from o left join m using (id, n)) """


@query(_CHRF.format(low="lower", sp=" ") + ", f as (select id, k / greatest(hyp, 1) as p, k / greatest(ref, 1) as r from s) select id, round(100 * sum(case when 4 * p + r > 0 then 5 * p * r / (4 * p + r) else 0 end) / 6, 6) as chrf from f group by id")
def sentence_chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sentence_chrf(_chrf_pairs(spark, sf_dir), "reference", "hypothesis").select("id", F.round("chrf", 6).alias("chrf"))


@query(_CHRF.format(low="", sp="") + ", g as (select lang, n, sum(hyp) as hyp, sum(ref) as ref, sum(k) as k from s group by lang, n), a as (select lang, avg(k / hyp) filter (hyp > 0 and ref > 0) as p, avg(k / ref) filter (hyp > 0 and ref > 0) as r from g group by lang) select lang, round(coalesce(case when 4 * p + r > 0 then 500 * p * r / (4 * p + r) end, 0), 6) as chrf from a")
def corpus_chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.corpus_chrf(_chrf_pairs(spark, sf_dir), ["lang"], "reference", "hypothesis").select("lang", F.round("chrf", 6).alias("chrf"))


@query(r"with v as (select doc_id, unnest(regexp_extract_all(text, '\b([0-9]+(?:\.[0-9]+)?)\b', 1)) as x from documents), c as (select doc_id, case when contains(x, '.') then regexp_replace(x, '\.?0+$', '') else x end as x from v), z as (select distinct doc_id, coalesce(nullif(ltrim(split_part(x, '.', 1), '0'), ''), '0') || case when contains(x, '.') then '.' || split_part(x, '.', 2) else '' end as value from c) select doc_id, value from z")
def number_values_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "documents").select("doc_id", F.explode(numbers.digit_values("text")).alias("value"))


@query()
def number_mentions_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of the documents' texts, digits and words, one row each."""
    d = B.read(spark, sf_dir, "documents").select("doc_id", F.explode(numbers.number_mentions("text")).alias("m"))
    return d.select("doc_id", "m.value", "m.start", "m.end")


_DE = numbers._german_lexicon()
_DE_WORD = "|".join(sorted(_DE, key=len, reverse=True))
_DE_FORM = rf"^(?:(?:({_DE_WORD})?(hundert))?({_DE_WORD})?(tausend))?(?:({_DE_WORD})?(hundert))?({_DE_WORD})?$"
_DE_TABLE = ", ".join(f"('{w}', {n})" for w, n in _DE.items())


@query(
    rf"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[0-9]+|[a-zäöüß]+')) as w from documents), x as (select doc_id, w, count(*) as n from t where w <> 'ein' group by all),
lex(w, v) as (values {_DE_TABLE}),
m as (select w, regexp_extract(w, '{_DE_FORM}', ['h1', 's1', 'r1', 'k', 'h2', 's2', 'r2']) as g from (select distinct w from x) where regexp_matches(w, '{_DE_FORM}')),
v as (select m.w, g, a.v as h1, b.v as r1, c.v as h2, d.v as r2 from m left join lex a on a.w = g.h1 left join lex b on b.w = g.r1 left join lex c on c.w = g.h2 left join lex d on d.w = g.r2),
l as (select *, case when g.s1 <> '' then 100 * coalesce(h1, 1) else 0 end + coalesce(r1, 0) as hi, case when g.s2 <> '' then 100 * coalesce(h2, 1) else 0 end + coalesce(r2, 0) as lo from v where coalesce(h1, 1) <> 0 and coalesce(h2, 1) <> 0),
y as (select w, case when g.k = '' then lo when (case when g.s1 <> '' or r1 is not null then hi else 1 end) between 1 and 999 and lo < 1000 then 1000 * (case when g.s1 <> '' or r1 is not null then hi else 1 end) + lo end as value from l),
z as (select w, value::varchar as value from y where value is not null union all select distinct w, case when ltrim(w, '0') = '' then '0' else ltrim(w, '0') end from x where regexp_matches(w, '^[0-9]+$'))
select doc_id, value, sum(n)::bigint as n from x join z using (w) group by doc_id, value"""
)
def german_number_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of digits and German number words of every text, with how often each is there (NUM4)."""
    return B.read(spark, sf_dir, "documents").select("doc_id", F.explode(numbers.german_numbers("text")).alias("value")).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query()
def french_number_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French mentions of every text, one row each; a text with a malformed run has one row without a value (NUM5)."""
    d = B.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", numbers.french_numbers("text").alias("m"))
    found = F.coalesce("m", F.array(F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))))
    return d.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")


@query()
def label_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each turn as the output, with the next turn as its reference; the fact is the reference's first number, or a negation where it has none."""
    c = B.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    number = F.regexp_extract("reference", r"[0-9]+(?:\.[0-9]+)?", 0)
    pairs = c.join(n, ["conv_id", "turn"]).withColumn("kind", F.when(number != "", "number").otherwise("negation"))
    expected = F.concat(F.lit('"'), F.when(number != "", number).otherwise("no"), F.lit('"'))
    return pairs.select("conv_id", "turn", labels.label_fact("text", expected, F.lit(None).cast("string"), "kind", "reference").alias("l")).select("conv_id", "turn", "l.*")


# ----------------------------------------------------------------------- arrays


@query("with m as (select vec_id, list_transform(embedding, lambda v: v::double) as x from embeddings) select vec_id, round(20 * log10(greatest(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 1e-6)), 6) as rms_db, round(len(list_filter(x, lambda v: abs(v) < 1e-5))::double / len(x), 9) as zero_fraction, round(len(list_filter(x, lambda v: abs(v) >= 0.999))::double / len(x), 9) as clip_fraction, round(len(x) / 16000.0::double, 9) as duration, round(list_sum(list_transform(x, lambda v: abs(v * power(10, 6.0::double / 20)))), 6) as gained from m")
def signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = "embedding"
    gained = F.aggregate(signal.gain(x, 6.0), F.lit(0.0), lambda t, v: t + F.abs(v))
    return B.read(spark, sf_dir, "embeddings").select("vec_id", F.round(signal.rms_db(x), 6).alias("rms_db"), r9(signal.zero_fraction(x)).alias("zero_fraction"), r9(signal.clip_fraction(x)).alias("clip_fraction"), r9(signal.duration(x, 16000)).alias("duration"), F.round(gained, 6).alias("gained"))


@query("with m as (select vec_id, list_transform(embedding, lambda v: exp(v::double - list_max(embedding)::double)) as x from embeddings), p as (select vec_id, list_transform(x, lambda v: v / list_sum(x)) as p from m) select vec_id, round(-list_sum(list_transform(p, lambda v: v * ln(v))), 6) as entropy from p")
def softmax_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "embeddings").select("vec_id", F.round(signal.softmax_entropy("embedding"), 6).alias("entropy"))


@query("with x as (select vec_id, unnest(embedding)::double as v, unnest(range(len(embedding))) as j from embeddings), k as (select unnest(range(257)) as k), t as (select vec_id, k, sum(v * cos(2 * pi() * j * k / 512)) as re, sum(v * sin(2 * pi() * j * k / 512)) as im from x cross join k group by vec_id, k), p as (select vec_id, (re * re + im * im) / sum(re * re + im * im) over (partition by vec_id) as p from t) select vec_id, round(-sum(case when p > 0 then p * ln(p) else 0 end) / ln(257), 9) as entropy from p group by vec_id")
def spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "embeddings").select("vec_id", r9(signal.spectral_entropy("embedding")).alias("entropy"))


# ------------------------------------------------------------------------ heads


def _numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.read(spark, sf_dir, "documents").join(B.read(spark, sf_dir, "labels"), "doc_id", "left")
    upper = F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(F.length("text"), F.lit(1))
    symbols = F.length(F.regexp_replace("text", "[^|#!$%&]", "")) / F.greatest(F.length("text"), F.lit(1))
    return d.select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("y"), B.split_of("doc_id").alias("split"), F.log1p("n_chars").alias("length"), upper.alias("upper"), F.when(F.col("doc_id") % 9 > 0, symbols).alias("symbols"))


@query()
def logistic_platt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic head fitted on train, calibrated on cal, applied to all rows."""
    d = _numeric(spark, sf_dir)
    ready = heads.prepare(d.where("split = 'train' and y is not null"), ["length", "upper", "symbols"]).apply(d)
    model = heads.fit_logistic(ready.where("split = 'train'"))
    raw = ready.select("id", "split", "y", F.lit("logistic").alias("method"), model.score(ready).alias("raw"))
    platt = heads.fit_platt(raw.where("split = 'cal'"), ["method"])
    return heads.apply_platt(raw, platt, ["method"]).select("id", "split", r9("raw").alias("raw"), r9("calibrated").alias("calibrated"))


@query()
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremely randomised trees on the same features."""
    d = _numeric(spark, sf_dir)
    ready = heads.prepare(d.where("split = 'train' and y is not null"), ["length", "upper", "symbols"]).apply(d)
    model = heads.fit_forest(ready.where("split = 'train'"))
    return ready.select("id", "split", r9(model.score(ready)).alias("raw"))


@query(f"with {B.SQL['e']} select cond, count(*) as n, round(sum(1 / (1 + exp(-(0.7 * ln(least(greatest(p, 1e-6), 1 - 1e-6) / least(greatest(1 - p, 1e-6), 1)) - 0.2)))), 6) as total from e group by cond")
def platt_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.events(spark, sf_dir).select("cond", heads.sigmoid(F.lit(0.7) * heads.logit("p") - 0.2).alias("c")).groupBy("cond").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c"), 6).alias("total"))


@query("select doc_id, substr(sha256('20260906:' || doc_id), 1, 16) as tie, ('0x' || substr(sha256('7:' || doc_id), 1, 16))::ubigint::varchar as stable from documents")
def stable_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "documents").select("doc_id", hashing.stable_hex("doc_id").alias("tie"), hashing.stable_u64("doc_id", 7).cast("string").alias("stable"))
