"""More registered queries: summaries over seeds, folds and clusters, contracts, shards, maps and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.functions import hashing, signal
from hedgerow.functions import text as X
from hedgerow.operators import cohorts, contracts, decide, heads, metrics, resample, selection, sensitivity, summaries
from hedgerow.streaming import incremental

from . import bindings as B
from .catalogue import _AURC, _BOOT, REPLICATES, _SPLIT, _TURNS, _TWO, _turns, _two_selections, query, r9, rounded

# --------------------------------------------------- seeds, folds, comparisons


@query(f"with {B.SQL['e']}, s as (select cond, cluster % 5 as seed, avg(score) as v from e group by all) select cond, count(*) as seeds, round(avg(v), 9) as mean, round(stddev_samp(v), 9) as sd, round(min(v), 9) as low, round(max(v), 9) as high, count(*) = 5 as complete from s group by cond")
def seed_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.events(spark, sf_dir).groupBy("cond", (F.col("cluster") % 5).alias("seed")).agg(F.avg("score").alias("v"))
    return rounded(summaries.seed_distribution(e, ["cond"], "seed", "v"))


@query("with s as (select user_id % 5 as seed, event_type, avg(value) as v from events group by all) select a.seed, round(a.v, 9) as first, round(b.v, 9) as second, round(a.v - b.v, 9) as difference from s a join s b using (seed) where a.event_type = 'click' and b.event_type = 'view'")
def matched_seed_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.read(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("seed"), "event_type").agg(F.avg("value").alias("v"))
    return rounded(summaries.matched(s, ["seed"], "event_type", "click", "view", "v"))


@query("with s as (select o_orderpriority, o_orderstatus, avg(o_totalprice) as v from orders group by all) select o_orderpriority, o_orderstatus as method, round(v, 6) as value from s qualify row_number() over (partition by o_orderpriority order by v, o_orderstatus) = 1")
def best_per_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.read(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    return heads.preselect(s, ["o_orderpriority"], "o_orderstatus", "v", []).select("o_orderpriority", F.col("o_orderstatus").alias("method"), F.round("v", 6).alias("value"))


@query(f"with {B.SQL['o']}, s as (select *, (cluster % 5)::varchar as slice from o union all select *, 'ALL' from o), {_AURC.format(by='slice', t='s')}, f as (select slice, avg(v) as aurc from b group by slice) select round(max(aurc) filter (slice = 'ALL'), 9) as pooled, count(*) filter (slice <> 'ALL') as folds, round(avg(aurc) filter (slice <> 'ALL'), 9) as mean, round(stddev_pop(aurc) filter (slice <> 'ALL'), 9) as sd from f")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = metrics.aurc(metrics.slices(B.orders(spark, sf_dir).withColumn("fold", F.col("cluster") % 5), "fold"), ["slice"])
    return rounded(summaries.fold_summary(f.where("slice <> 'ALL'"), f.where("slice = 'ALL'"), "aurc"))


@query(_TWO + " select cond, count(*) filter (keep_a and keep_b) as both, count(*) filter (keep_a and not keep_b) as only_a, count(*) filter (not keep_a and keep_b) as only_b, count(*) filter (keep_a <> keep_b) as differing from k group by cond")
def retained_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.retained_difference(_two_selections(spark, sf_dir), ["cond"])


@query(f"with {B.SQL['o']}, c as (select cond, count(*) as n, count(*) filter (score < 150000) as k, coalesce(sum(y) filter (score < 150000), 0)::bigint as e, count(*) filter (score < 150000 and y is null) as u from o group by cond) select *, round(100.0::double * e / k, 9) as lower_percent, round(100.0::double * (e + u) / k, 9) as upper_percent, round(100.0::double * (e + u) / k - 100.0::double * e / k, 9) as width from c")
def count_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = B.orders(spark, sf_dir).withColumn("keep", F.coalesce(F.col("score") < 150000, F.lit(False)))
    return rounded(summaries.percentages(metrics.selective(kept, ["cond"]).select("cond", "n", "k", "e", "u")))


@query("select lang, count(quality) as filled_first, count(toxic) as filled_second, round(avg((quality = (n_chars > 500)::int)::int), 9) as first_automatic, round(avg((1 - toxic = (n_chars > 500)::int)::int), 9) as second_automatic, round(avg((quality = 1 - toxic)::int), 9) as first_second from documents left join labels using (doc_id) group by lang")
def annotation_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.read(spark, sf_dir, "documents").join(B.read(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.select("lang", F.col("quality").alias("first"), (1 - F.col("toxic")).alias("second"), (F.col("n_chars") > 500).cast("int").alias("automatic"))
    return rounded(summaries.agreement(rows, ["lang"], "automatic", "first", "second"))


@query(f"with {B.SQL['d']}, p as (select a.y as y1, b.y as y2, a.score as s1, b.score as s2 from d a join d b on a.id // 2 = b.id // 2 where a.id % 2 = 0 and b.id % 2 = 1) select count(*) as pairs, count(y1 - y2) as decidable, round(avg(y1 - y2), 9) as label_difference, round(avg(s1 - s2), 9) as score_difference from p")
def mask_pair_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.documents(spark, sf_dir).select("y", "score", F.floor(F.col("id") / 2).alias("item"), F.when(F.col("id") % 2 == 0, "local").otherwise("irrelevant").alias("mask"))
    return rounded(sensitivity.mask_pairs(d, ["item"], "mask", "local", "irrelevant", "y", "score"))


@query(f"with {B.SQL['d']} select cond, cluster, count(*) as n, round(avg(y), 9) as error_rate, round(avg(score) filter (y = 1), 6) as mean_score_of_errors from d group by grouping sets ((), (cond), (cluster))")
def base_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall, by condition and by cluster; a mean over no rows is NULL (AGG1, AGG4)."""
    d = B.documents(spark, sf_dir).groupingSets([[], [F.col("cond")], [F.col("cluster")]], "cond", "cluster")
    return d.agg(F.count(F.lit(1)).alias("n"), r9(F.avg("y")).alias("error_rate"), F.round(F.avg(F.when(F.col("y") == 1, F.col("score"))), 6).alias("mean_score_of_errors"))


@query("select event_type, count(*) as n, round(avg(value), 6) as bare, round(avg(value * 2 + user_id), 6) as probes, round(avg(user_id * 1.0::double), 6) as evidence, round(avg(value) + avg(value * 2 + user_id) + avg(user_id * 1.0::double), 6) as serial, round((avg(value) + avg(value * 2 + user_id) + avg(user_id * 1.0::double)) / avg(value), 6) as ratio from events group by event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.read(spark, sf_dir, "events").select("event_type", F.col("value").alias("bare"), (F.col("value") * 2 + F.col("user_id")).alias("probes"), F.col("user_id").cast("double").alias("evidence"))
    out = summaries.latencies(e, ["event_type"], "bare", ["probes", "evidence"])
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("bare", "probes", "evidence", "serial", "ratio")])


@query(f"with {B.SQL['e']}, c as (select id, cluster, score, round(score * 100)::bigint as cents from e) select id, (sum(cents) over w)::double / row_number() over w as running_mean from c window w as (partition by cluster order by score, id rows unbounded preceding)")
def running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over whole cents, so that two engines' sums are the same numbers."""
    cents = B.events(spark, sf_dir).withColumn("cents", F.round(F.col("score") * 100).cast("long"))
    return summaries.running_mean(cents, ["cluster"], ["score", "id"], "cents").select("id", "running_mean")


# ------------------------------------------------------------------- resampling

_DRAWS = _BOOT[: _BOOT.index("m as (select")].rstrip().rstrip(",")


def _draws(d: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    return resample.hash_draws(d.select("cluster").distinct(), replicates)


@query(
    _DRAWS
    + """, k as (select cluster, y, score < 2000 as ka, score < 800 as kb from d), s as (select cluster, count(*) as n, count(*) filter (ka) as ka, count(*) filter (kb) as kb, count(y) filter (ka) as na, count(y) filter (kb) as nb, coalesce(sum(y) filter (ka), 0) as ea, coalesce(sum(y) filter (kb), 0) as eb from k group by cluster),
r as (select b, sum(ea * w)::double / nullif(sum(na * w), 0) - sum(eb * w)::double / nullif(sum(nb * w), 0) as rd, (sum(ka * w) - sum(kb * w))::double / sum(n * w) as cd from s join wt using (cluster) group by b),
q as (select quantile_cont(rd, 0.025) as risk_low, quantile_cont(rd, 0.975) as risk_high, quantile_cont(cd, 0.025) as coverage_low, quantile_cont(cd, 0.975) as coverage_high from r)
select round(risk_low, 9) as risk_low, round(risk_high, 9) as risk_high, round(coverage_low, 9) as coverage_low, round(coverage_high, 9) as coverage_high, case when risk_low is null then 'not_computed' when risk_high < 0 then 'full_lower' when risk_low > 0 then 'full_higher' else 'cannot_exclude' end as conclusion from q"""
)
def operating_point_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.documents(spark, sf_dir)
    per = resample.bootstrap_operating_point(d.withColumn("keep_a", F.col("score") < 2000).withColumn("keep_b", F.col("score") < 800), _draws(d))
    at = lambda c, q, n: F.percentile(c, F.lit(q)).alias(n)
    out = per.agg(at("risk_difference", 0.025, "risk_low"), at("risk_difference", 0.975, "risk_high"), at("coverage_difference", 0.025, "coverage_low"), at("coverage_difference", 0.975, "coverage_high"))
    return rounded(out.withColumn("conclusion", sensitivity.interval_class(F.col("risk_low"), F.col("risk_high"))))


@query(_DRAWS + ", s as (select cluster, sum(score) as chars, count(*) as rows from d group by cluster), r as (select sum(chars * w)::double / sum(rows * w) as m from s join wt using (cluster) group by b) select round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.5), 6) as middle, round(quantile_cont(m, 0.975), 6) as high from r")
def weighted_sum_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates from additive statistics of clusters alone: rows are never sorted again."""
    d = B.documents(spark, sf_dir)
    per = resample.bootstrap_sums(d.select("cluster", F.col("score").alias("chars"), F.lit(1).alias("rows")), _draws(d), ["chars", "rows"])
    m = F.col("chars") / F.col("rows")
    return per.agg(*[F.round(F.percentile(m, F.lit(q)), 6).alias(n) for q, n in ((0.025, "low"), (0.5, "middle"), (0.975, "high"))])


# ---------------------------------------------------------- contracts, cohorts


@query("select doc_id, 'changed' as problem from documents where doc_id % 13 = 0 and doc_id % 3 <> 0")
def stale_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done rows whose input has changed since; every thirteenth has, and a third is not done."""
    d = B.read(spark, sf_dir, "documents").select("doc_id", hashing.fingerprint("text", "lang").alias("fp"))
    done = d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 13 == 0, hashing.fingerprint("fp")).otherwise(F.col("fp")).alias("fp"))
    return contracts.stale(d, done, "doc_id", "fp").select("doc_id", F.lit("changed").alias("problem"))


@query("with a as (select c_custkey, c_mktsegment, c_nationkey from customer), b as (select c_custkey + (c_custkey % 50 = 0)::int * 1000000 as c_custkey, c_mktsegment, c_nationkey + (c_custkey % 70 = 0)::int as c_nationkey from customer), x as (select * from a except all select * from b), y as (select * from b except all select * from a) select 'lost' as side, count(*) as n from x union all select 'new', count(*) from y")
def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    key = F.col("c_custkey")
    b = a.select((key + (key % 50 == 0).cast("int") * 1000000).alias("c_custkey"), "c_mktsegment", (F.col("c_nationkey") + (key % 70 == 0).cast("int")).alias("c_nationkey"))
    return decide.pinned(a, b).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("with f as (select distinct o_orderpriority as p, o_orderstatus as s from orders where o_orderpriority <> '5-LOW' or o_orderstatus = 'F'), g as (select p, s from (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW']) as p) cross join (select unnest(['F', 'O', 'X']) as s)) select p, s, 'missing' as problem from (select * from g except select * from f) union all select p, s, 'unexpected' from (select * from f except select * from g)")
def design_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.read(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW' or o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    return contracts.design_contract(found, {"p": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], "s": ["F", "O", "X"]})


@query("with c as (select o_orderkey, case when o_custkey in (select c_custkey from customer where c_acctbal < 0) then 'speaker' when o_totalprice in (select o_totalprice from orders where o_orderkey % 11 = 0) then 'reference' end as reason from orders) select coalesce(reason, 'kept') as reason, count(*) as n from c group by 1")
def historical_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = B.read(spark, sf_dir, "orders"), B.read(spark, sf_dir, "customer")
    out = summaries.historical(o.select("o_orderkey", "o_custkey", "o_totalprice"), [("speaker", "o_custkey", c.where("c_acctbal < 0").select("c_custkey")), ("reference", "o_totalprice", o.where("o_orderkey % 11 = 0").select("o_totalprice"))])
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, event_type, arg_max(value, event_id) as value, max(event_id) as event_id, min(event_id) as first_position from events group by all")
def last_row_first_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.last_per_key(B.read(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


@query("with a as (select doc_id, lang, 2 as file from documents where doc_id % 4 = 1), b as (select doc_id, lang, 1 as file from documents where doc_id % 2 = 1), c as (select doc_id, lang, 0 as file from documents where doc_id % 6 = 1), u as (select * from a union all select * from b union all select * from c) select doc_id, lang, min(file) as file from u where doc_id % 5 <> 0 group by all")
def first_file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.read(spark, sf_dir, "documents").select("doc_id", "lang")
    part = lambda m, file: d.where(f"doc_id % {m} = 1").withColumn("file", F.lit(file))
    return cohorts.first_match([part(6, 0), part(2, 1), part(4, 2)], d.where("doc_id % 5 <> 0"), "doc_id")


@query("select (doc_id % 3)::bigint as parent, (doc_id % 12)::bigint as child, count(*) as n from documents group by all")
def resharded_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lanes, each dealt to four children by stride."""
    d = B.read(spark, sf_dir, "documents").select(contracts.shard_of(F.col("doc_id"), 3).alias("parent"), summaries.resharded("doc_id", 3, 4).alias("child"))
    return d.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("n"))


@query(r"with a as (select distinct lower(trim(regexp_replace(role, '\s+', ' ', 'g') || ' ' || (turn % 3)::varchar)) as t from conversations), b as (select distinct lower(trim(regexp_replace(role, '\s+', ' ', 'g') || ' ' || (turn % 2)::varchar)) as t from conversations where turn < 2) select count(*) as texts, count(b.t) as external from a left join b using (t)")
def external_text_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.read(spark, sf_dir, "conversations")
    key = lambda m: F.concat("role", F.lit(" "), (F.col("turn") % m).cast("string")).alias("key")
    return summaries.external_overlap(c.select(key(3)), c.where("turn < 2").select(key(2)), "key", "key", lambda t: F.lower(F.trim(F.regexp_replace(t, r"\s+", " "))))


@query(f"select {_SPLIT} as split, count(*) as n from documents left join labels using (doc_id) where {_SPLIT} = 'test' or quality is not null group by 1")
def split_rows_for_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and calibration keep rows with labels, the test split keeps all (FLT5)."""
    d = B.documents(spark, sf_dir).withColumn("split", B.split_of("id"))
    return d.where("split = 'test' or y is not null").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------- texts, arrays, maps, JSON


@query(f"with {_TURNS}, p as (select a.conv_id, a.turn, list_distinct(a.t) as x, list_distinct(b.t) as y from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1), c as (select *, len(list_intersect(x, y))::double as i from p) select conv_id, turn, round(1 - case when len(x) + len(y) = 0 then 1 else least(i / greatest(len(y), 1), i / greatest(len(x), 1)) end, 9) as gap from c")
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("y"))
    return t.join(n, ["conv_id", "turn"]).select("conv_id", "turn", r9(X.coverage_gap("t", "y")).alias("gap"))


@query(r"select doc_id, len(list_filter(string_split_regex(text, '[\s\x0B\x{85}\p{Z}]+'), lambda x: x <> ''))::int as words from documents")
def output_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "documents").select("doc_id", X.word_total("text").alias("words"))


@query(r"select page_id, regexp_replace(url, '[^\p{L}\p{N}._\-]', '_', 'g') as safe from pages")
def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "pages").select("page_id", hashing.safe_id("url").alias("safe"))


@query("with m as (select vec_id, list_transform(embedding[1:least(len(embedding), greatest(1, round_even((0.001::double + 0.003::double * 0.5) * 16000, 0)::int))], lambda v: v::double) as x from embeddings) select vec_id, len(x)::int as samples, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 6) as rms from m")
def truncated_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = signal.truncate_at("embedding", 16000, F.lit(0.001), F.lit(0.004), 0.5)
    x = B.read(spark, sf_dir, "embeddings").select("vec_id", F.transform(cut, lambda v: v.cast("double")).alias("x"))
    return x.select("vec_id", F.size("x").alias("samples"), F.round(signal.rms("x"), 6).alias("rms"))


@query("with m as (select l_returnflag, 'price' as method, l_extendedprice as risk from lineitem union all select l_returnflag, 'discount', l_discount from lineitem union all select l_returnflag, 'tax', l_tax from lineitem) select l_returnflag, method, count(*) as n, round(avg(risk), 6) as mean from m group by all")
def risks_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of risks per row, one of them dropped and another renamed, to rows per method (MAP1, MAP2)."""
    risks = F.create_map(F.lit("price"), F.col("l_extendedprice"), F.lit("discount"), F.col("l_discount"), F.lit("quantity"), F.col("l_quantity"))
    edited = F.map_concat(F.map_filter(risks, lambda k, _: k != "quantity"), F.create_map(F.lit("tax"), F.col("l_tax")))
    long = B.read(spark, sf_dir, "lineitem").select("l_returnflag", F.explode(edited).alias("method", "risk"))
    return long.groupBy("l_returnflag", "method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("risk"), 6).alias("mean"))


@query("select event_type, count(*) as n, sum((props::json->>'k')::bigint)::bigint as total, count(*) filter (props::json->>'missing' is not null) as others from events group by event_type")
def props_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a JSON column; an absent key is NULL (JSN1, JSN2)."""
    p = F.from_json("props", "k bigint, missing string")
    return B.read(spark, sf_dir, "events").select("event_type", p.alias("p")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total"), F.count("p.missing").alias("others"))


_MARKERS = "|".join(sorted(X.NEGATIVE, key=len, reverse=True)).replace("'", "''")


@query(rf"with m as (select conv_id, turn, lower(text) as t from conversations union all select item_id, -1, lower(text) || ' and NOBODY came, I won''t.' from benchmark) select conv_id, turn, regexp_matches(lower(coalesce(t, '')), '(^|[^\p{{L}}\p{{N}}_])({_MARKERS})($|[^\p{{L}}\p{{N}}_])') as negative from m")
def negation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative markers of turns, and of benchmark texts with a negative sentence added."""
    c = B.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    b = B.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.concat("text", F.lit(" and NOBODY came, I won't.")).alias("text"))
    return c.union(b).select("conv_id", "turn", X.is_negative(X.normalize("text", punctuation=True, form=False)).alias("negative"))


@query("with m as (select vec_id, list_transform(embedding, lambda v: v::double) as x from embeddings), p as (select a.vec_id, a.x as x, b.x as y, list_avg(a.x) as mx, list_avg(b.x) as my from m a join m b on b.vec_id = a.vec_id + 1), c as (select vec_id, list_transform(x, lambda v: v - mx) as x, list_transform(y, lambda v: v - my) as y from p) select vec_id, round(list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)), 6) as r from c")
def consecutive_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id").select("vec_id", F.round(signal.pearson("x", "y"), 6).alias("r"))


@query(f"with {B.SQL['e']}, r as (select *, row_number() over (partition by cond order by score, id) <= least(count(*) over (partition by cond), greatest(1, round_even(0.9::double * count(*) over (partition by cond), 0))) as keep from e) select cond, count(*) as n, count(*) filter (keep) as k, coalesce(sum(y) filter (keep), 0)::bigint as e, count(*) filter (keep and y is null) as u from r group by cond")
def legacy_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older selection, ties by row position (TOP2)."""
    return metrics.selective(selection.keep_first(B.events(spark, sf_dir), ["cond"], "score", "id", 0.9), ["cond"]).select("cond", "n", "k", "e", "u")


@query("with s as (select doc_id, (doc_id % 6)::int as shard, doc_id % 6 = 0 or (doc_id % 6 < 4 and doc_id % 7 <> 0) as done from documents), g as (select shard, count(*) as expected, count(*) filter (done) as completed from s group by shard) select *, case when completed = 0 then 'waiting' when completed < expected then 'running' else 'complete' end as status from g")
def shard_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("_pos"))
    return incremental.status(d, d.where("id % 6 = 0 or (id % 6 < 4 and id % 7 <> 0)"), 6)
