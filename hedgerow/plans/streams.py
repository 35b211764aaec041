"""Registered queries over streams with keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.operators import graph, reporting
from hedgerow.streaming import stateful

from . import bindings as B
from .catalogue import query

_LATER = "2024-01-12"


@query(f"select event_id as id, round(value / (1 + value), 9) as score, event_type as kind from events where event_id is not null and (ts < '{_LATER}' or ts >= '2024-01-08')")
def incremental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in two lots that overlap by some days; two runs on one checkpoint score each event once (STR1-STR3, INF5)."""
    folder = f"{graph.shared_root(spark)}/stream-{reporting.fresh_id()}"
    e = B.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.sha2(F.concat_ws(":", "event_type", "value"), 256).alias("fingerprint"), "event_type", "value", "ts").where("id is not null")
    schema = e.drop("ts").schema
    for lot in (e.where(F.col("ts") < _LATER), e.where(F.col("ts") >= "2024-01-08")):
        lot.drop("ts").write.mode("append").parquet(f"{folder}/in")
        scorer = lambda rows: rows.select("id", F.round(F.col("value") / (1 + F.col("value")), 9).alias("score"), F.col("event_type").alias("kind"))
        stateful.follow(spark.readStream.schema(schema).parquet(f"{folder}/in"), scorer, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return stateful.results(spark, f"{folder}/out", "id long, score double, kind string")


@query("with j as (select client_id as job, count(distinct priority) as reported from sales where client_id is not null and priority between 1 and 5 group by 1) select job, case when reported = 5 then 'complete' else 'timed_out' end as status, case when reported = 5 then 5 else reported end::int as reported, 5 as shards from j")
def job_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients' sales as reports of five shards (their priorities): complete, or out of time at the end of the data (STR4)."""
    folder = f"{graph.shared_root(spark)}/stream-{reporting.fresh_id()}"
    s = B.read(spark, sf_dir, "sales").where("client_id is not null and priority between 1 and 5")
    rows = s.select(F.col("client_id").cast("string").alias("job"), (F.col("priority") - 1).alias("shard"), F.lit(5).alias("shards"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    rows.write.parquet(f"{folder}/in")
    # a report long after the others moves the watermark past every job's time
    for at in ("2030-01-01", "2031-01-01"):
        stateful.watch(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), "400 days", "1 day", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        spark.sql(f"select '-' as job, 0 as shard, 5 as shards, timestamp '{at}' as at").write.mode("append").parquet(f"{folder}/in")
    stateful.watch(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), "400 days", "1 day", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.schema("job string, status string, reported int, shards int").parquet(f"{folder}/out")
    return out.where("job <> '-'").select(F.col("job").cast("long").alias("job"), "status", "reported", "shards")
