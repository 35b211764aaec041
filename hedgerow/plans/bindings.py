"""Roles of the test tables: items with a three-valued label, scores, conditions and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y (1 - quality, NULL without a label), score (length), cond (language), cluster (source)."""
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.select("doc_id", "n_chars", "lang", "source").join(l, "doc_id", "left").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("y"), F.col("n_chars").alias("score"), F.col("lang").alias("cond"), F.col("source").alias("cluster"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y (error 1, signup NULL, else 0), score (with ties), p, cond (4 groups of users), cluster (user)."""
    e = read(spark, sf_dir, "events")
    y = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", F.lit(None)).otherwise(0)
    return e.select(F.col("event_id").alias("id"), y.cast("int").alias("y"), F.col("value").alias("score"), (F.col("value") / (1 + F.col("value"))).alias("p"), F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("cond"), F.col("user_id").alias("cluster"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y (F 1, O 0, P NULL), score (price), cond (priority), cluster (customer)."""
    o = read(spark, sf_dir, "orders")
    y = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return o.select(F.col("o_orderkey").alias("id"), y.cast("int").alias("y"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("cond"), F.col("o_custkey").alias("cluster"))


def split_of(id_: str) -> Column:
    """train, cal or test by the id."""
    return F.when(F.col(id_) % 10 < 6, "train").when(F.col(id_) % 10 < 8, "cal").otherwise("test")


#: The same roles in SQL.
SQL = {
    "d": "d as (select doc_id as id, 1 - quality as y, n_chars as score, lang as cond, source as cluster from documents left join labels using (doc_id))",
    "e": "e as (select event_id as id, case when event_type = 'error' then 1 when event_type = 'signup' then null else 0 end as y, value as score, value / (1 + value) as p, 'c' || (user_id % 4)::varchar as cond, user_id as cluster from events)",
    "o": "o as (select o_orderkey as id, case o_orderstatus when 'F' then 1 when 'O' then 0 end as y, o_totalprice as score, o_orderpriority as cond, o_custkey as cluster from orders)",
}


def tie(id_: str, seed: int = 20260906) -> str:
    return f"substr(sha256('{seed}:' || ({id_})::varchar), 1, 16)"
