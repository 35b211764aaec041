"""Incremental runs: resume by id, refuse stale state, drop repeats (STR1-STR3, INF5, INF6).

A scorer is any function from a batch of rows to a DataFrame; it runs once for
each new id. State is the sink itself, joined by id, so a restart needs nothing
but the folder and the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hedgerow.operators.contracts import ContractError, pending, stale
from hedgerow.operators.graph import checkpointed

Scorer = Callable[[DataFrame], DataFrame]


def _sink(spark: SparkSession, path: str, schema) -> DataFrame:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def run_pending(rows: DataFrame, scorer: Scorer, sink: str, schema, id_: str = "id", fingerprint: str = "fingerprint") -> int:
    """Score the rows that the sink doesn't hold and append them; rows done under another fingerprint are an error."""
    whole = _sink(rows.sparkSession, sink, schema)
    # of the sink only the batch's ids and their fingerprints are kept, read once
    done = checkpointed(whole.select(id_, fingerprint).join(rows.select(id_).distinct(), id_, "left_semi"), "done")
    if stale(rows, done, id_, fingerprint).limit(1).count():
        raise ContractError("rows in the sink were made from other inputs")
    todo = pending(rows, done, id_).dropDuplicates([id_])
    out = checkpointed(scorer(todo).select(*[f.name for f in whole.schema.fields]), "scored")
    out.write.mode("append").parquet(sink)
    return out.count()


def follow(source: DataFrame, scorer: Scorer, sink: str, checkpoint: str, schema, id_: str = "id", fingerprint: str = "fingerprint", once: bool = True) -> StreamingQuery:
    """The same over a stream of rows: each micro-batch is joined against the sink, so replays append nothing."""
    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            run_pending(df, scorer, sink, schema, id_, fingerprint)

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def distinct_events(stream: DataFrame, id_: str, time: str, delay: str) -> DataFrame:
    """A stream without repeats of an id inside the watermark (STR3)."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([id_])


def status(expected: DataFrame, done: DataFrame, shards: int, id_: str = "id", position: str = "_pos") -> DataFrame:
    """One row per shard: expected and completed rows, and its state (E10)."""
    marked = expected.select(id_, F.pmod(position, F.lit(shards)).cast("int").alias("shard")).join(done.select(id_, F.lit(True).alias("_done")).distinct(), id_, "left")
    out = marked.groupBy("shard").agg(F.count(F.lit(1)).alias("expected"), F.count("_done").alias("completed"))
    return out.withColumn("status", F.when(F.col("completed") == 0, "waiting").when(F.col("completed") < F.col("expected"), "running").otherwise("complete"))
