"""Incremental runs with keyed state (STR1-STR4, INF5): what was done is in a state store, not in the sink.

``follow`` keeps the fingerprint of every id, and its row, in the state of a streaming aggregate.
A micro-batch looks up its own ids and nothing else, however much was done before: an
id seen for the first time is passed on, the same id with the same fingerprint is dropped,
with another fingerprint the query fails before anything of the batch is written. Results
of a batch go to a folder of its own number, which a batch that runs again overwrites,
so a restart from the checkpoint writes each row once.

``watch`` follows reports of shards and says when a job has all of them, or that its
time is up: an event-time timer of the job's key, which fires when the watermark passes.

Defined cases: rows with a null id are refused like stale ones, as nothing tells them
apart; of rows with one new id in a batch the first by fingerprint counts, and another
fingerprint among them is stale; a null fingerprint is a value like others; an empty
source writes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hedgerow.operators.contracts import ContractError

#: transformWithState needs a store of this kind.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Shards(StatefulProcessor):
    """Whether the shards of a job were all reported within a time of its first report."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "shards int, closed boolean, done string")

    def _row(self, key, status: str, found: int, shards: int) -> pd.DataFrame:
        return pd.DataFrame({"job": [key[0]], "status": [status], "reported": [found], "shards": [shards]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # a state is one call away: it is asked once and written once, whatever the number of reports
        reports = pd.concat(list(rows))
        state = self.job.get()
        if state is None:
            state = (int(reports["shards"].max()), False, "")
            self.handle.registerTimer(int(pd.to_datetime(reports["at"]).min().value // 1_000_000) + self.limit_ms)
        shards, closed, done = state
        done = {*done.split(",")} - {""} | {str(int(s)) for s in reports["shard"]}
        complete = not closed and len(done) >= shards
        self.job.update((shards, closed or complete, ",".join(sorted(done))))
        if complete:
            yield self._row(key, "complete", len(done), shards)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        shards, closed, done = self.job.get()
        if not closed:
            self.job.update((shards, True, done))
            yield self._row(key, "timed_out", len({*done.split(",")} - {""}), shards)

    def close(self) -> None:
        pass


def _started(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query with the store it needs; the session's setting stays as it was."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, STORE)
    try:
        return start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def new_rows(source: DataFrame, id_: str = "id", fingerprint: str = "fingerprint") -> DataFrame:
    """A stream, in update mode, of (state, key_id, payload) of the ids of a batch: new, stale or repeated; the payload is the row as JSON.

    All rows of a batch have the batch's time, which its log keeps for a run that is done
    again; an id is new if the first and the last time it was seen are the same.
    """
    print_ = F.coalesce(F.concat(F.lit("="), F.col(fingerprint).cast("string")), F.lit("null"))  # a null is a value of its own
    packed = source.select(F.col(id_).cast("string").alias("key_id"), print_.alias("print"), F.to_json(F.struct("*")).alias("payload"), F.current_timestamp().alias("at"))
    seen = packed.groupBy("key_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi"), F.min("payload").alias("payload"), F.min("at").alias("first"), F.max("at").alias("last"))
    state = F.when(F.col("key_id").isNull() | (F.col("lo") != F.col("hi")), "stale").when(F.col("first") == F.col("last"), "new").otherwise("repeated")
    return seen.select(state.alias("state"), "key_id", "payload")


def follow(source: DataFrame, scorer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, id_: str = "id", fingerprint: str = "fingerprint", once: bool = True) -> StreamingQuery:
    """Score each new id of a stream once, into ``sink``/batch=<number>; ``scorer`` gets the rows as they came in.

    With ``once`` the query ends when it has read what is there; starting it again on the
    same checkpoint goes on from there.
    """
    schema = source.schema

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()  # the state is asked once for a batch
        try:
            bad = [r["key_id"] for r in rows.where("state = 'stale'").select("key_id").limit(5).collect()]
            if bad:
                raise ContractError(f"rows were made from other inputs than before: {bad}")
            new = rows.where("state = 'new'").select(F.from_json("payload", schema).alias("row")).select("row.*")
            scorer(new).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        finally:
            rows.unpersist()

    def start() -> StreamingQuery:
        writer = new_rows(source, id_, fingerprint).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    return _started(source.sparkSession, start)


def results(spark: SparkSession, sink: str, schema: str | T.StructType) -> DataFrame:
    """All rows that were scored so far."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(sink)


def watch(reports: DataFrame, limit: str, delay: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Follow reports (job, shard, shards, at): job, status, reported, shards of every job that is complete or out of time.

    ``limit`` is the time a job has from its first report, ``delay`` how late a report may come.
    """
    spark = reports.sparkSession
    ms = int(pd.Timedelta(limit).total_seconds() * 1000)

    def start() -> StreamingQuery:
        rows = reports.select("job", F.col("shard").cast("int").alias("shard"), F.col("shards").cast("int").alias("shards"), "at").withWatermark("at", delay)
        out = rows.groupBy("job").transformWithStateInPandas(Shards(ms), "job string, status string, reported int, shards int", "Append", "EventTime")
        return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    return _started(spark, start)


def progress(query: StreamingQuery) -> list[dict]:
    """Rows read, and rows of state, of each micro-batch of a run."""
    return [{"rows": p["numInputRows"], "state": [s["numRowsTotal"] for s in p["stateOperators"]]} for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, query.recentProgress)]
