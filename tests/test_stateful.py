"""Keyed state: each id once over restarts, stale fingerprints, batches that run again, and timers."""

import datetime as dt
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hedgerow.streaming import stateful

SCHEMA = "id long, fingerprint string, value double"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(str(folder))


def scored(df):
    return df.select("id", (F.col("value") * 2).alias("score"))


def start(spark, tmp_path):
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = stateful.follow(source, scored, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    q.awaitTermination(180)
    return q


def found(spark, tmp_path):
    return sorted((r.id, r.score) for r in stateful.results(spark, str(tmp_path / "out"), "id long, score double").collect())


def test_each_id_once_over_runs(spark, tmp_path):
    put(spark, tmp_path / "in", [(i, f"f{i}", i / 2) for i in range(20)] + [(3, "f3", 1.5)] * 2)
    start(spark, tmp_path)
    assert found(spark, tmp_path) == [(i, float(i)) for i in range(20)]
    put(spark, tmp_path / "in", [(i, f"f{i}", i / 2) for i in range(10, 30)] + [(40, None, 1.0), (40, None, 1.0)])
    q = start(spark, tmp_path)
    assert found(spark, tmp_path) == [(i, float(i)) for i in range(30)] + [(40, 2.0)]
    assert sum(p["rows"] for p in stateful.progress(q)) == 22  # the second run reads its own rows, the sink is never read
    before = found(spark, tmp_path)
    start(spark, tmp_path)
    assert found(spark, tmp_path) == before
    # the last batch is lost after its rows were written: it runs again under its number, and its rows are there once
    last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        p = tmp_path / "checkpoint" / "commits" / name
        if p.exists():
            p.unlink()
    start(spark, tmp_path)
    assert found(spark, tmp_path) == before


def test_stale_rows_are_refused(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, "a", 1.0), (2, "b", 1.0)])
    start(spark, tmp_path)
    put(spark, tmp_path / "in", [(2, "other", 1.0), (3, "c", 1.0)])
    with pytest.raises(Exception, match="other inputs"):
        start(spark, tmp_path)
    assert [i for i, _ in found(spark, tmp_path)] == [1, 2]  # nothing of the refused batch is there


@pytest.mark.parametrize("rows", [[(5, "a", 1.0), (5, "b", 1.0)], [(None, "a", 1.0)], [(6, None, 1.0), (6, "null", 1.0)]])
def test_contradictions_in_one_batch(spark, tmp_path, rows):
    put(spark, tmp_path / "in", rows)
    with pytest.raises(Exception, match="other inputs"):
        start(spark, tmp_path)
    shutil.rmtree(tmp_path / "in")


def test_timer_of_jobs(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    at = lambda minutes: t + dt.timedelta(minutes=minutes)
    schema = "job string, shard int, shards int, at timestamp"
    first = [("whole", 0, 2, at(0)), ("whole", 1, 2, at(5)), ("half", 0, 2, at(1)), ("late", 0, 2, at(2))]
    later = [("late", 1, 2, at(20)), ("other", 0, 9, at(200))]

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stateful.watch(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "60 minutes", "1 minute", str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(180)
        return sorted((r.job, r.status, r.reported) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run(first) == [("whole", "complete", 2)]
    run(later)
    assert run([("end", 0, 9, at(900))]) == [("half", "timed_out", 1), ("late", "complete", 2), ("other", "timed_out", 1), ("whole", "complete", 2)]


def test_a_job_asks_its_state_once_for_a_batch(monkeypatch):
    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, x):
            calls.append("update")
            self.held = x

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            calls.append("timer")

    p = stateful.Shards(1000)
    p.init(Handle())
    pdf = pd.DataFrame({"shard": list(range(50)), "shards": [50] * 50, "at": [dt.datetime(2024, 1, 1)] * 50})
    (row,) = p.handleInputRows(("j",), iter([pdf[:20], pdf[20:]]), None)
    assert row.values.tolist() == [["j", "complete", 50, 50]] and sorted(calls) == ["get", "timer", "update"]
    assert not list(p.handleInputRows(("j",), iter([pdf]), None)) and not list(p.handleExpiredTimer(("j",), None, None))


def test_ids_are_kept_without_a_python_worker(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, "a", 1.0)])
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert "Python" not in stateful.new_rows(source)._jdf.queryExecution().analyzed().toString()
