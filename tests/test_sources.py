import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgerow.operators.contracts import ContractError
from hedgerow.sources import readers, writers
from hedgerow.streaming import incremental


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": NaN}\n\n{"id": 2, "x": 0.5}\n')
    df = readers.missing_as_null(readers.jsonl(spark, str(tmp_path / "a.jsonl"), "id int, x double"))
    assert {r.id: r.x for r in df.collect()} == {1: None, 2: 0.5}
    (tmp_path / "b.jsonl").write_text('{"id": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.jsonl(spark, str(tmp_path / "b.jsonl"), "id int").collect()
    assert [(r.line, r.text) for r in readers.jsonl_errors(spark, str(tmp_path / "b.jsonl"), "id int").collect()] == [(2, "not json")]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "id int, t string")
    writers.jsonl(df, str(tmp_path / "j"))
    assert {tuple(r) for r in readers.jsonl(spark, str(tmp_path / "j"), "id int, t string").collect()} == {(1, "é"), (2, None)}
    assert writers.append(df, str(tmp_path / "k")) == 2
    assert writers.append(df.union(spark.createDataFrame([(3, "x")], "id int, t string")), str(tmp_path / "k")) == 1
    writers.csv(df, str(tmp_path / "c"))
    assert readers.delimited(spark, str(tmp_path / "c"), ",").count() == 2
    writers.document({"b": 1, "a": "é"}, tmp_path / "d.json")
    assert (tmp_path / "d.json").read_text().index('"a"') < (tmp_path / "d.json").read_text().index('"b"')


def test_audio(spark, tmp_path):
    x = np.sin(np.arange(100) / 5) * 2
    writers.audio(tmp_path / "s" / "a.wav", x, 8000)
    row = readers.audio(spark, str(tmp_path / "s")).first()
    assert row.rate == 8000 and np.allclose(row.samples, np.clip(x, -1, 1), atol=1e-3)
    assert readers.digests(spark, str(tmp_path / "s"), "*.wav").first().bytes == 44 + 200


def test_paths_and_tables(spark):
    listing = spark.createDataFrame([("/data/a.wav",), ("/new/b.wav",)], "path string")
    df = spark.createDataFrame([("a.wav",), ("/old/b.wav",), ("c.wav",)], "p string")
    got = {r.p: r.resolved for r in readers.resolve(df, "p", listing, ["/data"], {"/old": "/new"}).collect()}
    assert got == {"a.wav": "/data/a.wav", "/old/b.wav": "/new/b.wav", "c.wav": None}
    forms = writers.table_forms(spark.createDataFrame([("a_b", 0.5, None)], "n string, v double, w double"))
    assert forms["markdown"].endswith("| a_b | 0.5000 | -- |\n") and r"a\_b" in forms["latex"]
    assert writers.macros(spark.createDataFrame([("full head", 0.25)], "n string, v double"), "n", "v") == "\\newcommand{\\FullHead}{0.2500}\n"


def test_incremental(spark, tmp_path):
    sink = str(tmp_path / "sink")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("fingerprint", T.StringType()), T.StructField("score", T.DoubleType())])
    score = lambda df: df.withColumn("score", F.col("id") * 0.5)
    rows = lambda n, f="v1": spark.range(n).select("id", F.lit(f).alias("fingerprint"))
    assert incremental.run_pending(rows(3), score, sink, schema) == 3
    assert incremental.run_pending(rows(5), score, sink, schema) == 2
    assert incremental.run_pending(rows(5), score, sink, schema) == 0
    with pytest.raises(ContractError):
        incremental.run_pending(rows(5, "v2"), score, sink, schema)
    source = str(tmp_path / "in")
    rows(7).write.parquet(source)
    stream = spark.readStream.schema("id long, fingerprint string").parquet(source)
    incremental.follow(stream, score, sink, str(tmp_path / "ck"), schema).awaitTermination(120)
    assert spark.read.parquet(sink).count() == 7
    manifest = spark.range(8).select("id", F.col("id").alias("_pos"))
    assert {r.shard: r.status for r in incremental.status(manifest, spark.read.parquet(sink), 2).collect()} == {0: "complete", 1: "running"}
