"""Sources: JSON lines, delimited text, audio, digests, listings and configuration (SRC1-SRC14)."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON objects, one a line; blank lines are skipped, a line that is no such object fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, text) of lines that don't parse to the schema: what the failing read doesn't tell.

    Files are read in splits. A line's number is its place in its split, which row ids of
    the scan give, and the lines of the splits before it: one row for each split.
    """
    meta = F.col("_metadata")
    read = spark.read.text(path, lineSep="\n")
    lines = read.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    parsed = F.from_json("text", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    bad = lines.where(F.trim("text") != "").where(parsed.isNull() | parsed["_bad"].isNotNull())
    return bad.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "text")


def delimited(spark: SparkSession, path: str, sep: str = "\t", schema: str | None = None) -> DataFrame:
    """Text with a header line, tabs or commas, and double quotes."""
    reader = spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL, so that aggregates skip it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def _wave(content: bytes) -> tuple[int, list[float]]:
    with wave.open(io.BytesIO(content)) as f:
        raw, width = np.frombuffer(f.readframes(f.getnframes()), np.uint8), f.getsampwidth()
        if width == 1:  # 8 bits are unsigned
            x = raw.astype(np.float32) / 128 - 1
        elif width in (2, 3, 4):
            whole = np.zeros((len(raw) // width, 4), np.uint8)
            whole[:, 4 - width :] = raw.reshape(-1, width)
            x = (whole.view("<i4")[:, 0] / 2.0**31).astype(np.float32)
        else:
            raise ValueError(f"samples of {width} bytes are not known")
        return f.getframerate(), x.reshape(-1, f.getnchannels()).mean(1).tolist()


def audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, samples) of WAV files of 8 to 32 bits, channels averaged."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [_wave(c) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "rate": [r for r, _ in got], "samples": [s for _, s in got]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(decode, "path string, rate int, samples array<float>")


def digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _moved(path: Column, old: str, new: str) -> Column:
    """The path with a prefix replaced, if it has it; the prefix is plain text."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def resolve(df: DataFrame, column: str, listing: DataFrame, roots: list[str], rewrites: dict[str, str]) -> DataFrame:
    """Adds ``resolved``: the first of the path, its rewritten forms and its places under the roots that is listed; NULL if none is."""
    p = F.col(column)
    forms = [p, *[_moved(p, old, new) for old, new in rewrites.items()], *[F.concat(F.lit(r.rstrip("/") + "/"), p) for r in roots]]
    named = df.select("*", F.posexplode(F.array(*forms)).alias("_rank", "_path"))
    found = named.join(listing.select(F.col("path").alias("_path")).distinct(), "_path", "left_semi")
    best = found.groupBy(F.col(column).alias("_key")).agg(F.min_by("_path", "_rank").alias("resolved"))
    return df.join(best, df[column] == best["_key"], "left").drop("_key")


def migrate(df: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    """Path prefixes replaced in some columns (SRC14)."""
    return df.withColumns({c: _moved(F.col(c), old, new) for c in columns})


def config(path: str | Path) -> dict:
    """A YAML file whose root is a mapping; small and read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: the root must be a mapping")
    return found
