"""Sinks: JSON lines, single documents, tables in three forms, audio (SNK1-SNK10)."""

from __future__ import annotations

import hashlib
import io
import json
import os
import uuid
import wave
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON objects with keys in order; the folder appears as a whole when the job commits."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)


def append(df: DataFrame, path: str, id_: str = "id") -> int:
    """Append the rows whose id isn't in the folder yet; how many there were."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(df.schema).json(path)
        df = df.join(done.select(id_).distinct(), id_, "left_anti")
    except Exception as e:  # the first append finds no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df = df.dropDuplicates([id_])
    n = df.count()
    if n:
        df.write.mode("append").json(path)
    return n


def document(payload: dict, path: str | Path) -> None:
    """One JSON document, written aside and renamed."""
    aside = f"{path}.tmp"
    with open(aside, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(aside, path)


def yaml_document(payload: dict, path: str | Path) -> None:
    """One YAML mapping with its keys in their order, written aside and renamed (SNK3)."""
    import yaml

    if not isinstance(payload, dict):
        raise ValueError("the root must be a mapping")
    aside = f"{path}.tmp"
    with open(aside, "w", encoding="utf-8") as f:
        yaml.safe_dump(payload, f, sort_keys=False, allow_unicode=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(aside, path)


def csv(df: DataFrame, path: str) -> None:
    """A small report table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _cell(v: object, digits: int) -> str:
    return "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def table_forms(df: DataFrame, digits: int = 4, limit: int = 10_000) -> dict[str, str]:
    """CSV, Markdown and LaTeX text of a report table of at most ``limit`` rows (SNK6, FMT2)."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a report")
    head, cells = df.columns, [[_cell(v, digits) for v in r] for r in rows]
    tex = lambda s: "".join(f"\\{c}" if c in "&%$#_{}" else c for c in s)
    return {
        "csv": "\n".join(",".join(f'"{c}"' if any(x in c for x in ',"\n') else c for c in r) for r in [head, *cells]) + "\n",
        "markdown": "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *cells]) + "\n",
        "latex": "\n".join([rf"\begin{{tabular}}{{{'l' * len(head)}}}", *[" & ".join(map(tex, r)) + r" \\" for r in [head, *cells]], r"\end{tabular}"]) + "\n",
    }


def audio(path: str | Path, samples: np.ndarray, rate: int) -> None:
    """16-bit WAV, clipped to [-1, 1]; folders are made."""
    os.makedirs(os.path.dirname(str(path)) or ".", exist_ok=True)
    with wave.open(str(path), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())


def audio_files(df: DataFrame, folder: str, name: str = "name", samples: str = "samples", rate: str = "rate") -> DataFrame:
    """One 16-bit WAV file per row below a folder that all executors reach: name, path, bytes, sha256.

    A file is written under a name of the attempt and renamed, so a task that runs again
    leaves whole files only; rows of one name write the same file, the last stays. Null
    samples are silence of no length.
    """
    import pyarrow as pa

    def run(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for n, x, r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = io.BytesIO()
                with wave.open(raw, "wb") as f:
                    f.setnchannels(1)
                    f.setsampwidth(2)
                    f.setframerate(r)
                    f.writeframes((np.clip(np.array(x or [], np.float64), -1, 1) * 32767).round().astype("<i2").tobytes())
                path, half = f"{root}/{n}.wav", f"{root}/.{n}-{uuid.uuid4().hex}"
                with files.open_output_stream(half) as f:
                    f.write(raw.getvalue())
                if files.get_file_info(path).type == fs.FileType.File:
                    files.delete_file(path)
                files.move(half, path)
                out.append((n, f"{folder}/{n}.wav", len(raw.getvalue()), hashlib.sha256(raw.getvalue()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["name", "path", "bytes", "sha256"])

    rows = df.select(F.col(name).cast("string"), F.col(samples).cast("array<double>"), F.col(rate).cast("int"))
    return rows.mapInArrow(run, "name string, path string, bytes long, sha256 string")


def macros(df: DataFrame, name: str, value: str, digits: int = 4, limit: int = 10_000) -> str:
    """LaTeX commands of named values (RPT4), of at most ``limit`` rows."""
    letters = F.regexp_replace(F.initcap(F.regexp_replace(name, "[^A-Za-z]+", " ")), " ", "")
    rows = df.select(letters, value).orderBy(letters).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for macros")
    return "".join(rf"\newcommand{{\{r[0]}}}{{{_cell(r[1], digits)}}}" + "\n" for r in rows)
