"""What the training-data operators share: the shared folder, word hashes and folds.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; a word's hash is a
64-bit polynomial over its bytes, computed for a whole batch of texts by prefix
sums, so that no Python code runs per word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` excludes it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that are worked on at a time inside a Python worker.
CHUNK_BYTES = 1 << 20
#: Rows of a batch on its way to a Python worker.
BATCH_ROWS = 500


def give_back() -> None:
    """Freed memory goes back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it keeps
        pass


#: What operators remember in a Python worker from task to task, by operator.
_REMEMBERED: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    """A table that lives as long as the worker's tasks are this operator's."""
    return _REMEMBERED.setdefault(operator, {})


def forget(but: str = "") -> None:
    """Empties the tables of all other operators, and the tables of powers."""
    for operator, held in _REMEMBERED.items():
        if operator != but:
            held.clear()
    _POWERS[:] = _NO_POWERS


def released(run, operator: str = ""):
    """A function of batches that gives its freed memory back to the machine when it ends: workers live on beside the next stage's.

    What other operators remember in the worker goes before it begins.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(operator)
        give_back()
        yield from run(batches)
        forget(operator)
        give_back()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing a folder of this machine is used, which is only
    right in local mode; a cluster without the setting is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    path = f"file://{tempfile.mkdtemp(prefix='hedgerow-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers some hundred at a time: a batch of long texts is copied several times on its way."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) <= 0 or int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/hedgerow/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives executors.

    The folder is the caller's to sweep, as with any checkpoint; rows that are
    read back have a fixed order and a fixed split into partitions.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark removes what a written table has shuffled as soon as it stands; for tables that are written once, from here."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A key of the joins below is hot above this many rows, and above this share of all.
HOT_ROWS = 1000
HOT_KEYS = 10_000


def join_by_size(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of many rows with one row per key, whose column ``rows`` counts the key's rows in ``left``.

    ``total`` is the sum of ``rows`` (or more). A key with more than 1,000 and more than
    a ten-thousandth of all rows is hot. There can't be 10,000 such keys, whatever the
    table, so they are broadcast and their rows stay where they lie; the rest is dealt
    by key, of which none is large. ``right`` should be a written table.
    """
    hot = F.col(rows) > max(HOT_ROWS, total // HOT_KEYS)
    few = right.where(hot)
    if few.isEmpty():
        return left.join(right, on)
    return left.join(F.broadcast(few), on).unionByName(left.join(F.broadcast(few.select(*on)), on, "left_anti").join(right.where(~hot), on))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold that nothing learns from: crc32 of the id as text, modulo 5, is 0.

    A null id belongs to the held-out fold, so that it never trains a model.
    """
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def spread(doc_id: str | Column, seed: int) -> Column:
    """A seeded pseudo-random long of an id, the same on every cluster and layout."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.xxhash64(F.lit(seed), col)


# ---------------------------------------------------------------- word hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NO_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))
_POWERS: list[np.ndarray] = list(_NO_POWERS)


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[i] = np.cumprod(step, dtype=np.uint64)
    return _POWERS


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and their offsets; a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes, one text at least."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text, first byte and end of each word).

    ``raw`` and ``off`` hold some texts; the offsets may start above 0.
    """
    off = off - off[0]
    n = len(raw)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    gap = _IS_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    start = np.flatnonzero(~gap & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    end = np.flatnonzero(~gap & (after | edge[1:])) + 1
    parts, at = [], 0
    while at < len(start):  # a long text is hashed some words at a time, so that the tables of powers stay small
        to = max(at + 1, int(np.searchsorted(end, start[at] + 2 * CHUNK_BYTES, "right")))
        lo, hi = start[at], end[to - 1]
        parts.append(_hashes(raw[lo:hi], start[at:to] - lo, end[at:to] - lo))
        at = to
    out = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return out, np.searchsorted(start, off).astype(np.int64), start, end


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` hashes; runs that cross texts are the caller's to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i : i + n]
    return mix(out)
