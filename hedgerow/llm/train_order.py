"""Token sequences in training order, as fixed-stride binary records.

Documents are encoded once and cut into sequences of at most ``stride`` tokens. A
sequence's index is its place in the order of document id, text hash and position:
texts are range-partitioned in that order before they are encoded and each range counts
its sequences, so the index follows from the rows, whatever files, splits or cores there
are. A keyed Feistel permutation
with cycle-walking maps the indexes 0..n-1 one to one onto slots 0..n-1, without any
sort or table of n entries. Shards are written in ``PASSES`` passes over the encoded texts, each
of which moves the sequences of its own shards alone; what it shuffled is given back when it
ends, so that disks never hold the whole of it beside the shards. In a pass consecutive
shards are dealt to range partitions, at least
``SHARDS_A_TASK`` to each where there are more shards than shuffle partitions, and
sorted there: shard k holds the slots from k * per_shard on, and slot s lies at byte
(s - k * per_shard) * stride * 2, so a reader can stop at any slot and go on from it. A
task holds one shard at a time.

A folder of shards has a manifest that says what it is made of (key, number of
sequences, stride, vocabulary, fingerprint of the rows). A run that goes on in a
folder of another manifest is refused. Shards are written under a temporary name
and renamed; a shard that is there already is compared with its records by checksum
and written again if it differs, so a broken run ends with the same bytes as an
unbroken one. Files go through pyarrow's file systems (local or mounted folders,
hdfs, object stores), not through ``open``.

Records are unsigned 16-bit little-endian ids, padded with ``pad``; vocabularies
above 65,536 ids are refused.

Defined cases: null and empty texts have no sequence; a text of any length is cut
as a whole; an empty table gives no sequence and no shard; ids may be null (they come
first) or repeat; rows with the same id and text are copies, of which each has its
slots; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, freed_shuffles, keep, mix, small_batches, utf8
from .token_count import PATTERN

STRIDE = 512
PER_SHARD = 8192
#: Shards that a task writes one after another, if there are many.
SHARDS_A_TASK = 64
#: Passes that shards are written in.
PASSES = 4
ROUNDS = 6


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of some indexes: a bijection of 0..n-1."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (1 << 64) - 1))
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = todo[x[todo] >= np.uint64(n)]  # outside the range: walk on along the cycle
    return x.astype(np.int64)


_ENCODINGS: dict = {}


def encoding(ranks: bytes, pattern: str):
    """One encoding for each vocabulary and worker process."""
    key = zlib.crc32(ranks)
    if key not in _ENCODINGS:
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        _ENCODINGS[key] = tiktoken.Encoding(f"ranks-{key}", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def token_table(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", stride: int = STRIDE, pattern: str = PATTERN) -> DataFrame:
    """Written rows (doc_id, text_hash, n_seq, ids, part, first): ids as 16-bit binary; texts without tokens have no row.

    The rows of all parts, one after another, are in the order of id and text hash;
    ``first`` is the number of sequences that lie before a row in its part.
    ``ranks_path`` names a vocabulary of tokens and their ranks; strings of special
    tokens in a text are ordinary text.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    small_batches(docs.sparkSession)
    # bounded by the vocabulary file
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            _, off = utf8(batch.column(2))
            for at, to in chunks(off):
                enc = encoding(shared.value, pattern)
                ids = [np.array(enc.encode_ordinary(t or ""), np.int32) for t in batch.column(2).slice(at, to - at).to_pylist()]
                if any(len(x) and x.max() > 65535 for x in ids):
                    raise ValueError("records hold 16-bit ids")
                n = np.array([-(-len(x) // stride) for x in ids], np.int64)
                first = before + np.cumsum(n) - n
                before += int(n.sum())
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(n), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary()), pa.array(first)], ["doc_id", "text_hash", "n_seq", "ids", "first"])
                yield out.filter(pa.array(n > 0))

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_seq", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("first", T.LongType())])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    order = ["doc_id", "text_hash", "row"]  # rows that agree but for ``row`` are copies, whose records are the same
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text_hash", "text")
    with freed_shuffles(docs.sparkSession):
        return keep(ranged.mapInArrow(run, out).select("doc_id", "text_hash", "n_seq", "ids", F.spark_partition_id().alias("part"), "first"), "tokens", "zstd")


def sequence_index(tokens: DataFrame) -> tuple[DataFrame, int]:
    """(part, base), where base is the index of a part's first sequence, and the number of sequences."""
    # one row for each part
    sizes = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n_seq").alias("n")).collect()}
    base, n = [], 0
    for part in sorted(sizes):
        base.append((part, n))
        n += sizes[part]
    return tokens.sparkSession.createDataFrame(base, "part int, base long"), n


def range_partitions(shards: int, shuffle_partitions: int) -> int:
    """Number of tasks that some shards are dealt to: one each while they are few."""
    return min(shards, max(shuffle_partitions, -(-shards // SHARDS_A_TASK)))


def ordered_sequences(tokens: DataFrame, key: int, stride: int = STRIDE, per_shard: int = PER_SHARD, pad: int = 0, placed: tuple[DataFrame, int] | None = None, only: tuple[int, int] | None = None) -> DataFrame:
    """One row per sequence, range-partitioned by shard and sorted by slot: slot, shard, doc_id, seq, n_tokens, record.

    ``only`` names the first shard and the end of those that are asked for.
    """
    index, n = placed or sequence_index(tokens)
    kind = tokens.schema["doc_id"].dataType
    low, high = only or (0, max(1, -(-n // per_shard)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("n_seq").to_numpy()
            ids = batch.column("ids")
            row = np.repeat(np.arange(len(counts)), counts)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            slot = permute(np.repeat(batch.column("first").to_numpy(), counts) + seq, n, key)
            own = np.flatnonzero((slot >= low * per_shard) & (slot < high * per_shard))
            slot, row, seq = slot[own], row[own], seq[own]
            payload = [ids[r].as_buffer()[i * 2 * stride : (i + 1) * 2 * stride].to_pybytes() for r, i in zip(row.tolist(), seq.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), batch.column("doc_id").take(pa.array(row)), pa.array(seq), pa.array(np.array([len(x) // 2 for x in payload], np.int64)), pa.array(payload, pa.binary())], ["slot", "shard", "doc_id", "seq", "n_tokens", "ids"])

    out = T.StructType([T.StructField("slot", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("doc_id", kind), T.StructField("seq", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    shards = high - low
    tasks = range_partitions(shards, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    padding = int(pad).to_bytes(2, "little") * stride
    indexed = tokens.join(F.broadcast(index), "part").select("doc_id", "n_seq", "ids", (F.col("base") + F.col("first")).alias("first"))
    dealt = indexed.mapInArrow(run, out).repartitionById(tasks, F.floor((F.col("shard") - low) * tasks / shards).cast("int")).sortWithinPartitions("slot")
    record = F.substring(F.concat(F.col("ids"), F.lit(bytearray(padding))), 1, 2 * stride)
    return dealt.select("slot", "shard", "doc_id", "seq", "n_tokens", record.alias("record"))


def _files(folder: str):
    """The file system of a folder and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _name(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:08d}.bin"


def _checksum(files, name: str) -> int | None:
    from pyarrow import fs

    if files.get_file_info(name).type != fs.FileType.File:
        return None
    crc = 0
    with files.open_input_stream(name) as f:
        while part := f.read(1 << 20):
            crc = zlib.crc32(part, crc)
    return crc


def fingerprint(tokens: DataFrame) -> str:
    """The same for the same documents in any order, split or file."""
    row = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id", "text_hash", "n_seq").cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"


def write_training_order(docs: DataFrame, ranks_path: str, folder: str, key: int, id_col: str = "doc_id", text_col: str = "text", stride: int = STRIDE, per_shard: int = PER_SHARD, pad: int = 0, pattern: str = PATTERN, listed: bool = False) -> DataFrame:
    """Write all shards of a table into a folder that all executors reach, or go on where a broken run stopped.

    Returns shard, first_slot, n_sequences, crc, written (False for a shard that was
    there already, whole and the same); with ``listed`` the records of the shards as they
    stand in the files: slot, shard, byte_offset, doc_id, seq, n_tokens, record_crc32.
    """
    from pyarrow import fs

    master = docs.sparkSession.sparkContext.master
    if "://" not in folder and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError(f"{folder} would be a disk of each executor's own; name the folder by a URI that all of them reach (file:// for a mounted one)")
    tokens = token_table(docs, ranks_path, id_col, text_col, stride, pattern)
    index, n = sequence_index(tokens)
    with open(ranks_path, "rb") as f:
        vocabulary = hashlib.sha256(f.read() + pattern.encode()).hexdigest()
    manifest = {"key": key, "sequences": n, "stride": stride, "per_shard": per_shard, "pad": pad, "vocabulary": vocabulary, "rows": fingerprint(tokens)}
    files, path = _files(folder)
    files.create_dir(path, recursive=True)
    if files.get_file_info(f"{path}/manifest.json").type == fs.FileType.File:
        with files.open_input_stream(f"{path}/manifest.json") as f:
            there = json.loads(f.read())
        if there != manifest:
            raise ValueError(f"{folder} holds another training order: {[k for k in manifest if manifest[k] != there.get(k)]} differ")
    elif any(x.base_name.startswith("shard-") for x in files.get_file_info(fs.FileSelector(path))):
        raise ValueError(f"{folder} holds shards without a manifest")
    else:
        with files.open_output_stream(f"{path}/.manifest") as f:
            f.write(json.dumps(manifest, sort_keys=True).encode())
        files.move(f"{path}/.manifest", f"{path}/manifest.json")
    for x in files.get_file_info(fs.FileSelector(path)):
        if x.base_name.startswith(".shard-"):  # of a run that broke
            files.delete_file(x.path)
    shards = max(1, -(-n // per_shard))
    edges = [shards * i // min(PASSES, shards) for i in range(min(PASSES, shards) + 1)]
    with freed_shuffles(docs.sparkSession):
        done = [keep(write_shards(ordered_sequences(tokens, key, stride, per_shard, pad, (index, n), only), folder, listed), "shards") for only in zip(edges, edges[1:], strict=False)]
    return reduce(DataFrame.unionAll, done)


def write_shards(sequences: DataFrame, folder: str, listed: bool = False) -> DataFrame:
    """Write the shards as the returned rows are read: shard, first_slot, n_sequences, crc, written, or with ``listed`` their records.

    A record's place and checksum are those of the bytes that are read back from its shard.
    """
    kind = sequences.schema["doc_id"].dataType
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    records_of = T.StructType([*longs("slot", "shard", "byte_offset"), T.StructField("doc_id", kind), *longs("seq", "n_tokens", "record_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        shard, first, records, thin = None, 0, [], []

        def listing() -> pa.RecordBatch:
            at, offsets, crcs = 0, [], []
            with files.open_input_stream(_name(path, shard)) as f:
                for record in records:
                    offsets.append(at)
                    crcs.append(zlib.crc32(f.read(len(record))))
                    at += len(record)
            table = pa.Table.from_batches(thin)
            columns = [*table.select(["slot", "shard"]).columns, pa.array(offsets), *table.select(["doc_id", "seq", "n_tokens"]).columns, pa.array(crcs)]
            return pa.table(columns, names=records_of.names).combine_chunks().to_batches()[0]

        def close() -> pa.RecordBatch:
            # a shard is per_shard records of fixed length
            whole = b"".join(records)
            crc = zlib.crc32(whole)
            if new := _checksum(files, _name(path, shard)) != crc:
                name = f"{path}/.shard-{shard}-{uuid.uuid4().hex}"
                with files.open_output_stream(name) as f:
                    f.write(whole)
                files.move(name, _name(path, shard))
            if listed:
                return listing()
            return pa.RecordBatch.from_pylist([{"shard": shard, "first_slot": first, "n_sequences": len(records), "crc": crc, "written": new}])

        for batch in batches:
            of = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi == lo:
                    continue
                if of[lo] != shard:
                    if shard is not None:
                        yield close()
                    shard, first, records, thin = int(of[lo]), batch.column("slot")[lo].as_py(), [], []
                part = batch.slice(lo, hi - lo)
                records += part.column("record").to_pylist()
                if listed:
                    thin.append(part.select(["slot", "shard", "doc_id", "seq", "n_tokens"]))
        if shard is not None:
            yield close()

    if listed:
        return sequences.select("shard", "slot", "record", "doc_id", "seq", "n_tokens").mapInArrow(run, records_of)
    return sequences.select("shard", "slot", "record").mapInArrow(run, "shard long, first_slot long, n_sequences long, crc long, written boolean")


def read_slots(folder: str, slot: int, count: int) -> Iterator[np.ndarray]:
    """Records from a slot on, in order: what a training job reads after a stop."""
    files, path = _files(folder)
    with files.open_input_stream(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    size, per_shard = manifest["stride"] * 2, manifest["per_shard"]
    end = min(slot + count, manifest["sequences"])
    while slot < end:
        with files.open_input_file(_name(path, slot // per_shard)) as f:
            f.seek(slot % per_shard * size)
            for _ in range(min(end, (slot // per_shard + 1) * per_shard) - slot):
                if len(raw := f.read(size)) != size:
                    raise ValueError(f"shard {slot // per_shard} of {folder} is short")
                yield np.frombuffer(raw, "<u2")
                slot += 1
