"""A pair of tables rewritten into common buckets, one sorted Parquet file per table and bucket.

The order is found before any payload moves. From the starting files, which are sorted
themselves, only the key is read, with pointers: the number of the file and the place in
it. Inside a file the place is the order already, so rows of one key are tied only if
they come from different files; for those, and no others, the next column is fetched,
and so on until no group is tied. Keys, fetched columns and pointers are range-sorted
by (bucket, key, fetched columns, pointer): the permutation.

The payload moves once. Pointers are dealt by row group of the starting files, so that
each row group is read by one task, once; its rows go to the ranges of the permutation,
where each column is taken into its new order on its own and written. Where a bucket
lies in one range that file is the bucket's, otherwise its pieces are strung together
by one streaming task, row group by row group. A key, file or bucket that holds any
share of the rows is spread over ranges of bounded size all along; only that last
stringing together of one demanded file is a single task's.

A starting file that holds the rows of just one bucket, and all of them, stays as it is.
Every step is written to a work folder of the run and named by attempt, so a task that
runs again reads what is there and leaves nothing but what its rows name; the work
folder goes at the end. To the driver come figures by file and bucket, at most two more
than there are buckets for each table.

Defined cases: a null key has a bucket of its own (``buckets`` + 1), one that the left
table doesn't hold another (``buckets``); nulls come first in every column; text, numbers
and times of any length and equal rows are kept as they are; an empty table has no
file; columns of any name, those of the plan included, are payload. Columns must be of
kinds that can be ordered.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_size, shared_path, small_batches
from .train_order import _files

#: Rows of a row group, which is what a gathering task reads at a time, and about those of a range.
GROUP_ROWS = 65_536
PART_ROWS = 1_000_000
LEAST_PARTS = 8


@dataclass
class Numbered:
    """The files of a table: numbers, paths and rows."""

    folder: str
    schema: object
    files: dict[int, tuple[str, int]]

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.files.values())


def _parts(rows: int) -> int:
    return max(LEAST_PARTS, math.ceil(rows / PART_ROWS))


def _plain(path: str) -> str:
    """A path as other readers take it: without the scheme of local or mounted files."""
    return path.removeprefix("file://") if path.startswith("file:///") else path


def _kept(df: DataFrame, work: str, name: str) -> DataFrame:
    """Written to the run's work folder and read again."""
    path = f"{work}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- pieces of files


class _Piece:
    """One file that is written row group by row group."""

    def __init__(self, folder: str, schema: pa.Schema):
        import pyarrow.parquet as pq

        files, path = _files(folder)
        self.path = f"{folder}/{uuid.uuid4().hex}.parquet"
        self.stream = files.open_output_stream(f"{path}/{self.path.rpartition('/')[2]}")
        self.writer = pq.ParquetWriter(self.stream, schema)
        self.held, self.waiting, self.rows = [], 0, 0

    def add(self, table: pa.Table) -> None:
        self.held.append(table)
        self.waiting, self.rows = self.waiting + table.num_rows, self.rows + table.num_rows
        if self.waiting >= GROUP_ROWS:
            whole = pa.concat_tables(self.held)
            full = whole.num_rows // GROUP_ROWS * GROUP_ROWS
            self.writer.write_table(whole.slice(0, full), row_group_size=GROUP_ROWS)
            self.held, self.waiting = [whole.slice(full)], whole.num_rows - full

    def close(self) -> None:
        if self.waiting:
            self.writer.write_table(pa.concat_tables(self.held).combine_chunks(), row_group_size=GROUP_ROWS)
        self.writer.close()
        self.stream.close()


def _flat(rows: pa.StructArray) -> pa.Table:
    return pa.Table.from_arrays(rows.flatten(), schema=pa.schema(list(rows.type)))


def _pieces(runs: Iterator[tuple[int, int, pa.Table]], folder: str) -> Iterator[pa.RecordBatch]:
    """Write consecutive rows of one (file, part) as a piece; a row for each."""
    key, piece = None, None

    def done() -> pa.RecordBatch:
        piece.close()
        return pa.RecordBatch.from_pylist([{"file": key[0], "part": key[1], "path": piece.path, "n": piece.rows}], pa.schema([("file", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n", pa.int64())]))

    for file, part, table in runs:
        if (file, part) != key:
            if piece:
                yield done()
            key, piece = (file, part), _Piece(folder, table.schema)
        piece.add(table)
    if piece:
        yield done()


def _runs(file: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of one (file, part)."""
    if len(file):
        edge = np.flatnonzero((np.diff(file) != 0) | (np.diff(part) != 0)) + 1
        yield from zip([0, *edge.tolist()], [*edge.tolist(), len(file)], strict=True)


def _sha_of_keys(path: str, key: str) -> str:
    """Of the decimal keys of a file, in order, with commas between them; a null is empty."""
    import pyarrow.parquet as pq

    files, inner = _files(path)
    sha, first = hashlib.sha256(), True
    with files.open_input_file(inner) as f:
        for batch in pq.ParquetFile(f).iter_batches(GROUP_ROWS, columns=[key]):
            text = ",".join("" if x is None else str(x) for x in batch.column(0).to_pylist())
            sha.update((text if first else f",{text}").encode())
            first = False
    return sha.hexdigest()


def _joined(pieces: DataFrame, folder: str, name: str, count: int, key: str | None = None) -> list:
    """One file for each number from its pieces, in order of their parts: rows of file, path, n and (with a key) its digest."""
    small_batches(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, inside = _files(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{inside}/{name}-{row['file']:05d}.parquet"
                own = [_files(p["path"])[1] for p in row["pieces"]]
                if len(own) > 1:  # a demanded file of several pieces: streamed by row groups
                    piece = None
                    for x in own:
                        with files.open_input_file(x) as f:
                            for part in pq.ParquetFile(f).iter_batches(GROUP_ROWS):
                                piece = piece or _Piece(row["work"], part.schema)
                                piece.add(pa.Table.from_batches([part]))
                    piece.close()
                    own = [_files(piece.path)[1]]
                there = files.get_file_info(own[0]).type == fs.FileType.File
                if there:  # else an attempt before this one has moved it
                    if files.get_file_info(path).type == fs.FileType.File:
                        files.delete_file(path)
                    files.move(own[0], path)
                final = f"{folder}/{name}-{row['file']:05d}.parquet"
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "path": final, "n": sum(p["n"] for p in row["pieces"]), "sha": _sha_of_keys(final, key) if key else ""}], pa.schema([("file", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("sha", pa.string())]))

    work = f"{folder.rpartition('/')[0]}/_work/pieces"
    each = pieces.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("part", "path", "n"))).alias("pieces")).select("file", F.lit(work).alias("work"), "pieces")
    return each.repartitionById(count, F.col("file")).mapInArrow(run, "file int, path string, n long, sha string").collect()


def write_numbered(df: DataFrame, number: Column, order: list[str], folder: str, name: str, count: int) -> Numbered:
    """The rows as one file for each number below ``count``, each sorted by the columns in ``order``, nulls first."""
    small_batches(df.sparkSession)
    work = f"{folder.rpartition('/')[0]}/_work/pieces"
    for x in (folder, work):
        files, path = _files(x)
        files.create_dir(path, recursive=True)
    by = ["file", *[F.col("row").getField(c) for c in order]]
    packed = df.select(number.cast("int").alias("file"), F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]).alias("row"))
    ranged = packed.repartitionByRange(_parts(df.count()), *by).sortWithinPartitions(*by).select("file", F.spark_partition_id().alias("part"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs():
            for batch in batches:
                file, part, table = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _flat(batch.column(2))
                yield from ((int(file[a]), int(part[a]), table.slice(a, b - a)) for a, b in _runs(file, part))

        return _pieces(runs(), work)

    pieces = _kept(ranged.mapInArrow(run, "file int, part int, path string, n long"), work.rpartition("/")[0], "start-pieces")
    return Numbered(folder, df.schema, {r["file"]: (r["path"], r["n"]) for r in _joined(pieces, folder, name, count)})


# ---------------------------------------------------------------- the order


def _read(spark: SparkSession, table: Numbered, order: list[str], depth: int, files: list[int]) -> DataFrame:
    """k0, k1 ... (the first columns of the order), file and row (the pointer): other columns are not read."""
    source = spark.read.schema(table.schema).parquet(*[table.files[f][0] for f in files])
    number = F.regexp_extract(F.col("_metadata.file_name"), r"-(\d+)\.parquet$", 1).cast("int")
    return source.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order[:depth])], number.alias("file"), F.col("_metadata.row_index").alias("row"))


def _group(depth: int) -> Column:
    """A prefix as one value, in which nulls are equal."""
    return F.struct(*[f"k{i}" for i in range(depth)])


def _tied() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), (F.min("file") < F.max("file")).alias("tied")]


def permutation(spark: SparkSession, table: Numbered, order: list[str], groups: DataFrame, files: list[int], work: str) -> DataFrame:
    """bucket, k0, k1 ..., file, row of every row of some files: what orders it among its bucket's rows.

    ``groups`` has g (the key as a struct), n (its rows), tied (they come from several
    files) and bucket. A column beyond the key is null unless it was fetched.
    """
    total, settled, depth = table.rows, [], 1
    now = _read(spark, table, order, 1, files).withColumn("g", _group(1))
    while True:
        rest = groups.where("tied")
        last = depth == len(order) or rest.isEmpty()
        settled.append(join_by_size(now, (groups if last else groups.where(~F.col("tied"))).select("g", "n", "bucket"), ["g"], "n", total).drop("g", "n"))
        if last:
            return _kept(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), settled), work, "order")
        fetched = _read(spark, table, order, depth + 1, files).withColumn("g", _group(depth))
        depth += 1
        now = _kept(join_by_size(fetched, rest.select("g", "n", "bucket"), ["g"], "n", total).drop("g", "n"), work, "fetched").withColumn("g", _group(depth))
        groups = _kept(now.groupBy("g").agg(*_tied(), F.first("bucket").alias("bucket")), work, "groups")
        now = now.drop("bucket")


def gather(perm: DataFrame, table: Numbered, work: str) -> DataFrame:
    """Move the payload once, into the order of the permutation: pieces by (bucket, range)."""
    paths = {f: p for f, (p, _) in table.files.items()}
    parts = _parts(table.rows)
    keys = [c for c in perm.columns if c[0] == "k" and c[1:].isdigit()]
    by = ["bucket", *sorted(keys, key=lambda c: int(c[1:])), "file", "row"]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = perm.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("bucket", "file", "row", F.spark_partition_id().alias("part"), place.alias("at"))
    dealt = placed.withColumn("group", F.floor(F.col("row") / GROUP_ROWS)).repartition(parts, "file", "group").sortWithinPartitions("file", "row")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a row group with their new places."""
        import pyarrow.parquet as pq

        open_, key, held = None, None, []

        def flush():
            nonlocal open_
            file, group = key
            if open_ is None or open_[0] != file:
                files, path = _files(paths[file])
                open_ = file, pq.ParquetFile(files.open_input_file(path))
            rows = pa.Table.from_batches(held)
            payload = open_[1].read_row_group(group).combine_chunks()
            if payload.num_rows != rows.num_rows:
                raise ValueError(f"{rows.num_rows} pointers for {payload.num_rows} rows of group {group} of {paths[file]}")
            whole = pa.Table.from_arrays([rows.column(c) for c in ("part", "at", "bucket")] + [pa.StructArray.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in payload.columns], fields=list(payload.schema))], ["part", "at", "bucket", "payload"])
            yield from whole.combine_chunks().to_batches(max_chunksize=10_000)

        for batch in batches:
            file, group = batch.column("file").to_numpy(), batch.column("group").to_numpy()
            for a, b in _runs(file, group):
                if (int(file[a]), int(group[a])) != key:
                    if held:
                        yield from flush()
                    key, held = (int(file[a]), int(group[a])), []
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    kind = ", ".join(f"`{f.name.replace('`', '``')}`: {f.dataType.simpleString()}" for f in table.schema)
    moved = dealt.mapInArrow(fetch, f"part int, at long, bucket int, payload struct<{kind}>")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Take each column into its new order, then write the buckets' rows as they follow."""

        def runs():
            held = list(batches)
            if not any(b.num_rows for b in held):
                return
            rows = pa.Table.from_batches(held)
            part, at, bucket = (rows.column(c).to_numpy() for c in ("part", "at", "bucket"))
            order = np.lexsort((at, part))
            take, payload = pa.array(order), rows.column("payload").combine_chunks()
            payload = payload if isinstance(payload, pa.StructArray) else payload.chunk(0)
            del rows, held
            columns = [payload.field(i).take(take) for i in range(payload.type.num_fields)]
            table = pa.Table.from_arrays(columns, schema=pa.schema(list(payload.type)))
            part, bucket = part[order], bucket[order]
            yield from ((int(bucket[a]), int(part[a]), table.slice(a, b - a)) for a, b in _runs(bucket, part))

        return _pieces(runs(), f"{work}/pieces")

    ranged = moved.repartitionById(parts, F.col("part"))
    return _kept(ranged.mapInArrow(write, "file int, part int, path string, n long"), work, "pieces")


# ---------------------------------------------------------------- the pair


def _rewrite(spark: SparkSession, name: str, table: Numbered, order: list[str], groups: DataFrame, buckets: int, work: str, joined: dict[int, int]) -> list[tuple]:
    """Rewrite one table by the buckets of its keys; a row for each final file."""
    if not table.files:
        return []
    groups = _kept(groups, work, "groups")
    every = list(table.files)
    # at most (buckets + 2) squared pairs, whatever the table
    pairs = join_by_size(_read(spark, table, order, 1, every).withColumn("g", _group(1)), groups.select("g", "n", "bucket"), ["g"], "n", table.rows).groupBy("bucket", "file").agg(F.count(F.lit(1)).alias("rows"))
    pairs = _kept(pairs, work, "lineage")
    line = F.concat_ws(",", F.transform("from", lambda x: F.concat_ws(":", x["file"], x["rows"])))
    alone = pairs.groupBy("file").agg(F.count(F.lit(1)).alias("buckets"))
    by_bucket = pairs.join(alone, "file").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("file", "rows"))).alias("from"), F.sum("rows").alias("rows"), F.max("buckets").alias("buckets"), F.min("file").alias("file"))
    info = {r["bucket"]: r for r in by_bucket.select("bucket", "rows", "file", ((F.size("from") == 1) & (F.col("buckets") == 1)).alias("stays"), F.sha2(line, 256).alias("sha")).collect()}
    stays = {r["file"]: b for b, r in info.items() if r["stays"]}
    moving = [f for f in every if f not in stays]
    final = {}
    if moving:
        left = groups.join(F.broadcast(spark.createDataFrame([(b,) for b in stays.values()], "bucket int")), "bucket", "left_anti") if stays else groups
        perm = permutation(spark, table, order, left, moving, work)
        for r in _joined(gather(perm, table, work), table.folder, "bucket", buckets + 2, order[0]):
            final[r["file"]] = r["path"], r["n"], r["sha"], True
    if stays:
        key = order[0]

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_sha_of_keys(p, key) for p in batch.column(1).to_pylist()], pa.string())], ["bucket", "sha"])

        there = spark.createDataFrame([(b, table.files[f][0]) for f, b in stays.items()], "bucket int, path string")
        sha = {r["bucket"]: r["sha"] for r in there.repartitionById(buckets + 2, F.col("bucket")).mapInArrow(digests, "bucket int, sha string").collect()}
        for f, b in stays.items():
            final[b] = table.files[f][0], table.files[f][1], sha[b], False
    for f in moving:
        files, path = _files(table.files[f][0])
        files.delete_file(path)
    names = ",".join(table.schema.names)
    return [(name, _plain(path), names, sha, info[b]["sha"], b, n, joined.get(b, 0), new) for b, (path, n, sha, new) in sorted(final.items())]


def co_bucket(left: DataFrame, right: DataFrame, key: str, bucket: Callable[[Column], Column], buckets: int, starts: dict[str, Column], folder: str) -> DataFrame:
    """Write both tables as numbered files, then rewrite them by bucket of the key; one row per final file.

    ``starts`` names the two tables, left first, with the numbers of their starting
    files; ``bucket`` gives the bucket of a key that the left table holds.
    """
    spark = left.sparkSession
    work = f"{folder}/_work"
    (left_name, left_start), (right_name, right_start) = starts.items()
    order = lambda df: [key, *[c for c in df.columns if c != key]]
    a = write_numbered(left, left_start, order(left), f"{folder}/{left_name}", "start", buckets + 2)
    b = write_numbered(right, right_start, order(right), f"{folder}/{right_name}", "start", buckets + 2)

    none = spark.createDataFrame([], "g struct<k0: long>, n long, tied boolean, k0 long")
    keys = lambda t, df: _read(spark, t, order(df), 1, list(t.files)).groupBy(_group(1).alias("g")).agg(*_tied()).withColumn("k0", F.col("g.k0")) if t.files else none
    own, other = keys(a, left), keys(b, right)
    place = lambda held: F.when(F.col("k0").isNull(), buckets + 1).when(held, bucket(F.col("k0"))).otherwise(buckets).cast("int").alias("bucket")
    matched = _kept(other.join(own.select("k0", F.col("n").alias("lefts")), "k0", "left").select("g", "n", "tied", "lefts", place(F.col("lefts").isNotNull())), work, "keys")
    # at most buckets + 2 rows
    joined = {r["bucket"]: r["x"] for r in matched.where("lefts is not null").groupBy("bucket").agg(F.sum(F.col("n") * F.col("lefts")).alias("x")).collect()}
    rows = _rewrite(spark, left_name, a, order(left), own.select("g", "n", "tied", place(F.lit(True))), buckets, work, joined)
    rows += _rewrite(spark, right_name, b, order(right), matched.select("g", "n", "tied", "bucket"), buckets, work, joined)
    files, path = _files(work)
    files.delete_dir(path)
    return spark.createDataFrame(rows, "table_name string, path string, columns string, ids_sha256 string, lineage_sha256 string, bucket int, n_rows long, n_joined long, rewritten boolean").withColumn("bucket", F.col("bucket").cast("long"))


def new_folder(spark: SparkSession, name: str = "co-bucketed") -> str:
    """A new folder of the shared one, as a URI; a path without a scheme is one of the default file system."""
    folder = shared_path(spark, name)
    if "://" not in folder:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
        folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file:///") else folder
    return folder
