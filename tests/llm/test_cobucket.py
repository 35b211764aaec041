"""Co-bucketed tables against a plain rewrite of the same rows, and their defined cases."""

import glob
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hedgerow.llm import cobucket, queries

SF = "/root/testdata/sf0.001"
BUCKETS = 300


def total_order(row):
    return tuple((x is not None, (x.encode() if isinstance(x, str) else x) if x is not None else 0) for x in row)


def crc(prefix, x):
    return zlib.crc32(f"{prefix}{x}".encode()) % BUCKETS


def start_of(table, row, names):
    if table == "sales":
        b = BUCKETS + 1 if row[0] is None else crc("line", row[0])
        return b - 1 if b % 3 == 1 else b
    item = row[names.index("item_id")]
    return 0 if item is None else crc("", item)


def plain(sales, lines, sales_names, lines_names):
    """(table, bucket) -> what the file must hold."""
    held = Counter(r[0] for r in sales if r[0] is not None)
    place = lambda k: BUCKETS + 1 if k is None else crc("line", k) if k in held else BUCKETS
    joined = Counter()
    for r in lines:
        if r[0] in held:
            joined[place(r[0])] += held[r[0]]
    out = {}
    for table, rows, names in (("sales", sales, sales_names), ("sale_lines", lines, lines_names)):
        files, starts = defaultdict(list), defaultdict(list)
        for r in rows:
            files[place(r[0])].append(r)
            starts[start_of(table, r, names)].append(r)
        for b, mine in files.items():
            mine.sort(key=total_order)
            lineage = sorted(Counter(start_of(table, r, names) for r in mine).items())
            out[table, b] = dict(
                rows=mine, columns=",".join(names), n_rows=len(mine), n_joined=joined[b],
                ids_sha256=hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in mine).encode()).hexdigest(),
                lineage_sha256=hashlib.sha256(",".join(f"{s}:{n}" for s, n in lineage).encode()).hexdigest(),
                rewritten=not any(len(starts[s]) == len(mine) == n for s, n in lineage),
            )
    return out


def compare(got, want):
    assert {(r.table_name, r.bucket) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        w = want[r.table_name, r.bucket]
        for c in ("columns", "n_rows", "n_joined", "ids_sha256", "lineage_sha256", "rewritten"):
            assert r[c] == w[c], (r.table_name, r.bucket, c)
        table = pq.read_table(r.path)
        assert table.column_names == w["columns"].split(",")
        assert [total_order(x.values()) for x in table.to_pylist()] == [total_order(x) for x in w["rows"]]


def only_final(got):
    top = os.path.dirname(os.path.dirname(got[0].path))
    left = {os.path.relpath(f, top) for d, _, names in os.walk(top) for f in (os.path.join(d, n) for n in names)}
    assert left == {os.path.relpath(r.path, top) for r in got}


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_query_against_a_plain_rewrite(spark):
    sales, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("sales", "sale_lines"))
    got = queries.op11_late_materialisation(spark, SF).collect()
    compare(got, plain(tuples(sales), tuples(lines), sales.columns, lines.columns))
    only_final(got)
    assert {r.rewritten for r in got} == {True, False}


SALES = "sale_id long, row string, file int"
LINES = "sale_id long, item_id long, part string, k0 double, at int"


def run(spark, sales, lines, name):
    bucket = lambda key: F.crc32(F.concat(F.lit("line"), key.cast("string")).cast("binary")) % BUCKETS
    b = F.coalesce(bucket(F.col("sale_id")), F.lit(BUCKETS + 1))
    starts = {"sales": F.when(b % 3 == 1, b - 1).otherwise(b), "sale_lines": F.coalesce(F.crc32(F.col("item_id").cast("string").cast("binary")) % BUCKETS, F.lit(0))}
    return cobucket.co_bucket(sales, lines, "sale_id", bucket, BUCKETS, starts, cobucket.new_folder(spark)).collect()


def test_ties_nulls_repeats_and_clashing_names(spark):
    """A key with most rows, ties that only later columns break, equal rows, nulls everywhere, text in byte order."""
    sales = [(i, f"s{i % 3}", i) for i in range(40)] + [(7, "twice", 1), (7, "twice", 1), (None, None, None), (None, "z", 2)]
    lines = [(7, i % 4 or None, "é" if i % 3 else "z" if i % 2 else None, float(i % 2) if i % 5 else None, i % 3) for i in range(900)]
    lines += [(i % 50, i % 7, "\U0001f600" if i % 2 else "￿", -1.5, None) for i in range(200)] + [(None, None, None, None, None)] * 3 + [(None, 1, "a", 0.5, 1), (10**12, 2, "b", 1.0, 2)]
    a, b = spark.createDataFrame(sales, SALES).repartition(3), spark.createDataFrame(lines, LINES).repartition(5)
    got = run(spark, a, b, "ties")
    compare(got, plain(sales, lines, a.columns, b.columns))
    only_final(got)
    assert {r.bucket for r in got} >= {BUCKETS, BUCKETS + 1}


@pytest.mark.parametrize("empty", ["sales", "lines", "both"])
def test_empty_tables(spark, empty):
    sales = [] if empty != "lines" else [(1, "a", 1), (2, "b", 2)]
    lines = [] if empty != "sales" else [(1, 2, "x", 1.0, 1), (None, None, None, None, None)]
    got = run(spark, spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), empty)
    if got:
        compare(got, plain(sales, lines, SALES.replace(",", "").split()[::2], LINES.replace(",", "").split()[::2]))
    assert bool(got) == (empty != "both")


def test_one_key_over_many_ranges_and_row_groups(spark, monkeypatch):
    """One sale and one item with most rows: the bucket's pieces of many ranges are strung together."""
    monkeypatch.setattr(cobucket, "PART_ROWS", 20_000)
    lines = spark.range(160_000).select(F.when(F.col("id") % 10 < 8, 5).otherwise(F.col("id") % 300).alias("sale_id"), F.when(F.col("id") % 4 < 3, 9).otherwise(F.col("id") % 6).alias("item_id"), F.md5(F.col("id").cast("string")).alias("part"), (F.col("id") % 7).cast("double").alias("k0"), (F.col("id") % 5).cast("int").alias("at")).repartition(4)
    sales = spark.range(200).select(F.col("id").alias("sale_id"), F.lit("x").alias("row"), F.lit(1).alias("file"))
    got = run(spark, sales, lines, "hot")
    compare(got, plain(tuples(sales), tuples(lines), sales.columns, lines.columns))
    big = max(got, key=lambda r: r.n_rows)
    assert big.n_rows > 2 * cobucket.GROUP_ROWS - 20_000 and pq.ParquetFile(big.path).num_row_groups > 1


def test_a_second_attempt_changes_nothing(spark, tmp_path):
    """Joining pieces again, as after a lost executor, finds the files that the first attempt has moved."""
    folder = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(i, f"r{i}") for i in range(50)], "sale_id long, x string")
    table = cobucket.write_numbered(df, F.col("sale_id") % 4, ["sale_id", "x"], folder, "start", 4)
    before = {f: pq.read_table(f).to_pylist() for f in glob.glob(f"{tmp_path}/t/*.parquet")}
    pieces = spark.createDataFrame([(f, 0, f"{folder}/gone-{f}.parquet", n) for f, (_, n) in table.files.items()], "file int, part int, path string, n long")
    again = cobucket._joined(pieces, folder, "start", 4)
    assert {(r.file, r.n) for r in again} == {(f, n) for f, (_, n) in table.files.items()}
    assert before == {f: pq.read_table(f).to_pylist() for f in glob.glob(f"{tmp_path}/t/*.parquet")} and len(before) == 4


def test_a_folder_without_a_scheme(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cobucket, "shared_path", lambda *_: f"{tmp_path}/plain")
    assert cobucket.new_folder(spark) == f"file://{tmp_path}/plain"
    monkeypatch.setattr(cobucket, "shared_path", lambda *_: "hdfs://host/x")
    assert cobucket.new_folder(spark) == "hdfs://host/x"
