"""Training order: the same slots from any split, refusals, and runs that broke."""

import random
import zlib

import pytest

from hedgerow.llm import queries, train_order

RANKS = queries.vocabulary(queries.BYTE_RANKS)
SHAPE = {"stride": 8, "per_shard": 16, "pad": 50256}


@pytest.fixture(scope="module")
def folder_of_parts(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(i if i % 17 else None, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    rows += [(5, "a copy of a row"), (5, "a copy of a row"), (5, "the same id"), (None, None), (7, "")]
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    return path


def write(docs, folder, key=3):
    return train_order.write_training_order(docs, RANKS, str(folder), key, **SHAPE).collect()


def content(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if p.suffix == ".bin"}


def test_slots_do_not_depend_on_splits(spark, folder_of_parts):
    def slots(docs):
        rows = train_order.ordered_sequences(train_order.token_table(docs, RANKS, stride=8), 3, **SHAPE).collect()
        return sorted((r.slot, str(r.doc_id), r.seq, bytes(r.record)) for r in rows)

    first = slots(spark.read.parquet(folder_of_parts))
    assert [s for s, *_ in first] == list(range(len(first)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        assert slots(spark.read.parquet(folder_of_parts)) == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert slots(spark.read.parquet(folder_of_parts).coalesce(1)) == first
    assert slots(spark.read.parquet(folder_of_parts).repartition(9)) == first


def test_a_broken_run_ends_like_an_unbroken_one(spark, folder_of_parts, tmp_path):
    docs = spark.read.parquet(folder_of_parts)
    whole = write(docs, tmp_path / "whole")
    assert all(r.written for r in whole) and len(whole) > 8
    write(docs, tmp_path / "broken")
    for k in (1, 4, 5):
        (tmp_path / "broken" / f"shard-{k:08d}.bin").unlink()
    (tmp_path / "broken" / "shard-00000002.bin").write_bytes(b"damaged")
    (tmp_path / "broken" / ".shard-4-half").write_bytes(b"half")
    again = write(docs.repartition(3), tmp_path / "broken")
    assert sorted(r.shard for r in again if r.written) == [1, 2, 4, 5]
    assert content(tmp_path / "broken") == content(tmp_path / "whole") and not (tmp_path / "broken" / ".shard-4-half").exists()


def test_other_orders_are_refused(spark, folder_of_parts, tmp_path):
    docs = spark.read.parquet(folder_of_parts)
    write(docs, tmp_path / "out")
    before = content(tmp_path / "out")
    with pytest.raises(ValueError, match="key"):
        write(docs, tmp_path / "out", key=4)
    with pytest.raises(ValueError, match="rows"):
        write(docs.where("doc_id <> 9 or doc_id is null"), tmp_path / "out")
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "shard-00000000.bin").write_bytes(b"x")
    with pytest.raises(ValueError, match="manifest"):
        write(docs, tmp_path / "bare")
    assert content(tmp_path / "out") == before


def test_an_empty_table_has_no_shard(spark, folder_of_parts, tmp_path):
    assert write(spark.read.parquet(folder_of_parts).limit(0), tmp_path / "none") == []
    assert list(train_order.read_slots(str(tmp_path / "none"), 0, 5)) == []


def test_tasks_do_not_grow_with_shards():
    assert [train_order.range_partitions(s, 200) for s in (1, 150, 200, 10_000, 6_000_000)] == [1, 150, 200, 200, 93_750]


def test_several_shards_a_task(spark, folder_of_parts, tmp_path):
    """More shards than shuffle partitions: a task writes consecutive ones, and the bytes are the same."""
    docs = spark.read.parquet(folder_of_parts)
    few = write(docs, tmp_path / "few")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        assert len(few) > 8 and write(docs, tmp_path / "each") and content(tmp_path / "each") == content(tmp_path / "few")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = train_order.ordered_sequences(train_order.token_table(docs, RANKS, stride=8), 3, **SHAPE)
    assert rows.rdd.getNumPartitions() == int(before)


def test_a_local_path_is_refused_on_a_cluster(spark, folder_of_parts, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="each executor's own"):
        write(spark.read.parquet(folder_of_parts), "/tmp/nowhere")


def test_the_query_writes_its_shards(spark, monkeypatch):
    made = []

    def folder(*args):
        made.append(new_folder(*args))
        return made[-1]

    new_folder = queries.cobucket.new_folder
    monkeypatch.setattr(queries.cobucket, "new_folder", folder)
    rows = sorted(queries.op7_training_order(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.slot)
    records = list(train_order.read_slots(made[0], 0, len(rows) + 1))
    assert [r.slot for r in rows] == list(range(len(records))) and len(rows) > 200
    for r, record in zip(rows, records, strict=True):
        assert r.record_crc32 == zlib.crc32(record.tobytes()) and (r.shard, r.byte_offset) == (r.slot // train_order.PER_SHARD, r.slot % train_order.PER_SHARD * 1024)
    plain = train_order.ordered_sequences(train_order.token_table(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), queries.vocabulary(queries.BYTE_RANKS)), key=20240229, pad=50256)
    assert sorted((r.slot, r.doc_id, r.seq, r.n_tokens) for r in plain.collect()) == [(r.slot, r.doc_id, r.seq, r.n_tokens) for r in rows]


def test_passes_shuffle_only_their_own_shards(spark, folder_of_parts, tmp_path, monkeypatch):
    """The disk holds the shuffle of a pass, not of the table: each pass asks for its own shards, and gives its shuffle back."""
    asked, on = [], []
    plain, name = train_order.ordered_sequences, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def noted(tokens, key, stride, per_shard, pad, placed, only):
        asked.append(only)
        on.append(spark.conf.get(name))
        rows = plain(tokens, key, stride, per_shard, pad, placed, only)
        assert {r.shard for r in rows.select("shard").distinct().collect()} == set(range(*only))
        return rows

    monkeypatch.setattr(train_order, "ordered_sequences", noted)
    before = spark.conf.get(name)
    found = write(spark.read.parquet(folder_of_parts), tmp_path / "out")
    assert len(asked) == train_order.PASSES and [a for a, _ in asked] == [0, *[b for _, b in asked[:-1]]] and asked[-1][1] == len(found)
    assert set(on) == {"true"} and spark.conf.get(name) == before
    assert sorted(r.shard for r in found) == list(range(len(found)))
