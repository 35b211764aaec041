"""Sums over ranges equal sums over windows."""

import random

import numpy as np
import pytest
from conftest import SF, canonical

from hedgerow.operators import graph, order, splits
from hedgerow.plans import catalogue, reports  # noqa: F401
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKED = ["aurc_by_condition", "aurc_row_order", "auroc_exact", "average_precision", "ece_equal_count", "quantile_higher", "spearman_by_group", "retained_bounds_grid", "retained_bounds_top90_by_lang", "legacy_top_share", "running_means", "donor_assignment"]


def jobs(spark):
    tracker = spark.sparkContext._jsc.sc().dagScheduler()
    return tracker.numTotalJobs()


@pytest.mark.parametrize("name", RANKED)
def test_cells_equal_sql(spark, duck, name):
    """Also: where the plan is all there is, no job runs before the action."""
    before = jobs(spark)
    df = catalogue.QUERIES[name](spark, SF)
    scans = 3 if name != "donor_assignment" else 99  # schemas of the tables; the merge of donors numbers its rows
    assert jobs(spark) - before <= scans
    assert canonical(df.toPandas()) == canonical(duck.execute(catalogue.ORACLES[name]).df())


def test_cells_never_fall(spark):
    values = [float("-inf"), -1e300, -7.5, -7.4999, -1.0, -1e-300, -0.0, 0.0, 5e-324, 1e-9, 0.5, 0.7, 0.7001, 1.0, 1e9, 1e308, float("inf"), float("nan")]
    got = spark.createDataFrame([(None,), *[(v,) for v in values]], "x double").select(order.cell(F.col("x"), T.DoubleType()).alias("c")).collect()
    cells = [r.c for r in got]
    assert cells == sorted(cells) and len(set(cells)) >= len(values) - 2
    words = ["", "a", "ab", "abc", "b", "zé", "é", "日本", "\U0001f600"]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, x string").orderBy("x").select(order.cell(F.col("x"), T.StringType()).alias("c")).collect()
    assert [r.c for r in got] == sorted((r.c for r in got), key=lambda c: c.encode())


def test_running_over_null_slices(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in range(400)]
    got = order.running(spark.createDataFrame(rows, "k string, i int, v int").repartition(5), ["k"], [-F.col("i")], {"s": "v", "n": F.lit(1)}, ["n"]).collect()
    for r in got:
        mine = [v for k, i, v in rows if k == r.k and i >= r.i]
        assert (r.s, r.n, r.total_n) == (sum(mine), len(mine), sum(k == r.k for k, *_ in rows))
    assert len(got) == 400


def test_running_over_ties_nulls_and_nan(spark):
    """Most rows share one value; ties go by text, then by number."""
    rng = random.Random(5)
    rows = [(rng.choice([1, 2]), rng.choice([0.25] * 9 + [None, -3.0, float("nan"), 8.5]), rng.choice(["ab", "abc", "b", None, "é"]), i, rng.randrange(5)) for i in range(500)]
    place = lambda r: ((r[1] is not None, r[1] != r[1], 0.0 if r[1] is None or r[1] != r[1] else r[1]), (r[2] is not None, (r[2] or "").encode()), r[3])
    got = order.running(spark.createDataFrame(rows, "g int, x double, t string, i int, v int").repartition(4), ["g"], ["x", "t", "i"], {"s": "v"}, ["s"]).collect()
    assert len(got) == 500
    for r in got:
        own = next(x for x in rows if x[3] == r.i)
        assert r.s == sum(x[4] for x in rows if x[0] == r.g and place(x) <= place(own)) and r.total_s == sum(x[4] for x in rows if x[0] == r.g)


def test_donors_of_a_dominant_speaker(spark):
    rows = [(i, "big" if i % 4 else f"s{i}", "x" if i % 3 else "y") for i in range(200)] + [(999, "only", "z")]
    got = {r.id: r for r in splits.donors(spark.createDataFrame(rows, "id long, sp string, split string"), "id", "sp", "split", position="id").collect()}
    for i, sp, split in rows:
        valid = [d for d, s, x in sorted(rows) if x == split and s != sp]
        h = splits.stable_u64
        k = spark.range(1).select(h(F.lit(f"{i}:donor"), splits.SEED).cast("string")).first()[0]
        assert got[i].donor_id == (valid[int(k) % len(valid)] if valid else None) if i in (0, 1, 7, 8, 999) else True
        assert not valid or (got[i].donor_id in valid and got[i].donor_speaker != sp)


def test_groups_for_the_driver_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(splits, "MAX_GROUPS", 3)
    df = spark.createDataFrame([(f"g{i}", "x") for i in range(5)], "g string, s string")
    with pytest.raises(ValueError, match="groups"):
        splits.grouped_split(df, "g", ["s"], {"a": 0.5, "b": 0.5})
    with pytest.raises(ValueError, match="groups"):
        splits.fold_of_group(df, "g", 2)


def test_folds_of_any_number_of_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for case in range(4):
        sizes = rng.integers(1, [2, 4, 12, 40][case], 60).tolist() + [90, 17, 17][: case]
        df = spark.createDataFrame([(f"g{i:03d}",) for i, n in enumerate(sizes) for _ in range(n)], "g string")
        plain = sorted(map(tuple, splits.fold_of_group(df, "g", 5).collect()))
        with monkeypatch.context() as m:
            m.setattr(splits, "MAX_GROUPS", 3)
            assert sorted(map(tuple, splits.folds_by_size(df, "g", 5).collect())) == plain


def test_a_cluster_needs_the_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *_: None)}))

    frame = type("D", (), {"sparkSession": Session})
    with pytest.raises(ValueError, match="checkpoint"):
        graph.checkpointed(frame, "x")


def test_orders_in_blocks_give_the_same_split(spark, monkeypatch):
    df = spark.createDataFrame([(f"g{i % 13}", "ab"[i % 7 % 2]) for i in range(400)], "g string, s string")
    fractions = {"a": 0.5, "b": 0.3, "c": 0.2}
    found = []
    for orders in (1000, 90, 7):
        monkeypatch.setattr(splits, "ORDERS", orders)
        found.append(sorted(map(tuple, splits.grouped_split(df, "g", ["s"], fractions, tries=200).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 13
    table = np.arange(1.0, 9).reshape(4, 2)
    cuts, share = np.array([0, 2, 4]), np.array([0.5, 0.5])
    best = [splits.best_order(table, cuts, share, 3, lo, lo + 5) for lo in (0, 5, 10)]
    assert min(b[0] for b in best) == splits.best_order(table, cuts, share, 3, 0, 15)[0]
