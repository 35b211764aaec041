"""Areas of all replicates at once against repeated rows, and against the path for draws that are too many to broadcast."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgerow.operators import metrics, replicates, resample


def expected_ties(rows):
    """Area of (score, y) rows by its definition: each tied row has the mean of its group."""
    out, errors, n = 0.0, 0.0, 0
    for s in sorted({s for s, _ in rows}):
        tied = [y for t, y in rows if t == s]
        p = sum(tied) / len(tied)
        for _ in tied:
            errors, n = errors + p, n + 1
            out += errors / n
    return out / len(rows)


def some_rows(n, seed=1, null_cluster=True):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "e", *([None] if null_cluster else [])]
    return [(rng.choice(["x", "y"]), rng.choice(names), rng.choice([0, 1, 1, None]), rng.choice([0.5, 0.5, 1.5, -2.0, rng.random()]), i) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "method string, cluster string, y int, score double, pos int").repartition(5)


def test_harmonic():
    n = np.array([0, 1, 2, 3, 1022, 1023, 1024, 5000])
    assert np.allclose(replicates.harmonic(n), [sum(1 / i for i in range(1, k + 1)) for k in n], atol=1e-12)


def test_many_rows_take_a_few_megabytes():
    rng = np.random.default_rng(3)
    n, w = 10_000, replicates.Weights(2000, rng.poisson(1, (80, 2000)).astype(np.uint16))
    m, e, cluster = np.ones(n), rng.integers(0, 2, n).astype(float), rng.integers(0, 80, n)
    tracemalloc.start()
    try:
        total = replicates.areas(np.arange(n), m, e, cluster, np.zeros((2, 2000)), w)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16e6
    weight = w.matrix[cluster, 7].astype(int)
    p = np.repeat(e, weight)
    assert total[7] == pytest.approx((np.cumsum(p) / np.arange(1, len(p) + 1)).sum())


@pytest.mark.parametrize("cells", [replicates.CELLS, 5])
def test_areas_in_blocks(monkeypatch, cells):
    """Groups of tied rows, in two steps and in blocks of few replicates."""
    monkeypatch.setattr(replicates, "CELLS", cells)
    rng = np.random.default_rng(2)
    w = replicates.Weights(7, rng.integers(0, 3, (4, 7)).astype(np.uint16))
    score, cluster, y = np.sort(rng.integers(0, 9, 40)), rng.integers(0, 4, 40), rng.integers(0, 2, 40).astype(float)
    before, total, m = np.zeros((2, 7)), np.zeros(7), np.ones(40)
    cut = int(np.searchsorted(score, 4))
    for part in (slice(0, cut), slice(cut, 40)):
        first = np.flatnonzero(np.concatenate([[True], np.diff(score[part]) != 0]))
        total += replicates.areas(first, m[part], y[part], cluster[part], before, w)
    assert np.allclose(np.stack(replicates.add_up(m, y, cluster, w)), before)
    for b in range(7):
        rows = [(s, v) for s, c, v in zip(score, cluster, y, strict=True) for _ in range(w.matrix[c, b])]
        assert total[b] / before[0, b] == pytest.approx(expected_ties(rows))


@pytest.mark.parametrize("most", [replicates.MAX_WEIGHTS, 0])
def test_bootstrap_against_repeated_rows(spark, monkeypatch, most):
    """With the matrix, and with weights joined to the sums where it would be too large."""
    monkeypatch.setattr(replicates, "MAX_WEIGHTS", most)
    rows = some_rows(600, null_cluster=False)
    draws = [(r.replicate, r.cluster, r.weight) for r in resample.hash_draws(spark.createDataFrame([(c,) for c in "abcde"], "cluster string"), 12).collect()]
    got = {(r.replicate, r.method): r.aurc for r in resample.bootstrap_aurc(frame(spark, rows), spark.createDataFrame(draws, "replicate int, cluster string, weight int")).collect()}
    assert len(got) == 24
    for b, method in got:
        weight = {c: w for k, c, w in draws if k == b}
        drawn = [(s, y) for m, c, y, s, _ in rows if m == method and y is not None for _ in range(weight.get(c, 0))]
        assert got[b, method] == pytest.approx(expected_ties(drawn), abs=1e-12)


@pytest.mark.parametrize("most", [replicates.MAX_WEIGHTS, 0])
def test_row_order_against_repeated_rows(spark, monkeypatch, most):
    monkeypatch.setattr(replicates, "MAX_WEIGHTS", most)
    rows = some_rows(150, 3, null_cluster=False)
    draws = spark.createDataFrame([(b, c, (b + i) % 3) for b in range(4) for i, c in enumerate("abcde") if (b + i) % 3], "replicate int, cluster string, weight int")
    got = {(r.replicate, r.method): r.aurc for r in resample.bootstrap_row_order(frame(spark, rows), draws, "pos").collect()}
    for b in range(4):
        for method in "xy":
            errors, n, total = 0, 0, 0.0
            for _, c, y, _, _ in sorted((r for r in rows if r[0] == method and r[2] is not None), key=lambda r: (r[3], r[4])):
                for _ in range((b + "abcde".index(c)) % 3):
                    errors, n = errors + y, n + 1
                    total += errors / n
            assert got[b, method] == pytest.approx(total / n)


def test_conditions_have_their_own_draws(spark):
    rows = [(f"k{i % 3}", *r) for i, r in enumerate(some_rows(500, 5, null_cluster=False))] + [(None, "x", "a", 1, 0.1, 900)]
    df = spark.createDataFrame(rows, "cond string, method string, cluster string, y int, score double, pos int")
    got = {r.condition: r for r in resample.by_condition(df, "cond", "cluster", 40, "x", "y").collect()}
    assert set(got) == {"k0", "k1", "k2"}
    for cond, r in got.items():
        alone = df.where(F.col("cond") == cond)
        per = resample.bootstrap_aurc(alone, resample.hash_draws(alone.select("cluster").distinct(), 40))
        want = resample.paired_interval(per, "method", "x", "y").first()
        assert (r.replicates, r.low, r.high) == (want.replicates, pytest.approx(want.low), pytest.approx(want.high))


def test_leave_one_out_with_a_null_cluster(spark):
    rows = some_rows(300, 7)
    got = {r.left_out: r.aurc for r in metrics.leave_one_out(frame(spark, rows), "cluster").collect()}
    assert set(got) == {"a", "b", "c", "d", "e", None}
    for c, x in got.items():
        assert x == pytest.approx(expected_ties([(s, y) for _, k, y, s, _ in rows if y is not None and k != c]))
    one = frame(spark, [r for r in rows if r[1] == "a"])
    assert metrics.leave_one_out(one, "cluster").count() == 0
    assert metrics.leave_one_out(one.limit(0), "cluster").count() == 0


def test_rows_are_not_multiplied_by_replicates(spark):
    """What is written and shuffled has a row for each sum, whatever the number of replicates."""
    rows = frame(spark, some_rows(400, 9, null_cluster=False))
    sums = rows.where("y is not null").groupBy("method", "cluster", "score").agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum(F.col("y").cast("double")).alias("e"))
    numbered = sums.withColumn("cluster", (F.ascii("cluster") - 97).cast("int"))
    out = replicates.replicate_areas(numbered, ["method"], ["score"], replicates.Weights(500, np.ones((5, 500), np.uint16)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    got = out.groupBy("method").agg(F.count_distinct(F.round("aurc", 12)).alias("n"), F.count(F.lit(1)).alias("all")).collect()
    assert all((r.n, r["all"]) == (1, 500) for r in got)


def test_draws_are_the_hashes(spark):
    from hedgerow.functions.hashing import stable_u64

    clusters = spark.createDataFrame([(f"c{i:02d}",) for i in range(37)], "cluster string")
    draws = resample.hash_draws(clusters, 20)
    slots = spark.range(37).withColumnRenamed("id", "draw").crossJoin(spark.range(20).withColumnRenamed("id", "b"))
    place = (stable_u64(F.concat_ws(":", "b", "draw"), resample.SEED) % F.lit(37).cast("decimal(20,0)")).cast("int")
    plain = slots.groupBy("b", place.alias("place")).count()
    assert sorted((r.b, f"c{r.place:02d}", r["count"]) for r in plain.collect()) == sorted((r.replicate, r.cluster, r.weight) for r in draws.collect())
    assert resample.hash_draws(clusters.limit(0), 3).count() == 0


def test_draws_are_not_broadcast(spark):
    plan = resample.hash_draws(spark.range(37).withColumnRenamed("id", "cluster"), 20)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [place" in plan and "BroadcastHashJoin [place" not in plan


@pytest.mark.parametrize("block", [1024, 4])
def test_sums_weighed_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    names = [None, *[f"c{i:02d}" for i in range(12)]]
    rows = [(names[i % 13], i * i - 50, i / 8, None if i % 3 else i) for i in range(60)]
    stats = spark.createDataFrame(rows, "cluster string, k int, x double, some long")
    columns = ["k", "x", "some"]
    got = resample.bootstrap_sums(stats, 25, columns)
    want = resample.bootstrap_sums(stats, resample.hash_draws(stats.select("cluster").distinct(), 25), columns)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.fillna(0).collect()) and got.count() == 25
    assert "Join [place" not in got._jdf.queryExecution().executedPlan().toString()
    assert resample.bootstrap_sums(stats.limit(0), 25, columns).count() == 0


def test_gram_counts(spark):
    from collections import Counter

    from hedgerow.functions.text import gram_counts

    for r, h in [("abcabca", "bcabx"), ("", "ab"), ("", ""), ("a\U0001F600b", "\U0001F600b"), ("aaaa", "aa"), ("x", "x")]:
        want = []
        for n in range(1, 7):
            a, b = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (r, h))
            want += [sum(b.values()), sum(a.values()), sum((a & b).values())]
        assert gram_counts(r, h, 6) == want
