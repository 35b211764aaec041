"""Whitening against plain numpy, and its defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgerow.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(vectors, components=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    exact = [[n * int(a) - int(b) for a, b in zip(row, s, strict=True)] for row in x]
    c = np.array(exact, np.float64) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, (e > e[0] * 1e-12).sum())
    return n, [sum(a * a for a in row) for row in exact], c @ q[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def test_query_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    good = [r for r in rows if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    n, deviation, white, explained = brute([r.embedding for r in good])
    got = queries.op13_gramian_whitening(spark, SF).collect()
    assert len(got) == n * 32 and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 33))
    place = {r.vec_id: i for i, r in enumerate(good)}
    full = np.zeros((n, 32))
    for r in got:
        assert r.deviation == deviation[place[r.vec_id]]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        full[place[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((full * white).sum(0))
    assert np.abs(full * sign - white).max() < 1e-6
    cov = full.T @ full / n
    assert np.abs(cov - np.eye(32)).max() < 1e-9 and 0 <= got[0].identity_error < 1e-9


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [2.0, -1.0, 0.25], [0.5, 0.5, 4.0], [3.0, 1.0, 1.0], [3.0, 1.0, 1.0]]
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 0.0, 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [(None if i == 3 else i % 3, v, "x", 1.0) for i, v in enumerate(good + bad)]
    schema = "vec_id long, embedding array<float>, n string, v double"
    got = whitening.whiten(spark.createDataFrame(rows, schema).repartition(3)).collect()
    n, deviation, white, explained = brute(good)
    assert n == 5 and len(got) == 15 and sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    first = sorted(abs(r.whitened) for r in got if r.component == 1)
    assert np.allclose(first, sorted(abs(white[:, 0])))
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame(rows[:1] * 3, schema)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()


def test_exact_deviation():
    assert whitening._deviation(np.array([[3, 4], [2_000_000_000, 1_900_000_000]])).tolist() == [25, 2_000_000_000**2 + 1_900_000_000**2]
    with pytest.raises(ValueError):
        whitening._deviation(np.array([[1 << 32, 0]]))


def test_components_are_bounded_by_the_parameter(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), float(i % 3)]) for i in range(60)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(rows, components=2).select("component").distinct().collect()} == {1, 2}
    assert whitening.whiten(rows).agg(F.max("identity_error")).first()[0] < 1e-9
