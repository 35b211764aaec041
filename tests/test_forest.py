"""Trees grown level by level over a table equal those grown from a matrix, and a plain recursive version."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgerow.functions import text
from hedgerow.operators import forest


def data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 4)).round(2)
    x[:, 3] = 1.0  # a constant is never cut
    y = (x[:, 0] + 0.3 * rng.normal(0, 1, n) > 0.2).astype(np.int64)
    return x, y


def recursive(x, y, weight, seed, tree, leaf, share, path=1):
    """(feature, cut, left, right) or the value, straight from the definition."""
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    mean = float(n[1] * weight[1] / (n * weight).sum())
    if n.sum() < 2 * leaf or n.min() == 0:
        return mean
    rng = np.random.default_rng([seed, tree, path])
    lo, hi = x.min(0), x.max(0)
    features = rng.permutation([f for f in range(x.shape[1]) if hi[f] > lo[f]])[: max(1, int(share * x.shape[1]))]
    cuts, best = rng.uniform(lo[features], hi[features]), None
    for f, c in zip(features, cuts, strict=True):
        left = x[:, f] <= c
        if leaf <= left.sum() <= len(x) - leaf:
            cost = 0.0
            for side in (left, ~left):
                t = (weight[y[side]]).sum()
                p = weight[1] * (y[side] == 1).sum() / t
                cost += t * p * (1 - p)
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, c, left
    if best is None:
        return mean
    _, f, c, left = best
    return (int(f), float(c), recursive(x[left], y[left], weight, seed, tree, leaf, share, 2 * path), recursive(x[~left], y[~left], weight, seed, tree, leaf, share, 2 * path + 1))


def nested(nodes, at=0):
    f, c, left, right, v = nodes[at]
    return v if f < 0 else (f, c, nested(nodes, left), nested(nodes, right))


@pytest.mark.parametrize("leaf", [5, 20, 400])
def test_a_tree_is_what_its_draws_say(leaf):
    x, y = data()
    weight = np.array([0.8, 1.3])
    for tree in range(3):
        assert str(nested(forest.grow(x, y, weight, 9, tree, leaf, 0.7))) == str(recursive(x, y, weight, 9, tree, leaf, 0.7))


@pytest.mark.parametrize("at_a_time", [16, 2])
def test_both_ways_give_the_same_trees(spark, monkeypatch, at_a_time):
    monkeypatch.setattr(forest, "TREES_AT_A_TIME", at_a_time)
    x, y = data(400)
    rows = [(row.tolist(), int(label) if i % 10 else None) for i, (row, label) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "features_array array<double>, y int").repartition(5)
    near = forest.fit_forest(df, trees=5, leaf=10, seed=4)
    far = forest.fit_forest(df, trees=5, leaf=10, seed=4, most_rows=0)
    assert near.trees == far.trees and max(len(t) for t in near.trees) > 5
    assert forest.fit_forest(df.orderBy(F.rand(3)), trees=5, leaf=10, seed=4).trees == near.trees
    got = df.where("y is not null").select("y", far.score(df).alias("s")).toPandas()
    assert got[got.y == 1].s.mean() > got[got.y == 0].s.mean() + 0.25


def test_nodes_of_few_rows_are_grown_by_one_task_each(spark):
    x, y = data(400)
    df = spark.createDataFrame([(row.tolist(), int(label)) for row, label in zip(x, y, strict=True)], "features_array array<double>, y int").repartition(5)
    near = forest.fit_forest(df, trees=5, leaf=10, seed=4)
    for most in (399, 150, 40):
        assert forest.fit_forest(df, trees=5, leaf=10, seed=4, most_rows=most).trees == near.trees


def test_a_forest_is_sent_and_saved_packed(spark, tmp_path):
    x, y = data(3000)
    df = spark.createDataFrame([(row.tolist(), int(label)) for row, label in zip(x, y, strict=True)], "features_array array<double>, y int")
    made = forest.fit_forest(df, trees=3, leaf=2, seed=4)
    nodes = sum(map(len, made.packed))
    assert nodes > 500 and len(pickle.dumps(made.packed)) < 16 * nodes + 2000
    made.save(spark, f"file://{tmp_path}/trees")
    again = forest.Forest.load(spark, f"file://{tmp_path}/trees")
    assert again.trees == made.trees and again.digest() == made.digest()

    def plain(nodes, row):
        at = 0
        while nodes[at][0] >= 0:
            at = nodes[at][2] if row[nodes[at][0]] <= nodes[at][1] else nodes[at][3]
        return nodes[at][4]

    got = [r.s for r in df.select(again.score(df).alias("s")).collect()]
    trees = again.trees
    assert got == [float(np.mean([plain(t, row) for t in trees])) for row in x]


def test_one_class_and_few_rows(spark):
    one = spark.createDataFrame([([float(i)], 1) for i in range(50)], "features_array array<double>, y int")
    for most in (0, 1000):
        assert forest.fit_forest(one, trees=2, most_rows=most).trees == [[(-1, 0.0, -1, -1, 1.0)]] * 2
    with pytest.raises(ValueError, match="labels"):
        forest.fit_forest(one.limit(0))


def test_many_different_tokens(spark):
    """43,000 different tokens of a pair: the codes pass over the surrogates."""
    many = F.transform(F.sequence(F.lit(0), F.lit(42_999)), lambda i: F.concat(F.lit("v"), i.cast("string")))
    few = F.array(F.lit("v42990"), F.lit("new"), F.lit("v42999"))
    df = spark.range(1).select(many.alias("a"), few.alias("b"))
    assert df.select(text.token_distance("a", "b").alias("d")).first().d == 42_998  # two tokens are kept, one is exchanged, the others go
    small = spark.createDataFrame([(["x"] * 2, ["y", "x"], 1), ([], ["q"], 1), (["a", "b", "c"], ["b", "c", "d"], 2)], "a array<string>, b array<string>, d int")
    assert all(r.got == r.d for r in small.select("d", text.token_distance("a", "b").alias("got")).collect())
