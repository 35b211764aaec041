"""Registered queries that once did less than their operators' whole job."""

import pytest

from hedgerow.functions import labels
from hedgerow.operators import heads, resample, splits
from hedgerow.plans import catalogue

from conftest import SF


@pytest.mark.parametrize(("module", "name", "query", "option"), [(splits, "grouped_split", "group_split", "tries"), (heads, "fit_forest", "forest_scores", "trees")])
def test_queries_run_the_whole_search(spark, monkeypatch, module, name, query, option):
    class Called(Exception):
        pass

    def called(*args, **options):
        raise Called(options.get(option))

    monkeypatch.setattr(module, name, called)
    with pytest.raises(Called) as e:
        catalogue.QUERIES[query](spark, SF)
    assert e.value.args == (None,)


def test_too_many_clusters_are_refused(spark, monkeypatch):
    monkeypatch.setattr(resample, "MAX_CLUSTERS", 2, raising=False)
    with pytest.raises(ValueError, match="hash_draws"):
        catalogue.QUERIES["cluster_bootstrap_numpy_draws"](spark, SF)


def test_label_fact_runs_over_all_turns(spark):
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    pairs = c.join(c.selectExpr("conv_id", "turn - 1 as turn"), ["conv_id", "turn"]).count()
    got = catalogue.QUERIES["label_fact"](spark, SF)
    assert got.count() == pairs > 6 and {"conv_id", "turn"} <= set(got.columns)


def test_label_fact_of_literals(spark):
    rows = [
        ("a", "There are 30 cats and 20 dogs.", '"20"', '"30"', "number", "There are 20 cats and 30 dogs."),
        ("b", "", '"3"', None, "number", "Three cats arrived."),
        ("c", "Three cats and four cats.", '"3"', None, "number", "Three cats arrived."),
        ("d", "3.5 liters", '"3.5"', None, "number", "3.5 liters"),
        ("e", "1/2 liter", '"1/2"', None, "number", "1/2 liter"),
        ("f", "He did not come.", '"no"', None, "negation", "He came."),
    ]
    df = spark.createDataFrame(rows, "id string, translation string, expected string, contrast string, kind string, reference string")
    got = df.select("id", labels.label_fact("translation", "expected", "contrast", "kind", "reference").alias("l")).select("id", "l.*").collect()
    assert sorted(r.id for r in got) == list("abcdef") and {r.id: r.y for r in got}["d"] == 0
