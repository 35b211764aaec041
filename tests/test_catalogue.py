import pytest

from conftest import SF, canonical

import __spark_entry__ as entry
from hedgerow.plans import catalogue, experiments, models, reports, streams  # noqa: F401  (the others add their queries to the catalogue)

WITH_SQL = sorted(catalogue.ORACLES)
WITHOUT = sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES))


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", WITHOUT)
def test_query_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registered_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert ("pipeline" in entry.queries()) == (entry._present("corpus_pipeline") and entry._present("hedgerow.llm.queries"))
