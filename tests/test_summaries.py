import pytest
from pyspark.sql import functions as F

from hedgerow.operators import heads, summaries


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_seed_distribution(spark):
    df = spark.createDataFrame([("a", s, float(s)) for s in range(1, 6)] + [("b", 1, 2.0), ("b", 2, float("nan"))], "m string, seed int, v double")
    out = {r["m"]: r for r in summaries.seed_distribution(df, ["m"], "seed", "v").collect()}
    assert out["a"]["mean"] == 3 and abs(out["a"]["sd"] - 2.5**0.5) < 1e-12 and out["a"]["complete"]
    assert not out["b"]["complete"] and out["b"]["seeds"] == 1


def test_matched_needs_both_sides(spark):
    df = spark.createDataFrame([(1, "f", 3.0), (1, "c", 5.0), (2, "f", 1.0), (3, "x", 1.0)], "s int, m string, v double")
    assert rows(summaries.matched(df, ["s"], "m", "f", "c", "v")) == [(1, 3.0, 5.0, -2.0)]


def test_preselect_breaks_ties_by_name_and_ignores_null(spark):
    df = spark.createDataFrame([("x", "b", 1.0), ("x", "a", 1.0), ("x", "c", None), ("x", "d", 0.5)], "k string, m string, v double")
    assert rows(heads.preselect(df, ["k"], "m", "v", ["d"])) == [("x", "a", 1.0)]


def test_percentages_refuse_what_is_no_selection(spark):
    good = spark.createDataFrame([(10, 4, 1, 2), (10, 0, 0, 0)], "n long, k long, e long, u long")
    assert rows(summaries.percentages(good).select("lower_percent", "upper_percent", "width")) == [(25.0, 75.0, 50.0), (None, None, None)]
    with pytest.raises(Exception, match="no selection"):
        summaries.percentages(spark.createDataFrame([(10, 2, 2, 1)], "n long, k long, e long, u long")).collect()


def test_agreement_without_pairs_is_null(spark):
    df = spark.createDataFrame([("a", 1, 1, None), ("a", 0, 1, None)], "g string, auto int, first int, second int")
    assert rows(summaries.agreement(df, ["g"], "auto", "first", "second")) == [("a", 2, 0, 0.5, None, None)]


def test_historical_takes_the_first_reason_and_keeps_rows_once(spark):
    df = spark.createDataFrame([(1, "a", "t"), (2, "b", "t"), (3, "b", "u"), (4, None, None)], "id int, sp string, tx string")
    sp = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    tx = spark.createDataFrame([("t",), ("t",)], "y string")
    out = summaries.historical(df, [("speaker", "sp", sp), ("text", "tx", tx)])
    assert sorted(rows(out.select("id", "reason"))) == [(1, "speaker"), (2, "text"), (3, None), (4, None)]


def test_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, p int, v string")
    assert sorted(rows(summaries.last_per_key(df, ["k"], "p").select("k", "v", "first_position"))) == [("a", "z", 1), ("b", "y", 2)]


@pytest.mark.parametrize(("stride", "children"), [(1, 2), (3, 4), (5, 1)])
def test_resharded_lanes_stride(spark, stride, children):
    got = [r[0] for r in spark.range(40).orderBy("id").select(summaries.resharded("id", stride, children)).collect()]
    for parent in range(stride):
        lane = [i for i in range(40) if i % stride == parent]
        for s in range(children):
            assert [i for i in range(40) if got[i] == parent + s * stride] == lane[s::children]


def test_external_overlap(spark):
    a = spark.createDataFrame([("A b",), ("a  b",), ("c",), (None,)], "t string")
    b = spark.createDataFrame([("a b",), ("d",)], "t string")
    assert rows(summaries.external_overlap(a, b, "t", "t", lambda c: F.lower(F.regexp_replace(c, r"\s+", " ")))) == [(2, 1)]
    assert rows(summaries.external_overlap(a.limit(0), b, "t", "t", F.lower)) == [(0, 0)]
