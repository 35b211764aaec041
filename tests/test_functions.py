import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hedgerow.functions import labels, numbers, signal
from hedgerow.functions import text as X


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("twenty one patients", ["21"]), ("twenty-one patients", ["21"]), ("one hundred", ["100"]), ("one hundred and twenty-three", ["123"]),
        ("two thousand five hundred", ["2500"]), ("twenty first", ["21"]), ("one hundredth", ["100"]), ("one point zero five", ["1.05"]),
        ("1,234.50 and 22nd", ["1234.5", "22"]), ("minus twenty one", ["-21"]), ("one or two", ["1", "2"]), ("twenty, one", ["20", "1"]),
        ("3.5 liters", ["3.5"]), ("1/2 liter", ["1", "2"]), ("a dozen, twice", ["12", "2"]), ("", []), ("negative", []), ("two million and five", ["2000005"]),
    ],
)
def test_english_mentions(text, values):
    assert [v for v, _, _ in numbers.english_mentions(text)] == values


def test_mention_span():
    assert numbers.english_mentions("There are twenty-one patients.") == [("21", 10, 20)]


def test_all_spellings_below_ten_thousand():
    assert [f for n in range(10_000) for f in labels.representation_failures(n)] == []


@pytest.mark.parametrize(("text", "values"), [("ein Zug mit einundzwanzig Wagen", ["21"]), ("zweitausendvierhundert Menschen", ["2400"]), ("hundert und 5", ["100", "5"]), ("und", [])])
def test_german(text, values):
    assert numbers.german_values(text) == values


@pytest.mark.parametrize(
    ("text", "value"),
    [("vingt et un", 21), ("soixante et onze", 71), ("quatre-vingts", 80), ("quatre-vingt-dix-neuf", 99), ("deux cent trois", 203), ("mille neuf cent quatre-vingt-dix", 1990), ("neuf cent quatre-vingt-dix-neuf mille neuf cent quatre-vingt-dix-neuf", 999_999), ("deux trois", None)],
)
def test_french_integer(text, value):
    assert numbers.french_integer(text) == value


def test_french_mentions():
    assert numbers.french_mentions("Une femme lit un livre.") == []
    assert [v for v, _, _ in numbers.french_mentions("deux ou trois livres")] == ["2", "3"]
    assert numbers.french_mentions("deux trois livres") is None
    assert numbers.french_mentions("trois millions de livres") is None
    assert len(numbers._french_lexicon()) == 1000


def test_table_function(spark):
    numbers.register(spark)
    got = spark.sql("select id, m.value from values (1, 'one or 22'), (2, 'none') as t(id, s), lateral number_mentions(s) m").collect()
    assert sorted((r.id, r.value) for r in got) == [(1, "1"), (1, "22")]


CASES = [
    ("There are 30 cats and 20 dogs.", "20", "30", "number", "There are 20 cats and 30 dogs.", None, "number_target_context_ambiguous"),
    ("", "3", None, "number", "Three cats arrived.", 1, "wrong_or_missing_target_number"),
    ("Three cats and four cats.", "3", None, "number", "Three cats arrived.", None, "number_target_context_ambiguous"),
    ("3.5 liters", "3.5", None, "number", "3.5 liters", 0, "target_number_match"),
    ("1/2 liter", "1/2", None, "number", "1/2 liter", None, "reference_target_not_unique"),
    ("He came not.", "no", None, "negation", "He came.", 1, "reference_polarity_proxy"),
    ("He came!", "no", None, "negation", "He came.", 0, "exact_reference"),
    ("x", "y", None, "colour", "z", None, "unsupported_fact_type"),
]


def test_label_fact(spark):
    rows = [(i, t, json.dumps(e), json.dumps(c), k, r) for i, (t, e, c, k, r, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string, e string, c string, k string, r string")
    got = df.select("i", labels.label_fact("t", "e", "c", "k", "r").alias("l")).select("i", "l.y", "l.reason").orderBy("i").collect()
    assert [(r.y, r.reason) for r in got] == [(y, why) for *_, y, why in CASES]


def test_older_labels(spark):
    df = spark.createDataFrame([("twelve passengers",), ("thirteen passengers",), ("many passengers",)], "t string").select("t", F.array(F.lit("12")).alias("e"), F.array(F.lit("13")).alias("c"))
    got = df.select(labels.slot_correct("t", "e", "number").alias("ok"), labels.unsupported_contrast("t", "e", "c", "number").alias("bad")).collect()
    assert [(r.ok, r.bad) for r in got] == [(True, False), (False, True), (False, False)]


def test_reference_checks():
    assert all(labels.reference_checks("We saw twenty-one birds.", '"21"').values())


def test_slots():
    assert X.slot_list('{"value": 3, "aliases": ["three", "3"], "other": "x"}') == ["3", "three"]
    assert X.slot_list(None) == []
    assert X.slot_list('["a", ["b", "a"]]') == ["a", "b"]


def test_normalize(spark):
    df = spark.createDataFrame([("  Don't STOP ",), ("ＡＢ c",), (None,), ("",)], "t string")
    got = df.select(X.normalize("t").alias("n"), X.normalize("t", punctuation=True).alias("p"), X.is_negative(X.normalize("t", punctuation=True)).alias("neg")).collect()
    assert [(r.n, r.p, r.neg) for r in got] == [("don t stop", "don't stop", True), ("ab c", "ab c", False), ("", "", False), ("", "", False)]


words = st.lists(st.sampled_from(["a", "b", "é", "cc", "d'"]), max_size=7)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=60, max_size=120))
def test_token_distance(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = df.select("i", X.token_distance("a", "b").alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [edits(a, b) for a, b in pairs]


def test_distance_queries(spark):
    import itertools
    import re

    from conftest import SF
    from hedgerow.plans import catalogue

    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        s = re.sub(r"[\W_]+", " ", r.text.lower()).strip()
        turns.setdefault(r.conv_id, {})[r.turn] = s.split() if " " in s else list(s)
    for r in catalogue.QUERIES["token_distance_pairs"](spark, SF).collect():
        a, b = turns[r.conv_id][r.turn_a], turns[r.conv_id][r.turn_a + 1]
        assert r.distance == edits(a, b) and r.normalized == pytest.approx(edits(a, b) / max(len(a), len(b), 1))
    for r in catalogue.QUERIES["pairwise_mean_distance"](spark, SF).collect():
        pairs = [edits(a, b) / max(len(a), len(b)) for a, b in itertools.combinations([t for t in turns[r.conv_id].values() if t], 2)]
        assert r.pairs == len(pairs) and (not pairs or r.mean_distance == pytest.approx(np.mean(pairs)))


def test_chrf(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sat"), ("the cat sat", "zzz qqq"), ("abc", "abc"), ("", "")], "r string, h string")
    got = [r.chrf for r in X.sentence_chrf(df, "r", "h").collect()]
    assert got[0] == pytest.approx(100) and got[1] < 30 and got[2] == pytest.approx(50) and got[3] == 0
    assert X.corpus_chrf(df.limit(1), [], "r", "h").first().chrf == pytest.approx(100)


def test_disagreement(spark):
    df = spark.createDataFrame([([["3"], ["3"], [], ["3"]],), ([["3"]],)], "s array<array<string>>")
    assert [r[0] for r in df.select(X.disagreement("s")).collect()] == [pytest.approx(1 / 3), None]


def test_signal(spark):
    df = spark.createDataFrame([([0.1] * 16000,), ([],)], "x array<double>")
    row = df.select(signal.duration("x", 16000).alias("d"), signal.zero_fraction("x").alias("z"), signal.rms_db("x").alias("db"), F.size(signal.truncate_at("x", 16000, F.lit(0.5), F.lit(0.8), 0.5)).alias("n")).collect()
    assert (row[0].d, row[0].z, row[0].n) == (1.0, 0.0, 10400) and row[0].db == pytest.approx(-20)
    assert row[1].db == pytest.approx(-120) and row[1].z is None


def test_noise_level_and_seed():
    x = np.full(16000, 0.1)
    a, b = (signal.noisy(x, 10, signal._generator("i", 1)) for _ in range(2))
    assert (a == b).all()
    assert 20 * math.log10(0.1 / np.sqrt(np.mean((a - x) ** 2))) == pytest.approx(10, abs=0.05)


def test_entropy_and_attention(spark):
    df = spark.createDataFrame([([0.0, float("-inf"), 0.0],)], "x array<double>")
    assert df.select(signal.softmax_entropy("x")).first()[0] == pytest.approx(math.log(2))
    w = spark.createDataFrame([([[0.75, 0.125, 0.125], [0.75, 0.125, 0.125]],)], "w array<array<double>>")
    got = w.select(signal.attention_summary("w", 1).alias("a")).select("a.*").first()
    assert (got.audio_ratio, got.audio_entropy) == (pytest.approx(0.75), 0) and got.text_entropy == pytest.approx(math.log(2)) and got.correlation == pytest.approx(1)


def test_overlap_and_masks(spark):
    x = signal.overlapped(np.full(1000, 0.5), 1000, np.sin(np.arange(300.0)), 500, (0.2, 0.4), 0)
    assert (x[:200] == 0.5).all() and (x[400:] == 0.5).all() and not (x[200:400] == 0.5).all()
    df = spark.createDataFrame([(2, 4, 10), (8, 10, 10)], "a int, b int, n int")
    assert [tuple(r[0]) for r in df.select(signal.irrelevant_span(F.col("a"), F.col("b"), F.col("n"))).collect()] == [(0, 2), (0, 2)]


def test_pandas_form_of_empty_series():
    assert list(pd.Series([], dtype=object).map(str)) == []
