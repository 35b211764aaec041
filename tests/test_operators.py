import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgerow.functions import numbers
from hedgerow.operators import cohorts, contracts, decide, features, graph, heads, metrics, resample, selection, sensitivity, splits


def frame(spark, y, score, **more):
    cols = {"id": range(len(y)), "y": y, "score": score, **more}
    kinds = {"id": "int", "y": "int", "score": "double", "keep": "boolean", "keep_a": "boolean", "keep_b": "boolean", "g": "string", "cluster": "string"}
    rows = list(zip(*cols.values(), strict=True))
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in cols)).withColumn("all", F.lit("a"))


def aurc(y, s):
    y, s = np.array(y, float), np.array(s, float)
    order = np.argsort(s, kind="stable")
    p = y.copy()
    for v in set(s):
        p[s == v] = y[s == v].mean()
    return float(np.mean(np.cumsum(p[order]) / np.arange(1, len(y) + 1)))


def test_aurc_ties_and_order(spark):
    assert metrics.aurc(frame(spark, [0, 0, 1, 1], [0.0] * 4), ["all"]).first().aurc == pytest.approx(0.5)
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 500).tolist(), rng.integers(0, 40, 500).astype(float).tolist()
    assert metrics.aurc(frame(spark, y, s), ["all"]).first().aurc == pytest.approx(aurc(y, s), abs=1e-12)


def test_selective_bounds(spark):
    row = metrics.selective(frame(spark, [1, None, 0, 0], [0.0] * 4, keep=[True, True, True, False]), ["all"]).first()
    assert (row.risk_lower, row.risk_upper, row.coverage) == (pytest.approx(1 / 3), pytest.approx(2 / 3), 0.75)
    none = metrics.selective(frame(spark, [1], [0.0], keep=[False]), ["all"]).first()
    assert none.risk_lower is None and none.known_risk is None and none.capture == 1


def test_ece_of_true_probabilities(spark):
    df = frame(spark, [0, 0, 1, 1], [0.0, 0.0, 1.0, 1.0])
    assert metrics.ece(df, ["all"], "y", "score", "id", 2).first().ece == 0


def test_kept_count_rounds_half_to_even(spark):
    df = spark.createDataFrame([(5,), (15,), (1,), (0,)], "n long")
    assert [r[0] for r in df.select(selection.kept_count(F.col("n"), 0.5)).collect()] == [2, 8, 1, 0]


def test_keep_top_agrees_with_ranking(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, [0] * 300, rng.integers(0, 20, 300).astype(float).tolist(), g=rng.choice(["a", "b", "c"], 300).tolist())
    for c in (0.1, 0.8, 0.95):
        kept = {r.id for r in selection.keep_top(df, ["g"], "score", "id", c).where("keep").collect()}
        want = {r.id for r in selection.ranked(df, ["g"], "score", "id").where(F.col("rank") <= selection.kept_count(F.col("n"), c)).collect()}
        assert kept == want


def worst(y, a, b, flips):
    known = [i for i, v in enumerate(y) if v is not None]
    unknown = [i for i, v in enumerate(y) if v is None]
    best = -math.inf
    for f in itertools.combinations(known, flips):
        for u in itertools.product([0, 1], repeat=len(unknown)):
            z = [1 - v if i in f else v for i, v in enumerate(y)]
            for i, v in zip(unknown, u, strict=True):
                z[i] = v
            mean = lambda k: np.mean([v for v, m in zip(z, k, strict=True) if m])
            best = max(best, mean(a) - mean(b))
    return best


def test_difference_bounds_and_flips(spark):
    rng = np.random.default_rng(3)
    for _ in range(6):
        y = [[0, 1, None][i] for i in rng.integers(0, 3, 7)]
        a, b = rng.random(7) < 0.6, rng.random(7) < 0.6
        a[0] = b[1] = True
        df = frame(spark, y, [0.0] * 7, keep_a=a.tolist(), keep_b=b.tolist())
        row = sensitivity.difference_bounds(df, ["all"]).first()
        assert row.upper == pytest.approx(worst(y, a, b, 0))
        assert row.lower == pytest.approx(-worst(y, b, a, 0))
        if any(v is not None for v in y):
            got = sensitivity.flip_budget(df, ["all"]).first()
            need = next((m for m in range(sum(v is not None for v in y) + 1) if max(worst(y, a, b, k) for k in range(m + 1)) >= -1e-12), None)
            assert got.flips_to_erase == need


def test_identical_selections(spark):
    row = sensitivity.difference_bounds(frame(spark, [1, None], [0.0, 0.0], keep_a=[True, True], keep_b=[True, True]), ["all"]).first()
    assert (row.lower, row.upper) == (0, 0)
    empty = sensitivity.difference_bounds(frame(spark, [1], [0.0], keep_a=[False], keep_b=[True]), ["all"]).first()
    assert empty.lower is None and empty.upper is None


def test_bootstrap_weights_equal_copied_rows(spark):
    rng = np.random.default_rng(4)
    y, s, c = rng.integers(0, 2, 60), rng.integers(0, 9, 60).astype(float), rng.choice(list("abcd"), 60)
    df = frame(spark, y.tolist(), s.tolist(), cluster=c.tolist()).withColumn("method", F.lit("m"))
    draws = resample.numpy_draws(spark, list("abcd"), 5, seed=9)
    got = {r.replicate: r.aurc for r in resample.bootstrap_aurc(df, draws).collect()}
    again = np.random.default_rng(9)
    for b in range(5):
        idx = np.concatenate([np.flatnonzero(c == k) for k in again.choice(list("abcd"), 4, replace=True)])
        assert got[b] == pytest.approx(aurc(y[idx], s[idx]), abs=1e-12)


def test_contracts(spark):
    left = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (4, "x")], "id int, f string")
    right = spark.createDataFrame([(1, "x"), (3, "x"), (4, "y")], "id int, f string")
    row = contracts.id_contract(left, right, "id", [("f", "f")]).first()
    assert (row.left_only, row.right_only, row.left_repeated, row.right_repeated, row.stale_f) == (1, 1, 1, 0, 1)
    with pytest.raises(contracts.ContractError):
        contracts.require(contracts.id_contract(left, right), "test")
    with pytest.raises(contracts.ContractError):
        contracts.contract_join(left, right)
    contracts.require(contracts.id_contract(right, right), "test")
    assert {r.id for r in contracts.pending(right, left).collect()} == {3}
    assert contracts.stale(right, left, "id", "f").first().id == 4


def test_shards(spark):
    m = spark.createDataFrame([(f"i{k}", k) for k in range(5)], "id string, _pos int")
    parts = m.select("id", (F.col("_pos") % 2).alias("shard"))
    assert all(r.expected == r.found and not (r.unknown or r.missing or r.misplaced or r.repeated) for r in contracts.shard_contract(m, parts, 2).collect())
    broken = {r.shard: r for r in contracts.shard_contract(m, parts.where("id <> 'i4'"), 2).collect()}
    assert broken[0].missing == 1 and broken[1].missing == 0


def test_design(spark):
    found = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1)], "m string, s int")
    assert {(r.m, r.s, r.problem) for r in contracts.design_contract(found, {"m": ["a", "b"], "s": [1, 2]}).collect()} == {("b", 1, "missing"), ("b", 2, "missing"), ("c", 1, "unexpected")}


def test_grouped_split(spark):
    rows = [(f"s{i % 12}", "number" if i % 3 else "negation") for i in range(48)]
    df = spark.createDataFrame(rows, "speaker string, kind string")
    run = lambda: {r.speaker: r.split for r in splits.grouped_split(df, "speaker", ["kind"], {"train": 0.6, "cal": 0.2, "test": 0.2}, seed=9, tries=300).collect()}
    first = run()
    assert first == run() and len(first) == 12
    assert sorted(map(list(first.values()).count, ("train", "cal", "test"))) == [2, 3, 7]


def test_largest_remainder():
    assert splits.largest_remainder(12, {"train": 0.6, "cal": 0.2, "test": 0.2}) == {"train": 7, "cal": 2, "test": 3}
    assert sum(splits.largest_remainder(7, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}).values()) == 7


@pytest.mark.parametrize("speakers", ["aabbc", "aaabbcc", "abcdef", "abcdefghijk"])
def test_donor_design(spark, speakers):
    rows = [(f"{s}{i}", s) for i, s in enumerate(speakers)]
    design = lambda r: {x.id: x.donor_id for x in splits.donor_design(spark.createDataFrame(r, "id string, sp string"), "id", "sp").collect()}
    got = design(rows)
    assert sorted(got) == sorted(got.values()) == sorted(i for i, _ in rows)
    assert all(a[0] != b[0] for a, b in got.items())
    assert sum(got[got[a]] != a for a in got) == (3 if len(rows) % 2 else 0)
    assert got == design(rows[::-1])


def test_donor_design_infeasible(spark):
    with pytest.raises(ValueError):
        splits.donor_design(spark.createDataFrame([(f"{s}{i}", s) for i, s in enumerate("aaabca")], "id string, sp string"), "id", "sp")


def test_number_readers_skip_texts_without_numbers(spark):
    texts = ["no such word", "", None, "Twenty-one cats", "dixième", "ein Haus", "zweihundert", "trente et un", "mille mille", "٣ x", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(numbers.number_mentions("t").alias("en"), numbers.german_numbers("t").alias("de"), numbers.french_numbers("t").alias("fr")).collect()
    for t, r in zip(texts, got, strict=True):
        if t is None:
            assert r.en is r.de is r.fr is None
            continue
        assert [tuple(m) for m in r.en] == numbers.english_mentions(t) and r.de == numbers.german_values(t)
        assert (r.fr if r.fr is None else [tuple(m) for m in r.fr]) == numbers.french_mentions(t)


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 200, (150, 2)).tolist() + [[i, i + 1] for i in range(300, 360)] + [[5, 5]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), graph.checkpointed).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long"), graph.checkpointed).count() == 0


@pytest.mark.parametrize("hot", [3, 1000])
def test_components_never_plan_a_whole_round(spark, monkeypatch, hot):
    monkeypatch.setattr(graph, "HOT_ROWS", hot)
    star = [(1000, i) for i in range(1001, 1030)]
    pairs = [*star, *((i, i + 1) for i in range(20)), (5, 1007), (2000, 2001)]
    exchanges = []

    def keep(df, name):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return graph.checkpointed(df, name)

    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), keep).collect()}
    assert got == {**{i: 0 for i in [*range(21), *range(1000, 1030)]}, 2000: 2000, 2001: 2000}
    assert max(exchanges) <= 8


def test_heads_and_platt(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(i, float(a), None if i % 5 == 0 else float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, y int")
    ready = heads.prepare(df, ["a", "b"]).apply(df)
    assert heads.prepare(df, ["a", "b"]).columns == ["a", "b", "b_missing"]
    model = heads.fit_logistic(ready)
    raw = ready.select("id", "y", F.lit("m").alias("method"), model.score(ready).alias("raw"))
    platt = heads.fit_platt(raw, ["method"])
    row = platt.first()
    assert row.a > 0
    out = heads.apply_platt(raw, platt, ["method"]).orderBy("raw").collect()
    assert all(p.calibrated <= q.calibrated + 1e-12 for p, q in zip(out, out[1:], strict=False))
    assert np.mean([r.calibrated for r in out]) == pytest.approx(np.mean(y), abs=1e-4)
    flipped = raw.withColumn("y", 1 - F.col("y"))
    assert heads.fit_platt(flipped, ["method"]).first().a == 0
    forest = heads.fit_forest(ready, trees=20)
    auc = metrics.auroc(ready.select("y", forest.score(ready).alias("score"), F.lit("a").alias("all")), ["all"]).first().auroc
    assert auc > 0.9


def test_funnel_and_expansion(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", False), (4, "b", True)], "id int, t string, ok boolean")
    judged = cohorts.funnel(df, [("bad", ~F.col("ok"))], ["t"], [F.col("id")])
    assert {r.id: r.reason for r in judged.collect()} == {1: None, 2: "duplicate", 3: "bad", 4: None}
    assert {r.reason: r.n for r in cohorts.funnel_counts(judged).collect()} == {"kept": 2, "duplicate": 1, "bad": 1}
    assert cohorts.expand(df, "id", ["l", "r"], ["c"]).count() == 8
    assert [r._pos for r in cohorts.with_position(df, "id").orderBy("id").collect()] == [0, 1, 2, 3]


def test_first_match(spark):
    files = [spark.createDataFrame(rows, "k string, v int") for rows in ([("a", 1)], [("a", 2), ("b", 3)], [("c", 4), ("d", 5)])]
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "k string")
    assert {r.k: r.v for r in cohorts.first_match(files, keys, "k").collect()} == {"a": 1, "b": 3, "c": 4}


def test_feature_rows(spark):
    df = spark.createDataFrame([("three cats", ["", "three dogs"], "three cats"), ("", [], None)], "translation string, probes array<string>, cascade string")
    got = features.feature_rows(df).collect()
    assert (got[0].output_length, got[0].perturb_mean_distance, got[0].evidence_text_distance, got[0].evidence_coverage_gap) == (2.0, 0.5, 0.0, 0.0)
    assert (got[1].output_length, got[1].perturb_mean_distance, got[1].evidence_text_distance) == (0.0, None, None)
    with pytest.raises(Exception, match="missing translation"):
        features.feature_rows(df.select(F.lit(None).cast("string").alias("translation"), "probes", "cascade")).collect()


def test_decisions(spark):
    df = spark.createDataFrame([(0.1, "20 cats"), (0.5, "20 cats and one"), (0.5, "cats"), (0.9, "x")], "r double, t string")
    got = [(r.action, r.output) for r in decide.decided(df, "r", "t", 0.5, 0.9).collect()]
    assert got == [("translate", "20 cats"), ("mark_uncertain", "[uncertain]20[/uncertain] cats and [uncertain]one[/uncertain]"), ("mark_uncertain", "cats [uncertain]"), ("abstain", "")]


def test_seal():
    first = decide.seal({"a": 1}, None, "t1")
    assert decide.seal({"a": 1}, first, "t2") == first
    with pytest.raises(ValueError):
        decide.seal({"a": 2}, first, "t2")


def test_distances_are_made_once_a_row(spark):
    df = spark.createDataFrame([("a b c", ["a b d", "x"], "a b d"), ("", [], None), (None, ["", "y"], " ")], "t string, probes array<string>, c string")
    for made in (features.perturbation("t", "probes"), features.evidence("t", "c")):
        assert df.select(made.alias("x"))._jdf.queryExecution().analyzed().toString().count("levenshtein(") == 1
    got = [(r.p.mean, r.p.max, r.e.distance, r.e.gap) for r in df.select(features.perturbation("t", "probes").alias("p"), features.evidence("t", "c").alias("e")).collect()]
    assert got == [((1 / 3 + 1) / 2, 1.0, 1 / 3, 1 - 2 / 3), (None, None, None, None), (1.0, 1.0, None, None)]
