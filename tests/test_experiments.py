"""Training, checkpoints, transfer, gates, chains, requests and preparation."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hedgerow.functions import signal
from hedgerow.operators import cohorts, contracts, features, gates, heads, inference, reporting, training
from hedgerow.plans import catalogue, chains, experiments  # noqa: F401  (the last adds its queries to the catalogue)
from hedgerow.sources import readers, writers


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        y = rng.random() < 0.4
        rows.append((i, f"s{i % 40}", ["train", "train", "calibration", "test"][i % 40 % 4], None if i % 23 == 0 else int(y), y + rng.gauss(0, 0.7), rng.gauss(0, 1) if i % 7 else None, None, "number", "clean" if i % 2 else "noise"))
    return spark.createDataFrame(rows, "id long, speaker string, split string, y int, a double, b double, none double, fact_type string, condition string").cache()


REGISTRY = {"lr_a": ["a"], "et_ab": ["a", "b"], "lr_none": ["none"], "lr_nowhere": ["nowhere"]}


@pytest.fixture(scope="module")
def trained(items):
    return training.train_heads(items, REGISTRY, "speaker", ["id", "y", "condition"], trees=20)


def test_training(trained, items):
    fitted, scores, reasons = trained
    assert set(fitted) == {"lr_a", "et_ab"} and set(reasons) == {"lr_none", "lr_nowhere"}
    got = scores.toPandas()
    assert len(got) == 2 * items.where("split = 'test'").count() and got.calibrated.between(0, 1).all()
    one = got[(got.method == "lr_a") & got.y.notna()]
    assert one.raw[one.y == 1].mean() > one.raw[one.y == 0].mean()
    record = training.describe(scores, ["method"]).toPandas().set_index("method")
    y, p = one.y.to_numpy(float), one.raw.to_numpy()
    assert abs(record.loc["lr_a"].brier_raw - np.mean((p - y) ** 2)) < 1e-12 and record.loc["lr_a"].auroc_known > 0.6
    flat = training.flattened(training.describe(scores, ["method"]), F.lit("c"), F.lit(1))
    assert flat.count() == 2 and {"cohort", "aurc", "kept90", "frozen_upper"} <= set(flat.columns)


def test_heads_are_stored_and_frozen(spark, trained, items, tmp_path):
    fitted, scores, _ = trained
    frozen = training.freeze(fitted, "manifest")["heads"]
    for head in fitted.values():
        assert training.save_head(spark, head, f"file://{tmp_path}") == frozen[head.name]
    again = {n: training.load_head(spark, f"file://{tmp_path}", n, frozen[n]) for n in fitted}
    test = items.where("split = 'test'")
    moved, _ = training.transfer(test, again, frozen, ["id", "y", "condition"])
    key = lambda df: sorted((r.method, r.id, r.raw, r.calibrated) for r in df.collect())
    assert key(moved) == key(scores)
    with pytest.raises(contracts.ContractError):
        training.load_head(spark, f"file://{tmp_path}", "lr_a", "another")
    with pytest.raises(contracts.ContractError):
        training.transfer(test, again, {**frozen, "lr_a": "another"}, ["id", "y"])
    with pytest.raises(contracts.ContractError):
        training.transfer(items, again, frozen, ["id", "y"])


def test_split_check(items):
    training.split_check(items, "speaker")
    with pytest.raises(contracts.ContractError):
        training.split_check(items.withColumn("speaker", F.lit("one")), "speaker")
    with pytest.raises(contracts.ContractError):
        training.split_check(items.withColumn("y", F.when(F.col("split") == "train", 1).otherwise(F.col("y"))), "speaker")


def test_boosting_scores(items):
    parts = [items.where(f"split = '{s}'") for s in ("train", "calibration", "test")]
    ready = heads.prepare(parts[0].where("y is not null"), ["a", "b"])
    model = heads.Fitted(heads.fit_boosting(ready.apply(parts[0]), rounds=3))
    got = model.scored(ready.apply(parts[2]), "raw").toPandas()
    assert got.raw.between(0, 1).all() and got.raw[got.y == 1].mean() > got.raw[got.y == 0].mean()


def test_selection_by_folds(items):
    best, areas = training.select_by_folds(items.where("split = 'train'"), {"lr_b": ["b"], "lr_a": ["a"]}, "speaker", folds=3)
    assert best == "lr_a" and areas.count() == 2


def test_legacy_calibration(spark):
    rng = np.random.default_rng(1)
    raw = rng.uniform(0.05, 0.95, 300)
    y = (rng.uniform(size=300) < 1 - raw).astype(int)  # turned round: only the older form may follow
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, raw, strict=True)], "method string, y int, raw double")
    assert heads.fit_platt(df, ["method"]).first()["a"] == 0.0 and heads.fit_platt(df, ["method"], legacy=True).first()["a"] < -0.5
    with pytest.raises(ValueError):
        heads.fit_platt(df.withColumn("y", F.lit(1)), ["method"], legacy=True)


def test_seed_grid_reuses_and_refuses(items, tmp_path):
    args = ({"c": items.where("split = 'test'")}, {"x": items}, {"lr_a": ["a"]}, f"file://{tmp_path}", {"p": 1}, {"c": "x"}, ["id", "y"])
    first = training.seed_grid(*args, seeds=(1, 2)).collect()
    assert len(first) == 2 and training.seed_grid(*args, seeds=(1, 2)).collect() == first
    with pytest.raises(contracts.ContractError):
        training.seed_grid(*args[:4], {"p": 2}, *args[5:], seeds=(1,))


def test_registries():
    assert len(training.REGISTRY) == 18 and len(training.REGISTRY["et_full"]) == 21 and len(training.without("speech", "wave")) == 14
    old = training.legacy_registry(["token_entropy"])
    assert len(old) == 16 and old["mlp_audio_grounded"] == ["token_entropy"] and len(training.legacy_registry(formal=True)["hgb_audio_grounded"]) == 19
    assert [training.kind_of(n) for n in ("et_full", "interaction_audio_grounded", "hgb_full", "qe")] == ["et", "et", "hgb", "lr"]


def test_gates(spark):
    assert gates.failures({"a": True, "author_information_supplied": False}) == []
    assert gates.failures({"a": False, "author_information_supplied": False}, "submission") == ["a", "author_information_supplied"]
    with pytest.raises(ValueError):
        gates.failures({}, "draft")
    assert [r.key for r in gates.protocol_gate(spark, {"x": 1, "y": [1]}, {"x": 1, "y": [2], "z": None}).collect()] == ["y"]
    sheet = spark.createDataFrame([("a", "", None), ("b", "yes", " ")], "t string, h string, g string")
    assert gates.blank_columns(sheet, ["h", "g"]).first().asDict() == {"rows": 2, "h": 1, "g": 0}
    ok = spark.range(1).select(gates.verdicts({"a": F.lit(True), "b": F.lit(None).cast("boolean")}).alias("m")).first()["m"]
    assert ok == {"b": False}


def test_chain(spark, tmp_path):
    d = spark.range(10)
    made = []

    def double(x, by):
        made.append(by)
        return x.select((F.col("id") * by).alias("id"))

    line = [chains.Stage("last", lambda x: x.groupBy().agg(F.sum("id").alias("s")), ["twice"]), chains.Stage("twice", double, ["in"], {"by": 2})]
    folder = f"file://{tmp_path}/chain"
    with pytest.raises(contracts.ContractError):
        chains.run(spark, line, {"in": d}, folder, {"in": "a"}, start_at="last")
    tables, new = chains.run(spark, line, {"in": d}, folder, {"in": "a"})
    assert tables["last"].first()["s"] == 90 and new == ["twice", "last"]
    assert chains.run(spark, line, {"in": d}, folder, {"in": "a"}, start_at="last")[1] == [] and made == [2]
    line[1].settings = {"by": 3}
    assert chains.run(spark, line, {"in": d}, folder, {"in": "a"}, until="twice")[1] == ["twice"]
    with pytest.raises(contracts.ContractError):
        chains.ordered([chains.Stage("a", None, ["b"]), chains.Stage("b", None, ["a"])], set())
    assert chains.shard_plan(["x", "y"], {"x": 2}, {"x": 3, "y": 1}) == [("x", 0, 2), ("x", 1, 2), ("y", 0, 1)]
    assert len(chains.cohort_registry(["p", "q"], {"fr": ["clean", "stress"], "de": ["natural"]})) == 8
    assert chains.optional_scores(spark, False, "nowhere", "id long").count() == 0
    with pytest.raises(FileNotFoundError):
        chains.optional_scores(spark, True, f"file://{tmp_path}/nowhere", "id long")
    states = iter(["running", "complete"])
    chains.wait_for(lambda: spark.createDataFrame([(next(states),)], "status string"), 60, 0.01)
    with pytest.raises(contracts.ContractError):
        chains.wait_for(lambda: spark.createDataFrame([("failed",)], "status string"), 1)
    with pytest.raises(TimeoutError):
        chains.wait_for(lambda: spark.createDataFrame([("running",)], "status string"), 0)


def test_requests_and_answers(spark):
    def stub(batches):
        for b in batches:
            assert b["src"].nunique() == 1
            yield pd.DataFrame({"owner": b["owner"], "role": b["role"], "place": b["place"], "translation": b["audio"].str.upper()})

    m = spark.createDataFrame([(1, "a", [("p", "b"), ("q", "c")], "de"), (2, "d", None, "fr")], "id long, audio string, probes array<struct<name:string,audio:string>>, src string")
    asked = inference.requests(m, samples=2).join(m.select(F.col("id").alias("owner"), "src"), "owner")
    answers = inference.scored(asked, stub, "owner long, role string, place int, translation string", ("src",))
    got = {r.id: r for r in inference.checked_outputs(inference.regrouped(answers)).collect()}
    assert got[1].translation == "A" and [(p.name, p.translation) for p in got[1].probe_translations] == [("p", "B"), ("q", "C")]
    assert got[2].probe_translations == [] and got[2].sample_translations == ["D", "D"]
    with pytest.raises(contracts.ContractError):
        inference.checked_outputs(spark.createDataFrame([(" ",)], "translation string"))


def test_exact_input_cache(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string")
    todo, hold = inference.cached(rows, spark.createDataFrame([], "id long, input_fingerprint string, score double"), ["t"])
    assert todo.count() == 2 and hold.count() == 0
    done = todo.select("id", "input_fingerprint", F.lit(0.5).alias("score")).where("id = 1")
    todo, hold = inference.cached(rows, done, ["t"])
    assert [r.id for r in todo.collect()] == [2] and hold.count() == 1
    with pytest.raises(contracts.ContractError):
        inference.cached(rows.withColumn("t", F.lit("other")), done, ["t"])
    assert [r.chunk for r in inference.in_chunks(rows, "id", 1).orderBy("id").collect()] == [0, 1]
    a, b = rows.select(inference.fingerprints("attention", "t").alias("a"), inference.fingerprints("likelihood", "t").alias("b")).first()
    assert a != b
    timings = spark.createDataFrame([(2, "a", 1, 1.0), (2, "b", 0, 2.0)], "item int, way string, place int, seconds double")
    with pytest.raises(contracts.ContractError):
        inference.paired_timings(timings)


def test_timings_of_no_time(spark):
    rows = [(2, "a", 0, 0.0), (2, "b", 1, 1.0), (3, "a", 1, 0.0), (3, "b", 0, 0.0), (4, "a", 0, 2.0), (4, "b", 1, 1.0)]
    timings = spark.createDataFrame(rows, "item int, way string, place int, seconds double")
    got = {r.item: r.ratio for r in inference.paired_timings(timings).collect()}
    assert got[2] == float("inf") and got[3] != got[3] and got[4] == 0.5


def test_repeated_timings(spark):
    rows = [(2, "a", 0, 2.0, 1), (2, "b", 1, 1.0, 1), (2, "a", 0, 4.0, 2), (2, "b", 1, 8.0, 2)]
    timings = spark.createDataFrame(rows, "item int, way string, place int, seconds double, run int")
    assert sorted(r.ratio for r in inference.paired_timings(timings, run="run").collect()) == [0.5, 2.0]
    with pytest.raises(contracts.ContractError, match="repeated"):
        inference.paired_timings(timings)


def test_paired_timings_equal_sql_on_odd_values(spark, tmp_path):
    import duckdb

    # an id twice, decimals at and next to half a unit of the ninth digit, no time with either sign, values out of range
    values = [0.0, 0.0, 1.0, 3.0, 3.0, 5120.0, -5120.0, 16956.9370982495, 1843.1628034354999, 0.0, -0.0, 1e308, 5e-324, float("nan"), float("inf")]
    ids = [0, 1, 2, 3, 3, *range(4, 14)]
    con = duckdb.connect()
    con.execute("create table events as select unnest($1::bigint[]) as event_id, unnest($2::double[]) as value", [ids, values])
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = con.execute(catalogue.ORACLES["paired_timings"]).fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["paired_timings"](spark, str(tmp_path)).select("item", "first", "second", "ratio").collect()]
    assert sorted(map(repr, ((i, *(x + 0.0 for x in r)) for i, *r in got))) == sorted(map(repr, ((i, *(x + 0.0 for x in r)) for i, *r in want)))


def test_feature_variants(spark):
    df = spark.createDataFrame([(1, "twelve cats", ["12 cats", "no cats", ""], "12 cats"), (2, "", None, "")], "id long, translation string, sample_translations array<string>, cascade_translation string")
    got = {r.id: r for r in features.deployment_features(df, "id").collect()}
    assert (got[1].sample_number_disagreement, got[1].evidence_number_mismatch) == (1 / 3, 0.0)
    assert got[1].sample_negation_disagreement == 1 / 3 and got[2].sample_number_disagreement is None and got[2].evidence_number_mismatch is None
    old = spark.createDataFrame([(1, "test", 1.0), (2, "train", 2.0)], "id long, split string, f double")
    labels = spark.createDataFrame([(1, 1, "ok"), (2, None, "open")], "id long, y int, status string")
    resolved, unresolved, coverage = features.corrected(old, old.where("id = 2").withColumn("f", F.lit(9.0)), labels)
    assert resolved.count() == 1 and unresolved.first()["f"] == 9.0 and coverage.count() == 2
    with pytest.raises(contracts.ContractError):
        features.corrected(old, old, labels.where("id = 1"))
    manifest = spark.createDataFrame([(1, "", True), (2, "x", True)], "id long, contrast_slot string, contrast_value_present boolean")
    predictions = df.select("id", "translation", F.col("sample_translations").alias("probes"), F.lit("f").alias("input_fingerprint"))
    scores = df.select("id", F.lit(0.5).alias("score"), F.lit("f").alias("input_fingerprint"))
    made = {r.id: r for r in features.external(manifest, predictions, df.select("id", "cascade_translation"), scores).collect()}
    assert made[1].unsupported is None and made[2].unsupported is True and made[1].qe_risk == 0.5 and made[2].output_length == 0
    with pytest.raises(contracts.ContractError):
        features.external(manifest, predictions, df.select("id", "cascade_translation"), scores.withColumn("input_fingerprint", F.lit("g")))


def test_transforms(spark):
    x = [0.5, -0.5] * 8
    df = spark.createDataFrame([(1, x, [0.1] * 4, 8, 0.0, 1.0)], "id long, x array<double>, donor array<double>, donor_rate int, span_start double, span_end double")
    one = lambda kind, **spec: signal.transformed(df, kind, **spec).first()["x"]
    assert one("identity") == x and one("gain", db=20.0) == [v * 10 for v in x]
    assert len(one("truncate_at_slot", rate=8, retain=0.5)) == 4 and one("gaussian_noise", snr_db=10.0) != x
    over = one("local_overlap", rate=8, snr_db=0.0)
    assert np.allclose(over[:8], [1.0, 0.0] * 4) and over[8:] == x[8:]
    with pytest.raises(ValueError):
        signal.transformed(df, "reverse")


def test_preparation(spark):
    m = spark.createDataFrame([(1, "h1"), (2, "h2")], "id long, audio_sha256 string")
    got = {r.id: r for r in cohorts.revised(m, spark.createDataFrame([(2, "h9")], "id long, audio_sha256 string"), ["id", "audio_sha256"]).collect()}
    assert not got[1].requires_fresh_prediction and got[2].requires_fresh_prediction and got[1].row_digest != got[2].row_digest
    sheet = cohorts.annotation_sheet(m, ["audio_sha256"], ["verdict"], 2, 7).collect()
    assert len(sheet) == 4 and {r.verdict for r in sheet} == {""} and sorted(r.row for r in sheet) == [1, 1, 2, 2]


def test_reports(spark, tmp_path):
    records = spark.createDataFrame([("m", "c", 0.25, 10, 2, 1), ("n", "c", 0.5, 0, 0, 0)], "method string, cohort string, aurc double, kept90 long, errors90 long, unresolved90 long")
    rows = reporting.publication(records, ["c"], ["n", "m"]).collect()
    assert [r.method for r in rows] == ["n", "m"] and rows[1].c == "0.2500 20.00-30.00" and rows[0].c == "0.5000 --"
    assert reporting.run_metrics(spark, "r", {"t": 1.0}).count() == 1 and reporting.utc_now().endswith("Z")
    assert reporting.figure_data({"a": spark.createDataFrame([(1, 2.0)], "x int, y double")}, "x", "y").first().asDict() == {"series": "a", "x": 1.0, "y": 2.0}
    pytest.importorskip("yaml")
    writers.yaml_document({"b": 1, "a": [2]}, tmp_path / "c.yaml")
    assert list(readers.config(tmp_path / "c.yaml")) == ["b", "a"]


def test_macros_are_bounded(spark):
    df = spark.createDataFrame([(f"name {chr(97 + i)}", float(i)) for i in range(5)], "n string, v double")
    assert writers.macros(df, "n", "v").count("newcommand") == 5
    with pytest.raises(ValueError):
        writers.macros(df, "n", "v", limit=4)


def test_seed_grid_fits_a_logistic_head_once_and_describes_once(items, tmp_path, monkeypatch):
    fits, passes = [], []
    fit_head, describe = training.fit_head, training.describe
    monkeypatch.setattr(training, "fit_head", lambda *a, **k: fits.append(a[2]) or fit_head(*a, **k))
    monkeypatch.setattr(training, "describe", lambda s, by, *a, **k: passes.append(by) or describe(s, by, *a, **k))
    args = ({"c": items.where("split = 'test'")}, {"b": items}, {"lr_a": ["a"]}, f"file://{tmp_path}", {"p": 1}, {"c": "b"}, ["id", "y"])
    rows = training.seed_grid(*args, seeds=(1, 2)).collect()
    assert fits == ["lr_a"] and len(passes) == 1
    assert sorted((r.cohort, r.seed) for r in rows) == [("c", 1), ("c", 2)]
    assert [training.load_head(items.sparkSession, f"file://{tmp_path}/b/{s}", "lr_a").seed for s in (1, 2)] == [1, 2]
