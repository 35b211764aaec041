"""The fits of the two classifiers against dense and finite-difference versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hedgerow.llm import common, langid, quality_pu


def grams(text: str, orders: int = 4) -> set[bytes]:
    raw = text.lower().encode()
    return {raw[i : i + k] for k in range(1, orders + 1) for i in range(len(raw) - k + 1)}


def test_presence_is_of_ngrams():
    texts = ["Ein Haus", "", "aé b", "x" * 40]
    raw, off = langid._lowered(pa.array(texts))
    got = langid.presence(raw, off, bits=22)
    every = sorted({g for t in texts for g in grams(t)})
    alone = {g: np.flatnonzero(langid.presence(np.frombuffer(g, np.uint8), np.array([0, len(g)]), bits=22)[0]) for g in every}
    for row, t in zip(got, texts, strict=True):
        assert set(np.flatnonzero(row)) == {c for g in grams(t) for c in alone[g]}


def test_fit_is_kernel_ridge_regression(spark):
    """With every row a landmark the fit is the closed form of the dense kernel matrix."""
    texts = {"en": ["the house on the hill", "a cat and the dog", "where is the train"], "de": ["das haus am berg", "ein hund und die katze", "wo ist der zug"], "fr": ["la maison sur la colline", "un chat et le chien", "où est le train"]}
    rows = [(i, t, x) for i, (x, t) in enumerate((x, t) for x, ts in texts.items() for t in ts)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_landmarks=len(rows))
    raw, off = langid._lowered(pa.array([t for _, t, _ in rows]))
    cells = langid.presence(raw, off).astype(np.float64)
    unit = cells / np.sqrt(cells.sum(1, keepdims=True))
    kernel = unit @ unit.T
    y = np.array([[float(x == name) for name in sorted(texts)] for _, _, x in rows])
    alpha = np.linalg.solve(kernel + langid.RIDGE * len(rows) * np.eye(len(rows)), y)
    new, at = langid._lowered(pa.array(["the train and the hill", "der hund am haus", "le chat sur le train"]))
    x = langid.presence(new, at).astype(np.float64)
    x /= np.sqrt(x.sum(1, keepdims=True))
    assert np.allclose(x @ model.weights, x @ unit.T @ alpha, atol=2e-3)
    assert [model.languages[i] for i in (x @ model.weights).argmax(1)] == ["en", "de", "fr"]


@pytest.mark.parametrize("shift", [-3.0, 3.0])
@pytest.mark.parametrize("risk", [quality_pu.nn_risk, quality_pu.apart_risk])
def test_gradient(risk, shift):
    rng = np.random.default_rng(1)
    zp, zu = rng.normal(1, 1, 7) + shift, rng.normal(-1, 1, 9) - shift
    prior, step = 0.6, 1e-6
    value, gp, gu = risk(zp, zu, prior)
    rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

    def unclipped(p, u):
        part = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        return prior * np.logaddexp(0, -p).mean() + part if rest >= 0 else -part

    f = unclipped if risk is quality_pu.nn_risk else lambda p, u: risk(p, u, prior)[0]
    assert (rest < 0) == (shift > 0)
    for g, z, at in ((gp, zp, 0), (gu, zu, 1)):
        for i in range(len(z)):
            up, down = [zp.copy(), zu.copy()], [zp.copy(), zu.copy()]
            up[at][i] += step
            down[at][i] -= step
            assert abs((f(*up) - f(*down)) / 2 / step - g[i]) < 1e-6
    assert value >= 0


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.85])
def test_planted_prior(prior):
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 0.8, 12)
    draw = lambda n, side: (rng.normal(0, 1, (n, 12)) + side * centre).astype(np.float32)
    unl = np.concatenate([draw(int(3000 * prior), 1), draw(int(3000 * (1 - prior)), -1)])
    got = quality_pu.estimate_prior(draw(1500, 1), unl[rng.permutation(len(unl))], 1)
    assert abs(got - prior) < 0.08


def test_features_of_words_and_trigrams():
    texts = ["alpha beta alpha", "", "zq"]
    raw, off = common.utf8(pa.array(texts))
    x = quality_pu.features(raw, off)
    words, three = x[:, quality_pu.PLAIN : quality_pu.PLAIN + quality_pu.CELLS], x[:, quality_pu.PLAIN + quality_pu.CELLS :]
    assert sorted(np.rint(words[0][words[0] > 0]).tolist()) == [147, 208] and not words[1].any() and (three[2] == 0).all()
    again = quality_pu._unpacked([a.tobytes() + b.astype(np.uint8).tobytes() for a, b in zip(x[:, : quality_pu.PLAIN], x[:, quality_pu.PLAIN :], strict=True)])
    assert (again == x).all()


@pytest.mark.parametrize("prior", [0.3, 0.85])
def test_calibration_needs_no_negatives(prior):
    """Slope and offset from positives and a mixture come near those of the true log odds."""
    rng = np.random.default_rng(7)
    n = 40_000
    y = rng.random(n) < prior
    x = rng.normal(np.where(y, 0.9, -0.9), 1)
    true = 2 * 0.9 * x + np.log(prior / (1 - prior))  # log odds of two normal classes
    z = (true - 0.7) / 2.5  # a score of another scale
    slope, offset = quality_pu.calibrate(z[y][:15_000] if y.sum() > 15_000 else z[y], z, prior)
    assert abs(slope - 2.5) < 0.2 and abs(offset - 0.7) < 0.2
    g = slope * z + offset
    assert abs((1 / (1 + np.exp(-g))).mean() - prior) < 1e-3
    at = lambda a, b: quality_pu.pu_loss(a * z[y] + b, a * z + b, prior)
    assert all(at(slope + da, offset + db) > at(slope, offset) - 2e-3 for da in (-0.3, 0, 0.3) for db in (-0.3, 0, 0.3))


def test_the_fit_reads_no_negatives(spark):
    good, junk = "some plain words that make a sentence number {}", "zzz {} $$$ ### 111 @@@ {}"
    docs = [(i, (good if i % 3 else junk).format(i, i)) for i in range(600)]
    positives = [(i, 1) for i in range(600) if i % 3 and i * 7919 % 1000 < 400]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    l = spark.createDataFrame(positives, "doc_id long, quality int")
    model = quality_pu.train(d, l)
    # the same rows in another order and split give the same fit
    again = quality_pu.train(d.orderBy(F.desc("doc_id")).repartition(5), l)
    assert all((a == b).all() for a, b in zip(model.layers, again.layers, strict=True)) and (model.slope, model.offset, model.prior, model.weight) == (again.slope, again.offset, again.prior, again.weight)
    assert model.weight in quality_pu.WEIGHTS and abs(model.prior - 0.55) < 0.15  # 400 of 600 less the labelled ones
    scores = {r.doc_id: r for r in quality_pu.quality_scores(d, l).collect()}
    assert np.mean([scores[i].predicted == 1 for i, _ in docs if i % 3]) > 0.95 and np.mean([scores[i].predicted == 0 for i, _ in docs if not i % 3]) > 0.95
    assert all(0 <= r.score <= 1 for r in scores.values())
    # which label a labelled negative has doesn't matter, only that it is no unlabelled row
    negatives = spark.createDataFrame([(i, 0) for i in range(0, 60, 2) if not i % 3], "doc_id long, quality int")
    with_ = quality_pu.train(d, l.union(negatives))
    other = quality_pu.train(d.where(~F.col("doc_id").isin([r.doc_id for r in negatives.collect()])), l)
    assert all((a == b).all() for a, b in zip(with_.layers, other.layers, strict=True))
