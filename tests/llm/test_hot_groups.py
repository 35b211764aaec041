"""Repeats inside one text, hot keys, templates that many texts share, and columns whose names clash."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgerow.llm import common, line_rules, ngram_join, suffix_dedup


def windows(docs, n=50):
    """Covered words by brute force: (all repeated, those not of the first occurrence) of each document."""
    seen = {}
    for i, t in docs:
        w = t.split()
        for p in range(len(w) - n + 1):
            seen.setdefault(tuple(w[p : p + n]), []).append((i, p))
    every, later = {}, {}
    for places in seen.values():
        if len(places) > 1:
            for k, (i, p) in enumerate(sorted(places)):
                every.setdefault(i, set()).update(range(p, p + n))
                if k:
                    later.setdefault(i, set()).update(range(p, p + n))
    return every, later


@pytest.mark.parametrize("hot", [1, 1000])
def test_runs_inside_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "HOT_KEYS", 1 << 40)
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = some(55)
    texts = [["buy"] * 400, some(9) + ["buy"] * 120 + some(9), ["buy", "now"] * 150, some(30) + ["a", "b", "c"] * 80, shared * 3, some(20) + shared, some(10) + shared + some(5), ["buy"] * 49, some(60)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    every, later = windows(docs)
    got = suffix_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    cover = lambda spans: {j for s in spans for j in range(s.start, s.end)}
    assert {r.doc_id: cover(r.repeated) for r in got} == every
    assert {r.doc_id: cover(r.removed) for r in got if r.removed} == later


def test_a_run_is_one_row():
    w = np.full(5000, 7, np.uint64)
    gram, context, lo, hi, counts = suffix_dedup.suffixes(w, np.array([0, 5000]))
    rows = suffix_dedup._places(gram, context, lo, hi, counts)
    assert counts.tolist() == [4951] and rows[-1].tolist() == [1] and len(rows[4][0]) == 4950


def test_join_by_size(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = spark.createDataFrame([(k, i) for k, n in {"a": 20, "b": 3, "c": 6, "d": 1}.items() for i in range(n)], "k string, i int")
    right = spark.createDataFrame([("a", 20, 1), ("b", 3, 2), ("c", 6, 3), ("x", 0, 4)], "k string, n int, v int")
    got = common.join_by_size(left, right, ["k"], "n", 30)
    assert sorted(got.collect()) == sorted(left.join(right, "k").collect()) and got.columns == left.join(right, "k").columns


def template_corpus(n, share, seed=1, words=120):
    """Texts that agree in a contiguous share of their words; the rest is their own."""
    rng = random.Random(seed)
    common_part = [f"t{i}" for i in range(int(words * share))]
    return [(i, " ".join(common_part + [f"o{rng.randrange(10**9)}" for _ in range(words - len(common_part))])) for i in range(n)]


@pytest.mark.parametrize(("n", "share"), [(1500, 0.687), (1500, 0.773), (1500, 0.862)])
def test_templates_do_not_run_together(spark, monkeypatch, n, share):
    """Texts at similarity 0.51, 0.62 and 0.75 meet in most buckets; no group of them comes out, and fewer pairs are verified than meet."""
    made = {}
    for name in ("plausible_members", "verified_links"):
        monkeypatch.setattr(ngram_join, name, lambda *a, f=getattr(ngram_join, name), name=name: made.setdefault(name, f(*a)))
    docs = spark.createDataFrame(template_corpus(n, share), "doc_id long, text string").repartition(4)
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == n and all(r.class_id == r.doc_id and r.n_links == 0 for r in got)
    assert made["verified_links"].count() == 0  # so there is no edge to make a component of
    bands, rows = ngram_join.choose_bands()
    signed = docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("key"), "text").mapInArrow(ngram_join._sign(bands, rows), "id long, key string, n long, bands array<long>, sketch binary")
    pairs = F.sum(F.col("count") * (F.col("count") - 1) / 2)
    met = signed.select(F.explode("bands").alias("band")).groupBy("band").count().agg(pairs).first()[0]
    compared = made["plausible_members"].groupBy("band").count().agg(F.coalesce(pairs, F.lit(0.0))).first()[0]
    assert met > 300 and compared <= met


def test_recall_at_the_threshold(spark):
    """Pairs at similarity 0.80 to 0.81: nearly all are found, among many texts of one template."""
    rng = random.Random(11)
    docs, pairs = [], 0
    own = lambda k: [f"o{rng.randrange(10**9)}" for _ in range(k)]
    template = [f"t{i}" for i in range(60)]
    for i in range(400):
        base = template + own(144)
        a, b = list(base), list(base)
        b[-22:] = own(22)  # 178 of 222 n-grams are shared
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    like = [i for i in range(400) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])]
    assert len(like) == 400 and max(len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in like) < 0.81
    got = {r.doc_id: r for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    pairs = sum(got[2 * i].class_id == got[2 * i + 1].class_id == 2 * i for i in like)
    assert pairs >= 0.97 * len(like) and all(r.n_links <= 1 for r in got.values())


def test_repeated_rows_and_blocks(spark, monkeypatch):
    """Near copies whose rows repeat with the same id, in blocks of few texts."""
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(ngram_join, "BUCKET_TEXTS", 4)
    base = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join([*base[:95], *[f"x{i}y{k}" for k in range(i % 4)]])) for i in range(12)]
    rows = docs + docs[:5] * 2
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    times = {i: sum(j == i for j, _ in rows) for i, _ in docs}
    for r in got:
        assert r.n_links == sum(times[j] for j in sets if len(sets[j] & sets[r.doc_id]) >= 0.8 * len(sets[j] | sets[r.doc_id])) - 1
        assert r.class_id == 0


@pytest.mark.parametrize("block", [3, 4096])
def test_texts_unlike_the_first_of_their_bucket(spark, monkeypatch, block):
    """Chains of texts from alike to unlike; one band of one row, so that buckets mix them."""
    monkeypatch.setattr(ngram_join, "BUCKET_TEXTS", block)
    monkeypatch.setattr(ngram_join, "choose_bands", lambda *a: (40, 2))
    rng = random.Random(3)
    docs = []
    for g in range(5):
        t = [f"g{g}w{i}" for i in range(80)]
        for _ in range(12):
            docs.append((len(docs), " ".join(t)))
            at = rng.randrange(70)
            t[at : at + 3] = [f"n{rng.randrange(10**9)}" for _ in range(3)]
            if rng.random() < 0.3:
                t[10:30] = [f"n{rng.randrange(10**9)}" for _ in range(20)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(76)} for i, t in docs}
    links, root = dict.fromkeys(sets, 0), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert sum(links.values()) > 40
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (find(i), links[i]) for i in sets}


def test_plausible():
    k = ngram_join.plausible(0.8, 120)
    assert 70 <= k <= 80 and ngram_join.plausible(1.0, 120) == 120


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _text_key string, _key string, _number long, _removed string, _text_hash long, row long, cut string, key string, tk long, id long, removed string, copies long, doc string, number long, rid long, line_key string, salt long, part string, gram long, n long"


def test_clashing_names(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [(1, f"{passage} one"), (2, f"two {passage}"), (3, "a line\nof three"), (4, "a line\nof four"), (5, "x y z"), (6, "x y z")]
    extra = ("k", "k", 1, "r", 2, 3, "c", "k", 4, 5, "r", 6, "d", 7, 8, "l", 9, "p", 10, 11)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), *extra) for i, t in texts], CLASH)
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]  # 1 and 2 are alike
    assert {tuple(r)[5:] for r in kept.collect()} == {extra}
    cut = suffix_dedup.drop_repeated_passages(docs)
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()}[2] == "two "
    assert {tuple(r)[5:] for r in cut.collect()} == {extra}
    lines = line_rules.keep_lines(docs, max_docs=1)
    assert lines.columns == docs.columns
    assert {r.doc_id: r.text for r in lines.collect()} == {1: f"{passage} one", 2: f"two {passage}", 3: "of three", 4: "of four", 5: "", 6: ""}
    assert {tuple(r)[5:] for r in lines.collect()} == {extra}
