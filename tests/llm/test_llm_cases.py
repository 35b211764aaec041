"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from hedgerow.llm import ann, langid, line_rules, mixing, ngram_join, quality_pu, queries, sp_codec, suffix_dedup, token_count, train_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, h long, n long, tokens string, score double, doc string"
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))


def rows():
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "en", "a"), (5, "one", "en", "a"), (5, "one", "en", "a"),
        (None, "a null id here and some words", "de", "b"), (None, "a null id here and some words", "de", "b"), (6, LONG, "en", "a"), (7, f"{passage} tail of seven", "en", "a"),
        (8, f"head of eight {passage}", "en", "b"), (9, "日本語 text — “quoted” ½", "fr", "c"), (10, "<|endoftext|> x  y\n\n z ", "fr", "c"), (7, "other text of a repeated id", "en", "a"),
        (11, "12 34 !!", "de", "c"), (12, "\x00\x01 odd \x85 spaces\xa0here ▁mark", "de", "c"),
    ]
    return [(i, t, l, s, len(t or ""), "clash", "clash", 1, 2, "x", 0.5, "y") for i, t, l, s in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 1, 0), (7, 1, 0), (8, 0, 1), (10, 0, 0), (None, 1, None), (9, None, None), (11, 0, 0)], "doc_id long, quality int, toxic int")


def run(f, docs, none):
    full, empty = f(docs), f(none)
    assert empty.count() == 0 and empty.columns == full.columns
    return full.collect()


def test_line_rules(docs, none):
    got = run(line_rules.line_rules, docs, none)
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got if r.doc_id}
    assert (by[1].n_words, by[1].base_failed, by[1].kept) == (0, True, False)
    assert by[6].n_words == 60_000
    assert run(lambda d: line_rules.keep_lines(d, max_docs=1), docs, none)


def test_ngram_join(docs, none):
    got = run(ngram_join.near_duplicates, docs, none)
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert [(by[i].class_id, by[i].n_links) for i in (1, 2, 3)] == [(1, 0), (2, 0), (3, 0)]
    assert {(r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id in (4, 5)} == {(4, 4, 2), (5, 4, 2)}
    assert [r.n_links for r in got if r.doc_id is None] == [1, 1]
    kept = run(ngram_join.drop_near_duplicates, docs, none)
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [1, 2, 3, 4, None, 6, 7, 7, 9, 10, 11, 12]))
    assert list(kept[0].asDict()) == SCHEMA.replace(",", "").split()[::2]


def test_suffix_array(docs, none):
    got = run(suffix_dedup.repeated_passages, docs, none)
    spans = {r.doc_id: [(s.start, s.end) for s in r.repeated] for r in got}
    assert spans[7] == [(0, 60)] and spans[8] == [(3, 63)] and 4 not in spans
    cut = {r.doc_id: r for r in run(suffix_dedup.drop_repeated_passages, docs, none) if r.doc_id in (7, 8) and "tail" in r.text or r.doc_id == 8}
    assert cut[8].text == "head of eight " and cut[8].n_chars == 14 and cut[7].text.endswith("tail of seven")


def test_language(docs, none):
    got = run(langid.identify, docs, none)
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {1, 2, 3, 11} <= und and not und & {4, 6, 9}
    alone = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("und", 0.0)}


def test_quality(spark, docs, none):
    got = run(lambda d: quality_pu.quality_scores(d, labels(spark)), docs, none)
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    no_labels = quality_pu.quality_scores(docs, labels(spark).limit(0)).collect()
    assert {r.score for r in no_labels} == {0.5}
    assert quality_pu.keep_good(docs, labels(spark)).columns == docs.columns
    assert quality_pu.keep_good(none, labels(spark)).count() == 0


def test_tokens(docs, none):
    got = {r.doc_id: r for r in run(lambda d: token_count.token_counts(d, queries.vocabulary(queries.BYTE_BPE)), docs, none)}
    assert (got[1].n_bytes, got[1].n_tokens, got[2].n_tokens) == (0, 0, 0) and got[6].over_limit
    ids = {r.doc_id: r for r in run(lambda d: sp_codec.encode(d, queries.vocabulary(queries.PIECES)), docs, none)}
    assert list(ids[1].ids) == [] and all(r.restored for i, r in ids.items() if i != 12)
    back = {r.doc_id: r.text for r in sp_codec.decode(sp_codec.encode(docs.where("doc_id = 9"), queries.vocabulary(queries.PIECES)), queries.vocabulary(queries.PIECES)).collect()}
    assert back == {9: "日本語 text — “quoted” ½"}


def test_training_order(docs, none):
    f = lambda d: train_order.ordered_sequences(train_order.token_table(d, queries.vocabulary(queries.BYTE_RANKS), stride=16), 5, stride=16, per_shard=8)
    got = run(f, docs, none)
    assert sorted(r.slot for r in got) == list(range(len(got))) and all(len(r.record) == 32 for r in got)


def test_mixture(docs, none):
    w = mixing.Weights([{"en": 2}, {}])
    levels = [F.col("lang"), F.col("source")]
    got = run(lambda d: mixing.mixture(d, levels, w), docs, none)
    assert {r.doc_id for r in got} == {i for i, *_ in rows()} - {3} and len(got) == len(rows()) - 1
    assert run(lambda d: mixing.mix(d, levels, w, share=0.5), docs, none)


def test_vectors(spark):
    kind = "vec_id long, embedding array<float>, id long, h long, v string, list int"
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, None], [1.0, 1.0], [1.0, 0.0, 0.0]]
    df = spark.createDataFrame([(i * 100, v, 1, 1, "x", 1) for i, v in enumerate(vectors)] + [(200, [1.0, 0.0], 1, 1, "x", 1), (None, [1.0, 2.0], 1, 1, "x", 1)], kind)
    got = ann.nearest(df, df.where("vec_id % 100 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert by[0] == [(200, 0.0), (800, 1.0), (100, 1.414214)]
    assert by[200] == [(0, 0.0), (800, 1.0), (100, 1.414214)] and set(by) == {0, 100, 200, 800}
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0
