"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pytest

from hedgerow.llm import langid, queries, sp_codec, suffix_dedup, token_count

WORDS = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcd"]


def test_one_of_some_whole_rows_stays(spark):
    a, b, c, d = WORDS
    rows = [(1, a, "x"), (1, a, "y"), (None, b, "x"), (None, b, "x"), (None, b, "x"), (3, f"{c} tail of three", "x"), (4, f"head {c}", "x"), (4, f"head {c}", "y"), (5, d, "x"), (6, "too short", "x"), (6, "too short", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [(r.doc_id, r.text.strip(), r.source) for r in suffix_dedup.drop_repeated_passages(docs, length_col=None).collect()]
    assert sorted(got, key=str) == sorted([(1, a, "x"), (None, b, "x"), (3, f"{c} tail of three", "x"), (4, "head", "x"), (5, d, "x"), (6, "too short", "x"), (6, "too short", "x")], key=str)


def test_late_words_are_verified():
    c = sp_codec.Codec(sp_codec.read_model(queries.vocabulary(queries.PIECES)))
    other = c.other

    class Differs:
        def encode(self, texts, **options):
            return [[0] if t == "late" else ids for t, ids in zip(texts, other.encode(texts, **options), strict=True)]

    c.other = Differs()
    c.encode([" ".join(f"w{i}" for i in range(20_001))])
    with pytest.raises(ValueError, match="late"):
        c.encode(["late"])


def test_no_language_is_left_out(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} of {x}", x) for i, x in enumerate(["aa", "bb", "cc"] * 3)], "doc_id long, text string, lang string")
    assert langid.train(docs, max_train=4).languages == ["aa", "bb", "cc"]
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2, raising=False)
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs)


def test_long_words_are_not_remembered():
    """A text without spaces is one word; workers keep short ones only, so their memory is bounded."""
    long = ["x" * 5000 + str(i) for i in range(50)] + ["日本語" * 700]
    c = sp_codec.Codec(sp_codec.read_model(queries.vocabulary(queries.PIECES)))
    want = [c.other.encode(t) for t in long]
    assert [np.frombuffer(x, np.int32).tolist() for x in c.encode([f"a {t} b" for t in long])] == [c.other.encode(f"a {t} b") for t in long]
    assert [np.frombuffer(x, np.int32).tolist() for x in c.encode(long)] == want
    assert max(map(len, c.known)) <= sp_codec.CACHED_CHARS
    spec = open(queries.vocabulary(queries.BYTE_BPE), encoding="utf-8").read()
    e = token_count.Encoder(spec, token_count.whole_tokens(spec))
    for t in long:
        n = len(e.tokenizer.encode(f"a {t} b", add_special_tokens=False).ids)
        assert e.count(f"a {t} b") == n == len(e.encode(f"a {t} b")) // 4
    assert max(map(len, [*e.counts, *e.parts])) <= token_count.CACHED_CHARS and len(e.pre) <= len(e.whole) + 200
