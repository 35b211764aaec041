"""Lattice scores against enumeration of all segmentations and against a plain count of words."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hedgerow.llm import lattice_lm, queries

SF = "/root/testdata/sf0.001"


def ways(s, weights):
    """All sequences of pieces that spell s."""
    if not s:
        yield ()
    for i in range(1, len(s) + 1):
        if s[:i] in weights:
            for rest in ways(s[i:], weights):
                yield (s[:i], *rest)


@pytest.fixture(scope="module")
def small():
    return lattice_lm.pieces_of({b" a": 5.0, b" ab": 3.0, b"b": 2.0, b"ba": 4.0, b"aba": 1.0, "é".encode(): 2.0, b" ": 1.0, b"abab": 0.5})


def marked(texts):
    raw = b"".join(b" " + t for t in texts)
    return np.frombuffer(raw, np.uint8), np.array([len(t) + 1 for t in texts])


@pytest.mark.parametrize("cells", [lattice_lm.CELLS, 7])
def test_forward_and_expected_counts_by_enumeration(small, monkeypatch, cells):
    monkeypatch.setattr(lattice_lm, "CELLS", cells)
    texts = [b"a", b"abab", "é".encode(), b"ababab", b"x", "bé".encode(), b"a"]
    p = dict(zip(small.surfaces, np.exp(small.logp[:-1]), strict=True))
    counts = np.array([3, 1, 2, 5, 1, 1, 0])
    lattice = lattice_lm.Lattice(*marked(texts), small)
    logp = lattice.logp_of()
    expected = Counter()
    for t, c, got in zip(texts, counts, logp, strict=True):
        each = {w: math.prod(p[x] for x in w) for w in ways(b" " + t, p)}
        total = sum(each.values())
        assert got == pytest.approx(math.log(total), abs=1e-9)
        for w, x in each.items():
            for piece in w:
                expected[piece] += c * x / total
    found = lattice_lm.Lattice(*marked(texts), small).expected(counts)
    assert found[-1] == 0
    for s, x in zip(small.surfaces, found, strict=False):
        assert x == pytest.approx(expected.get(s, 0), abs=1e-9)


def test_probabilities_sum_to_one(small):
    assert np.exp(small.logp).sum() == pytest.approx(1)
    # all strings of up to two pieces of a tiny vocabulary, weighed by their lattices
    p = lattice_lm.pieces_of({b"a": 1.0, b"aa": 1.0})
    one, two = np.exp(p.logp[p.surfaces.index(b"a")]), np.exp(p.logp[p.surfaces.index(b"aa")])
    space = np.exp(p.logp[p.surfaces.index(b" ")])
    got = np.exp(lattice_lm.Lattice(*marked([b"aaa"]), p).logp_of()[0])
    assert got == pytest.approx(space * (one**3 + 2 * one * two))


def test_long_word_in_blocks(small, monkeypatch):
    word = b"ab" * 3000
    whole = lattice_lm.Lattice(*marked([word, b"a"]), small).logp_of()
    monkeypatch.setattr(lattice_lm, "CELLS", 40)
    assert np.allclose(lattice_lm.Lattice(*marked([word, b"a"]), small).logp_of(), whole)
    assert len(lattice_lm.Lattice(*marked([word]), small).blocks) > 8


def base_rows(docs):
    """doc_id -> (held out, tokens, known, N, base score) by plain counting."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(itertools.chain.from_iterable(split(t) for i, t in docs if not held(i)))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(w := split(t)), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, t in docs]


@pytest.mark.parametrize("heavy", [lattice_lm.HEAVY, 50])
def test_query_against_plain_counts(spark, monkeypatch, heavy):
    monkeypatch.setattr(lattice_lm, "HEAVY", heavy)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op12_subword_lattice(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, held, tokens, known, n, base in base_rows(docs):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and -1e9 < r.score < 0


def test_score_is_the_lattice_of_the_text(spark):
    """Without a training text the vocabulary's scores stand: each word by its own lattice, and the end."""
    docs = [(1, None), (1, ""), (None, "Der Hund"), (None, "der  hund\n")]
    rows = spark.createDataFrame([(i, t, "clash", 1, " ") for i, t in docs if i is None] + [(None, None, "clash", 1, " ")], "doc_id long, text string, word string, row long, key string")
    with open(queries.vocabulary(queries.PIECES), "rb") as f:
        model = f.read()
    got = sorted(lattice_lm.lattice_scores(rows.repartition(2), model).collect(), key=lambda r: r.n_tokens)
    p = lattice_lm.vocabulary_pieces(model)
    hund = lattice_lm.Lattice(*marked([b"der", b"hund"]), p).logp_of().sum() / math.log(10)
    end = p.logp[-1] / math.log(10)
    assert [r.n_tokens for r in got] == [1, 3, 3] and [r.n_known for r in got] == [0, 0, 0] and {r.train_tokens for r in got} == {0}
    assert [r.score for r in got] == pytest.approx([end, hund + end, hund + end])
    assert lattice_lm.lattice_scores(rows.limit(0), model).count() == 0


def test_training_raises_the_likelihood(spark):
    """Expected counts of the training texts make the held-out ones likelier, round by round."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    with open(queries.vocabulary(queries.PIECES), "rb") as f:
        model = f.read()
    total = [lattice_lm.score(docs, lattice_lm.learn(docs, model, rounds=r)).where("held_out").agg({"score": "sum"}).first()[0] for r in (0, 1, 2)]
    assert total[0] < total[1] < total[2]
