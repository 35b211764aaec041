"""Results against brute force, round trips and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from conftest import SF, canonical
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hedgerow.llm import ann, common, mixing, ngram_join, queries, sp_codec, suffix_dedup, token_count, train_order


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and canonical(ours) == canonical(theirs)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\tÀ\x0b¡", max_size=40), max_size=8))
def test_word_hashes(texts):
    import pyarrow as pa

    raw, off = common.utf8(pa.array(texts, pa.string()))
    h, first, start, end = common.words(raw, off)
    want = [w for t in texts for w in t.encode().split()]
    assert [bytes(raw[a:b]) for a, b in zip(start, end, strict=True)] == want
    assert len({*zip(h.tolist(), want, strict=True)}) == len(set(want))
    assert np.diff(first).tolist() == [len(t.encode().split()) for t in texts]


def test_long_text_is_hashed_like_a_short_one(monkeypatch):
    raw = np.frombuffer(b"alpha beta gamma delta " * 50, np.uint8)
    whole = common.words(raw, np.array([0, len(raw)]))[0]
    monkeypatch.setattr(common, "CHUNK_BYTES", 8)
    assert (common.words(raw, np.array([0, len(raw)]))[0] == whole).all()


def test_bands():
    b, r = ngram_join.choose_bands()
    assert b * r <= 128 and 1 - (1 - 0.8**r) ** b >= 0.9999
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.1, 0.999999, 4)


def near_corpus(seed, groups=6, copies=7):
    rng = random.Random(seed)
    docs = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 120))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = f"new{rng.randrange(10**6)}"
            docs.append(" ".join(t))
    docs += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(10)] + docs[:3]
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    docs = near_corpus(1)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
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
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("parts", [1, 7])
def test_passages(spark, parts):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(50_000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 70, 130)]
    docs = []
    for i in range(30):
        t = []
        for _ in range(rng.randrange(1, 4)):
            t += [word() for _ in range(rng.randrange(0, 40))]
            p = rng.choice(passages)
            a = rng.randrange(0, 5)
            t += p[a:] if rng.random() < 0.5 else p
        docs.append((i, " ".join(t)))
    docs.append((30, docs[0][1]))
    seen = {}
    for i, t in docs:
        w = t.split()
        for p in range(len(w) - 49):
            seen.setdefault(tuple(w[p : p + 50]), []).append((i, p))
    every, later = {}, {}
    for places in seen.values():
        if len(places) > 1:
            for k, (i, p) in enumerate(sorted(places)):
                every.setdefault(i, set()).update(range(p, p + 50))
                if k:
                    later.setdefault(i, set()).update(range(p, p + 50))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = suffix_dedup.repeated_passages(df).collect()
    cover = lambda spans: {j for s in spans for j in range(s.start, s.end)}
    assert {r.doc_id: cover(r.repeated) for r in got} == every
    assert {r.doc_id: cover(r.removed) for r in got if r.removed} == later
    cut = {r.doc_id: r.text for r in suffix_dedup.drop_repeated_passages(df, length_col=None).collect()}
    for i, t in docs:
        rest = [w for j, w in enumerate(t.split()) if j not in later.get(i, ())]
        assert cut.get(i, "").split() == rest


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(train_order.permute(np.arange(n), n, 42).tolist()) == list(range(n))
    assert train_order.permute(np.arange(100), 100, 1).tolist() != train_order.permute(np.arange(100), 100, 2).tolist()


def test_shards(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 9)) for i in range(60)], "doc_id long, text string").repartition(5)
    path, folder = queries.vocabulary(queries.BYTE_BPE), str(tmp_path / "out")
    ranks = queries.vocabulary(queries.BYTE_RANKS)
    shards = train_order.write_training_order(docs, ranks, folder, key=3, stride=8, per_shard=16, pad=50256).collect()
    rows = {r.slot: r for r in train_order.ordered_sequences(train_order.token_table(docs, ranks, stride=8), key=3, stride=8, per_shard=16, pad=50256).collect()}
    n = len(rows)
    assert sum(r.n_sequences for r in shards) == n and sorted(r.shard for r in shards) == list(range(-(-n // 16)))
    read = list(train_order.read_slots(folder, 0, n + 5))
    assert len(read) == n
    assert all(bytes(rows[s].record) == x.tobytes() for s, x in enumerate(read))
    again = list(train_order.read_slots(f"file://{folder}", 21, 7))
    assert all((a == b).all() for a, b in zip(again, read[21:28], strict=True))
    tk = Tokenizer.from_file(path)
    for i in range(60):
        mine = sorted((r.seq, r.slot) for r in rows.values() if r.doc_id == i)
        ids = [int(t) for s, slot in mine for t in read[slot][: rows[slot].n_tokens]]
        assert ids == tk.encode(f"text number {i} " * (i % 9), add_special_tokens=False).ids


ODD = ["", " ", "  a b", "a  b\n c \n\n d\t e", "x<|endoftext|>y z", "naïve café — “quotes” 日本語 123 4½", "it's we'll I'D", "a b c", "tail ", "\n", "1234 56,7 $$$ ###", "it 's 're  's", "\x0b\x0c x", "▁ x▁▁y ▁", "<s> </s> <0x0A>", "é" * 300, "🙂 🙂🙂  🙂"]


def test_encoders_equal_the_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    spec = open(queries.vocabulary(queries.BYTE_BPE), encoding="utf-8").read()
    enc, tk = token_count.Encoder(spec, token_count.whole_tokens(spec)), Tokenizer.from_str(spec)
    model = sp_codec.read_model(queries.vocabulary(queries.PIECES))
    codec, sp = sp_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    mixed = ["".join(rng.choice("ab \n'sé½<|>▁\t1") for _ in range(rng.randrange(30))) for _ in range(400)]
    for t in ODD + mixed:
        want = tk.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), np.int32).tolist() == want and enc.count(t) == len(want), t
        ids = codec.encode([t])[0]
        assert np.frombuffer(ids, np.int32).tolist() == sp.encode(t), t
        assert codec.decode(ids) == sp.decode(sp.encode(t)), t


def test_unigram_backend():
    from sentencepiece import sentencepiece_model_pb2 as pb
    import sentencepiece

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.unk_id = 1, True, 0
    m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.escape_whitespaces = m.normalizer_spec.remove_extra_whitespaces = True
    add = lambda piece, score, kind: m.pieces.add(piece=piece, score=score, type=kind)
    add("<unk>", 0, 2)
    for b in range(256):
        add(f"<0x{b:02X}>", 0, 6)
    for i, p in enumerate(["▁", "a", "b", "▁a", "ab", "▁ab", "ba", "abb"]):
        add(p, -1.0 - 0.3 * i, 1)
    model = m.SerializeToString()
    ours, sp = sp_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for t in ["ab", "abba ab", "  b  a ", "aXb", ""]:
        assert np.frombuffer(ours.encode([t])[0], np.int32).tolist() == sp.encode(t), t


def test_budgets():
    w = mixing.Weights([{"x": 3, "y": 1}, {"a": 1, "b": 1}])
    supply = {("x", "a"): 10, ("x", "b"): 1000, ("y", "a"): 1000}
    # a gives what it has, its sibling takes over before the other domain does
    assert mixing.budgets(supply, w, 400, 1) == {("x", "a"): 10, ("x", "b"): 290, ("y", "a"): 100}
    assert mixing.budgets(supply, w, 1800, 1) == {("x", "a"): 10, ("x", "b"): 1000, ("y", "a"): 790}
    assert mixing.budgets(supply, w, 10**6, 2) == {k: 2 * v for k, v in supply.items()}
    assert mixing.budgets(supply, mixing.Weights([{"y": 0}]), 500, 1)[("y", "a")] == 0


@pytest.mark.parametrize("bucket", [20_000, 5])
def test_mixture(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", bucket)
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["en", "de", None]), rng.choice("abc")) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    w = mixing.Weights([{"en": 3, "de": 1}, {"a": 2}], default=0.5)
    got = mixing.mixture(df, [F.col("lang"), F.col("source")], w, share=0.9, epochs=2, seed=8).collect()
    supply = {}
    for _, t, l, s in rows:
        supply[(l, s)] = supply.get((l, s), 0) + len(t.split())
    given = mixing.budgets(supply, w, int(sum(supply.values()) * 0.9), 2)
    hashed = {}
    for r in df.select("doc_id", "text", "lang", "source").collect():
        hashed.setdefault((r.lang, r.source), []).append(r)
    for leaf, docs in hashed.items():
        mine = [r for r in got if (r.level_0, r.level_1) == leaf]
        whole, rest = divmod(given[leaf], supply[leaf])
        times = {}
        for r in mine:
            times.setdefault(r.doc_id, set()).add(r.epoch)
        order = [r.doc_id for r in df.where(F.col("lang").eqNullSafe(leaf[0]) & (F.col("source") == leaf[1])).orderBy(F.xxhash64(F.lit(8), F.lit(whole).cast("long"), "doc_id", F.xxhash64("text"))).select("doc_id").collect()]
        size = {r.doc_id: len(r.text.split()) for r in docs}
        total, prefix = 0, set()
        for d in order:
            total += size[d]
            if not rest or total > rest:
                break
            prefix.add(d)
        assert {d: len(e) for d, e in times.items()} == {d: whole + (d in prefix) for d in size if whole + (d in prefix)}
        assert sum(r.n_tokens for r in mine) <= given[leaf]
    kept = mixing.mix(df, [F.col("lang"), F.col("source")], w, share=0.9, epochs=2, seed=8)
    assert kept.columns == df.columns and kept.count() == len(got)


@pytest.mark.parametrize("pieces", [20_000, 7])
def test_vector_recall(spark, monkeypatch, pieces):
    monkeypatch.setattr(ann, "QUERY_ROWS", pieces)
    monkeypatch.setattr(ann, "LIST_ROWS", pieces * 10)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(30, 24))
    x = (centre[rng.integers(0, 30, 4000)] + 0.5 * rng.normal(size=(4000, 24))).astype(np.float32)
    x[100:600] = x[100]  # one vector many times
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append(r)
    hits = total = 0
    y = x.astype(np.float64)
    for q in range(0, 4000, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        order = [i for i in np.lexsort([np.arange(4000), d]) if i != q][:10]
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert [r.score for r in mine] == sorted(r.score for r in mine)
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(order))
        total += 10
    assert hits / total >= 0.9
    # copies of one vector: the smallest other ids, in order
    assert [r.vec_id for r in sorted(got[300], key=lambda r: r.rank)] == list(range(100, 110))


def test_classifiers_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    lang = queries.QUERIES["op3_string_kernel"](spark, sf).join(docs, "doc_id").where("held_out")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
    known = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.QUERIES["op5_pu_quality"](spark, sf).join(known, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) >= 0.9


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = common.keep(out, "test")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    ours = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert {r.doc_id: list(r.ids) for r in last.collect()} == ours and len(ours) > 50
    classes = ngram_join.near_duplicates(common.table(spark, SF, "documents")).collect()
    seen = [r.class_id for r in classes if r.doc_id in ours]
    assert len(seen) == len(set(seen))
