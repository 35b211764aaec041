"""The whole pipeline against a plain version of each stage, and on odd rows."""

import itertools
import re

import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from hedgerow.llm import common, mixing, quality_pu, queries, sp_codec

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def good(spark, rows):
    model = quality_pu.train(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"))

    def score(t):
        raw, off = common.utf8(pa.array([t], pa.string()))
        return quality_pu._scores(raw, off, model)[0]

    return [r for r in rows if score(r["text"]) >= 0.3]


def one_of_each_class(rows):
    sets = {}
    for r in rows:
        w = words(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def first_passages(rows, n=50):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        w, later = words(r["text"]), set()
        for p in range(len(w) - n + 1):
            window = tuple(w[p : p + n])
            if window in seen:
                later.update(range(p, p + n))
            seen.add(window)
        if not later:
            out.append(r)
            continue
        at = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", r["text"])] + [len(r["text"])]
        text = r["text"][: at[0]] + "".join(r["text"][at[j] : at[j + 1]] for j in range(len(w)) if j not in later)
        if words(text):
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def mixed(spark, rows):
    leaf = lambda r: (queries.DOMAINS[int(m[0]) % 4 if (m := re.findall(r"[0-9]{1,9}$", r["source"] or "")) else 0], r["lang"], r["source"])
    supply = {}
    for r in rows:
        supply[leaf(r)] = supply.get(leaf(r), 0) + len(words(r["text"]))
    given = mixing.budgets(supply, queries.MIXTURE, int(sum(supply.values()) * corpus_pipeline.MIX_SHARE), 1)
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    place = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(9), F.lit(0).cast("long"), "doc_id", F.xxhash64("text")).alias("h")).collect()}
    out = []
    for name in supply:
        mine, left = sorted((r for r in rows if leaf(r) == name), key=lambda r: place[r["doc_id"]]), given[name]
        for r in mine:
            if supply[name] and given[name] >= supply[name]:
                out.append(r)
                continue
            left -= len(words(r["text"]))
            if left < 0 or not supply[name] or not given[name]:
                break
            out.append(r)
    return out


def test_pipeline_equals_plain_stages(spark):
    rows = [r.asDict() for r in common.table(spark, SF, "documents").collect()]
    for stage in (lambda r: good(spark, r), one_of_each_class, first_passages, lambda r: mixed(spark, r)):
        before, rows = len(rows), stage(rows)
        assert len(rows) <= before
    other = sp_codec.Codec(sp_codec.read_model(queries.vocabulary(queries.PIECES))).other
    want = {r["doc_id"]: other.encode(r["text"]) for r in rows}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()} == want and len(want) > 50


ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, doc string, removed string, copies long, tokens string, score double, h long, row long, x string, _text_key string, _removed string"
EXTRA = ("a", "b", "c", "d", 1, "e", 0.5, 2, 3, "f", "g", "h")


@pytest.fixture
def odd(spark, tmp_path):
    p = [" ".join(f"{c}{i}" for i in range(70)) for c in "pqr"]
    texts = [(1, p[0]), (1, p[0]), (2, f"head {p[0]}"), (None, p[1]), (None, p[1]), (3, None), (3, None), (4, ""), (5, " \n"), (6, "short"), (6, "short"), (7, "buy " * 5000), (8, p[2] + "\n" + p[2]), (9, "日本語" * 3000)]
    rows = [(i, t, ["en", None][k % 2], ["s1", None, "s2"][k % 3], len(t or ""), *EXTRA) for k, (i, t) in enumerate(texts)]
    labels = [(1, 1, 0), (2, 1, 0), (6, 1, 0), (7, 0, 0), (None, 1, None), (9, None, None), (8, 1, 0)]

    def make(name, n):
        spark.createDataFrame(rows[:n], ODD).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels[:n], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        return f"{tmp_path}/{name}"

    return make


def test_odd_rows(spark, odd):
    sf = odd("odd", 99)
    docs = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.keep(stage(spark, docs, sf), "test")
        got = out.collect()
        assert out.columns == docs.columns and len(got) <= docs.count(), name
        assert {tuple(r)[5:] for r in got} <= {EXTRA}
        docs = out
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(ids) == docs.count() and all(r.restored for r in ids)
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(ids)


def test_empty_table(spark, odd):
    sf = odd("none", 0)
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == 0 and out.columns == ["doc_id", "ids", "n_tokens", "restored"]
