"""What Python workers hold while another operator's tasks run in them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hedgerow.llm import common, mixing, queries, sp_codec


def _model():
    return sp_codec.read_model(queries.vocabulary(queries.PIECES))


def test_another_operators_task_drops_the_codec():
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    c = sp_codec.codec(_model())
    assert list(common.released(lambda b: b, "sentencepiece")(iter([batch]))) == [batch]
    assert sp_codec.codec(_model()) is c
    task = common.released(lambda b: b)(iter([batch]))
    next(task)
    assert not sp_codec._CODECS


def test_a_task_leaves_no_tables_of_powers():
    raw, off = common.utf8(pa.array(["some words"] * 1000))
    want = common.words(raw, off)[0]
    list(common.released(lambda b: b)(iter([])))
    assert sum(len(x) for x in common._POWERS) == 2
    assert np.array_equal(common.words(raw, off)[0], want)


def test_new_words_are_learnt_some_at_a_time():
    c, sizes = sp_codec.Codec(_model()), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **kw):
            sizes.append(len(texts))
            return self.inner.encode_batch_fast(texts, **kw)

    c.tokenizer, words = Counted(c.tokenizer), [f"w{i}" for i in range(9000)]
    assert np.frombuffer(c.encode([" ".join(words)])[0], np.int32).tolist() == c.other.encode(" ".join(words))
    assert sum(sizes) == 9000 and max(sizes) <= 2000


def test_the_mixture_starts_no_python_worker(spark, capsys):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 > 0, "x").alias("source"))
    for rows, n in ((docs, 20), (docs.limit(0), 0)):
        out = mixing.mix(rows, [F.col("source")], mixing.Weights([{"x": 1.0}]), share=0.5)
        assert abs(out.count() - n) <= 1
        out.explain()
        assert "ExistingRDD" not in capsys.readouterr().out
