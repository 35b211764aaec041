"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file's protobuf gives the pieces, scores and flags, from which the
normaliser, the white-space marker, the model (unigram scores, or merges in the
order of scores for BPE models) and the byte fallback are rebuilt. Where no piece
has a marker after another character - proven at load - a text is encoded by its
marked words, each distinct word once per worker, which gives the same ids as the
text as a whole. New words are encoded in batches of some thousand, and each is
checked against the sentencepiece library; a difference is an error.

Defined cases: a null text is an empty one without ids; a text of any length is
encoded whole; an empty table gives an empty one; ids may be null or repeat, each row
gives a row; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, give_back, released, remembered, small_batches, utf8

MARK = "▁"
#: Words that a worker remembers before it starts anew, and the longest of them: both bound its memory.
CACHE = 250_000
CACHED_CHARS = 64
#: New words that both libraries encode at a time, and bytes of text that are cut into words at a time.
LEARN_WORDS = 2_000
SPLIT_BYTES = 1 << 18

#: Fixed values of the model format: kinds of pieces and of models.
_UNKNOWN, _CONTROL, _BYTE = 2, 3, 6
_UNIGRAM, _BPE = 1, 2


def _proto(model: bytes):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    return m


def _merges(pieces, ids: dict[str, int]) -> list[tuple[str, str]]:
    """All ways to join two pieces into a third, by the third's score, then by the halves' ids."""
    out = []
    for p in pieces:
        if p.type not in (_UNKNOWN, _CONTROL, _BYTE) and len(p.piece) > 1:
            ways = [(p.piece[:i], p.piece[i:]) for i in range(1, len(p.piece))]
            out += [(-p.score, ids[a], ids[b], a, b) for a, b in ways if a in ids and b in ids]
    return [(a, b) for *_, a, b in sorted(out)]


def build(model: bytes):
    """A tokenizers.Tokenizer that encodes and decodes as the model file says."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

    m = _proto(model)
    ids = {p.piece: i for i, p in enumerate(m.pieces)}
    unknown = next(i for i, p in enumerate(m.pieces) if p.type == _UNKNOWN)
    fallback = m.trainer_spec.byte_fallback
    if m.trainer_spec.model_type == _BPE:
        core = models.BPE(ids, _merges(m.pieces, {p.piece: i for i, p in enumerate(m.pieces) if p.type not in (_UNKNOWN, _CONTROL, _BYTE)}), unk_token=m.pieces[unknown].piece, fuse_unk=True, byte_fallback=fallback)
    elif m.trainer_spec.model_type == _UNIGRAM:
        core = models.Unigram([(p.piece, p.score) for p in m.pieces], unknown, fallback)
    else:
        raise ValueError("only unigram and BPE models are known")
    spec, steps = m.normalizer_spec, []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        from tokenizers import Regex

        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    t = Tokenizer(core)
    t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else [])])
    user = [p.piece for p in m.pieces if p.type == 4]
    if user:
        t.add_tokens([AddedToken(x, normalized=False) for x in user])
    return t


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece

        m = _proto(model)
        self.tokenizer, self.other = build(model), sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = m.normalizer_spec
        self.prefix = spec.add_dummy_prefix
        self.by_word = (
            self.prefix and spec.escape_whitespaces and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
            and not any(MARK in p.piece.lstrip(MARK) or p.type == 4 for p in m.pieces)
        )
        # a marker alone, as behind a last space; the normaliser gives an empty text none
        self.lone = {"": np.array([t.id for t in self.tokenizer.model.tokenize(MARK)], np.int32).tobytes()} if self.by_word else {}
        self.known: dict[str, bytes] = dict(self.lone)
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else b"" if p.type == _CONTROL else m.trainer_spec.unk_surface.encode() if p.type == _UNKNOWN else p.piece.replace(MARK, " ").encode() for p in m.pieces]

    def _learn(self, texts: list[str]) -> dict[str, bytes]:
        """Encode texts that are new, some at a time; each is compared with the other library."""
        out: dict[str, bytes] = {}
        for at in range(0, len(texts), LEARN_WORDS):
            out |= self._checked(texts[at : at + LEARN_WORDS])
        return out

    def _checked(self, texts: list[str]) -> dict[str, bytes]:
        encoded, other = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], self.other.encode(texts, num_threads=1)
        if encoded != other:
            text, ours, theirs = next(x for x in zip(texts, encoded, other, strict=True) if x[1] != x[2])
            raise ValueError(f"the backend encodes {text!r} as {ours}, sentencepiece as {theirs}")
        raw = np.fromiter(itertools.chain.from_iterable(encoded), np.int32).tobytes()
        ends = list(itertools.accumulate((4 * len(ids) for ids in encoded), initial=0))
        return {text: raw[a:b] for text, a, b in zip(texts, ends, ends[1:], strict=False)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as consecutive native 32-bit integers."""
        if len(self.known) > CACHE:
            self.known = dict(self.lone)
        split = [self._words(t) for t in texts]
        known, long = self.known, {}
        if missing := list({w for words in split for w in words} - known.keys()):
            new = self._learn(missing)
            long = {w: ids for w, ids in new.items() if len(w) > CACHED_CHARS}
            known.update((w, ids) for w, ids in new.items() if w not in long)
        ids = (lambda w: long[w] if w in long else known[w]) if long else known.__getitem__
        return [b"".join(map(ids, words)) for words in split]

    def _words(self, text: str) -> list[str]:
        """Parts that are encoded one by one; each stands for itself behind one marker."""
        if not text:
            return []
        if not self.by_word:
            return [text]
        if text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, np.int32).tolist()))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode(errors="replace")


_CODECS: dict[int, Codec] = remembered("sentencepiece")


def codec(model: bytes) -> Codec:
    import zlib

    key = zlib.crc32(model)
    if key not in _CODECS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would hold memory of its own
        _CODECS[key] = Codec(model)
        give_back()  # what the model file was parsed into
    return _CODECS[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, n_tokens, restored (whether decoding gives the text again)."""
    # the model is sent once to each executor; its size is the file's, whatever the corpus
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = utf8(batch.column(1))
            for at, to in chunks(off, SPLIT_BYTES):
                c = codec(shared.value)
                texts = [t or "" for t in batch.column(1).slice(at, to - at).to_pylist()]
                ids = c.encode(texts)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists, pa.array(n), pa.array([c.decode(x) == t for x, t in zip(ids, texts, strict=True)])], ["doc_id", "ids", "n_tokens", "restored"])

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("restored", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(released(run, "sentencepiece"), out)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts of id lists: doc_id, text; null ids give a null text, ids outside the model are an error."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = codec(shared.value)
            texts = [None if x is None else c.decode(np.array(x, np.int32).tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(released(run, "sentencepiece"), T.StructType([T.StructField("doc_id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())]))
