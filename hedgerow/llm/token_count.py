"""Token counts and ids of a byte-level BPE, with a shortcut for whole tokens.

Before the run the driver proves, by encoding each vocabulary string alone, which
of them are one pre-token and encode as exactly one token. A worker counts those
pre-tokens as one without calling the tokenizer; only the rest is merged by the
library, once for each distinct string in a cache of bounded size.

Texts are cut at single spaces between other characters: there the
pre-tokeniser always starts a new piece, so the parts are independent. Texts with
other white space go through the pre-token pattern, and texts with a special
string or with characters outside the proven range go to the library as a whole.

Defined cases: a null text is an empty one with 0 tokens; a text of any length is
counted whole; an empty table gives an empty one; ids may be null or repeat, each row
gives a row; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, small_batches, utf8

LIMIT = 512
#: Distinct strings that a worker remembers before it starts anew, and the longest of them: both bound its memory.
CACHE = 250_000
CACHED_CHARS = 64
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRE = regex.compile(PATTERN)
#: Characters whose class no Unicode version and no regular-expression library disputes.
_UNSAFE = re.compile("[^\n -~¡-ſ]")


def _unicode_of_bytes() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable ones as they are, others from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(spec: str) -> dict[str, int]:
    """Vocabulary strings that are one pre-token and encode alone as one token, with their ids.

    Refuses a tokenizer whose normaliser or pre-tokeniser is not the plain
    byte-level one, for which alone the cuts at spaces are proven.
    """
    from tokenizers import Tokenizer

    parsed = json.loads(spec)
    pre = parsed.get("pre_tokenizer") or {}
    if parsed.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("the whole-token shortcut is proven for plain byte-level tokenizers only")
    tokenizer, back = Tokenizer.from_str(spec), _unicode_of_bytes()
    found = []
    for piece in parsed["model"]["vocab"]:
        if all(c in back for c in piece):
            try:
                text = bytes(back[c] for c in piece).decode()
            except UnicodeDecodeError:
                continue
            if not _UNSAFE.search(text) and _PRE.findall(text) == [text]:
                found.append(text)
    specials = {x["content"] for x in parsed["added_tokens"]}
    encoded = tokenizer.encode_batch(found, add_special_tokens=False)
    return {t: e.ids[0] for t, e in zip(found, encoded, strict=True) if len(e.ids) == 1 and t not in specials}


class Encoder:
    """Counts (or encodes) texts exactly as the library does."""

    def __init__(self, spec: str, whole: dict[str, int]):
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_str(spec), whole
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x["content"] for x in json.loads(spec)["added_tokens"]]
        self.pre: dict[str, bytes] = {t: np.int32(i).tobytes() for t, i in whole.items()}
        self.parts: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def _pieces(self, text: str) -> bytes:
        out = []
        for p in _PRE.findall(text):
            if (ids := self.pre.get(p)) is None:
                ids = self._library(p)
                if len(p) <= CACHED_CHARS:
                    self.pre[p] = ids
            out.append(ids)
        return b"".join(out)

    def _room(self) -> None:
        if len(self.parts) > CACHE or len(self.counts) > CACHE or len(self.pre) > CACHE:
            self.parts, self.counts, self.pre = {}, {}, {t: np.int32(i).tobytes() for t, i in self.whole.items()}

    def _way(self, text: str) -> str:
        if not text or any(s in text for s in self.special) or _UNSAFE.search(text):
            return "library"
        if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
            return "pieces"
        return "parts"

    def count(self, text: str) -> int:
        way = self._way(text)
        if way == "library":
            return len(self._library(text)) // 4 if text else 0
        if way == "pieces":
            return len(self._pieces(text)) // 4
        parts, counts = text.split(" "), self.counts
        n = len(self._pieces(parts.pop(0))) // 4
        try:
            return n + sum(map(counts.__getitem__, parts))
        except KeyError:
            for p in parts:
                if (m := counts.get(p)) is None:
                    m = len(self._pieces(" " + p)) // 4
                    if len(p) <= CACHED_CHARS:
                        counts[p] = m
                n += m
            return n

    def encode(self, text: str) -> bytes:
        """The ids as consecutive native 32-bit integers."""
        way = self._way(text)
        if way == "library":
            return self._library(text) if text else b""
        if way == "pieces":
            return self._pieces(text)
        parts, known = text.split(" "), self.parts
        out = [self._pieces(parts.pop(0))]
        for p in parts:
            if (ids := known.get(p)) is None:
                ids = self._pieces(" " + p)
                if len(p) <= CACHED_CHARS:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)


_ENCODERS: dict[int, Encoder] = {}


def encoder(spec: str, whole: dict[str, int]) -> Encoder:
    """One encoder for each tokenizer and worker process, with its cache."""
    import zlib

    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec, whole)
    _ENCODERS[key]._room()
    return _ENCODERS[key]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    # the vocabulary is sent once to each executor; its size is the file's, whatever the corpus
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((spec, whole_tokens(spec)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = utf8(batch.column(1))
            for at, to in chunks(off):
                enc = encoder(*shared.value)
                n = pa.array([enc.count(t or "") for t in batch.column(1).slice(at, to - at).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(np.diff(off[at : to + 1])), n], ["doc_id", "n_bytes", "n_tokens"])

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, out).select("*", (F.col("n_tokens") > limit).alias("over_limit"))
