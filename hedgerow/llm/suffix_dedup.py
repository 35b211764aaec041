"""Repeated passages of 50 words and more, by a sparse suffix array.

Suffixes are kept only where content selects them: each window of 50 words picks
the smallest hash among its 8-word grams (a minimiser), so two equal passages pick
equal positions. A kept suffix carries the stretch of all windows that picked it.
What a document repeats within itself (a run of one word, a table) is one row with
a list of places. Equal contexts are counted first, so copies collapse before they
move; the distinct ones are range-partitioned and sorted by (gram, context), and
neighbours in that order are compared. Neighbours with the same context repeat as a whole.
Neighbours with the same gram but different contexts are the ends of a repeat, or
near copies: there the match is extended left and right, window by window, from
the words of one document for each context. The result is exact up to 64-bit
hashes: every window of 50 words that occurs twice in the corpus is found.

Spans are word positions, end excluded. ``repeated`` covers all repeated windows
of a document, ``removed`` those that are not the first occurrence, in the order
of id, text hash and position.

A context that occurs once needs no join to find its place; the others meet their
places by key, hot contexts and windows by broadcast (``join_by_size``).

Defined cases: null, empty and shorter texts have no spans, an empty table gives an
empty one; a text of any length is read whole; a passage may repeat inside one
document; every row counts as a document, also if ids or whole rows repeat; a null
id sorts first; of equal ids the smaller text hash comes first. Columns other than
id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _powers, chunks, join_by_size, keep, mix, released, utf8, words

LENGTH = 50
GRAM = 8
_C = np.uint64(0xD6E8FEB86659FD93)


def _gram_hashes(w: np.ndarray) -> np.ndarray:
    g, step = w, 1
    while step < GRAM:
        if len(g) <= step:
            return np.empty(0, np.uint64)
        g = mix(g[:-step] * _C + g[step:])
        step *= 2
    return g


def _range_hashes(w: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(w))
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * power[: len(w)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def suffixes(w: np.ndarray, first: np.ndarray, length: int = LENGTH):
    """Kept suffixes of some texts: (gram, context, first window, last window) and the count per text.

    Positions are relative to the text.
    """
    n = len(w)
    none = np.empty(0, np.int64)
    span = length - GRAM + 1
    g = _gram_hashes(w)
    if len(g) < span:
        return none.view(np.uint64), none.view(np.uint64), none, none, np.zeros(len(first) - 1, np.int64)
    v = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    m, width = v, 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    p = np.flatnonzero(np.arange(len(m)) + length <= first[1:][doc[: len(m)]])
    if not len(p):
        return none.view(np.uint64), none.view(np.uint64), none, none, np.zeros(len(first) - 1, np.int64)
    at = (m[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.concatenate([[True], (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)])
    lo = p[head]
    hi = p[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(p) - 1]])]
    at = at[head]
    context = mix(_range_hashes(w, lo, hi + length) + mix(((hi - lo) * 4096 + (at - lo)).astype(np.uint64)))
    owner = doc[lo]
    return g[at], context, lo - first[owner], hi - first[owner], np.bincount(owner, minlength=len(first) - 1)


def _places(gram: np.ndarray, context: np.ndarray, lo: np.ndarray, hi: np.ndarray, counts: np.ndarray):
    """One row per text and context: the first place, and a list of the others (null where there are none)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((lo, context, owner))
    head = np.ones(len(order), bool)
    head[1:] = (owner[order][1:] != owner[order][:-1]) | (context[order][1:] != context[order][:-1])
    first = order[head]
    n = np.diff(np.append(np.flatnonzero(head), len(order))) - 1
    more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(lo[order[~head]].astype(np.int32)), mask=pa.array(n == 0))
    return gram[first], context[first], lo[first], hi[first], more, np.bincount(owner[first], minlength=len(counts))


def _scan(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(2))
            for at, to in chunks(off):
                w, first, _, _ = words(raw[off[at] : off[to]], off[at : to + 1])
                gram, context, lo, hi, more, counts = _places(*suffixes(w, first, length))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), more)]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), *lists], ["id", "tk", "gram", "context", "lo", "hi", "more"])
                yield out.filter(pa.array(counts > 0))

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark rows of a sorted partition whose neighbour has the same gram, and the partition's two ends."""

    def marked(batch: pa.RecordBatch, before, after, start: bool, end: bool) -> pa.RecordBatch:
        gram = batch.column("gram").to_numpy()
        same = gram[1:] == gram[:-1]
        near = np.concatenate([[before is not None and before == gram[0]], same]) | np.concatenate([same, [after is not None and after == gram[-1]]])
        edge = np.zeros(len(gram), bool)
        edge[0] |= start
        edge[-1] |= end
        out = batch.append_column("near", pa.array(near)).append_column("edge", pa.array(edge))
        return out.filter(pa.array(near | edge | (batch.column("copies").to_numpy() > 1)))

    held, before, start = None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield marked(held, before, batch.column("gram")[0].as_py(), start, False)
            before, start = held.column("gram")[-1].as_py(), False
        held = batch
    if held is not None:
        yield marked(held, before, None, start, True)


def _windows(length: int):
    """The window hashes of each asked-for context of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            asked = batch.column("asked").to_pylist()
            rows, lists = [], []
            for d, items in enumerate(asked):
                w, _, _, _ = words(raw[off[d] : off[d + 1]], off[d : d + 2])
                start = np.arange(max(0, len(w) - length + 1))
                h = _range_hashes(w, start, start + length).view(np.int64) if len(start) else start
                for x in items:
                    rows.append(x)
                    lists.append(h[x["lo"] : x["hi"] + 1])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
            flat = pa.array(np.concatenate(lists).astype(np.int64) if lists else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([r["gram"] for r in rows], pa.int64()), pa.array([r["context"] for r in rows], pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["gram", "context", "window"])

    return run


def _union(p: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Word ranges covered by windows that start at the sorted positions."""
    if not len(p):
        return []
    head = np.concatenate([[True], p[1:] > p[:-1] + length])
    start = p[head]
    end = p[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(p) - 1]])] + length
    return list(zip(start.tolist(), end.tolist(), strict=True))


def _spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            repeated, removed = [], []
            for parts in batch.column("parts").to_pylist():
                every, later = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for x in parts:
                    if x["offs"] is None:
                        p = np.arange(x["hi"] - x["lo"] + 1)
                        own = np.full(len(p), x["first"])
                    else:
                        p = np.array([o >> 1 for o in x["offs"]], np.int64)
                        own = np.array([o & 1 for o in x["offs"]], bool) & x["first"]
                    every.append(p + x["lo"])
                    later.append(p[~own] + x["lo"])
                    if x["more"]:
                        again = (np.array(x["more"], np.int64)[:, None] + p).ravel()
                        every.append(again)
                        later.append(again)
                repeated.append([{"start": a, "end": b} for a, b in _union(np.unique(np.concatenate(every)), length)])
                removed.append([{"start": a, "end": b} for a, b in _union(np.unique(np.concatenate(later)), length)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tk"), pa.array(repeated, kind), pa.array(removed, kind)], ["id", "tk", "repeated", "removed"])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document that holds a repeated passage: doc_id, text_hash, repeated, removed (spans of words)."""
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    scanned = T.StructType([T.StructField("id", kind), T.StructField("tk", T.LongType()), T.StructField("gram", longs), T.StructField("context", longs), T.StructField("lo", ints), T.StructField("hi", ints), T.StructField("more", T.ArrayType(ints))])
    rows = keep(source.mapInArrow(released(_scan(length)), scanned).select(F.monotonically_increasing_id().alias("rid"), "*"), "suffix-rows")
    kept = rows.select("rid", "id", "tk", F.explode(F.arrays_zip("gram", "context", "lo", "hi", "more")).alias("x")).select("rid", "id", "tk", "x.*")

    order = lambda lo: F.struct(F.col("id"), F.col("tk"), F.col("rid"), lo.alias("lo"))
    copies = F.sum(F.when(F.col("more").isNull(), 1).otherwise(1 + F.size("more")))
    contexts = kept.groupBy("gram", "context").agg(copies.alias("copies"), F.count(F.lit(1)).alias("n_rows"), F.min(F.struct("id", "tk", "rid", "lo", "hi")).alias("first"))
    ordered = contexts.select("gram", "context", "copies", "n_rows", "first.*").repartitionByRange("gram", "context").sortWithinPartitions("gram", "context")
    marked = T.StructType([*ordered.schema.fields, T.StructField("near", T.BooleanType()), T.StructField("edge", T.BooleanType())])
    array = keep(ordered.mapInArrow(released(_neighbours), marked).withColumn("part", F.spark_partition_id()), "suffix-array")
    # a gram that goes on in the next partition stands at the ends of both; two rows of each partition at most
    across = array.where("edge").groupBy("gram").agg(F.count_distinct("part").alias("parts")).where("parts > 1").select("gram", F.lit(True).alias("across"))
    array = array.join(F.broadcast(across), "gram", "left").select("*", (F.col("near") | F.coalesce("across", F.lit(False))).alias("multi"))

    ends = array.where("multi").select("gram", "context", "copies", "id", "tk", "rid", "lo", "hi")
    asked = ends.groupBy("id", "tk").agg(F.collect_list(F.struct("gram", "context", "lo", "hi")).alias("asked"))
    texts = source.alias("s").join(asked.alias("a"), (F.col("s.tk") == F.col("a.tk")) & F.col("s.id").eqNullSafe(F.col("a.id"))).select("s.text", "asked")
    hashed = texts.mapInArrow(released(_windows(length)), "gram long, context long, window array<long>").groupBy("gram", "context").agg(F.first("window").alias("window"))
    wide = keep(ends.join(hashed, ["gram", "context"]).select("gram", "context", "copies", "id", "tk", "rid", "lo", F.posexplode("window").alias("off", "window")), "suffix-windows")
    shared = wide.groupBy("window").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("n_rows"), F.min(order(F.col("lo") + F.col("off"))).alias("first")).where("n > 1")
    shared = keep(shared.select("window", "n_rows", "first"), "suffix-shared")
    found = join_by_size(wide, shared, ["window"], "n_rows", wide.count()).select("gram", "context", (F.col("off") * 2 + (order(F.col("lo") + F.col("off")) == F.col("first")).cast("int")).alias("o"))
    parts = found.groupBy("gram", "context").agg(F.collect_list("o").alias("offs"))
    place = ["gram", "context", "copies", "n_rows", "id", "tk", "rid", "lo", "hi"]
    whole = array.where("not multi and copies > 1").select(*place, F.lit(None).cast("array<int>").alias("offs"))
    verdicts = keep(whole.union(array.where("multi").select(*place).join(parts, ["gram", "context"]).select(*place, "offs")), "suffix-verdicts")

    once = verdicts.where("copies = 1").select("rid", "id", "tk", F.struct("lo", "hi", F.lit(None).cast("array<int>").alias("more"), "offs", F.lit(True).alias("first")).alias("part"))
    often = verdicts.where("copies > 1").select("gram", "context", "n_rows", F.col("rid").alias("first_rid"), "offs")
    total = often.agg(F.sum("n_rows")).first()[0] or 0
    hit = join_by_size(kept, often, ["gram", "context"], "n_rows", total)
    every = once.union(hit.select("rid", "id", "tk", F.struct("lo", "hi", "more", "offs", (F.col("rid") == F.col("first_rid")).alias("first")).alias("part")))
    per_doc = every.groupBy("rid", "id", "tk").agg(F.collect_list("part").alias("parts"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = T.StructType([T.StructField("id", kind), T.StructField("tk", T.LongType()), T.StructField("repeated", span), T.StructField("removed", span)])
    return per_doc.select("id", "tk", "parts").mapInArrow(released(_spans(length)), out).select(F.col("id").alias("doc_id"), F.col("tk").alias("text_hash"), "repeated", "removed")


def span_words(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])


def _cut(text: str, spans) -> str:
    """The text without the words of the spans and the white space after each."""
    raw = text.encode()
    _, _, start, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    out, at = [], 0
    for s in spans:
        out.append(raw[at : start[s["start"]]])
        at = int(start[s["end"]]) if s["end"] < len(start) else len(raw)
    return b"".join([*out, raw[at:]]).decode()


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", length: int = LENGTH) -> DataFrame:
    """The documents without their repeated passages, but for the first occurrence of each.

    A text of which nothing is left goes; other texts keep all their columns. Of rows
    with the same id and text one is cut as the first of them; nothing is left of the
    others, whose every window occurs in the first.
    """
    found = repeated_passages(docs, id_col, text_col, length)
    # the first of some copies loses least
    least = found.groupBy("doc_id", "text_hash").agg(F.min_by("removed", span_words("removed")).alias("removed"), F.count(F.lit(1)).alias("copies")).where("copies > 1 or size(removed) > 0")
    least = keep(least.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("tk"), "removed", "copies"), "suffix-cuts")
    names = docs.columns
    # the document is one struct, so no column of its can clash with those of the plan
    keyed = docs.select(F.struct(*[F.col(c).alias(c) for c in names]).alias("doc"), F.col(id_col).alias("doc_key"), F.xxhash64(text_col).alias("text_key"))
    joined = keyed.join(least, (F.col("text_key") == F.col("tk")) & F.col("doc_key").eqNullSafe(F.col("id")), "left")
    if not least.where("copies > 1").isEmpty():
        copied = F.coalesce(F.col("copies") > 1, F.lit(False))
        number = F.row_number().over(Window.partitionBy("text_key", "doc_key").orderBy(*[F.col("doc")[f.name] for f in docs.schema if isinstance(f.dataType, T.AtomicType) and f.name != text_col] or [F.lit(1)]))
        joined = joined.where(~copied).unionByName(joined.where(copied).select("*", number.alias("number")).where("number = 1").drop("number"))

    t, n = names.index(text_col), names.index(length_col) if length_col in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, spans = batch.column("doc").flatten(), batch.column("removed").to_pylist()
            keep_row = None
            if any(spans):
                texts = [x if not s else _cut(x, s) for x, s in zip(columns[t].to_pylist(), spans, strict=True)]
                keep_row = pa.array([not s or bool(x.strip()) for x, s in zip(texts, spans, strict=True)])
                if n >= 0:
                    sizes = [len(x) if s else c for x, s, c in zip(texts, spans, columns[n].to_pylist(), strict=True)]
                    columns[n] = pa.array(sizes, columns[n].type)
                columns[t] = pa.array(texts, columns[t].type)
            out = pa.RecordBatch.from_arrays(columns, names)
            yield out if keep_row is None else out.filter(keep_row)

    return joined.select("doc", "removed").mapInArrow(released(run), docs.schema)


ORACLE = r"""
with w as (
  select doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), g as (
  select doc_id, unnest(range(1, len(w) - 48)) as p, w from w where len(w) >= 50
), h as (
  select doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as x from g
), d as (
  select doc_id, p, count(*) over (partition by x) as n, row_number() over (partition by x order by doc_id, p) as k from h
), c as (
  select distinct doc_id, unnest(range(p, p + 50)) as j from d where n > 1
), c2 as (
  select distinct doc_id, unnest(range(p, p + 50)) as j from d where n > 1 and k > 1
), i as (
  select doc_id, count(*) as repeated_words, sum((b is null or j > b + 1)::int) as n_spans
  from (select doc_id, j, lag(j) over (partition by doc_id order by j) as b from c) group by doc_id
), r as (select doc_id, count(*) as removed_words from c2 group by doc_id)
select i.doc_id, n_spans::bigint as n_spans, repeated_words::bigint as repeated_words, coalesce(removed_words, 0)::bigint as removed_words from i left join r using (doc_id)
"""
