"""Near-duplicate join: n-gram Jaccard similarity by MinHash banding, verified on full sets.

Texts are compared as sets of five-word n-grams. Band and row counts follow from
the similarity and the wanted recall. Texts meet in the buckets of their band hashes,
and a pair counts in the first band that the two share, there and nowhere else. A
bucket is gone through twice. First sketches are compared (one byte of each minimum
that the bands were made of, a thirtieth of a text's n-grams): a pair that could still
belong to the wanted similarity, but for a chance of ``MISS``, marks its two texts. Only
marked texts bring their full n-gram sets to the bucket, where their pairs are verified by
matrix products. What leaves a bucket are counts of links and spanning edges of verified
links, never pairs; classes are the components of those. So texts that share only a
template, and often meet in a bucket, never make a group of any size.

Buckets are cut into blocks of bounded numbers of texts and n-grams; a text goes to each
pair of blocks it belongs to. Exact copies are one text from the start: they are
counted, not compared.

Defined cases: a text without words (or null) links to nothing and is its own
class; a text of one to four words has one n-gram, all its words; a text of any
length is read whole; an empty table gives an empty one; every row counts as a
document, also if ids or whole rows repeat; a null id takes part, and a class takes
the smallest id that is not null. Columns other than id and text are not read,
whatever their names. Word case and punctuation count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgerow.operators.graph import components

from .common import chunks, grams, join_by_size, keep, mix, released, utf8, words

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
#: Texts and n-grams in a block of the verification.
BLOCK_TEXTS = 512
BLOCK_GRAMS = 1_000_000
#: Texts of a bucket that meet at a time, and the chance that a pair at the threshold seems too unlike by its sketches.
BUCKET_TEXTS = 4096
MISS = 1e-4
#: Rows and bytes of sorted groups that are worked on at a time.
GATHER_ROWS = 4096
GATHER_BYTES = 1 << 22


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows per band): most rows, so fewest false candidates, that reach the recall at the threshold."""
    found = None
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-hit))
        if bands * rows <= max_hashes:
            found = bands, rows
    if not found:
        raise ValueError(f"{max_hashes} hashes can't reach a recall of {recall} at {threshold}")
    return found


def shingles(raw: np.ndarray, off: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes of all texts in order, first n-gram of each text); repeats are kept."""
    w, first, _, _ = words(raw, off)
    g = grams(w, size)
    valid = np.ones(len(g), bool)
    for j in range(1, size):
        at = first[1:] - j
        valid[at[(at >= 0) & (at < len(g))]] = False
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, n > 0)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    out = np.empty(bounds[-1], np.uint64)
    short = np.flatnonzero((n > 0) & (n < size))
    fill = np.ones(len(out), bool)
    for d in short:
        fill[bounds[d]] = False
        out[bounds[d]] = grams(w[first[d] : first[d + 1]], int(n[d]))[0] ^ np.uint64(n[d])
    out[fill] = g[valid]
    return out, bounds


def plausible(threshold: float, slots: int, miss: float = MISS) -> int:
    """Equal slots that a pair at the threshold has but for a chance of ``miss``."""
    chance = 0.0
    for k in range(slots + 1):
        chance += math.comb(slots, k) * threshold**k * (1 - threshold) ** (slots - k)
        if chance > miss:
            return k
    return slots


def signatures(g: np.ndarray, bounds: np.ndarray, bands: int, rows: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes [texts x bands] and sketches [texts x bands * rows] of texts that all have an n-gram."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64)
    out, sketch = np.empty((len(bounds) - 1, bands), np.uint64), np.empty((len(bounds) - 1, bands * rows), np.uint8)
    x = np.empty_like(g)
    for i in range(bands):
        h = np.full(len(bounds) - 1, i + 1, np.uint64)
        for j in range(rows):
            np.multiply(g, a[i, j], out=x)
            np.bitwise_xor(x, b[i, j], out=x)
            least = np.minimum.reduceat(x, bounds[:-1])
            sketch[:, i * rows + j] = mix(least).astype(np.uint8)
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + least)
        out[:, i] = h
    return out.view(np.int64), sketch


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(2))
            for at, to in chunks(off):
                g, bounds = shingles(raw[off[at] : off[to]], off[at : to + 1])
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                flat, sketches = np.empty(0, np.int64), np.full(to - at, b"", object)
                if len(some):
                    flat, sketch = signatures(g, np.append(bounds[:-1][some], bounds[-1]), bands, rows)
                    sketches[some] = [x.tobytes() for x in sketch]
                sizes = np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(n.astype(np.int64)), lists, pa.array(sketches, pa.binary())], ["id", "key", "n", "bands", "sketch"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows: some thousand rows, a large group alone."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < GATHER_ROWS and size < GATHER_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(rows, bool)
        for c in key:
            x = table.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        if len(starts):  # the last group may go on
            yield table.slice(0, int(starts[-1]))
            held = table.slice(int(starts[-1])).to_batches()
            rows, size = rows - int(starts[-1]), sum(b.nbytes for b in held)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(table: pa.Table, key: list[str]) -> np.ndarray:
    """First row of each group, and the end."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in key:
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """[rows x values] of a column of equally long byte strings or lists."""
    if pa.types.is_list(column.type):
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


GROUP = ["band", "a", "b"]


def _meet(need: int):
    """Texts of a bucket (or of two blocks of it) that have a plausible partner there: a pair counts in the first band it shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, GROUP):
            bounds = _bounds(table, GROUP)
            sketch, bands = _matrix(table.column("sketch"), np.uint8), _matrix(table.column("bands"), np.int64)
            pos, side = table.column("pos").to_numpy(), table.column("side").to_numpy()
            cross = table.column("a").to_numpy() != table.column("b").to_numpy()
            found = np.zeros(table.num_rows, bool)
            two = bounds[:-1][np.diff(bounds) == 2]  # most buckets: all at once
            like = (sketch[two] == sketch[two + 1]).sum(1) >= need
            first = (bands[two] == bands[two + 1]).argmax(1) == pos[two]
            hit = two[like & first & (~cross[two] | (side[two] != side[two + 1]))]
            found[hit] = found[hit + 1] = True
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo <= 2:
                    continue
                own, code, where = sketch[lo:hi], bands[lo:hi], found[lo:hi]
                for i in range(hi - lo - 1):
                    near = i + 1 + np.flatnonzero((own[i + 1 :] == own[i]).sum(1, dtype=np.int16) >= need)
                    if cross[lo]:
                        near = near[side[lo:hi][near] != side[lo + i]]
                    near = near[(code[near] == code[i]).argmax(1) == pos[lo]]
                    if len(near):
                        where[i] = True
                        where[near] = True
            yield table.select(["band", "pos", "rid"]).filter(pa.array(found)).combine_chunks().to_batches(max_chunksize=10_000)[0] if found.any() else pa.RecordBatch.from_pylist([], table.select(["band", "pos", "rid"]).schema)

    return run


def _in_blocks(rows: DataFrame, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks it is part of: side (its block), a and b (the pair)."""
    side = F.pmod(F.hash("rid"), F.col(blocks))
    each = rows.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return each.withColumn("a", F.least("side", "other")).withColumn("b", F.greatest("side", "other")).drop("other", blocks)


def plausible_members(texts: DataFrame, threshold: float, slots: int) -> DataFrame:
    """(band, pos, rid): texts that have a plausible partner in a bucket which is the first that the two share."""
    banded = texts.select("rid", F.posexplode("bands").alias("pos", "band"))
    buckets = keep(banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "ngram-buckets")
    total = buckets.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    members = join_by_size(banded, buckets, ["band"], "m", total).withColumn("blocks", F.ceil(F.col("m") / BUCKET_TEXTS).cast("int")).drop("m")
    dealt = _in_blocks(members.join(texts.select("rid", "sketch", "bands"), "rid"), "blocks").repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = dealt.select(*GROUP, "pos", "side", "rid", "sketch", "bands").mapInArrow(released(_meet(plausible(threshold, slots))), "band long, pos int, rid long")
    return keep(found.distinct(), "ngram-members")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each text by its sorted set of n-gram hashes."""
    for batch in batches:
        raw, off = utf8(batch.column("text"))
        sets = []
        for at, to in chunks(off):
            g, bounds = shingles(raw[off[at] : off[to]], off[at : to + 1])
            sets += [np.unique(g[bounds[i] : bounds[i + 1]]).tobytes() for i in range(to - at)]
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, "grams", pa.array(sets, pa.binary()))


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by products of incidence blocks."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    code = np.cumsum(new) - 1
    shared = np.bincount(code)[code] > 1
    owner, code = owner[shared], code[shared]
    if len(code):
        code = np.cumsum(np.concatenate([[0], (np.diff(code) != 0).astype(np.int64)]))
        for lo in range(0, int(code[-1]) + 1, width):
            a, b = np.searchsorted(code, [lo, lo + width])
            block = np.zeros((m, min(width, int(code[-1]) + 1 - lo)), np.float32)
            block[owner[a:b], code[a:b] - lo] = 1
            out += block @ block.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _linked(rid: np.ndarray, copies: np.ndarray, side: np.ndarray, bands: np.ndarray, pos: int, sets: list[np.ndarray], cross: bool, threshold: float):
    """(rid, links to other texts by documents, local root) of the texts of a block that have a link; a pair counts in the first band it shares."""
    both = overlaps(sets).astype(np.float64)
    size = np.diag(both)
    near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(near, False)
    if cross:
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(near)
    for lo in range(0, len(i), 1 << 16):  # the pairs that are links, some at a time
        part = slice(lo, lo + (1 << 16))
        near[i[part], j[part]] = (bands[i[part]] == bands[j[part]]).argmax(1) == pos
    links = near @ copies
    some = np.flatnonzero(near.any(1))
    root = np.arange(len(rid))
    near, root = near[np.ix_(some, some)], root[: len(some)]
    while len(some):
        low = np.minimum(root, np.where(near, root[None, :], len(some)).min(1))
        if (low == root).all():
            break
        root = low
    return rid[some], links[some], rid[some][root]


def _verify(threshold: float):
    """Links of the texts of a bucket (or of two blocks of it) on full n-gram sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, GROUP):
            bounds = _bounds(table, GROUP)
            bands = _matrix(table.column("bands"), np.int64)
            rid, copies, side, pos, a, b = (table.column(c).to_numpy() for c in ("rid", "copies", "side", "pos", "a", "b"))
            grams_ = table.column("grams").combine_chunks()
            out = []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                sets = [np.frombuffer(x, np.uint64) for x in grams_.slice(lo, hi - lo).to_pylist()]
                if hi - lo == 2:
                    shared = len(np.intersect1d(*sets, assume_unique=True))
                    near = shared >= threshold * (len(sets[0]) + len(sets[1]) - shared) - 1e-9
                    if near and (bands[lo] == bands[lo + 1]).argmax() == pos[lo] and (a[lo] == b[lo] or side[lo] != side[lo + 1]):
                        out.append((rid[lo : lo + 2], copies[lo : lo + 2][::-1], np.full(2, rid[lo : lo + 2].min())))
                elif hi - lo > 2:
                    out.append(_linked(rid[lo:hi], copies[lo:hi], side[lo:hi], bands[lo:hi], int(pos[lo]), sets, a[lo] != b[lo], threshold))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out]).astype(np.int64)) for i in range(3)], ["rid", "links", "root"])

    return run


def verified_links(texts: DataFrame, source: DataFrame, member: DataFrame, threshold: float) -> DataFrame:
    """(rid, links, root): for each bucket (or block of it) its texts with a link there, their number of links, and an edge."""
    sized = member.join(texts.select("rid", "n"), "rid")
    blocks = keep(sized.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks")).where("m > 1"), "ngram-blocks")
    total = blocks.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    dealt = _in_blocks(join_by_size(member, blocks, ["band"], "m", total).drop("m"), "blocks")
    wanted = texts.join(member.select("rid").distinct(), "rid", "left_semi").select("rid", "key", "first_id", "copies", "bands")
    chosen = source.alias("s").join(wanted.alias("m"), (F.col("s.key") == F.col("m.key")) & F.col("s.id").eqNullSafe(F.col("m.first_id"))).select("rid", "copies", "bands", "text").dropDuplicates(["rid"])
    sets = keep(chosen.mapInArrow(released(_sets), "rid long, copies long, bands array<long>, grams binary"), "ngram-sets")
    ready = dealt.join(sets, "rid").repartition(*GROUP).sortWithinPartitions(*GROUP, "rid")
    return keep(ready.select(*GROUP, "pos", "side", "rid", "copies", "bands", "grams").mapInArrow(released(_verify(threshold)), "rid long, links long, root long"), "ngram-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, text_key, class_id (smallest id of its class), n_links, n_copies.

    ``n_links`` counts the other documents whose similarity to this one is at
    least ``threshold``, copies included; a class is a connected set of links.
    ``text_key`` is the md5 of the text, null for a text without words.
    """
    return classes(docs, id_col, text_col, threshold, recall).drop("class_key")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``near_duplicates`` and ``class_key``, the smallest text key of the class, which tells classes apart if ids repeat."""
    bands, per_band = choose_bands(threshold, recall)
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    signed = T.StructType([T.StructField("id", kind), T.StructField("key", T.StringType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    rows = keep(source.mapInArrow(released(_sign(bands, per_band)), signed), "ngram-rows")
    texts = keep(rows.where("n > 0").groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("n", "bands", "sketch")).alias("x")).select(F.monotonically_increasing_id().alias("rid"), "key", "first_id", "copies", "x.*"), "ngram-texts")

    member = plausible_members(texts, threshold, bands * per_band)
    linked = verified_links(texts, source, member, threshold)
    roots = components(linked.select("rid", "root"), keep).select(F.col("node").alias("rid"), "root")
    linked_texts = keep(linked.groupBy("rid").agg(F.sum("links").alias("links")).join(roots, "rid").join(texts.select("rid", "key", "first_id"), "rid"), "ngram-linked")
    named_roots = keep(linked_texts.groupBy("root").agg(F.min("first_id").alias("class_id"), F.min("key").alias("class_key"), F.count(F.lit(1)).alias("size")), "ngram-roots")
    linked_texts = join_by_size(linked_texts, named_roots, ["root"], "size", linked_texts.count()).select("key", "class_id", "class_key", "links")
    by_key = texts.select("key", "first_id", "copies").join(linked_texts, "key", "left").select("key", F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("class_key", "key").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    by_key = keep(by_key, "ngram-classes")
    named = rows.where("n > 0").select("id", "key")
    worded = join_by_size(named, by_key, ["key"], "n_copies", named.count())
    worded = worded.select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), "class_id", "n_links", "n_copies", "class_key")
    none = rows.where("n = 0").select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text_key"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("string").alias("class_key"))
    return worded.union(none)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The first document (smallest id, then text) of each class, with all its columns; texts without words stay.

    Of rows with the same id and text the first by the other columns stays.
    """
    found = classes(docs, id_col, text_col, threshold, recall).where("text_key is not null")
    first = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))).alias("x")).select(F.col("x.id").alias("id"), F.col("x.key").alias("key"))
    # the document is one struct, so no column of its can clash with those of the plan
    text = F.col(text_col)
    keyed = docs.select(F.struct(*[F.col(c).alias(c) for c in docs.columns]).alias("doc"), F.col(id_col).alias("doc_key"), F.md5(text).alias("text_key"), F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    joined = keyed.where("worded").join(first, (F.col("text_key") == F.col("key")) & F.col("doc_key").eqNullSafe(F.col("id")), "left_semi")
    order = [F.col("doc")[f.name] for f in docs.schema if isinstance(f.dataType, T.AtomicType) and f.name != text_col] or [F.lit(1)]
    kept = joined.select("doc", F.row_number().over(Window.partitionBy("text_key", "doc_key").orderBy(*order)).alias("number")).where("number = 1").select("doc")
    return kept.union(keyed.where("not worded").select("doc")).select(*[F.col("doc")[c].alias(c) for c in docs.columns])


ORACLE = r"""
with recursive w as (
  select doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), t as (
  select text, any_value(w) as w, min(doc_id) as id, count(*) as c from w where len(w) > 0 group by text
), s as (
  select id, c, list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as sh from t
), e as (select id, unnest(sh) as g from s),
p as (select a.id as x, b.id as y, count(*) as i from e a join e b on a.g = b.g and a.id <> b.id group by all),
l as (
  select x, y, sy.c from p join s sx on sx.id = p.x join s sy on sy.id = p.y where 5 * i >= 4 * (len(sx.sh) + len(sy.sh) - i)
), r(id, root) as (
  select id, id from s union select l.y, r.root from r join l on r.id = l.x
), cls as (select id, min(root) as class_id from r group by id),
n as (select x as id, sum(c) as links from l group by x)
select w.doc_id, md5(w.text) as text_key, cls.class_id, (coalesce(n.links, 0) + t.c - 1)::bigint as n_links, t.c as n_copies
from w join t using (text) join cls on cls.id = t.id left join n on n.id = t.id
union all
select doc_id, null, doc_id, 0, 1 from w where text is null or len(w) = 0
"""
