"""Quality rules over lines and words, with line frequencies across documents.

Only DataFrame functions run here. A document's text is read once: one native
projection derives its word measures and the hash and length of each normalised
line. Lines are then counted over distinct documents per host (aggregated before
the shuffle), lines above the limit are joined back (those with many rows by
broadcast, see ``join_by_size``), and a document that would lose too many of its
characters is rejected.

Defined cases: a null text is an empty one and fails the base rules; a text of any
length is read whole; an empty table gives an empty one; a null host is a host of
its own; every row is one document, also if ids or whole rows repeat; a line without
a word is no line; columns other than the three named ones are neither read nor
returned by ``line_rules``, and kept as they are, whatever their names, by
``keep_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_by_size, keep

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A line in more documents of one host than this is boilerplate.
MAX_DOCS_PER_HOST = 20
#: Rejected: documents that lose more than this percentage of their characters.
MAX_REMOVED_PERCENT = 50


def _sorted_windows(hashes: Column) -> Column:
    """(hash, position) of all windows in order, so that equal windows stand side by side."""
    return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated(s: Column) -> Column:
    """Positions, in order, of the windows that have an equal neighbour."""
    n = F.size(s)
    same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    hit = F.filter(s, lambda x, i: ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False))) | ((i < n - 1) & F.coalesce(same(i, i + 1), F.lit(False))))
    return F.array_sort(F.transform(hit, lambda x: x["i"]))


def _covered(p: Column) -> Column:
    """Words under the windows at some positions: each covers the words up to the next, ``WINDOW`` at most."""
    gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(0), lambda t, x: t + x)


def document_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: base measures, and the key and length of each line with a word."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.select(
        "doc_id",
        "host",
        F.array_remove(F.split("t", SPACE), "").alias("w"),
        F.size(F.split("t", r"[#*$%&|<>]")).alias("sym"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("raw"),
    )
    t = t.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.col("sym") - 1).cast("long").alias("n_symbols"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
        F.transform("raw", lambda x: F.xxhash64(x)).alias("rh"),
        F.transform("raw", lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]+", "0"), SPACE, " "))).alias("norm"),
    )
    t = t.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("rh") - F.size(F.array_distinct("rh"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("wh") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("wh") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("wh", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("win"),
        F.transform("norm", lambda x: F.xxhash64(F.col("host"), x)).alias("line_key"),
        F.transform("norm", lambda x: F.length(x)).alias("line_len"),
    )
    repeats = F.size("win") > F.size(F.array_distinct("win"))
    t = t.select("*", F.when(repeats, _sorted_windows(F.col("win"))).alias("s")).drop("win")
    t = t.select("*", F.when(F.col("s").isNotNull(), _repeated(F.col("s"))).alias("p")).drop("s")
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(_covered(F.col("p")), F.lit(0)).cast("long").alias("n_repeat_words"), "line_key", "line_len")


def frequent_lines(digest: DataFrame, max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """(line_key, n_docs) of lines in more than ``max_docs`` documents of a host."""
    lines = digest.select(F.explode(F.array_distinct("line_key")).alias("line_key"))
    return lines.groupBy("line_key").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs)


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS_PER_HOST, max_removed_percent: int = MAX_REMOVED_PERCENT) -> DataFrame:
    """One row per document: the measures, the characters removed and the verdict ``kept``."""
    rows = keep(document_digest(docs, id_col, text_col, host_col).select(F.monotonically_increasing_id().alias("row"), "*"), "line-digest")
    often = keep(frequent_lines(rows, max_docs), "line-frequent")
    lines = rows.select("row", F.explode(F.arrays_zip("line_key", "line_len")).alias("x")).select("row", F.col("x.line_key").alias("line_key"), F.col("x.line_len").alias("line_len"))
    n_lines = rows.agg(F.sum(F.size("line_key"))).first()[0] or 0
    removed = join_by_size(lines, often, ["line_key"], "n_docs", n_lines).groupBy("row").agg(F.sum("line_len").alias("removed_chars"), F.count(F.lit(1)).alias("removed_lines"))
    out = rows.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.aggregate("line_len", F.lit(0).cast("long"), lambda t, x: t + x).alias("line_chars")).join(removed, "row", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce(F.col("removed_chars"), F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * gone <= max_removed_percent * F.col("line_chars"))).alias("kept"),
        F.coalesce(F.col("removed_lines"), F.lit(0)).cast("long").alias("removed_lines"),
        gone.cast("long").alias("removed_chars"),
    )


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """The documents with their frequent lines taken out of the text; other columns stay."""
    key = lambda x: F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit("")), F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]+", "0"), SPACE, " ")))
    names = docs.columns
    # the document is one struct, so no column of its can clash with those of the plan
    numbered = keep(docs.select(F.struct(*[F.col(c).alias(c) for c in names]).alias("doc"), F.monotonically_increasing_id().alias("row"), F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), key(x))).alias("line_key")), "line-docs")
    lines = numbered.select("row", "line_key")
    found = lines.select(F.explode(F.array_distinct("line_key")).alias("line_key")).where("line_key is not null").groupBy("line_key").agg(F.count(F.lit(1)).alias("n_docs"))
    often = keep(found.where(F.col("n_docs") > max_docs), "line-frequent")
    places = lines.select("row", F.posexplode("line_key").alias("at", "line_key")).where("line_key is not null")
    cut = join_by_size(places, often, ["line_key"], "n_docs", places.count()).groupBy("row").agg(F.collect_set("at").alias("cut"))
    out = numbered.select("row", "doc").join(cut, "row", "left")
    text = F.array_join(F.filter(F.split(F.col("doc")[text_col], "\n"), lambda x, i: ~F.array_contains(F.col("cut"), i)), "\n")
    return out.select(*[(F.when(F.col("cut").isNull(), F.col("doc")[c]).otherwise(text) if c == text_col else F.col("doc")[c]).alias(c) for c in names])


ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents
), w as (
  select r, doc_id, host, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d
), m as (
  select r, doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines from w
), g as (
  select r, unnest(range(1, len(w) - 6)) as i, w from w where len(w) >= 8
), h as (
  select r, i, array_to_string(w[i:i + 7], ' ') as x from g
), rep as (
  select r, i from (select r, i, count(*) over (partition by r, x) as n from h) where n > 1
), cov as (
  select r, count(distinct j) as n from (select r, unnest(range(i, i + 8)) as j from rep) group by r
), ln as (
  select r, host, unnest(l) as line from w
), nl as (
  select r, host, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as line from ln
), often as (
  select host, line from nl group by host, line having count(distinct r) > 20
), lost as (
  select r, count(*) as lines, sum(length(line)) as chars from nl join often using (host, line) group by r
), tot as (
  select r, sum(length(line)) as chars from nl group by r
), a as (
  select m.*, coalesce(cov.n, 0) as n_repeat_words, coalesce(lost.lines, 0) as removed_lines, coalesce(lost.chars, 0) as removed_chars, coalesce(tot.chars, 0) as line_chars
  from m left join cov using (r) left join lost using (r) left join tot using (r)
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  (not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * removed_chars <= 50 * line_chars) as kept,
  removed_lines::bigint as removed_lines, removed_chars::bigint as removed_chars
from a
"""
