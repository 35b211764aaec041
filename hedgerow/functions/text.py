"""Text normalisation, distances, coverage, polarity and signatures (TXT1-TXT20)."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import number_values

# Words that decide a text's polarity.
NEGATIVE = ["not", "no", "never", "cannot", "can't", "dont", "don't", "doesnt", "doesn't", "didnt", "didn't", "wont", "won't", "isnt", "isn't", "nothing", "nobody", "no one", "neither", "without", "hardly"]
AFFIRMATIVE = ["affirmative", "positive", "yes", "will", "present", "again"]
_SLOT_KEYS = ("value", "surface", "text", "translation", "aliases")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a function over an array an outer expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normal form, for which there is no built-in."""
    return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def normalize(text: str | Column, punctuation: bool = False, form: bool = True) -> Column:
    """Lower case, single spaces, and (unless kept) no punctuation; null is empty (TXT1).

    Texts that are ASCII need no normal form; ``form=False`` leaves it out and stays in the JVM.
    """
    t = F.coalesce(_col(text), F.lit(""))
    t = F.lower(nfkc(t) if form else t)
    if not punctuation:
        t = F.regexp_replace(t, r"(?U)[^\w\s]", " ")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^ | $", "")


def units(normalized: str | Column) -> Column:
    """Words of a normalised text; the characters of a single word; nothing of an empty one (TXT2)."""
    words = lambda t: let(F.split(t, " "), lambda w: F.when(F.size(w) > 1, w).otherwise(F.split(t, "")))
    return let(_col(normalized), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(words(t)))


def token_distance(a: str | Column, b: str | Column) -> Column:
    """Edit distance of two token arrays (TXT3).

    Each different token of the pair becomes one character, so that the built-in
    distance of strings does the work; for up to a million different tokens a pair (more
    are refused).
    """
    both = F.struct(_col(a).alias("a"), _col(b).alias("b"))
    # code points from 0x3400 on, without the surrogates from 0xD800 to 0xDFFF
    point = lambda n: F.when(n > 0x10FFFF - 0x3400 - 0x800, F.raise_error(F.lit("more than a million different tokens"))).otherwise(F.when(n + 0x3400 < 0xD800, n + 0x3400).otherwise(n + 0x3C00))
    code = lambda known, t: F.lpad(F.hex(let(F.array_position(known, t), point)), 8, "0")
    coded = lambda known, x: F.decode(F.unhex(F.array_join(F.transform(x, lambda t: code(known, t)), "")), "UTF-32")
    return let(both, lambda p: let(F.array_distinct(F.concat(p["a"], p["b"])), lambda known: F.levenshtein(coded(known, p["a"]), coded(known, p["b"]))))


def normalized_distance(a: str | Column, b: str | Column) -> Column:
    """Edit distance over the longer length; 0 for two empty texts (TXT4)."""
    both = F.struct(_col(a).alias("a"), _col(b).alias("b"))
    return let(both, lambda p: token_distance(p["a"], p["b"]) / F.greatest(F.size(p["a"]), F.size(p["b"]), F.lit(1)))


def pairwise_mean(df: DataFrame, by: str, tokens: str) -> DataFrame:
    """Mean normalised distance of all unordered pairs of non-empty texts in a group; NULL under two (TXT5).

    Groups are the samples of one item, so an array of them is small; pairs are
    made inside the row, without a join.
    """
    groups = df.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.size(tokens) > 0, F.col(tokens)))).alias("_t"))
    n = F.size("_t")
    pairs = F.flatten(F.transform("_t", lambda a, i: F.transform(F.slice("_t", i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    long = groups.select(by, F.explode_outer(pairs).alias("p")).select(by, F.when(F.col("p").isNotNull(), normalized_distance("p.a", "p.b")).alias("d"))
    return long.groupBy(by).agg(F.avg("d").alias("mean_distance"), F.count("d").alias("pairs"))


def coverage(reference: str | Column, hypothesis: str | Column) -> Column:
    """(precision, recall) of token sets; (1, 1) for two empty ones (TXT6)."""
    sets = F.struct(F.array_distinct(_col(reference)).alias("r"), F.array_distinct(_col(hypothesis)).alias("h"))

    def both(s: Column) -> Column:
        n, h, r = F.size(F.array_intersect(s["r"], s["h"])).cast("double"), F.size(s["h"]), F.size(s["r"])
        share = lambda size: F.when((h == 0) & (r == 0), F.lit(1.0)).otherwise(n / F.greatest(size, F.lit(1)))
        return F.struct(share(h).alias("precision"), share(r).alias("recall"))

    return let(sets, both)


def coverage_gap(reference: str | Column, hypothesis: str | Column) -> Column:
    """One less the smaller of precision and recall (TXT7)."""
    c = coverage(reference, hypothesis)
    return 1 - F.least(c["precision"], c["recall"])


def is_negative(normalized: str | Column) -> Column:
    """Whether a text (normalised with punctuation kept) has a negative marker as a word (TXT8)."""
    words = "|".join(sorted(NEGATIVE, key=len, reverse=True))
    return _col(normalized).rlike(rf"(?U)(?<!\w)(?:{words})(?!\w)")


def slot_list(raw: str | None) -> list[str]:
    """Texts of a slot given as JSON: a value, a list, or an object of known keys; first occurrences (TXT9)."""
    def walk(x):
        if isinstance(x, dict):
            for k in _SLOT_KEYS:
                if k in x:
                    yield from walk(x[k])
        elif isinstance(x, list):
            for item in x:
                yield from walk(item)
        elif x is not None and str(x):
            yield str(x)

    return [] if raw is None else list(dict.fromkeys(walk(json.loads(raw))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def slot_surfaces(slots: pd.Series) -> pd.Series:
    return slots.map(slot_list)


def polarity(surfaces: str | Column) -> Column:
    """Whether a slot negates: true, false, or NULL where it says neither (TXT10)."""
    joined = F.array_join(_col(surfaces), " ")
    affirms = F.arrays_overlap(F.split(normalize(joined), " "), F.array(*map(F.lit, AFFIRMATIVE)))
    return F.when(F.size(_col(surfaces)) == 0, F.lit(None).cast("boolean")).when(is_negative(normalize(joined, punctuation=True)), True).when(affirms, False)


def signature(text: str | Column, kind: str) -> Column:
    """What a text says about its fact: sorted numbers, or its polarity (TXT13)."""
    if kind == "number":
        return F.array_sort(number_values(text))
    if kind == "negation":
        return F.array(F.when(is_negative(normalize(text, punctuation=True)), "negative").otherwise("affirmative"))
    return F.array().cast("array<string>")


def disagreement(signatures: str | Column) -> Column:
    """Different signatures of an output and its samples beyond the first, as a share; NULL without samples (TXT14)."""
    s = _col(signatures)
    return F.when(F.size(s) > 1, (F.size(F.array_distinct(s)) - 1) / F.greatest(F.size(s) - 1, F.lit(1)))


def word_total(text: str | Column) -> Column:
    """Words between white space (TXT20)."""
    return F.size(F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != ""))


def gram_counts(reference: str, hypothesis: str, orders: int) -> list[int]:
    """For each order the numbers of n-grams of the hypothesis, of the reference, and of their multiset intersection.

    A gram is numbered by the pair of its first n - 1 characters' number and its last character.
    """
    r, h = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (reference, hypothesis))
    known, characters = np.unique(np.concatenate([r, h]), return_inverse=True)
    grams, out = (characters[: len(r)], characters[len(r) :]), []
    last = grams
    for n in range(1, orders + 1):
        if n > 1:
            keys = [g[:-1] * len(known) + c[n - 1 :] if len(c) >= n else g[:0] for g, c in zip(grams, last, strict=True)]
            _, number = np.unique(np.concatenate(keys), return_inverse=True)
            grams = (number[: len(keys[0])], number[len(keys[0]) :])
        size = max((int(g.max()) + 1 for g in grams if len(g)), default=0)
        both = [np.bincount(g, minlength=size) for g in grams]
        out += [len(grams[1]), len(grams[0]), int(np.minimum(*both).sum())]
    return out


def chrf_counts(df: DataFrame, reference: str, hypothesis: str, orders: int = 6, spaces: bool = True, lower: bool = True) -> DataFrame:
    """Adds ``chrf``: an array of (order, hyp, ref, match) n-gram counts; sums of them make corpus scores (TXT17)."""
    def plain(c: str) -> Column:
        t = F.lower(c) if lower else F.col(c)
        t = F.regexp_replace(t, r"(?U)\s+", " " if spaces else "")
        return F.regexp_replace(t, r"^ | $", "")

    @F.pandas_udf("array<int>")
    def counted(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([gram_counts(a or "", b or "", orders) for a, b in zip(r, h, strict=True)], dtype=object)

    rows = df.select("*", counted(plain(reference), plain(hypothesis)).alias("_grams"))
    part = lambda n: F.struct(F.lit(n).alias("order"), *[F.get("_grams", F.lit(3 * n - 3 + i)).alias(c) for i, c in enumerate(("hyp", "ref", "match"))])
    return rows.select(*df.columns, F.array(*[part(n) for n in range(1, orders + 1)]).alias("chrf"))


def chrf_f(counts: Column, beta: float = 2.0) -> Column:
    """Mean F score over the orders, times 100; an order without n-grams counts 0 (TXT16)."""
    def f(x: Column) -> Column:
        p = x["match"] / F.greatest(x["hyp"], F.lit(1))
        r = x["match"] / F.greatest(x["ref"], F.lit(1))
        d = beta * beta * p + r
        return F.when(d > 0, (1 + beta * beta) * p * r / d).otherwise(0.0)

    return 100 * F.aggregate(F.transform(counts, f), F.lit(0.0), lambda t, x: t + x) / F.size(counts)


def sentence_chrf(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    return chrf_counts(df, reference, hypothesis).select(*df.columns, chrf_f(F.col("chrf")).alias("chrf"))


def corpus_chrf(df: DataFrame, by: list[str], reference: str, hypothesis: str, beta: float = 2.0, case: bool = True) -> DataFrame:
    """Character F score of summed counts, white space left out, over orders that occur on both sides (TXT17, MET21)."""
    long = chrf_counts(df, reference, hypothesis, spaces=False, lower=not case).select(*by, F.explode("chrf").alias("c")).select(*by, "c.*")
    sums = long.groupBy(*by, "order").agg(F.sum("hyp").alias("hyp"), F.sum("ref").alias("ref"), F.sum("match").alias("match"))
    there = (F.col("hyp") > 0) & (F.col("ref") > 0)
    mean = sums.groupBy(*by).agg(F.avg(F.when(there, F.col("match") / F.col("hyp"))).alias("p"), F.avg(F.when(there, F.col("match") / F.col("ref"))).alias("r"))
    b = beta * beta
    d = b * F.col("p") + F.col("r")
    return mean.select(*by, F.coalesce(F.when(d > 0, 100 * (1 + b) * F.col("p") * F.col("r") / d), F.lit(0.0)).alias("chrf"))
