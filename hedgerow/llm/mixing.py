"""Mixing sources to target weights by hierarchical budgets.

Weights go down a tree of levels (domain, language, source). A node shares its
budget among its children by weight, none above the tokens it can give (its
tokens times the allowed epochs); what a child can't use goes to its siblings by
weight, and to the parent's siblings only where all of them are full. A leaf's
budget is met by whole epochs and a prefix of one more: documents in the order of
a seeded hash, as long as their tokens fit.

The prefix of a leaf is a cut on that hash. It is found from sums over hash
buckets and then inside the one bucket where the budget ends, so no task ever
holds a leaf, however large (buckets hold about ``BUCKET_DOCS`` documents, up to a
billion of a leaf), and what the driver sees is one row per leaf.

Defined cases: null levels are leaves of their own; weight 0 takes nothing, and a
name without a weight has ``default``; a null text has no tokens and is taken
with any prefix that reaches it; a leaf without any token gives nothing; rows of one leaf with the same id and text are
taken together or not at all; a budget above the whole supply takes everything
as often as allowed; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, keep

#: More leaves than this are refused: budgets are worked out on the driver.
MAX_LEAVES = 50_000
BUCKET_DOCS = 1000


@dataclass
class Weights:
    """Weight of each name at a level, ``default`` for other names; the same at every parent."""

    levels: list[dict[str, float]] = field(default_factory=list)
    default: float = 1.0

    def of(self, level: int, name: str | None) -> Fraction:
        return Fraction(str(self.levels[level].get(name, self.default) if level < len(self.levels) else self.default))


def _fill(amount: Fraction, weights: list[Fraction], caps: list[Fraction]) -> list[Fraction]:
    """Share by weight, nobody above the cap; what is left goes to the others by weight."""
    out, left = [Fraction(0)] * len(caps), amount
    open_ = [i for i in range(len(caps)) if weights[i] > 0 and caps[i] > 0]
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if caps[i] <= left * weights[i] / total]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            return out
        for i in full:
            out[i] = caps[i]
        left -= sum(caps[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def budgets(supply: dict[tuple, int], weights: Weights, budget: int, epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf (a tuple of names), rounded down."""
    def usable(leaves: dict[tuple, int], level: int) -> Fraction:
        """What a subtree can give, without children of weight 0."""
        if not leaves or level == len(next(iter(leaves))):
            return Fraction(sum(leaves.values()) * epochs)
        return sum((usable(part, level + 1) for name, part in _children(leaves, level).items() if weights.of(level, name) > 0), Fraction(0))

    def down(leaves: dict[tuple, int], level: int, amount: Fraction, out: dict[tuple, int]) -> None:
        if level == len(next(iter(leaves))):
            (leaf,) = leaves
            out[leaf] = int(amount)
            return
        parts = _children(leaves, level)
        names = sorted(parts, key=lambda x: (x is not None, x or ""))
        given = _fill(amount, [weights.of(level, x) for x in names], [usable(parts[x], level + 1) for x in names])
        for name, share in zip(names, given, strict=True):
            down(parts[name], level + 1, share, out)

    out: dict[tuple, int] = {}
    if supply:
        down(supply, 0, Fraction(budget), out)
    return out


def _children(leaves: dict[tuple, int], level: int) -> dict:
    parts: dict = {}
    for leaf, n in leaves.items():
        parts.setdefault(leaf[level], {})[leaf] = n
    return parts


def word_count(text: str | Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE), "")).cast("long")


def _order(epoch: Column, seed: int, id_: Column, text_hash: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch, id_, text_hash)


def _plan(rows: DataFrame, n_levels: int, weights: Weights, budget: int | None, share: float, epochs: int, seed: int) -> DataFrame:
    """One row per leaf: its names (l0, l1, ...), whole epochs, and the cut of the prefix of the next."""
    spark, names = rows.sparkSession, [f"l{i}" for i in range(n_levels)]
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).limit(MAX_LEAVES + 1).collect()
    if len(leaves) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    supply = {tuple(r[c] for c in names): r["tokens"] for r in leaves}
    total = sum(supply.values())
    given = budgets(supply, weights, int(total * share) if budget is None else budget, epochs)
    table = [(*leaf, *divmod(given[leaf], n), i) if n else (*leaf, 0, 0, i) for i, (leaf, n) in enumerate(supply.items())]
    plan = _leaves(spark, table, names, {"whole": pa.int64(), "rest": pa.int64(), "leaf": pa.int32()})
    bits = max(1, min(20, (max((r["docs"] for r in leaves), default=1) // BUCKET_DOCS).bit_length()))
    h = _order(F.col("whole"), seed, F.col("id"), F.col("text_hash"))
    hashed = _with_plan(rows, plan, names).where("rest > 0").select("leaf", "rest", "n_tokens", h.alias("h")).select("*", F.shiftright("h", 64 - bits).alias("bucket"))
    sums = hashed.groupBy("leaf", "bucket").agg(F.sum("n_tokens").alias("t"))
    # at most 1,048,576 buckets of a leaf are summed up in order
    run = sums.select("*", F.sum("t").over(Window.partitionBy("leaf").orderBy("bucket")).alias("upto"))
    edge = run.join(F.broadcast(plan.select("leaf", "rest")), "leaf").where(F.col("upto") > F.col("rest"))
    edge = edge.groupBy("leaf").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("t")).alias("base")), "bucket").alias("x")).select("leaf", "x.*")
    inside = hashed.join(F.broadcast(edge), ["leaf", "bucket"]).groupBy("leaf", "bucket", "base", "rest", "h").agg(F.sum("n_tokens").alias("t"))
    fine = inside.select("*", (F.col("base") + F.sum("t").over(Window.partitionBy("leaf", "bucket").orderBy("h"))).alias("upto"))
    cut = fine.groupBy("leaf", "bucket").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("h"))).alias("h"), F.min("h").alias("low"))
    cuts = {r["leaf"]: r["h"] if r["h"] is not None else r["low"] - 1 if r["low"] > -(1 << 63) else None for r in cut.collect()}
    top = (1 << 63) - 1
    # a leaf whose budget ends in no bucket takes its next epoch as a whole, one without a rest nothing of it
    return _leaves(spark, [(*r[:n_levels], r[n_levels], cuts.get(r[-1], top) if r[n_levels + 1] else None) for r in table], names, {"whole": pa.int64(), "cut": pa.int64()})


def _leaves(spark: SparkSession, rows: list[tuple], names: list[str], numbers: dict[str, pa.DataType]) -> DataFrame:
    """The driver's rows as a table; as Arrow, since a list of tuples starts Python workers of its own on each executor."""
    kinds = dict.fromkeys(names, pa.string()) | numbers
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds)))


def _with_plan(rows: DataFrame, plan: DataFrame, names: list[str]) -> DataFrame:
    """The plan has one row per leaf, ``MAX_LEAVES`` at most, and is broadcast."""
    renamed = plan.select(*[F.col(c).alias(f"_{c}") for c in names], *[c for c in plan.columns if c not in names])
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(F.broadcast(renamed), on).drop(*[f"_{c}" for c in names])


def _rows(docs: DataFrame, levels: list[Column], tokens: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), tokens.alias("n_tokens"), *[c.cast("string").alias(f"l{i}") for i, c in enumerate(levels)])


def _taken(rows: DataFrame, plan: DataFrame, n_levels: int, seed: int) -> DataFrame:
    """Each row once for each epoch that takes it, with the epoch (from 0)."""
    joined = _with_plan(rows, plan, [f"l{i}" for i in range(n_levels)])
    times = F.col("whole") + F.coalesce((_order(F.col("whole"), seed, F.col("id"), F.col("text_hash")) <= F.col("cut")).cast("long"), F.lit(0))
    return joined.select("*", times.alias("_times")).where("_times > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)).alias("epoch")).drop("_times", "whole", "cut")


def mixture(docs: DataFrame, levels: list[Column], weights: Weights, budget: int | None = None, share: float = 1.0, epochs: int = 1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row per document and epoch taken: doc_id, n_tokens, epoch, level_0, level_1, ...

    ``budget`` is in tokens; without it ``share`` of the whole supply is taken.
    """
    rows = keep(_rows(docs, levels, word_count(text_col) if tokens is None else tokens, id_col, text_col), "mix-rows")
    plan = _plan(rows, len(levels), weights, budget, share, epochs, seed)
    return _taken(rows, plan, len(levels), seed).select(F.col("id").alias("doc_id"), "n_tokens", "epoch", *[F.col(f"l{i}").alias(f"level_{i}") for i in range(len(levels))])


def mix(docs: DataFrame, levels: list[Column], weights: Weights, budget: int | None = None, share: float = 1.0, epochs: int = 1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The documents taken, with all their columns; one row for each epoch that takes a document."""
    rows = keep(_rows(docs, levels, word_count(text_col) if tokens is None else tokens, id_col, text_col), "mix-rows")
    plan = _plan(rows, len(levels), weights, budget, share, epochs, seed)
    doc = F.struct(*[F.col(c).alias(c) for c in docs.columns]).alias("doc")
    keyed = docs.select(doc, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), *[c.cast("string").alias(f"l{i}") for i, c in enumerate(levels)])
    return _taken(keyed, plan, len(levels), seed).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
