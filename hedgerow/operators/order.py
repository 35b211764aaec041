"""Global row numbers and running sums without a global window (SRC1's position, JN8, BST1, WIN1).

Running sums are prefix sums over cells that follow from a row's own values, so they
hold in any plan and on any retry and need no job before the action: the first order
column's sign and logarithm name a cell (a few hundred for each power of two), rows
are summed up inside their cell, and one sum for each cell gives what lies before it.
Where rows tie on the first column, they are first summed by its value and a piece of the
next column, so a value that most rows share is dealt to as many tasks as that has pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import checkpointed


def numbered(df: DataFrame, order: list[str], name: str = "_pos") -> DataFrame:
    """Adds each row's place (from 0) in the given order."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = checkpointed(ordered.select("*", F.spark_partition_id().alias("_part"), local.alias("_local")), "ordered")
    sizes = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    base, total = [], 0
    for part, n in sizes:  # one row per partition
        base.append((part, total))
        total += n
    table = df.sparkSession.createDataFrame(base, "_part int, _base long")
    return rows.join(F.broadcast(table), "_part").select(*df.columns, (F.col("_base") + F.col("_local")).alias(name))


#: Cells for each factor of e; a power of two has ln 2 times as many.
CELLS = 256
_FAR = 1 << 20


def cell(x: Column, kind: T.DataType) -> Column:
    """A whole number (for text: its start) that never falls as ``x`` grows; nulls come first and NaN last, as in an order."""
    if isinstance(kind, T.StringType):
        return F.coalesce(F.substring(x, 1, 2), F.lit(""))
    d = x.cast("double")
    size = F.when(F.abs(d) == float("inf"), F.lit(2 * _FAR)).otherwise(F.lit(_FAR) + F.floor(F.ln(F.abs(d)) * CELLS))
    return F.when(d.isNull(), F.lit(-4 * _FAR)).when(F.isnan(d), F.lit(4 * _FAR)).when(d == 0, F.lit(0)).when(d > 0, size).otherwise(-size).cast("int")


def _matched(left: DataFrame, right: DataFrame, on: list[str], prefix: str) -> DataFrame:
    """Join on columns of which some may be null; the right side's are dropped."""
    right = right.withColumnsRenamed({c: f"{prefix}{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return left.join(right, cond).drop(*[f"{prefix}{c}" for c in on])


def _over_cells(rows: DataFrame, by: list[str], order: list[Column | str], values: dict[str, str], totals: list[str]) -> DataFrame:
    """Adds _upto_<name> for each value, and _all_<name>: windows over the cells' rows, and over one row for each cell."""
    inside = Window.partitionBy(*by, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cells = rows.groupBy(*by, "_cell").agg(*[F.sum(c).alias(f"_c_{n}") for n, c in values.items()])
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select(*by, "_cell", *[F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values], *[F.sum(f"_c_{n}").over(Window.partitionBy(*by)).alias(f"_all_{n}") for n in totals])
    local = rows.select("*", *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in values.items()])
    joined = _matched(local, base, [*by, "_cell"], "_of_")
    return joined.select(*rows.columns, *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(f"_upto_{n}") for n in values], *[f"_all_{n}" for n in totals])


def running(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column | str], totals: list[str] | None = None) -> DataFrame:
    """Adds for each name the sum of a value over the rows of the slice up to this one, and ``total_<name>`` for some.

    ``order`` is ascending, nulls first. Rows that agree in ``by`` and all of it may come
    in any order among themselves.
    """
    totals, names = totals or [], list(sums)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    value = [(F.col(c) if isinstance(c, str) else c).alias(f"_v_{n}") for n, c in sums.items()]
    rows = df.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys)], *value)
    own, values = [f"_k{i}" for i in range(len(keys))], {n: f"_v_{n}" for n in names}
    rows = rows.withColumn("_cell", cell(F.col("_k0"), rows.schema["_k0"].dataType))
    if len(keys) == 1:
        out = _over_cells(rows, by, own, values, totals)
        return out.select(*df.columns, *[F.col(f"_upto_{n}").alias(n) for n in names], *[F.col(f"_all_{n}").alias(f"total_{n}") for n in totals])
    # rows that tie on the first column: prefix sums over (its value, piece of the second), then inside
    rows = rows.withColumn("_tie", cell(F.col("_k1"), rows.schema["_k1"].dataType))
    at = [*by, "_cell", "_k0", "_tie"]
    tied = rows.groupBy(*at).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = _over_cells(tied, by, ["_k0", "_tie"], {n: f"_t_{n}" for n in names}, totals)
    before = before.select(*at, *[(F.col(f"_upto_{n}") - F.col(f"_t_{n}")).alias(f"_f_{n}") for n in names], *[f"_all_{n}" for n in totals])
    inside = Window.partitionBy(*at).orderBy(*own[1:]).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in values.items()])
    out = _matched(local, before, at, "_of_")
    return out.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_f_{n}")).alias(n) for n in names], *[F.col(f"_all_{n}").alias(f"total_{n}") for n in totals])
