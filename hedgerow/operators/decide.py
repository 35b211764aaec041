"""Decisions, marks, claims and sealed protocols (DEC1, DEC2, TXT19, GAT1, GAT2)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.functions.text import NEGATIVE

ACTIONS = ("translate", "mark_uncertain", "abstain")


def action(risk: str | Column, mark: float | Column, abstain: float | Column) -> Column:
    """Three-way action: at or above a threshold counts as above it."""
    r = F.col(risk) if isinstance(risk, str) else risk
    lit = lambda x: F.lit(x) if isinstance(x, (int, float)) else x
    return F.when(r >= lit(abstain), ACTIONS[2]).when(r >= lit(mark), ACTIONS[1]).otherwise(ACTIONS[0])


def marked(text: str | Column, kind: str) -> Column:
    """The text with its numbers or negations in tags; where there are none, a tag at the end."""
    t = F.col(text) if isinstance(text, str) else text
    from hedgerow.functions import numbers as N

    words = {"number": sorted([*N._EN_UNITS, *N._EN_TENS, *N._EN_ORDINALS, *N._EN_SCALES, *N._EN_ALIASES], key=len, reverse=True), "negation": sorted(NEGATIVE, key=len, reverse=True)}.get(kind)
    if words is None:
        return F.concat(F.lit("[uncertain]"), t, F.lit("[/uncertain]"))
    pattern = r"(?iU)(?<!\w)(?:" + (r"[+-]?\d+(?:[.,]\d+)*|" if kind == "number" else "") + "|".join(words) + r")(?!\w)"
    return F.when(t.rlike(pattern), F.regexp_replace(t, f"({pattern})", "[uncertain]$1[/uncertain]")).otherwise(F.concat(t, F.lit(" [uncertain]")))


def decided(df: DataFrame, risk: str, text: str, mark: float, abstain: float, kind: str = "number") -> DataFrame:
    """Adds the action and what is shown: the text, the marked text, or nothing."""
    a = action(risk, mark, abstain)
    return df.select("*", a.alias("action"), F.when(a == ACTIONS[0], F.col(text)).when(a == ACTIONS[1], marked(text, kind)).otherwise("").alias("output"))


def claims(checks: dict[str, Column], formal: Column) -> list[Column]:
    """Boolean checks, and whether all hold under the formal protocol (DEC2)."""
    every = formal
    for c in checks.values():
        every = every & F.coalesce(c, F.lit(False))
    return [*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()], every.alias("eligible")]


def digest(payload: dict) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()


def seal(payload: dict, sealed: dict | None, now: str) -> dict:
    """The sealed form of a protocol; sealing again keeps the first time, another payload is refused (GAT1)."""
    if sealed is None:
        return {"payload": payload, "digest": digest(payload), "sealed_at": now}
    if sealed["digest"] != digest(payload):
        raise ValueError("the protocol is sealed with another payload")
    return sealed


def pinned(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Rows that differ between a pinned snapshot and the current table, as multisets (GAT2, SET7)."""
    lost = snapshot.exceptAll(current).withColumn("side", F.lit("lost"))
    return lost.union(current.exceptAll(snapshot).withColumn("side", F.lit("new")))
