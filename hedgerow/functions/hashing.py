"""Seeded, label-independent order keys (HSH1, SRT1, SRT2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 20260906


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_hex(text: str | Column, seed: int | Column = SEED) -> Column:
    """First 16 hex digits of SHA-256 of ``seed:text``; their order is the order of the integer they spell."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.substring(F.sha2(F.concat(seed.cast("string"), F.lit(":"), _col(text).cast("string")), 256), 1, 16)


def stable_u64(text: str | Column, seed: int | Column = SEED) -> Column:
    """The unsigned 64-bit integer of :func:`stable_hex`."""
    return F.conv(stable_hex(text, seed), 16, 10).cast("decimal(20,0)")


def fingerprint(*parts: str | Column) -> Column:
    """SHA-256 over the parts, each with its length, so that no two lists of parts coincide (HSH2, HSH3)."""
    texts = [F.coalesce(_col(p).cast("string"), F.lit("\x00")) for p in parts]
    return F.sha2(F.concat(*[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]), 256)


def safe_id(c: str | Column) -> Column:
    """Letters, digits, dot, underscore and hyphen stay, anything else is an underscore (FMT1)."""
    return F.regexp_replace(_col(c), r"[^\p{L}\p{N}._\-]", "_")
