"""Signal and array functions on waveforms and vectors (AUD1-AUD6, INF2, INF7, MTH3-MTH5).

Everything that array functions express runs in the JVM; only the spectrum, noise
and resampling need numpy and run as Arrow UDFs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + f(x.cast("double")))


def _share(a: Column, test) -> Column:
    return F.size(F.filter(a, test)) / F.nullif(F.size(a), F.lit(0))


def rms(x: str | Column) -> Column:
    x = _col(x)
    return F.sqrt(_sum(x, lambda v: v * v) / F.nullif(F.size(x), F.lit(0)))


def rms_db(x: str | Column) -> Column:
    """Level in decibels, at least that of 1e-6 (MTH3)."""
    return 20 * F.log10(F.greatest(F.coalesce(rms(x), F.lit(0.0)), F.lit(1e-6)))


def zero_fraction(x: str | Column) -> Column:
    return _share(_col(x), lambda v: F.abs(v) < 1e-5)


def clip_fraction(x: str | Column) -> Column:
    return _share(_col(x), lambda v: F.abs(v) >= 0.999)


def duration(x: str | Column, rate: str | Column | int) -> Column:
    return F.size(_col(x)) / (F.lit(rate) if isinstance(rate, int) else _col(rate))


def gain(x: str | Column, db: float) -> Column:
    """Amplitudes times 10^(db/20) (AUD2)."""
    return F.transform(_col(x), lambda v: v.cast("double") * 10 ** (db / 20))


def truncate_at(x: str | Column, rate: int, start: str | Column, end: str | Column, retain: float) -> Column:
    """The signal up to a share of a span, one sample at least (AUD3, AUD5)."""
    x, start, end = _col(x), _col(start), _col(end)
    n = F.bround((start + (end - start) * retain) * rate, 0).cast("int")
    return F.slice(x, F.lit(1), F.least(F.size(x), F.greatest(n, F.lit(1))))


def zero_span(x: str | Column, first: str | Column, after: str | Column) -> Column:
    """Samples of [first, after) set to 0 (GEN5)."""
    first, after = _col(first), _col(after)
    return F.transform(_col(x), lambda v, i: F.when((i >= first) & (i < after), F.lit(0.0)).otherwise(v.cast("double")))


def irrelevant_span(first: Column, after: Column, n: Column) -> Column:
    """A span as long as [first, after) outside of it: the prefix if it fits, else the suffix, else an error (GEN5)."""
    size = after - first
    return F.when(size <= first, F.struct(F.lit(0).alias("first"), size.alias("after"))).when(n - size >= after, F.struct((n - size).alias("first"), n.alias("after"))).otherwise(F.raise_error(F.lit("no room for an irrelevant mask")).cast("struct<first:int,after:int>"))


def entropy(p: str | Column) -> Column:
    """Minus the sum of p ln p; zeros count nothing (MTH4)."""
    return _sum(F.filter(_col(p), lambda v: v > 0), lambda v: -v * F.log(v))


def softmax_entropy(logits: str | Column) -> Column:
    """Entropy of the softmax of logits; minus infinity is a probability of 0 (INF2)."""
    x = _col(logits)
    e = F.transform(x, lambda v: F.exp(v.cast("double") - F.array_max(x)))
    total = _sum(e)
    return entropy(F.transform(e, lambda v: v / total))


def pearson(a: str | Column, b: str | Column) -> Column:
    """Correlation of two vectors, 0 if one is constant (MTH5)."""
    a, b = _col(a), _col(b)
    n = F.size(a)
    ma, mb = _sum(a) / n, _sum(b) / n
    cov = _sum(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    va, vb = _sum(a, lambda x: (x - ma) * (x - ma)), _sum(b, lambda y: (y - mb) * (y - mb))
    return F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).otherwise(0.0)


def attention_summary(weights: str | Column, audio: int) -> Column:
    """Of a query-by-key attention matrix whose first ``audio`` keys are audio: mass ratio, entropies of both parts,
    mean correlation of consecutive rows (INF7)."""
    w = _col(weights)
    part = lambda row, first: F.slice(row, 1, audio) if first else F.slice(row, audio + 1, F.greatest(F.size(row) - audio, F.lit(0)))
    mass = lambda first: _sum(F.transform(w, lambda r: _sum(part(r, first))))
    mean = lambda a: F.coalesce(_sum(a) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))
    spread = lambda first: mean(F.transform(w, lambda r: F.when(_sum(part(r, first)) > 0, entropy(F.transform(part(r, first), lambda v: v / _sum(part(r, first))))).otherwise(0.0)))
    steps = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), pearson)
    return F.struct((mass(True) / F.nullif(mass(True) + mass(False), F.lit(0.0))).alias("audio_ratio"), spread(True).alias("audio_entropy"), spread(False).alias("text_entropy"), mean(steps).alias("correlation"))


def spectral(x: np.ndarray) -> float:
    """Entropy of the power spectrum over its maximum; the transform's length is a power of two from 512 to 32768."""
    if not len(x):
        return 0.0
    size = min(32768, max(512, 1 << (len(x) - 1).bit_length()))
    power = np.abs(np.fft.rfft(x[:size], n=size)) ** 2
    total = power.sum()
    if total <= 0:
        return 0.0
    p = power / total
    p = p[p > 0]
    return float(-(p * np.log(p)).sum() / np.log(size // 2 + 1))


@F.pandas_udf(T.DoubleType())
def spectral_entropy(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else spectral(np.asarray(v, np.float64)))


def _generator(id_: str, seed: int) -> np.random.Generator:
    return np.random.default_rng(int(hashlib.sha256(f"{seed}:{id_}".encode()).hexdigest()[:16], 16))


def noisy(x: np.ndarray, snr: float, rng: np.random.Generator) -> np.ndarray:
    level = np.sqrt(np.mean(x**2)) if len(x) else 0.0
    if level == 0:
        return x
    noise = rng.normal(size=len(x))
    return x + noise * (level / 10 ** (snr / 20) / np.sqrt(np.mean(noise**2)))


def add_noise(id_: str | Column, x: str | Column, snr: float, seed: int) -> Column:
    """Gaussian noise at a signal-to-noise ratio, seeded by the id; silence stays (AUD1)."""
    @F.pandas_udf("array<double>")
    def run(ids: pd.Series, xs: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else noisy(np.asarray(v, np.float64), snr, _generator(str(i), seed)) for i, v in zip(ids, xs, strict=True)])

    return run(_col(id_), _col(x))


def overlapped(x: np.ndarray, rate: int, donor: np.ndarray, donor_rate: int, span: tuple[float, float], snr: float) -> np.ndarray:
    """A donor signal laid over a span at a signal-to-noise ratio; brought to the rate, repeated to fill (AUD4)."""
    if donor_rate != rate and len(donor):
        n = max(1, round(len(donor) * rate / donor_rate))
        donor = np.interp(np.arange(n) * donor_rate / rate, np.arange(len(donor)), donor)
    first, after = (min(len(x), max(0, round(s * rate))) for s in span)
    part = x[first:after]
    if not len(part) or not len(donor):
        return x
    fill = np.resize(donor, len(part))
    own, other = np.sqrt(np.mean(part**2)), np.sqrt(np.mean(fill**2))
    out = x.astype(np.float64).copy()
    if own > 0 and other > 0:
        out[first:after] += fill * (own / 10 ** (snr / 20) / other)
    return out


#: The transforms of a signal by name (AUD7).
KINDS = ("identity", "gaussian_noise", "gain", "truncate_at_slot", "local_overlap")


def transformed(df: DataFrame, kind: str, id_: str = "id", x: str = "x", **spec) -> DataFrame:
    """Rows with the column ``x`` transformed by kind (AUD7).

    ``local_overlap`` needs the columns donor, donor_rate, span_start and span_end;
    the truncation needs the span. What is already there is left out beforehand with
    ``contracts.pending`` on the listing of the target folder.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown transform {kind}")
    if kind == "identity":
        return df
    if kind == "gaussian_noise":
        return df.withColumn(x, add_noise(id_, x, spec["snr_db"], spec.get("seed", 0)))
    if kind == "gain":
        return df.withColumn(x, gain(x, spec["db"]))
    if kind == "truncate_at_slot":
        return df.withColumn(x, truncate_at(x, spec["rate"], "span_start", "span_end", spec["retain"]))

    @F.pandas_udf("array<double>")
    def overlap(xs: pd.Series, donors: pd.Series, rates: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([overlapped(np.asarray(v, np.float64), spec["rate"], np.asarray(d, np.float64), int(r), (a, b), spec["snr_db"]).tolist() for v, d, r, a, b in zip(xs, donors, rates, starts, ends, strict=True)])

    return df.withColumn(x, overlap(x, "donor", "donor_rate", "span_start", "span_end"))


def features_by_content(df: DataFrame, digest: str, x: str, rate: int) -> DataFrame:
    """Signal features of each distinct content once, joined back to all rows that have it (AUD8)."""
    one = df.groupBy(digest).agg(F.first(x).alias("_x"))
    measured = one.select(F.col(digest), duration("_x", rate).alias("audio_duration"), rms_db("_x").alias("audio_rms_db"), zero_fraction("_x").alias("audio_zero_fraction"), clip_fraction("_x").alias("audio_clipping_fraction"))
    return df.drop(x).join(measured, digest)
