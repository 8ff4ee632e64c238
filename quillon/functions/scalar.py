"""Scalar statistics as Column expressions; tails of distributions as Arrow UDFs (Spark has no erf)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.functions import special

#: Standard error factor of a rank or maximum correlation's z.
RANK_SE = 1.06


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def fisher_z(r: Column) -> Column:
    """atanh of r, clipped at 0.9999."""
    return F.atanh(clip(r, -0.9999, 0.9999))


def inverse_fisher_z(z: Column) -> Column:
    return F.tanh(z)


def fisher_z_se(n: Column, method: str = "pearson") -> Column:
    """1 / sqrt(n - 3); null below four samples."""
    base = 1 / F.sqrt(n - 3)
    return F.when(n >= 4, base if method == "pearson" else RANK_SE * base)


def correlation_ci(r: Column, n: Column, alpha: float = 0.05, method: str = "pearson") -> tuple[Column, Column]:
    half = float(special.norm_ppf(1 - alpha / 2)) * fisher_z_se(n, method)
    return F.tanh(fisher_z(r) - half), F.tanh(fisher_z(r) + half)


def fisher_z_difference(r1: Column, n1: Column, r2: Column, n2: Column, method: str = "pearson") -> Column:
    """z of two independent correlations."""
    s1, s2 = fisher_z_se(n1, method), fisher_z_se(n2, method)
    return (fisher_z(r1) - fisher_z(r2)) / F.sqrt(s1 * s1 + s2 * s2)


def coherence_z(r1: Column, n1: Column, r2: Column, n2: Column) -> Column:
    """The variant that clips at 0.999 and is 0 below four samples."""
    z = (F.atanh(clip(r1, -0.999, 0.999)) - F.atanh(clip(r2, -0.999, 0.999))) / F.sqrt(1 / F.nullif(n1 - 3, F.lit(0)) + 1 / F.nullif(n2 - 3, F.lit(0)))
    return F.when((n1 < 4) | (n2 < 4), F.lit(0.0)).otherwise(z)


def soft_clip(x: Column, lower: Column, upper: Column, sharpness: float | None = None) -> Column:
    """centre + half range * tanh(k (x - centre)), k = 2 / range by default; the midpoint where the range vanishes."""
    centre, half = (lower + upper) / 2, (upper - lower) / 2
    k = F.lit(sharpness) if sharpness is not None else 2 / F.nullif(upper - lower, F.lit(0.0))
    return F.when(F.abs(upper - lower) < 1e-10, centre).otherwise(centre + half * F.tanh(k * (x - centre)))


def squeeze_var(s2: Column, df: Column, d0: float, s0_sq: float) -> Column:
    """Variance moderated towards its prior."""
    return F.lit(s0_sq) if math.isinf(d0) else (d0 * s0_sq + df * s2) / (d0 + df)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic."""
    return pd.Series(special.t_two_sided(t, df))


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    """Two-sided p of a z statistic."""
    return pd.Series(2 * special.norm_sf(z.abs()))


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series(special.norm_ppf(p))


@F.pandas_udf(DoubleType())
def hypergeometric_p(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series([special.hypergeom_sf(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, total, marked, drawn)])


def critical_r(n: int, alpha: float = 0.05, n_tests: int = 1) -> float:
    """The correlation that is significant with n samples, Bonferroni-corrected."""
    t = float(special.t_ppf(1 - alpha / n_tests / 2, n - 2))
    return t / math.sqrt(n - 2 + t * t)
