"""Exact order statistics of a whole column without a shared buffer.

A pass counts the values of each sought rank's interval in ``BINS`` equal parts, with the least and largest value in
each; the part that holds the rank is the next interval, between values that are really there. Odd passes cut the
interval evenly by logarithm, so that a few huge values don't stretch all parts; each part is an order-preserving
function of the value, so ranks stay exact. A pass moves at most ranks x BINS rows of counts, whatever the input;
usually one or two suffice, until what the parts hold is at most ``FEW`` values, which are looked at.
"""

from __future__ import annotations

import bisect
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096
FEW = 20_000


def _position(x: Column, low: float, high: float, log: bool) -> Column:
    """Part of [low, high] a value lies in; never decreasing in x."""
    if log:
        f = lambda v: F.signum(v) * F.log1p(F.abs(v) * 1e300)
        g = lambda v: math.copysign(math.log1p(abs(v) * 1e300), v) if abs(v) < 1e8 else math.copysign(math.log(abs(v)) + 300 * math.log(10), v)
        x = F.when(F.abs(x) < 1e8, f(x)).otherwise(F.signum(x) * (F.log(F.abs(x)) + 300 * math.log(10)))
        low, high = g(low), g(high)
    if not high > low:
        return F.lit(0)
    scale = BINS / (high - low)
    if not math.isfinite(scale) or not math.isfinite(high - low):  # half the values at a time
        middle = low / 2 + high / 2
        return F.when(x > middle, 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((x - low) * scale).cast("int")))


def at_ranks(df: DataFrame, value: str | Column, ranks: list[int], bounds: tuple[float, float] | None = None) -> list[float]:
    """The values at these ranks (from 0) of the non-null values in order."""
    col = F.col(value) if isinstance(value, str) else value
    rows = df.select(col.cast("double").alias("x")).filter("x is not null")
    if bounds is None:
        bounds = tuple(rows.agg(F.min("x"), F.max("x")).first())
    open_, done, log = {k: (*bounds, k, math.inf) for k in set(ranks)}, {}, False
    while True:
        for k, (low, high, *_) in list(open_.items()):
            if low == high:
                done[k] = low
                del open_[k]
        if not open_:
            return [done[k] for k in ranks]
        sizes = {(low, high): n for low, high, _, n in open_.values()}
        spans = sorted(sizes)
        if sum(sizes.values()) <= FEW:
            near = [F.col("x").between(low, high) for low, high in spans]
            values = sorted(r["x"] for r in rows.filter(reduce(lambda a, b: a | b, near)).collect())
            for k, (low, _, rank, _) in open_.items():
                done[k] = values[bisect.bisect_left(values, low) + rank]
            return [done[k] for k in ranks]
        where = F.array_compact(F.array(*(F.when(F.col("x").between(low, high), F.struct(F.lit(i).alias("span"), _position(F.col("x"), low, high, log).alias("part"))) for i, (low, high) in enumerate(spans))))
        parts = rows.select("x", F.explode(where).alias("at")).groupBy("at.span", "at.part").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        found: dict[int, list] = {}
        for r in parts.collect():  # at most BINS rows a rank
            found.setdefault(r["span"], []).append((r["part"], r["n"], r["low"], r["high"]))
        for k, (low, high, rank, _) in open_.items():
            for _, n, least, most in sorted(found[spans.index((low, high))]):
                if rank < n:
                    open_[k] = (least, most, rank, n)
                    break
                rank -= n
        log = not log


def quantiles(df: DataFrame, value: str | Column, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; None of a column without values."""
    col = F.col(value) if isinstance(value, str) else value
    n, low, high = df.select(col.cast("double").alias("x")).agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    ranks = sorted({r for p in at for r in (math.floor(p), math.ceil(p))})
    values = dict(zip(ranks, at_ranks(df, col, ranks, (low, high))))
    mixed = lambda p, a, b: a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b
    return [mixed(p, values[math.floor(p)], values[math.ceil(p)]) for p in at]


def median_mad(df: DataFrame, value: str | Column) -> tuple[int, float | None, float | None]:
    """Number of values, median and median absolute deviation of a whole column."""
    col = F.col(value) if isinstance(value, str) else value
    n = df.agg(F.count(col)).first()[0]
    (med,) = quantiles(df, col, [0.5])
    return n, med, None if med is None else quantiles(df, F.abs(col - F.lit(med)), [0.5])[0]
