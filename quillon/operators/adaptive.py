"""Distribution-aware outlier detection: medcouple fences, Student-t tails, kernel-density thresholds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.functions import special
from quillon.operators.robust import MAD_CONSISTENCY, MAD_SCALE, MIN_GROUP, adjusted_fences, back, median_mad
from quillon.schema import Quality, set_flag


def medcouple(x: np.ndarray, times: np.ndarray | None = None) -> float:
    """Median of the kernel over pairs around the median; pairs of equal values are dropped, ties at the median give +-1.

    ``times``: how often each value occurs. The kernel grows with both values of a pair, so pairs up to a limit are counted
    by a search per distinct value above the median, and the limit is halved in: memory is that of the distinct values."""
    times = np.ones(len(x), np.int64) if times is None else times
    ok = np.isfinite(x)
    x, at = np.unique(x[ok], return_inverse=True)
    times = np.bincount(at, times[ok], len(x)).astype(np.int64)
    n = int(times.sum())
    if n < 3:
        return 0.0
    upto = np.cumsum(times)
    m = (x[np.searchsorted(upto, (n - 1) // 2, side="right")] + x[np.searchsorted(upto, n // 2, side="right")]) / 2
    low, high = x[x < m], x[x > m]
    below = np.concatenate([[0], np.cumsum(times[x < m])])
    above, same = times[x > m], int(times[x == m].sum())
    downs, ups = same * int(above.sum()), same * int(below[-1])  # pairs with the median: -1 and 1
    inner = int(above.sum()) * int(below[-1])
    if not (total := downs + inner + ups):
        return 0.0

    def kernel(columns: np.ndarray) -> np.ndarray:
        return ((high - m) - (m - low[columns])) / (high - low[columns])

    def reach(limit: float, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """How many of the values below the median have a kernel up to the limit, for each one above it."""
        first, last = first.copy(), last.copy()
        while (open_ := first < last).any():
            middle = (first + last) // 2
            small = open_ & (kernel(np.minimum(middle, len(low) - 1)) <= limit)
            first, last = np.where(small, middle + 1, first), np.where(open_ & ~small, middle, last)
        return first

    def ranked(k: int) -> float:
        """The k-th smallest kernel, from 0."""
        if k < downs:
            return -1.0
        if k >= downs + inner:
            return 1.0
        k -= downs
        start, end = -1.0 - 1e-9, 1.0
        first, last = np.zeros(len(high), np.int64), np.full(len(high), len(low))
        for _ in range(60):
            middle = (start + end) / 2
            here = reach(middle, first, last)
            if int(above @ below[here]) > k:
                end, last = middle, here
            else:
                start, first = middle, here
        while True:  # the next larger kernel, and again while it doesn't reach k
            left = first < len(low)
            value = kernel(np.minimum(first, len(low) - 1))[left].min()
            first = reach(value, first, np.full(len(high), len(low)))
            if int(above @ below[first]) > k:
                return float(value)

    return (ranked((total - 1) // 2) + ranked(total // 2)) / 2


@F.pandas_udf(DoubleType())
def medcouple_of(values: pd.Series, times: pd.Series) -> float:
    return medcouple(values.to_numpy(float), times.to_numpy(np.int64))


def adjusted_boxplot(cells: DataFrame, keys: list[str], whis: float = 1.5) -> DataFrame:
    """Cells flagged outside medcouple-adjusted fences per ``keys``; with groups, fewer than MIN_GROUP values flag nothing.

    The medcouple needs a key's distinct values with their counts together in a task (an Arrow aggregate); quartiles stay built in."""
    q = cells.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("value").alias("n"))
    counts = cells.filter("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("times"))
    mc = counts.groupBy(*keys).agg(medcouple_of("value", "times").alias("mc"))
    j = back(q, mc, keys) if keys else q.crossJoin(F.broadcast(mc))
    low, high = adjusted_fences(F.col("q")[0], F.col("q")[2], F.col("q")[1], F.col("mc"), F.col("n"), whis)
    j = j.select(*keys, low.alias("_low"), high.alias("_high"), "n")
    c = back(cells, j, keys)
    out = (F.col("value") < F.col("_low")) | (F.col("value") > F.col("_high"))
    if len(keys) > 1:
        out = out & (F.col("n") >= MIN_GROUP)
    return c.withColumn("flag", set_flag(F.col("flag"), Quality.OUTLIER_DETECTED, out)).select(*cells.columns)


def standardised(cells: DataFrame) -> DataFrame:
    """``z``: (value - median) / (1.4826 MAD), MAD 0 counting as scale 1; features with fewer than three values have null."""
    s = median_mad(cells, ["feature_id"])
    scale = F.when(F.col("mad") > 0, F.col("mad") * MAD_CONSISTENCY).otherwise(1.0)
    return back(cells, s, ["feature_id"]).withColumn("z", F.when(F.col("n") >= 3, (F.col("value") - F.col("med")) / scale)).select(*cells.columns, "z")


def shared_df(z: DataFrame, low: float = 2.1, high: float = 100.0, rounds: int = 4, grid: int = 16) -> float:
    """Maximum-likelihood degrees of freedom of pooled z; each round is one aggregate over a grid, then it zooms in."""
    for _ in range(rounds):
        nus = np.linspace(low, high, grid)
        sums = z.filter("z is not null").agg(F.count("*").alias("n"), *(F.sum(F.log1p(F.col("z") ** 2 / float(nu))).alias(f"s{i}") for i, nu in enumerate(nus))).first()
        if not sums["n"]:
            return high
        ll = [sums["n"] * (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)) - (nu + 1) / 2 * sums[f"s{i}"] for i, nu in enumerate(nus)]
        i = int(np.argmax(ll))
        low, high = float(nus[max(0, i - 1)]), float(nus[min(grid - 1, i + 1)])
    return float(min(100.0, max(2.1, (low + high) / 2)))


def student_t_outliers(cells: DataFrame, p_threshold: float = 0.001, df: float | None = None) -> DataFrame:
    """Cells whose two-sided tail is below ``p_threshold``; ``outlier_p`` is 1 for missing values."""
    if not 0 < p_threshold < 1:
        raise ValueError("the threshold is a probability here")
    z = standardised(cells)
    nu = shared_df(z) if df is None else df

    @F.pandas_udf(DoubleType())
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series(np.where(x.isna(), 1.0, special.t_two_sided(x.fillna(0.0), nu)))

    r = z.withColumn("outlier_p", tail("z"))
    return r.withColumn("flag", set_flag(F.col("flag"), Quality.OUTLIER_DETECTED, F.col("outlier_p") < p_threshold)).select(*cells.columns, "outlier_p")


def qq_points(cells: DataFrame, df: float, points: int = 200) -> DataFrame:
    """probability, observed z quantile, t quantile."""
    p = [(i + 0.5) / points for i in range(points)]
    q = standardised(cells).agg(F.percentile("z", F.array(*map(F.lit, p))).alias("q")).select(F.posexplode("q").alias("i", "observed"))
    t = cells.sparkSession.createDataFrame([(i, x, float(special.t_ppf(x, df))) for i, x in enumerate(p)], "i int, probability double, theoretical double")
    return q.join(F.broadcast(t), "i").select("probability", "observed", "theoretical")


def _smooth(x: np.ndarray) -> np.ndarray:
    """Gaussian filter of standard deviation 1, reflected at the ends."""
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    return np.convolve(np.pad(x, 4, mode="symmetric"), k / k.sum(), mode="valid")


def _widths(s: np.ndarray, k: int) -> np.ndarray:
    """Distance of each of the sorted values to its k-th nearest (itself counted): a window's half width."""
    idx = np.arange(len(s))
    width = np.full(len(s), np.inf)
    for left in range(k):
        a, b = idx - left, idx - left + k - 1
        ok = (a >= 0) & (b < len(s))
        width[ok] = np.minimum(width[ok], np.maximum(s[idx[ok]] - s[a[ok]], s[b[ok]] - s[idx[ok]]))
    return np.clip(width, 0.01, None)


def _kernels(grid: np.ndarray, s: np.ndarray, width: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sum of the kernels of the sorted values at each grid point."""
    density = np.zeros(len(grid))
    for part in np.array_split(np.arange(len(s)), max(1, len(s) // 2000)):
        x, w = s[part], width[part]
        # beyond 39 widths a kernel is 0 in double precision
        at = slice(np.searchsorted(grid, (x - 39 * w).min()), np.searchsorted(grid, (x + 39 * w).max(), side="right"))
        u = (grid[at, None] - x) / w
        density[at] += np.exp(-0.5 * u * u) @ (times[part] / (w * math.sqrt(2 * math.pi)))
    return density


def _fall(grid: np.ndarray, density: np.ndarray, tail: float, sensitivity: float, low: float, high: float) -> float:
    """Where the tail of a density over the grid begins to fall off steadily."""
    density = _smooth(density)
    right = np.cumsum(density[::-1] * (grid[1] - grid[0]))[::-1]
    below = np.flatnonzero(right <= tail)
    start = int(below[0]) if len(below) else int(0.95 * 500)
    slope = _smooth(np.gradient(density))
    at = next((i for i in range(start, 500 - 5) if slope[i : i + 5].mean() < -sensitivity and (slope[i : i + 5] < 0).all()), start)
    return float(np.clip(grid[min(at, 499)], low, high))


def kde_threshold(scores: np.ndarray, k: int = 50, tail: float = 0.005, sensitivity: float = 1e-4, low: float = 2.5, high: float = 6.0, fallback: float = 3.0) -> float:
    """Where the tail of an adaptive kernel density begins to fall off steadily; fewer than 50 scores give the fallback."""
    s = np.sort(scores[np.isfinite(scores)])
    if len(s) < 50 or s[0] == s[-1]:
        return fallback
    grid = np.linspace(s[0], s[-1], 500)
    density = _kernels(grid, s, _widths(s, min(k, len(s) - 1)), np.ones(len(s)))
    return _fall(grid, density / len(s), tail, sensitivity, low, high)


def _in_blocks(scores: DataFrame, group: str, k: int, rows: int) -> DataFrame:
    """group, z, times, block, own, n, lo, hi: the distinct scores of each group in blocks of about ``rows`` scores by
    order, and beside each block's own the ``k`` before and the ``k`` after it."""
    most = 1000
    d = scores.groupBy(group, "z").agg(F.count("*").alias("times"))  # equal scores are one row
    stats = d.groupBy(group).agg(F.sum("times").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    # the borders of large groups alone: one for every ``rows`` scores at most
    large = back(scores, stats.filter(F.col("n") > rows), [group]).filter("n is not null")
    borders = large.groupBy(group).agg(F.first("n").alias("n"), F.percentile_approx("z", F.array(*(F.lit(i / most) for i in range(1, most))), 100 * most).alias("q"))
    step = F.ceil(most / F.least(F.lit(most), F.ceil(F.col("n") / rows))).cast("int")
    borders = borders.select(group, F.array_distinct(F.filter("q", lambda x, i: (i + 1) % step == 0)).alias("borders"))
    borders = scores.sparkSession.createDataFrame(borders.collect(), borders.schema)  # approximate, so taken once
    block = F.coalesce(F.size(F.filter("borders", lambda x: x <= F.col("z"))), F.lit(0))
    d = back(d, F.broadcast(borders), [group]).withColumn("block", F.when(F.col("borders").isNull(), 0).otherwise(block)).drop("borders")
    own = back(d, stats, [group]).select(group, "z", "times", "block", F.lit(True).alias("own"), "n", "lo", "hi")

    # a block's outer scores, k at either end, hold what its neighbours need
    w = Window.partitionBy(group, "block")
    outer = own.join(F.broadcast(borders.select(F.col(group).alias("_g")).distinct()), F.col(group).eqNullSafe(F.col("_g")), "left_semi")
    up = outer.withColumn("_at", F.row_number().over(w.orderBy("z"))).filter(F.col("_at") <= k).drop("_at")
    down = outer.withColumn("_at", F.row_number().over(w.orderBy(F.desc("z")))).filter(F.col("_at") <= k).drop("_at")

    def halos(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("z")
        blocks, out = rows["block"].to_numpy(), []
        for b in np.unique(blocks):
            i, j = np.searchsorted(blocks, b), np.searchsorted(blocks, b, side="right")
            out.append(pd.concat([rows.iloc[max(0, i - k) : i], rows.iloc[j : j + k]]).assign(block=b, own=False))
        return pd.concat(out)

    return own.unionByName(up.union(down).distinct().groupBy(group).applyInPandas(lambda rows: halos(rows), own.schema))


def kde_outliers(cells: DataFrame, group: str, k: int = 50, fallback: float = 3.0, block_rows: int = 100_000, **how) -> DataFrame:
    """MAD-z of positive values per (feature, group), cut at each group's density threshold; features without spread are skipped.

    The density of a group is that of all its scores (``kde_threshold``). Sorted scores are dealt to blocks of bounded
    size, which see as many neighbours on either side as a bandwidth needs; the densities of a group's blocks are
    summed per grid point."""
    c = cells.withColumn("_pos", F.when(F.col("value") > 0, F.col("value")))
    s = median_mad(c, ["feature_id", group], "_pos").filter("mad >= 1e-10")
    z = back(c, s, ["feature_id", group]).withColumn("z", (F.col("_pos") - F.col("med")) * MAD_SCALE / F.col("mad"))
    scores = z.filter("z > 0 and z < double('infinity')").select(group, "z")
    settings = {"tail": 0.005, "sensitivity": 1e-4, "low": 2.5, "high": 6.0} | how

    def density(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("z")
        n, lo, hi = int(rows["n"].iloc[0]), float(rows["lo"].iloc[0]), float(rows["hi"].iloc[0])
        out = rows[[group, "block", "n", "lo", "hi"]].head(1)
        if n < 50 or lo == hi:
            return out.assign(density=[[]])
        x, times, own = rows["z"].to_numpy(float), rows["times"].to_numpy(np.int64), rows["own"].to_numpy(bool)
        near = min(k, n - 1)
        seen = np.minimum(times, near)  # further equal scores leave the distances as they are
        width = _widths(np.repeat(x, seen), near)[np.cumsum(seen) - seen]
        return out.assign(density=[_kernels(np.linspace(lo, hi, 500), x[own], width[own], times[own].astype(float))])

    @F.pandas_udf(DoubleType())
    def cut(blocks: pd.Series, n: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        def one(parts, n, lo, hi):
            if n < 50 or lo == hi:
                return fallback
            return _fall(np.linspace(lo, hi, 500), np.sum([p["density"] for p in parts], axis=0) / n, **settings)

        return pd.Series([one(*x) for x in zip(blocks, n, lo, hi)])

    dealt = _in_blocks(scores, group, k, block_rows)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(group, "block", "n", "lo", "hi").schema)
    parts = dealt.groupBy(group, "block").applyInPandas(lambda rows: density(rows), fields + ", density array<double>")
    t = parts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("block", "density"))).alias("blocks"), *(F.first(x).alias(x) for x in ("n", "lo", "hi")))
    t = t.select(group, cut("blocks", "n", "lo", "hi").alias("threshold"))
    j = back(z, t, [group])
    return j.withColumn("flag", set_flag(F.col("flag"), Quality.OUTLIER_DETECTED, F.col("z") > F.col("threshold"))).select(*cells.columns, "threshold")
