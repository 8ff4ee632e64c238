"""Imputation of flagged cells and of missing values.

Targets are cells with OUTLIER_DETECTED or MISSING_ORIGINAL; the others are clean and supply the
statistics. Bounds come from the group if it has enough clean values, else from the feature, else
from the clean percentiles of all cells; a MAD of 0 goes by the rule of its strategy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.functions.scalar import normal_quantile, soft_clip
from quillon.operators import select
from quillon.operators.robust import MAD_SCALE, MIN_GROUP, back, median_mad
from quillon.operators.store import forget, stored
from quillon.schema import Quality, has_flag, set_flag


def target(flag: Column) -> Column:
    return has_flag(flag, Quality.OUTLIER_DETECTED | Quality.MISSING_ORIGINAL)


def global_bounds(cells: DataFrame, max_upper: float | None = None) -> DataFrame:
    """0.1 and 99.9 percentiles of the clean values; of all values where none is clean."""
    clean = F.when(~target(F.col("flag")), F.col("value"))
    values = stored(cells.select(clean.alias("clean"), "value"), "impute-values")  # read some times, so without what led to them
    low, high = select.quantiles(values, "clean", [0.001, 0.999])
    if low is None:
        low, high = select.quantiles(values, "value", [0.001, 0.999])
    forget(values)
    if max_upper is not None and high is not None:
        high = min(high, max_upper)
    return cells.sparkSession.createDataFrame([(low, high)], "g_low double, g_high double")


def _feature_and_group(cells: DataFrame, group_cols: list[str]) -> DataFrame:
    clean = ~target(F.col("flag"))
    f = median_mad(cells, ["feature_id"], where=clean).select("feature_id", F.col("n").alias("f_n"), F.col("med").alias("f_med"), F.col("mad").alias("f_mad"))
    j = back(cells, f, ["feature_id"])
    if group_cols:
        keys = ["feature_id", *group_cols]
        g = median_mad(cells, keys, where=clean).select(*keys, F.col("n").alias("s_n"), F.col("med").alias("s_med"), F.col("mad").alias("s_mad"))
        j = back(j, g, keys)
    return j


def _done(j: DataFrame, value: Column, cols: list[str]) -> DataFrame:
    hit = target(F.col("flag"))
    return j.withColumn("_new", value).withColumn("flag", set_flag(F.col("flag"), Quality.IMPUTED, hit)).withColumn("value", F.col("_new")).select(*cols)


def mad_clip(cells: DataFrame, threshold: float = 3.5, group_cols: list[str] | None = None, min_group: int = MIN_GROUP, max_upper: float | None = None) -> DataFrame:
    """Flagged values clipped to clean median +- threshold * MAD / 0.6745."""
    group_cols = group_cols or []
    j = back(_feature_and_group(cells, group_cols), global_bounds(cells, max_upper), [])
    half = lambda mad: threshold * F.col(mad) / MAD_SCALE
    f_ok = (F.col("f_n") >= 2) & (F.col("f_mad") > 0)
    if group_cols:
        in_group = F.col("s_n") >= min_group

        def bound(sign: int, fallback: str) -> Column:
            return F.when(in_group & (F.col("s_mad") == 0), F.col(fallback)).when(in_group, F.col("s_med") + sign * half("s_mad")).when(f_ok, F.col("f_med") + sign * half("f_mad")).otherwise(F.col(fallback))
    else:  # without a usable feature bound the value stays

        def bound(sign: int, fallback: str) -> Column:
            return F.when(f_ok, F.col("f_med") + sign * half("f_mad"))

    low, high = bound(-1, "g_low"), bound(1, "g_high")
    high = high if max_upper is None else F.when(high.isNotNull(), F.least(high, F.lit(max_upper)))
    v = F.col("value")
    clipped = F.when(v < low, low).when(v > high, high).otherwise(v)
    return _done(j, F.when(target(F.col("flag")), clipped).otherwise(v), cells.columns)


def soft_clip_cells(cells: DataFrame, threshold: float = 3.5, group_cols: list[str] | None = None, min_group: int = MIN_GROUP, sharpness: float | None = None, max_upper: float | None = None) -> DataFrame:
    """tanh clip of *every* value of a feature (of a feature's group) that has a flagged one; only flagged cells get IMPUTED."""
    group_cols = group_cols or []
    j = back(_feature_and_group(cells, group_cols), global_bounds(cells, max_upper), [])
    keys = ["feature_id", *group_cols]
    touched = cells.groupBy(*keys).agg(F.bool_or(target(F.col("flag"))).alias("_touched"))
    j = back(j, touched, keys)
    half = lambda mad: threshold * F.col(mad) / MAD_SCALE
    f_ok = (F.col("f_n") >= 2) & (F.col("f_mad") > 0)
    if group_cols:  # a group or feature without spread leaves its values
        in_group = F.col("s_n") >= min_group
        pick = lambda s: F.when(in_group & (F.col("s_mad") > 0), F.col("s_med") + s * half("s_mad")).when(~in_group & f_ok, F.col("f_med") + s * half("f_mad"))
        low, high = pick(-1), pick(1)
    else:
        low = F.when(f_ok, F.col("f_med") - half("f_mad")).otherwise(F.col("g_low"))
        high = F.when(f_ok, F.col("f_med") + half("f_mad")).otherwise(F.col("g_high"))
    high = high if max_upper is None else F.when(high.isNotNull(), F.least(high, F.lit(max_upper)))
    v = F.col("value")
    return _done(j, F.when(F.col("_touched") & low.isNotNull() & (low < high), soft_clip(v, low, high, sharpness)).otherwise(v), cells.columns)


def median_impute(cells: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Flagged values replaced by the clean median of the group, the feature, or all cells."""
    keys = ["feature_id", *(group_cols or [])]
    clean = F.when(~target(F.col("flag")), F.col("value"))
    m = cells.groupBy(*keys).agg(F.median(clean).alias("_m"))
    f = cells.groupBy("feature_id").agg(F.median(clean).alias("_f"))
    values = stored(cells.select(clean.alias("clean")), "impute-values")
    (g,) = select.quantiles(values, "clean", [0.5])
    forget(values)
    j = back(back(cells, m, keys), f, ["feature_id"]).withColumn("_g", F.lit(g).cast("double"))
    return _done(j, F.when(target(F.col("flag")), F.coalesce("_m", "_f", "_g", "value")).otherwise(F.col("value")), cells.columns)


# Missing values (null) ------------------------------------------------------------------------------


def missing_summary(cells: DataFrame) -> DataFrame:
    """One row: counts, rate, mechanism by the correlation of feature means and missing rates, censoring limit."""
    f = cells.groupBy("feature_id").agg(F.avg("value").alias("m"), F.avg(F.col("value").isNull().cast("double")).alias("r")).filter("m is not null and r < 1")
    n, cov = F.count("*"), F.avg(F.col("m") * F.col("r")) - F.avg("m") * F.avg("r")
    var = F.nullif(F.var_pop("m") * F.var_pop("r"), F.lit(0.0))
    corr = f.agg(n.alias("n_features"), (cov / F.sqrt(var)).alias("corr"))
    a = cells.agg(F.count_if(F.col("value").isNull()).alias("n_missing"), F.count("*").alias("n_cells")).withColumn("low", F.lit(select.quantiles(cells, "value", [0.001])[0]).cast("double"))
    kind = F.when((F.col("n_features") > 10) & (F.col("corr") < -0.3), "MNAR").when((F.col("n_features") > 10) & (F.col("corr") > 0.3), "MAR").otherwise("MIXED")
    return a.crossJoin(corr).select("n_missing", "n_cells", (F.col("n_missing") / F.col("n_cells")).alias("missing_rate"), kind.alias("mechanism"), F.when(kind != "MAR", F.col("low")).alias("censoring_threshold"))


def censoring_threshold(cells: DataFrame, method: str = "min_feature", percentile: float = 0.1) -> DataFrame:
    if method == "min_feature":
        return cells.groupBy("feature_id").agg(F.min("value").alias("m")).agg(F.coalesce(F.median("m"), F.lit(0.0)).alias("threshold"))
    p = {"percentile": percentile, "learned": 0.1}[method]
    (found,) = select.quantiles(cells, "value", [p / 100])
    return cells.sparkSession.createDataFrame([(found or 0.0,)], "threshold double")


def _fill(cells: DataFrame, value: Column) -> DataFrame:
    miss = F.col("value").isNull()
    flag = set_flag(F.col("flag"), Quality.IMPUTED | Quality.MISSING_ORIGINAL, miss) if "flag" in cells.columns else None
    out = cells.withColumn("_v", F.coalesce("value", value))
    out = out if flag is None else out.withColumn("flag", flag)
    return out.withColumn("value", F.col("_v")).drop("_v")


def impute_min(cells: DataFrame, method: str = "feature") -> DataFrame:
    """Missing values become the minimum of their feature, sample, or of all."""
    keys = {"feature": ["feature_id"], "sample": ["sample_id"], "global": []}[method]
    m = cells.groupBy(*keys).agg(F.min("value").alias("_min"))
    return _fill(back(cells, m, keys), F.col("_min")).select(*cells.columns)


def seeded_uniform(seed: int, *ids: str | Column) -> Column:
    """A uniform number in (0, 1) that depends on the seed and the ids alone, not on the partitioning."""
    h = F.xxhash64(F.lit(seed), *ids)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(2**53)


def impute_truncated_normal(cells: DataFrame, threshold: float | None = None, seed: int = 0) -> DataFrame:
    """Draws below the censoring limit from each feature's normal distribution (population standard deviation)."""
    c = censoring_threshold(cells) if threshold is None else cells.sparkSession.range(1).select(F.lit(float(threshold)).alias("threshold"))
    s = cells.groupBy("feature_id").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    j = back(back(cells, s, ["feature_id"]), c, [])
    sd = F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1e-6))
    top = normal_cdf((F.col("threshold") - F.col("_m")) / sd)
    draw = F.col("_m") + sd * normal_quantile(F.greatest(seeded_uniform(seed, "feature_id", "sample_id") * top, F.lit(1e-300)))
    return _fill(j, F.least(draw, F.col("threshold"))).select(*cells.columns)


def impute_quantile_left(cells: DataFrame, seed: int = 0, tune: float = 1.0) -> DataFrame:
    """Per-sample left-censored draws: median and normal-consistent MAD, uniform below the CDF of the minimum."""
    s = median_mad(cells, ["sample_id"]).select("sample_id", "med", (F.col("mad") * 1.4826 * tune).alias("_sd"))
    m = cells.groupBy("sample_id").agg(F.min("value").alias("_min"))
    j = back(back(cells, s, ["sample_id"]), m, ["sample_id"])
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1e-6))
    u = seeded_uniform(seed, "sample_id", "feature_id") * normal_cdf((F.col("_min") - F.col("med")) / sd)
    return _fill(j, F.col("med") + sd * normal_quantile(F.greatest(u, F.lit(1e-300)))).select(*cells.columns)


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    from quillon.functions import special

    return pd.Series(special.norm_cdf(z))


def nearest_samples(cells: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """s, feature_id, o, d, y: for each missing value the k nearest samples that have the feature, with its value there.

    d: root mean square distance over the features that both have, to 12 digits; equal ones go by the name of the sample.
    A task has a block of samples with gaps and one of eight times as many of all samples, multiplies them piece by piece
    (three products of values, squares and masks) and keeps k samples a missing value; no list of all pairs is written."""
    block = max(16, min(block, 2**20 // max(1, cells.select("feature_id").distinct().count())))
    centre = cells.groupBy("feature_id").agg(F.avg("value").alias("_c"))  # distances don't change, but the squares stay small
    have = F.col("value").isNotNull()
    packed = back(cells, centre, ["feature_id"]).groupBy("sample_id").agg(*(F.collect_list(F.when(have, x)).alias(n) for n, x in (("f", F.col("feature_id")), ("v", F.col("value") - F.col("_c")), ("y", F.col("value")))), F.collect_list(F.when(~have, F.col("feature_id"))).alias("w"))
    packed = stored(packed.filter(F.size("f") > 0), "knn-packed")
    with_gap = packed.filter(F.size("w") > 0)
    gaps, others = max(1, -(-with_gap.count() // block)), max(1, -(-packed.count() // (8 * block)))
    deal = lambda n: F.pmod(F.xxhash64("sample_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = with_gap.select("sample_id", "f", "v", "w", deal(gaps).alias("gb"), every(others).alias("ob"))
    right = packed.select("sample_id", "f", "v", "y", deal(others).alias("ob"), every(gaps).alias("gb"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = {f: i for i, f in enumerate(sorted({f for side in (left["f"], right["f"], left["w"]) for fs in side for f in fs}))}

        def dense(rows: pd.DataFrame, value: str = "v") -> tuple[np.ndarray, np.ndarray]:
            x, m = np.zeros((len(rows), len(at))), np.zeros((len(rows), len(at)))
            for i, (f, v) in enumerate(zip(rows["f"], rows[value])):
                j = [at[n] for n in f]
                x[i, j], m[i, j] = v, 1
            return x, m

        (x, mx), out = dense(left), [pd.DataFrame({"s": [], "feature_id": [], "o": [], "d": [], "y": []})]
        names = left["sample_id"].to_numpy()
        wanted = {f: np.array([i for i, w in enumerate(left["w"]) if f in w]) for f in sorted({f for w in left["w"] for f in w})}
        for start in range(0, len(right), block):
            part = right.iloc[start : start + block]
            (z, mz), raw, o = dense(part), dense(part, "y")[0], part["sample_id"].to_numpy()
            shared = mx @ mz.T
            gap = np.maximum((x * x) @ mz.T + mx @ (z * z).T - 2 * x @ z.T, 0)
            d = np.round(np.sqrt(np.divide(gap, shared, out=np.full_like(gap, np.inf), where=shared > 0)), 12)
            d[names[:, None] == o[None, :]] = np.inf
            for f, rows in wanted.items():
                has = np.flatnonzero(mz[:, at[f]])
                if not len(has):
                    continue
                near = d[np.ix_(rows, has)]
                limit = np.partition(near, min(k, len(has)) - 1, axis=1)[:, min(k, len(has)) - 1]
                i, j = np.nonzero((near <= limit[:, None]) & (near < np.inf))
                out.append(pd.DataFrame({"s": names[rows[i]], "feature_id": f, "o": o[has[j]], "d": near[i, j], "y": raw[has[j], at[f]]}))
        found = pd.concat(out).sort_values(["s", "feature_id", "d", "o"])
        return found.groupby(["s", "feature_id"], sort=False).head(k)

    found = left.groupBy("gb", "ob").cogroup(right.groupBy("gb", "ob")).applyInPandas(nearest, "s string, feature_id string, o string, d double, y double")
    return found.withColumn("rk", F.row_number().over(Window.partitionBy("s", "feature_id").orderBy("d", "o"))).filter(F.col("rk") <= k).drop("rk")


def impute_knn(cells: DataFrame, k: int = 10) -> DataFrame:
    """Missing values by the distance-weighted mean of the k nearest samples that have the feature (`nearest_samples`)."""
    near = nearest_samples(cells, k)
    zero = F.max(F.when(F.col("d") == 0, F.col("y")))
    w = 1 / F.nullif(F.col("d"), F.lit(0.0))
    fill = near.groupBy("s", "feature_id").agg(F.coalesce(zero, F.try_divide(F.sum(w * F.col("y")), F.sum(w))).alias("_k")).withColumnRenamed("s", "sample_id")
    return _fill(back(cells, fill, ["sample_id", "feature_id"]), F.col("_k")).select(*cells.columns)


def impute_missing(cells: DataFrame, method: str = "aft", censored_at: float | None = None, **how) -> DataFrame:
    """Dispatch; values at or below ``censored_at`` count as missing first."""
    if censored_at is not None:
        cells = cells.withColumn("value", F.when(F.col("value") > censored_at, F.col("value")))
    return {"none": lambda c: c, "min": impute_min, "aft": impute_truncated_normal, "qrilc": impute_quantile_left, "knn": impute_knn}[method](cells, **how)
