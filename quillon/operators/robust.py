"""Robust outlier detection on cells (feature_id, sample_id, value, flag [, group column]).

Each detector is two exact percentile aggregates and a join on the few aggregate rows; nothing is
collected. Bounds come back by broadcast only if Catalyst finds them small. Flags are OR-ed bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import select
from quillon.operators.store import forget, stored
from quillon.schema import Quality, has_flag, set_flag

#: Fixed consistency constants; the two are not reciprocal to the last digit.
MAD_SCALE, MAD_CONSISTENCY = 0.6745, 1.4826
MIN_GROUP = 10


def back(cells: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``stats`` joined back to the cells by ``keys`` (null-safe); one row for all without keys."""
    if not keys:
        return cells.crossJoin(F.broadcast(stats))  # one row
    s = stats.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in stats.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (cells[k].eqNullSafe(s[f"_{k}"]) for k in keys))
    return cells.join(s, on, "left").drop(*(f"_{k}" for k in keys))


def median_mad(cells: DataFrame, keys: list[str], value: str = "value", where: Column | None = None) -> DataFrame:
    """keys, n, med, mad of the non-null values for which ``where`` holds; without keys by `select.quantiles`."""
    x = F.col(value) if where is None else F.when(where, F.col(value))
    if not keys:  # one row for all values: counted, not gathered
        row = select.median_mad(cells, x)
        return cells.sparkSession.createDataFrame([row], "n bigint, med double, mad double")
    d = cells.withColumn("_x", x)
    med = d.groupBy(*keys).agg(F.median("_x").alias("med"), F.count("_x").alias("n"))
    dev = back(d.select(*keys, "_x"), med, keys)
    return dev.groupBy(*keys).agg(F.first("n").alias("n"), F.first("med").alias("med"), F.median(F.abs(F.col("_x") - F.col("med"))).alias("mad"))


def mad_bounds(stats: DataFrame, lower: float, upper: float) -> DataFrame:
    """lower and upper bound; a MAD of 0 counts as 1."""
    scaled = F.when(F.col("mad") == 0, F.lit(1.0)).otherwise(F.col("mad")) / MAD_SCALE
    return stats.withColumn("lower", F.col("med") - lower * scaled).withColumn("upper", F.col("med") + upper * scaled)


def iqr_bounds(cells: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Tukey fences with interpolated quartiles."""
    if keys:
        q = cells.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("value").alias("n"))
    else:
        row = select.quantiles(cells, "value", [0.25, 0.75]), cells.agg(F.count("value")).first()[0]
        q = cells.sparkSession.createDataFrame([row], "q array<double>, n bigint")
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.withColumn("lower", F.col("q")[0] - threshold * iqr).withColumn("upper", F.col("q")[1] + threshold * iqr).drop("q")


def outlier_bounds(cells: DataFrame, method: str = "mad-z", mode: str = "per_feature", group_cols: list[str] | None = None, threshold: float = 3.5, lower_threshold: float | None = None, upper_threshold: float | None = None) -> tuple[DataFrame, list[str]]:
    """Bounds and their keys. Groups of fewer than MIN_GROUP samples have null bounds: they are never flagged."""
    keys = {"per_feature": ["feature_id"], "within_group": ["feature_id", *(group_cols or [])], "global": []}[mode]
    if method == "mad-z":
        low, high = (threshold if t is None else t for t in (lower_threshold, upper_threshold))
        b = mad_bounds(median_mad(cells, keys), low, high)
    elif method == "iqr":  # asymmetric thresholds don't apply here
        b = iqr_bounds(cells, keys, threshold)
    else:
        raise ValueError(f"unknown method {method}")
    if mode == "within_group":
        b = b.withColumns({c: F.when(F.col("n") >= MIN_GROUP, F.col(c)) for c in ("lower", "upper")})
    return b.select(*keys, "lower", "upper"), keys


def detect_outliers(cells: DataFrame, **how) -> DataFrame:
    """Cells with OUTLIER_DETECTED set outside the bounds (strictly)."""
    bounds, keys = outlier_bounds(cells, **how)
    j = back(cells, bounds, keys)
    out = (F.col("value") > F.col("upper")) | (F.col("value") < F.col("lower"))
    return j.withColumn("flag", set_flag(F.col("flag"), Quality.OUTLIER_DETECTED, out)).select(*cells.columns)


def residual_cells(cells: DataFrame) -> DataFrame:
    """``residual``: value - feature median - sample median + grand median."""
    f = cells.groupBy("feature_id").agg(F.median("value").alias("f_med"))
    s = cells.groupBy("sample_id").agg(F.median("value").alias("s_med"))
    (g,) = select.quantiles(cells, "value", [0.5])
    j = back(back(cells, f, ["feature_id"]), s, ["sample_id"]).withColumn("g_med", F.lit(g).cast("double"))
    return j.withColumn("residual", F.col("value") - (F.col("f_med") + F.col("s_med") - F.col("g_med"))).select(*cells.columns, "residual")


def multipass_outliers(cells: DataFrame, threshold: float = 5.0, residual_threshold: float = 4.0, high_end_only: bool = True, cap_percentile: float = 99.95, **how) -> DataFrame:
    """Three passes whose flags are OR-ed; columns pass1, pass2, pass3 tell each pass's own finds.

    Each pass is stored, so that no later one computes it again; the medians over all cells are numbers."""
    cells = stored(cells, "multipass-cells")
    first = stored(detect_outliers(cells, threshold=threshold, **how), "multipass-first")
    r = stored(residual_cells(first), "multipass-residuals")
    _, med, mad = select.median_mad(r, "residual")
    (cap,) = select.quantiles(cells, "value", [cap_percentile / 100])
    j = r.withColumns({"r_med": F.lit(med).cast("double"), "r_mad": F.lit(None if mad is None else mad * MAD_CONSISTENCY).cast("double"), "cap": F.lit(cap).cast("double")})
    forget(cells, first)
    z = (F.col("residual") - F.col("r_med")) / F.nullif(F.col("r_mad"), F.lit(0.0))
    p1 = has_flag(F.col("flag"), Quality.OUTLIER_DETECTED)
    p2 = F.coalesce((z if high_end_only else F.abs(z)) > residual_threshold, F.lit(False))
    p3 = F.coalesce(F.col("value") > F.col("cap"), F.lit(False))
    j = j.withColumn("pass1", p1).withColumn("pass2", p2 & ~p1).withColumn("pass3", p3 & ~p1 & ~p2)
    return j.withColumn("flag", set_flag(F.col("flag"), Quality.OUTLIER_DETECTED, p1 | p2 | p3)).select(*cells.columns, "pass1", "pass2", "pass3")


def pass_summary(passes: DataFrame) -> DataFrame:
    return passes.agg(*(F.count_if(p).alias(f"n_{p}") for p in ("pass1", "pass2", "pass3")), F.count("*").alias("n_cells"))


def group_residuals(cells: DataFrame, group: str) -> DataFrame:
    """One-factor residuals: value minus the mean of its (feature, group)."""
    m = cells.groupBy("feature_id", group).agg(F.avg("value").alias("_mean"))
    return back(cells, m, ["feature_id", group]).withColumn("residual", F.col("value") - F.col("_mean")).drop("_mean")


def residual_outliers(cells: DataFrame, group: str, threshold: float = 5.0) -> DataFrame:
    """MAD-z of one-factor residuals; features with a MAD of 0 or fewer than three values are skipped."""
    r = group_residuals(cells, group)
    s = median_mad(r, ["feature_id"], "residual").filter("mad > 0 and n >= 3")
    j = back(r, s, ["feature_id"])
    out = F.abs(F.col("residual") - F.col("med")) > threshold * F.col("mad") / MAD_SCALE
    return j.withColumn("flag", set_flag(F.col("flag"), Quality.OUTLIER_DETECTED, out)).select(*cells.columns, "residual")


def adjusted_fences(q1: Column, q3: Column, med: Column, mc: Column, n: Column, whis: float = 1.5) -> tuple[Column, Column]:
    """Fences of the adjusted boxplot for a medcouple; unbounded below four values."""
    iqr = q3 - q1
    a = F.when(mc >= 0, -4.0).otherwise(-3.0)
    b = F.when(mc >= 0, 3.0).otherwise(4.0)
    low = F.when(iqr == 0, med - 1e-10).otherwise(q1 - whis * F.exp(a * mc) * iqr)
    high = F.when(iqr == 0, med + 1e-10).otherwise(q3 + whis * F.exp(b * mc) * iqr)
    return F.when(n < 4, F.lit(float("-inf"))).otherwise(low), F.when(n < 4, F.lit(float("inf"))).otherwise(high)


def sensitivity_sweep(cells: DataFrame, thresholds: list[float], group_cols: list[str] | None = None) -> DataFrame:
    """Outliers per MAD-z threshold in one job: the aggregate is shared, the thresholds are a small table."""
    keys = ["feature_id", *(group_cols or [])]
    stats = median_mad(cells, keys)
    scaled = F.when(F.col("mad") == 0, F.lit(1.0)).otherwise(F.col("mad")) / MAD_SCALE
    z = F.abs(F.col("value") - F.col("med")) / scaled
    z = F.when(F.col("n") >= MIN_GROUP, z) if group_cols else z
    j = back(cells, stats, keys).withColumn("z", z)
    j = j.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("out", F.coalesce(F.col("z") > F.col("threshold"), F.lit(False)))
    return j.groupBy("threshold").agg(
        F.count_if("out").alias("n_outliers"), F.count("*").alias("n_cells"), (100.0 * F.count_if("out") / F.count("*")).alias("pct_outliers"),
        F.count_distinct(F.when(F.col("out"), F.col("feature_id"))).alias("n_features"), F.count_distinct(F.when(F.col("out"), F.col("sample_id"))).alias("n_samples"),
    )
