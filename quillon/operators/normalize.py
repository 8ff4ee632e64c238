"""Normalisation of samples, expression filters, and summaries of features by sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import clip
from quillon.operators.robust import back
from quillon.operators.store import forget, stored


def median_normalize(cells: DataFrame, reference: str = "global") -> DataFrame:
    """value minus (sample median - reference median); references: global, first (sample id), median_sample."""
    m = cells.groupBy("sample_id").agg(F.median("value").alias("_m"))
    if reference == "global":
        ref = m.agg(F.median("_m").alias("_ref"))
    elif reference == "first":
        ref = m.agg(F.min_by("_m", "sample_id").alias("_ref"))
    elif reference == "median_sample":
        g = m.agg(F.median("_m").alias("_g"))
        ref = back(m, g, []).agg(F.min_by("_m", F.struct(F.abs(F.col("_m") - F.col("_g")), "sample_id")).alias("_ref"))
    else:
        raise ValueError(reference)
    return back(back(cells, m, ["sample_id"]), ref, []).withColumn("value", F.col("value") - (F.col("_m") - F.col("_ref"))).select(*cells.columns)


def standards_normalize(cells: DataFrame, standards: DataFrame, method: str = "median") -> DataFrame:
    """Samples shifted so that their standards' centre meets the centre of all samples'."""
    agg = F.median if method == "median" else F.avg
    s = cells.join(standards.select("feature_id").distinct(), "feature_id", "left_semi").groupBy("sample_id").agg(agg("value").alias("_m"))
    ref = s.agg(agg("_m").alias("_ref"))
    return back(back(cells, s, ["sample_id"]), ref, []).withColumn("value", F.col("value") - F.coalesce(F.col("_m") - F.col("_ref"), F.lit(0.0))).select(*cells.columns)


def quantile_normalize(cells: DataFrame) -> DataFrame:
    """Values replaced by the mean of their rank over samples; average ranks and linear interpolation between them.

    The target holds one row per rank. Features with a missing value don't shape the target; a sample
    with fewer values uses the target's lower part.
    """
    n_samples = cells.agg(F.count_distinct("sample_id").alias("_s"))
    per = back(cells.groupBy("feature_id").agg(F.count("value").alias("_n")), n_samples, []).filter("_n = _s").select("feature_id")
    w = Window.partitionBy("sample_id").orderBy("value", "feature_id")
    full = cells.join(per, "feature_id", "left_semi").withColumn("rk", F.row_number().over(w))
    target = full.groupBy("rk").agg(F.avg("value").alias("t"))
    here = cells.filter("value is not null")
    tie = Window.partitionBy("sample_id", "value")
    ranked = here.withColumn("pos", F.rank().over(Window.partitionBy("sample_id").orderBy("value")) + (F.count("*").over(tie) - 1) / 2)
    ranked = ranked.withColumn("lo", F.floor("pos")).withColumn("hi", F.ceil("pos"))
    j = ranked.join(target.select(F.col("rk").alias("lo"), F.col("t").alias("t_lo")), "lo").join(target.select(F.col("rk").alias("hi"), F.col("t").alias("t_hi")), "hi")
    j = j.withColumn("value", F.col("t_lo") + (F.col("pos") - F.col("lo")) * (F.col("t_hi") - F.col("t_lo"))).select(*cells.columns)
    return j.unionByName(cells.filter("value is null"))


def asinh_scale(cells: DataFrame) -> DataFrame:
    """asinh(value / median of the sample's positive values)."""
    s = cells.groupBy("sample_id").agg(F.coalesce(F.median(F.when(F.col("value") > 0, F.col("value"))), F.lit(1.0)).alias("_c"))
    return back(cells, s, ["sample_id"]).withColumn("value", F.asinh(F.col("value") / F.col("_c"))).select(*cells.columns)


def variance_stabilise(cells: DataFrame, max_iter: int = 50, tol: float = 1e-4) -> DataFrame:
    """asinh((value - a) / b) with per-sample offset and scale from alternating medians against the feature means.

    The parameters (two numbers a sample) are a stored table between rounds; the driver gets the largest step of a round alone.
    """
    cells = stored(cells, "vsn-cells")
    p = cells.groupBy("sample_id").agg(F.lit(0.0).alias("a"), F.coalesce(F.median(F.when(F.col("value") > 0, F.col("value"))), F.lit(1.0)).alias("b"))
    p = stored(p, "vsn-parameters")
    y = F.asinh(clip(F.col("value") - F.col("a"), -1e10, 1e10) / F.greatest(F.col("b"), F.lit(1e-10)))
    for _ in range(max_iter):
        now = back(cells, p, ["sample_id"])
        ref = now.groupBy("feature_id").agg(F.avg(y).alias("ref"))
        j = back(now, ref, ["feature_id"]).filter("value is not null").withColumn("sh", F.sinh(clip(F.col("ref"), -10.0, 10.0)))
        a = j.groupBy("sample_id").agg(F.median(F.col("value") - F.col("b") * F.col("sh")).alias("a2"), F.first("a").alias("a"), F.first("b").alias("b"))
        k = back(j.drop("a", "b"), a, ["sample_id"])
        ratio = F.abs(F.col("value") - F.col("a2")) / F.abs(F.col("sh"))
        b = stored(k.groupBy("sample_id").agg(F.first("a").alias("a"), F.first("a2").alias("a2"), F.first("b").alias("b"), F.greatest(F.coalesce(F.median(F.when(F.abs("sh") > 1e-10, ratio)), F.first("b")), F.lit(1e-10)).alias("b2")), "vsn-parameters")
        step = F.greatest(F.abs(F.col("a2") - F.col("a")), F.abs(F.col("b2") - F.col("b")) / F.greatest("b", F.lit(1e-10)))
        forget(p)
        p, largest = b.select("sample_id", F.col("a2").alias("a"), F.col("b2").alias("b")), b.agg(F.max(step)).first()[0]
        if largest is None or largest < tol:
            break
    return back(cells, p, ["sample_id"]).withColumn("value", y).select(*cells.columns)


def normalization_quality(before: DataFrame, after: DataFrame) -> DataFrame:
    """Spread of sample medians and mean standard deviation, before and after."""

    def one(cells: DataFrame, stage: str) -> DataFrame:
        m = cells.groupBy("sample_id").agg(F.median("value").alias("m"), F.stddev_pop("value").alias("s"))
        return m.agg(F.lit(stage).alias("stage"), F.try_divide(F.stddev_pop("m"), F.abs(F.avg("m"))).alias("cv_of_medians"), (F.max("m") - F.min("m")).alias("range_of_medians"), F.avg("s").alias("mean_std"))

    return one(before, "before").unionByName(one(after, "after"))


def cpm_keep(cells: DataFrame, strata: list[str] | None = None, min_cpm: float = 1.0, min_prevalence: float = 0.5, min_group: int = 10) -> DataFrame:
    """feature_id, n_pass: strata in which enough samples exceed min_cpm; library totals by partial sums."""
    strata = strata or []
    lib = cells.groupBy("sample_id").agg(F.sum("value").alias("_l"))
    c = back(cells, lib, ["sample_id"]).withColumn("cpm", F.col("value") / F.when(F.col("_l") == 0, 1.0).otherwise(F.col("_l")) * 1e6)
    sizes = cells.groupBy(*strata).agg(F.count_distinct("sample_id").alias("_n"))
    need = F.greatest(F.lit(1), F.floor(F.col("_n") * min_prevalence))
    g = back(c.groupBy("feature_id", *strata).agg(F.count_if(F.col("cpm") > min_cpm).alias("_k")), sizes, strata).filter(F.col("_n") >= min_group)
    return g.groupBy("feature_id").agg(F.count_if(F.col("_k") >= need).alias("n_pass"), F.count("*").alias("n_strata"))


def cpm_filter(cells: DataFrame, **how) -> DataFrame:
    return cells.join(cpm_keep(cells, **how).filter("n_pass > 0"), "feature_id", "left_semi")


def variance_top(cells: DataFrame, n: int) -> DataFrame:
    """The n features of largest population variance (top-k, no full sort)."""
    v = cells.groupBy("feature_id").agg(F.var_pop("value").alias("variance"))
    return v.orderBy(F.col("variance").desc(), "feature_id").limit(n)


def variance_percentile(cells: DataFrame, percentile: float) -> DataFrame:
    v = cells.groupBy("feature_id").agg(F.var_pop("value").alias("variance"))
    return back(v, v.agg(F.percentile("variance", 1 - percentile / 100).alias("_cut")), []).filter("variance >= _cut").drop("_cut")


def expressed_features(cells: DataFrame) -> DataFrame:
    """Features with mean at least the 20th percentile of means and variance at least the 10th of positive variances."""
    v = cells.groupBy("feature_id").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    cut = v.agg(F.percentile("m", 0.2).alias("_m"), F.percentile(F.when(F.col("v") > 0, F.col("v")), 0.1).alias("_v"))
    return back(v, cut, []).filter("m >= _m and v >= _v").select("feature_id", "m", "v")


def subject_values(cells: DataFrame, subjects: DataFrame, method: str = "mean") -> DataFrame:
    """One value per feature and subject (sample_id, subject_id)."""
    agg = F.avg if method == "mean" else F.median
    return cells.join(subjects, "sample_id").groupBy("feature_id", "subject_id").agg(agg("value").alias("value"))


def summarize_sets(cells: DataFrame, sets: DataFrame, method: str = "median") -> DataFrame:
    """set_id, sample_id, value: median, mean or logsum of members (built in), polish or pc1 (a task a set)."""
    j = cells.join(sets.select("set_id", "feature_id").distinct(), "feature_id")
    if method in ("median", "mean"):
        return j.groupBy("set_id", "sample_id").agg((F.median if method == "median" else F.avg)("value").alias("value"))
    if method == "logsum":
        m = j.groupBy("set_id", "sample_id").agg(F.max("value").alias("_m"))
        return back(j, m, ["set_id", "sample_id"]).groupBy("set_id", "sample_id").agg((F.first("_m") + F.log(F.sum(F.exp(F.col("value") - F.col("_m"))))).alias("value"))

    def block(rows: pa.Table) -> pa.Table:
        """A row a sample, with the numbers of its members and their values: the matrix is filled without objects a cell."""
        at, values = (rows[c].combine_chunks() for c in ("at", "values"))
        member = at.flatten().to_numpy()
        x = np.full((member.max() + 1, rows.num_rows), np.nan)
        x[member, np.repeat(np.arange(rows.num_rows), at.value_lengths().to_numpy())] = values.flatten().to_numpy()
        x = x[~np.isnan(x).all(axis=1)]
        v = median_polish(x)[0] if method == "polish" else first_component(x)
        return pa.table({"set_id": rows["set_id"].cast(pa.string()), "sample_id": rows["sample_id"], "value": pa.array(v, pa.float64(), from_pandas=True)})

    number = (F.row_number().over(Window.partitionBy("set_id").orderBy("feature_id")) - 1).alias("_at")
    members = sets.select("set_id", "feature_id").distinct().select("set_id", "feature_id", number)
    have = cells.filter("value is not null and not isnan(value)").join(members, "feature_id")
    packed = have.groupBy("set_id", "sample_id").agg(F.collect_list("_at").alias("at"), F.collect_list(F.col("value").cast("double")).alias("values"))
    return packed.groupBy("set_id").applyInArrow(block, "set_id string, sample_id string, value double")


def median_polish(x: np.ndarray, max_iter: int = 10, eps: float = 0.01):
    """Tukey's median polish: (sample abundances, overall, row effects, column effects, residuals)."""
    r = np.array(x, float)
    rows, cols, last = np.zeros(r.shape[0]), np.zeros(r.shape[1]), None
    with np.errstate(all="ignore"):
        for _ in range(max_iter):
            d = np.nan_to_num(np.nanmedian(r, axis=1))
            r, rows = r - d[:, None], rows + d
            d = np.nan_to_num(np.nanmedian(r, axis=0))
            r, cols = r - d[None, :], cols + d
            total = np.nansum(np.abs(r))
            if last is not None and (total == 0 or abs(last - total) < eps * total):
                break
            last = total
    overall = float(np.median(rows)) if len(rows) else 0.0
    abundance = np.where(np.isnan(x).all(axis=0), np.nan, overall + cols)
    return abundance, overall, rows - overall, cols, r


def first_component(x: np.ndarray) -> np.ndarray:
    """First principal component over samples, with the sign of the feature mean."""
    filled = np.where(np.isnan(x), np.nanmean(x, axis=1, keepdims=True), x)
    filled = np.nan_to_num(filled)
    centred = filled - filled.mean(axis=1, keepdims=True)
    u, s, v = np.linalg.svd(centred, full_matrices=False)
    score = s[0] * v[0] if len(s) else np.zeros(x.shape[1])
    mean = centred.mean(axis=0)
    return -score if score @ mean < 0 else score


def set_coherence(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """set_id, n_members, coherence: mean pairwise correlation of members over complete samples (three at least)."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.pivot_table(index="feature_id", columns="sample_id", values="value", aggfunc="first").to_numpy(float)
        x = x[:, ~np.isnan(x).any(axis=0)]
        value = None
        if x.shape[0] > 1 and x.shape[1] >= 3:
            with np.errstate(all="ignore"):
                value = float(np.nanmean(np.corrcoef(x)[np.triu_indices(len(x), 1)]))
        return pd.DataFrame({"set_id": [rows["set_id"].iloc[0]], "n_members": [x.shape[0]], "coherence": [value]})

    j = cells.join(sets.select("set_id", "feature_id").distinct(), "feature_id").select("set_id", "feature_id", "sample_id", "value")
    return j.groupBy("set_id").applyInPandas(block, "set_id string, n_members bigint, coherence double")


def normalize(cells: DataFrame, method: str = "median", **how) -> DataFrame:
    """The cells normalised by name: none, median, quantile, vsn (one pass), vsn_iterated, global_standards (with ``standards``)."""
    steps = {"none": lambda c: c, "median": median_normalize, "quantile": quantile_normalize, "vsn": asinh_scale, "vsn_iterated": variance_stabilise, "global_standards": standards_normalize}
    if method not in steps:
        raise ValueError(f"unknown normalisation {method}; known are {', '.join(sorted(steps))}")
    return steps[method](cells, **how)
