"""Resampling keyed by hashes of (seed, iteration, id): permutations, bootstraps and random sets do not
depend on partitioning. All iterations are one job with an iteration column, not a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.robust import back


def iterations(df: DataFrame, n: int, name: str = "iteration") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def permuted_labels(samples: DataFrame, label: str, n: int, strata: list[str] | None = None, seed: int = 0) -> DataFrame:
    """iteration, sample_id, label: labels shuffled (within strata if given)."""
    strata = strata or []
    it = iterations(samples.select("sample_id", label, *strata), n)
    key = ["iteration", *strata]
    pos = it.withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy("sample_id")))
    draw = it.withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed), "iteration", "sample_id"), "sample_id"))).select(*key, "_p", F.col(label).alias("_new"))
    return back(pos, draw, [*key, "_p"]).select("iteration", "sample_id", F.col("_new").alias(label))


def bootstrap_weights(samples: DataFrame, n: int, groups: list[str] | None = None, seed: int = 0) -> DataFrame:
    """iteration, sample_id, times: draws with replacement within groups, as multiplicities."""
    groups = groups or []
    size = back(samples.select("sample_id", *groups), samples.groupBy(*groups).agg(F.count("*").alias("_n")), groups)
    numbered = size.withColumn("_p", F.row_number().over(Window.partitionBy(*groups, *([] if groups else [F.lit(0)])).orderBy("sample_id")))
    draws = iterations(numbered, n).withColumn("_d", F.pmod(F.xxhash64(F.lit(seed), "iteration", "sample_id"), F.col("_n")) + 1)
    times = draws.groupBy("iteration", *groups, F.col("_d").alias("_p")).agg(F.count("*").alias("times"))
    return back(times, numbered.select("sample_id", *groups, "_p"), [*groups, "_p"]).select("iteration", "sample_id", "times")


def random_sets(pool: DataFrame, sizes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """iteration, size, feature_id: for each distinct size so many features without replacement; top-k by hash."""
    s = sizes.select("size").distinct()
    it = iterations(pool.select("feature_id").distinct(), n).crossJoin(F.broadcast(s))
    w = Window.partitionBy("iteration", "size").orderBy(F.xxhash64(F.lit(seed), "iteration", "size", "feature_id"), "feature_id")
    return it.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= F.col("size")).select("iteration", "size", "feature_id")


def empirical_p(observed: DataFrame, null: DataFrame, keys: list[str], stat: str = "t", min_null: int = 10) -> DataFrame:
    """keys, stat, n_null, p_two_sided, p_directional, percentile: (b + 1) / (B + 1) with ties counted; fewer than ``min_null`` draws give no row."""
    o = observed.select(*keys, F.col(stat).alias("_o"))
    j = null.select(*keys, F.col(stat).alias("_z")).join(o, keys)
    beyond = F.count_if(F.abs("_z") >= F.abs("_o"))
    side = F.count_if(F.when(F.col("_o") > 0, F.col("_z") >= F.col("_o")).otherwise(F.col("_z") <= F.col("_o")))
    g = j.groupBy(*keys).agg(F.first("_o").alias(stat), F.count("*").alias("n_null"), ((beyond + 1) / (F.count("*") + 1)).alias("p_two_sided"), ((side + 1) / (F.count("*") + 1)).alias("p_directional"), (100.0 * F.count_if(F.abs("_z") < F.abs("_o")) / F.count("*")).alias("percentile"))
    return g.filter(F.col("n_null") >= min_null)


def competitive_test(stats: DataFrame, sets: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """Observed mean |t| of each set against random sets of its size from the pool of all features."""
    x = stats.select("feature_id", F.abs("t").alias("x"))
    m = sets.select("set_id", "feature_id").distinct().join(x, "feature_id")
    obs = m.groupBy("set_id").agg(F.avg("x").alias("t"), F.count("*").alias("size"))
    null = random_sets(x, obs, n, seed).join(x, "feature_id").groupBy("iteration", "size").agg(F.avg("x").alias("t"))
    g = obs.withColumnRenamed("t", "_o").join(null.withColumnRenamed("t", "_z"), "size").groupBy("set_id", "size")
    return g.agg(F.first("_o").alias("mean_abs_t"), F.avg("_z").alias("null_mean"), F.stddev_samp("_z").alias("null_sd"), ((F.count_if(F.col("_z") >= F.col("_o")) + 1) / (F.count("*") + 1)).alias("p")).withColumn("z", F.try_divide(F.col("mean_abs_t") - F.col("null_mean"), F.col("null_sd")))


def group_t(cells: DataFrame, labels: DataFrame, a: str, b: str, label: str = "label", weight: str | None = None) -> DataFrame:
    """iteration, feature_id, t: pooled two-sample t under every iteration's labels, by conditional sums in one aggregate."""
    j = cells.filter("value is not null").join(labels, "sample_id")
    w = F.col(weight) if weight else F.lit(1.0)
    ia, ib = F.when(F.col(label) == a, w).otherwise(0.0), F.when(F.col(label) == b, w).otherwise(0.0)
    v = F.col("value")
    g = j.groupBy("iteration", "feature_id").agg(*(F.sum(x).alias(n) for n, x in (("na", ia), ("nb", ib), ("sa", ia * v), ("sb", ib * v), ("qa", ia * v * v), ("qb", ib * v * v))))
    ss = (F.col("qa") - F.col("sa") ** 2 / F.col("na")) + (F.col("qb") - F.col("sb") ** 2 / F.col("nb"))
    s2 = ss / (F.col("na") + F.col("nb") - 2)
    return g.filter("na >= 2 and nb >= 2").select("iteration", "feature_id", F.try_divide(F.col("sa") / F.col("na") - F.col("sb") / F.col("nb"), F.sqrt(F.greatest(s2, F.lit(0.0)) * (1 / F.col("na") + 1 / F.col("nb")))).alias("t"))


def iteration_z(t: DataFrame, targets: DataFrame) -> DataFrame:
    """iteration, z: the competitive z of the targets in each iteration."""
    j = t.join(targets.select("feature_id").distinct().withColumn("_t", F.lit(True)), "feature_id", "left").filter("t is not null")
    x, y = F.when(F.col("_t"), F.abs("t")), F.when(F.col("_t").isNull(), F.abs("t"))
    g = j.groupBy("iteration").agg(F.avg(x).alias("m"), F.count(x).alias("k"), F.avg(y).alias("b"), F.stddev_samp(y).alias("s"))
    return g.select("iteration", F.coalesce(F.try_divide(F.col("m") - F.col("b"), F.col("s") / F.sqrt("k")), F.lit(0.0)).alias("z"))


def label_permutation_null(cells: DataFrame, samples: DataFrame, label: str, a: str, b: str, targets: DataFrame, n: int = 1000, strata: list[str] | None = None, seed: int = 0) -> DataFrame:
    """One row: observed z, mean and sd of the null, p = (#>= + 1) / (n + 1)."""
    s = samples.filter(F.col(label).isin(a, b))
    real = iteration_z(group_t(cells, s.select("sample_id", F.col(label).alias("label"), F.lit(0).alias("iteration")), a, b), targets).select(F.col("z").alias("observed_z"))
    null = iteration_z(group_t(cells, permuted_labels(s, label, n, strata, seed).withColumnRenamed(label, "label"), a, b), targets)
    g = back(null, real, []).groupBy("observed_z").agg(F.avg("z").alias("null_mean"), F.stddev_samp("z").alias("null_sd"), F.count("*").alias("n_permutations"), ((F.count_if(F.col("z") >= F.col("observed_z")) + 1) / (F.count("*") + 1)).alias("p"))
    return g


def bootstrap_stability(cells: DataFrame, samples: DataFrame, label: str, a: str, b: str, targets: DataFrame, n: int = 200, z_threshold: float = 1.5, seed: int = 0) -> DataFrame:
    """One row: mean z, share of resamples at or above the threshold, 95 % interval."""
    s = samples.filter(F.col(label).isin(a, b))
    w = bootstrap_weights(s, n, [label], seed).join(s.select("sample_id", F.col(label).alias("label")), "sample_id")
    z = iteration_z(group_t(cells, w, a, b, weight="times"), targets)
    return z.agg(F.avg("z").alias("mean_z"), F.avg((F.col("z") >= z_threshold).cast("double")).alias("stability"), F.percentile("z", 0.025).alias("ci_low"), F.percentile("z", 0.975).alias("ci_high"), F.count("*").alias("n_bootstraps"))


def negative_controls(stats: DataFrame, targets: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """One row: the targets' mean |t| against random sets of their size from all features, targets included; percentile and share above."""
    t = targets.select(F.lit("target").alias("set_id"), "feature_id")
    r = competitive_test(stats, t, n, seed)
    return r.select(F.col("size").alias("n_targets"), "mean_abs_t", "null_mean", "null_sd", "z", "p")
