"""Comparing methods on sets: concordance, disagreement, wide form, specificity, verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.robust import back


def valid(results: DataFrame) -> DataFrame:
    return results.filter("p_value is not null and not isnan(p_value) and p_value between 0 and 1")


def _rank(col: str, keys: list[str]) -> Column:
    return F.rank().over(Window.partitionBy(*keys).orderBy(col)) + (F.count("*").over(Window.partitionBy(*keys, col)) - 1) / 2


def _corr(x: str, y: str) -> Column:
    """Pearson from sums; null where one is constant."""
    cov = F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y)
    return F.try_divide(cov, F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def concordance(results: DataFrame, threshold: float = 0.05, min_sets: int = 3, keys: list[str] | None = None) -> DataFrame:
    """A row per pair of methods (a < b) of long results (set_id, method, effect_size, p_value), within ``keys`` if given."""
    r, outer = valid(results), keys or []
    one = lambda s: r.select(*outer, "set_id", F.col("method").alias(f"method_{s}"), F.col("p_value").alias(f"p_{s}"), F.col("effect_size").alias(f"e_{s}"))
    j = one("a").join(one("b"), [*outer, "set_id"]).filter("method_a < method_b")
    keys = [*outer, "method_a", "method_b"]
    j = j.withColumn("rk_a", _rank("p_a", keys)).withColumn("rk_b", _rank("p_b", keys))
    sa, sb = F.col("p_a") < threshold, F.col("p_b") < threshold
    g = j.groupBy(*keys).agg(
        F.count("*").alias("n"), _corr("rk_a", "rk_b").alias("spearman"), F.count_if(sa & sb).alias("n_both"), F.count_if(sa & ~sb).alias("n_a_only"),
        F.count_if(~sa & sb).alias("n_b_only"), F.count_if(~sa & ~sb).alias("n_neither"), _corr("e_a", "e_b").alias("effect_r"),
        F.sqrt(F.avg((F.col("e_a") - F.col("e_b")) ** 2)).alias("effect_rmse"), F.avg((F.signum("e_a") == F.signum("e_b")).cast("double")).alias("sign_agreement"),
    ).filter(F.col("n") >= min_sets)
    pa, pb = (F.col("n_both") + F.col("n_a_only")) / F.col("n"), (F.col("n_both") + F.col("n_b_only")) / F.col("n")
    po, pe = (F.col("n_both") + F.col("n_neither")) / F.col("n"), pa * pb + (1 - pa) * (1 - pb)
    kappa = F.when(pe < 1, F.try_divide(po - pe, 1 - pe)).otherwise(F.when(po == 1, 1.0).otherwise(0.0))
    return g.withColumn("kappa", kappa).withColumn("jaccard", F.try_divide(F.col("n_both"), F.col("n_both") + F.col("n_a_only") + F.col("n_b_only")))


def concordance_matrix(conc: DataFrame, methods: list[str], value: str = "spearman") -> DataFrame:
    """Symmetric wide form with a diagonal of 1."""
    both = conc.select(F.col("method_a").alias("method"), F.col("method_b").alias("other"), value).union(conc.select("method_b", "method_a", value))
    diag = conc.sparkSession.createDataFrame([(m, m, 1.0) for m in methods], f"method string, other string, {value} double")
    return both.unionByName(diag).groupBy("method").pivot("other", methods).agg(F.first(value))


def wide(results: DataFrame, methods: list[str]) -> DataFrame:
    """set_id and p_value, effect_size per method."""
    cols = [F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{c}_{m}") for m in methods for c in ("p_value", "effect_size")]
    return results.groupBy("set_id").agg(*cols)


def disagreements(results: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Sets that some methods call and others don't, widest range of p first."""
    g = valid(results).groupBy("set_id").agg(F.count_if(F.col("p_value") < threshold).alias("n_significant"), F.count("*").alias("n_methods"), (F.max("p_value") - F.min("p_value")).alias("p_range"))
    return g.filter("n_significant > 0 and n_significant < n_methods").orderBy(F.col("p_range").desc(), "set_id")


def robust_hits(results: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Sets significant by every method that any set was tested with."""
    r = valid(results)
    m = r.agg(F.count_distinct("method").alias("_m"))
    return back(r.filter(F.col("p_value") < threshold).groupBy("set_id").agg(F.count_distinct("method").alias("_n")), m, []).filter("_n = _m").select("set_id")


def specific_hits(results: DataFrame, method: str, threshold: float = 0.05) -> DataFrame:
    """Sets significant by this method only."""
    own = F.bool_or((F.col("method") == method) & (F.col("p_value") < threshold))
    other = F.bool_or((F.col("method") != method) & (F.col("p_value") < threshold))
    return valid(results).groupBy("set_id").agg(own.alias("own"), other.alias("other")).filter("own and not other").select("set_id")


def specificity(enrichment: DataFrame, primary: str, z_threshold: float = 1.5, p_threshold: float = 0.05) -> DataFrame:
    """One row (label, ratio) of (contrast, z, p): specific, shared or inconclusive by the binary comparison."""
    ok = (F.col("z") >= z_threshold) & (F.col("p") < p_threshold)
    mine = F.col("contrast") == primary
    g = enrichment.agg(F.bool_or(mine & ok).alias("own"), F.coalesce(F.bool_or(~mine & ok), F.lit(False)).alias("other"), F.max(F.when(mine, F.col("z"))).alias("z"), F.max(F.when(~mine, F.abs("z"))).alias("other_z"))
    return g.select(F.lit(primary).alias("primary"), F.when(~F.col("own"), "inconclusive").when(F.col("other"), "shared").otherwise("specific").alias("label"), "z", F.try_divide("z", "other_z").alias("ratio"))


def verdict(phases: dict, alpha: float = 0.05, control_percentile: float = 10.0) -> dict:
    """Gates: the covariate-adjusted and the permutation phase must both pass; both failing refutes; anything else is inconclusive."""

    def phase(name: str) -> dict | None:
        p = phases.get(name)
        return None if not p or p.get("status") == "failed" else p

    adjusted, permuted = phase("covariate_adjusted"), phase("label_permutation")
    gate1 = bool(adjusted) and adjusted.get("empirical_pvalue", 1.0) < alpha
    gate3 = bool(permuted) and permuted.get("stratified", permuted).get("permutation_pvalue", 1.0) < alpha
    spec, matched, control = phase("specificity"), phase("matched"), phase("negative_controls")
    support = [x for x in (matched and matched.get("empirical_pvalue", 1.0) < alpha, control and control.get("target_percentile", 100.0) < control_percentile) if x is not None]
    missing = [n for n, p in (("covariate_adjusted", adjusted), ("label_permutation", permuted)) if p is None]
    if gate1 and gate3:
        result = "validated" if all(support) or not support or sum(support) * 2 >= len(support) else "inconclusive"
    elif not gate1 and not gate3 and not missing:
        result = "refuted"
    else:
        result = "inconclusive"
    return {"verdict": result, "gates": {"covariate_adjusted": gate1, "label_permutation": gate3}, "supporting": f"{sum(support)}/{len(support)}", "specificity": (spec or {}).get("label", "not_tested"), "missing": missing}


def unified(results: dict[str, DataFrame]) -> DataFrame:
    """Long results with a method column; a method that failed contributes nothing."""
    return reduce(DataFrame.unionByName, (d.withColumn("method", F.lit(m)).select("set_id", "method", "effect_size", "p_value") for m, d in results.items()))
