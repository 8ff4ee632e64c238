"""End-to-end flows: what the commands of a matrix study do, as DataFrame pipelines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import adaptive, compare, controls, correlate, impute, linear, modules, multiple, normalize, resample, robust, rotation
from quillon.operators.cohort import match_exactly
from quillon.operators.store import fingerprint, stored
from quillon.functions.scalar import normal_p_value, t_p_value
from quillon.schema import flag_summary
from quillon.sources import matrix


@dataclass(frozen=True)
class Clean:
    """Detect outliers, then impute: the flags of both steps stay on the cells."""

    detector: str = "mad-z"
    mode: str = "within_group"
    group: str | None = None
    threshold: float = 5.0
    strategy: str = "mad-clip"
    log1p: bool = False

    def run(self, cells: DataFrame) -> DataFrame:
        c = cells.withColumn("value", F.log1p("value")) if self.log1p else cells
        groups = [self.group] if self.group else []
        if self.detector == "multipass":
            c = robust.multipass_outliers(c, threshold=self.threshold, mode=self.mode, group_cols=groups).drop("pass1", "pass2", "pass3")
        elif self.detector == "adjusted-boxplot":
            c = adaptive.adjusted_boxplot(c, ["feature_id", *groups])
        elif self.detector == "kde":
            c = adaptive.kde_outliers(c, self.group).drop("threshold")
        elif self.detector == "student-t":
            c = adaptive.student_t_outliers(c, self.threshold).drop("outlier_p")
        else:
            c = robust.detect_outliers(c, method=self.detector, mode=self.mode, group_cols=groups, threshold=self.threshold)
        step = {"mad-clip": impute.mad_clip, "soft-clip": impute.soft_clip_cells, "median": impute.median_impute}[self.strategy]
        return step(c, group_cols=groups)

    def report(self, cleaned: DataFrame) -> DataFrame:
        return flag_summary(cleaned, *([self.group] if self.group else []))


def analyze(cells: DataFrame, sets: DataFrame, condition: str, case: str, control: str, min_correlation: float = 0.7, method: str = "pearson") -> dict[str, DataFrame]:
    """Regulator coherence: pair table once, each set's module per condition, rewiring, changed pairs, gained and lost edges."""
    pairs = correlate.correlations(cells, method, [condition])
    m = modules.set_modules(pairs, sets, condition, min_correlation)
    return {
        "modules": m,
        "rewiring": modules.rewiring(m, condition, case, control),
        "pair_changes": correlate.differential_pairs(pairs, case, control, method, condition),
        "edge_changes": correlate.gained_lost(pairs, case, control, min_correlation, condition),
    }


def differential_sets(cells: DataFrame, sets: DataFrame, condition: str, contrast: tuple[str, str], summary: str = "polish", subject: str | None = None) -> DataFrame:
    """Sets summarised per sample, fitted, contrasted and corrected: set_id, estimate, t, p, q."""
    s = normalize.summarize_sets(cells, sets, summary).withColumnRenamed("set_id", "feature_id")
    meta = cells.select("sample_id", condition, *([subject] if subject else [])).distinct()
    s = s.join(meta, "sample_id")
    if subject:
        fitted = linear.mixed_contrasts(s, contrast, condition, subject).select("feature_id", "estimate", "t", "p")
    else:
        fitted = linear.moderated(linear.ols_contrasts(s, [contrast], condition)).select("feature_id", "estimate", F.col("t_mod").alias("t"), "p")
    return multiple.bh(fitted, "p", "q").withColumnRenamed("feature_id", "set_id")


def differential_features(cells: DataFrame, condition: str, contrast: tuple[str, str]) -> DataFrame:
    """feature_id, estimate, t (moderated), p, q of single features."""
    fitted = linear.moderated(linear.ols_contrasts(cells, [contrast], condition)).select("feature_id", "estimate", F.col("t_mod").alias("t"), "p")
    return multiple.bh(fitted, "p", "q")


def compare_levels(set_results: DataFrame, feature_results: DataFrame, sets: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Per set: members, significant members, whether the set is significant, and what only one level detects.

    coordinated: the set is significant and none of its members; individual: members are and the set isn't.
    A set or member without a q value isn't significant; the mean estimate is over members with results."""
    m = sets.select("set_id", "feature_id").distinct().join(feature_results.select("feature_id", F.col("estimate").alias("_e"), F.col("q").alias("_q")), "feature_id", "left")
    g = m.groupBy("set_id").agg(F.count("*").alias("n_features"), F.count_if(F.col("_q") < threshold).alias("n_significant"), F.avg("_e").alias("mean_estimate"))
    hit = F.coalesce(F.col("q") < threshold, F.lit(False))
    j = set_results.select("set_id", "estimate", "q").join(g, "set_id").withColumn("set_significant", hit)
    return j.withColumn("coordinated", F.col("set_significant") & (F.col("n_significant") == 0)).withColumn("individual", ~F.col("set_significant") & (F.col("n_significant") > 0))


def compare_methods(cells: DataFrame, sets: DataFrame, condition: str, contrast: tuple[str, str], n_rotations: int = 499) -> DataFrame:
    """Long results (set_id, method, effect_size, p_value) of OLS on summaries, rotation (two statistics) and competitive permutation."""
    ols = differential_sets(cells, sets, condition, contrast).select("set_id", F.col("estimate").alias("effect_size"), F.col("p").alias("p_value"))
    rot = stored(rotation.test_two_groups(cells, sets, condition, contrast, n_rotations), "rotation")
    pick = lambda s: rot.filter((F.col("statistic") == s) & (F.col("alternative") == "mixed")).select("set_id", F.col("observed").alias("effect_size"), F.col("p").alias("p_value"))
    t = linear.ols_contrasts(cells, [contrast], condition).select("feature_id", "t")
    perm = resample.competitive_test(t, sets, n=n_rotations).select("set_id", F.col("z").alias("effect_size"), F.col("p").alias("p_value"))
    return compare.unified({"ols": ols, "rotation_msq": pick("msq"), "rotation_mean": pick("mean"), "permutation": perm})


def _draws(samples: DataFrame, condition: str, contrast: tuple[str, str], stratum: str, n: int, seed: int) -> DataFrame:
    """stratum, iteration, sample_id, side (1: the first of the contrast), times: the samples as they are (iteration 0) and n bootstraps of each stratum and condition."""
    s = samples.filter(F.col(condition).isin(*contrast) & F.col(stratum).isNotNull() & (F.lower(F.col(stratum).cast("string")) != "unknown")).select("sample_id", stratum, condition).distinct()
    drawn = resample.bootstrap_weights(s, n, [stratum, condition], seed).withColumn("iteration", F.col("iteration") + 1)
    every = drawn.select("iteration", "sample_id", "times").unionByName(s.select(F.lit(0).alias("iteration"), "sample_id", F.lit(1).cast("long").alias("times")))
    return every.join(s, "sample_id").select(F.col(stratum).alias("stratum"), "iteration", "sample_id", (F.col(condition) == contrast[0]).cast("int").alias("side"), "times")


def _weighted_t(values: DataFrame, draws: DataFrame, unit: str) -> DataFrame:
    """stratum, iteration, unit, estimate, t, df from six weighted sums each."""
    j = values.filter("value is not null").join(draws, "sample_id")
    a, b, v = F.col("times") * F.col("side"), F.col("times") * (1 - F.col("side")), F.col("value")
    g = j.groupBy("stratum", "iteration", unit).agg(*(F.sum(x).alias(k) for k, x in (("na", a), ("nb", b), ("sa", a * v), ("sb", b * v), ("qa", a * v * v), ("qb", b * v * v)))).filter("na >= 2 and nb >= 2")
    df = F.col("na") + F.col("nb") - 2
    ss = F.col("qa") - F.col("sa") * F.col("sa") / F.col("na") + F.col("qb") - F.col("sb") * F.col("sb") / F.col("nb")
    gap = F.col("sa") / F.col("na") - F.col("sb") / F.col("nb")
    t = F.try_divide(gap, F.sqrt(F.greatest(ss, F.lit(0.0)) / df * (1 / F.col("na") + 1 / F.col("nb"))))
    return g.select("stratum", "iteration", unit, gap.alias("estimate"), t.alias("t"), df.cast("double").alias("df"))


def stratified_comparison(cells: DataFrame, samples: DataFrame, sets: DataFrame, condition: str, contrast: tuple[str, str], stratum: str, n: int = 100, threshold: float = 0.05, seed: int = 0) -> dict[str, DataFrame]:
    """Methods compared within strata, over bootstraps of the samples: strata x resamples x methods are one relation.

    Methods from weighted sufficient statistics: summary (t of the set's mean value), competitive (mean |t| of members
    against all other features), directional (mean t of members). results: (stratum, iteration, set_id, method,
    effect_size, p_value), iteration 0 being the data as they are. concordance: each two methods' agreement in the data
    with 95 % intervals over the resamples. sets: share of resamples in which a method calls a set, and of the majority
    direction. Strata that are null or 'unknown', or have fewer than two samples a side, give nothing."""
    draws = stored(_draws(samples, condition, contrast, stratum, n, seed), "comparison-draws")
    members = sets.select("set_id", "feature_id").distinct()
    summary = _weighted_t(cells.join(members, "feature_id").groupBy("set_id", "sample_id").agg(F.avg("value").alias("value")), draws, "set_id")
    key = ["stratum", "iteration"]
    summary = summary.select(*key, "set_id", F.lit("summary").alias("method"), F.col("estimate").alias("effect_size"), t_p_value("t", "df").alias("p_value"))
    t = stored(_weighted_t(cells, draws, "feature_id").filter("t is not null").select(*key, "feature_id", "t"), "comparison-t")
    x = F.abs("t")
    every = t.groupBy(*key).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    own = t.join(members, "feature_id").groupBy(*key, "set_id").agg(F.count("*").alias("k"), F.sum(x).alias("os"), F.sum(x * x).alias("oq"), F.avg("t").alias("mt"))
    j = own.join(every, key)
    rest = F.col("n") - F.col("k")
    mean = F.try_divide(F.col("s") - F.col("os"), rest)
    var = F.try_divide(F.col("q") - F.col("oq") - rest * mean * mean, rest - 1)
    j = j.select(*key, "set_id", F.try_divide(F.col("os") / F.col("k") - mean, F.sqrt(F.greatest(var, F.lit(0.0)) / F.col("k"))).alias("competitive"), (F.col("mt") * F.sqrt("k")).alias("directional"))
    z = j.unpivot([*key, "set_id"], ["competitive", "directional"], "method", "effect_size").filter("effect_size is not null")
    results = stored(summary.unionByName(z.withColumn("p_value", normal_p_value("effect_size"))), "comparison-results")
    each = stored(compare.concordance(results, threshold, keys=key), "comparison-concordance")
    pair = ["stratum", "method_a", "method_b"]
    measures = ["spearman", "effect_r", "sign_agreement", "kappa", "jaccard"]
    bounds = [F.percentile(m, q).alias(f"{m}_{side}") for m in measures for side, q in (("low", 0.025), ("high", 0.975))]
    spread = each.filter("iteration > 0").groupBy(*pair).agg(F.count("*").alias("n_resamples"), *bounds)
    hit, up = F.avg((F.col("p_value") < threshold).cast("double")), F.avg((F.col("effect_size") > 0).cast("double"))
    called = results.filter("iteration > 0").groupBy("stratum", "set_id", "method").agg(hit.alias("frequency"), F.greatest(up, 1 - up).alias("direction_share"), F.percentile("effect_size", 0.025).alias("effect_low"), F.percentile("effect_size", 0.975).alias("effect_high"))
    return {"results": results, "concordance": each.filter("iteration = 0").drop("iteration").join(spread, pair, "left"), "sets": called}


def _one(df: DataFrame) -> dict:
    """The only row of a summary."""
    row = df.first()
    if row is None:
        raise ValueError("nothing is left to test")
    return row.asDict()


@dataclass
class Validation:
    """Phases of a validation of one target set, each stored in ``folder`` (if given) once finished, and their verdict.

    A phase that is stored already, for the same study (settings, and what cells, samples and targets hold), isn't run again; one that fails is stored as failed with its
    message, counts as missing in the verdict, and is tried again by the next run."""

    folder: str | None = None
    phases: dict = field(default_factory=dict)

    def _phase(self, name: str, study: dict, work: Callable[[], dict]) -> None:
        path = f"{self.folder.rstrip('/')}/{name}.json" if self.folder else None
        before = matrix.read_json(path) if path else None
        if before and before.get("study") == study and before["result"].get("status") != "failed":
            self.phases[name] = before["result"]
            return
        try:
            self.phases[name] = work()
        except (ValueError, AnalysisException, PythonException) as e:
            self.phases[name] = {"status": "failed", "message": str(e).splitlines()[0]}
        if path:
            matrix.write_json(path, {"study": study, "result": self.phases[name]})

    def run(
        self, cells: DataFrame, samples: DataFrame, condition: str, contrast: tuple[str, str], targets: DataFrame, covariates: list[str] | None = None,
        strata: list[str] | None = None, others: list[tuple[str, str]] | None = None, n: int = 200, seed: int = 0,
    ) -> dict:
        """covariate_adjusted: competitive z and empirical p of t values adjusted for the covariates. specificity (with
        ``others``): the same z in further contrasts. label_permutation: labels shuffled within strata and freely. matched
        (with covariates): samples matched exactly on them. negative_controls: rank among sets matched on mean and
        variance. bootstrap: stability of z."""
        covariates, others = covariates or [], others or []
        cells = cells.drop(condition)
        ids = targets.select("feature_id").distinct()
        study = {"condition": condition, "contrast": list(contrast), "covariates": covariates, "strata": strata, "others": [list(o) for o in others], "n": n, "seed": seed, "targets": fingerprint(ids), "cells": fingerprint(cells.select("feature_id", "sample_id", "value")), "samples": fingerprint(samples)}

        def enriched(t: DataFrame) -> dict:
            marked = t.select("feature_id", "t").filter("t is not null").join(ids.withColumn("_i", F.lit(True)), "feature_id", "left").withColumn("is_target", F.coalesce("_i", F.lit(False)))
            return {"z": _one(linear.competitive_z(marked))["z"], "empirical_pvalue": _one(resample.negative_controls(marked.select("feature_id", "t"), ids, n, seed))["p"]}

        def of(chosen: DataFrame, pair: tuple[str, str]) -> DataFrame:
            return linear.ols_contrasts(cells.join(chosen.select("sample_id", condition), "sample_id"), [pair], condition)

        def adjusted() -> dict:
            rows = samples.select("sample_id", condition, *covariates).distinct().toPandas()  # the design, a row a sample
            return enriched(linear.design_contrasts(cells, linear.covariate_design(rows, condition, contrast, covariates)))

        def specific() -> dict:
            found = [(f"{a} - {b}", *enriched(of(samples, (a, b))).values()) for a, b in (contrast, *others)]
            table = cells.sparkSession.createDataFrame(found, "contrast string, z double, p double")
            return _one(compare.specificity(table, f"{contrast[0]} - {contrast[1]}"))

        def permuted() -> dict:
            null = lambda by: _one(resample.label_permutation_null(cells, samples, condition, *contrast, ids, n, by, seed).withColumnRenamed("p", "permutation_pvalue"))
            return {"stratified": null(strata), "free": null(None)} if strata else {"free": null(None)} | null(None)

        def controls_rank() -> dict:
            row = _one(controls.matched_controls(cells, of(samples, contrast).select("feature_id", "t"), ids, n, seed))
            above = row["p"] * (row["n_controls"] + 1) - 1
            return row | {"target_percentile": 100.0 * above / row["n_controls"]}

        self._phase("covariate_adjusted", study, adjusted)
        if others:
            self._phase("specificity", study, specific)
        self._phase("label_permutation", study, permuted)
        if covariates:
            self._phase("matched", study, lambda: enriched(of(match_exactly(samples, condition, covariates, seed), contrast)))
        self._phase("negative_controls", study, controls_rank)
        self._phase("bootstrap", study, lambda: _one(resample.bootstrap_stability(cells, samples.select("sample_id", condition), condition, *contrast, ids, n, seed=seed)))
        result = compare.verdict(self.phases)
        if self.folder:
            matrix.write_json(f"{self.folder}/report.json", {"study": study, "phases": self.phases, **result})
        return result
