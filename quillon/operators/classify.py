"""Classifiers whose scores come from models that never saw the sample, and markers found from a reference feature.

Cross-fitting: every sample, labelled or not, has a fold; the model of a fold learns from the other folds alone (its
choice of features too) and scores its own. Self-training adds confident samples as labels of the next round, again
only for the models of other folds; how confident they must be is read off the labelled samples' own scores.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.markers import Ensemble, classify_samples
from quillon.operators.robust import back
from quillon.operators.store import stored

SCORES = ("sample_id", "fold", "label", "probability", "predicted", "confidence")


def with_folds(samples: DataFrame, label: str = "label", folds: int = 5, seed: int = 0) -> DataFrame:
    """``samples`` with ``fold``: within each label (and among the unlabelled) dealt evenly in the order of a hash.

    Ranks are those of a sample's hash among the quantiles' ranges, so no window holds all samples of a label."""
    h = F.pmod(F.xxhash64(F.lit(seed), "sample_id"), F.lit(1 << 20))
    keyed = samples.withColumn("_h", h)
    few = keyed.groupBy(label, "_h").agg(F.count("*").alias("_n"), F.min("sample_id").alias("_first"))
    block = few.groupBy(label, F.floor(F.col("_h") / (1 << 12)).alias("_b")).agg(F.sum("_n").alias("_t"))
    from pyspark.sql import Window

    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    block = block.withColumn("_s", F.coalesce(F.sum("_t").over(before), F.lit(0)))  # at most 256 rows a label
    keyed = back(keyed.withColumn("_b", F.floor(F.col("_h") / (1 << 12))), block.select(label, "_b", "_s"), [label, "_b"])
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", "sample_id")) + F.col("_s") - 1
    return keyed.withColumn("fold", F.pmod(rank, F.lit(folds)).cast("int")).drop("_h", "_b", "_s")


def cross_fit(cells: DataFrame, samples: DataFrame, taught: DataFrame, folds: int = 5, **ensemble) -> DataFrame:
    """SCORES of all ``samples`` (sample_id, fold, label or null), each by the model of its fold.

    ``taught`` (sample_id, label) is what models may learn from; that of a fold leaves out the fold's own samples."""
    parts = []
    for k in range(folds):
        own = samples.filter(F.col("fold") == k)
        learn = taught.join(own, "sample_id", "left_anti").select("sample_id", "label")
        classes = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
        if set(classes) != {0, 1}:
            raise ValueError(f"the folds other than {k} don't have both labels: {classes}")
        model = Ensemble(**ensemble).fit(cells, learn)
        parts.append(own.select("sample_id", "fold", "label").join(model.predict(cells.join(own, "sample_id", "left_semi")), "sample_id", "left"))
    return reduce(DataFrame.unionByName, parts).select(*SCORES)


def accuracy(scores: DataFrame) -> dict:
    """n, accuracy, balanced and auc of the labelled samples' own scores; auc from the counts of equal scores."""
    known = scores.filter("label is not null and probability is not null")
    hit = F.col("predicted") == F.col("label")
    share = lambda c: F.try_divide(F.count_if(hit & c), F.count_if(c))
    row = known.agg(F.count("*").alias("n"), share(F.lit(True)).alias("accuracy"), ((share(F.col("label") == 1) + share(F.col("label") == 0)) / 2).alias("balanced")).first().asDict()
    return row | {"auc": area_under_curve(known)}


def area_under_curve(known: DataFrame) -> float | None:
    """Share of (1, 0) pairs in the right order, ties as halves: running counts within ranges of the score."""
    from quillon.operators.multiple import _before, ranged

    g = known.groupBy("probability").agg(F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") == 0).alias("zeros"))
    run = _before(ranged(stored(g, "auc"), "probability"), [], "probability", ["zeros"])
    row = run.agg(F.sum(F.col("ones") * (F.col("_runzeros") - F.col("zeros") / 2)).alias("u"), F.sum("ones").alias("a"), F.sum("zeros").alias("b")).first()
    return row["u"] / (row["a"] * row["b"]) if row["a"] and row["b"] else None


def confident_from(scores: DataFrame, least: float) -> float | None:
    """The smallest confidence (in steps of 0.05) from which on labelled samples' own scores are right in at least ``least`` of cases."""
    known = scores.filter("label is not null and probability is not null")
    cuts = [i / 20 for i in range(20)]
    above = lambda c: F.col("confidence") >= c
    row = known.agg(*(F.try_divide(F.count_if(above(c) & (F.col("predicted") == F.col("label"))), F.count_if(above(c))).alias(f"c{i}") for i, c in enumerate(cuts))).first()
    return next((c for i, c in enumerate(cuts) if row[i] is not None and row[i] >= least), None)


def self_train(cells: DataFrame, samples: DataFrame, label: str, classes: tuple[str, str], least: float = 0.95, rounds: int = 5, folds: int = 5, seed: int = 0, **ensemble) -> tuple[DataFrame, list[dict]]:
    """(SCORES with source, reports a round) of ``samples`` (sample_id, ``label``); labels other than ``classes`` are unknown.

    A round scores everyone by cross-fitting. Unlabelled samples at least as confident as `confident_from` asks teach
    the next round. It ends when these are the same as before, or none, or the labelled samples' own accuracy falls: then
    the round before counts. source: known, pseudo (taught the last round's other folds) or unknown."""
    s = samples.select("sample_id", F.when(F.col(label) == classes[1], 1).when(F.col(label) == classes[0], 0).alias("label"))
    s = stored(with_folds(s.distinct(), "label", folds, seed), "self-train-samples")
    known = s.filter("label is not null").select("sample_id", "label")
    none = known.limit(0)
    best, reports, pseudo = None, [], none
    for i in range(rounds):
        scores = stored(cross_fit(cells, s, known.unionByName(pseudo), folds, seed=seed, **ensemble), "self-train-scores")
        report = {"round": i, **accuracy(scores), "cut": confident_from(scores, least), "n_pseudo": pseudo.count()}
        reports.append(report)
        if best is not None and report["accuracy"] < reports[-2]["accuracy"]:
            break
        best = scores, pseudo
        new = none if report["cut"] is None else scores.filter((F.col("confidence") >= report["cut"]) & F.col("label").isNull()).select("sample_id", F.col("predicted").alias("label"))
        new = stored(new, "self-train-pseudo")
        if new.join(pseudo, ["sample_id", "label"], "left_anti").isEmpty() and pseudo.join(new, ["sample_id", "label"], "left_anti").isEmpty():
            break
        pseudo = new
    scores, taught = best
    mark = taught.select("sample_id", F.lit(True).alias("_p"))
    source = F.when(F.col("label").isNotNull(), "known").when(F.col("_p"), "pseudo").otherwise("unknown")
    return scores.join(mark, "sample_id", "left").withColumn("source", source).drop("_p"), reports


def classify_by_stratum(cells: DataFrame, samples: DataFrame, label: str, classes: tuple[str, str], stratum: str, min_known: int = 20) -> DataFrame:
    """stratum, and what `markers.classify_samples` gives, with a model of each stratum's own.

    Strata with fewer than ``min_known`` known labels, or without one of the classes, are left undecided ('U', source 'none'); a null stratum is one of its own."""
    known = samples.filter(F.col(label).isin(*classes)).groupBy(stratum).agg(F.count("*").alias("n"), F.count_distinct(label).alias("k"))
    sizes = samples.select(stratum).distinct().join(known.withColumnRenamed(stratum, "_s"), F.col(stratum).eqNullSafe(F.col("_s")), "left").select(stratum, "n", "k").collect()  # a row a stratum
    parts = []
    for r in sorted(sizes, key=lambda r: (r[stratum] is not None, r[stratum])):
        own = samples.filter(F.col(stratum).eqNullSafe(F.lit(r[stratum])))
        if (r["n"] or 0) >= min_known and r["k"] == 2:
            part = classify_samples(cells.join(own.select("sample_id"), "sample_id", "left_semi"), own, label, classes)
        else:
            is_known = F.coalesce(F.col(label).isin(*classes), F.lit(False))
            part = own.select("sample_id", F.when(is_known, F.col(label)).otherwise("U").alias(label), F.when(is_known, 1.0).otherwise(0.0).alias("confidence"), F.when(is_known, "known").otherwise("none").alias("source"))
        parts.append(part.withColumn(stratum, F.lit(r[stratum]).cast(samples.schema[stratum].dataType)))
    return reduce(DataFrame.unionByName, parts)


# Markers from a reference feature -------------------------------------------------------------------


def _log_density(x: str, share: Column, mean: Column, var: Column) -> Column:
    d = F.col(x) - mean
    return F.log(share) - 0.5 * F.log(2 * math.pi * var) - d * d / (2 * var)


def _posterior(x: str = "x") -> Column:
    """Probability of the upper component; null without a mixture or value."""
    gap = _log_density(x, F.lit(1.0) - F.col("share"), F.col("m0"), F.col("v0")) - _log_density(x, F.col("share"), F.col("m1"), F.col("v1"))
    return F.when(gap.isNotNull(), 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), gap)))))  # least and greatest pass over nulls


def two_components(values: DataFrame, keys: list[str] | None = None, min_samples: int = 20, max_iter: int = 60, tol: float = 1e-7) -> DataFrame:
    """keys, n, share, m0, v0, m1, v1 (m0 <= m1), log_likelihood: a mixture of two normals of ``x`` per key, by EM.

    A step is one aggregate of six sums a key, so no key's values meet in a task. Keys with fewer than ``min_samples``
    values, or with one value alone, have no row."""
    keys = keys or []
    v = stored(values.filter("x is not null").select(*keys, F.col("x").cast("double").alias("x")), "mixture-values")
    s = v.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).filter((F.col("n") >= min_samples) & (F.col("v") > 0))
    state = s.select(*keys, "n", F.lit(0.5).alias("share"), (F.col("m") - F.sqrt("v")).alias("m0"), (F.col("v") / 2).alias("v0"), (F.col("m") + F.sqrt("v")).alias("m1"), (F.col("v") / 2).alias("v1"), (F.col("v") * 1e-4).alias("floor"), F.lit(float("-inf")).alias("log_likelihood"), F.lit(True).alias("moves"))
    state = stored(state, "mixture")
    for _ in range(max_iter):
        j = v.join(state, keys) if keys else v.crossJoin(F.broadcast(state))  # one row
        a, b = _log_density("x", F.lit(1.0) - F.col("share"), F.col("m0"), F.col("v0")), _log_density("x", F.col("share"), F.col("m1"), F.col("v1"))
        top = F.greatest(a, b)
        j = j.withColumns({"w": _posterior(), "l": top + F.log(F.exp(a - top) + F.exp(b - top))})
        firsts = [F.first(c).alias(c) for c in ("n", "floor", "log_likelihood")]
        w, x = F.col("w"), F.col("x")
        g = j.groupBy(*keys).agg(*firsts, F.sum(w).alias("s1"), F.sum(w * x).alias("sx1"), F.sum(w * x * x).alias("sxx1"), F.sum((1 - w) * x).alias("sx0"), F.sum((1 - w) * x * x).alias("sxx0"), F.sum("l").alias("ll"))
        s1 = F.greatest(F.col("s1"), F.lit(1e-9))
        s0 = F.greatest(F.col("n") - F.col("s1"), F.lit(1e-9))
        m1, m0 = F.col("sx1") / s1, F.col("sx0") / s0
        var = lambda sxx, s, m: F.greatest(F.col(sxx) / s - m * m, F.col("floor"))
        share = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("s1") / F.col("n")))
        moves = F.col("ll") - F.col("log_likelihood") > tol * F.abs("ll")
        state = stored(g.select(*keys, "n", share.alias("share"), m0.alias("m0"), var("sxx0", s0, m0).alias("v0"), m1.alias("m1"), var("sxx1", s1, m1).alias("v1"), "floor", F.col("ll").alias("log_likelihood"), moves.alias("moves")), "mixture")
        if state.filter("moves").isEmpty():
            break
    flip = F.col("m0") > F.col("m1")
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    return state.select(*keys, "n", F.when(flip, 1 - F.col("share")).otherwise(F.col("share")).alias("share"), pick("m0", "m1").alias("m0"), pick("v0", "v1").alias("v0"), pick("m1", "m0").alias("m1"), pick("v1", "v0").alias("v1"), "log_likelihood")


def discover_from_reference(cells: DataFrame, reference: str, strata: list[str] | None = None, min_effect: float = 0.5, min_samples: int = 20) -> tuple[DataFrame, DataFrame]:
    """Two classes of samples from one feature's distribution, and the features that follow them.

    (strata, feature_id, d, r, n: standardised difference between the classes weighted by posterior, correlation with it,
    of features with |d| >= ``min_effect``, the reference left out; strata, sample_id, posterior of the upper class: null in
    strata too small to decide and of samples without the reference)."""
    strata = strata or []
    ref = cells.filter(F.col("feature_id") == reference).select(*strata, "sample_id", F.col("value").alias("x"))
    fitted = two_components(ref, strata, min_samples)
    samples = back(ref, fitted.select(*strata, "share", "m0", "v0", "m1", "v1"), strata) if strata else ref.join(fitted.drop("n"), F.lit(True), "left")
    samples = stored(samples.select(*strata, "sample_id", F.when(F.col("x").isNotNull(), _posterior()).alias("posterior")), "reference-samples")
    j = cells.filter((F.col("feature_id") != reference) & F.col("value").isNotNull()).join(samples.filter("posterior is not null").select("sample_id", "posterior"), "sample_id")
    p, x = F.col("posterior"), F.col("value")
    g = j.groupBy(*strata, "feature_id").agg(F.count("*").alias("n"), F.sum(p).alias("w1"), F.sum(1 - p).alias("w0"), F.sum(p * x).alias("x1"), F.sum((1 - p) * x).alias("x0"), F.sum(p * x * x).alias("q1"), F.sum((1 - p) * x * x).alias("q0"), (F.covar_pop(p, x) / F.nullif(F.stddev_pop(p) * F.stddev_pop(x), F.lit(0.0))).alias("r"))
    m1, m0 = F.try_divide(F.col("x1"), F.col("w1")), F.try_divide(F.col("x0"), F.col("w0"))
    pooled = (F.col("q1") - F.col("w1") * m1 * m1 + F.col("q0") - F.col("w0") * m0 * m0) / F.nullif(F.col("n") - 2, F.lit(0))
    d = F.try_divide(m1 - m0, F.sqrt(F.greatest(pooled, F.lit(0.0))))
    return g.select(*strata, "feature_id", d.alias("d"), "r", "n").filter(F.abs("d") >= min_effect), samples
