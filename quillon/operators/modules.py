"""Module discovery, stability and coherence: compositions over correlations, graphs and resampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import cliques, communities, correlate, graph, normalize
from quillon.operators.resample import bootstrap_weights, iterations
from quillon.operators.robust import back
from quillon.operators.store import stored

#: So many edges and features go to a task where regulators' targets are counted.
TASK_ROWS = 250_000


def discover(cells: DataFrame, condition: str, n_features: int = 5000, min_correlation: float = 0.7, min_size: int = 3, min_samples: int = 20, universe: DataFrame | None = None, greedy: bool = False) -> DataFrame:
    """Cliques of co-varying features per condition: most variable features, pair correlations, edges, enumeration.

    Conditions with fewer than ``min_samples`` samples give nothing; all conditions are one job."""
    if universe is not None:
        cells = cells.join(universe.select("feature_id"), "feature_id", "left_semi")
    top = normalize.variance_top(cells, n_features).select("feature_id")
    big = cells.groupBy(condition).agg(F.count_distinct("sample_id").alias("_n")).filter(F.col("_n") >= min_samples)
    c = cells.join(top, "feature_id", "left_semi").join(big.select(condition), condition, "left_semi")
    e = correlate.edges(correlate.correlations(c, keys=[condition]), min_correlation)
    return graph.maximum_cliques(e, [condition]).filter(F.col("size") >= min_size) if greedy else cliques.find_cliques(e, [condition], min_size)


def set_modules(pairs: DataFrame, sets: DataFrame, condition: str, min_correlation: float = 0.7, min_size: int = 3) -> DataFrame:
    """set_id, condition, members, size, n_targets, coherence_ratio: the largest coherent module of each set in each condition."""
    s = sets.select("set_id", "feature_id").distinct()
    e = correlate.edges(pairs, min_correlation).join(s.withColumnRenamed("feature_id", "a"), "a").join(s.withColumnRenamed("feature_id", "b"), ["set_id", "b"])
    m = graph.maximum_cliques(e.select("set_id", condition, "a", "b", "r"), ["set_id", condition]).filter(F.col("size") >= min_size)
    return back(m, s.groupBy("set_id").agg(F.count("*").alias("n_targets")), ["set_id"]).withColumn("coherence_ratio", F.col("size") / F.col("n_targets"))


def rewiring(modules: DataFrame, condition: str, case: str, control: str) -> DataFrame:
    """set_id, ratio_case, ratio_ctrl, rewiring = |difference| of coherence ratios; an absent module has ratio 0."""
    ratio = lambda v: F.coalesce(F.max(F.when(F.col(condition) == v, F.col("coherence_ratio"))), F.lit(0.0))
    g = modules.groupBy("set_id").agg(ratio(case).alias("ratio_case"), ratio(control).alias("ratio_ctrl"))
    return g.withColumn("rewiring", F.abs(F.col("ratio_case") - F.col("ratio_ctrl")))


def clique_differences(cliques: DataFrame, condition: str, case: str, control: str) -> DataFrame:
    """members, change: cliques (exact member sets) of one condition only."""
    key = cliques.select(condition, F.array_sort("members").alias("members"))
    a, b = (key.filter(F.col(condition) == v).select("members").distinct() for v in (case, control))
    return a.join(b, "members", "left_anti").withColumn("change", F.lit("gained")).unionByName(b.join(a, "members", "left_anti").withColumn("change", F.lit("lost")))


def clique_stability(cells: DataFrame, min_correlation: float = 0.7, min_size: int = 3, n: int = 100, seed: int = 0, groups: list[str] | None = None) -> DataFrame:
    """members, stability: share of bootstraps of the samples in which a clique is found; weights stand for repeats, and all
    resamples of a block of features are one task's matrix products."""
    w = bootstrap_weights(cells.select("sample_id", *(groups or [])).distinct(), n, groups, seed)
    p = correlate.resampled_correlations(cells.withColumn("_all", F.lit(0)), w, "_all", min_correlation)
    found = cliques.find_cliques(p, ["iteration"], min_size)
    return found.groupBy(F.array_sort("members").alias("members")).agg((F.count("*") / F.lit(n)).alias("stability"))


def stability_summary(cliques: DataFrame, pairs: DataFrame, least: float = 0.8) -> DataFrame:
    """features (comma-joined, sorted), size, stability, mean_correlation of the members' pairs in ``pairs``, is_stable."""
    c = cliques.select(F.array_sort("members").alias("members"), "stability").withColumn("features", F.array_join("members", ","))
    a = c.select("features", F.posexplode("members").alias("i", "a"))
    b = a.select("features", F.col("i").alias("j"), F.col("a").alias("b"))
    r = a.join(b, "features").filter("i < j").join(pairs.select("a", "b", "r"), ["a", "b"]).groupBy("features").agg(F.avg("r").alias("mean_correlation"))
    return c.join(r, "features", "left").select("features", F.size("members").alias("size"), "stability", "mean_correlation", (F.col("stability") >= least).alias("is_stable"))


def universe(cells: DataFrame, rule: str, n_features: int = 5000, edges: DataFrame | None = None, least: float = 0.0, min_targets: int = 1) -> DataFrame:
    """feature_id: the features that a module search looks at.

    variance: the most variable; measured: those with any value above ``least``; targets: measured features that a
    regulator of at least ``min_targets`` measured targets points to (edges may repeat; they are counted before they are read);
    components: measured ends of edges between measured features."""
    have = cells.filter(F.col("value") > least).select("feature_id").distinct() if rule == "measured" else cells.filter("value is not null").select("feature_id").distinct()
    if rule == "variance":
        return normalize.variance_top(cells, n_features).select("feature_id")
    if rule == "measured":
        return have
    have = have.withColumnRenamed("feature_id", "target")
    ends = edges.select("source", "target")
    if rule == "targets":
        # tasks by the number of rows, not the session's, and no broadcast: what one of them holds doesn't grow with the graph
        have = stored(have, "features")
        n = max(1, math.ceil((ends.count() + have.count()) / TASK_ROWS))
        hit = ends.filter("source is not null").repartition(n, "target").join(have.repartition(n, "target").hint("merge"), "target")
        pairs = hit.select("source", "target").repartition(n, "source").distinct()
        strong = pairs.withColumn("n", F.count("*").over(Window.partitionBy("source"))).filter(F.col("n") >= min_targets)
        return strong.select(F.col("target").alias("feature_id")).distinct()
    if rule == "components":
        inner = ends.join(have, "target", "left_semi").join(have.withColumnRenamed("target", "source"), "source", "left_semi").filter("source <> target")
        return inner.select(F.explode(F.array("source", "target")).alias("feature_id")).distinct()
    raise ValueError(f"unknown universe {rule}")


def stable(cliques: DataFrame, least: float = 0.8) -> DataFrame:
    return cliques.filter(F.col("stability") >= least)


def community_statistics(pairs: DataFrame, membership: DataFrame, keys: list[str]) -> DataFrame:
    """keys, community, size, mean_abs_r, min_abs_r, max_abs_r, density over all pairs inside (edge: |r| > 0 in ``pairs``)."""
    a = membership.select(*keys, F.col("node").alias("a"), "community")
    b = membership.select(*keys, F.col("node").alias("b"), F.col("community").alias("_c"))
    size = membership.groupBy(*keys, "community").agg(F.count("*").alias("size"))
    p = pairs.join(a, [*keys, "a"]).join(b, [*keys, "b"]).filter("community = _c").groupBy(*keys, "community").agg(F.avg(F.abs("r")).alias("mean_abs_r"), F.min(F.abs("r")).alias("min_abs_r"), F.max(F.abs("r")).alias("max_abs_r"), F.count("*").alias("_e"))
    j = size.join(p, [*keys, "community"], "left")
    return j.withColumn("density", F.coalesce(F.try_divide(2.0 * F.col("_e"), F.col("size") * (F.col("size") - 1)), F.lit(0.0))).drop("_e")


def modularity_null(cells: DataFrame, min_correlation: float, n: int = 50, seed: int = 0) -> DataFrame:
    """iteration, modularity of graphs whose features' values are shuffled over samples *independently of each other*."""
    from pyspark.sql import Window

    it = iterations(cells.filter("value is not null").select("feature_id", "sample_id", "value"), n)
    key = Window.partitionBy("iteration", "feature_id")
    pos = it.withColumn("_p", F.row_number().over(key.orderBy("sample_id"))).select("iteration", "feature_id", "sample_id", "_p")
    draw = it.withColumn("_p", F.row_number().over(key.orderBy(F.xxhash64(F.lit(seed), "iteration", "feature_id", "sample_id")))).select("iteration", "feature_id", "value", "_p")
    shuffled = pos.join(draw, ["iteration", "feature_id", "_p"])
    e = correlate.edges(correlate.correlations(shuffled, keys=["iteration"]), min_correlation).withColumn("weight", F.abs("r"))
    return communities.quality(e, communities.communities(e, ["iteration"]), ["iteration"]).select("iteration", "modularity")
