"""Matched control sets, interaction permutations and bootstrap selection of sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.normalize import summarize_sets
from quillon.operators.resample import bootstrap_weights, group_t, iteration_z, permuted_labels
from quillon.operators.robust import back


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment (rows <= columns), by shortest augmenting paths with potentials."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        slack, via, used = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last = i, -1
        while True:
            reduced = cost[row] - u[row] - v
            better = ~used & (reduced < slack)
            slack[better], via[better] = reduced[better], last
            j = int(np.where(used, np.inf, slack).argmin())
            step = slack[j]
            # shift the potentials by the shortest step
            u[i] += step
            for c in np.flatnonzero(used):
                u[row_of[c]] += step
            v[used] -= step
            slack[~used] -= step
            used[j] = True
            last = j
            if row_of[j] < 0:
                break
            row = int(row_of[j])
        while last >= 0:  # flip the path
            before = int(via[last])
            row_of[last] = row_of[before] if before >= 0 else i
            last = before
    out = np.empty(n, int)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


JITTER = 0.1


def _scatter(seed: int, iteration: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """A number in [-JITTER, JITTER) for each pair of hashes, whatever other pairs there are."""
    x = rows[:, None] * np.uint64(0x9E3779B97F4A7C15) + cols[None, :] + np.uint64((seed * 1_000_003 + iteration) & (2**63 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(11)).astype(np.float64) / 2**53 * 2 - 1) * JITTER


def matched_pool(stats: DataFrame, targets: DataFrame, step: int = 64) -> tuple[DataFrame, DataFrame]:
    """(targets, others that a least-cost matching can use), each feature_id, m, v of ``stats``.

    With k targets one of the k cheapest others of a target is always free, and jitter of 10 % lets only those be
    cheaper whose cost is at most 1.1 / 0.9 times the k-th: the rest can't be in any best matching. The cost of a pair
    is |difference of means| + |difference of variances| / 2.

    The k-th cost is bounded without looking at all pairs: others are dealt to cells of a grid over (m, v / 2), by
    quantiles of each, and counted. Around each target, cells are added ring by ring until they hold k others; the farthest
    corner of these is a bound, and the cells within it are joined by their number. Only the counts (as many as there are
    cells) and the targets are looked at as a whole."""
    chosen = targets.select("feature_id").distinct()
    t, rest = stats.join(chosen, "feature_id", "left_semi"), stats.join(chosen, "feature_id", "left_anti")
    k = t.count()
    y = F.col("v") / 2
    n = rest.count()
    if not n or not k:
        return t, rest
    side = max(1, min(64, round((n / step) ** 0.5)))
    shares = F.array(*(F.lit(i / side) for i in range(side + 1)))
    row = rest.agg(F.percentile_approx("m", shares, F.lit(10_000)), F.percentile_approx(y, shares, F.lit(10_000)), F.min("m"), F.max("m"), F.min(y), F.max(y)).first()
    edge_m, edge_v = (np.array([low, *q[1:-1], high]) for q, low, high in ((row[0], row[2], row[3]), (row[1], row[4], row[5])))
    number = lambda x, edges: sum((F.when(x > float(e), 1).otherwise(0) for e in edges[1:-1]), F.lit(0)).cast("int")
    dealt = rest.withColumns({"i": number(F.col("m"), edge_m), "j": number(y, edge_v)})
    held = np.zeros((side, side), np.int64)
    for r in dealt.groupBy("i", "j").count().collect():  # at most 64 x 64 cells
        held[r["i"], r["j"]] = r["count"]

    def reach(batches):
        """Every cell that a target's bound touches."""
        far_of = lambda x, e: np.maximum(np.abs(x - e[:-1]), np.abs(x - e[1:]))
        near_of = lambda x, e: np.maximum(0, np.maximum(e[:-1] - x, x - e[1:]))
        for b in batches:
            out = []
            for f, m, v in zip(b["feature_id"], b["m"], b["v"] / 2):
                far = (far_of(m, edge_m)[:, None] + far_of(v, edge_v)[None, :]).ravel()
                order = np.argsort(far, kind="stable")
                enough = np.searchsorted(np.cumsum(held.ravel()[order]), min(k, n))
                bound = far[order[enough]] * (1 + JITTER) / (1 - JITTER) + 1e-9
                near = near_of(m, edge_m)[:, None] + near_of(v, edge_v)[None, :]
                i, j = np.nonzero((near <= bound) & (held > 0))
                out.append(pd.DataFrame({"t": f, "tm": m, "tv": 2 * v, "bound": bound, "i": i.astype(np.int32), "j": j.astype(np.int32)}))
            yield pd.concat(out) if out else pd.DataFrame({"t": [], "tm": [], "tv": [], "bound": [], "i": [], "j": []})

    cells = t.select("feature_id", "m", "v").mapInPandas(reach, "t string, tm double, tv double, bound double, i int, j int")
    pairs = dealt.join(cells, ["i", "j"]).withColumn("c", F.abs(F.col("m") - F.col("tm")) + 0.5 * F.abs(F.col("v") - F.col("tv"))).filter("c <= bound")
    # the k smallest costs of each target, first by task: a bounded sketch that merges
    kth = pairs.withColumn("_s", F.pmod(F.xxhash64("feature_id"), F.lit(64))).withColumn("_rk", F.row_number().over(Window.partitionBy("t", "_s").orderBy("c"))).filter(F.col("_rk") <= k)
    kth = kth.withColumn("_rk", F.row_number().over(Window.partitionBy("t").orderBy("c"))).filter(F.col("_rk") <= k).groupBy("t").agg((F.max("c") * (1 + JITTER) / (1 - JITTER) + 1e-12).alias("most"))
    return t, pairs.join(kth, "t").filter("c <= most").select("feature_id", "m", "v").distinct()


def matched_sets(cells: DataFrame, targets: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """iteration, feature_id: control sets matched one to one on mean and variance to all other features, at least total
    cost, with 10 % jitter for variety. Fewer others than targets: all of them. Targets without values have no match."""
    stats = cells.groupBy("feature_id").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v")).filter("m is not null")
    t, p = (d.orderBy("feature_id").toPandas() for d in matched_pool(stats, targets))  # the targets, and what their matches can be
    if not len(t):
        return cells.sparkSession.createDataFrame([], "iteration int, feature_id string")
    cost = np.abs(t["m"].to_numpy()[:, None] - p["m"].to_numpy()[None, :]) + 0.5 * np.abs(t["v"].to_numpy()[:, None] - p["v"].to_numpy()[None, :])
    ids = p["feature_id"].tolist()
    rows, cols = (np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in d["feature_id"]], np.uint64) for d in (t, p))

    def draw(batches):
        for b in batches:
            for i in b["id"]:
                if cost.shape[1] < cost.shape[0]:
                    picked = range(cost.shape[1])
                else:
                    picked = assign(cost * (1 + _scatter(seed, int(i), rows, cols)))
                yield pd.DataFrame({"iteration": int(i), "feature_id": [ids[c] for c in picked]})

    return cells.sparkSession.range(n).mapInPandas(draw, "iteration int, feature_id string")


def matched_controls(cells: DataFrame, stats: DataFrame, targets: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """One row: the targets' mean |t| against matched sets; p and percentile."""
    x = stats.select("feature_id", F.abs("t").alias("x"))
    seen = x.join(targets.select("feature_id").distinct(), "feature_id", "left_semi").agg(F.avg("x").alias("_o"), F.count("*").alias("n_targets"))
    null = matched_sets(cells, targets, n, seed).join(x, "feature_id").groupBy("iteration").agg(F.avg("x").alias("z"))
    j = back(null, seen, [])
    return j.groupBy("_o", "n_targets").agg(F.avg("z").alias("null_mean"), F.stddev_samp("z").alias("null_sd"), ((F.count_if(F.col("z") >= F.col("_o")) + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("n_controls")).withColumnRenamed("_o", "mean_abs_t")


def interaction_permutation(cells: DataFrame, samples: DataFrame, label: str, primary: tuple[str, str], secondary: tuple[str, str], targets: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """One row: difference of competitive z between two contrasts, its null under one joint permutation of labels, p (two-sided), interval."""
    s = samples.filter(F.col(label).isin(*primary, *secondary)).select("sample_id", F.col(label).alias("label"))

    def z_of(labels: DataFrame, pair: tuple[str, str], name: str) -> DataFrame:
        return iteration_z(group_t(cells, labels, *pair), targets).withColumnRenamed("z", name)

    def both(labels: DataFrame) -> DataFrame:
        return z_of(labels, primary, "z1").join(z_of(labels, secondary, "z2"), "iteration").withColumn("dz", F.col("z1") - F.col("z2"))

    real = both(s.withColumn("iteration", F.lit(0))).select(F.col("dz").alias("observed_dz"))
    null = both(permuted_labels(s, "label", n, None, seed))
    cov = F.avg(F.col("z1") * F.col("z2")) - F.avg("z1") * F.avg("z2")
    return back(null, real, []).groupBy("observed_dz").agg(
        ((F.count_if(F.abs("dz") >= F.abs("observed_dz")) + 1) / (F.count("*") + 1)).alias("p"), F.percentile("dz", 0.025).alias("null_low"), F.percentile("dz", 0.975).alias("null_high"),
        F.try_divide(cov, F.nullif(F.stddev_pop("z1") * F.stddev_pop("z2"), F.lit(0.0))).alias("null_correlation"),
    )


def bootstrap_selection(cells: DataFrame, sets: DataFrame, samples: DataFrame, label: str, a: str, b: str, n: int = 100, critical_t: float = 2.0, stability: float = 0.8, fixed_controls: bool = True, seed: int = 0) -> DataFrame:
    """set_id, frequency of |t| beyond the critical value, share of the majority direction, mean and interval of t, robust.

    Cases are drawn with replacement; controls too, unless they stay fixed (advisable for few of them).
    Robust: selected often enough and in one direction at least as often."""
    s = samples.filter(F.col(label).isin(a, b)).select("sample_id", F.col(label).alias("label"))
    drawn = bootstrap_weights(s.filter(F.col("label") == a) if fixed_controls else s, n, ["label"], seed)
    if fixed_controls:
        from quillon.operators.resample import iterations

        drawn = drawn.unionByName(iterations(s.filter(F.col("label") == b).select("sample_id"), n).select("iteration", "sample_id", F.lit(1).cast("long").alias("times")))
    value = summarize_sets(cells, sets, "mean").withColumnRenamed("set_id", "feature_id")
    t = group_t(value, drawn.join(s, "sample_id"), a, b, weight="times").filter("t is not null")
    g = t.groupBy(F.col("feature_id").alias("set_id")).agg(F.avg((F.abs("t") > critical_t).cast("double")).alias("frequency"), F.avg((F.col("t") > 0).cast("double")).alias("_up"), F.avg("t").alias("mean_t"), F.percentile("t", 0.025).alias("low"), F.percentile("t", 0.975).alias("high"), F.count("*").alias("n"))
    g = g.withColumn("direction_share", F.greatest("_up", 1 - F.col("_up"))).drop("_up")
    return g.withColumn("robust", (F.col("frequency") >= stability) & (F.col("direction_share") >= stability))
