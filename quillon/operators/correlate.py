"""Pairwise correlation of features, edges, and comparisons of correlations between conditions.

Pairs are a self-join on the sample with a < b, aggregated by closed-form sums (partial aggregation
before the shuffle on the pair; no raw ``corr`` on constant columns). For many features the packed
form is joined in blocks instead: ``blocked_correlations`` multiplies blocks of standardised rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import coherence_z, fisher_z_difference, normal_p_value
from quillon.operators.multiple import bh
from quillon.operators.store import stored


def _moments(x: Column, y: Column, w: Column | None = None) -> Column:
    """Correlation of two columns from sums; 0 where one is constant."""
    w = F.lit(1.0) if w is None else w
    n = F.sum(w)
    mx, my = F.sum(w * x) / n, F.sum(w * y) / n
    cov = F.sum(w * x * y) / n - mx * my
    vx, vy = F.sum(w * x * x) / n - mx * mx, F.sum(w * y * y) / n - my * my
    flat = (vx <= 1e-12 * F.greatest(mx * mx, F.lit(1e-300))) | (vy <= 1e-12 * F.greatest(my * my, F.lit(1e-300)))
    r = F.try_divide(cov, F.sqrt(F.when(flat, None).otherwise(vx * vy)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0))))  # least and greatest skip nulls


def correlation(w: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, syy: Column) -> Column:
    """Correlation from weighted sums of centred values; NaN where a side has no spread."""
    spread = F.sqrt(F.greatest(sxx * w - sx * sx, F.lit(0.0)) * F.greatest(syy * w - sy * sy, F.lit(0.0)))
    return F.when(spread > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (sxy * w - sx * sy) / spread))).otherwise(F.lit(float("nan")))


def average_ranks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``rk``: average rank of the value within ``keys``."""
    w = Window.partitionBy(*keys)
    rank = F.rank().over(w.orderBy("value")) + (F.count("*").over(Window.partitionBy(*keys, "value")) - 1) / 2
    return cells.filter("value is not null").withColumn("rk", rank)


def correlations(cells: DataFrame, method: str = "pearson", keys: list[str] | None = None) -> DataFrame:
    """keys, a, b (a < b), r, n; methods pearson, spearman, max (larger |r|, ties to Pearson)."""
    keys = keys or []
    c = cells.filter("value is not null")
    if method != "pearson":
        c = average_ranks(c, [*keys, "feature_id"])
    # centring keeps the sums well conditioned
    m = c.groupBy(*keys, "feature_id").agg(F.avg("value").alias("_m"))
    c = c.join(m, [*keys, "feature_id"]).withColumn("x", F.col("value") - F.col("_m"))
    cols = ["x", *(["rk"] if method != "pearson" else [])]
    a = c.select(*keys, "sample_id", F.col("feature_id").alias("a"), *(F.col(k).alias(f"a_{k}") for k in cols))
    b = c.select(*keys, "sample_id", F.col("feature_id").alias("b"), *(F.col(k).alias(f"b_{k}") for k in cols))
    g = a.join(b, [*keys, "sample_id"]).filter("a < b").groupBy(*keys, "a", "b")
    p = _moments(F.col("a_x"), F.col("b_x"))
    if method == "pearson":
        return g.agg(p.alias("r"), F.count("*").alias("n"))
    s = _moments(F.col("a_rk"), F.col("b_rk"))
    if method == "spearman":
        return g.agg(s.alias("r"), F.count("*").alias("n"))
    both = g.agg(p.alias("_p"), s.alias("_s"), F.count("*").alias("n"))
    return both.select(*keys, "a", "b", F.when(F.abs("_s") > F.abs("_p"), F.col("_s")).otherwise(F.col("_p")).alias("r"), "n")


def weighted_correlations(cells: DataFrame, combine: str = "geometric") -> DataFrame:
    """Pairs of cells with ``weight``; a pair's weight is the geometric mean, minimum or product of its two. Always exact."""
    c = cells.filter("value is not null and weight > 0")
    a = c.select("sample_id", F.col("feature_id").alias("a"), F.col("value").alias("x"), F.col("weight").alias("wa"))
    b = c.select("sample_id", F.col("feature_id").alias("b"), F.col("value").alias("y"), F.col("weight").alias("wb"))
    w = {"geometric": F.sqrt(F.col("wa") * F.col("wb")), "minimum": F.least("wa", "wb"), "product": F.col("wa") * F.col("wb")}[combine]
    return a.join(b, "sample_id").filter("a < b").groupBy("a", "b").agg(_moments(F.col("x"), F.col("y"), w).alias("r"), F.count("*").alias("n"))


def blocked_correlations(rows: DataFrame, block: int = 512) -> DataFrame:
    """a, b, r of packed rows (feature_id, values without gaps): blocks of features are replicated once per
    partner block and multiplied, so a task holds two blocks and no pair of single rows is shuffled."""
    n = rows.count()
    blocks = max(1, -(-n // block))
    keyed = rows.withColumn("_own", F.pmod(F.xxhash64("feature_id"), F.lit(blocks)).cast("int"))
    spread = keyed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["values"].to_numpy()).astype(float)
        x = x - x.mean(1, keepdims=True)
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)
        ids, own = rows["feature_id"].to_numpy(), rows["_own"].to_numpy()
        lo = own == rows["_lo"].iloc[0]
        left, right = (np.flatnonzero(lo), np.flatnonzero(~lo)) if not lo.all() else (np.arange(len(x)),) * 2
        r = np.clip(x[left] @ x[right].T, -1, 1)
        i, j = np.nonzero(np.ones_like(r, bool) if not lo.all() else np.triu(np.ones_like(r, bool), 1))
        a, b = ids[left[i]], ids[right[j]]
        return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "r": r[i, j]})

    return spread.groupBy("_lo", "_hi").applyInPandas(lambda rows: product(rows), "a string, b string, r double")


def resampled_correlations(cells: DataFrame, weights: DataFrame, condition: str, least: float = 0.0, block: int = 256, most: int = 1 << 20) -> DataFrame:
    """condition, iteration, a, b, r with |r| >= ``least``: weighted pair correlations for every set of sample weights (iteration, sample_id, times).

    A task holds two blocks of features and all weights of a part of its condition's samples (about ``most`` cells a
    block); each iteration is six matrix products over the values that both features have, and the parts' sums are added
    by pair. Neither cells nor pairs are repeated per iteration before that."""
    have = cells.filter("value is not null").withColumnRenamed(condition, "_k")
    centre = stored(have.groupBy("_k", "feature_id").agg(F.avg("value").alias("_m"), F.count("*").alias("_n")), "centres")
    blocks = max(1, -(-centre.select("feature_id").distinct().count() // block))
    own = F.pmod(F.xxhash64("feature_id"), F.lit(blocks)).cast("int").alias("_own")
    cells_of_block = centre.groupBy("_k", own).agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] or 1
    parts = -(-cells_of_block // most)
    part = F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("int")
    near = have.join(centre, ["_k", "feature_id"]).withColumn("value", F.col("value") - F.col("_m"))  # near 0, for the sums of squares
    packed = near.groupBy("_k", "feature_id", part.alias("_part")).agg(F.collect_list("sample_id").alias("samples"), F.collect_list("value").alias("values")).select("*", own)
    spread = packed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
    times = weights.groupBy("sample_id").agg(F.collect_list("iteration").alias("its"), F.collect_list("times").alias("times"))
    grid = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.transform(F.sequence(i, F.lit(blocks - 1)), lambda j: F.struct(i.alias("_lo"), j.alias("_hi"))))))
    times = have.select("_k", "sample_id").distinct().join(times, "sample_id").withColumn("_b", grid).select(F.col("_k").alias("_k"), "_b._lo", "_b._hi", part.alias("_part"), "sample_id", "its", "times")
    sums = ("w", "sx", "sy", "sxy", "sxx", "syy")

    def product(key: tuple, rows: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({k: [] for k in ("_k", "iteration", "a", "b", *sums)})
        if not len(rows) or not len(draws):
            return none
        rows = rows.sort_values("feature_id")
        at = {s: i for i, s in enumerate(sorted(draws["sample_id"]))}
        its = sorted({i for x in draws["its"] for i in x})
        number = {i: k for k, i in enumerate(its)}
        w = np.zeros((len(its), len(at)))
        for s, which, k in zip(draws["sample_id"], draws["its"], draws["times"]):
            w[[number[i] for i in which], at[s]] = k
        x, m = np.zeros((len(rows), len(at))), np.zeros((len(rows), len(at)))
        for i, (ss, vs) in enumerate(zip(rows["samples"], rows["values"])):
            drawn = [(at[s], v) for s, v in zip(ss, vs) if s in at]
            if drawn:
                j, v = zip(*drawn)
                x[i, list(j)], m[i, list(j)] = v, 1
        ids, lo = rows["feature_id"].to_numpy(), rows["_own"].to_numpy() == key[1]
        left, right = (np.flatnonzero(lo), np.flatnonzero(~lo)) if key[1] != key[2] else (np.arange(len(x)),) * 2
        out = []
        for it, u in zip(its, w):
            xa, ma, xb, mb = x[left] * u, m[left] * u, x[right], m[right]
            size, sx, sy, sxy, sxx, syy = found = ma @ mb.T, xa @ mb.T, ma @ xb.T, xa @ xb.T, (xa * x[left]) @ mb.T, ma @ (xb * xb).T
            keep = size > 0
            if parts == 1:  # these are all samples: pairs that can't reach the limit end here
                gap = np.sqrt(np.maximum(sxx * size - sx * sx, 0) * np.maximum(syy * size - sy * sy, 0))
                keep &= np.abs(sxy * size - sx * sy) >= (least - 1e-9) * gap
            i, j = np.nonzero(keep if key[1] != key[2] else np.triu(keep, 1))
            a, b = ids[left[i]], ids[right[j]]
            out.append(pd.DataFrame({"_k": key[0], "iteration": it, "a": np.where(a < b, a, b), "b": np.where(a < b, b, a), **{k: v[i, j] for k, v in zip(sums, found)}}))
        return pd.concat(out) if out else none

    kind = have.schema["_k"].dataType.simpleString()
    by = ["_k", "_lo", "_hi", "_part"]
    made = spread.groupBy(*by).cogroup(times.groupBy(*by)).applyInPandas(product, f"_k {kind}, iteration int, a string, b string, " + ", ".join(f"{k} double" for k in sums))
    g = made.groupBy("_k", "iteration", "a", "b").agg(*(F.sum(k).alias(k) for k in sums))
    r = g.select(F.col("_k").alias(condition), "iteration", "a", "b", correlation(*map(F.col, sums)).alias("r"))
    return r.filter(~F.isnan("r") & (F.abs("r") >= least))


def edges(pairs: DataFrame, min_correlation: float = 0.7) -> DataFrame:
    """Signed edges with |r| at or above the limit."""
    return pairs.filter(F.abs("r") >= min_correlation)


def soft_threshold(pairs: DataFrame, power: float = 6.0, floor: float = 0.1) -> DataFrame:
    """weight = |r| ** power, dropped below ``floor``."""
    return pairs.withColumn("weight", F.pow(F.abs("r"), F.lit(power))).filter(F.col("weight") >= floor)


def signed_edges(pairs: DataFrame, min_correlation: float = 0.0) -> DataFrame:
    return edges(pairs, min_correlation).filter("r <> 0").withColumn("sign", F.when(F.col("r") > 0, "positive").otherwise("negative"))


def differential_pairs(pairs: DataFrame, case: str, control: str, method: str = "pearson", condition: str = "condition") -> DataFrame:
    """a, b, r and n in both conditions, z, p, q (BH over all pairs)."""
    one = lambda v, s: pairs.filter(F.col(condition) == v).select("a", "b", F.col("r").alias(f"r_{s}"), F.col("n").alias(f"n_{s}"))
    j = one(case, "case").join(one(control, "ctrl"), ["a", "b"])
    z = fisher_z_difference(F.col("r_case"), F.col("n_case"), F.col("r_ctrl"), F.col("n_ctrl"), method)
    return bh(j.withColumn("z", z).withColumn("p", normal_p_value("z")), "p", "q", by=["a", "b"])


def correlation_changes(pairs: DataFrame, a: str, b: str, fdr: float = 0.05, min_change: float = 0.3, condition: str = "condition") -> DataFrame:
    """Pairs whose correlation differs by at least ``min_change`` at the false discovery rate."""
    one = lambda v, s: pairs.filter(F.col(condition) == v).select("a", "b", F.col("r").alias(f"r_{s}"), F.col("n").alias(f"n_{s}"))
    j = one(a, "a").join(one(b, "b"), ["a", "b"]).withColumn("z", coherence_z(F.col("r_a"), F.col("n_a"), F.col("r_b"), F.col("n_b")))
    q = bh(j.withColumn("p", normal_p_value("z")), "p", "q", by=["a", "b"])
    return q.withColumn("delta", F.col("r_b") - F.col("r_a")).withColumn("significant", (F.col("q") < fdr) & (F.abs("delta") >= min_change))


def gained_lost(pairs: DataFrame, case: str, control: str, min_correlation: float, condition: str = "condition") -> DataFrame:
    """Edges that only one condition has: change is gained or lost."""
    e = edges(pairs, min_correlation)
    c, k = (e.filter(F.col(condition) == v).select("a", "b") for v in (case, control))
    return c.join(k, ["a", "b"], "left_anti").withColumn("change", F.lit("gained")).unionByName(k.join(c, ["a", "b"], "left_anti").withColumn("change", F.lit("lost")))


def effective_tests(r: np.ndarray, method: str = "nyholt") -> float:
    """Effective number of tests from a correlation matrix: sum over maximum of the eigenvalues, or Li and Ji."""
    m = len(r)
    if m <= 1:
        return float(m)
    ev = np.linalg.eigvalsh(r)
    ev = ev[ev > 1e-10]
    if not len(ev):
        return 1.0
    value = ev.sum() / ev.max() if method == "nyholt" else 1 + (len(ev) - 1) * (1 - ev.var() / len(ev))
    return float(np.clip(value, 1.0, m))
