"""Multiple testing as windows over p values, null values aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.robust import back
from quillon.operators.store import stored

EULER = 0.57721566490153286
#: Distinct p values in a window.
WINDOW = 100_000


def ranged(df: DataFrame, col: str, parts: int = 64) -> DataFrame:
    """``df`` with ``_part``: rows in ``parts`` ranges of the column, in order, so that no window takes all rows.

    The limits are approximate quantiles, one row; equal values are in one range."""
    limits = df.agg(F.percentile_approx(col, F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(10_000)).alias("_limits"))
    return df.crossJoin(F.broadcast(limits)).withColumn("_part", F.size(F.filter(F.coalesce("_limits", F.array()), lambda x: x < F.col(col)))).drop("_limits")


def _before(rows: DataFrame, keys: list[str], col: str, sums: list[str]) -> DataFrame:
    """Running sums of ``sums`` in the order of ``col`` within keys: within a range by a window, plus the totals of the ranges before (few rows)."""
    up = Window.partitionBy(*keys, "_part").orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"_t{c}") for c in sums))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_part", *(F.coalesce(F.sum(f"_t{c}").over(earlier), F.lit(0)).alias(f"_b{c}") for c in sums))
    out = back(rows, starts, [*keys, "_part"])
    return out.select(*[c for c in rows.columns if c not in sums], *sums, *((F.sum(c).over(up) + F.col(f"_b{c}")).alias(f"_run{c}") for c in sums))


def _least_from_here(rows: DataFrame, keys: list[str], col: str, value: str, out: str) -> DataFrame:
    """``out``: the least ``value`` at this and larger ``col`` within keys, ranges as above."""
    down = Window.partitionBy(*keys, "_part").orderBy(F.col(col).desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = rows.groupBy(*keys, "_part").agg(F.min(value).alias("_m")).select(*keys, "_part", F.min("_m").over(later).alias("_after"))
    return back(rows, least, [*keys, "_part"]).withColumn(out, F.least(F.min(value).over(down), F.col("_after"))).drop("_after")


def harmonic(n: Column, method: str) -> Column:
    """1 + 1/2 + ... + 1/n for Benjamini-Yekutieli, else 1: summed for small n, by its expansion (to 1e-14) beyond."""
    if method == "bh":
        return F.lit(1.0)
    few = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(64).cast("long"))), F.lit(0.0), lambda a, i: a + 1 / i)
    x = n.cast("double")
    return F.when(n <= 64, few).otherwise(F.log(x) + EULER + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def bh(df: DataFrame, p: str, out: str = "q", by: list[str] | None = None, keys: list[str] | None = None, method: str = "bh") -> DataFrame:
    """Benjamini-Hochberg (or -Yekutieli) values within ``keys``; ``by`` breaks ties of p. Null p stays null.

    q = min over equal and larger p of p * m / rank; equal p values share the largest rank, so the
    minimum may be taken over *distinct* p values with their counts. The input is stored first: it is read for its counts
    and to get its values of q, and sums taken anew in another order may differ in their last bits and find no p. Up to
    ``WINDOW`` counts are one window a key; beyond, windows run within ranges of p, and what the ranges before and after
    add is found over one row a range: the values are the same.
    """
    keys, df = keys or [], stored(df, "bh-rows")
    counts = stored(df.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_c")), "bh-counts")
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n")).withColumn("_f", harmonic(F.col("_n"), method))
    whole = lambda rows: back(rows, total, keys).withColumn("_q", F.col(p) * F.col("_n") * F.col("_f") / F.col("_run_c"))
    parts = -(-counts.count() // WINDOW)
    if parts <= 1:
        by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy
        ranked = whole(counts.withColumn("_run_c", F.sum("_c").over(by(p).rowsBetween(Window.unboundedPreceding, 0))))
        q = ranked.withColumn(out, F.min("_q").over(by(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ranked = stored(whole(_before(stored(ranged(counts, p, min(1024, parts)), "bh-ranged"), keys, p, ["_c"])), "bh-ranked")
        q = _least_from_here(ranked, keys, p, "_q", out)
    return back(df, q.select(*keys, p, F.least(F.lit(1.0), F.col(out)).alias(out)), [*keys, p])


def bonferroni(df: DataFrame, p: str, out: str = "q", keys: list[str] | None = None) -> DataFrame:
    m = df.groupBy(*(keys or [])).agg(F.count(p).alias("_m"))
    return back(df, m, keys or []).withColumn(out, F.least(F.lit(1.0), F.col(p) * F.col("_m"))).drop("_m")


def storey(observed: DataFrame, null: DataFrame, p: str = "p", out: str = "q") -> DataFrame:
    """q values against permutation p values: pi0 is the median over the usual cut-offs; counts by a merged running sum.

    Both are stored, as q comes back by p."""
    observed, null = stored(observed, "storey-rows"), stored(null.select(p), "storey-null")
    cuts = [i * 0.05 for i in range(1, 19)]
    pi0 = observed.agg(F.count(p).alias("_m"), F.array(*(F.least(F.lit(1.0), F.count_if(F.col(p) > c) / (F.count(p) * (1 - c))) for c in cuts)).alias("_e"))
    pi0 = pi0.select("_m", F.explode("_e").alias("_e")).groupBy("_m").agg(F.median("_e").alias("_pi0"))
    n_null = null.agg(F.count(p).alias("_n"))
    both = observed.filter(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_o"), F.lit(0).cast("long").alias("_z")).unionByName(null.filter(F.col(p).isNotNull()).groupBy(p).agg(F.lit(0).cast("long").alias("_o"), F.count("*").alias("_z")))
    both = both.groupBy(p).agg(F.sum("_o").alias("_o"), F.sum("_z").alias("_z"))
    both = _before(ranged(both, p), [], p, ["_o", "_z"]).filter("_o > 0").crossJoin(F.broadcast(pi0)).crossJoin(F.broadcast(n_null))  # one row each
    both = both.withColumn("_q", F.least(F.lit(1.0), F.col("_pi0") * F.col("_run_z") * F.col("_m") / F.col("_n") / F.col("_run_o")))
    return back(observed, _least_from_here(both, [], p, "_q", out).select(p, out), [p])
