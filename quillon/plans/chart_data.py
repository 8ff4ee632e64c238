"""The relations that charts of a study are drawn from; nothing is drawn here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.robust import back
from quillon.schema import Quality, has_flag


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """feature_id, sample_id, before, after, change of imputed cells."""
    a = before.select("feature_id", "sample_id", F.col("value").alias("before"))
    b = after.filter(has_flag(F.col("flag"), Quality.IMPUTED)).select("feature_id", "sample_id", F.col("value").alias("after"))
    return a.join(b, ["feature_id", "sample_id"]).withColumn("change", F.col("after") - F.col("before"))


def histogram(df: DataFrame, column: str, bins: int = 50, keys: list[str] | None = None) -> DataFrame:
    """keys, bin, low, high, n over the common range of all rows."""
    keys = keys or []
    d = back(df.filter(F.col(column).isNotNull()), df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")), [])
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return d.groupBy(*keys, at.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n")).select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def vulnerability(cells: DataFrame, top: int = 30) -> DataFrame:
    """Features by share of flagged cells."""
    hit = F.count_if(has_flag(F.col("flag"), Quality.OUTLIER_DETECTED))
    return cells.groupBy("feature_id").agg(hit.alias("n_outliers"), (hit / F.count("*")).alias("rate")).orderBy(F.col("rate").desc(), "feature_id").limit(top)


def membership(cliques: DataFrame, keys: list[str]) -> DataFrame:
    """keys, clique, feature_id: a row per membership; the matrix is its pivot."""
    c = cliques.select(*keys, F.array_join(F.array_sort("members"), ",").alias("clique"), F.explode("members").alias("feature_id"))
    return c.distinct()


def feature_flow(modules: DataFrame, condition: str, a: str, b: str) -> DataFrame:
    """set_id, feature_id, flow (gained, lost, kept) between two conditions' modules."""
    one = lambda v, n: modules.filter(F.col(condition) == v).select("set_id", F.explode("members").alias("feature_id"), F.lit(True).alias(n))
    j = one(a, "_a").join(one(b, "_b"), ["set_id", "feature_id"], "full_outer")
    return j.select("set_id", "feature_id", F.when(F.col("_a") & F.col("_b"), "kept").when(F.col("_a"), "gained").otherwise("lost").alias("flow"))


def direction_composition(results: DataFrame, p: str = "p_value", threshold: float = 0.05) -> DataFrame:
    d = F.when(F.col(p) >= threshold, "none").when(F.col("effect_size") > 0, "up").otherwise("down")
    return results.groupBy("method", d.alias("direction")).agg(F.count("*").alias("n"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
