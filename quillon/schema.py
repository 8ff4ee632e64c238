"""Relations of the engine: the matrix is a long fact table of cells with bitwise quality flags."""

from __future__ import annotations

from enum import IntFlag

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = "feature_id string, sample_id string, value double, flag int"
SETS = "set_id string, feature_id string, weight double"
EDGES = "source string, target string, relationship string, evidence_count bigint, confidence double, sources array<string>, metadata map<string,string>"


class Quality(IntFlag):
    """Bits of a cell's flag."""

    ORIGINAL = 0
    OUTLIER_DETECTED = 1
    IMPUTED = 2
    MISSING_ORIGINAL = 4
    BATCH_CORRECTED = 8
    LOW_CONFIDENCE = 16
    MANUAL_REVIEW = 32


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(int(bit)) != 0


def set_flag(flag: Column, bit: int, when: Column) -> Column:
    """The flag with the bit set where ``when`` holds; a null condition leaves it."""
    return F.when(F.coalesce(when, F.lit(False)), flag.bitwiseOR(int(bit))).otherwise(flag)


def canonical(cells: DataFrame) -> DataFrame:
    """NaN and infinite values become null, and null cells carry MISSING_ORIGINAL."""
    v = F.col("value").cast("double")
    v = F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
    flag = F.col("flag") if "flag" in cells.columns else F.lit(0)
    return cells.withColumn("flag", set_flag(flag.cast("int"), Quality.MISSING_ORIGINAL, v.isNull())).withColumn("value", v)


def flag_summary(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells per flag bit, by ``keys``."""
    counts = [F.count_if(has_flag(F.col("flag"), q)).alias(q.name.lower()) for q in Quality if q]
    return cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), *counts, F.bit_or("flag").alias("any_flags"))


def select_samples(cells: DataFrame, samples: DataFrame) -> DataFrame:
    return cells.join(samples.select("sample_id"), "sample_id", "left_semi")


def select_features(cells: DataFrame, features: DataFrame) -> DataFrame:
    return cells.join(features.select("feature_id"), "feature_id", "left_semi")


def unwide(wide: DataFrame, id_col: str) -> DataFrame:
    """Wide table (one column per sample) to long cells; the first of repeated features is kept by ``row_order`` if present."""
    samples = [c for c in wide.columns if c not in (id_col, "row_order")]
    keep = [id_col, *(["row_order"] if "row_order" in wide.columns else [])]
    typed = wide.select(*keep, *(F.col(f"`{c}`").cast("double").alias(c) for c in samples))
    return typed.unpivot(keep, samples, "sample_id", "value").withColumnRenamed(id_col, "feature_id")


def widen(cells: DataFrame, samples: list[str], value: str = "value") -> DataFrame:
    """Long cells to one row per feature; the sample list bounds the width."""
    return cells.groupBy("feature_id").pivot("sample_id", samples).agg(F.first(value))


def packed(cells: DataFrame, *keys: str) -> DataFrame:
    """feature_id -> array of values in sample order (null for missing): what matrix kernels take."""
    entries = F.array_sort(F.collect_list(F.struct("sample_ord", "value")))
    return cells.groupBy(*keys, "feature_id").agg(F.transform(entries, lambda x: x["value"]).alias("values"))
