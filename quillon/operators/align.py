"""Ids, joins and alignment of samples, features and annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extract_or(raw: Column, pattern: str, group: int = 1) -> Column:
    """The pattern's group, or the trimmed id where it doesn't match."""
    return F.coalesce(F.nullif(F.regexp_extract(raw, pattern, group), F.lit("")), F.trim(raw))


def sample_fields(sample_id: Column) -> list[Column]:
    """phenotype, participant, cohort of ``PHENO-PARTICIPANT-COHORT``; phenotype UNKNOWN without a dash, cohort a number or null."""
    parts = F.split(sample_id, "-")
    pheno = F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("UNKNOWN")
    return [pheno.alias("phenotype"), F.coalesce(F.get(parts, F.lit(1)), sample_id).alias("participant"), F.get(parts, F.lit(2)).try_cast("int").alias("cohort")]


def subject_id(sample_id: Column, pattern: str | None = None, delimiter: str = "-", field: int = 1) -> Column:
    """Regex first, then the delimiter's field, else null."""
    by_field = F.get(F.split(sample_id, f"\\Q{delimiter}\\E"), F.lit(field))
    return by_field if pattern is None else F.coalesce(F.nullif(F.regexp_extract(sample_id, pattern, 1), F.lit("")), by_field)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk")


def enrich_samples(samples: DataFrame, clinical: DataFrame, subject_col: str, drop_unmatched: bool = False) -> DataFrame:
    """Clinical columns by ``subject_id``; the first clinical row of a subject counts, existing columns win, ``matched`` tells."""
    new = [c for c in clinical.columns if c not in samples.columns and c != subject_col]
    right = keep_first(clinical.filter(F.col(subject_col).isNotNull()), [subject_col], [F.monotonically_increasing_id()]).select(F.col(subject_col).alias("_subject"), *new, F.lit(True).alias("matched"))
    j = samples.join(right, samples["subject_id"] == right["_subject"], "inner" if drop_unmatched else "left").drop("_subject")
    return j.withColumn("matched", F.coalesce("matched", F.lit(False)))


def match_rate(enriched: DataFrame) -> DataFrame:
    return enriched.agg(F.count("*").alias("n_samples"), F.count_if("matched").alias("n_matched"), F.try_divide(F.count_if("matched"), F.count("*")).alias("match_rate"))


def phenotypes(samples: DataFrame, clinical: DataFrame, subject_col: str, source_col: str, case_values: list[str], control_values: list[str], prefixes: dict[str, str] | None = None) -> DataFrame:
    """sample_id, phenotype CASE / CTRL / EXCLUDE, and where it came from: clinical value, id prefix, or nowhere."""
    c = keep_first(clinical, [subject_col], [source_col]).select(F.col(subject_col).alias("_s"), F.col(source_col).alias("raw_value"))
    j = samples.join(c, samples["subject_id"] == c["_s"], "left")
    clinical_label = F.when(F.col("raw_value").isin(case_values), "CASE").when(F.col("raw_value").isin(control_values), "CTRL")
    prefix = reduce(lambda a, kv: F.coalesce(a, F.when(F.upper("sample_id").startswith(kv[0].upper()), kv[1])), (prefixes or {"CASE": "CASE", "CTRL": "CTRL"}).items(), F.lit(None).cast("string"))
    prefix = F.when(F.col("raw_value").isNull(), prefix)
    return j.select("sample_id", F.coalesce(clinical_label, prefix, F.lit("EXCLUDE")).alias("phenotype"), F.when(clinical_label.isNotNull(), "clinical").when(prefix.isNotNull(), "prefix").when(F.col("raw_value").isNotNull(), "unmapped").otherwise("none").alias("provenance"), "raw_value")


def symbol_cells(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cells re-keyed by symbol (feature_id, symbol); of several features the one of highest population variance, then smallest id."""
    v = cells.groupBy("feature_id").agg(F.var_pop("value").alias("_v")).join(mapping, "feature_id")
    best = keep_first(v, ["symbol"], [F.col("_v").desc_nulls_last(), "feature_id"]).select("feature_id", "symbol")
    return cells.join(best, "feature_id").withColumn("feature_id", F.col("symbol")).drop("symbol")


def resolve_entities(sources: list[DataFrame]) -> DataFrame:
    """id, symbol, biotype, confidence, source of the most confident resolution."""
    every = reduce(DataFrame.unionByName, sources)
    return keep_first(every, ["id"], [F.col("confidence").desc(), "source", "symbol"])


def reverse_symbols(resolved: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """name (upper case) -> id from symbols and aliases; symbols beat aliases, the last id of a symbol and the first of an alias count."""
    ok = resolved.filter((F.col("confidence") >= min_confidence) & F.col("symbol").isNotNull())
    s = ok.select(F.upper("symbol").alias("name"), "id", F.lit(0).alias("_p"), (-F.col("ord")).alias("_o"))
    a = ok.select(F.explode(F.transform("aliases", F.upper)).alias("name"), "id", F.lit(1).alias("_p"), F.col("ord").alias("_o"))
    return keep_first(s.union(a), ["name"], ["_p", "_o"]).select("name", "id")


def unify_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """symbol, side (both, left, right) of two id spaces (symbol columns), compared in upper case."""
    a = left.select(F.upper("symbol").alias("symbol")).distinct().withColumn("_a", F.lit(1))
    b = right.select(F.upper("symbol").alias("symbol")).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, "symbol", "full_outer")
    return j.select("symbol", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "left").otherwise("right").alias("side"))


def unify_rates(unified: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("side") == s)
    return unified.agg(n("both").alias("n_both"), n("left").alias("n_left"), n("right").alias("n_right"), F.try_divide(n("both"), F.count("*")).alias("overlap_rate"))


def align_samples(left: DataFrame, right: DataFrame, pattern: str) -> DataFrame:
    """participant, left_id, right_id of samples of two modalities."""
    one = lambda d, n: d.select(F.nullif(F.regexp_extract("sample_id", pattern, 1), F.lit("")).alias("participant"), F.col("sample_id").alias(n)).filter("participant is not null")
    return keep_first(one(left, "left_id"), ["participant"], ["left_id"]).join(keep_first(one(right, "right_id"), ["participant"], ["right_id"]), "participant", "full_outer")


def map_features(names: DataFrame, symbols: DataFrame, upper: bool = True) -> DataFrame:
    """name -> feature_id: exact match first, then by upper case."""
    exact = names.join(symbols.select(F.col("symbol").alias("name"), F.col("feature_id").alias("_e")), "name", "left")
    if upper:
        up = keep_first(symbols.select(F.upper("symbol").alias("_u"), F.col("feature_id").alias("_f")), ["_u"], ["_f"])
        exact = exact.join(up, F.upper("name") == F.col("_u"), "left").drop("_u")
    else:
        exact = exact.withColumn("_f", F.lit(None).cast("string"))
    return exact.withColumn("feature_id", F.coalesce("_e", "_f")).drop("_e", "_f")


def merge_experiments(a: DataFrame, b: DataFrame, p: str, threshold: float = 0.05) -> DataFrame:
    """Inner join of two result sets by set_id with -log10 p (floor 1e-10) and a category."""
    one = lambda d, s: d.select("set_id", F.col(p).alias(f"p_{s}"), (-F.log10(F.greatest(F.col(p), F.lit(1e-10)))).alias(f"score_{s}"))
    j = one(a, "a").join(one(b, "b"), "set_id")
    sa, sb = F.col("p_a") < threshold, F.col("p_b") < threshold
    return j.withColumn("category", F.when(sa & sb, "both").when(sa, "a_only").when(sb, "b_only").otherwise("neither"))


def available_columns(columns: list[str], groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """The groups' columns that are among ``columns``, in the groups' order; groups without any are left out."""
    present = {g: [c for c in wanted if c in columns] for g, wanted in groups.items()}
    return {g: found for g, found in present.items() if found}


def map_ids(ids: DataFrame, mapping: DataFrame, source: str, target: str, species: str | None = None) -> DataFrame:
    """id, mapped of the distinct ids of ``ids`` (id) by a stored mapping table, in place of an online service: the first
    target by name where there are several, null where there is none; ``species`` filters the table if it has that column."""
    m = mapping.filter(F.col("species") == species) if species is not None and "species" in mapping.columns else mapping
    one = m.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("id")).agg(F.min(target).alias("mapped"))
    return ids.select("id").filter("id is not null").distinct().join(one, "id", "left")
