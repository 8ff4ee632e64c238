"""Cohorts: declarative criteria compiled to one Column, labels by first matching group."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("eq", "ne", "in", "not_in", "gte", "gt", "lte", "lt", "isna", "notna")


@dataclass(frozen=True)
class Criterion:
    column: str
    op: str
    value: object = None
    allow_na: bool = False

    def condition(self) -> Column:
        """Null is false for every comparison, ``ne`` and ``not_in`` too, unless ``allow_na``."""
        c = F.col(self.column)
        if self.op == "isna":
            return c.isNull()
        if self.op == "notna":
            return c.isNotNull()
        if self.op in ("gte", "gt", "lte", "lt"):
            n, v = c.try_cast("double"), float(self.value)
            p = {"gte": n >= v, "gt": n > v, "lte": n <= v, "lt": n < v}[self.op]
        elif self.op in ("in", "not_in"):
            p = c.isin(list(self.value))
            p = p if self.op == "in" else ~p
        elif self.op in ("eq", "ne"):
            p = c == F.lit(self.value)
            p = p if self.op == "eq" else ~p
        else:
            raise ValueError(f"unknown operator {self.op}")
        return F.coalesce(p, F.lit(self.allow_na))


@dataclass(frozen=True)
class Group:
    label: str
    criteria: tuple[Criterion, ...] = ()
    logic: str = "all"

    def condition(self, columns: list[str], strict: bool = True) -> Column:
        """No criteria: true. A missing column raises when strict; else it is false, and is skipped with ``all``."""
        missing = [c.column for c in self.criteria if c.column not in columns]
        if missing and strict:
            raise KeyError(f"columns {missing} are missing")
        parts = [c.condition() for c in self.criteria if c.column in columns]
        if not self.criteria:
            return F.lit(True)
        if not parts:
            return F.lit(False)
        return reduce(lambda a, b: a | b if self.logic == "any" else a & b, parts)


@dataclass(frozen=True)
class Cohort:
    name: str
    groups: tuple[Group, ...]
    base_filter: tuple[Criterion, ...] = ()
    contrast: tuple[str, str] | None = None
    description: str = field(default="", compare=False)

    @staticmethod
    def parse(raw: dict) -> Cohort:
        """From a mapping; each criterion has exactly one operator key."""

        def criterion(d: dict) -> Criterion:
            ops = [k for k in d if k in OPERATORS]
            if "column" not in d or len(ops) != 1:
                raise ValueError(f"a criterion needs a column and exactly one of {OPERATORS}: {d}")
            return Criterion(d["column"], ops[0], d[ops[0]], bool(d.get("allow_na", False)))

        groups = []
        for label, g in raw["groups"].items():
            logic = "any" if "any" in g else "all"
            groups.append(Group(label, tuple(map(criterion, g.get(logic, []))), logic))
        if not groups:
            raise ValueError("a cohort needs groups")
        contrast = tuple(raw["contrast"]) if raw.get("contrast") else None
        if contrast and not set(contrast) <= {g.label for g in groups}:
            raise ValueError("the contrast names unknown groups")
        return Cohort(raw.get("name", "cohort"), tuple(groups), tuple(map(criterion, raw.get("base_filter", []))), contrast, raw.get("description", ""))

    @staticmethod
    def from_yaml(path: str) -> Cohort:
        import yaml

        return Cohort.parse(yaml.safe_load(Path(path).read_text()))

    def _base(self) -> Column:
        return reduce(lambda a, b: a & b, (c.condition() for c in self.base_filter), F.lit(True))

    def resolve(self, samples: DataFrame, column: str = "cohort", strict: bool = True) -> DataFrame:
        """Samples that pass the base filter and match a group, labelled by the first match."""
        label = reduce(lambda a, g: F.coalesce(a, F.when(g.condition(samples.columns, strict), g.label)), self.groups, F.lit(None).cast("string"))
        return samples.filter(self._base()).withColumn(column, label).filter(F.col(column).isNotNull())

    def audit(self, samples: DataFrame, strict: bool = True) -> DataFrame:
        """group, n_match (alone), n_assigned, n_overlap (matched before): one aggregate over the samples."""
        base = samples.filter(self._base())
        out, before = [], F.lit(False)
        for g in self.groups:
            c = g.condition(samples.columns, strict)
            out += [F.struct(F.lit(g.label).alias("group"), F.count_if(c).alias("n_match"), F.count_if(c & ~before).alias("n_assigned"), F.count_if(c & before).alias("n_overlap"))]
            before = before | c
        return base.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def carriers_against(samples: DataFrame, mutation: str, mutation_col: str, phenotype_col: str = "phenotype", case: str = "CASE", repeat_col: str | None = None, repeat_min: float | None = None) -> Cohort:
    """Carriers of a mutation against sporadic cases: built from the columns that the samples have."""
    if mutation_col not in samples.columns:
        raise KeyError(mutation_col)
    carrier = [Criterion(mutation_col, "eq", mutation)]
    if repeat_col and repeat_col in samples.columns and repeat_min is not None:
        carrier.append(Criterion(repeat_col, "gte", repeat_min))
    base = (Criterion(phenotype_col, "eq", case),) if phenotype_col in samples.columns else ()
    return Cohort(f"{mutation}_vs_sporadic", (Group("carrier", tuple(carrier), "any"), Group("sporadic", (Criterion(mutation_col, "isna"),))), base, ("carrier", "sporadic"))


def drop_ids(features: DataFrame, patterns: list[str], column: str = "feature_id", regex: bool = False, case_sensitive: bool = False, keep: bool = False) -> DataFrame:
    """Rows whose id holds none of the literals (or matches none of the expressions); ``keep``: the complement."""
    c = F.col(column)
    if regex:
        hit = c.rlike(("" if case_sensitive else "(?i)") + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    else:
        low = c if case_sensitive else F.lower(c)
        hit = reduce(lambda a, p: a | low.contains(p if case_sensitive else p.lower()), patterns, F.lit(False))
    hit = F.coalesce(hit, F.lit(False))
    return features.filter(hit if keep else ~hit)


def match_exactly(samples: DataFrame, group: str, strata: list[str], seed: int = 0) -> DataFrame:
    """Each stratum downsampled to its smallest group (0 where a group is absent), by a seeded hash of the id."""
    from pyspark.sql import Window

    from quillon.operators.robust import back

    n_groups = samples.agg(F.count_distinct(group).alias("_g"))
    sizes = samples.groupBy(*strata, group).agg(F.count("*").alias("_c"))
    least = back(sizes.groupBy(*strata).agg(F.min("_c").alias("_k"), F.count("*").alias("_have")), n_groups, [])
    least = least.select(*strata, F.when(F.col("_have") == F.col("_g"), F.col("_k")).otherwise(0).alias("_k"))
    w = Window.partitionBy(*strata, group).orderBy(F.xxhash64(F.lit(seed), "sample_id"), "sample_id")
    return back(samples.withColumn("_rk", F.row_number().over(w)), least, strata).filter("_rk <= _k").select(*samples.columns)


def match_audit(samples: DataFrame, matched: DataFrame, group: str, strata: list[str]) -> DataFrame:
    a = samples.groupBy(*strata, group).agg(F.count("*").alias("n_before"))
    b = matched.groupBy(*strata, group).agg(F.count("*").alias("n_after"))
    return a.join(b, [*strata, group], "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))
