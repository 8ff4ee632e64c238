"""What users plug in: transforms, designs, feature sets, summarizers, tests, edge sources, id mappers, annotations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import kg


@dataclass(frozen=True)
class Transform:
    """A named, parameterised DataFrame -> DataFrame step; ``df.transform(step)`` runs it."""

    name: str
    apply: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)
    needs: tuple[str, ...] = ("feature_id", "sample_id", "value")
    created: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat(), compare=False)

    def __call__(self, cells: DataFrame) -> DataFrame:
        if problems := self.validate(cells):
            raise ValueError("; ".join(problems))
        return self.apply(cells, **self.params)

    def validate(self, cells: DataFrame) -> list[str]:
        return [f"{self.name} needs column {c}" for c in self.needs if c not in cells.columns]

    def describe(self) -> str:
        return json.dumps({"name": self.name, "params": self.params, "created": self.created}, default=str)


def chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda cells: reduce(lambda d, f: f(d), steps, cells)


class Design(Protocol):
    test: str
    reference: str

    def label(self) -> Column: ...


@dataclass(frozen=True)
class TwoGroups:
    """Two labels of a column; other samples have no label."""

    column: str
    test: str
    reference: str
    blocking: str | None = None

    def label(self) -> Column:
        return F.when(F.col(self.column).isin(self.test, self.reference), F.col(self.column))


@dataclass(frozen=True)
class DerivedGroups:
    """Labels by any expression over the metadata."""

    expression: Column = field(compare=False)
    test: str = "test"
    reference: str = "reference"

    def label(self) -> Column:
        return F.when(self.expression.isin(self.test, self.reference), self.expression)


def labelled(samples: DataFrame, design: Design) -> DataFrame:
    """sample_id, label of the samples that take part."""
    return samples.select("sample_id", design.label().alias("label")).filter("label is not null")


class Summarizer(Protocol):
    """cells, sets -> set_id, sample_id, value."""

    def __call__(self, cells: DataFrame, sets: DataFrame) -> DataFrame: ...


class Statistic(Protocol):
    """values (feature_id = set, sample_id, value), labels -> iteration, feature_id, t."""

    def __call__(self, values: DataFrame, labels: DataFrame, a: str, b: str) -> DataFrame: ...


def competitive_engine(cells: DataFrame, sets: DataFrame, design: Design, samples: DataFrame, summarize: Summarizer, statistic: Statistic, n: int = 200, seed: int = 0) -> DataFrame:
    """Each set's statistic against random sets of its size, with any summarizer and statistic; one job for all iterations."""
    from quillon.operators.resample import empirical_p, random_sets

    labels = labelled(samples, design).withColumn("iteration", F.lit(0))
    members = sets.select("set_id", "feature_id").distinct().join(cells.select("feature_id").distinct(), "feature_id", "left_semi")
    sizes = members.groupBy("set_id").agg(F.count("*").cast("int").alias("size"))
    null_sets = random_sets(cells, sizes, n, seed).select(F.concat_ws("|", "size", "iteration").alias("set_id"), "feature_id")
    run = lambda s: statistic(summarize(cells, s).withColumnRenamed("set_id", "feature_id"), labels, design.test, design.reference).select(F.col("feature_id").alias("set_id"), "t").filter("t is not null")
    null = run(null_sets).select(F.split("set_id", "\\|")[0].cast("int").alias("size"), "t")
    observed = run(members).join(sizes, "set_id")
    each = observed.select("set_id", "size").join(null, "size").select("set_id", "t")
    return empirical_p(observed, each, ["set_id"])


class EdgeSource(Protocol):
    """Edges (source, target, relationship, evidence_count)."""

    def edges(self) -> DataFrame: ...


@dataclass(frozen=True)
class TableSource:
    """Edges of a table in any store that Spark reads; filters and columns are pushed to the scan."""

    spark: SparkSession = field(compare=False)
    path: str = ""
    name: str = "table"

    def edges(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


@dataclass(frozen=True)
class CompositeSource:
    """The union of several sources; duplicates stay, as each is evidence of its own."""

    sources: tuple[EdgeSource, ...]

    def edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (s.edges() for s in self.sources))

    def module(self, regulator: str, min_evidence: int = 2) -> DataFrame:
        return kg.targets_of(regulator).evidence(min_evidence).entities(self.edges())

    def regulators(self, universe: DataFrame | None = None, min_targets: int = 10, min_evidence: int = 2) -> DataFrame:
        return kg.modules(self.edges(), universe, min_targets, min_evidence=min_evidence).orderBy(F.col("n_targets").desc(), "source")


def neighbor_sets(edges: DataFrame, entity: str, universe: DataFrame | None = None, min_evidence: int = 2, split: bool = True) -> DataFrame:
    """set_id, feature_id of an entity's neighbours, one set per relationship or one in all."""
    q = kg.targets_of(entity).evidence(min_evidence)
    e = (q if universe is None else q.within(universe)).edges(edges)
    name = F.concat_ws("_", F.lit(entity), "relationship") if split else F.lit(entity)
    return e.select(name.alias("set_id"), F.col("target").alias("feature_id")).distinct()


class StoredTable:
    """A result stored under a key of its content and parameters, recomputed only if absent."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def key(self, df: DataFrame, **params) -> str:
        """Content hash by order-free aggregates; the rows stay where they are."""
        h = F.xxhash64(*df.columns)
        row = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
        return hashlib.sha256(json.dumps([sorted(df.columns), [str(v) for v in row], sorted(params.items())], default=str).encode()).hexdigest()[:24]

    def get(self, df: DataFrame, compute: Callable[[DataFrame], DataFrame], force: bool = False, **params) -> DataFrame:
        path = f"{self.root}/{self.key(df, **params)}"
        fs, _ = self._fs()
        if force or not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            compute(df).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def entries(self) -> list[dict]:
        fs, root = self._fs()
        if not fs.exists(root):
            return []
        return [{"key": s.getPath().getName(), "modified": s.getModificationTime() / 1000, "bytes": fs.getContentSummary(s.getPath()).getLength()} for s in fs.listStatus(root)]

    def clear(self, max_age_days: float | None = None) -> int:
        """Entries older than so many days (all by default) are deleted; returns how many."""
        fs, _ = self._fs()
        now = datetime.now(timezone.utc).timestamp()
        old = [e for e in self.entries() if max_age_days is None or now - e["modified"] > max_age_days * 86400]
        for e in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{e['key']}"), True)
        return len(old)
