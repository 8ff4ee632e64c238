"""Command line: ``python -m quillon COMMAND --input ... --output ...``; tables in, Parquet and JSON out."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import compare, correlate, modules, robust
from quillon.operators.cohort import Cohort, match_exactly
from quillon.plans import workflows
from quillon.sources import matrix


def load_config(path: str | None) -> dict:
    """YAML or JSON; command-line values win over it."""
    if not path:
        return {}
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def positive(kind, top: float | None = None):
    def check(text: str):
        v = kind(text)
        if not v > 0 or top is not None and v > top:
            raise argparse.ArgumentTypeError(f"{text} is out of range")
        return v

    return check


def study(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(cells with the condition, samples): a long Parquet table or a wide file, metadata and cohort joined."""
    if a.input.rstrip("/").endswith(".parquet"):
        cells = spark.read.parquet(a.input)
        samples = cells.select("sample_id").distinct()
    else:
        cells, samples = matrix.load_matrix(spark, a.input)
    if a.metadata:
        meta = spark.read.csv(a.metadata, header=True, inferSchema=True)
        samples = samples.join(meta.withColumnRenamed(meta.columns[0], "sample_id"), "sample_id")
    if a.cohort:
        samples = Cohort.from_yaml(a.cohort).resolve(samples, a.condition)
    if a.match:
        samples = match_exactly(samples, a.condition, a.match.split(","), a.seed)
    cells = cells.drop(a.condition) if a.condition in samples.columns else cells
    return (cells.join(samples.select("sample_id", a.condition), "sample_id") if a.condition in samples.columns else cells), samples


def _write(df: DataFrame, out: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{out}/{name}")


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    cells, samples = study(spark, a)
    out, pair = a.output.rstrip("/"), tuple(a.contrast.split(",")) if a.contrast else None
    sets = matrix.load_sets(spark, a.sets, a.min_size) if a.sets else None
    if a.command == "impute":
        flow = workflows.Clean(a.detector, a.mode, a.condition if a.mode == "within_group" else None, a.threshold, a.strategy, a.log1p)
        cleaned = flow.run(cells)
        _write(cleaned, out, "cells")
        _write(flow.report(cleaned), out, "flags")
    elif a.command == "sensitivity":
        _write(robust.sensitivity_sweep(cells, [float(t) for t in a.thresholds.split(",")], [a.condition] if a.mode == "within_group" else None), out, "sensitivity")
    elif a.command == "analyze":
        for name, df in workflows.analyze(cells, sets, a.condition, *pair, a.min_correlation, a.method).items():
            _write(df, out, name)
    elif a.command == "discover":
        _write(modules.discover(cells, a.condition, a.n_features, a.min_correlation, a.min_size), out, "modules")
    elif a.command == "differential":
        by_set, by_feature = workflows.differential_sets(cells, sets, a.condition, pair, a.summary), workflows.differential_features(cells, a.condition, pair)
        _write(by_set, out, "sets")
        _write(by_feature, out, "features")
        _write(workflows.compare_levels(by_set, by_feature, sets), out, "levels")
        if "rotation" in a.tests or "permutation" in a.tests:
            results = workflows.compare_methods(cells, sets, a.condition, pair, a.n)
            for name in a.tests.split(","):
                _write(results.filter(F.col("method").startswith(name)), out, name)
    elif a.command == "compare":
        results = workflows.compare_methods(cells, sets, a.condition, pair)
        _write(results, out, "results")
        _write(compare.concordance(results), out, "concordance")
        _write(compare.robust_hits(results), out, "robust_hits")
        if a.stratify:
            for name, df in workflows.stratified_comparison(cells, samples, sets, a.condition, pair, a.stratify, a.n, seed=a.seed).items():
                _write(df, out, f"stratified_{name}")
    elif a.command == "validate":
        targets = sets.select("feature_id").distinct()
        names = lambda text: text.split(",") if text else None
        others = [tuple(x.split(":")) for x in names(a.others) or []]
        verdict = workflows.Validation(f"{out}/phases").run(cells, samples, a.condition, pair, targets, names(a.covariates), names(a.strata), others, a.n, a.seed)
        matrix.write_json(f"{out}/verdict.json", verdict)
    elif a.command == "chart-data":
        pairs = correlate.correlations(cells, a.method, [a.condition])
        _write(correlate.signed_edges(pairs, a.min_correlation), out, "edges")
    matrix.write_json(f"{out}/params.json", {k: v for k, v in vars(a).items()})


COMMANDS = ("impute", "sensitivity", "analyze", "discover", "differential", "compare", "validate", "chart-data")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    for name in ("metadata", "cohort", "match", "sets", "contrast", "config", "covariates", "strata", "others", "stratify"):
        p.add_argument(f"--{name}")
    p.add_argument("--tests", default="", help="of differential: rotation, permutation")
    p.add_argument("--condition", default="phenotype")
    p.add_argument("--detector", default="mad-z", choices=("mad-z", "iqr", "multipass", "adjusted-boxplot", "kde", "student-t"))
    p.add_argument("--mode", default="within_group", choices=("within_group", "per_feature", "global"))
    p.add_argument("--strategy", default="mad-clip", choices=("mad-clip", "soft-clip", "median"))
    p.add_argument("--summary", default="polish", choices=("polish", "median", "mean", "logsum", "pc1"))
    p.add_argument("--method", default="pearson", choices=("pearson", "spearman", "max"))
    p.add_argument("--threshold", type=positive(float), default=5.0)
    p.add_argument("--thresholds", default="2,3,4,5,7")
    p.add_argument("--min-correlation", type=positive(float, 1.0), default=0.7)
    p.add_argument("--min-size", type=positive(int), default=3)
    p.add_argument("--n-features", type=positive(int), default=5000)
    p.add_argument("--n", type=positive(int), default=200)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--log1p", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    p = parser()
    first = p.parse_args(argv)
    p.set_defaults(**{k.replace("-", "_"): v for k, v in load_config(first.config).items()})
    a = p.parse_args(argv)
    if a.command in ("analyze", "differential", "compare", "validate") and not (a.sets and a.contrast):
        p.error(f"{a.command} needs --sets and --contrast")
    run(SparkSession.builder.appName("quillon").getOrCreate(), a)
