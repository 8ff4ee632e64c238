"""Reading and writing matrices: wide files to long cells and back, metadata, annotations, sets."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.align import keep_first, sample_fields
from quillon.schema import canonical, unwide
from quillon.sources.formats import PRESETS, Format, detect_id_type, head_text, sniff_delimiter, suggest_format


def read_wide(spark: SparkSession, path: str, fmt: Format | None = None) -> DataFrame:
    """A delimited file with string columns; ``row_order`` is its order (only for keep-first)."""
    fmt = fmt or suggest_format(head_text(spark, path))
    sep = fmt.delimiter or sniff_delimiter(head_text(spark, path))
    df = spark.read.options(sep=sep, header=True, encoding=fmt.encoding, enforceSchema=False).csv(path)
    keep = [c for i, c in enumerate(df.columns) if i == 0 or not fmt.drops(c)]
    return df.select(*(F.col(f"`{c}`") for c in keep)).withColumn("row_order", F.monotonically_increasing_id())


def _turned(cells: DataFrame) -> DataFrame:
    """Features as samples and samples as features."""
    return cells.select(F.col("sample_id").alias("feature_id"), F.col("feature_id").alias("sample_id"), *(c for c in cells.columns if c not in ("feature_id", "sample_id")))


def load_matrix(spark: SparkSession, path: str, fmt: Format | str | None = None, strict: bool = False, samples_in_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, samples) of a wide file: first column ids, header samples, repeated features and samples keep the first.

    ``samples_in_rows``: the file's rows are samples and its header features (then samples are ordered by their rows, with gaps).
    ``strict`` raises on values that are neither a number nor a missing token, and on infinite ones; otherwise they are missing.
    """
    fmt = PRESETS[fmt] if isinstance(fmt, str) else fmt or suggest_format(head_text(spark, path))
    wide = read_wide(spark, path, fmt)
    id_col, *names = (c for c in wide.columns if c != "row_order")
    if not samples_in_rows:
        wide = wide.withColumn(id_col, fmt.id_column(F.col(f"`{id_col}`")))
    wide = keep_first(wide, [id_col], ["row_order"])
    na = list(fmt.na_values)
    raw = wide.select(F.col(id_col).alias("feature_id"), *(F.when(F.trim(F.col(f"`{c}`")).isin(na), None).otherwise(F.trim(F.col(f"`{c}`"))).alias(c) for c in names))
    cells = raw.unpivot(["feature_id"], names, "sample_id", "text").withColumn("value", F.col("text").try_cast("double"))
    if strict and (bad := cells.filter((F.col("text").isNotNull() & F.col("value").isNull()) | (F.abs("value") == float("inf"))).first()):
        raise ValueError(f"{bad['feature_id']}, {bad['sample_id']}: {bad['text']!r} is no finite number")
    if samples_in_rows:
        cells = _turned(cells).withColumn("feature_id", fmt.id_column(F.col("feature_id")))
        samples = wide.select(F.col(id_col).alias("sample_id"), F.col("row_order").alias("sample_ord"))
    else:
        samples = spark.createDataFrame([(c, i) for i, c in enumerate(names)], "sample_id string, sample_ord int")
    extra = fmt.sample_columns(F.col("sample_id"))
    samples = samples.select("sample_id", "sample_ord", *(extra or sample_fields(F.col("sample_id"))))
    return canonical(cells.select("feature_id", "sample_id", "value")), samples


def load_counts(spark: SparkSession, path: str, annotation: str | None = None, ids_only: bool = False) -> tuple[DataFrame, str]:
    """(cells or ids, id type) of a count matrix; a two-column annotation (index, gene id) renames rows, unmapped ids pass."""
    wide = read_wide(spark, path, Format("counts"))
    id_col = wide.columns[0]
    if annotation:
        a = read_wide(spark, annotation, Format("annotation")).drop("row_order")
        index, gene = a.columns[:2]
        a = keep_first(a.select(F.col(index).alias("_i"), F.col(gene).alias("_g")), ["_i"], ["_g"])
        wide = wide.join(a, wide[id_col] == a["_i"], "left").withColumn(id_col, F.coalesce("_g", id_col)).drop("_i", "_g")
    ids = wide.select(F.col(id_col).alias("feature_id"))
    kind = detect_id_type(ids)
    if ids_only:
        return ids.distinct(), kind
    return canonical(unwide(keep_first(wide, [id_col], ["row_order"]).drop("row_order"), id_col)), kind


def write_matrix(cells: DataFrame, path: str, samples: list[str], flags: bool = True, samples_in_rows: bool = False) -> None:
    """Wide CSV folders ``path.data`` and ``path.flags``; ``samples`` bounds the width.

    ``samples_in_rows``: rows are samples, and ``samples`` names the features that are the columns: the way to write many
    samples of few features. Long Parquet is the better sink for many of both."""
    from quillon.schema import widen

    cells = _turned(cells) if samples_in_rows else cells
    widen(cells, samples).write.mode("overwrite").csv(f"{path}.data", header=True)
    if flags:
        widen(cells, samples, "flag").write.mode("overwrite").csv(f"{path}.flags", header=True)


def write_long(cells: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    cells.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def _hadoop(path: str):
    """(file system, path, Hadoop's Path) of the session at hand; None without a session. Local files have no checksum beside them, so that they may be edited."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    kind = spark._jvm.org.apache.hadoop.fs.Path
    fs = kind(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.ChecksumFileSystem").isInstance(fs):
        fs = fs.getRawFileSystem()
    return fs, kind(path), kind


def write_json(path: str, data) -> None:
    """Atomically: a temporary file renamed, through Hadoop's file systems where there is a session (else on the local disk)."""
    text = data if isinstance(data, str) else json.dumps(data, indent=2, default=str)
    if (at := _hadoop(path)) is None:
        p = Path(path)
        p.parent.mkdir(parents=True, exist_ok=True)
        t = p.with_name(p.name + ".tmp")
        t.write_text(text)
        t.replace(p)
        return
    fs, target, kind = at
    draft = kind(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"{path} could not be written")


def read_json(path: str):
    """What `write_json` wrote, None if there is no such file."""
    if (at := _hadoop(path)) is None:
        return json.loads(Path(path).read_text()) if Path(path).exists() else None
    fs, target, _ = at
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return json.loads(SparkSession.getActiveSession()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def load_sets(spark: SparkSession, path: str, min_members: int = 3) -> DataFrame:
    """set_id, feature_id of a set file: wide (members in one comma-joined column) or long (a member a row)."""
    df = spark.read.csv(path, header=True)
    set_col = next(c for c in ("clique_id", "set_id", "regulator") if c in df.columns)
    if "clique_genes" in df.columns:
        m = df.select(F.col(set_col).alias("set_id"), F.explode(F.transform(F.split("clique_genes", ","), F.trim)).alias("feature_id"))
    else:
        m = df.select(F.col(set_col).alias("set_id"), F.col("gene" if "gene" in df.columns else "feature_id").alias("feature_id"))
    m = m.filter("feature_id <> ''").distinct()
    return m.join(m.groupBy("set_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_members), "set_id", "left_semi")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """term, name, namespace of the [Term] stanzas of an ontology file."""
    t = spark.read.text(path, lineSep="\n\n").filter(F.col("value").contains("[Term]"))
    tag = lambda k: F.nullif(F.regexp_extract("value", rf"(?m)^{k}: (.*)$", 1), F.lit(""))
    return t.select(tag("id").alias("term"), tag("name").alias("name"), tag("namespace").alias("namespace"), F.col("value").rlike(r"(?m)^is_obsolete: true").alias("obsolete")).filter("term is not null")


#: Aspects of an annotation file.
ASPECTS = {"P": "biological_process", "F": "molecular_function", "C": "cellular_component"}


def read_annotations(spark: SparkSession, path: str, id_type: str = "symbol") -> DataFrame:
    """feature_id, term, category of an annotation file (tab-separated, ``!`` comments, 13 fields at least)."""
    parts = spark.read.text(path).filter(~F.col("value").startswith("!")).select(F.split("value", "\t", -1).alias("f")).filter(F.size("f") >= 13)
    gene = F.col("f")[2] if id_type == "symbol" else F.nullif(F.regexp_extract(F.concat_ws("|", F.col("f")[10], F.col("f")[1]), r"(ENS[A-Z]*G\d{11})", 1), F.lit(""))
    aspect = reduce(lambda a, kv: a.when(F.col("f")[8] == kv[0], kv[1]), list(ASPECTS.items())[1:], F.when(F.col("f")[8] == "P", ASPECTS["P"]))
    negated = F.col("f")[3].contains("NOT")
    return parts.filter(~negated).select(gene.alias("feature_id"), F.col("f")[4].alias("term"), aspect.alias("category")).filter("feature_id is not null and feature_id <> ''").distinct()


def log_status(cells: DataFrame) -> str:
    """logged, raw or unknown by the range of values."""
    low, high = cells.agg(F.min("value"), F.max("value")).first()
    if high is None:
        return "unknown"
    if high < 25 and high - low < 25:
        return "logged"
    return "raw" if high > 100 else "unknown"
