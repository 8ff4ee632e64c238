"""Declarative scan formats: presets, sniffing, id and sample-field extraction."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens that mean a missing number.
NA_TOKENS = ("", "NA", "NaN", "nan", "N/A", "null", "NULL", "None")


@dataclass(frozen=True)
class Format:
    """How a delimited matrix is read. Patterns use the named group ``id`` and any sample fields."""

    name: str
    delimiter: str | None = None
    id_pattern: str | None = None
    drop_columns: tuple[str, ...] = ()
    drop_pattern: str | None = None
    sample_pattern: str | None = None
    na_values: tuple[str, ...] = NA_TOKENS
    skip_rows: int = 0
    omic: str = "unknown"
    namespace: str = "unknown"
    encoding: str = "UTF-8"
    extra: dict = field(default_factory=dict, compare=False)

    def drops(self, column: str) -> bool:
        return column in self.drop_columns or bool(self.drop_pattern and re.search(self.drop_pattern, column))

    def id_column(self, raw: Column) -> Column:
        """The extracted id, or the trimmed raw one."""
        return extract_group(raw, self.id_pattern, "id") if self.id_pattern else F.trim(raw)

    def sample_columns(self, sample_id: Column) -> list[Column]:
        if not self.sample_pattern:
            return []
        names = re.compile(self.sample_pattern).groupindex
        return [F.nullif(F.regexp_extract(sample_id, java_pattern(self.sample_pattern), i), F.lit("")).alias(n) for n, i in names.items()]


def java_pattern(pattern: str) -> str:
    """Named groups in Java's spelling."""
    return pattern.replace("(?P<", "(?<")


def extract_group(raw: Column, pattern: str, group: str) -> Column:
    i = re.compile(pattern).groupindex[group]
    return F.coalesce(F.nullif(F.regexp_extract(raw, java_pattern(pattern), i), F.lit("")), F.trim(raw))


_CASE = r"^(?P<phenotype>CASE|CTRL|case|ctrl|Case|Ctrl)[-_]"

#: Presets and their patterns.
PRESETS = {
    "ensembl_csv": Format("ensembl_csv", ",", sample_pattern=_CASE, omic="transcriptomic", namespace="ensembl_gene"),
    "gene_symbol_csv": Format("gene_symbol_csv", ",", sample_pattern=_CASE, omic="transcriptomic", namespace="gene_symbol"),
    "answerals_proteomics": Format("answerals_proteomics", "\t", r"\d+/[a-z]+\|(?P<id>[A-Z0-9]+)\|[A-Z0-9]+_[A-Z]+$", ("nFragment", "nPeptide"), sample_pattern=r"^(?P<phenotype>CASE|CTRL)_", omic="proteomic", namespace="uniprot"),
    "uniprot_tsv": Format("uniprot_tsv", "\t", r"(?:sp|tr)\|[A-Z0-9]+\|(?P<id>[A-Z0-9]+)_[A-Z]+", omic="proteomic", namespace="gene_symbol"),
    "maxquant": Format("maxquant", "\t", r"^(?P<id>[A-Za-z0-9]+)(?:;|$)", drop_pattern=r"^(Reverse|Potential contaminant|Only identified by site)", omic="proteomic", namespace="gene_symbol"),
    "hmdb_csv": Format("hmdb_csv", ",", omic="metabolomic", namespace="hmdb"),
    "generic_tsv": Format("generic_tsv", "\t"),
    "generic_csv": Format("generic_csv", ","),
}

#: Id types by pattern, the first that 90 % of the ids match.
ID_TYPES = (
    ("ensembl_gene", r"^ENS[A-Z]*G\d{11}(\.\d+)?$"),
    ("ensembl_transcript", r"^ENS[A-Z]*T\d{11}(\.\d+)?$"),
    ("ensembl_protein", r"^ENS[A-Z]*P\d{11}(\.\d+)?$"),
    ("refseq", r"^[NX][MRP]_\d+(\.\d+)?$"),
    ("uniprot", r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"),
    ("entrez", r"^\d+$"),
    ("symbol", r"^[A-Za-z][A-Za-z0-9._-]*$"),
)


def head_text(spark: SparkSession, path: str, n: int = 8192) -> str:
    """The first characters of a file in any store that Spark reads."""
    rows = spark.read.text(path).head(64)
    return "\n".join(r[0] for r in rows)[:n]


def sniff_delimiter(text: str) -> str:
    """The csv module's guess among tab, comma and semicolon, else the most frequent of them on the first line."""
    try:
        return csv.Sniffer().sniff(text, delimiters="\t,;").delimiter
    except csv.Error:
        first = text.split("\n", 1)[0]
        return max("\t,;", key=first.count)


def suggest_format(text: str) -> Format:
    """A preset from the first data row's id."""
    lines, delimiter = text.split("\n"), sniff_delimiter(text)
    first = lines[1].split(delimiter)[0] if len(lines) > 1 else ""
    if re.match(r"\d+/[a-z]+\|", first) or "iRT" in first:
        return PRESETS["answerals_proteomics"]
    if re.match(r"(?:sp|tr)\|", first):
        return PRESETS["uniprot_tsv"]
    if first.startswith("ENS"):
        return PRESETS["ensembl_csv"]
    if first.startswith("HMDB"):
        return PRESETS["hmdb_csv"]
    return PRESETS["generic_tsv" if delimiter == "\t" else "generic_csv"]


def detect_id_type(ids: DataFrame, column: str = "feature_id", sample: int = 100, share: float = 0.9) -> str:
    """One aggregate over a bounded sample of ids."""
    row = ids.select(column).limit(sample).agg(*(F.avg(F.col(column).rlike(p).cast("double")).alias(n) for n, p in ID_TYPES)).first()
    return next((n for n, _ in ID_TYPES if (row[n] or 0) >= share), "unknown")
