"""Stored tables: the cut of a lineage that survives lost executors, in the folder all machines share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quillon-")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below spark.checkpoint.dir; a temporary one only where that is unset, on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or _local()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet and read again. Its files have sizes, so that joins with small ones are broadcast by Spark's own limit."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for root in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fingerprint(df: DataFrame) -> list[str]:
    """Of the rows whatever their order: count, exclusive or and sum of their hashes. No row leaves its place."""
    h = F.xxhash64(*sorted(df.columns))
    row = df.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return [*sorted(df.columns), *map(str, row)]
