"""Helpers shared by the corpus operators: the shared folder, written tables and a byte store.

Everything that must outlive an executor goes below the folder that the session names in
``spark.checkpoint.dir``; a temporary folder is used only where that setting is absent on one machine (tests),
and it is an error that it is absent on a cluster. Results are lazy and may read stored tables, so these stay until
the folder's owner clears it; tables that a finished step alone has read are deleted by the step.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as all word-based operators define it: a maximal run of bytes that are not ASCII blanks.
WORD_GAP = r"[\x20\x09-\x0D]+"


@functools.cache
def _fallback_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quillon-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the cluster's shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or _fallback_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(table: DataFrame, rows: int = 200_000) -> DataFrame:
    """A stored table of small rows, marked for broadcast if it has at most ``rows``; beyond that the join shuffles."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        for root in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text as UTF-8 bytes."""
    return (text or "").encode().lower().split()


class ByteStore:
    """Files of the shared folder for executors: write once, read ranges. The root is a URI."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.root = root
        self.fs, self.base = fs.FileSystem.from_uri(root if "://" in root else root.replace("file:/", "file:///"))

    def create(self) -> None:
        self.fs.create_dir(self.base, recursive=True)

    def put(self, name: str, data: bytes) -> None:
        """One file in one go. Names hold an attempt's own token, so a lost attempt leaves only an unreferenced file."""
        self.create()
        with self.fs.open_output_stream(f"{self.base}/{name}") as out:
            out.write(data)

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.base}/{name}")


def read_at(handle, offset: int, length: int) -> bytes:
    """Exactly this range of an open file."""
    handle.seek(offset)
    data = handle.read(length)
    if len(data) != length:
        raise EOFError(f"range {offset}+{length} is outside the file")
    return data
