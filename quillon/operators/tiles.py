"""A store of feature correlations by tiles: only what changed is computed, only what is asked for is read.

Features belong to blocks; a feature keeps its block, new ones get blocks of their own. A tile is the pairs of two
blocks and is stored under a key of the contents of both, so that a changed block costs its row of tiles and an added
one too, and nothing else. Tiles are partitions of one Parquet table (i, j, key): what is there is seen in the listing, and a
read of some features is pruned to the tiles of their blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.correlate import correlation
from quillon.operators.store import stored

TILE_SCHEMA = "i int, j int, key string, a string, b string, r double, n double"


SUMS = ("w", "sx", "sy", "sxy", "sxx", "syy")


def _product(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
    """a, b and their weighted sums, of two blocks of packed, centred rows over the samples of a part that both features have."""
    at = {s: k for k, s in enumerate({s for side in (left, right) for ss in side["samples"] for s in ss})}

    def dense(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
        rows = rows.sort_values("feature_id")
        x, u = np.zeros((len(rows), len(at))), np.zeros((len(rows), len(at)))
        for k, (ss, vs, us) in enumerate(zip(rows["samples"], rows["values"], rows["roots"])):
            where = [at[s] for s in ss]
            x[k, where], u[k, where] = vs, us
        return x, u, rows["feature_id"].tolist()

    (x, u, ids), (y, v, others) = dense(left), dense(right)
    sums = (u @ v.T, (u * x) @ v.T, u @ (v * y).T, (u * x) @ (v * y).T, (u * x * x) @ v.T, u @ (v * y * y).T)
    p, q = np.nonzero(np.triu(np.ones_like(sums[0], bool), 1) if same else np.ones_like(sums[0], bool))
    a, b = np.array(ids, object)[p], np.array(others, object)[q]
    return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), **{k: m[p, q] for k, m in zip(SUMS, sums)}})


class CorrelationTiles:
    """Tiles below ``root`` of cells (feature_id, sample_id, value and perhaps weight: then a pair's weight is the geometric mean of its two).

    The samples of a tile are dealt to parts of about ``most`` cells of a block; the parts' sums are added by pair."""

    def __init__(self, spark: SparkSession, root: str, block: int = 512, most: int = 1 << 19):
        self.spark, self.root, self.block, self.most = spark, root.rstrip("/"), block, max(most, 8 * block * block)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self, name: str) -> str | None:
        """The newest complete version of a small table: versions are numbered, and whole once they have _SUCCESS."""
        fs, top = self._fs(), self._path(name)
        if not fs.exists(top):
            return None
        done = sorted(s.getPath().getName() for s in fs.listStatus(top) if fs.exists(self._path(f"{name}/{s.getPath().getName()}/_SUCCESS")))
        return f"{self.root}/{name}/{done[-1]}" if done else None

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self._version(name)
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def _put(self, df: DataFrame, name: str) -> None:
        last = self._version(name)
        number = int(last.rsplit("/", 1)[1].split("-")[0]) + 1 if last else 0
        df.write.parquet(f"{self.root}/{name}/{number:012d}-{uuid.uuid4().hex[:8]}")

    def update(self, cells: DataFrame) -> int:
        """Bring the store up to ``cells``; returns how many tiles were computed."""
        have = cells.filter("value is not null")
        members = self._table("members", "feature_id string, block int")
        new = have.select("feature_id").distinct().join(members, "feature_id", "left_anti")
        n, first = new.count(), (members.agg(F.max("block")).first()[0] or 0) + (0 if members.isEmpty() else 1)
        if n:
            fresh = max(1, -(-n // self.block))
            self._put(members.unionByName(new.withColumn("block", (F.pmod(F.xxhash64("feature_id"), F.lit(fresh)) + first).cast("int"))), "members")
            members = self._table("members", "feature_id string, block int")
        root = F.sqrt("weight") if "weight" in cells.columns else F.lit(1.0)
        rows = have.join(members, "feature_id").select("feature_id", "sample_id", "value", "block", root.alias("root")).filter("root > 0")
        h = F.xxhash64("feature_id", "sample_id", "value", "root")
        keys = rows.groupBy("block").agg(F.sha2(F.concat_ws(":", F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))), 256).alias("k"))
        i, j = (keys.select(F.col("block").alias(x), F.col("k").alias(f"k{x}")) for x in "ij")
        self._put(i.join(j, F.col("i") <= F.col("j")).select("i", "j", F.substring(F.sha2(F.concat("ki", "kj"), 256), 1, 24).alias("key")), "current")  # a row a tile
        current = self._table("current", "i int, j int, key string")
        there = self._tiles().select("i", "j", "key").distinct()
        missing = current.join(there, ["i", "j", "key"], "left_anti")
        count = missing.count()
        if not count:
            return 0
        features = stored(rows.groupBy("block", "feature_id").agg(F.avg("value").alias("_m"), F.count("*").alias("_n")), "tile-features")
        parts = -(-features.groupBy("block").agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] // self.most)
        part = F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("int")
        centred = rows.join(features.select("feature_id", "_m"), "feature_id").withColumn("value", F.col("value") - F.col("_m")).withColumn("part", part)
        packed = centred.groupBy("block", "part", "feature_id").agg(*(F.collect_list(c).alias(f"{c.removesuffix('_id')}s") for c in ("sample_id", "value", "root")))
        by = ["i", "j", "key"]
        side = lambda df, x: df.join(missing.withColumnRenamed(x, "block"), "block").withColumn(x, F.col("block"))
        sides = [side(packed, x).select(*(F.col(c).alias(c) for c in (*by, "part", "feature_id", "samples", "values", "roots"))) for x in "ij"]

        def tile(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return _product(left, right, key[0] == key[1]).assign(i=key[0], j=key[1], key=key[2])[[*by, "a", "b", *SUMS]]

        deal = [*by, "part"]
        made = sides[0].groupBy(*deal).cogroup(sides[1].groupBy(*deal)).applyInPandas(tile, "i int, j int, key string, a string, b string, " + ", ".join(f"{k} double" for k in SUMS))
        # pairs without a part in common, and a tile without pairs, are there, too
        left, right = (side(features, x).select(*(F.col(c).alias(c) for c in by), F.col("feature_id").alias(f"_{x}")) for x in "ij")
        every = left.join(right, by).filter("i < j or _i < _j").select(*by, F.least("_i", "_j").alias("a"), F.greatest("_i", "_j").alias("b"))
        every = every.unionByName(missing.select(*by, *(F.lit(None).cast("string").alias(x) for x in "ab"))).select("*", *(F.lit(0.0).alias(k) for k in SUMS))
        g = made.unionByName(every).groupBy(*by, "a", "b").agg(*(F.sum(k).alias(k) for k in SUMS))
        g.select(*by, "a", "b", correlation(*map(F.col, SUMS)).alias("r"), F.col("w").alias("n")).repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.root}/tiles")
        return count

    def _tiles(self) -> DataFrame:
        if not self._fs().exists(self._path("tiles")):
            return self.spark.createDataFrame([], TILE_SCHEMA)
        return self.spark.read.schema(TILE_SCHEMA).parquet(f"{self.root}/tiles")

    def read(self, features: DataFrame | None = None) -> DataFrame:
        """a, b, r, n of all pairs of the last update, or of those with a feature of ``features`` (feature_id): from its blocks' tiles alone."""
        current = self._table("current", "i int, j int, key string")
        if features is not None:
            own = [r["block"] for r in features.join(self._table("members", "feature_id string, block int"), "feature_id").select("block").distinct().collect()]
            current = current.filter(F.col("i").isin(own) | F.col("j").isin(own))
        found = self._tiles().join(current, ["i", "j", "key"], "left_semi").filter("a is not null").select("a", "b", F.nanvl("r", F.lit(None).cast("double")).alias("r"), "n")
        if features is None:
            return found
        f = features.select("feature_id").distinct()
        hit = [found.join(f.withColumnRenamed("feature_id", x), x, "left_semi") for x in "ab"]
        return hit[0].unionByName(hit[1]).distinct()
