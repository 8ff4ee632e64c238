"""The driver's tables seen as cells, samples, edges and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_cells(spark: SparkSession, d: str) -> DataFrame:
    """64 dimensions x vectors, group label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "value"))
    return e.select(F.lpad(F.col("dim").cast("string"), 2, "0").alias("feature_id"), F.col("vec_id").cast("string").alias("sample_id"), F.col("value").cast("double").alias("value"), F.lit(0).alias("flag"), F.col("label").cast("string").alias("grp"))


EMB_SQL = """emb AS (SELECT lpad(CAST(d AS VARCHAR), 2, '0') AS feature_id, CAST(vec_id AS VARCHAR) AS sample_id,
  CAST(embedding[d + 1] AS DOUBLE) AS value, CAST(label AS VARCHAR) AS grp FROM embeddings, range(64) t(d))"""


def event_cells(spark: SparkSession, d: str) -> DataFrame:
    """Skewed values of event types, group user_id % 3; every 17th value is missing."""
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("feature_id"), F.col("event_id").cast("string").alias("sample_id"), F.col("value").cast("double").alias("value"), F.lit(0).alias("flag"), (F.col("user_id") % 3).cast("string").alias("grp"))


EVENT_SQL = """ev AS (SELECT event_type AS feature_id, CAST(event_id AS VARCHAR) AS sample_id, CAST(value AS DOUBLE) AS value,
  CAST(user_id % 3 AS VARCHAR) AS grp FROM events)"""


def user_cells(spark: SparkSession, d: str) -> DataFrame:
    """Mean value by event type and user; users whose id is a multiple of 7 miss the type of that rank."""
    e = table(spark, d, "events")
    c = e.groupBy("event_type", "user_id").agg(F.avg("value").alias("value"))
    gone = (F.col("user_id") % 7 == 0) & (F.length("event_type") % 2 == 0)
    return c.select(F.col("event_type").alias("feature_id"), F.lpad(F.col("user_id").cast("string"), 9, "0").alias("sample_id"), F.when(~gone, F.col("value")).alias("value"), F.lit(0).alias("flag"), (F.col("user_id") % 3).cast("string").alias("grp"))


USER_SQL = """us AS (SELECT event_type AS feature_id, lpad(CAST(user_id AS VARCHAR), 9, '0') AS sample_id,
  CASE WHEN user_id % 7 = 0 AND length(event_type) % 2 = 0 THEN NULL ELSE avg(value) END AS value, CAST(user_id % 3 AS VARCHAR) AS grp
  FROM events GROUP BY event_type, user_id)"""


def brand_cells(spark: SparkSession, d: str) -> DataFrame:
    """Mean price by brand and supplier; group is the supplier's region."""
    li, p, s, n = (table(spark, d, t) for t in ("lineitem", "part", "supplier", "nation"))
    sup = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").cast("string").alias("grp"))
    c = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.avg("l_extendedprice").alias("value"))
    return c.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("p_brand").alias("feature_id"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0").alias("sample_id"), "value", F.lit(0).alias("flag"), "grp")


BRAND_SQL = """br AS (SELECT p_brand AS feature_id, lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS sample_id, avg(l_extendedprice) AS value,
  CAST(min(n_regionkey) AS VARCHAR) AS grp FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey GROUP BY p_brand, l_suppkey)"""


def edge_table(spark: SparkSession, d: str) -> DataFrame:
    """supplier -> part; evidence counts lines, the relationship follows the return flag."""
    rel = F.when(F.col("l_returnflag") == "A", "activation").when(F.col("l_returnflag") == "R", "repression").otherwise("other")
    return table(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey")).alias("source"), F.concat(F.lit("P"), F.col("l_partkey")).alias("target"), rel.alias("relationship")).agg(F.count("*").alias("evidence_count"))


def edge_ends(spark: SparkSession, d: str) -> DataFrame:
    """source and target of the edges, for what needs neither evidence nor relationship; a pair may come more than once."""
    return table(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("source"), F.concat(F.lit("P"), F.col("l_partkey")).alias("target"))


EDGE_SQL = """ed AS (SELECT 'S' || l_suppkey AS source, 'P' || l_partkey AS target,
  CASE l_returnflag WHEN 'A' THEN 'activation' WHEN 'R' THEN 'repression' ELSE 'other' END AS relationship,
  count(*) AS evidence_count FROM lineitem GROUP BY ALL)"""


def part_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("set_id"), F.concat(F.lit("P"), F.col("p_partkey")).alias("feature_id"), F.lit(1.0).alias("weight"))


def doc_samples(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels where there are some: metadata with nulls."""
    docs, lab = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.select(F.col("doc_id").cast("string").alias("sample_id"), "doc_id", "lang", "source", "n_chars").join(lab, "doc_id", "left")


DOC_SQL = """sm AS (SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
