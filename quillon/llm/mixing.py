"""Mixing sources to target weights.

Sizes are words. Source totals are aggregated with partial sums; sources in code-point order (null
last) weigh 5, 2, 1 in turn and share ``share`` of all words; no target exceeds ``cap`` times its
source, the excess is reshared by weight among the rest until none is above. A document is emitted
floor(target / source size) times, plus once with the fraction as probability; the draw is a hash of
the seed and the id, so that reruns and other partitionings agree.

The driver sees per-source totals never as rows: only sums over the sources that are not yet capped.
Sources are ranked over range partitions with per-partition offsets, so any number of sources works.
The per-source rates come back to the documents by a broadcast join if at most ``broadcast_sources``
sources exist, else by a sort-merge join, which adaptive execution splits on a hot source.

Edge cases: null text has no words; a null source is a source of its own; a source without words has
target 0 and emits nothing; rows with the same id and source share a draw; an empty table gives an
empty result; further columns are kept by ``repeat_documents`` and ignored by ``mix_plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import WORD_GAP, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def n_words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), WORD_GAP, -1)
    blank = lambda at: (F.element_at(parts, at) == "").cast("long")  # noqa: E731  only the ends can be empty
    return F.greatest(F.size(parts) - blank(1) - blank(-1), F.lit(0).cast("long"))


def uniform(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) with 52 bits of a hash of the seed and the ids."""
    key = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(x.cast("string"), F.lit("null")) for x in ids))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def _ranked(sources: DataFrame) -> DataFrame:
    """``rank`` from 0 in code-point order, null last."""
    part = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    part = written(part, "mix-sources")
    sizes = {r["part"]: r["n"] for r in part.groupBy("part").agg(F.count("*").alias("n")).collect()}
    start, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, start))
        start += sizes[p]
    if not offsets:
        return part.select("source", "source_size", F.lit(0).cast("long").alias("rank"))
    first = F.broadcast(sources.sparkSession.createDataFrame(offsets, "part int, first long"))
    w = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return part.join(first, "part").select("source", "source_size", (F.col("first") + F.row_number().over(w) - 1).alias("rank"))


def source_targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of ``sized`` (source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = F.array(*map(F.lit, weights))
    s = written(_ranked(sources).withColumn("weight", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int"))), "mix-weights")
    most = cap * F.col("source_size")
    total = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # each round caps at least one more source; sums only
        above = most < level * F.col("weight")
        row = s.agg(F.sum(F.when(above, most)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("w"), F.count(F.when(above, 1)).alias("n")).first()
        if not row["w"] or row["n"] == capped:
            break
        capped, level = row["n"], (total - (row["held"] or 0.0)) / row["w"]
    return s.select("source", "source_size", F.least(most, level * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 7, broadcast_sources: int = 10_000) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies."""
    sized = docs.withColumn("size", n_words(F.col("text")))
    targets = source_targets(sized.select("source", "size"), share, cap).withColumnRenamed("source", "of_source")
    targets = written(targets, "mix-targets")
    if targets.count() <= broadcast_sources:
        targets = F.broadcast(targets)
    j = sized.join(targets, sized["source"].eqNullSafe(targets["of_source"]), "left").drop("of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    j = j.withColumn("rate", rate)
    extra = uniform(seed, F.col("source"), F.col("doc_id")) < F.col("rate") - F.floor("rate")
    return j.withColumn("copies", F.floor("rate") + extra.cast("long"))


def mixed_sizes(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    p = mix_plan(docs.select("doc_id", "text", "source"), **how)
    return p.select("doc_id", "size", "source_size", F.col("target"), (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as its plan says, with the columns of ``docs``, whatever their names."""
    p = mix_plan(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row")), **how).filter("copies > 0")
    return p.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
