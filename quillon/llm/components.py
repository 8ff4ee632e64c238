"""Connected components of a link table, without gathering it anywhere.

Tasks first reduce their own links to a spanning forest, in as many trees as a bound of nodes allows, and as long as
a task can hold all that is left this is repeated with fewer tasks (``local_links``). What is too large for that
goes through alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014) until the forest is a set of stars. Neighbourhood minima are partial aggregates; hubs get theirs by a
broadcast of checked size, so that no node's neighbours meet in one task. Each round is stored in the shared folder.

Edge cases: links to oneself and links with a null end connect nothing; repeated and reversed links count once;
without links the result is empty; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import release, written

#: A node with more links than this is a hub.
HUB_LINKS = 500


def forest(links: DataFrame, most_nodes: int = 2_000_000) -> DataFrame:
    """Links (u, v) that connect the same nodes within each partition, each node to its tree's smallest; trees are
    given out and begun anew when a partition has seen ``most_nodes`` nodes."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def out():
            pairs = [(x, find(x)) for x in list(parent)]
            pairs = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, c = find(u), find(v)
                if a != c:
                    parent[max(a, c)] = min(a, c)
            if len(parent) > most_nodes:
                yield out()
                parent.clear()
        yield out()

    clean = links.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).filter("u <> v")
    return clean.mapInArrow(run, "u bigint, v bigint")


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(rows: DataFrame, least: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """rows with the ``m`` of their u."""
    if hubs is None:
        return rows.join(least.select("u", "m"), "u")
    return rows.join(F.broadcast(hubs), "u").unionByName(rows.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.select("u", "m"), "u"))


def _star(links: DataFrame, large: bool, most_hubs: int = 100_000) -> DataFrame:
    """Large star: neighbours above a node to its neighbourhood's minimum; small star: the node and those below it."""
    around = _both(links) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "cc")
    hubs = least.filter(F.col("n") > HUB_LINKS).select("u", "m")
    found = hubs.limit(most_hubs + 1).count()
    hubs = hubs if 0 < found <= most_hubs else None  # with more of them the join shuffles, and is split where it is uneven
    if large:
        moved = _with_least(around.filter("v > u"), least, hubs).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = _with_least(around, least, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    stars = written(moved.filter("u <> v").distinct(), "cc")
    release(links.sparkSession, least)
    return stars


def components(links: DataFrame, max_rounds: int = 60, local_links: int = 1_000_000) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link in ``links`` (u, v)."""
    spark = links.sparkSession
    e = written(forest(links), "cc")
    n = e.count()
    if n <= local_links:
        whole = written(forest(e.coalesce(1), local_links * 2 + 1), "cc")
        release(spark, e)
        e = whole
    else:
        before = None
        for _ in range(max_rounds):
            once = _star(e, large=True)
            twice = _star(once, large=False)
            release(spark, e, once)
            e = twice
            # a set of stars: no node is both above and below; sums tell whether a round changed anything
            now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
            if before is not None and tuple(now) == before:
                break
            before = tuple(now)
        else:
            raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
