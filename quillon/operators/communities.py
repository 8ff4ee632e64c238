"""Communities of signed weighted graphs, many graphs (keys) in one run, as joins and aggregates.

Edges (keys, a, b, weight, sign) make two layers over the same nodes. A partition's quality is the sum over layers of
layer weight x (weight inside communities - what degrees alone would put there); the usual weights, 1 and -0.5, reward
positive edges inside and punish negative ones. A graph without negative edges has the plain modularity, one without
positive edges is partitioned by the negative layer alone.

Each level has three steps, and then the graph is contracted:

1. *Moves*: every node looks up the community of its neighbours that it would gain most by (or none: to be alone). Of
   all proposals those are taken that are the best one of both communities they touch. Their gains don't depend on each
   other, so the quality rises with every round. The first rounds of a fresh graph take more: all moves from communities
   of one half (drawn by a hash) to those of the other.
2. *Refinement*: within each community, nodes start alone again and join, under the same rule and only along an edge, so
   that what is contracted is connected.
3. *Contraction*: refined communities become nodes; where the moves have put them is the start of the next level.

At the end each community is split into its connected parts (edges of layers with a positive weight), and the whole is
run again from there (``repeats``). No graph is gathered in one task; a round is one job for all graphs, whose largest
table is that of the edges. Ties are broken by name, so results don't depend on partitioning.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import correlate, graph
from quillon.operators.resample import bootstrap_weights
from quillon.operators.store import forget, stored

LAYERS = (1.0, -0.5)
NODE = ("kp", "kn", "op", "on", "gp", "gn")
_fresh = itertools.count()


def symmetric(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, p, n: both directions of each edge, weights of its two signs summed; loops dropped."""
    sign = F.col("sign") if "sign" in edges.columns else F.lit("positive")
    w = edges.filter("a <> b and weight > 0").select(*keys, "a", "b", F.when(sign == "positive", F.col("weight")).otherwise(0.0).alias("p"), F.when(sign == "negative", F.col("weight")).otherwise(0.0).alias("n"))
    both = w.unionByName(w.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "p", "n"))
    return both.groupBy(*keys, "a", "b").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def layer_totals(g: DataFrame, keys: list[str], layers: tuple[float, float], resolution: float) -> DataFrame:
    """keys, tp, tn (twice the layer's weight), op, on (weights in the quality), gp, gn (factors of degree products)."""
    t = g.groupBy(*keys).agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    op, on = F.when(F.col("tp") > 0, layers[0]).otherwise(0.0), F.when(F.col("tp") > 0, layers[1]).otherwise(1.0)
    t = t.withColumns({"op": op, "on": F.when(F.col("tn") > 0, on).otherwise(0.0)})
    per = lambda o, s: F.coalesce(F.try_divide(F.col(o) * resolution, F.col(s)), F.lit(0.0))
    return t.withColumns({"gp": per("op", "tp"), "gn": per("on", "tn")})


def _step(g: DataFrame, nodes: DataFrame, keys: list[str], refine: bool, bulk: int | None) -> DataFrame:
    """``nodes`` (keys, node, c, NODE) after one round, with ``moved``."""
    own = nodes.select(*keys, F.col("node").alias("a"), F.col("c").alias("mine"), *NODE)
    sums = nodes.groupBy(*keys, "c").agg(F.sum("kp").alias("cp"), F.sum("kn").alias("cn"), F.count("*").alias("size"))
    at = nodes.select(*keys, F.col("node").alias("b"), "c")
    links = g.filter("a <> b").join(at, [*keys, "b"]).groupBy(*keys, "a", "c").agg(F.sum("p").alias("lp"), F.sum("n").alias("ln"))
    seen = links.unionByName(own.select(*keys, "a", F.col("mine").alias("c"), F.lit(0.0).alias("lp"), F.lit(0.0).alias("ln")))  # its own community counts, with links or without
    seen = seen.groupBy(*keys, "a", "c").agg(F.sum("lp").alias("lp"), F.sum("ln").alias("ln")).join(own, [*keys, "a"]).join(sums, [*keys, "c"])
    stays = F.col("c") == F.col("mine")
    less = lambda x: F.when(stays, F.col(x)).otherwise(0.0)
    value = F.col("op") * F.col("lp") + F.col("on") * F.col("ln") - F.col("gp") * F.col("kp") * (F.col("cp") - less("kp")) - F.col("gn") * F.col("kn") * (F.col("cn") - less("kn"))
    allowed = ~stays & ((F.col("op") * F.col("lp") > 0) | (F.col("on") * F.col("ln") > 0)) if refine else ~stays
    best = F.max(F.when(allowed, F.struct(F.round(value, 10).alias("value"), F.col("c").alias("to"))))
    one = seen.groupBy(*keys, "a").agg(F.first("mine").alias("mine"), F.max(F.when(stays, value)).alias("now"), F.max(F.when(stays, F.col("size"))).alias("size"), best.alias("best"))
    if refine:
        move = one.filter("size = 1").select(*keys, "a", "mine", "now", F.col("best.value").alias("value"), F.col("best.to").alias("to"))
    else:
        alone = F.struct(F.lit(0.0).alias("value"), F.concat(F.lit(f"~{next(_fresh)}~"), F.col("a")).alias("to"))
        choice = F.when(F.col("size") > 1, F.greatest("best", alone)).otherwise(F.col("best"))
        move = one.withColumn("best", choice).select(*keys, "a", "mine", "now", F.col("best.value").alias("value"), F.col("best.to").alias("to"))
    move = move.withColumn("gain", F.round(F.col("value") - F.col("now"), 9)).filter("gain > 1e-9")
    if bulk is not None:
        half = lambda c: F.pmod(F.xxhash64(F.lit(bulk), c), F.lit(2))
        taken = move.filter((half("mine") == 0) & (half("to") == 1)).select(*keys, F.col("a").alias("node"), "to")
    else:
        touched = move.select(*keys, F.explode(F.array("mine", "to")).alias("c"), F.struct("gain", "a", "to").alias("m"))
        firsts = touched.groupBy(*keys, "c").agg(F.max("m").alias("m"))
        taken = firsts.groupBy(*keys, F.col("m.a").alias("node"), F.col("m.to").alias("to")).agg(F.count("*").alias("_k")).filter("_k = 2").drop("_k")
    after = nodes.drop("moved").join(taken, [*keys, "node"], "left")
    return after.withColumn("moved", F.col("to").isNotNull()).withColumn("c", F.coalesce("to", "c")).drop("to")


def _moves(g: DataFrame, nodes: DataFrame, keys: list[str], refine: bool = False, bulk: int = 0, rounds: int = 200) -> DataFrame:
    """``nodes`` after rounds until none moves, or ``rounds`` (what is left is found at the next level or repeat)."""
    for i in range(rounds):
        new = stored(_step(g, nodes, keys, refine, i if i < bulk else None), "communities-nodes")
        forget(nodes)
        nodes = new
        if i >= bulk and nodes.filter("moved").isEmpty():
            break
    return nodes


def _split(g: DataFrame, member: DataFrame, keys: list[str]) -> DataFrame:
    """``member`` (keys, node, c) with c by connected part, along edges whose layer has a positive weight."""
    name = F.to_json(F.struct(*keys, F.lit(0).alias("_"))) if keys else F.lit("")
    ends = [member.select(*keys, F.col("node").alias(x), F.col("c").alias(f"c{x}"), "op", "on") for x in "ab"]
    inside = g.join(ends[0], [*keys, "a"]).join(ends[1].drop("op", "on"), [*keys, "b"]).filter("ca = cb and ((p > 0 and op > 0) or (n > 0 and on > 0))")
    parts = graph.connected_components(inside.select(F.concat_ws("\x1f", name, "a").alias("a"), F.concat_ws("\x1f", name, "b").alias("b")))
    part = member.withColumn("_id", F.concat_ws("\x1f", name, "node")).join(parts.withColumnRenamed("node", "_id"), "_id", "left")
    return part.select(*keys, "node", F.coalesce("component", "_id").alias("c"), "op", "on")


def communities(edges: DataFrame, keys: list[str] | None = None, layers: tuple[float, float] = LAYERS, resolution: float = 1.0, repeats: int = 2, bulk: int = 4) -> DataFrame:
    """keys, node, community (its smallest node) of edges (keys, a, b, weight and perhaps sign: positive or negative).

    Nodes without edges aren't there. Repeated edges add up; loops, null and non-positive weights are dropped."""
    keys = keys or []
    whole = stored(symmetric(edges, keys), "communities-edges")
    totals = stored(layer_totals(whole, keys, layers, resolution), "communities-totals")
    degree = whole.groupBy(*keys, F.col("a").alias("node")).agg(F.sum("p").alias("kp"), F.sum("n").alias("kn"))
    start = stored((degree.join(totals, keys) if keys else degree.crossJoin(F.broadcast(totals))).select(*keys, "node", *NODE), "communities-start")  # without keys: one row
    found = start.select(*keys, "node", F.col("node").alias("c"))
    for again in range(repeats):
        g, place = whole, start.select(*keys, "node", F.col("node").alias("at"))
        nodes = stored(start.join(found, [*keys, "node"]).withColumn("moved", F.lit(False)), "communities-nodes")
        for level in itertools.count():
            nodes = _moves(g, nodes, keys, bulk=bulk if level == again == 0 else 0)
            ends = [nodes.select(*keys, F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in "ab"]
            inside = stored(g.join(ends[0], [*keys, "a"]).join(ends[1], [*keys, "b"]).filter("ca = cb").drop("ca", "cb"), "communities-inside")
            fine = _moves(inside, stored(nodes.withColumn("c", F.col("node")), "communities-nodes"), keys, refine=True)
            parts = stored(fine.select(*keys, "node", F.col("c").alias("into")).join(nodes.select(*keys, "node", "c"), [*keys, "node"]), "communities-parts")
            forget(inside, fine)
            place = place.join(parts.select(*keys, F.col("node").alias("at"), "into", "c"), [*keys, "at"])
            if parts.filter("node <> into").isEmpty():
                break
            place = place.select(*keys, "node", F.col("into").alias("at"))
            a, b = (parts.select(*keys, F.col("node").alias(x), F.col("into").alias(f"i{x}")) for x in "ab")
            g = stored(g.join(a, [*keys, "a"]).join(b, [*keys, "b"]).groupBy(*keys, F.col("ia").alias("a"), F.col("ib").alias("b")).agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "communities-edges")
            merged = nodes.join(parts.select(*keys, "node", "into"), [*keys, "node"]).groupBy(*keys, F.col("into").alias("node"))
            firsts = [F.first(x).alias(x) for x in ("c", "op", "on", "gp", "gn")]
            nodes = stored(merged.agg(F.sum("kp").alias("kp"), F.sum("kn").alias("kn"), *firsts).withColumn("moved", F.lit(False)), "communities-nodes")
        member = start.join(place.select(*keys, "node", "c"), [*keys, "node"]).select(*keys, "node", "c", "op", "on")
        found = stored(_split(whole, member, keys).select(*keys, "node", "c"), "communities-found")
    return found.join(found.groupBy(*keys, "c").agg(F.min("node").alias("community")), [*keys, "c"]).select(*keys, "node", "community")


def quality(edges: DataFrame, member: DataFrame, keys: list[str] | None = None, layers: tuple[float, float] = LAYERS, resolution: float = 1.0) -> DataFrame:
    """keys, n_communities, quality (of both layers) and modularity (of the positive layer, or the only one) of a partition (keys, node, community)."""
    keys = keys or []
    g = symmetric(edges, keys)
    a, b = (member.select(*keys, F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in "ab")
    inside = lambda x: F.sum(F.when(F.col("ca") == F.col("cb"), F.col(x)).otherwise(0.0))
    own = g.join(a, [*keys, "a"]).join(b, [*keys, "b"]).groupBy(*keys, "ca").agg(F.sum("p").alias("kp"), F.sum("n").alias("kn"), inside("p").alias("ip"), inside("n").alias("in"))
    t = layer_totals(g, keys, layers, resolution)
    own = own.join(t, keys) if keys else own.crossJoin(F.broadcast(t))
    layer = lambda o, i, f, k: F.sum(F.col(o) * F.col(i) - F.col(f) * F.col(k) * F.col(k))

    def part(i: str, k: str, total: str) -> Column:
        return F.sum(F.try_divide(F.col(i), F.col(total)) - resolution * F.pow(F.try_divide(F.col(k), F.col(total)), F.lit(2.0)))

    return own.groupBy(*keys).agg(F.count("*").alias("n_communities"), (layer("op", "ip", "gp", "kp") + layer("on", "in", "gn", "kn")).alias("quality"), F.coalesce(part("ip", "kp", "tp"), part("in", "kn", "tn")).alias("modularity"))


def matched(original: DataFrame, found: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """keys, by, c0, c1, n, a, b: how many nodes of an original community (of size a) lie in each found one (of size b).

    ``original`` is (keys, node, c0), ``found`` (keys, by, node, c1) over the same nodes: a sparse table, no pairs of nodes."""
    n = found.join(original, [*keys, "node"]).groupBy(*keys, *by, "c0", "c1").agg(F.count("*").alias("n"))
    a = original.groupBy(*keys, "c0").agg(F.count("*").alias("a"))
    b = found.groupBy(*keys, *by, "c1").agg(F.count("*").alias("b"))
    return n.join(a, [*keys, "c0"]).join(b, [*keys, *by, "c1"])


def agreement(match: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rand: adjusted Rand index of each two partitions from their table of counts; 1 where both are trivial in the same way."""
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2
    per = match.groupBy(*keys).agg(F.sum(two("n")).alias("_ij"), F.sum("n").alias("_n"))
    rows = match.select(*keys, "c0", "a").distinct().groupBy(*keys).agg(F.sum(two("a")).alias("_i"))
    cols = match.select(*keys, "c1", "b").distinct().groupBy(*keys).agg(F.sum(two("b")).alias("_j"))
    chance = F.try_divide(F.col("_i") * F.col("_j"), two("_n"))
    rand = F.try_divide(F.col("_ij") - chance, (F.col("_i") + F.col("_j")) / 2 - chance)
    return per.join(rows, keys).join(cols, keys).select(*keys, F.coalesce(rand, F.lit(1.0)).alias("rand"))


def stability(original: DataFrame, found: DataFrame, keys: list[str], n: int, by: str = "iteration", least: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How far the communities ``original`` (keys, node, c0) come back in ``n`` partitions ``found`` (keys, by, node, c1).

    Of communities: size, stability (share of partitions with one whose Jaccard index is above ``least``) and mean_jaccard.
    Of nodes: mates, the mean share of a node's community that is still with it. Of partitions: rand, the adjusted Rand index."""
    match = stored(matched(original, found, keys, [by]), "communities-match")
    best = match.groupBy(*keys, by, "c0").agg(F.max(F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).alias("j"), F.first("a").alias("size"))
    groups = best.groupBy(*keys, F.col("c0").alias("community")).agg(F.first("size").alias("size"), (F.count_if(F.col("j") > least) / F.lit(n)).alias("stability"), (F.sum("j") / F.lit(n)).alias("mean_jaccard"))
    mates = original.join(found, [*keys, "node"]).join(match.select(*keys, by, "c0", "c1", "n", "a"), [*keys, by, "c0", "c1"])
    nodes = mates.groupBy(*keys, "node", F.col("c0").alias("community")).agg(F.avg(F.try_divide(F.col("n") - 1, F.col("a") - 1)).alias("mates"))
    return groups, nodes, agreement(match, [*keys, by])


def community_bootstrap(cells: DataFrame, condition: str, n: int = 100, power: float = 6.0, floor: float = 0.1, seed: int = 0, signed: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`stability` of the communities of co-varying features per condition over ``n`` bootstraps of the samples.

    All resamples are one run: the data as they are and each draw are graphs of their own, keyed by condition and draw.
    A feature without an edge is a community by itself. ``signed`` takes both layers, else the positive one alone."""
    drawn = bootstrap_weights(cells.select("sample_id", condition).distinct(), n, [condition], seed).withColumn("iteration", F.col("iteration") + 1)
    samples = cells.select("sample_id").distinct().withColumn("iteration", F.lit(0)).withColumn("times", F.lit(1).cast("long"))
    weights = drawn.select("iteration", "sample_id", "times").unionByName(samples.select("iteration", "sample_id", "times"))
    pairs = correlate.resampled_correlations(cells, weights, condition, floor ** (1 / power))
    e = pairs.select(condition, "iteration", "a", "b", F.pow(F.abs("r"), F.lit(power)).alias("weight"), F.when(F.col("r") > 0, "positive").otherwise("negative").alias("sign"))
    found = communities(e if signed else e.filter("sign = 'positive'"), [condition, "iteration"], repeats=1)
    every = cells.filter("value is not null").select(condition, F.col("feature_id").alias("node")).distinct().withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n))))
    whole = stored(every.join(found, [condition, "iteration", "node"], "left").select(condition, "iteration", "node", F.coalesce("community", "node").alias("c1")), "communities-resampled")
    return stability(whole.filter("iteration = 0").select(condition, "node", F.col("c1").alias("c0")), whole.filter("iteration > 0"), [condition], n)
