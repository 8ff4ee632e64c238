"""Graphs over edges (a, b): cores, components, cliques, communities. Iteration is joins; kernels are per component."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Lineage cut that survives a lost executor: a reliable checkpoint in spark.checkpoint.dir (a temporary folder only where unset, on one machine)."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillon-"))
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges with a < b, loops dropped."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def kcore(edges: DataFrame, k: int, max_rounds: int = 1000) -> DataFrame:
    """Edges of the k-core: nodes of lower degree go until none is left to go."""
    e = _cut(undirected(edges))
    n = e.count()
    for _ in range(max_rounds):
        keep = degrees(e).filter(F.col("degree") >= k).select("node")
        e = _cut(e.join(keep, e["a"] == keep["node"], "left_semi").join(keep.withColumnRenamed("node", "node2"), F.col("b") == F.col("node2"), "left_semi"))
        m = e.count()
        if m == n:
            return e
        n = m
    raise RuntimeError("the core did not settle")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 200) -> DataFrame:
    """node, component (smallest node): minimum labels with pointer jumping, so that long chains take few rounds."""
    both = _cut(both_ways(undirected(edges)))
    label = _cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = label.join(near, "node").select("node", "component", F.least("component", "m").alias("m"))
        jump = step.join(step.select(F.col("node").alias("m"), F.col("m").alias("mm")), "m", "left")
        new = _cut(jump.select("node", "component", F.coalesce("mm", "m").alias("m")))
        changed = new.filter("component <> m").limit(1).count()
        label = new.select("node", F.col("m").alias("component"))
        if not changed:
            break
    else:
        raise RuntimeError("the components did not settle")
    if nodes is None:
        return label
    return nodes.select("node").distinct().join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c, all joined."""
    e = undirected(edges)
    x, y, z = (e.alias(n) for n in "xyz")
    return x.join(y, F.col("x.b") == F.col("y.a")).join(z, (F.col("x.a") == F.col("z.a")) & (F.col("y.b") == F.col("z.b"))).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))


# Kernels on one component -----------------------------------------------------------------------------


def adjacency(pairs) -> dict:
    adj: dict = defaultdict(set)
    for a, b in pairs:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def core_numbers(adj: dict) -> dict:
    """Core number of each node by peeling the smallest degree (ties by name)."""
    degree, left, core, k = {v: len(n) for v, n in adj.items()}, set(adj), {}, 0
    while left:
        v = min(left, key=lambda u: (degree[u], u))
        k = max(k, degree[v])
        core[v] = k
        left.remove(v)
        for u in adj[v] & left:
            degree[u] -= 1
    return core


class TooManyCliques(RuntimeError):
    """A caller's budget of cliques was exceeded: nothing is returned in place of all of them."""


def maximal_cliques(adj: dict, min_size: int = 3, budget: int | None = None) -> list[tuple]:
    """All maximal cliques of at least ``min_size``, in a fixed order: degeneracy order outside, pivots inside.
    More than ``budget`` of them, if one is given, are an error."""
    order = {v: i for i, (v, _) in enumerate(sorted(core_numbers(adj).items(), key=lambda x: (x[1], x[0])))}
    found: list[tuple] = []
    for v in sorted(adj, key=order.get):
        stack = [((v,), {u for u in adj[v] if order[u] > order[v]}, {u for u in adj[v] if order[u] < order[v]})]
        while stack:
            r, p, x = stack.pop()
            if not p and not x:
                if len(r) >= min_size:
                    found.append(tuple(sorted(r)))
                    if budget is not None and len(found) > budget:
                        raise TooManyCliques(f"more than {budget} cliques")
                continue
            if len(r) + len(p) < min_size:
                continue
            pivot = max(sorted(p | x), key=lambda u: len(adj[u] & p))
            for u in sorted(p - adj[pivot]):
                stack.append(((*r, u), p & adj[u], x & adj[u]))
                p = p - {u}
                x = x | {u}
    return sorted(found)


def greedy_clique(adj: dict, weight=None, restarts: int = 10) -> tuple:
    """A large clique: from the highest-degree starts, always the candidate that keeps most others; ties by mean weight, then name."""
    weight = weight or (lambda a, b: 0.0)
    best: tuple = ()
    for start in sorted(adj, key=lambda v: (-len(adj[v]), v))[:restarts]:
        clique, cand = [start], set(adj[start])
        while cand:
            v = max(sorted(cand), key=lambda u: (len(cand & adj[u]), sum(weight(u, c) for c in clique) / len(clique)))
            clique.append(v)
            cand &= adj[v]
        if len(clique) > len(best):
            best = tuple(sorted(clique))
    return best


def louvain(weights: dict, resolution: float = 1.0, seed: int = 0, max_levels: int = 20) -> dict:
    """node -> community by modularity moves on symmetric weights {(a, b): w}, nodes visited in a seeded order."""
    nodes = sorted({v for e in weights for v in e})
    member = {v: i for i, v in enumerate(nodes)}
    graph: dict = defaultdict(lambda: defaultdict(float))
    for (a, b), w in weights.items():
        graph[member[a]][member[b]] += w
        if a != b:
            graph[member[b]][member[a]] += w
    groups = {i: [v] for i, v in enumerate(nodes)}
    rng = np.random.default_rng(seed)
    for _ in range(max_levels):
        degree = {v: sum(n.values()) + n.get(v, 0.0) for v, n in graph.items()}
        total = sum(degree.values()) or 1.0
        com = {v: v for v in graph}
        tot = dict(degree)
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in rng.permutation(sorted(graph)).tolist():
                links: dict = defaultdict(float)
                for u, w in graph[v].items():
                    if u != v:
                        links[com[u]] += w
                tot[com[v]] -= degree[v]
                old = com[v]
                gain = lambda c: links.get(c, 0.0) - resolution * tot[c] * degree[v] / total  # noqa: B023, E731
                new = max(sorted(set(links) | {old}), key=lambda c: (gain(c), c == old))
                if gain(new) <= gain(old) + 1e-12:
                    new = old
                com[v] = new
                tot[new] += degree[v]
                if new != old:
                    moved = moved_any = True
        if not moved_any:
            break
        merged: dict = defaultdict(list)
        for v, c in com.items():
            merged[c] += groups[v]
        nxt: dict = defaultdict(lambda: defaultdict(float))
        for v, n in graph.items():
            for u, w in n.items():
                if com[v] != com[u]:
                    nxt[com[v]][com[u]] += w
                else:
                    nxt[com[v]][com[v]] += w if u == v else w / 2
        graph, groups = nxt, merged
        for c in groups:
            graph.setdefault(c, defaultdict(float))
    out = {}
    for i, c in enumerate(sorted(groups.values(), key=min)):
        out |= dict.fromkeys(c, i)
    return out


def modularity(weights: dict, community: dict, resolution: float = 1.0) -> float:
    total = sum(weights.values()) or 1.0
    inside, degree = defaultdict(float), defaultdict(float)
    for (a, b), w in weights.items():
        degree[community[a]] += w
        degree[community[b]] += w
        if community[a] == community[b]:
            inside[community[a]] += w
    return sum(inside[c] / total - resolution * (degree[c] / (2 * total)) ** 2 for c in degree)


def average_linkage(nodes: list, distance: np.ndarray, cut: float = 0.5) -> dict:
    """node -> cluster by average linkage, merged while the distance is at most ``cut``."""
    groups = [[i] for i in range(len(nodes))]
    while len(groups) > 1:
        d, i, j = min((distance[np.ix_(a, b)].mean(), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        if d > cut:
            break
        groups[i] += groups.pop(j)
    return {nodes[v]: c for c, g in enumerate(groups) for v in g}


# Grouped operators --------------------------------------------------------------------------------------


def maximum_cliques(edges: DataFrame, keys: list[str], restarts: int = 10) -> DataFrame:
    """keys, members, size: one large clique per key."""
    head = [f for f in edges.schema.fields if f.name in keys]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = {frozenset(p): abs(float(v)) for *p, v in zip(rows["a"], rows["b"], rows["r"])}
        best = greedy_clique(adjacency(zip(rows["a"], rows["b"])), lambda a, b: r.get(frozenset((a, b)), 0.0), restarts)
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, "members": list(best), "size": len(best)}])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in head), "members array<string>, size int"])
    return edges.groupBy(*keys).applyInPandas(run, schema)


def linkage_communities(edges: DataFrame, keys: list[str], cut: float = 0.5) -> DataFrame:
    """keys, node, community by average linkage of 1 - weight on edges (keys, a, b, weight): a table of distances between
    all nodes of a key, in its task. `communities.communities` is the way for large graphs."""
    head = [f for f in edges.schema.fields if f.name in keys]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*rows["a"], *rows["b"]})
        at = {v: i for i, v in enumerate(nodes)}
        d = np.ones((len(nodes), len(nodes)))
        for a, b, x in zip(rows["a"], rows["b"], rows["weight"]):
            d[at[a], at[b]] = d[at[b], at[a]] = 1 - float(x)
        out = pd.DataFrame(sorted(average_linkage(nodes, d, cut).items()), columns=["node", "community"])
        for i, k in enumerate(keys):
            out.insert(i, k, rows[k].iloc[0])
        return out

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in head), "node string, community int"])
    return edges.groupBy(*keys).applyInPandas(run, schema)


def complexity(edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, density and the largest degree of a graph."""
    d = degrees(undirected(edges)).agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.max("degree").alias("max_degree"))
    return d.withColumn("density", F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)))
