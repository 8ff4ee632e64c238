"""All maximal cliques, with the work dealt out by seeds.

The nodes are put in order by peeling: all nodes of at most twice the mean degree of what is left go at once, so that a
few rounds suffice and a node has few neighbours after it (at most a small multiple of the graph's degeneracy). A seed's
unit of work is then: the edges among its later neighbours, and which earlier neighbours are joined to these (a clique
that one of them extends isn't maximal). Units come from the triangles, two rows each, so they are as many as the
triangles; their estimated cost is the number of their edges. Units above ``unit_edges`` are cut by their second member.
A task takes one unit: its size is limited by the order, not by the size of the graph, its hubs or the number of keys.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.store import forget, stored


class TooManyCliques(RuntimeError):
    """A caller's budget of cliques was exceeded: nothing is returned in place of all of them."""


def peeling_order(edges: DataFrame, keys: list[str] | None = None, factor: float = 2.0) -> DataFrame:
    """keys, node, round of edges (keys, a, b), a < b, distinct. Rounds are few: each takes a share of what is left."""
    keys = keys or []
    left = stored(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))), "cliques-left")
    done, number = None, 0
    while True:
        degree = left.groupBy(*keys, "a").agg(F.count("*").alias("d"))
        mean = degree.groupBy(*keys).agg(F.avg("d").alias("m"))
        mean = degree.join(mean, keys) if keys else degree.crossJoin(F.broadcast(mean))  # without keys: one row
        gone = stored(mean.filter(F.col("d") <= factor * F.col("m")).select(*keys, F.col("a").alias("node"), F.lit(number).alias("round")), "cliques-gone")
        if gone.isEmpty():
            break
        done = gone if done is None else done.unionByName(gone)
        a, b = (gone.select(*keys, F.col("node").alias(x)) for x in "ab")
        ends = left.join(b, [*keys, "b"], "left_semi").select(*keys, "a").distinct()  # who is left without any edge goes now, too
        rest = stored(left.join(a, [*keys, "a"], "left_anti").join(b, [*keys, "b"], "left_anti"), "cliques-left")
        bare = ends.join(a, [*keys, "a"], "left_anti").join(rest, [*keys, "a"], "left_anti").select(*keys, F.col("a").alias("node"), F.lit(number + 1).alias("round"))
        done = done.unionByName(stored(bare, "cliques-bare"))
        forget(left)
        left, number = rest, number + 2
    return done if done is not None else edges.select(*keys, F.col("a").alias("node"), F.lit(0).alias("round")).limit(0)


def _units(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, prefix, kind, a, b, r of every seed: kind 0 an edge among seed and later neighbours, 1 an earlier neighbour's (a) edge to a later one (b)."""
    order = peeling_order(edges, keys)
    at = [order.select(*keys, F.col("node").alias(x), F.col("round").alias(f"r{x}")) for x in "ab"]
    e = edges.join(at[0], [*keys, "a"]).join(at[1], [*keys, "b"])
    before = lambda r1, x, r2, y: (F.col(r1) < F.col(r2)) | ((F.col(r1) == F.col(r2)) & (F.col(x) < F.col(y)))
    first = before("ra", "a", "rb", "b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    e = stored(e.select(*keys, pick("a", "b").alias("u"), pick("ra", "rb").alias("ru"), pick("b", "a").alias("v"), pick("rb", "ra").alias("rv"), "r"), "cliques-ordered")
    x = e.select(*keys, "u", "v", "rv", F.col("r").alias("r1"))
    y = e.select(*keys, "u", F.col("v").alias("w"), F.col("rv").alias("rw"), F.col("r").alias("r2"))
    z = e.select(*keys, F.col("u").alias("v"), F.col("v").alias("w"), F.col("r").alias("r3"))
    tri = stored(x.join(y, [*keys, "u"]).filter(before("rv", "v", "rw", "w")).join(z, [*keys, "v", "w"]).select(*keys, "u", "v", "w", "r1", "r2", "r3"), "cliques-triangles")
    inner = tri.select(*keys, F.array("u").alias("prefix"), F.lit(0).alias("kind"), F.col("v").alias("a"), F.col("w").alias("b"), F.col("r3").alias("r"))
    spokes = tri.select(*keys, "u", F.explode(F.array(F.struct(F.col("v").alias("b"), F.col("r1").alias("r")), F.struct(F.col("w").alias("b"), F.col("r2").alias("r")))).alias("s"))
    spokes = spokes.groupBy(*keys, "u", F.col("s.b").alias("b")).agg(F.first("s.r").alias("r")).select(*keys, F.array("u").alias("prefix"), F.lit(0).alias("kind"), F.col("u").alias("a"), "b", "r")
    earlier = tri.select(*keys, F.array("v").alias("prefix"), F.lit(1).alias("kind"), F.col("u").alias("a"), F.col("w").alias("b"), F.lit(None).cast("double").alias("r"))
    return inner.unionByName(spokes).unionByName(earlier)


def _cut(units: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    """Units of the heavy seeds' second members: the same rows, seen from the seed and each of its later neighbours in the order of names."""
    h = stored(units.join(heavy, [*keys, "prefix"], "left_semi"), "cliques-heavy")
    seed = F.col("prefix")[0]
    inner = h.filter((F.col("kind") == 0) & (F.col("a") != seed)).select(*keys, "prefix", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "r")
    spoke = h.filter((F.col("kind") == 0) & (F.col("a") == seed)).select(*keys, "prefix", "b", "r")
    both = inner.select(*keys, "prefix", F.col("a").alias("p"), F.col("b").alias("q"), "r").unionByName(inner.select(*keys, "prefix", F.col("b").alias("p"), F.col("a").alias("q"), "r"))
    grown = F.array(seed, F.col("p")).alias("prefix")
    x = both.select(*keys, "prefix", "p", F.col("q").alias("a"))
    y = both.select(*keys, "prefix", "p", F.col("q").alias("b"))
    three = x.join(y, [*keys, "prefix", "p"]).join(inner, [*keys, "prefix", "a", "b"])  # a < b, both joined to p, and to each other
    edge = three.filter("a > p").select(*keys, grown, F.lit(0).alias("kind"), "a", "b", "r")
    own = spoke.select(*keys, "prefix", F.col("b").alias("p"), "r")
    base = own.select(*keys, grown, F.lit(0).alias("kind"), seed.alias("a"), F.col("p").alias("b"), "r")
    later = both.filter("q > p")
    to_second = later.select(*keys, grown, F.lit(0).alias("kind"), F.col("p").alias("a"), F.col("q").alias("b"), "r")
    to_seed = later.drop("r").join(spoke.select(*keys, "prefix", F.col("b").alias("q"), "r"), [*keys, "prefix", "q"]).select(*keys, grown, F.lit(0).alias("kind"), seed.alias("a"), F.col("q").alias("b"), "r")
    none = F.lit(None).cast("double").alias("r")
    sibling = three.select(*keys, "prefix", "p", "a", "b").filter("a < p and b > p").select(*keys, grown, F.lit(1).alias("kind"), "a", "b", none)
    out = h.filter("kind = 1").select(*keys, "prefix", F.col("a").alias("o"), F.col("b").alias("p"))
    far = out.join(out.withColumnRenamed("p", "b"), [*keys, "prefix", "o"]).join(later.select(*keys, "prefix", "p", F.col("q").alias("b")), [*keys, "prefix", "p", "b"])
    outer = far.select(*keys, grown, F.lit(1).alias("kind"), F.col("o").alias("a"), "b", none)
    alone = out.select(*keys, grown, F.lit(1).alias("kind"), F.col("o").alias("a"), F.col("p").alias("b"), none)
    before = inner.select(*keys, "prefix", F.col("a").alias("o"), F.col("b").alias("p")).select(*keys, grown, F.lit(1).alias("kind"), F.col("o").alias("a"), F.col("p").alias("b"), none)
    parts = (edge, base, to_second, to_seed, sibling, outer, alone, before)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def unit_cliques(prefix: tuple, edges: dict, outside: dict, min_size: int, budget: int | None = None) -> list[tuple]:
    """Maximal cliques with ``prefix`` in a unit: ``edges`` {(a, b): r}, ``outside`` {earlier node: nodes of the unit it is joined to}."""
    joined: dict = {}
    for a, b in edges:
        joined.setdefault(a, set()).add(b)
        joined.setdefault(b, set()).add(a)
    own = set(prefix)
    pool = set.intersection(*(joined.get(p, set()) for p in prefix)) - own
    found: list[tuple] = []
    stack = [(tuple(prefix), pool, {x: n & pool for x, n in outside.items()}, set())]
    while stack:
        members, may, beyond, past = stack.pop()
        if not may:
            if not past and not beyond and len(members) >= min_size:
                found.append(tuple(sorted(members)))
                if budget is not None and len(found) > budget:
                    raise TooManyCliques(f"more than {budget} cliques")
            continue
        if len(members) + len(may) < min_size:
            continue
        cover = max((joined[u] & may for u in sorted(may | past)), key=len, default=set())
        cover = max([cover, *(n & may for n in beyond.values())], key=len)
        for u in sorted(may - cover):
            stack.append(((*members, u), may & joined[u], {x: n for x, n in beyond.items() if u in n}, past & joined[u]))
            may, past = may - {u}, past | {u}
    return found


def find_cliques(edges: DataFrame, keys: list[str] | None = None, min_size: int = 3, budget: int | None = None, unit_edges: int = 20_000) -> DataFrame:
    """keys, members, size, mean_r, min_abs_r: all maximal cliques of at least ``min_size`` (2 or more) of edges (keys, a, b, r).

    Loops and repeats of an edge are dropped (the least r stays). More than ``budget`` cliques of a unit, if one is given, fail the job."""
    keys = keys or []
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    e = stored(edges.filter("a <> b").groupBy(*keys, lo.alias("a"), hi.alias("b")).agg(F.min("r").cast("double").alias("r")), "cliques-edges")
    units = stored(_units(e, keys), "cliques-units")
    heavy = units.groupBy(*keys, "prefix").agg(F.count("*").alias("_n")).filter(F.col("_n") > unit_edges).drop("_n")
    heavy = stored(heavy, "cliques-heavy-seeds")
    if not heavy.isEmpty():
        units = units.join(heavy, [*keys, "prefix"], "left_anti").unionByName(_cut(units, heavy, keys))
    head = [f for f in edges.schema.fields if f.name in keys]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        prefix = tuple(rows["prefix"].iloc[0])
        inside = rows["kind"] == 0
        r = {(min(a, b), max(a, b)): float(v) for a, b, v in zip(rows["a"][inside], rows["b"][inside], rows["r"][inside])}
        outside: dict = {}
        for a, b in zip(rows["a"][~inside], rows["b"][~inside]):
            outside.setdefault(a, set()).add(b)
        # an earlier node counts where it is joined to the whole prefix: to a second member by a row of its own
        outside = {x: n for x, n in outside.items() if all(p in n for p in prefix[1:])}
        found = unit_cliques(prefix, r, outside, max(3, min_size), budget)
        out = [(list(c), len(c), v) for c in found for v in [[r[p] for p in ((c[i], c[j]) for i in range(len(c)) for j in range(i + 1, len(c)))]]]
        d = pd.DataFrame([(c, n, sum(v) / len(v), min(map(abs, v))) for c, n, v in out], columns=["members", "size", "mean_r", "min_abs_r"])
        for i, k in enumerate(keys):
            d.insert(i, k, rows[k].iloc[0])
        return d

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in head), "members array<string>, size int, mean_r double, min_abs_r double"])
    found = units.groupBy(*keys, "prefix").applyInPandas(run, schema)
    if min_size < 3:  # edges in no triangle
        a, b = (F.col(x) for x in "ab")
        tri = units.filter("kind = 0").select(*keys, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
        bare = e.join(tri, [*keys, "a", "b"], "left_anti")
        found = found.unionByName(bare.select(*keys, F.array("a", "b").alias("members"), F.lit(2).alias("size"), F.col("r").alias("mean_r"), F.abs("r").alias("min_abs_r")))
    return found
