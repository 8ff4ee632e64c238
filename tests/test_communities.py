"""Cliques by seeds, communities of signed graphs and their bootstrap against brute force."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import cliques, communities, correlate, graph, modules

SIGNED = "k int, a string, b string, weight double, sign string"


def partitions(items):
    if not items:
        yield []
        return
    first, *rest = items
    for p in partitions(rest):
        yield [[first], *p]
        for i in range(len(p)):
            yield [*p[:i], [first, *p[i]], *p[i + 1 :]]


def connected(group, pairs):
    seen, todo = {group[0]}, [group[0]]
    while todo:
        v = todo.pop()
        more = {u for u in group if u not in seen and frozenset((u, v)) in pairs}
        seen |= more
        todo += more
    return len(seen) == len(group)


class Brute:
    """Quality of partitions of one signed graph, straight from its definition."""

    def __init__(self, rows, layers=(1.0, -0.5)):
        self.nodes = sorted({x for r in rows for x in r[1:3]})
        self.at = {v: i for i, v in enumerate(self.nodes)}
        self.w = {s: np.zeros((len(self.nodes),) * 2) for s in ("positive", "negative")}
        for _, a, b, w, s in rows:
            i, j = self.at[a], self.at[b]
            self.w[s][i, j] += w
            self.w[s][j, i] += w
        only = not self.w["positive"].any()
        self.layers = {"positive": layers[0], "negative": 1.0 if only else layers[1]}
        keep = self.w["negative" if only else "positive"]
        self.pairs = {frozenset((a, b)) for a in self.nodes for b in self.nodes if keep[self.at[a], self.at[b]] > 0}

    def quality(self, partition):
        total = 0.0
        for s, w in self.w.items():
            if w.any():
                k = w.sum(0)
                for group in partition:
                    i = [self.at[v] for v in group]
                    total += self.layers[s] * (w[np.ix_(i, i)].sum() - k[i].sum() ** 2 / w.sum())
        return total


def groups(rows):
    found = defaultdict(lambda: defaultdict(list))
    for r in rows:
        found[r["k"]][r["community"]].append(r["node"])
    return found


@pytest.fixture(scope="module")
def mixed(spark):
    """Twelve graphs of 8 nodes, one of negative edges alone, one of positive, and three of 60 nodes with planted groups."""
    rng, rows = random.Random(5), []
    for k in range(14):
        for a, b in itertools.combinations("abcdefgh", 2):
            if rng.random() < 0.5:
                sign = "negative" if k == 12 else "positive" if k == 13 or rng.random() < 0.6 else "negative"
                rows.append((k, a, b, round(rng.uniform(0.1, 1), 3), sign))
    for k in range(20, 23):
        for a, b in itertools.combinations(range(60), 2):
            if rng.random() < (0.5 if a % 5 == b % 5 else 0.06):
                rows.append((k, f"{a:02}", f"{b:02}", round(rng.uniform(0.1, 1), 3), "positive"))
    odd = [(0, "a", "a", 5.0, "positive"), (0, "x", "y", 0.0, "positive"), (0, "x", None, 1.0, "positive"), (0, "x", "y", None, "negative")]
    e = spark.createDataFrame(rows + odd, SIGNED)
    found = communities.communities(e, ["k"]).persist()
    return rows, e, found


def test_communities_near_the_best_partition(mixed, spark):
    """Every community is connected; qualities are those of the definition, and near the best of all partitions."""
    rows, e, found = mixed
    got = groups(found.collect())
    stated = {r["k"]: r for r in communities.quality(e.filter("a is not null and b is not null"), found, ["k"]).collect()}
    reached = []
    for k in range(14):
        brute = Brute([r for r in rows if r[0] == k])
        mine = list(got[k].values())
        assert sorted(v for g in mine for v in g) == brute.nodes and all(c == min(g) for c, g in got[k].items())
        assert all(connected(g, brute.pairs) for g in mine)
        best = max(brute.quality(p) for p in partitions(brute.nodes) if all(connected(g, brute.pairs) for g in p))
        assert stated[k]["quality"] == pytest.approx(brute.quality(mine)) and stated[k]["n_communities"] == len(mine)
        assert brute.quality(mine) <= best + 1e-9
        reached.append(brute.quality(mine) / best)
    assert sum(x > 0.999 for x in reached) >= 10 and min(reached) > 0.8


def test_communities_reach_the_sequential_kernel(mixed):
    rows, e, found = mixed
    got = {r["k"]: r["modularity"] for r in communities.quality(e.filter("k >= 20"), found, ["k"]).collect()}
    for k in range(20, 23):
        w = {(a, b): x for i, a, b, x, _ in rows if i == k}
        assert got[k] >= 0.99 * graph.modularity(w, graph.louvain(w))


def test_communities_without_keys_or_edges(spark):
    two = [(0, a, b, 1.0, "positive") for a, b in [*itertools.combinations("abcd", 2), *itertools.combinations("wxyz", 2), ("d", "w")]]
    e = spark.createDataFrame(two, SIGNED)
    assert {r["node"]: r["community"] for r in communities.communities(e).collect()} == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("wxyz", "w")}
    assert communities.communities(e.limit(0), ["k"]).count() == 0


def test_stability_counts_what_comes_back(spark):
    """Jaccard, node shares and the Rand index from the table of counts equal those from the sets and pairs."""
    rng = random.Random(4)
    nodes = [f"{i:02}" for i in range(20)]
    first = {v: rng.choice("pqr") for v in nodes}
    draws = [{v: rng.choice("xyz") if rng.random() < 0.4 else first[v] for v in nodes} for _ in range(5)] + [dict(first)]
    original = spark.createDataFrame([("c", v, first[v]) for v in nodes], "k string, node string, c0 string")
    found = spark.createDataFrame([("c", i, v, d[v]) for i, d in enumerate(draws) for v in nodes], "k string, iteration int, node string, c1 string")
    whole, each, rand = communities.stability(original, found, ["k"], len(draws))
    sets = lambda d: [{v for v in nodes if d[v] == c} for c in sorted(set(d.values()))]
    for r in whole.collect():
        mine = {v for v in nodes if first[v] == r["community"]}
        best = [max(len(mine & s) / len(mine | s) for s in sets(d)) for d in draws]
        assert (r["size"], r["stability"]) == (len(mine), sum(x > 0.5 for x in best) / len(draws)) and r["mean_jaccard"] == pytest.approx(np.mean(best))
    for r in each.collect():
        mates = [v for v in nodes if first[v] == r["community"] and v != r["node"]]
        assert r["mates"] == pytest.approx(np.mean([sum(d[v] == d[r["node"]] for v in mates) / len(mates) for d in draws]))
    for r in rand.collect():
        d, c = draws[r["iteration"]], Counter()
        for u, v in itertools.combinations(nodes, 2):
            c[first[u] == first[v], d[u] == d[v]] += 1
        a, b, total = c[True, True] + c[True, False], c[True, True] + c[False, True], sum(c.values())
        assert r["rand"] == pytest.approx((c[True, True] - a * b / total) / ((a + b) / 2 - a * b / total))


def planted_cells(spark, n=60, seed=2):
    """Two conditions; in 'x' features 0-4 and 5-9 follow one factor each, in 'y' all is noise; some values are missing."""
    rng, rows = np.random.default_rng(seed), []
    for cond in "xy":
        factor = rng.normal(size=(2, n))
        for f in range(12):
            v = rng.normal(size=n) * (0.3 if cond == "x" and f < 10 else 1) + (factor[f // 5] if cond == "x" and f < 10 else 0)
            rows += [(f"f{f:02}", f"{cond}{s:03}", None if (f * 7 + s) % 19 == 0 else float(v[s]), cond) for s in range(n)]
    return spark.createDataFrame(rows, "feature_id string, sample_id string, value double, grp string")


def test_resampled_correlations_are_weighted_correlations(spark):
    cells = planted_cells(spark, 20)
    w = spark.createDataFrame([(i, f"{c}{s:03}", (s * (i + 1) + i) % 3) for c in "xy" for i in range(3) for s in range(20)], "iteration int, sample_id string, times long").filter("times > 0")
    got = {(r["grp"], r["iteration"], r["a"], r["b"]): r["r"] for r in correlate.resampled_correlations(cells, w, "grp", block=4).collect()}
    value = {(r["feature_id"], r["sample_id"]): r["value"] for r in cells.collect()}
    times = {(r["iteration"], r["sample_id"]): r["times"] for r in w.collect()}
    assert len(got) == 2 * 3 * 66
    for (cond, i, a, b), r in got.items():
        ids = [f"{cond}{s:03}" for s in range(20) for _ in range(times.get((i, f"{cond}{s:03}"), 0))]
        pairs = [(value[a, s], value[b, s]) for s in ids if value[a, s] is not None and value[b, s] is not None]
        assert r == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1], abs=1e-9)


def test_planted_communities_come_back(spark):
    whole, each, rand = communities.community_bootstrap(planted_cells(spark), "grp", n=6, power=2.0, floor=0.04)
    got = {(r["grp"], r["community"]): r for r in whole.collect()}
    for c in ("f00", "f05"):
        assert got["x", c]["size"] >= 5 and got["x", c]["stability"] == 1.0
    noise = [r["stability"] for (k, _), r in got.items() if k == "y"]
    assert np.mean(noise) < 1
    r = {k: np.mean([x["rand"] for x in rand.collect() if x["grp"] == k]) for k in "xy"}
    assert r["x"] > 0.8 > r["y"]
    assert each.count() == 24


# Cliques -------------------------------------------------------------------------------------------


def random_graphs():
    rng, rows = random.Random(7), []
    for k, p in enumerate((0.3, 0.5, 0.8, 0.05)):
        rows += [(k, f"{a:02}", f"{b:02}", rng.uniform(-1, 1)) for a, b in itertools.combinations(range(24), 2) if rng.random() < p]
    return rows


@pytest.mark.parametrize("unit_edges", [20_000, 30])
def test_cliques_by_seeds(spark, unit_edges):
    """The cliques of the plain kernel, with units whole and cut by their second member; repeats and loops don't matter."""
    rows = random_graphs()
    e = spark.createDataFrame(rows + [(0, rows[0][2], rows[0][1], rows[0][3]), (0, "00", "00", 1.0)], "k int, a string, b string, r double")
    found = cliques.find_cliques(e, ["k"], 2, unit_edges=unit_edges).collect()
    want = sorted((k, c) for k in range(4) for c in graph.maximal_cliques(graph.adjacency((r[1], r[2]) for r in rows if r[0] == k), 2))
    assert sorted((r["k"], tuple(r["members"])) for r in found) == want
    value = {(k, a, b): x for k, a, b, x in rows}
    for r in found:
        v = [value[r["k"], a, b] for a, b in itertools.combinations(r["members"], 2)]
        assert r["size"] == len(r["members"]) and r["mean_r"] == pytest.approx(np.mean(v)) and r["min_abs_r"] == pytest.approx(np.abs(v).min())


def test_units_are_limited_by_the_order(spark):
    """A hub of 300 leaves and a clique of 12: no unit holds the hub's leaves."""
    rows = [("h", f"l{i:03}", 1.0) for i in range(300)] + [(f"c{i:02}", f"c{j:02}", 1.0) for i in range(12) for j in range(i + 1, 12)] + [("c00", "h", 1.0)]
    e = spark.createDataFrame(rows, "a string, b string, r double")
    assert [tuple(r["members"]) for r in cliques.find_cliques(e).collect()] == [tuple(f"c{i:02}" for i in range(12))]
    units = cliques._units(e, [])
    assert units.filter("kind = 0").groupBy("prefix").count().agg(F.max("count")).first()[0] <= 12 * 11 / 2
    order = {r["node"]: r["round"] for r in cliques.peeling_order(e).collect()}
    later = Counter()
    for a, b, _ in rows:
        later[min((order[a], a), (order[b], b))] += 1
    assert len(order) == 313 and max(later.values()) <= 4 * 11


def test_cliques_of_nothing_and_budget(spark):
    e = spark.createDataFrame(random_graphs(), "k int, a string, b string, r double")
    assert cliques.find_cliques(e.limit(0), ["k"]).count() == 0
    assert cliques.find_cliques(e.filter("k = 3"), ["k"], 24).count() == 0
    with pytest.raises(Exception, match="more than 1 cliques"):
        cliques.find_cliques(e, ["k"], budget=1).collect()


def test_clique_stability_counts_draws(spark):
    got = {tuple(r["members"]): r["stability"] for r in modules.clique_stability(planted_cells(spark).filter("grp = 'x'"), 0.6, 3, n=8).collect()}
    assert any(set(m) <= {f"f{i:02}" for i in range(5)} and s > 0.5 for m, s in got.items()) and all(0 < s <= 1 for s in got.values())
