"""Special functions against tabulated values, kernels against definitions."""

import itertools
import math
import random

import numpy as np
import pytest

from quillon.functions import special
from quillon.operators import adaptive, compare, correlate, graph, linear, normalize, rotation


def test_tabulated_values():
    near = lambda a, b: pytest.approx(b, rel=1e-9, abs=1e-12) == float(a)
    assert near(special.norm_cdf(1.959963984540054), 0.975)
    assert near(special.norm_ppf(0.975), 1.959963984540054)
    assert near(special.norm_ppf(1e-6), -4.753424308822899)
    assert near(special.t_two_sided(2.2281388519649385, 10), 0.05)
    assert near(special.t_ppf(0.975, 10), 2.2281388519649385)
    assert near(special.t_sf(1.0, math.inf), special.norm_sf(1.0))
    assert near(special.t_sf(1.0, 1), 0.25)
    assert near(special.chi2_sf(3.841458820694124, 1), 0.05)
    assert near(special.f_sf(4.964602743730711, 1, 10), 0.05)
    assert near(special.digamma(1.0), -0.5772156649015329)
    assert near(special.trigamma(1.0), math.pi**2 / 6)
    assert near(special.betainc(2, 3, 0.5), 0.6875)
    assert near(special.gammainc(1, 2), 1 - math.exp(-2))
    assert near(special.hypergeom_sf(3, 20, 7, 5), sum(math.comb(7, k) * math.comb(13, 5 - k) for k in (3, 4, 5)) / math.comb(20, 5))
    assert near(special.binom_sf(8, 10, 0.5), 56 / 1024)
    for x in (0.1, 1.0, 7.5, 300.0):
        assert special.trigamma(special.trigamma_inverse(x)) == pytest.approx(x, rel=1e-6)


def test_mann_whitney_counts():
    u, p = special.mann_whitney([1, 2, 3, 9], [4, 5, 6, 7, 8])
    assert u == 5 and 0 < p < 1


def test_prior_of_known_variances():
    rng = np.random.default_rng(0)
    d0, s0, df = 6.0, 2.0, 8
    s2 = s0 * rng.chisquare(df, 20000) / df / (rng.chisquare(d0, 20000) / d0)
    got = linear.fit_prior(s2, df)
    assert got[0] == pytest.approx(d0, rel=0.1) and got[1] == pytest.approx(s0, rel=0.05)
    assert linear.fit_prior(np.ones(50), df)[0] == math.inf


def test_median_polish_additive():
    x = np.arange(5.0)[:, None] + np.array([10.0, 20.0, 40.0])[None, :]
    abundance, overall, rows, cols, rest = normalize.median_polish(x)
    assert np.allclose(rest, 0) and np.allclose(np.diff(abundance), [10, 20])


def test_first_component_follows_the_mean():
    rng = np.random.default_rng(1)
    base = rng.normal(size=30)
    x = np.stack([base * w + 0.01 * rng.normal(size=30) for w in (1, 2, 3)])
    assert np.corrcoef(normalize.first_component(x), base)[0, 1] > 0.99


def brute_cliques(adj, least):
    nodes = sorted(adj)
    full = [set(c) for n in range(1, len(nodes) + 1) for c in itertools.combinations(nodes, n) if all(b in adj[a] for a, b in itertools.combinations(c, 2))]
    return sorted(tuple(sorted(c)) for c in full if len(c) >= least and not any(c < d for d in full))


def test_cliques_against_brute_force():
    rng = random.Random(2)
    for n, p in ((6, 0.5), (9, 0.4), (10, 0.7), (11, 0.5)):
        pairs = [(f"n{a:02d}", f"n{b:02d}") for a, b in itertools.combinations(range(n), 2) if rng.random() < p]
        adj = graph.adjacency(pairs)
        want = brute_cliques(adj, 3)
        assert graph.maximal_cliques(adj, 3) == want and graph.maximal_cliques(adj, 3, len(want)) == want
        if want:  # a caller's budget never cuts the list
            with pytest.raises(graph.TooManyCliques):
                graph.maximal_cliques(adj, 3, len(want) - 1)
        best = graph.greedy_clique(adj)
        assert all(b in adj[a] for a, b in itertools.combinations(best, 2))


def test_cores_of_known_graphs():
    k4 = graph.adjacency([*itertools.combinations("abcd", 2), ("d", "e")])
    assert graph.core_numbers(k4) == {"a": 3, "b": 3, "c": 3, "d": 3, "e": 1}


def test_louvain_splits_two_cliques():
    w = {p: 1.0 for g in ("abcd", "wxyz") for p in itertools.combinations(g, 2)} | {("d", "w"): 0.1}
    com = graph.louvain(w)
    assert len(set(com.values())) == 2 and len({com[v] for v in "abcd"}) == 1
    assert graph.modularity(w, com) > 0.4


def test_medcouple():
    assert adaptive.medcouple(np.array([1.0, 2, 3, 4, 5])) == pytest.approx(0)
    assert adaptive.medcouple(np.exp(np.linspace(0, 3, 101))) > 0.2
    assert adaptive.medcouple(np.ones(10)) == 0


def test_kde_threshold_bounds():
    rng = np.random.default_rng(3)
    assert adaptive.kde_threshold(rng.random(20)) == 3.0
    assert 2.5 <= adaptive.kde_threshold(np.abs(rng.standard_t(3, 2000))) <= 6.0


def test_random_intercept_recovers_variances():
    rng = np.random.default_rng(4)
    groups = np.repeat(np.arange(80), 5)
    x = np.column_stack([groups % 2 == 0, groups % 2 == 1]).astype(float)
    y = x @ np.array([1.0, 3.0]) + rng.normal(size=80)[groups] * 2 + rng.normal(size=400)
    m = linear.random_intercept(y, x, groups)
    assert m["subject_var"] == pytest.approx(4, rel=0.4) and m["residual_var"] == pytest.approx(1, rel=0.2)
    df = linear.satterthwaite_df(np.array([1.0, -1.0]), m["cov"], m["residual_var"], m["subject_var"], 80, 400)
    assert 39 <= df <= 399
    assert linear.satterthwaite_df(np.array([1.0, -1.0]), m["cov"], 1.0, 1.0, 2, 10) is None


def test_rotation_basis_gives_t():
    import pandas as pd

    rng = np.random.default_rng(5)
    s = pd.DataFrame({"sample_id": [f"s{i}" for i in range(12)], "c": ["x"] * 5 + ["y"] * 7})
    b = rotation.two_group_basis(s, "c", ("x", "y"))
    assert np.allclose(b.q2.T @ b.q2, np.eye(11))
    y = rng.normal(size=12)
    u = y @ b.q2
    t = u[0] / math.sqrt((u[1:] ** 2).sum() / b.df)
    a, c = y[:5], y[5:]
    s2 = ((a - a.mean()) @ (a - a.mean()) + (c - c.mean()) @ (c - c.mean())) / 10
    assert t == pytest.approx((a.mean() - c.mean()) / math.sqrt(s2 * (1 / 5 + 1 / 7)))
    s["d"] = ["p", "q"] * 6
    assert rotation.interaction_basis(s, "c", "d").df == 8
    r = rotation.rotations(100, 5, 1)
    assert np.allclose((r * r).sum(1), 1)


def test_set_statistics_signs():
    z = np.array([[2.0, -1.0, 3.0]])
    s = rotation.set_statistics(z, np.ones(3))
    assert s["mean", "up"][0] == -s["mean", "down"][0] and s["msq", "mixed"][0] == pytest.approx(14 / 3)
    assert s["mean50", "up"][0] == 2.5


def test_effective_tests():
    assert correlate.effective_tests(np.eye(5)) == pytest.approx(5)
    assert correlate.effective_tests(np.ones((5, 5))) == pytest.approx(1)
    assert 1 <= correlate.effective_tests(np.eye(5), "li-ji") <= 5


def test_verdicts():
    ok, bad = {"empirical_pvalue": 0.01}, {"empirical_pvalue": 0.5}
    perm = lambda p: {"stratified": {"permutation_pvalue": p}}
    v = lambda **k: compare.verdict(k)["verdict"]
    assert v(covariate_adjusted=ok, label_permutation=perm(0.01)) == "validated"
    assert v(covariate_adjusted=bad, label_permutation=perm(0.4)) == "refuted"
    assert v(covariate_adjusted=ok, label_permutation=perm(0.4)) == "inconclusive"
    assert v(covariate_adjusted={"status": "failed"}, label_permutation=perm(0.4)) == "inconclusive"
