"""Cross-fitted and self-training classifiers, strata, and markers from a reference feature."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import classify


def two_class_cells(spark, n=120, features=12, seed=3, gap=2.5):
    """Features 0-3 differ between classes (sample number % 2), the rest are noise; some values are missing."""
    rng, rows = np.random.default_rng(seed), []
    for s in range(n):
        for f in range(features):
            x = rng.normal() + (gap * (s % 2) if f < 4 else 0)
            rows.append((f"f{f:02}", f"s{s:03}", None if (s * 13 + f) % 41 == 0 else float(x), "ab"[s % 3 == 0]))
    return spark.createDataFrame(rows, "feature_id string, sample_id string, value double, grp string")


@pytest.fixture(scope="module")
def cells(spark):
    return two_class_cells(spark).persist()


def number(c="sample_id"):
    return F.substring(c, 2, 3).cast("int")


def test_folds_are_even_and_fixed(spark):
    s = spark.range(1000).select(F.col("id").cast("string").alias("sample_id"), F.when(F.col("id") % 10 < 3, F.col("id") % 2).alias("label"))
    got = classify.with_folds(s, folds=5).groupBy("label", "fold").count().collect()
    assert len(got) == 15
    for label in (None, 0, 1):
        n = [r["count"] for r in got if r["label"] == label]
        assert max(n) - min(n) <= 1
    fold = lambda d: {r["sample_id"]: r["fold"] for r in classify.with_folds(d, folds=5).collect()}
    assert fold(s) == fold(s.repartition(7))


def test_no_model_scores_what_it_learnt(spark, cells, monkeypatch):
    """Labels of a fold don't reach its model: a fold whose labels are turned round is scored as before."""
    seen = []

    class Spy:
        def __init__(self, **_):
            pass

        def fit(self, cells, labels):
            self.learnt = {r["sample_id"] for r in labels.collect()}
            return self

        def predict(self, cells):
            ids = {r["sample_id"] for r in cells.select("sample_id").distinct().collect()}
            seen.append((self.learnt, ids))
            return cells.select("sample_id").distinct().select("sample_id", F.lit(0.9).alias("probability"), F.lit(1).alias("predicted"), F.lit(0.8).alias("confidence"))

    monkeypatch.setattr(classify, "Ensemble", Spy)
    s = cells.select("sample_id").distinct().withColumn("label", F.when(number() % 4 != 0, number() % 2))
    s = classify.with_folds(s, folds=3).persist()
    scores = classify.cross_fit(cells, s, s.filter("label is not null"), 3)
    assert scores.count() == 120
    assert len(seen) == 3 and all(not learnt & scored and learnt for learnt, scored in seen)
    assert set.union(*(scored for _, scored in seen)) == {f"s{i:03}" for i in range(120)}


def test_area_under_curve(spark):
    rng = np.random.default_rng(1)
    rows = [(float(np.round(rng.random(), 1)), int(rng.random() < 0.4)) for _ in range(300)]
    one, zero = ([p for p, y in rows if y == k] for k in (1, 0))
    want = np.mean([(a > b) + (a == b) / 2 for a in one for b in zero])
    assert classify.area_under_curve(spark.createDataFrame(rows, "probability double, label int")) == pytest.approx(want)


def test_self_training_finds_hidden_labels(spark, cells):
    s = cells.select("sample_id").distinct().withColumn("sex", F.when(number() % 3 == 0, F.when(number() % 2 == 1, "M").otherwise("F")).otherwise("?"))
    scores, reports = classify.self_train(cells, s, "sex", ("F", "M"), rounds=2, folds=3, trees=10, n_features=6)
    rows = scores.collect()
    assert len(rows) == 120 and {r["source"] for r in rows} >= {"known", "pseudo"}
    hidden = [r for r in rows if r["label"] is None]
    assert len(hidden) == 80 and np.mean([r["predicted"] == int(r["sample_id"][1:]) % 2 for r in hidden]) > 0.9
    assert reports[0]["accuracy"] > 0.85 and reports[0]["auc"] > 0.9 and reports[0]["n_pseudo"] == 0
    assert all(a["accuracy"] <= b["accuracy"] for a, b in zip(reports[:-2], reports[1:-1]))


def test_strata_too_small_stay_undecided(spark, cells):
    s = cells.select("sample_id").distinct().withColumn("grp", F.when(number() < 100, "big").when(number() < 110, "small"))
    s = s.withColumn("sex", F.when(number() % 2 == 1, "M").otherwise("F")).withColumn("sex", F.when(number() % 4 != 0, F.col("sex")))
    got = {r["sample_id"]: r for r in classify.classify_by_stratum(cells, s, "sex", ("F", "M"), "grp", 20).collect()}
    assert len(got) == 120
    for i, r in ((int(k[1:]), r) for k, r in got.items()):
        if i % 4:
            assert r["source"] == "known" and r["sex"] == "FM"[i % 2]
        elif i < 100:
            assert r["source"] == "ensemble" and r["grp"] == "big"
        else:
            assert (r["sex"], r["source"], r["confidence"]) == ("U", "none", 0.0)


def brute_em(x, steps=200):
    share, v = 0.5, x.var()
    m, s = np.array([x.mean() - v**0.5, x.mean() + v**0.5]), np.array([v / 2, v / 2])
    for _ in range(steps):
        d = np.stack([np.log([1 - share, share][k]) - 0.5 * np.log(2 * np.pi * s[k]) - (x - m[k]) ** 2 / (2 * s[k]) for k in (0, 1)])
        w = 1 / (1 + np.exp(d[0] - d[1]))
        share = w.mean()
        m = np.array([((1 - w) * x).sum() / (1 - w).sum(), (w * x).sum() / w.sum()])
        s = np.array([((1 - w) * (x - m[0]) ** 2).sum() / (1 - w).sum(), (w * (x - m[1]) ** 2).sum() / w.sum()])
    return share, m, s


def test_mixture_equals_plain_em(spark):
    rng = np.random.default_rng(5)
    data = {"a": np.concatenate([rng.normal(0, 1, 200), rng.normal(5, 1.5, 100)]), "b": np.concatenate([rng.normal(-3, 0.5, 50), rng.normal(3, 0.5, 150)]), "few": rng.normal(size=5), "flat": np.ones(50)}
    v = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs] + [("a", None)], "k string, x double")
    got = {r["k"]: r for r in classify.two_components(v, ["k"], max_iter=40).collect()}
    assert set(got) == {"a", "b"}
    for k in "ab":
        share, m, s = brute_em(data[k])
        assert got[k]["share"] == pytest.approx(share, abs=2e-3) and (got[k]["m0"], got[k]["m1"]) == pytest.approx(tuple(m), abs=2e-2) and (got[k]["v0"], got[k]["v1"]) == pytest.approx(tuple(s), rel=0.03)


def test_markers_from_a_reference(spark):
    """Planted features follow the reference in each stratum with its own baseline; a small stratum stays undecided."""
    rng, rows = np.random.default_rng(8), []
    for g, n, base in (("x", 80, 0.0), ("y", 60, 10.0), ("z", 6, 0.0)):
        for s in range(n):
            up = s % 3 == 0
            for f in range(8):
                rows.append((f"f{f}", f"{g}{s:02}", float(base + rng.normal(0, 0.5) + (4 if up and f == 0 else 2 if up and f in (1, 2) else -2 if up and f == 3 else 0)), g))
    cells = spark.createDataFrame(rows, "feature_id string, sample_id string, value double, grp string")
    found, samples = classify.discover_from_reference(cells, "f0", ["grp"], 1.0)
    got = {(r["grp"], r["feature_id"]): r for r in found.collect()}
    assert set(got) == {(g, f) for g in "xy" for f in ("f1", "f2", "f3")}
    assert all((r["d"] > 0) == (f != "f3") and abs(r["r"]) > 0.7 for (_, f), r in got.items())
    rows = samples.collect()
    assert all(r["posterior"] is None for r in rows if r["grp"] == "z")
    assert np.mean([(r["posterior"] > 0.5) == (int(r["sample_id"][1:]) % 3 == 0) for r in rows if r["grp"] != "z"]) > 0.97
    alone, _ = classify.discover_from_reference(cells.filter("grp = 'x'"), "f0", min_effect=1.0)
    assert {r["feature_id"] for r in alone.collect()} == {"f1", "f2", "f3"}
