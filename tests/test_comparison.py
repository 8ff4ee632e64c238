"""Stratified comparison with bootstrap, the tile store, validation phases and what they notice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import correlate, tiles
from quillon.operators.store import folder
from quillon.plans import workflows
from quillon.sources import matrix


def study(spark, n=48, features=18, seed=1):
    """Sets A (up in 'case'), B (mixed) and C (nothing) of 6 features; strata 'x', 'y' and 'Unknown'."""
    rng, cells, samples = np.random.default_rng(seed), [], []
    for s in range(n):
        case, stratum = s % 2, ("x", "y", "Unknown")[s % 3]
        samples.append((f"s{s:02}", ("ctrl", "case")[case], stratum))
        for f in range(features):
            shift = case * (1.5 if f < 6 else (1.5 if f % 2 else -1.5) if f < 12 else 0)
            cells.append((f"f{f:02}", f"s{s:02}", None if (f * 5 + s) % 37 == 0 else float(rng.normal() + shift)))
    sets = [("ABC"[f // 6], f"f{f:02}") for f in range(features)]
    return spark.createDataFrame(cells, "feature_id string, sample_id string, value double"), spark.createDataFrame(samples, "sample_id string, grp string, site string"), spark.createDataFrame(sets, "set_id string, feature_id string")


def plain_t(a, b):
    s2 = (((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / (len(a) + len(b) - 2)
    return (a.mean() - b.mean()) / np.sqrt(s2 * (1 / len(a) + 1 / len(b)))


def test_stratified_comparison(spark):
    cells, samples, sets = (d.persist() for d in study(spark))
    got = workflows.stratified_comparison(cells, samples, sets, "grp", ("case", "ctrl"), "site", n=12)
    results = got["results"].collect()
    assert {r["stratum"] for r in results} == {"x", "y"} and {r["iteration"] for r in results} == set(range(13))
    value = {(r["feature_id"], r["sample_id"]): r["value"] for r in cells.collect()}
    side = {(r["sample_id"]): (r["grp"], r["site"]) for r in samples.collect()}
    own = {(r["stratum"], r["set_id"], r["method"]): r for r in results if r["iteration"] == 0}
    for stratum in "xy":
        split = [[s for s, k in side.items() if k == (g, stratum)] for g in ("case", "ctrl")]
        pick = lambda f, ids: np.array([value[f, s] for s in ids if value[f, s] is not None])  # noqa: B023, E731
        t = {f"f{f:02}": plain_t(*(pick(f"f{f:02}", ids) for ids in split)) for f in range(18)}
        for k, name in enumerate("ABC"):
            mine = np.array([t[f"f{f:02}"] for f in range(6 * k, 6 * k + 6)])
            rest = np.abs([x for f, x in t.items() if int(f[1:]) // 6 != k])
            assert own[stratum, name, "directional"]["effect_size"] == pytest.approx(mine.mean() * np.sqrt(6))
            assert own[stratum, name, "competitive"]["effect_size"] == pytest.approx((np.abs(mine).mean() - rest.mean()) / (rest.std(ddof=1) / np.sqrt(6)))
            means = [np.array([np.mean([value[f"f{f:02}", s] for f in range(6 * k, 6 * k + 6) if value[f"f{f:02}", s] is not None]) for s in ids]) for ids in split]
            assert own[stratum, name, "summary"]["effect_size"] == pytest.approx(means[0].mean() - means[1].mean())
    conc = got["concordance"].collect()
    assert len(conc) == 2 * 3 and all(r["n_resamples"] == 12 and r["sign_agreement_low"] <= r["sign_agreement_high"] for r in conc)
    called = {(r["stratum"], r["set_id"], r["method"]): r for r in got["sets"].collect()}
    assert called["x", "A", "summary"]["frequency"] > 0.8 and called["x", "A", "directional"]["direction_share"] == 1.0
    assert called["x", "B", "summary"]["frequency"] < called["x", "A", "summary"]["frequency"]


def test_tiles_follow_changes(spark):
    """All pairs once; an added block costs its row of tiles, a changed value its block's, nothing changed nothing."""
    cells, _, _ = study(spark)
    store = tiles.CorrelationTiles(spark, folder(spark, "tiles"), block=5)
    known = lambda d: {(r["a"], r["b"]): r["r"] for r in d.collect()}
    first = store.update(cells.filter("feature_id < 'f12'"))
    blocks = store._table("members", "feature_id string, block int").agg(F.count_distinct("block")).first()[0]
    assert first == blocks * (blocks + 1) // 2 and store.update(cells.filter("feature_id < 'f12'")) == 0
    want = known(correlate.correlations(cells.filter("feature_id < 'f12'")))
    got = known(store.read())
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    added = store.update(cells)
    more = store._table("members", "feature_id string, block int").agg(F.count_distinct("block")).first()[0]
    assert added == more * (more + 1) // 2 - first and store.update(cells) == 0
    changed = cells.withColumn("value", F.when((F.col("feature_id") == "f03") & (F.col("sample_id") == "s01"), 9.0).otherwise(F.col("value")))
    assert store.update(changed) == more
    got, want = known(store.read()), known(correlate.correlations(changed))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    one = store.read(spark.createDataFrame([("f03",)], "feature_id string"))
    assert known(one) == {k: v for k, v in got.items() if "f03" in k}
    assert store.update(cells) == 0  # the old tiles are still there


def test_weighted_tiles(spark):
    cells, _, _ = study(spark)
    cells = cells.withColumn("weight", F.pmod(F.xxhash64("feature_id", "sample_id"), F.lit(4)).cast("double"))
    store = tiles.CorrelationTiles(spark, folder(spark, "tiles"), block=6)
    store.update(cells)
    want = {(r["a"], r["b"]): r["r"] for r in correlate.weighted_correlations(cells).collect()}
    got = {(r["a"], r["b"]): r["r"] for r in store.read().collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_json_goes_through_hadoop(spark, tmp_path):
    matrix.write_json(f"file://{tmp_path}/a/b.json", {"x": 1})
    matrix.write_json(f"file://{tmp_path}/a/b.json", {"x": [2, "é\n"]})
    assert matrix.read_json(f"file://{tmp_path}/a/b.json") == {"x": [2, "é\n"]} and matrix.read_json(f"{tmp_path}/none.json") is None
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["b.json"]


def test_a_changed_cell_reruns_the_phases(spark, tmp_path):
    """Phases stored for other cells don't count; those for the same ones do."""
    cells, samples, sets = (d.persist() for d in study(spark, 24))
    targets = sets.filter("set_id = 'A'").select("feature_id")
    ran = []

    class Counting(workflows.Validation):
        def _phase(self, name, study, work):
            super()._phase(name, study, lambda: ran.append(name) or {"done": name})

    run = lambda c: Counting(str(tmp_path)).run(c, samples, "grp", ("case", "ctrl"), targets, n=4)
    run(cells)
    first = len(ran)
    run(cells.repartition(3))
    assert first > 0 and len(ran) == first
    run(cells.withColumn("value", F.when((F.col("feature_id") == "f00") & (F.col("sample_id") == "s00"), 5.0).otherwise(F.col("value"))))
    assert len(ran) == 2 * first
