"""Operators on small tables with hand-computed results, and edge semantics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon import schema
from quillon.functions import scalar
from quillon.operators import align, cohort, compare, correlate, graph, impute, kg, linear, multiple, normalize, resample, robust
from quillon.schema import Quality, has_flag
from quillon.sources import formats, matrix

CELLS = "feature_id string, sample_id string, value double, flag int"


def cells_of(spark, rows, grp=None):
    """{feature: [values]} as cells, samples s00, s01, ...; ``grp``: a group per sample."""
    data = [(f, f"s{i:02d}", None if v is None else float(v), 0) for f, vs in rows.items() for i, v in enumerate(vs)]
    c = spark.createDataFrame(data, CELLS)
    if grp is None:
        return c
    return c.join(spark.createDataFrame([(f"s{i:02d}", g) for i, g in enumerate(grp)], "sample_id string, grp string"), "sample_id")


def values(df, feature="a"):
    return [r["value"] for r in df.filter(F.col("feature_id") == feature).orderBy("sample_id").collect()]


def flagged(df):
    return {(r["feature_id"], r["sample_id"]) for r in df.filter(has_flag(F.col("flag"), Quality.OUTLIER_DETECTED)).collect()}


def test_mad_zero_counts_as_one(spark):
    c = cells_of(spark, {"a": [5, 5, 5, 5, 5, 5, 5, 5, 5, 20]})
    assert flagged(robust.detect_outliers(c, threshold=3.0)) == {("a", "s09")}
    assert flagged(robust.detect_outliers(c, threshold=15.0)) == set()


def test_small_groups_are_never_flagged(spark):
    vs = [1, 2, 1, 2, 1, 2, 1, 2, 99, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 99]
    c = cells_of(spark, {"a": vs}, ["x"] * 9 + ["y"] * 11)
    assert flagged(robust.detect_outliers(c, mode="within_group", group_cols=["grp"], threshold=3.0)) == {("a", "s19")}


def test_iqr_ignores_asymmetric_thresholds(spark):
    c = cells_of(spark, {"a": [1, 2, 3, 4, 5, 6, 7, 8, 9, 60]})
    assert flagged(robust.detect_outliers(c, method="iqr", threshold=1.5, upper_threshold=1e9)) == {("a", "s09")}
    with pytest.raises(ValueError):
        robust.detect_outliers(c, method="nothing")


def test_null_values_and_empty_tables(spark):
    c = cells_of(spark, {"a": [1, None, 2, 3, 100], "b": [None] * 5})
    assert ("b", "s00") not in flagged(robust.detect_outliers(c, threshold=3.0))
    for op in (robust.detect_outliers, impute.mad_clip, impute.soft_clip_cells, impute.median_impute, normalize.median_normalize, normalize.quantile_normalize, impute.impute_min):
        assert op(c.limit(0)).count() == 0


def test_canonical_flags(spark):
    c = schema.canonical(spark.createDataFrame([("a", "s", float("nan")), ("a", "t", float("inf")), ("a", "u", 1.0)], "feature_id string, sample_id string, value double"))
    assert {r["sample_id"]: (r["value"], r["flag"]) for r in c.collect()} == {"s": (None, 4), "t": (None, 4), "u": (1.0, 0)}


def test_clip_keeps_clean_cells(spark):
    vs = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 500]
    c = robust.detect_outliers(cells_of(spark, {"a": vs}), threshold=3.0)
    out = values(impute.mad_clip(c, threshold=3.0))
    assert out[:10] == [float(v) for v in vs[:10]]
    clean = np.array(vs[:10], float)
    mad = np.median(np.abs(clean - np.median(clean)))
    assert out[10] == pytest.approx(np.median(clean) + 3 * mad / 0.6745)
    soft = values(impute.soft_clip_cells(c, threshold=3.0))
    assert all(a != b for a, b in zip(soft[:3], vs[:3])) and sorted(soft) == soft  # every value of a touched feature moves, order stays
    assert values(impute.mad_clip(c, max_upper=11.0))[10] == 11.0


def test_median_impute_falls_back(spark):
    c = spark.createDataFrame([("a", "s0", 1.0, 0), ("a", "s1", 3.0, 0), ("a", "s2", 99.0, 1), ("b", "s0", 50.0, 1)], CELLS)
    r = {(x["feature_id"], x["sample_id"]): (x["value"], x["flag"]) for x in impute.median_impute(c).collect()}
    assert r["a", "s2"] == (2.0, 3) and r["b", "s0"] == (2.0, 3)


def test_missing_imputers(spark):
    c = cells_of(spark, {"a": [1, 2, None, 4], "b": [2, 4, 6, None], "c": [1, 1, 1, 1]})
    assert values(impute.impute_min(c))[2] == 1.0 and values(impute.impute_min(c, "sample"))[2] == 1.0
    draws = values(impute.impute_truncated_normal(c, 1.5, seed=1))
    assert draws[2] <= 1.5 and draws == values(impute.impute_truncated_normal(c.repartition(3), 1.5, seed=1))
    assert values(impute.impute_quantile_left(c))[2] is not None
    assert values(impute.impute_missing(c, "none", censored_at=1.0))[0] is None
    near = values(impute.impute_knn(c, 2))
    assert near[:2] == [1.0, 2.0] and 1 <= near[2] <= 4


def test_quantile_normalisation_makes_samples_alike(spark):
    c = cells_of(spark, {"a": [1, 10, 5], "b": [2, 30, 4], "c": [3, 20, 9]})
    q = normalize.quantile_normalize(c).groupBy("sample_id").agg(F.array_sort(F.collect_list("value")).alias("v")).collect()
    assert len({tuple(round(x, 9) for x in r["v"]) for r in q}) == 1


def test_references_of_median_normalisation(spark):
    c = cells_of(spark, {"a": [1, 5, 9], "b": [1, 5, 9]})
    assert values(normalize.median_normalize(c)) == [5.0, 5.0, 5.0]
    assert values(normalize.median_normalize(c, "first")) == [1.0, 1.0, 1.0]
    assert values(normalize.median_normalize(c, "median_sample")) == [5.0, 5.0, 5.0]


def test_stabilised_samples_meet(spark):
    rng = np.random.default_rng(0)
    base = rng.lognormal(3, 1, 60)
    c = cells_of(spark, {f"f{i:02d}": [base[i], 3 * base[i] + 5] for i in range(60)})
    r = normalize.variance_stabilise(c, 12).groupBy("feature_id").pivot("sample_id").agg(F.first("value")).toPandas()
    assert np.corrcoef(r["s00"], r["s01"])[0, 1] > 0.999 and np.abs(r["s00"] - r["s01"]).median() < 0.1


def test_constant_features_have_no_correlation(spark):
    c = cells_of(spark, {"a": [1, 2, 3, 4], "b": [2, 4, 6, 8], "k": [7, 7, 7, 7], "n": [4, 3, 2, 1]})
    r = {(x["a"], x["b"]): x["r"] for x in correlate.correlations(c).collect()}
    assert r["a", "b"] == pytest.approx(1) and r["a", "n"] == pytest.approx(-1) and r["a", "k"] == 0
    rows = schema.packed(c.withColumn("sample_ord", F.substring("sample_id", 2, 2).cast("int")))
    b = {(x["a"], x["b"]): x["r"] for x in correlate.blocked_correlations(rows, 2).collect()}
    assert b.keys() == r.keys() and all(b[k] == pytest.approx(r[k]) for k in r)


def test_edges_are_inclusive(spark):
    p = spark.createDataFrame([("a", "b", 0.7), ("a", "c", -0.7), ("b", "c", 0.69)], "a string, b string, r double")
    assert correlate.edges(p, 0.7).count() == 2
    assert {x["sign"] for x in correlate.signed_edges(p, 0.7).collect()} == {"positive", "negative"}


def test_fisher_columns(spark):
    one = spark.range(1)
    z, se3, se = one.select(scalar.fisher_z(F.lit(1.0)), scalar.fisher_z_se(F.lit(3)), scalar.fisher_z_se(F.lit(103), "spearman")).first()
    assert z == pytest.approx(np.arctanh(0.9999)) and se3 is None and se == pytest.approx(0.106)
    p = one.select(scalar.normal_p_value(F.lit(1.959963984540054)), scalar.t_p_value(F.lit(2.2281388519649385), F.lit(10.0))).first()
    assert p[0] == pytest.approx(0.05) and p[1] == pytest.approx(0.05)
    assert scalar.critical_r(12) == pytest.approx(0.5759829, rel=1e-5)


def test_bh_with_ties_and_nulls(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.01), (3, 0.03), (4, 0.5), (5, None)], "id int, p double")
    q = {r["id"]: r["q"] for r in multiple.bh(d, "p").collect()}
    assert q[1] == q[2] == pytest.approx(0.02) and q[3] == pytest.approx(0.04) and q[4] == 0.5 and q[5] is None


def test_ols_equals_matrix_form(spark):
    rng = np.random.default_rng(1)
    x = {f"f{i}": [None if rng.random() < 0.1 else v for v in rng.normal(size=24)] for i in range(5)}
    grp = [["a", "b", "c"][i % 3] for i in range(24)]
    c = cells_of(spark, x, grp)
    got = {r["feature_id"]: r for r in linear.ols_contrasts(c, [("a", "b")], "grp").collect()}
    s = pd.DataFrame({"sample_id": [f"s{i:02d}" for i in range(24)], "grp": grp})
    want = {r["feature_id"]: r for r in linear.design_contrasts(c, linear.covariate_design(s, "grp", ("a", "b"))).collect()}
    for f in x:
        assert all(got[f][k] == pytest.approx(want[f][k]) for k in ("estimate", "se", "df", "t"))
    p = linear.moderated(linear.ols_contrasts(c, [("a", "b")], "grp"), float("inf"), 1.0).collect()
    assert all(0 < r["p"] <= 1 and r["df_total"] is None for r in p)


def test_prior_by_aggregates(spark):
    rng = np.random.default_rng(2)
    s2, df = rng.chisquare(5, 500) / 5 * rng.gamma(3, 1, 500), rng.integers(4, 9, 500)
    d = spark.createDataFrame(pd.DataFrame({"s2": s2, "df": df}))
    assert linear.fit_prior_frame(d) == pytest.approx(linear.fit_prior(s2, df), rel=1e-6)


def test_designs_reject_what_cannot_be_fitted():
    s = pd.DataFrame({"sample_id": list("abcdef"), "c": list("xxxyyy"), "k": list("xxxyyy"), "age": [1.0, 2, 3, 4, 5, np.nan]})
    with pytest.raises(ValueError, match="rank"):
        linear.covariate_design(s, "c", ("x", "y"), ["k"])
    d = linear.covariate_design(s, "c", ("y", "x"), ["age"])
    assert d.x.shape == (5, 3) and d.contrast.tolist() == [0, 1, 0] and d.df_residual == 2
    with pytest.raises(ValueError, match="contrast"):
        linear.covariate_design(s, "c", ("x", "z"))


def test_competitive_z_degenerate(spark):
    d = spark.createDataFrame([(1.0, True), (2.0, True)], "t double, is_target boolean")
    assert linear.competitive_z(d).first()["z"] == 0.0


def test_mixed_and_plain_models(spark):
    rng = np.random.default_rng(3)
    rows = [("f", float(rng.normal() + (i % 2) + i // 4), "xy"[i % 2], str(i // 4)) for i in range(40)]
    d = spark.createDataFrame(rows, "feature_id string, value double, condition string, subject_id string")
    r = linear.mixed_contrasts(d, ("y", "x")).first()
    assert r["model"] == "mixed" and r["estimate"] == pytest.approx(np.mean([v for _, v, c, _ in rows if c == "y"]) - np.mean([v for _, v, c, _ in rows if c == "x"]), abs=1e-6)
    assert linear.mixed_contrasts(d.limit(2), ("y", "x")).first()["model"] == "failed"


def test_components_and_cores(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "z")], "a string, b string")
    n = spark.createDataFrame([("a",), ("q",)], "node string")
    assert {r["node"]: r["component"] for r in graph.connected_components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    assert {r["node"]: r["component"] for r in graph.connected_components(e, n).collect()} == {"a": "a", "q": "q"}
    assert sorted((r["a"], r["b"]) for r in graph.kcore(e, 2).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)], "a string, b string")
    assert {r["component"] for r in graph.connected_components(chain).collect()} == {"000"}


def test_cohort_semantics(spark):
    s = spark.createDataFrame([("1", "A", 1.0), ("2", None, 2.0), ("3", "B", None)], "sample_id string, g string, x double")
    c = cohort.Cohort.parse({"groups": {"one": {"any": [{"column": "g", "ne": "A"}]}, "two": {"all": [{"column": "x", "gte": 1}]}, "all": {}}})
    assert {r["sample_id"]: r["cohort"] for r in c.resolve(s).collect()} == {"1": "two", "2": "two", "3": "one"}
    with pytest.raises(ValueError):
        cohort.Cohort.parse({"groups": {"one": {"all": [{"column": "g", "eq": 1, "ne": 2}]}}})
    missing = cohort.Group("m", (cohort.Criterion("nope", "isna"),))
    with pytest.raises(KeyError):
        missing.condition(s.columns)
    assert s.filter(missing.condition(s.columns, strict=False)).count() == 0
    k = cohort.carriers_against(s, "A", "g")
    assert {r["sample_id"]: r["cohort"] for r in k.resolve(s).collect()} == {"1": "carrier", "2": "sporadic"}


def test_exact_matching_is_balanced(spark):
    rows = [(f"s{i}", "CASE" if i % 3 else "CTRL", "FM"[i % 2]) for i in range(60)]
    s = spark.createDataFrame(rows, "sample_id string, grp string, sex string")
    m = cohort.match_exactly(s, "grp", ["sex"], 1)
    assert {r["n_before"] >= r["n_after"] for r in cohort.match_audit(s, m, "grp", ["sex"]).collect()} == {True}
    n = {(r["sex"], r["grp"]): r["count"] for r in m.groupBy("sex", "grp").count().collect()}
    assert n["F", "CASE"] == n["F", "CTRL"] and n["M", "CASE"] == n["M", "CTRL"]
    assert sorted(r["sample_id"] for r in m.collect()) == sorted(r["sample_id"] for r in cohort.match_exactly(s.repartition(4), "grp", ["sex"], 1).collect())


def test_alignment(spark):
    s = spark.createDataFrame([("CASE-P1-3",), ("CTRL-P2-x",), ("lonely",)], "sample_id string")
    f = {r["sample_id"]: (r["phenotype"], r["participant"], r["cohort"]) for r in s.select("sample_id", *align.sample_fields(F.col("sample_id"))).collect()}
    assert f == {"CASE-P1-3": ("CASE", "P1", 3), "CTRL-P2-x": ("CTRL", "P2", None), "lonely": ("UNKNOWN", "lonely", None)}
    t = s.withColumn("subject_id", align.subject_id(F.col("sample_id")))
    clin = spark.createDataFrame([("P1", "ALS"), ("P1", "other"), ("P9", "x")], "id string, dx string")
    e = align.enrich_samples(t, clin, "id")
    assert e.filter("matched").count() == 1 and align.enrich_samples(t, clin, "id", True).count() == 1
    p = {r["sample_id"]: (r["phenotype"], r["provenance"]) for r in align.phenotypes(t, clin, "id", "dx", ["ALS"], ["HC"]).collect()}
    assert p == {"CASE-P1-3": ("CASE", "clinical"), "CTRL-P2-x": ("CTRL", "prefix"), "lonely": ("EXCLUDE", "none")}


def test_resolution_and_reverse_map(spark):
    a = spark.createDataFrame([("e1", "ABC", "x", 0.5, "s1"), ("e1", "ABD", "x", 0.9, "s2")], "id string, symbol string, biotype string, confidence double, source string")
    assert align.resolve_entities([a]).first()["symbol"] == "ABD"
    r = spark.createDataFrame([("e1", "Abc", ["x1"], 1.0, 0), ("e2", "X1", ["abc"], 1.0, 1), ("e3", "abc", [], 1.0, 2)], "id string, symbol string, aliases array<string>, confidence double, ord int")
    assert {x["name"]: x["id"] for x in align.reverse_symbols(r).collect()} == {"ABC": "e3", "X1": "e2"}


def test_graph_queries(spark):
    e = spark.createDataFrame([("r", "a", "activation", 3), ("r", "b", "repression", 1), ("s", "b", "activation", 5), ("s", "r", "activation", 2)], "source string, target string, relationship string, evidence_count int")
    ent = lambda q: sorted(x["entity"] for x in q.entities(e).collect())
    assert ent(kg.targets_of("r")) == ["a", "b"] and ent(kg.regulators_of("b")) == ["r", "s"] and ent(kg.Query(("r",), "bidirectional")) == ["a", "b", "s"]
    assert ent(kg.targets_of("r").evidence(2)) == ["a"] and ent(kg.targets_of("r").difference(kg.targets_of("s"))) == ["a"]
    nested = kg.targets_of("s").union(kg.targets_of("r").difference(kg.targets_of("s")))
    assert ent(nested) == ["a", "b", "r"]
    u = spark.createDataFrame([("b",)], "feature_id string")
    assert ent(nested.within(u)) == ["b"] and kg.targets_of("r").within(u).edges(e).count() == 1
    m = {x["source"]: (x["n_targets"], x["direction"]) for x in kg.modules(e, min_targets=1, min_evidence=1).collect()}
    assert m == {"r": (2, "mixed"), "s": (2, "activating")}


def test_enrichment_edges(spark):
    ann = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c")], "term string, feature_id string")
    r = {x["term"]: x for x in kg.enrichment(spark.createDataFrame([("a",), ("zz",)], "feature_id string"), ann).collect()}
    assert r["t"]["study_size"] == 1 and r["t"]["p"] == pytest.approx(2 / 3) and r["u"]["p"] == 1.0
    empty = kg.enrichment(spark.createDataFrame([], "feature_id string"), ann).collect()
    assert all(x["p"] == 1.0 and x["ratio"] == 0 for x in empty)


def test_resampling_is_seeded_and_balanced(spark):
    s = spark.createDataFrame([(f"s{i}", "AB"[i % 2], "FM"[i // 5 % 2]) for i in range(20)], "sample_id string, label string, sex string")
    p = resample.permuted_labels(s, "label", 5, ["sex"], 7)
    assert p.count() == 100
    n = p.join(s.select("sample_id", "sex"), "sample_id").groupBy("iteration", "sex", "label").count().collect()
    real = {(r["sex"], r["label"]): r["count"] for r in s.groupBy("sex", "label").count().collect()}
    assert all(r["count"] == real[r["sex"], r["label"]] for r in n)
    assert sorted(map(str, p.collect())) == sorted(map(str, resample.permuted_labels(s.repartition(3), "label", 5, ["sex"], 7).collect()))
    b = resample.bootstrap_weights(s, 4, ["label"], 1).join(s, "sample_id").groupBy("iteration", "label").agg(F.sum("times").alias("n")).collect()
    assert {r["n"] for r in b} == {10}
    sets = resample.random_sets(s.select(F.col("sample_id").alias("feature_id")), spark.createDataFrame([(3,), (5,)], "size int"), 6)
    assert {(r["size"], r["count"]) for r in sets.groupBy("iteration", "size").count().collect()} == {(3, 3), (5, 5)}


def test_empirical_p(spark):
    o = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "set_id string, t double")
    null = spark.createDataFrame([("a", float(i - 6)) for i in range(12)] + [("b", 0.0)] * 5, "set_id string, t double")
    r = resample.empirical_p(o, null, ["set_id"]).collect()
    assert len(r) == 1 and r[0]["p_two_sided"] == pytest.approx((5 + 4 + 1) / 13) and r[0]["p_directional"] == pytest.approx((4 + 1) / 13)


def test_signal_survives_permutation_and_bootstrap(spark):
    rng = np.random.default_rng(4)
    x = {f"f{i:02d}": (rng.normal(size=40) + (np.arange(40) % 2) * (2.5 if i < 8 else 0)).tolist() for i in range(40)}
    c = cells_of(spark, x)
    s = spark.createDataFrame([(f"s{i:02d}", "AB"[i % 2]) for i in range(40)], "sample_id string, label string")
    t = spark.createDataFrame([(f"f{i:02d}",) for i in range(8)], "feature_id string")
    null = resample.label_permutation_null(c, s, "label", "A", "B", t, 60).first()
    assert null["p"] == pytest.approx(1 / 61) and null["observed_z"] > 3
    boot = resample.bootstrap_stability(c, s, "label", "A", "B", t, 30).first()
    assert boot["stability"] == 1.0 and boot["ci_low"] > 1.5


def test_concordance_needs_three_sets(spark):
    r = spark.createDataFrame([(s, m, 1.0, 0.01) for s in "ab" for m in "xy"], "set_id string, method string, effect_size double, p_value double")
    assert compare.concordance(r).count() == 0
    r3 = spark.createDataFrame([(s, m, float(i), 0.01 * (i + 1)) for i, s in enumerate("abc") for m in "xy"], r.schema)
    c = compare.concordance(r3, 0.025).first()
    assert c["spearman"] == pytest.approx(1) and c["kappa"] == pytest.approx(1) and c["n_both"] == 2
    m = compare.concordance_matrix(compare.concordance(r3), ["x", "y"]).collect()
    assert all(x["x"] == pytest.approx(1) for x in m)


def test_files(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("id\tCASE_1\tCTRL_2\tnFragment\n1/sp|A0AVT1|UBA6_HUMAN\t1.5\tNA\t3\n1/sp|P12345|ABC_HUMAN\t2\tinf\t4\n1/sp|A0AVT1|UBA6_HUMAN\t9\t9\t9\n")
    text = formats.head_text(spark, str(p))
    assert formats.sniff_delimiter(text) == "\t" and formats.suggest_format(text).name == "answerals_proteomics"
    cells, samples = matrix.load_matrix(spark, str(p))
    got = {(r["feature_id"], r["sample_id"]): (r["value"], r["flag"]) for r in cells.collect()}
    assert got == {("A0AVT1", "CASE_1"): (1.5, 0), ("A0AVT1", "CTRL_2"): (None, 4), ("P12345", "CASE_1"): (2.0, 0), ("P12345", "CTRL_2"): (None, 4)}
    assert {r["sample_id"]: r["phenotype"] for r in samples.collect()} == {"CASE_1": "CASE", "CTRL_2": "CTRL"}
    with pytest.raises(ValueError):
        matrix.load_matrix(spark, str(p), strict=True)
    matrix.write_matrix(cells, str(tmp_path / "out"), ["CASE_1", "CTRL_2"])
    assert spark.read.csv(str(tmp_path / "out.data"), header=True).count() == 2
    g = tmp_path / "counts.csv"
    g.write_text("gene,s1,s2\n0,1,2\n1,3,4\n")
    a = tmp_path / "ann.csv"
    a.write_text("i,g\n0,ENSG00000000001\n")
    c, kind = matrix.load_counts(spark, str(g), str(a))
    assert {r["feature_id"] for r in c.collect()} == {"ENSG00000000001", "1"} and kind == "unknown"
    s = tmp_path / "sets.csv"
    s.write_text('clique_id,clique_genes\nk1,"a, b,c"\nk2,"a,b"\n')
    assert matrix.load_sets(spark, str(s)).count() == 3
    o = tmp_path / "go.obo"
    o.write_text("format-version: 1.2\n\n[Term]\nid: GO:1\nname: one\nnamespace: biological_process\n\n[Typedef]\nid: part_of\n")
    assert [r["name"] for r in matrix.read_terms(spark, str(o)).collect()] == ["one"]
    f = tmp_path / "go.gaf"
    f.write_text("!c\n" + "\t".join(["DB", "P1", "ABC", "", "GO:1", "R", "IEA", "", "P", "n", "ENSG00000000001", "protein", "taxon"]) + "\n" + "\t".join(["DB", "P1", "ABD", "NOT|x", "GO:1", "R", "IEA", "", "P", "n", "s", "protein", "taxon"]) + "\n")
    assert [tuple(r) for r in matrix.read_annotations(spark, str(f)).collect()] == [("ABC", "GO:1", "biological_process")]
    matrix.write_json(str(tmp_path / "d" / "x.json"), {"a": 1})
    assert (tmp_path / "d" / "x.json").read_text().startswith("{")


def test_stream_equals_batch(spark, tmp_path):
    from quillon.streaming import flags

    src = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(src).repartition(3).write.parquet(str(tmp_path / "in"))
    q = flags.windowed_statistics(flags.read_events(spark, str(tmp_path / "in")), "7 days", watermark="3650 days").writeStream.outputMode("complete").format("memory").queryName("stats").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = flags.windowed_statistics(spark.read.parquet(src), "7 days")
    key = lambda d: sorted((r["start"], r["event_type"], r["n"], round(r["mean"], 6)) for r in d.collect())
    assert key(spark.table("stats")) == key(batch)
    assert flags.sessions(spark.read.parquet(src)).agg(F.sum("n")).first()[0] == spark.read.parquet(src).count()


def test_assignment_is_optimal():
    import itertools

    from quillon.operators.controls import assign

    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 7)):
        c = rng.random((n, m))
        got = assign(c)
        assert len(set(got.tolist())) == n
        assert c[np.arange(n), got].sum() == pytest.approx(min(c[np.arange(n), list(p)].sum() for p in itertools.permutations(range(m), n)))


def test_matched_controls_and_interaction(spark):
    from quillon.operators import controls

    rng = np.random.default_rng(6)
    x = {f"f{i:02d}": (rng.normal(size=30) + i % 5 + (np.arange(30) % 3 == 0) * (2.5 if i < 6 else 0)).tolist() for i in range(40)}
    c = cells_of(spark, x)
    s = spark.createDataFrame([(f"s{i:02d}", "ABC"[i % 3]) for i in range(30)], "sample_id string, label string")
    t = spark.createDataFrame([(f"f{i:02d}",) for i in range(6)], "feature_id string")
    sets = controls.matched_sets(c, t, 5).collect()
    assert len(sets) == 30 and not {r["feature_id"] for r in sets} & {f"f{i:02d}" for i in range(6)}
    g = resample.group_t(c, s.withColumn("iteration", F.lit(0)), "A", "B").select("feature_id", "t")
    assert controls.matched_controls(c, g, t, 40).first()["p"] == pytest.approx(1 / 41)
    i = controls.interaction_permutation(c, s, "label", ("A", "B"), ("B", "C"), t, 40).first()
    assert i["observed_dz"] > 2 and i["p"] < 0.1
    m = spark.createDataFrame([("k", f"f{i:02d}") for i in range(6)] + [("o", f"f{i:02d}") for i in range(20, 26)], "set_id string, feature_id string")
    b = {r["set_id"]: r for r in controls.bootstrap_selection(c, m, s, "label", "A", "B", 20).collect()}
    assert b["k"]["robust"] and not b["o"]["robust"]


def test_extension_points(spark, tmp_path):
    from quillon.plans import extension as ext

    rng = np.random.default_rng(7)
    x = {f"f{i:02d}": (rng.normal(size=20) + (np.arange(20) % 2 == 0) * (3 if i < 5 else 0)).tolist() for i in range(30)}
    c = cells_of(spark, x)
    step = ext.Transform("outliers", robust.detect_outliers, {"threshold": 3.0})
    assert c.transform(ext.chain(step, lambda d: d)).count() == c.count()
    with pytest.raises(ValueError):
        step(c.drop("value"))
    s = spark.createDataFrame([(f"s{i:02d}", "xy"[i % 2]) for i in range(20)], "sample_id string, g string")
    sets = spark.createDataFrame([("hit", f"f{i:02d}") for i in range(5)] + [("none", f"f{i:02d}") for i in range(10, 15)], "set_id string, feature_id string")
    r = {v["set_id"]: v["p_two_sided"] for v in ext.competitive_engine(c, sets, ext.TwoGroups("g", "x", "y"), s, lambda a, b: normalize.summarize_sets(a, b, "median"), resample.group_t, 40).collect()}
    assert r["hit"] < 0.06 < r["none"]
    d = ext.DerivedGroups(F.when(F.col("g") == "x", "test").otherwise("reference"))
    assert ext.labelled(s, d).count() == 20
    store = ext.StoredTable(spark, str(tmp_path / "store"))
    one = store.get(c, correlate.correlations, method="pearson")
    assert one.count() == 435 and store.get(c.repartition(3), lambda d: 1 / 0, method="pearson").count() == 435
    assert len(store.entries()) == 1 and store.clear(1) == 0 and store.clear() == 1
    e = spark.createDataFrame([("r", "a", "activation", 3), ("r", "b", "repression", 2)], "source string, target string, relationship string, evidence_count int")
    e.write.parquet(str(tmp_path / "edges"))
    src = ext.CompositeSource((ext.TableSource(spark, str(tmp_path / "edges")), ext.TableSource(spark, str(tmp_path / "edges"))))
    assert src.module("r").count() == 2 and src.regulators(min_targets=2).count() == 1
    assert {v["set_id"] for v in ext.neighbor_sets(e, "r").collect()} == {"r_activation", "r_repression"}


def test_commands(spark, tmp_path):
    from quillon.plans import commands

    rng = np.random.default_rng(8)
    head = [f"{'CASE' if i % 2 else 'CTRL'}-{i}" for i in range(48)]
    base = rng.normal(size=48)
    lines = ["id," + ",".join(head)] + [f"g{j}," + ",".join(f"{base[i] + 0.2 * rng.normal() + (i % 2) * 2 * (j < 6):.4f}" for i in range(48)) for j in range(12)]
    (tmp_path / "m.csv").write_text("\n".join(lines))
    (tmp_path / "sets.csv").write_text("clique_id,gene\n" + "".join(f"k{j // 3},g{j}\n" for j in range(12)))
    (tmp_path / "c.json").write_text('{"min_correlation": 0.5}')
    common = ["--input", str(tmp_path / "m.csv"), "--sets", str(tmp_path / "sets.csv"), "--contrast", "CASE,CTRL", "--config", str(tmp_path / "c.json")]
    for command, table in (("impute", "cells"), ("sensitivity", "sensitivity"), ("analyze", "modules"), ("discover", "modules"), ("differential", "sets"), ("compare", "concordance"), ("chart-data", "edges")):
        out = str(tmp_path / command)
        commands.main([command, "--output", out, *common])
        assert spark.read.parquet(f"{out}/{table}").count() > 0, command
    commands.main(["validate", "--output", str(tmp_path / "v"), "--n", "20", *common])
    assert "verdict" in (tmp_path / "v" / "verdict.json").read_text()
    with pytest.raises(SystemExit):
        commands.main(["analyze", "--input", "x", "--output", "y"])


def test_chart_data(spark):
    from quillon.plans import chart_data

    c = cells_of(spark, {"a": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 500]})
    after = impute.mad_clip(robust.detect_outliers(c, threshold=3.0))
    ch = chart_data.changes(c, after).first()
    assert ch["before"] == 500 and ch["change"] < 0
    h = chart_data.histogram(c, "value", 10).collect()
    assert sum(r["n"] for r in h) == 11
    assert chart_data.vulnerability(after).first()["n_outliers"] == 1
    m = spark.createDataFrame([("s", "A", ["a", "b"]), ("s", "B", ["b", "c"])], "set_id string, cond string, members array<string>")
    assert {r["feature_id"]: r["flow"] for r in chart_data.feature_flow(m, "cond", "A", "B").collect()} == {"a": "gained", "b": "kept", "c": "lost"}
    assert chart_data.membership(m, ["cond"]).count() == 4


def test_kde_density_of_all_scores(spark):
    from quillon.operators import adaptive

    rng = np.random.default_rng(8)
    groups = {"small": 3 + rng.standard_t(4, 240), "large": rng.lognormal(0, 0.9, 9000), "ties": np.round(rng.lognormal(0, 0.7, 6000), 1), None: rng.gamma(2, 1, 3000), "few": 1 + rng.random(60)}
    rows = [("f", f"{g}{i}", float(x), 0, g) for g, v in groups.items() for i, x in enumerate(v)]
    cells = spark.createDataFrame(rows, "feature_id string, sample_id string, value double, flag int, grp string")
    got = {r["grp"]: r["t"] for r in adaptive.kde_outliers(cells, "grp", low=0.1, high=50.0, block_rows=700).groupBy("grp").agg(F.max("threshold").alias("t")).collect()}
    for g, v in groups.items():
        v = v[v > 0]
        z = (v - np.median(v)) * 0.6745 / np.median(np.abs(v - np.median(v)))
        assert np.isclose(got[g], adaptive.kde_threshold(z[z > 0], low=0.1, high=50.0), rtol=1e-9), g


def test_matched_pool_loses_no_match(spark):
    """Matching within the pruned pool costs as little as matching to all features, jitter included."""
    import itertools

    from quillon.operators import controls

    rng = np.random.default_rng(3)
    rows = [(f"f{i:03d}", f"s{j}", float(rng.normal(i % 7, 1 + i % 5))) for i in range(160) for j in range(8)]
    c = spark.createDataFrame(rows, "feature_id string, sample_id string, value double")
    t = spark.createDataFrame([(f"f{i:03d}",) for i in (3, 40, 77, 120)], "feature_id string")
    stats = c.groupBy("feature_id").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    hit, pool = controls.matched_pool(stats, t)
    every = {r["feature_id"]: (r["m"], r["v"]) for r in stats.collect()}
    kept, targets = {r["feature_id"] for r in pool.collect()}, [r["feature_id"] for r in hit.collect()]
    rest = [f for f in sorted(every) if f not in targets]
    assert len(targets) == 4 and kept < set(rest)
    cost = np.array([[abs(every[a][0] - every[b][0]) + abs(every[a][1] - every[b][1]) / 2 for b in rest] for a in targets])
    for turn in range(30):  # any jitter within 10 %
        x = cost * (1 + np.random.default_rng(turn).uniform(-0.1, 0.1, cost.shape))
        assert {rest[j] for j in controls.assign(x)} <= kept
    small = rng.random((3, 6))
    best = min(sum(small[i, p[i]] for i in range(3)) for p in itertools.permutations(range(6), 3))
    assert small[np.arange(3), controls.assign(small)].sum() == pytest.approx(best)
    sets = controls.matched_sets(c, t, 6, 1)
    got = sets.groupBy("iteration").agg(F.collect_set("feature_id").alias("f")).collect()
    assert len(got) == 6 and all(len(r["f"]) == 4 and set(r["f"]) <= kept for r in got)
    assert sorted(map(tuple, sets.collect())) == sorted(map(tuple, controls.matched_sets(c.repartition(5), t, 6, 1).collect()))


def test_corrections_over_ranges(spark, monkeypatch):
    """Many p values with ties and nulls, corrected in ranges, against the definition."""
    rng = np.random.default_rng(5)
    p = [None, None, *np.round(rng.random(800) ** 2, 3).tolist(), 0.0, 1.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "id int, p double")
    v = np.array([x for x in p if x is not None])
    order = np.sort(v)
    raw = order * len(v) / np.arange(1, len(v) + 1)
    want = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    got = {r["id"]: r["q"] for r in multiple.bh(df, "p").collect()}
    for i, x in enumerate(p):
        assert got[i] is None if x is None else got[i] == pytest.approx(want[np.searchsorted(order, x, side="left")])
    plan = multiple.bh(df, "p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 1  # the input; the rest is what is stored
    monkeypatch.setattr(multiple, "WINDOW", 50)  # now in ranges
    assert {r["id"]: r["q"] for r in multiple.bh(df, "p").collect()} == pytest.approx(got)
    monkeypatch.undo()
    assert "_part" in multiple._before(multiple.ranged(df.groupBy("p").agg(F.count("*").alias("_c")), "p"), [], "p", ["_c"])._jdf.queryExecution().optimizedPlan().toString()
    null = spark.createDataFrame([(float(x),) for x in rng.random(500)], "p double")
    q = {r["id"]: r["q"] for r in multiple.storey(df, null).collect()}
    n = np.sort([r["p"] for r in null.collect()])
    pi0 = np.median([min(1, (v > c).sum() / (len(v) * (1 - c))) for c in (i * 0.05 for i in range(1, 19))])
    each = {x: min(1, pi0 * (n <= x).sum() * len(v) / len(n) / (v <= x).sum()) for x in set(v)}
    for i, x in enumerate(p):
        if x is not None:
            assert q[i] == pytest.approx(min(e for y, e in each.items() if y >= x))
    assert multiple.bh(df.filter("p is null"), "p").filter("q is not null").count() == 0


def study_of(spark, seed=1, effect=2.5):
    rng = np.random.default_rng(seed)
    samples = [(f"s{i:02d}", "ab"[i % 2], float(rng.normal(50, 8)), "xy"[(i // 2) % 2]) for i in range(40)]
    rows = [(f"f{j:02d}", s, float(rng.normal() + 0.03 * age + (effect if g == "a" and j < 6 else 0))) for s, g, age, _ in samples for j in range(40)]
    return spark.createDataFrame(rows, "feature_id string, sample_id string, value double"), spark.createDataFrame(samples, "sample_id string, grp string, age double, batch string"), spark.createDataFrame([(f"f{j:02d}",) for j in range(6)], "feature_id string")


def test_validation_runs_its_phases(spark, tmp_path):
    import json

    from quillon.plans import workflows

    cells, samples, targets = study_of(spark)
    v = workflows.Validation(str(tmp_path / "v"))
    result = v.run(cells, samples, "grp", ("a", "b"), targets, ["age"], ["batch"], [("b", "a")], n=30)
    assert set(v.phases) == {"covariate_adjusted", "specificity", "label_permutation", "matched", "negative_controls", "bootstrap"}
    assert result["verdict"] == "validated" and all(result["gates"].values())
    # the adjusted z against plain least squares
    s = samples.toPandas().sort_values("sample_id")
    y = cells.toPandas().pivot(index="sample_id", columns="feature_id", values="value").loc[s["sample_id"]]
    x = np.stack([np.ones(40), (s["grp"] == "b").to_numpy(float), ((s["age"] - s["age"].mean()) / s["age"].std()).to_numpy()], 1)
    beta, rss, *_ = np.linalg.lstsq(x, y.to_numpy(), rcond=None)
    t = np.abs(-beta[1] / np.sqrt(rss / 37 * np.linalg.inv(x.T @ x)[1, 1]))
    assert v.phases["covariate_adjusted"]["z"] == pytest.approx((t[:6].mean() - t[6:].mean()) / (t[6:].std(ddof=1) / np.sqrt(6)))
    assert v.phases["specificity"]["label"] == "shared"  # the same contrast the other way round
    assert v.phases["label_permutation"]["stratified"]["permutation_pvalue"] < 0.05 and v.phases["negative_controls"]["target_percentile"] < 10
    stored = tmp_path / "v" / "covariate_adjusted.json"
    kept = json.loads(stored.read_text())
    kept["result"]["empirical_pvalue"] = 0.99  # a stored phase is taken as it is, another study's isn't
    stored.write_text(json.dumps(kept))
    again = workflows.Validation(str(tmp_path / "v")).run(cells, samples, "grp", ("a", "b"), targets, ["age"], ["batch"], [("b", "a")], n=30)
    assert again["gates"] == {"covariate_adjusted": False, "label_permutation": True} and again["verdict"] == "inconclusive"
    none = workflows.Validation()  # a level that no sample has: nothing is left to test
    assert none.run(cells, samples, "grp", ("a", "z"), targets, n=3)["missing"] == ["covariate_adjusted", "label_permutation"] and none.phases["covariate_adjusted"]["status"] == "failed"


def test_levels_universes_and_names(spark):
    from quillon.operators import modules
    from quillon.plans import workflows

    assert align.available_columns(["age", "sex", "x"], {"who": ["sex", "age"], "none": ["y"]}) == {"who": ["sex", "age"]}
    with pytest.raises(ValueError):
        normalize.normalize(cells_of(spark, {"a": [1, 2]}), "nothing")
    with pytest.raises(ValueError):
        kg.features_of_classes(spark.createDataFrame([("k", "f")], "class string, feature_id string"), ["k", "z"])
    with pytest.raises(ValueError):
        modules.universe(cells_of(spark, {"a": [1]}), "odd", edges=spark.createDataFrame([("r", "a")], "source string, target string"))
    sets = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "c"), ("s3", "zz")], "set_id string, feature_id string")
    f = spark.createDataFrame([("a", 1.0, 0.5), ("b", 3.0, None), ("c", 2.0, 0.01)], "feature_id string, estimate double, q double")
    got = {r["set_id"]: r for r in workflows.compare_levels(spark.createDataFrame([("s1", 2.0, 0.01), ("s2", 2.0, None), ("s3", 0.0, 0.5)], "set_id string, estimate double, q double"), f, sets).collect()}
    assert got["s1"]["coordinated"] and got["s1"]["mean_estimate"] == 2.0 and got["s2"]["individual"] and not got["s3"]["coordinated"] and got["s3"]["mean_estimate"] is None
    rho = linear.inter_feature_correlation(cells_of(spark, {"a": [1, 2, 3, 4], "b": [2, 1, 4, 9], "k": [5, 5, 5, 5], "n": [4, 3, 2, 1]}), spark.createDataFrame([("a",), ("b",), ("k",)], "feature_id string")).first()
    assert rho["n_targets"] == 2 and rho["correlation"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 1, 4, 9])[0, 1])
    assert linear.inter_feature_correlation(cells_of(spark, {"a": [1, 2, 3], "n": [3, 2, 1]}), spark.createDataFrame([("a",), ("n",)], "feature_id string")).first()["correlation"] == 0
    assert linear.inter_feature_correlation(cells_of(spark, {"a": [1, 2]}), sets.select("feature_id").limit(0)).first()["correlation"] == 0
