"""What only larger tables show: sums in another order, long sides, large groups."""

import math
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillon.operators import adaptive, correlate, impute, kg, linear, modules, multiple, normalize, rotation, tiles
from quillon.operators.store import folder
from quillon.plans import catalog
from quillon.sources import formats, matrix
from tests.test_queries import canonical


def test_corrections_read_their_input_once(spark):
    """Every p finds its q, though reading the input again would give other values."""
    draw = F.udf(lambda: random.random(), "double").asNondeterministic()
    p = spark.range(200).withColumn("p", draw())
    for method in ("bh", "by"):
        q = multiple.bh(p, "p", method=method)
        assert q.count() == 200 and q.filter("q is null or q < p").count() == 0
    assert multiple.storey(p, spark.range(50).select((F.col("id") / 50).alias("p"))).filter("q is null").count() == 0


def same_as_sql(spark, name, folder, **tables):
    """A query of the catalog and its SQL on tables of its own."""
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
    got, con = catalog.QUERIES[name](spark, str(folder)), duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES[name])
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(want.columns, want.fetchall())
    return got


def test_concordance_where_no_method_finds_anything(spark, tmp_path):
    """All p values above the threshold: the chance agreement is 1 and kappa undefined, as in the SQL."""
    e = spark.range(3000).select(F.col("id").alias("vec_id"), (F.col("id") % 3).cast("int").alias("label"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.floor(F.col("id") / 3) * (i + 3)) % 17 / 100 + (F.col("id") % 3) * (F.xxhash64(i) % 997) * 1e-7).cast("float")).alias("embedding"))
    got = same_as_sql(spark, "concordance", tmp_path, embeddings=e).collect()
    assert len(got) == 3 and all(r["n_neither"] == 64 and math.isnan(r["kappa"]) for r in got)


def test_medcouple_from_counts():
    """The medcouple of distinct values with their counts is that of all pairs, in the memory of the distinct values."""

    def by_pairs(x):
        m, h = np.median(x), []
        for a in x[x >= m]:
            for b in x[x <= m]:
                if a != b:
                    h.append(1.0 if a == m else -1.0 if b == m else ((a - m) - (m - b)) / (a - b))
        return float(np.median(h)) if h else 0.0

    rng = np.random.default_rng(3)
    for k in range(60):
        x = (rng.normal(size=k), rng.integers(0, 8, k).astype(float), np.exp(2 * rng.normal(size=k)))[k % 3]
        want = by_pairs(x) if len(x) > 2 else 0.0
        assert adaptive.medcouple(x) == want
        assert adaptive.medcouple(*np.unique(x, return_counts=True)) == want
    tracemalloc.start()
    value = adaptive.medcouple(np.floor(np.exp(rng.normal(size=5000) + 8)), np.full(5000, 1000))
    assert 0.3 < value < 0.5 and tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_matrix_of_many_samples(spark, tmp_path, monkeypatch):
    """Samples may be the rows of a file, and the query's file is as wide as its shorter side: here three brands, not 600 suppliers."""
    rows = [(f"f{i}", f"CASE_{j}", float(i * 10 + j), 0) for i in range(3) for j in range(40) if (i + j) % 7]
    cells = spark.createDataFrame(rows, "feature_id string, sample_id string, value double, flag int")
    matrix.write_matrix(cells, str(tmp_path / "m"), ["f0", "f1", "f2"], samples_in_rows=True)
    assert len(spark.read.csv(str(tmp_path / "m.data"), header=True).columns) == 4
    got, samples = matrix.load_matrix(spark, str(tmp_path / "m.data"), formats.Format("plain", delimiter=","), samples_in_rows=True)
    assert sorted((r["feature_id"], r["sample_id"], r["value"], 0) for r in got.filter("value is not null").collect()) == sorted(rows)
    assert sorted(r["sample_id"] for r in samples.collect()) == sorted(f"CASE_{j}" for j in range(40))
    widths, write = [], matrix.write_matrix
    monkeypatch.setattr(matrix, "write_matrix", lambda c, path, names, **how: widths.append(len(names)) or write(c, path, names, **how))
    n = spark.range(3000)
    same_as_sql(
        spark, "csv_round_trip", tmp_path, part=spark.range(30).select(F.col("id").alias("p_partkey"), F.concat(F.lit("B"), F.col("id") % 3).alias("p_brand")), nation=spark.range(2).select(F.col("id").alias("n_nationkey"), F.col("id").alias("n_regionkey")),
        supplier=spark.range(600).select(F.col("id").alias("s_suppkey"), (F.col("id") % 2).alias("s_nationkey")), lineitem=n.select((F.col("id") % 30).alias("l_partkey"), (F.col("id") * 7 % 600).alias("l_suppkey"), (F.col("id") * 1.5).alias("l_extendedprice")),
    )
    assert widths == [3]


def test_rotation_of_two_groups_without_a_basis(spark, monkeypatch):
    """Observed statistics are those of the basis, p values agree but for the draws, and nothing is samples x samples."""
    rng = np.random.default_rng(4)
    rows = [(f"f{i:02d}", f"s{j:03d}", float(rng.normal() + (0.8 if i < 4 and j % 3 == 0 else 0) + 5 * i), ("x", "y", "z")[j % 3]) for i in range(12) for j in range(60)]
    cells = spark.createDataFrame(rows, "feature_id string, sample_id string, value double, grp string")
    sets = spark.createDataFrame([(f"g{i // 4}", f"f{i:02d}", 1.0 + i % 2) for i in range(12)] + [("one", "f01", 1.0), ("gone", "f99", 1.0), ("gone", "f00", 1.0)], "set_id string, feature_id string, weight double")
    samples = cells.select("sample_id", "grp").distinct().orderBy("sample_id").toPandas()
    key = ["set_id", "statistic", "alternative"]
    old = rotation.test_sets(rotation.feature_effects(cells, rotation.two_group_basis(samples, "grp", ("x", "y"))), sets, 3999).toPandas().set_index(key).sort_index()
    monkeypatch.setattr(rotation, "contrast_basis", None)
    new = rotation.test_two_groups(cells, sets, "grp", ("x", "y"), 3999, block=16).toPandas().set_index(key).sort_index()
    assert list(new.index) == list(old.index) and len(new) == 36
    assert np.allclose(new["observed"], old["observed"]) and np.allclose(new["active_up"], old["active_up"])
    assert np.abs(new["p"] - old["p"]).max() < 0.04 and new["p"].min() < 0.01
    few = rotation.rotated(np.diag([1.0, 2.0, 3.0]), 2, 50, 0)  # more members than dimensions
    assert few.shape == (50, 3) and np.allclose((few[:, 1:] ** 2 / [2, 3]).sum(1), 1)


def test_rotation_query_needs_no_basis(spark, monkeypatch):
    monkeypatch.setattr(rotation, "contrast_basis", None)
    assert catalog.QUERIES["rotation_test"](spark, "/root/testdata/sf0.001").count() == 96


def test_nearest_samples_keep_k_a_missing_value(spark):
    """k samples a missing value come out, whatever the number of samples; they are the nearest of all, over blocks of samples."""
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(3, 90)), 3)
    gone = {(f, s) for f in range(3) for s in range(90) if (s + f) % 9 == 0}
    rows = [(f"f{f}", f"s{s:02d}", None if (f, s) in gone else float(v[f, s]), 0) for f in range(3) for s in range(90)]
    cells = spark.createDataFrame(rows, "feature_id string, sample_id string, value double, flag int")
    near, want = impute.nearest_samples(cells, 4, block=16).collect(), {}
    for f, s in gone:
        every = []
        for o in range(90):
            both = [g for g in range(3) if (g, s) not in gone and (g, o) not in gone]
            if o != s and (f, o) not in gone and both:
                every.append((round(float(np.sqrt(np.mean([(v[g, s] - v[g, o]) ** 2 for g in both]))), 9), f"s{o:02d}"))
        want[f"f{f}", f"s{s:02d}"] = {o for _, o in sorted(every)[:4]}
    got = {}
    for r in near:
        got.setdefault((r["feature_id"], r["s"]), set()).add(r["o"])
        assert r["y"] == v[int(r["feature_id"][1:]), int(r["o"][1:])]
    assert got == want and len(near) == 4 * len(gone)


def test_stabilising_brings_no_samples_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(7)
    cells = spark.createDataFrame([(f"f{f}", f"s{s}", float(np.sinh(f / 4) * (1 + s / 9) + s + rng.normal() / 9), 0) for f in range(12) for s in range(15)], "feature_id string, sample_id string, value double, flag int")
    seen, frame = [], type(cells)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: [seen.append(1), rows := collect(self), seen.append(len(rows))][1])
    out = normalize.variance_stabilise(cells, 4)
    assert max(seen) == 1 and out.count() == 180


def test_modules_repeat_no_edge(spark):
    e = spark.createDataFrame([("a", "x", "activation", 3), ("a", "x", "repression", 3), ("a", "y", "other", 3), ("a", None, "activation", 3), ("b", "x", "repression", 3), ("b", "y", None, 3)], "source string, target string, relationship string, evidence_count long")
    m = kg.modules(e, min_targets=2)
    assert sorted(map(tuple, m.collect())) == [("a", 2, 1, 1, "mixed"), ("b", 2, 0, 1, "repressing")]
    assert "Expand" not in m._jdf.queryExecution().optimizedPlan().toString()


def test_set_matches_shuffle_lists_and_no_pairs(spark):
    """All pairs of sets that share enough, by brute force; what is shuffled before the count goes by one set, not by pairs."""
    rng = random.Random(3)
    rows = [(f"s{i}", m) for i in range(40) for m in rng.choices(range(60), k=25)] + [("lone", None), (None, 1), ("one", 5), ("one", 5)]
    a = spark.createDataFrame(rows, "id string, member int")
    b = a.filter("id > 's2'").withColumn("member", F.when(F.col("member") < 50, F.col("member")))

    def sets(df):
        out = {}
        for r in df.filter("id is not null and member is not null").collect():
            out.setdefault(r["id"], set()).add(r["member"])
        return out

    for other in (a, b):
        got = kg.jaccard_matches(a, other, 0.3)
        x, y = sets(a), sets(other)
        want = {(i, j, len(p & q) / len(p | q)) for i, p in x.items() for j, q in y.items() if p & q and len(p & q) / len(p | q) >= 0.3}
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange hashpartitioning\((.*)", plan)
        assert dealt and not any(re.match(r"\w+#\d+, \w+#\d+", keys) for keys in dealt)


def test_contrasts_on_a_design_from_sums(spark):
    """Equal to least squares by feature, with gaps and without full rank; no list of a feature's values is made."""
    rng = np.random.default_rng(11)
    s = pd.DataFrame({"sample_id": [f"s{i:02d}" for i in range(30)], "g": ["a", "b", "c"] * 10, "age": rng.normal(50, 9, 30)})
    d = linear.covariate_design(s, "g", ("a", "c"), ["age"])
    v = rng.normal(100, 1, (5, 30))
    v[1, ::4], v[2, 3:] = np.nan, np.nan
    v[3, 2::3] = np.nan  # no sample of c
    cells = spark.createDataFrame([(f"f{f}", f"s{i:02d}", None if f == 1 and i == 0 else float(v[f, i])) for f in range(5) for i in range(30)], "feature_id string, sample_id string, value double")
    out = linear.design_contrasts(cells, d)
    got, want = {r["feature_id"]: r for r in out.collect()}, {}
    for f in (0, 1, 4):
        ok = ~np.isnan(v[f])
        beta, rss = np.linalg.lstsq(d.x[ok], v[f, ok], rcond=None)[:2]
        want[f"f{f}"] = (float(d.contrast @ beta), int(ok.sum()) - 4, float(rss[0]) / (ok.sum() - 4))
    assert got.keys() == want.keys()
    for f, (estimate, df, s2) in want.items():
        assert np.isclose(got[f]["estimate"], estimate) and got[f]["df"] == df and np.isclose(got[f]["s2"], s2) and np.isclose(got[f]["t"], estimate / got[f]["se"])
    assert "collect_list" not in out._jdf.queryExecution().toString()


def gappy(spark):
    rng = np.random.default_rng(12)
    rows = [(f"f{f}", f"s{i:02d}", float(rng.normal() + f * i % 5)) for f in range(7) for i in range(90) if (f * 5 + i) % 6 and not (f == 5 and i > 44) and not (f == 6 and i <= 44)]
    return spark.createDataFrame(rows, "feature_id string, sample_id string, value double")


def test_tiles_add_parts_of_the_samples(spark):
    """Samples in several parts give the same pairs; those without a sample in common are there, without a correlation."""
    cells, found = gappy(spark), []
    for most in (1, 1 << 20):
        store = tiles.CorrelationTiles(spark, folder(spark, "tiles"), block=2, most=most)
        store.update(cells)
        found.append({(r["a"], r["b"]): (r["r"], r["n"]) for r in store.read().collect()})
    assert len(found[0]) == 21 and found[0].keys() == found[1].keys() and found[0]["f5", "f6"] == (None, 0.0)
    assert all(n == found[1][k][1] and (r is None or np.isclose(r, found[1][k][0])) for k, (r, n) in found[0].items())


def test_resampled_correlations_add_parts_of_the_samples(spark):
    """As above for resamples; a sample that no resample draws is no error."""
    cells = gappy(spark).withColumn("k", F.lit("x"))
    w = spark.createDataFrame([(i, f"s{s:02d}", 1 + (s + i) % 2) for i in range(2) for s in range(3, 90)], "iteration int, sample_id string, times long")
    one, many = ({(r["iteration"], r["a"], r["b"]): r["r"] for r in correlate.resampled_correlations(cells, w, "k", 0.05, block=4, most=m).collect()} for m in (1 << 20, 40))
    assert one.keys() == many.keys() and len(one) > 5 and all(np.isclose(one[k], many[k]) for k in one)


def test_polished_sets_hold_no_object_a_cell(spark):
    """As the polish of the matrix; a member without values and a sample without any don't count, and nothing is pivoted."""
    cells = gappy(spark).unionByName(spark.createDataFrame([("f7", "s01", None), ("f0", "none", None)], "feature_id string, sample_id string, value double"))
    sets = spark.createDataFrame([(s, f"f{f}") for s, fs in (("a", (0, 1, 7)), ("b", (2, 3, 4))) for f in fs], "set_id string, feature_id string")
    pdf = cells.toPandas().dropna()
    for s, fs in (("a", ("f0", "f1")), ("b", ("f2", "f3", "f4"))):
        wide = pdf[pdf["feature_id"].isin(fs)].pivot(index="feature_id", columns="sample_id", values="value")
        for method, v in (("polish", normalize.median_polish(wide.to_numpy())[0]), ("pc1", normalize.first_component(wide.to_numpy()))):
            out = normalize.summarize_sets(cells, sets, method)
            got = {r["sample_id"]: r["value"] for r in out.filter(F.col("set_id") == s).collect()}
            assert got.keys() == set(wide.columns) and np.allclose([got[c] for c in wide.columns], v)
            assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().toString()


def test_target_universe_in_tasks_of_bounded_size(spark, monkeypatch):
    """What a task holds where targets are counted follows a number of rows, not the session's number of partitions; edges repeat and have nulls."""
    monkeypatch.setattr(modules, "TASK_ROWS", 500, raising=False)
    rng = random.Random(4)
    rows = [(f"r{rng.randrange(150)}", f"f{rng.randrange(300)}") for _ in range(4000)] + [("few", "f1")] * 40 + [(None, f"f{i}") for i in range(60)] + [("r1", None)] * 30
    edges = spark.createDataFrame(rows, "source string, target string")
    cells = spark.range(300).select(F.concat(F.lit("f"), "id").alias("feature_id"), F.lit("s").alias("sample_id"), F.when(F.col("id") % 5 > 0, 1.0).alias("value"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        for least in (1, 20, 24, 1000):
            found = modules.universe(cells, "targets", edges=edges, min_targets=least)
            got = sorted(r["feature_id"] for r in found.collect())
            hit = {(s, t) for s, t in rows if s and t and int(t[1:]) % 5}
            want = {t for s, t in hit if sum(x == s for x, _ in hit) >= least}
            assert got == sorted(want)
            dealt = [int(n) for n in re.findall(r"hashpartitioning\((?:source|target)[^)]*?, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())]
            assert dealt and min(dealt) * 500 >= len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_component_universe_of_repeated_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), ("c", "c"), ("d", "x"), ("x", "e"), ("e", "d")], "source string, target string")
    cells = spark.createDataFrame([(f, "s", 1.0) for f in "abcde"] + [("x", "s", None)], "feature_id string, sample_id string, value double")
    assert sorted(r["feature_id"] for r in modules.universe(cells, "components", edges=edges).collect()) == ["a", "b", "d", "e"]
