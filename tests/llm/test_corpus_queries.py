"""The registered corpus queries: columns, SQL where there is some, and the pipeline stage by stage."""

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import mixing, queries

DATA = "/root/testdata/sf0.01"
COLUMNS = {
    1: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    2: "doc_id held_out n_tokens n_known train_tokens base_score score",
    4: "page_id payload_bytes payload_digest record_type refers_to",
    5: "vec_id n_links component_id kept",
    6: "doc_id n_shingles component_id",
    7: "doc_id size source_size target taken",
    8: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    9: "doc_id held_out score predicted",
    10: "doc_id n_assign n_access n_hex base_sha256 spans",
    11: "word form root n n_near form_n",
    12: "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    13: "doc_id start n_tokens ids_crc32",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_names_and_columns(spark):
    known = queries.queries()
    for n in range(1, 14):
        (name,) = [k for k in known if re.match(f"op{n}_", k)]
        if n in COLUMNS:
            assert set(COLUMNS[n].split()) <= set(known[name](spark, "/root/testdata/sf0.001").columns), name
    assert "pipeline" in known


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def canonical(rows, columns):
        at = [columns.index(c) for c in cols]
        return sorted(tuple("~" if r[i] is None or isinstance(r[i], float) and math.isnan(r[i]) else str(r[i]) for i in at) for r in rows)

    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = stage["quality"](spark, docs, DATA)
    assert good.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert kept <= before.keys()
    right = Counter((labels[i], i in kept) for i in before if labels.get(i) is not None)
    assert right[1, True] / (right[1, True] + right[1, False]) > 0.97 and right[0, False] / (right[0, True] + right[0, False]) > 0.8

    from test_corpus_operators import brute_components, plain_pii

    single = stage["near_duplicates"](spark, good, DATA)
    want = {i for i, (_, c) in brute_components([(i, before[i]) for i in kept], 5, 80, 100).items() if c == i}
    assert {r["doc_id"] for r in single.collect()} == want and single.columns == docs.columns
    clean = stage["pii"](spark, single, DATA)
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert after.keys() == want
    for i, (text, n) in after.items():
        assert plain_pii(text) == [] and n == len(text)
        assert bool(plain_pii(before[i])) <= (text != before[i])
    mix = stage["mixing"](spark, clean, DATA)
    copies = Counter(r["doc_id"] for r in mix.collect())
    assert {r["doc_id"]: r["copies"] for r in mixing.mix_plan(clean).filter("copies > 0").collect()} == copies
    packed = stage["packing"](spark, mix, DATA)
    words = mix.agg(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert packed.agg(F.sum("length")).first()[0] == words
    fill = packed.filter("bin is not null").groupBy("bin").agg(F.sum("length").alias("n"), F.first("bin_length").alias("l")).agg(F.sum("n") / F.sum("l"), F.max(F.col("n") - F.col("l"))).first()
    assert fill[1] <= 0 and fill[0] > 0.8


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns, and empty tables."""
    from test_corpus_operators import odd_docs

    docs = odd_docs(spark)
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0, name
        if name != "packing":
            assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        rows = got.collect()
        if name == "near_duplicates":
            assert sorted(r["doc_id"] for r in rows if r["doc_id"]) == [1, 2, 3, 4, 5, 7, 8, 9]
        if name == "pii":
            assert len(rows) == docs.count() and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


def test_run_is_all_stages(spark, tmp_path):
    """``run`` over whole tables equals the stages one after the other on what each kept."""
    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).persist()
    want = Counter(map(tuple, docs.collect()))
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want and want
    empty = tmp_path / "none"
    for t in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
