"""The thin queries of the operators over their whole tables, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import fim, hmm, hnsw, jaccard, media, mixing, packing, pii, quality, secrets, tokenfiles, variants, zipwarc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark, sf_dir):
    """Every document as an image in a tar shard, read back: digests, sizes and a feature per row."""
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op2_hmm_scores(spark, sf_dir):
    """Every document scored by the hidden Markov model that the training fold taught."""
    return hmm.score_documents(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    """All pieces of all documents in bins of several lengths."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_zip_warc(spark, sf_dir):
    """Every page written as a WARC record in ZIP packages and read back."""
    return zipwarc.warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_hnsw_near_duplicates(spark, sf_dir):
    """Links and component of every vector."""
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_jaccard_join(spark, sf_dir):
    """Set size and component of every document by three-word shingles at 0.9."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark, sf_dir):
    """What the mix takes of every document."""
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    """Base spans and added spans of personal data of every document."""
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    """Quality score of every document."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_secrets(spark, sf_dir):
    """Base spans, linked weak spans and credentials of every document."""
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    """Words of all documents with their near words, form and root."""
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir):
    """Every document cut in three, and put together again from the output."""
    cut = fim.fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    again = fim.restored(F.col("form"), F.col("output"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(again).alias("restored_sha256"))


def op13_token_files(spark, sf_dir):
    """Every document's token ids written in ascending order of id and read back from the files."""
    import public_tokenizers

    read = tokenfiles.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_media_columns, op2_hmm_scores, op3_best_fit_packing, op4_zip_warc, op5_hnsw_near_duplicates, op6_jaccard_join, op7_source_mixing, op8_pii, op9_quality, op10_secrets,
             op11_spelling_variants, op12_fill_in_middle, op13_token_files, pipeline)
    return {f.__name__: f for f in found}


#: WARC: the archive holds what it was given, so its rows can be said of the table.
OP4_SQL = """
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, strlen(coalesce(html, '')) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON payload_digest = d AND payload_bytes >= 100
"""

#: Mixing: a source is at its cap if the level that its own rank implies exceeds it; ranks by cap / weight.
OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS held, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left
  FROM s WINDOW o AS (ORDER BY source_size / w, source_size, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(CASE WHEN (total - held) / w_left <= 2.0::DOUBLE * source_size / w THEN (total - held) / w_left END) AS level FROM r),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, level * w) AS target FROM s, l),
j AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('7|' || coalesce(d.source, 'null') || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM j
"""


#: Vectors with a null, not finite or only zero components link with nothing.
OP5_SQL = """
WITH RECURSIVE e AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS x,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
                  AND len(list_filter(embedding, lambda v: v <> 0)) > 0, false) AS ok FROM embeddings),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.ok AND b.ok AND a.vec_id < b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
two AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (SELECT DISTINCT u AS node, u AS label FROM two UNION SELECT two.v, reach.label FROM reach JOIN two ON reach.node = two.u WHERE reach.label < two.v),
c AS (SELECT node, min(label) AS component FROM reach GROUP BY 1),
k AS (SELECT u AS node, count(*) AS n FROM two GROUP BY 1)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, coalesce(c.component, e.vec_id) AS component_id, e.vec_id IS NOT DISTINCT FROM coalesce(c.component, e.vec_id) AS kept
FROM e LEFT JOIN c ON c.node = e.vec_id LEFT JOIN k ON k.node = e.vec_id
"""

#: All pairs that share a shingle: for the small tables.
OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(x[i:i + 2], ' ') AS g FROM (SELECT doc_id, x, unnest(range(1, greatest(len(x) - 1, 2))) AS i FROM w WHERE len(x) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 90 * (a.n + b.n - c)),
two AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (SELECT DISTINCT u AS node, u AS label FROM two UNION SELECT two.v, reach.label FROM reach JOIN two ON reach.node = two.u WHERE reach.label < two.v),
c AS (SELECT node, min(label) AS component FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""


#: The hash of slips (CRC-32, bit by bit in a table, then byte by byte) and near words by what is left without a code point.
OP11_SQL = """
WITH RECURSIVE bits AS (
  SELECT i, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents),
seen AS (SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x, count(*) AS n FROM runs GROUP BY 1, 2),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM seen, tab),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS (SELECT word, i, length(word) AS l, substr(word, 1, i - 1) || substr(word, i + 1) AS r FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.r = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.r = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS top, arg_min(near, (-n, near)) AS form
  FROM (SELECT near.word, near.near, w.n FROM near JOIN words w ON w.word = near.near) GROUP BY 1),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 5 * w.n THEN b.form END AS form, CASE WHEN b.top >= 5 * w.n THEN b.top END AS form_n FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, coalesce(form, word) AS at FROM formed UNION SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""

OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (
  SELECT doc_id, text, length(text) AS n, ('0x' || substr(x, 1, 8))::BIGINT % (length(text) + 1) AS a, ('0x' || substr(x, 9, 8))::BIGINT % (length(text) + 1) AS b,
         ('0x' || substr(x, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(x, 25, 8))::BIGINT % 100 AS e FROM d),
f AS (
  SELECT doc_id, text, n, CAST(least(a, b) AS BIGINT) AS p, CAST(abs(a - b) AS BIGINT) AS m,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
g AS (SELECT *, substr(text, 1, p) AS prefix, substr(text, p + 1, m) AS middle, substr(text, p + m + 1) AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_zip_warc": OP4_SQL, "op5_hnsw_near_duplicates": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op7_source_mixing": OP7_SQL, "op11_spelling_variants": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
