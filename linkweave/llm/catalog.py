"""Queries of the training-data operators: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkweave.llm import (
    alignment, bwt, common, dualtree, html, langid, mixing, packing, quota, secrets, superminhash,
    templates, vafile, warc,
)


WARC_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') t FROM pages),
d AS (SELECT page_id, url, strlen(t) payload_bytes, sha256(t) payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) one FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, url, payload_bytes, payload_digest,
  CASE WHEN one <> page_id OR (page_id IS NULL AND one IS NOT NULL) THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN one <> page_id OR (page_id IS NULL AND one IS NOT NULL) THEN one END refers_to
FROM d LEFT JOIN f USING (payload_digest)"""

VECTOR_SQL = """
WITH v AS (SELECT row_number() OVER () r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY r
  ORDER BY score DESC, vec_id))::INT rank FROM s) WHERE rank <= 20"""


def _codes_sql(rounds: int = dualtree.ROUNDS) -> str:
    """Lloyd's rounds written out: p parts, c codebooks, a assignments."""
    far = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    sql = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) e,
  row_number() OVER (ORDER BY vec_id, embedding) r FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, label, k, e[k * len(e) // 8 + 1 : (k + 1) * len(e) // 8] v
  FROM e, (SELECT unnest(range(8)) k)),
c0 AS MATERIALIZED (SELECT k, (r - 1)::BIGINT i, v FROM p WHERE r <= 16)"""
    for n in range(rounds + 1):
        sql += f""",
a{n} AS MATERIALIZED (SELECT r, k, min_by(i, (d, i)) i, min(d) d
  FROM (SELECT p.r, p.k, c.i, {far} d FROM p JOIN c{n} c USING (k)) GROUP BY r, k)"""
        if n < rounds:
            sql += f""",
m{n} AS (SELECT k, i, list(x ORDER BY j) v FROM (SELECT k, i, j, ((s - ((s % n + n) % n)) // n)::BIGINT x
  FROM (SELECT k, i, j, sum(x)::BIGINT s, count(*) n FROM (SELECT p.k, a.i, unnest(p.v) x, unnest(range(len(p.v))) j
    FROM p JOIN a{n} a USING (r, k)) GROUP BY k, i, j)) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce(m.v, c.v) v FROM c{n} c LEFT JOIN m{n} m USING (k, i))"""
    return sql + f""",
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY k, i)) codebooks_sha256 FROM c{rounds}),
o AS (SELECT r, string_agg(printf('%02x', i), '' ORDER BY k) code, sum(d)::BIGINT error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT label_error, codebooks_sha256
FROM o JOIN e USING (r), h"""


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(common.scan(spark, sf_dir, "documents"))


def text_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(common.scan(spark, sf_dir, "documents"))


def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.scan(spark, sf_dir, "pages")).drop("payload")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(common.scan(spark, sf_dir, "embeddings"))


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(common.scan(spark, sf_dir, "pages"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(common.scan(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(common.scan(spark, sf_dir, "documents"), 3, 85)


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.report(
        common.scan(spark, sf_dir, "documents"), common.scan(spark, sf_dir, "benchmark")
    )


def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.remove_repeats(common.scan(spark, sf_dir, "documents")).drop("kept")


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.taken(common.scan(spark, sf_dir, "documents"))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.quantise(common.scan(spark, sf_dir, "embeddings"))


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(common.scan(spark, sf_dir, "documents"))


def token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(common.scan(spark, sf_dir, "documents"))


def entries() -> dict:
    return {
        "op1_secret_spans": (secret_spans, secrets.ORACLE_SQL),
        "op2_context_mixing": (text_costs, None),
        "op3_dictionary_warc": (archived_pages, WARC_SQL),
        "op4_vector_approximation": (nearest_vectors, VECTOR_SQL),
        "op5_main_text": (main_texts, None),
        "op6_language_kernels": (languages, None),
        "op7_repeated_strings": (repeated_strings, None),
        "op8_source_mix": (source_mix, None),
        "op9_superminhash_near_duplicates": (near_duplicates, None),
        "op10_template_decontamination": (decontamination, None),
        "op11_dual_tree_codes": (vector_codes, _codes_sql()),
        "op12_best_fit_packing": (packed_pieces, None),
        "op13_pointer_jumping": (token_groups, None),
    }
