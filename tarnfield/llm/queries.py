"""The queries of this subpackage's operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, linededup, mixing, quality, simhash, spotsigs, tokenbin, toxicity, warc, winnow
from .common import table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages"))


def op3_token_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.documents_of(table(spark, sf_dir, "documents"), tokenizer())


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.neighbours_compared(table(spark, sf_dir, "documents"))


def op5_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.by_line(table(spark, sf_dir, "documents"), tokenizer())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=1, min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_items=2).drop("h")


def op8_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_pu, op2_warc_transactions, op3_token_bitplanes, op4_spotsigs, op5_offset_attribution, op6_line_dedup, op7_winnowing, op8_toxicity_knn, op9_simhash_pivot, op10_soft_mixing
    )}


SQL = {
    "op2_warc_transactions": r"""
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\r\n]', '%0A', 'g') AS url, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, n >= 100 AND row_number() OVER (PARTITION BY d ORDER BY page_id NULLS LAST) > 1 AS again, first_value(page_id) OVER (PARTITION BY d ORDER BY page_id NULLS LAST) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to, url FROM r
""",
    "op6_line_dedup": r"""
WITH l AS (
  SELECT d.rid, d.doc_id, u.pos, u.line, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls, 1) AS pos) u),
hot AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM hot)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM hot)), '')) AS kept_sha256
FROM l GROUP BY rid, doc_id
""",
    "op7_winnowing": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 8) AS n, array_to_string(ws[i : i + least(len(ws), 8) - 1], ' ') AS w
       FROM b, LATERAL (SELECT unnest(generate_series(1, len(ws) - least(len(ws), 8) + 1)) AS i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(ws) - n + 1)) AS i) WHERE len(ws) >= n),
hit AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hit, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS p) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hit) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
