"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, langid, licenses, pieces, pii, quality, sharding, warc, wrapper
from .common import table


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op6_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


def op8_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extracted(table(spark, sf_dir, "pages"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_warc(warc.deduplicated(table(spark, sf_dir, "pages")))
    # responses are inflated and checked; the other read, for revisits, steps over all other payloads
    out = warc.read_warc(spark, path, payload="verify").filter("record_type = 'response'").unionByName(warc.read_warc(spark, path, payload="skip").filter("record_type = 'revisit'"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E' \t\n\x0B\f\r'), '[ \t\n\x0B\f\r]+') AS words FROM documents),
w2 AS (SELECT doc_id, CASE WHEN words = [''] THEN [] ELSE words END AS words FROM w),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(1, len(words) - 3)), lambda i: array_to_string(words[i + 1 : i + 4], ' '))) AS gram FROM w2 WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, sym.b FROM reach r JOIN sym ON sym.a = r.other)
SELECT w2.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w2 LEFT JOIN n USING (doc_id)
JOIN (SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY node) c USING (doc_id)
"""

ORACLE10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first,
  list_transform(range(8), lambda i: CAST('0x' || substr(hex, 1 + 5 * i, 5) AS BIGINT)) AS part FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((part[1 + i // 4] >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_latent_decontamination": op1_latent_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language_id": op4_language_id,
    "op5_hash_tree_sharding": op5_hash_tree_sharding,
    "op6_feistel_pii": op6_feistel_pii,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_quality_forest": op8_quality_forest,
    "op9_wrapper_induction": op9_wrapper_induction,
    "op10_warc_archive": op10_warc_archive,
}

ORACLES: dict[str, str] = {
    "op2_license_scan": licenses.oracle(),
    "op5_hash_tree_sharding": sharding.oracle(),
    "op7_ngram_jaccard": ORACLE7,
    "op10_warc_archive": ORACLE10,
}
