"""The numbered queries over the tables of a data folder, and the SQL that some of them equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from . import centroids, forest, licenses, media, neardup, ngram_join, packing, pieces, pii, quality, token_files, vector_codes, vector_sql, warc


def pii_key(spark: SparkSession) -> bytes:
    """The session's secret `spark.quillspark.pii.key`; an open one for the tables of this folder, which hold invented people."""
    return spark.conf.get("spark.quillspark.pii.key", "for invented people only").encode()


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), neardup.NearDup(words=3, percent=85)).drop("class_id")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(read_table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark, read_table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_rows(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(read_table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"), ngram_join.NgramJoin(words=3, percent=90)).drop("class_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_nearest": op3_nearest,
    "op4_warc": op4_warc,
    "op5_token_files": op5_token_files,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_media": op9_media,
    "op10_pieces": op10_pieces,
    "op11_ngram_join": op11_ngram_join,
    "op12_vector_codes": op12_vector_codes,
    "op13_clusters": op13_clusters,
}

def _linked_sql(percent: int) -> str:
    """Every pair that shares a shingle, and the components of those at the threshold; to be followed by more columns and _LINKED_END."""
    return rf"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM t),
        x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x AS a JOIN x AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(node, lead) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.lead FROM r JOIN e ON e.a = r.node AND r.lead < e.b)
        SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id"""


_LINKED_END = " FROM s JOIN (SELECT node, min(lead) AS c FROM r GROUP BY 1) ON node = doc_id"

ORACLE_SQL: dict[str, str] = {
    "op12_vector_codes": vector_sql.codes_sql(),
    "op13_clusters": vector_sql.clusters_sql(),
    "op2_near_duplicates": _linked_sql(85) + ", doc_id = c AS kept" + _LINKED_END,
    "op11_ngram_join": _linked_sql(90) + _LINKED_END,
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
        d AS (SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(sha1(h), CAST(1 + 5 * k AS INTEGER), 5) AS INTEGER)) AS v FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[1 + i // 4] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
}
