"""One query per operator, over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import collocations, dedup, language, licenses, negatives, neighbours, packing, pii, quality, segmentation, simhash, urls, warc
from trajspark.llm.common import table

# The rules that the pages are judged by.
URL_RULES = [
    urls.Rule("com", "/", urls.ALLOW),
    urls.Rule("example.com", "/en/", urls.BLOCK),
    urls.Rule("www.example.com", "/en/", urls.ALLOW),
    urls.Rule("net", "/es/", urls.BLOCK),
    urls.Rule("net", "/fr/", urls.BLOCK),
]


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op3_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_license_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", language.held_out(folds=5, fold=0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.fingerprint_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op11_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_url_templates": op1_url_templates,
    "op2_warc_archives": op2_warc_archives,
    "op3_nbest_pieces": op3_nbest_pieces,
    "op4_one_bit_search": op4_one_bit_search,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_license_votes": op7_license_votes,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_pii_tagger": op11_pii_tagger,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_url_templates": urls.judge_sql(URL_RULES),
    "op2_warc_archives": """
        WITH payloads AS (
            SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
        ), grouped AS (
            SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
                   max(page_id) OVER (PARTITION BY body) AS response
            FROM payloads
        ), decided AS (
            SELECT *, payload_bytes >= 1000 AND response IS DISTINCT FROM page_id AS again FROM grouped
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN response END AS refers_to
        FROM decided
    """,
    "op4_one_bit_search": """
        WITH usable AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
              AND len([x FOR x IN embedding IF x <> 0]) > 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM scored QUALIFY rank <= 20
    """,
    "op5_exact_dedup": """
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS body,
                   regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS squeezed
            FROM documents
        ), ranked AS (
            SELECT doc_id, squeezed,
                   first_value(doc_id) OVER same AS keep_id, row_number() OVER same AS place,
                   count(*) OVER (PARTITION BY squeezed) AS group_size
            FROM texts
            WINDOW same AS (PARTITION BY squeezed ORDER BY length(body) DESC, doc_id NULLS LAST)
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(squeezed) AS text_sha256 FROM ranked
    """,
    "op7_license_votes": licenses.scan_sql(),
    "op12_collocations": collocations.COLLOCATIONS_SQL,
    "op13_hard_negatives": negatives.MINE_SQL,
}
