"""Queries of the operators for training corpora, over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.llm.lookalike import canonical_texts, lookalike_classes, lookalike_pairs
from tabulae.llm.mixture import mix, shares
from tabulae.llm.scanned import noisy_lines, paragraphs
from tabulae.llm.split import split_items
from tabulae.llm.tokens import count_tokens, encode_texts
from tabulae.llm.topn import top_items
from tabulae.session import read, small


def _items(spark: SparkSession, d: str) -> DataFrame:
    evidence = read(spark, d, "text_evidence").select(F.lit("text_evidence").alias("rec_table"), F.col("ref_id").cast("string").alias("rec_key"), F.lit("text_evidence").alias("collection"), "text", "page_number")
    sparse = read(spark, d, "sparse_records").select(F.lit("sparse_records").alias("rec_table"), F.col("point_id").alias("rec_key"), "collection", "text", F.col("payload.page_number").alias("page_number"))
    return evidence.unionByName(sparse)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    limits = read(spark, d, "size_limits")
    plan = split_items(_items(spark, d), limits, with_text=False).where("piece_no = 1").join(small(limits.select("collection", "max_chars")), "collection")
    return plan.groupBy("rec_table", "rec_key").agg(F.when(F.max(F.col("longest_stretch") > F.col("max_chars")), "yes").otherwise("no").alias("forced"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_items(_items(spark, d), read(spark, d, "size_limits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return top_items(read(spark, d, "text_evidence"), "document_id", "chunk_id", "relevance_score", "page_number")


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "text_evidence").select("ref_id", "document_name", "page_number", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return noisy_lines(_scans(spark, d))


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs(_scans(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(read(spark, d, "documents"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(read(spark, d, "documents").where("source IS NOT NULL"), ["doc_id", "source"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return shares(_sizes(spark, d), read(spark, d, "mix_targets")).where("short").select("source")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sizes(spark, d), read(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(_sizes(spark, d), read(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(read(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_classes(read(spark, d, "documents"))


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    return canonical_texts(read(spark, d, "documents")).select("doc_id", F.col("form").alias("text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p4_found, p4_paragraphs, p6_ids, p7_found, p7_mixture, p7_shares, p8_found, p8_classes, p8_texts)}

SQL = {
    "p1_found": r"""
WITH items AS (
  SELECT 'text_evidence' AS rec_table, CAST(ref_id AS VARCHAR) AS rec_key, 'text_evidence' AS collection, text FROM text_evidence
  UNION ALL
  SELECT 'sparse_records', point_id, collection, text FROM sparse_records
), long AS (
  SELECT i.rec_table, i.rec_key, s.max_chars, list_max(list_transform(string_split_regex(i.text, '[ \t\n\r\f]'), lambda x: length(x))) AS stretch
  FROM items i JOIN size_limits s ON i.collection = s.collection WHERE length(i.text) > s.max_chars
)
SELECT rec_table, rec_key, CASE WHEN max(CASE WHEN stretch > max_chars THEN 1 ELSE 0 END) = 1 THEN 'yes' ELSE 'no' END AS forced
FROM long GROUP BY rec_table, rec_key""",
    "p3_found": """
WITH best AS (
  SELECT document_id, chunk_id, max(relevance_score) AS score FROM text_evidence
  WHERE document_id <> '' AND chunk_id IS NOT NULL AND relevance_score IS NOT NULL AND NOT isnan(relevance_score) GROUP BY 1, 2
), paged AS (
  SELECT b.document_id, b.chunk_id, b.score, min(t.page_number) AS page
  FROM best b JOIN text_evidence t ON b.document_id = t.document_id AND b.chunk_id = t.chunk_id AND b.score = t.relevance_score GROUP BY 1, 2, 3
), ranked AS (
  SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, page ASC NULLS LAST, chunk_id ASC) AS n FROM paged
)
SELECT document_id, CAST(n AS INTEGER) AS rank_no, chunk_id FROM ranked WHERE n <= 5""",
}
