"""Queries of the general problems 1 and 3, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import normalize
from ..operators.keyed import heavy_keys, keyed_stats
from ..operators.orphans import month_index, orphan_references, orphan_report
from ..session import cut
from ..sources.tables import load
from .sql import normalize_sql


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return heavy_keys(load(spark, base, "document_words"), "word_id", 0.02).select("word_id")


def p1_word_stats(spark: SparkSession, base: str) -> DataFrame:
    """Postings, documents and first position per section of every word."""
    rows = load(spark, base, "document_words").where("word_id is not null")
    stats = keyed_stats(rows, "word_id", distinct="document_id", first="word_position", by=F.lower("section"), groups=("title", "header", "body"))
    return stats.withColumnsRenamed({"n_rows": "postings", "n_distinct": "n_documents"})


def link_references(links: DataFrame) -> DataFrame:
    """``(link_id, field, key, period)``: both references of each link, exact duplicates once; without those that refer to nothing."""
    rows = links.select(
        "link_id",
        month_index(F.col("link_time")).alias("period"),
        F.explode(
            F.array(
                F.struct(F.lit("source_document_id").alias("field"), F.col("source_document_id").cast("string").alias("key")),
                F.struct(F.lit("target_url").alias("field"), normalize(F.col("target_url")).alias("key")),
            )
        ).alias("ref"),
    )
    return rows.select("link_id", "ref.field", "ref.key", "period").where("key is not null").distinct()


def document_parents(documents: DataFrame) -> DataFrame:
    """``(field, key, since)``: what links can refer to, by document id and by url."""
    rows = documents.where("crawl_time is not null").select(
        month_index(F.col("crawl_time")).alias("since"),
        F.explode(
            F.array(
                F.struct(F.lit("source_document_id").alias("field"), F.col("doc_id").cast("string").alias("key")),
                F.struct(F.lit("target_url").alias("field"), normalize(F.col("url")).alias("key")),
            )
        ).alias("ref"),
    )
    return rows.select("ref.field", "ref.key", "since")


def _link_tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    # the references are read twice (for the bitmaps and to decode), their normal forms are made once
    return cut(link_references(load(spark, base, "links")), "references"), document_parents(load(spark, base, "documents"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return orphan_references(*_link_tables(spark, base)).select("link_id", "field").distinct()


def p3_orphans_by_month(spark: SparkSession, base: str) -> DataFrame:
    return orphan_report(*_link_tables(spark, base))


QUERIES = {"p1_found": p1_found, "p1_word_stats": p1_word_stats, "p3_found": p3_found, "p3_orphans_by_month": p3_orphans_by_month}

_ORPHANS = f"""
WITH refs AS (
  SELECT DISTINCT link_id, field, key, period FROM (
    SELECT link_id, 'source_document_id' AS field, CAST(source_document_id AS VARCHAR) AS key, date_trunc('month', link_time) AS period FROM links
    UNION ALL
    SELECT link_id, 'target_url', {normalize_sql("target_url")}, date_trunc('month', link_time) FROM links)
  WHERE key IS NOT NULL),
parents AS (
  SELECT field, key, min(since) AS since FROM (
    SELECT 'source_document_id' AS field, CAST(doc_id AS VARCHAR) AS key, date_trunc('month', crawl_time) AS since FROM documents
    UNION ALL
    SELECT 'target_url', {normalize_sql("url")}, date_trunc('month', crawl_time) FROM documents)
  WHERE key IS NOT NULL GROUP BY ALL),
orphans AS (
  SELECT refs.* FROM refs LEFT JOIN parents USING (field, key)
  WHERE since IS NULL OR since > coalesce(period, TIMESTAMP '9999-01-01'))
"""

ORACLE = {
    "p1_found": "SELECT word_id FROM document_words WHERE word_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(*) FROM document_words)",
    "p1_word_stats": """SELECT word_id, count(*) AS postings, count(DISTINCT document_id) AS n_documents,
      min(word_position) FILTER (lower(section) = 'title') AS first_title,
      min(word_position) FILTER (lower(section) = 'header') AS first_header,
      min(word_position) FILTER (lower(section) = 'body') AS first_body
      FROM document_words WHERE word_id IS NOT NULL GROUP BY 1""",
    "p3_found": _ORPHANS + "SELECT DISTINCT link_id, field FROM orphans",
    "p3_orphans_by_month": _ORPHANS
    + "SELECT field, CAST(period AS DATE) AS month, count(*) AS n_orphans, count(DISTINCT key) AS n_keys FROM orphans GROUP BY 1, 2",
}
