"""Queries of the training-data problems, over whole tables, with their SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import load
from . import fusion, leaks, maintext, mojibake, packing, residue, sitelines, spam


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return maintext.main_lines(load(spark, base, "pages"), load(spark, base, "documents")).distinct()


def p4_ranking(spark: SparkSession, base: str) -> DataFrame:
    """One ranking of documents per row of queries."""
    return fusion.search_ranking(*(load(spark, base, t) for t in ("queries", "words", "document_words", "documents", "labels")))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.garbled(load(spark, base, "documents")).select("doc_id", "field").distinct()


def p5_restored(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.garbled(load(spark, base, "documents"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return p6_list_pages(spark, base).select("doc_id").distinct()


def p6_list_pages(spark: SparkSession, base: str) -> DataFrame:
    return spam.list_pages(*(load(spark, base, t) for t in ("documents", "pages", "links")))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return sitelines.boilerplate_lines(load(spark, base, "documents")).select("doc_id", "line_no").distinct()


def p7_cleaned(spark: SparkSession, base: str) -> DataFrame:
    """Every document without its source's repeated lines."""
    return sitelines.without_boilerplate(load(spark, base, "documents"))


def p7_blocks(spark: SparkSession, base: str) -> DataFrame:
    """The blocks of all sources: their member lines, their occurrences (runs of lines in a document) and the lines these hold."""
    hashed = cut(sitelines.hashed_lines(load(spark, base, "documents")).drop("lines"), "lines")
    blocks = sitelines.boilerplate_blocks(hashed)
    members = blocks.select("source", F.explode("members").alias("m")).groupBy("source", F.col("m.block").alias("block")).agg(F.count(F.lit(1)).alias("n_members"))
    found = sitelines.occurrences(hashed, blocks).groupBy("source", "block").agg(F.sum((F.col("run") == F.col("line_no")).cast("long")).alias("n_runs"), F.count(F.lit(1)).alias("n_lines"))
    return members.join(found, ["source", "block"]).select("source", "n_members", "n_runs", "n_lines")


def p8_packed(spark: SparkSession, base: str) -> DataFrame:
    """Container of every document (of every piece of those longer than the capacity), for each kind of container."""
    counts = cut(packing.token_counts(load(spark, base, "documents")), "tokens")
    return packing.pack_documents(counts, load(spark, base, "containers"))


def p8_fill(spark: SparkSession, base: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, base), load(spark, base, "containers"))


def p8_invariants(spark: SparkSession, base: str) -> DataFrame:
    """What packing must never do, counted for each kind: containers above the capacity, documents split without need, tokens lost, containers in more
    than one step group, step groups of uneven number."""
    counts = cut(packing.token_counts(load(spark, base, "documents")), "tokens")
    containers = load(spark, base, "containers")
    packed = cut(packing.pack_documents(counts, containers), "containers")
    kinds = containers.select("container_kind", F.col("capacity_tokens").alias("capacity"))
    boxes = packed.groupBy("container_kind", "container").agg(F.sum("n_tokens").alias("n"), F.min("step_group").alias("g"), F.max("step_group").alias("last")).join(kinds, "container_kind")
    groups = boxes.groupBy("container_kind", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("container_kind").agg((F.max("n") - F.min("n") > 1).cast("int").alias("uneven"))
    over = boxes.groupBy("container_kind").agg(F.sum((F.col("n") > F.col("capacity")).cast("int")).alias("n_over"), F.sum((F.col("g") != F.col("last")).cast("int")).alias("n_torn"))
    documents = packed.groupBy("container_kind", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("packed")).join(kinds, "container_kind").join(counts, "doc_id")
    split = documents.groupBy("container_kind").agg(
        F.sum((F.col("pieces") > F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1))).cast("int")).alias("n_split"), F.sum((F.col("packed") != F.col("n_tokens")).cast("int")).alias("n_lost"), F.count(F.lit(1)).alias("n_documents")
    )
    return over.join(split, "container_kind").join(groups, "container_kind")


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return leaks.leaks(load(spark, base, "documents"), load(spark, base, "benchmark")).select("doc_id", "item_id").distinct()


def p9_leaked_items(spark: SparkSession, base: str) -> DataFrame:
    return leaks.leaked_items(leaks.leaks(load(spark, base, "documents"), load(spark, base, "benchmark")))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return residue.residue(load(spark, base, "documents")).select("doc_id").distinct()


def p10_kinds(spark: SparkSession, base: str) -> DataFrame:
    """Documents with residue, by source and kind of evidence."""
    documents = load(spark, base, "documents")
    return residue.residue(documents).join(documents.select("doc_id", "source"), "doc_id").groupBy("source", "kind").count().withColumnRenamed("count", "n_documents")


QUERIES = {
    query.__name__: query
    for query in (p2_found, p4_ranking, p5_found, p5_restored, p6_found, p6_list_pages, p7_found, p7_cleaned, p7_blocks, p8_packed, p8_fill, p8_invariants, p9_found, p9_leaked_items, p10_found, p10_kinds)
}

_SPACE = r"[\t\r\x0b\f\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_LINES = rf"""
WITH lines AS (
  SELECT doc_id, source, text, line, CAST(i - 1 AS INTEGER) AS line_no,
    trim(regexp_replace(regexp_replace(lower(line), '{_SPACE}', ' ', 'g'), '\p{{Nd}}+', '0', 'g')) AS key
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
sizes AS (SELECT source, count(*) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1),
kept AS (
  SELECT source, key FROM lines JOIN sizes USING (source) WHERE key <> ''
  GROUP BY source, key, size HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) >= 0.1 * size)
"""

ORACLE = {
    "p4_ranking": """
WITH terms AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(query_text), '\\W+')) AS word FROM queries),
wanted AS (SELECT query_id, word_id, idf FROM terms JOIN words USING (word)),
hits AS (
  SELECT document_id, word_id, word_position, min(CASE WHEN trim(coalesce(section, '')) = '' THEN 'body' ELSE lower(trim(section)) END) AS section
  FROM document_words WHERE word_id IN (SELECT word_id FROM wanted) GROUP BY 1, 2, 3),
per_word AS (
  SELECT document_id, word_id, sum(CASE section WHEN 'title' THEN 2.0 WHEN 'header' THEN 1.5 ELSE 1.0 END::DOUBLE) AS weight FROM hits GROUP BY 1, 2),
df AS (SELECT word_id, count(*) AS df FROM per_word GROUP BY 1),
weighted AS (
  SELECT query_id, word_id, CASE WHEN idf > 0 THEN idf ELSE ln((SELECT count(*) FROM documents) / df + 1) END AS idf FROM wanted JOIN df USING (word_id)),
text AS (
  SELECT query_id, doc_id, round(total / document_size, 9) AS value FROM (
    SELECT query_id, document_id AS doc_id, sum(weight * idf) AS total FROM per_word JOIN weighted USING (word_id) GROUP BY 1, 2)
  JOIN documents USING (doc_id) WHERE document_size > 0),
quality AS (SELECT doc_id, max(quality)::DOUBLE AS value FROM labels WHERE quality IS NOT NULL GROUP BY 1),
scores AS (
  SELECT query_id, doc_id, 'text' AS score, value FROM text
  UNION ALL SELECT query_id, doc_id, 'page_rank', page_rank FROM text JOIN documents USING (doc_id) WHERE page_rank > 0
  UNION ALL SELECT query_id, doc_id, 'quality', quality.value FROM text JOIN quality USING (doc_id)),
ranks AS (SELECT *, rank() OVER (PARTITION BY query_id, score ORDER BY value DESC) AS r FROM scores),
total AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS fused, count(*)::INTEGER AS n_scores FROM ranks GROUP BY 1, 2)
SELECT query_id, doc_id, fused, n_scores, rank() OVER (PARTITION BY query_id ORDER BY fused DESC) AS rank FROM total""",
    "p7_found": _LINES + "SELECT doc_id, line_no FROM lines SEMI JOIN kept USING (source, key)",
    "p8_invariants": "SELECT container_kind, 0 AS n_over, 0 AS n_torn, 0 AS n_split, 0 AS n_lost, (SELECT count(*) FROM documents) AS n_documents, 0 AS uneven FROM containers WHERE capacity_tokens >= 1",
    "p7_blocks": _LINES.replace("WITH lines", "WITH RECURSIVE lines")
    + """, marked AS (
      SELECT doc_id, source, line_no, kept.key AS key, lag(kept.key) OVER w AS before, row_number() OVER w AS place
      FROM (SELECT * FROM lines WHERE key <> '' AND source IS NOT NULL) l LEFT JOIN kept USING (source, key) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    edges AS (
      SELECT source, before AS a, key AS b FROM marked JOIN sizes USING (source) WHERE key IS NOT NULL AND before IS NOT NULL
      GROUP BY 1, 2, 3, size HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) >= 0.1 * size),
    ways AS (SELECT source, a, b FROM edges UNION SELECT source, b, a FROM edges),
    reach(source, a, b) AS (SELECT source, key, key FROM kept UNION SELECT reach.source, reach.a, ways.b FROM reach JOIN ways ON ways.source = reach.source AND ways.a = reach.b),
    blocks AS (SELECT source, a AS key, min(b) AS block FROM reach GROUP BY 1, 2),
    members AS (SELECT source, block, count(*) AS n_members FROM blocks GROUP BY 1, 2),
    matched AS (SELECT doc_id, m.source, block, block IS DISTINCT FROM lag(block) OVER (PARTITION BY doc_id ORDER BY line_no) AS begins FROM marked m LEFT JOIN blocks USING (source, key)),
    found AS (SELECT source, block, count(*) FILTER (begins) AS n_runs, count(*) AS n_lines FROM matched WHERE block IS NOT NULL GROUP BY 1, 2)
    SELECT source, n_members, n_runs, n_lines FROM members JOIN found USING (source, block)""",
    "p7_cleaned": _LINES
    + """, marked AS (SELECT lines.*, kept.key IS NOT NULL AS gone FROM lines LEFT JOIN kept USING (source, key))
    SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') END AS text,
      CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed
    FROM documents LEFT JOIN marked USING (doc_id) GROUP BY documents.doc_id, documents.text""",
}
