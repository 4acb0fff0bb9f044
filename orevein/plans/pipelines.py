"""The runs of a search engine over stored tables, each of which reads the tables of one folder and writes new snapshots to another."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import robots
from ..functions.text import STOP_WORDS
from ..operators import crawl, index, pagerank
from ..session import cut
from ..sources import files
from ..sources.tables import load


def _write(table: DataFrame, out: str, name: str) -> None:
    table.write.mode("overwrite").parquet(f"{out}/{name}.parquet")


def crawl_tables(spark: SparkSession, base: str, out: str, seeds: str, robots_files: str | None = None, max_depth: int = 3, max_pages: int | None = crawl.FRONTIER_CAP) -> None:
    """Crawls the stored ``pages`` from a seed file; writes ``crawled`` (every address with its status) and ``found`` (rows for new documents).

    ``robots_files``: a table of robots bodies ``(base, body)``.
    """
    rules = spark.createDataFrame([], "base string, kind string, pattern string")
    if robots_files:
        rules = robots.parse_robots(spark.read.parquet(robots_files)).select("base", "kind", robots.rule_regex(F.col("rule")).alias("pattern"))
    crawled = crawl.crawl(files.seeds(spark, seeds), load(spark, base, "pages").select("url", "html"), load(spark, base, "documents"), rules, max_depth, max_pages)
    _write(crawled.drop("html"), out, "crawled")
    _write(crawl.stored_documents(crawled, f"{out}/html"), out, "found")


def index_tables(spark: SparkSession, base: str, out: str, stop: Iterable[str] = STOP_WORDS) -> None:
    """Indexes the stored pages of all documents without ``index_time``: writes ``documents`` (title, description, size and stamp put in), ``words``
    (counts grown, new words with ids and stems), ``document_words`` and ``links`` (old rows and new ones).

    Pages that can't be read, and documents without a page, stay unindexed.
    """
    documents, words, postings, links = (load(spark, base, t) for t in ("documents", "words", "document_words", "links"))
    waiting = index.unindexed(documents).select("doc_id", "file_path")
    corpus = cut(index.corpus_from_pages(load(spark, base, "pages").select("file_path", "html").join(waiting, "file_path").select("doc_id", "html")), "corpus")
    read = corpus.where("error is null")
    new = cut(index.build_postings(read, stop), "postings")
    vocabulary = cut(index.upserted_vocabulary(words, index.word_counts(new)), "words")
    _write(index.sized(index.described(documents, corpus), new), out, "documents")
    _write(vocabulary, out, "words")
    _write(postings.unionByName(index.coded_postings(new, vocabulary)), out, "document_words")
    _write(links.unionByName(index.link_rows(read, documents.where("url is not null")), allowMissingColumns=True), out, "links")


def rank_tables(spark: SparkSession, base: str, out: str) -> None:
    """Writes ``documents`` with the ranks of the link graph."""
    documents = load(spark, base, "documents")
    edges = pagerank.resolve_links(load(spark, base, "links").where("source_document_id is not null").select("source_document_id", "target_url").distinct(), documents)
    _write(index.ranked(documents, pagerank.pagerank(documents.select(F.col("doc_id").alias("id")), edges)), out, "documents")
