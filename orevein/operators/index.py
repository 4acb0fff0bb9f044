"""Building the positional, section-aware index: corpus, postings, vocabulary, sizes, and their updates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.porter import stem_udf
from ..functions.text import STOP_WORDS, clean_section, tokens
from ..functions.urls import is_absolute, normalize, resolve
from ..session import spread
from ..sources.html import read_page
from .skew import numbered


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, title, description, elements)`` of plain texts: the first line is a header, each other line a paragraph."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    element = lambda x, i: F.struct(i.alias("ord"), F.when(i == 0, F.lit("h1")).otherwise(F.lit("p")).alias("tag"), x.alias("text"))
    return spread(documents.select("doc_id", "title", "description", "text")).select("doc_id", "title", "description", F.transform(lines, element).alias("elements"))


def corpus_from_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same of stored HTML, plus ``links`` and ``error``; a page that can't be read has an error and no elements."""
    return spread(pages.select(key, "html")).withColumn("_page", read_page("html")).select(F.col(key).alias("doc_id"), "_page.title", "_page.description", "_page.elements", "_page.links", "_page.error")


def build_postings(corpus: DataFrame, stop: Iterable[str] = STOP_WORDS) -> DataFrame:
    """``(doc_id, word, position, section)``: the title's words, then those of every element in order, positions counted over kept words.

    A document is one row until it is exploded, so positions need no window and no shuffle.
    """
    stop = tuple(stop)
    tagged = lambda text, section: F.transform(tokens(F.coalesce(text, F.lit("")), stop), lambda w: F.struct(w.alias("word"), section.alias("section")))
    section = lambda tag: F.when(tag.rlike("^h[1-6]$"), F.lit("header")).otherwise(F.lit("body"))
    body = F.flatten(F.transform(F.coalesce("elements", F.array().cast("array<struct<ord:int,tag:string,text:string>>")), lambda e: tagged(e["text"], section(e["tag"]))))
    every = F.concat(tagged(F.col("title"), F.lit("title")), body)
    return corpus.select("doc_id", F.posexplode(every).alias("position", "t")).select("doc_id", "t.word", "position", "t.section")


def document_sizes(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("document_size"))


def word_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("word").agg(F.count(F.lit(1)).alias("word_count"))


def document_frequency(postings: DataFrame, word: str = "word") -> DataFrame:
    """``(word, df)``. Documents per word are counted in two levels, so a word in every document is no burden to one task."""
    return postings.groupBy(word, "doc_id").agg(F.count(F.lit(1)).alias("_n")).groupBy(word).agg(F.count(F.lit(1)).alias("df"))


def with_idf(frequency: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``idf`` = ln(N/df + 1); N counts all documents, indexed or not."""
    n = documents.select(F.count(F.lit(1)).alias("n")).scalar()
    return frequency.withColumn("idf", F.round(F.log(n / F.col("df") + 1), 9))


def vocabulary(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """``(word, word_count, df, idf, stem)``; stems are made once per word, not per posting."""
    per = postings.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("word").agg(F.sum("_n").alias("word_count"), F.count(F.lit(1)).alias("df"))
    return with_idf(per, documents).withColumn("stem", stem_udf("word"))


def merge_vocabulary(words: DataFrame, new: DataFrame) -> DataFrame:
    """``(word, word_count)`` of old and new words: counts of known words grow, others are put in."""
    return words.select("word", "word_count").unionByName(new.select("word", "word_count")).groupBy("word").agg(F.sum("word_count").alias("word_count"))


def upserted_vocabulary(words: DataFrame, new: DataFrame) -> DataFrame:
    """The stored vocabulary ``(word_id, word, word_count, idf, stem)`` with the counts of ``new`` ``(word, word_count)`` put in.

    Known words keep id, idf and stem and their counts grow; others get the ids after the greatest one in the order of the words, idf 0.0
    (never computed) and a stem. New words are numbered range by range, so no task sees them all. Null words are left out.
    """
    counts = new.where("word is not null").groupBy("word").agg(F.sum("word_count").alias("_more"))
    known = words.join(counts, "word", "left").select("word_id", "word", (F.col("word_count") + F.coalesce("_more", F.lit(0))).alias("word_count"), "idf", "stem")
    fresh = numbered(counts.join(words.select("word"), "word", "left_anti"), "word", "_number")
    last = words.select(F.coalesce(F.max("word_id"), F.lit(0)).alias("last")).scalar()
    return known.unionByName(fresh.select((F.col("_number") + 1 + last).alias("word_id"), "word", F.col("_more").alias("word_count"), F.lit(0.0).alias("idf"), stem_udf("word").alias("stem")))


def coded_postings(postings: DataFrame, words: DataFrame) -> DataFrame:
    """Postings ``(doc_id, word, position, section)`` as rows of the stored table ``(document_id, word_id, word_position, section)``."""
    return postings.join(words.select("word_id", "word"), "word").select(F.col("doc_id").alias("document_id"), "word_id", F.col("position").alias("word_position"), "section")


def stored_postings(postings: DataFrame, words: DataFrame) -> DataFrame:
    """Stored postings by word: ``(doc_id, word, position, section)``, each key once, missing sections read as body.

    The join leaves only words asked for (push a filter into ``words``). What is left is moved once, by document: the duplicate check here and
    whatever groups by document afterwards need no further exchange.
    """
    named = postings.join(words.select("word_id", "word"), "word_id").select(F.col("document_id").alias("doc_id"), "word", F.col("word_position").alias("position"), clean_section(F.col("section")).alias("section"))
    return named.repartition("doc_id").groupBy("doc_id", "word", "position").agg(F.min("section").alias("section"))


def grouped_postings(postings: DataFrame) -> DataFrame:
    """``(doc_id, word, section, positions)`` with positions in order."""
    return postings.groupBy("doc_id", "word", "section").agg(F.array_sort(F.collect_list("position")).alias("positions"))


def positions_by_section(grouped: DataFrame) -> DataFrame:
    """``(doc_id, word, positions_by_section)``, a map from section to positions."""
    return grouped.groupBy("doc_id", "word").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "positions")))).alias("positions_by_section"))


def full_scan(documents: DataFrame, postings: DataFrame, words: DataFrame) -> DataFrame:
    """Documents with their postings and words, ordered by document and position."""
    rows = postings.join(words.select("word_id", "word"), "word_id").join(documents.select("doc_id", "url", "title"), F.col("document_id") == F.col("doc_id"))
    return rows.select("doc_id", "url", "title", "word", F.col("word_position").alias("position"), "section").orderBy("doc_id", "position", "word")


def unindexed(documents: DataFrame) -> DataFrame:
    return documents.where("index_time is null")


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A new snapshot of ``table`` with the columns of ``changes`` put in where the key has a row there."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = table.join(new, key, "left")
    pick: Column = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[pick(c) if c in names else F.col(c) for c in table.columns])


def sized(documents: DataFrame, postings: DataFrame, when: Column | None = None) -> DataFrame:
    """``documents`` with ``document_size`` and ``index_time`` written for those of ``postings``; the others stay as they are (unindexed).

    ``when``: the stamp, the present time by default.
    """
    stamp = F.current_timestamp().cast("timestamp_ntz") if when is None else when
    return updated(documents, document_sizes(postings).withColumn("index_time", stamp), "doc_id")


def ranked(documents: DataFrame, ranks: DataFrame) -> DataFrame:
    """``documents`` with ``page_rank`` written from ``(id, page_rank)``; documents without a rank keep theirs."""
    return updated(documents, ranks.select(F.col("id").alias("doc_id"), "page_rank"), "doc_id")


def described(documents: DataFrame, corpus: DataFrame) -> DataFrame:
    """``documents`` with title and description as their pages have them; pages that can't be read change nothing."""
    return updated(documents, corpus.where("error is null").select("doc_id", "title", "description"), "doc_id")


def link_rows(corpus: DataFrame, urls: DataFrame) -> DataFrame:
    """``(source_document_id, target_url)``: every link of a page, read against the page's own address ``(doc_id, url)`` and in normal form.

    Links without an absolute normal form are dropped, the same target of a page comes once.
    """
    links = corpus.select("doc_id", F.explode("links").alias("href")).distinct().join(urls.select("doc_id", "url"), "doc_id")
    found = links.select(F.col("doc_id").alias("source_document_id"), normalize(resolve(F.col("url"), F.col("href"))).alias("target_url"))
    return found.where(F.col("target_url").isNotNull() & is_absolute(F.col("target_url"))).distinct()


def full_text(corpus: DataFrame) -> DataFrame:
    """``(doc_id, content)``: title, a space, the description and, right behind it, the texts of the body, as the full-text index holds them."""
    body = F.array_join(F.transform(F.coalesce("elements", F.array().cast("array<struct<ord:int,tag:string,text:string>>")), lambda e: e["text"]), " ")
    return corpus.select("doc_id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")), body).alias("content"))


def duplicate_urls(documents: DataFrame) -> DataFrame:
    """``(url, n)`` of urls that stand in several rows, which a store with unique urls would refuse."""
    return documents.where("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def inserted(documents: DataFrame, new: DataFrame) -> DataFrame:
    """``documents`` with ``new`` rows, stamped with the present ``crawl_time`` if they have none; fails when the result is read if a url is there
    already or comes twice."""
    if "crawl_time" in documents.columns and "crawl_time" not in new.columns:
        new = new.withColumn("crawl_time", F.current_timestamp().cast(documents.schema["crawl_time"].dataType))
    clash = new.join(documents.select("url"), "url", "left_semi").select("url").unionByName(duplicate_urls(new).select("url"))
    taken = clash.groupBy().agg(F.first("url").alias("u")).select(F.when(F.col("u").isNotNull(), F.raise_error(F.concat(F.lit("url exists: "), "u"))).isNull().alias("ok"))
    return documents.unionByName(new.where(taken.scalar()), allowMissingColumns=True)
