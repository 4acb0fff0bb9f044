"""Snippets: the words around the first hit of each query term, hits in bold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 15


def first_hits(results: DataFrame, hits: DataFrame) -> DataFrame:
    """``(doc_id, word, first)`` of the documents in ``results``."""
    return hits.join(results.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id", "word").agg(F.min("position").alias("first"))


def snippets(results: DataFrame, hits: DataFrame, postings: DataFrame, terms: list[str], window: int = WINDOW) -> DataFrame:
    """``results`` with ``snippet``; documents without a hit show their description.

    ``hits``: postings of the query's words, ``postings``: all (those of the page's few documents are read). The range join becomes an
    equi-join: every window is unfolded to the positions it covers, each once.
    """
    spread = F.explode(F.sequence(F.greatest(F.col("first") - window, F.lit(0)), F.col("first") + window))
    places = first_hits(results, hits).select("doc_id", spread.alias("position")).distinct()
    shown = F.when(F.lower("word").isin(*terms), F.concat(F.lit("<b>"), "word", F.lit("</b>"))).otherwise(F.col("word")) if terms else F.col("word")
    around = postings.join(places, ["doc_id", "position"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "word", shown.alias("shown")))).alias("w"))
    made = around.select("doc_id", F.concat(F.array_join(F.transform("w", lambda x: x["shown"]), " "), F.lit(" ...")).alias("_made"))
    return results.join(made, "doc_id", "left").withColumn("snippet", F.coalesce("_made", "description", F.lit(""))).drop("_made")


def spans(snippet: str) -> DataFrame:
    """Column expression: ``(text, bold)`` parts of a snippet column."""
    parts = F.split(F.col(snippet), r"(?=<b>)|(?<=</b>)")
    full = F.filter(parts, lambda p: p != "")
    return F.transform(full, lambda p: F.struct(F.regexp_replace(p, r"^<b>(.*?)</b>$", "$1").alias("text"), p.rlike(r"^<b>.*?</b>$").alias("bold")))
