"""Keyword, phrase and boolean phrase retrieval with blended ranking.

All operators take postings ``(doc_id, word, position, section)`` cut down to the words of the query, documents ``(doc_id, url, title,
description, document_size, page_rank)`` and idf ``(word, idf)``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import section_weight
from ..schema import PAGE_RANK_SHARE, SECTION_WEIGHTS, TFIDF_SHARE

AND, OR, NOT = 1, 2, 3


def _none(postings: DataFrame) -> DataFrame:
    return postings.where(F.lit(False))


def tf_idf(postings: DataFrame, documents: DataFrame, idf: DataFrame, missing_idf: float) -> DataFrame:
    """``(doc_id, tf_idf)``: over words and sections, frequency by document size, times section weight, times idf."""
    weights = postings.groupBy("doc_id", "word").agg(F.sum(section_weight(F.col("section"), SECTION_WEIGHTS)).alias("weight"))
    known = weights.join(idf.select("word", "idf"), "word", "left").withColumn("idf", F.coalesce("idf", F.lit(missing_idf)))
    total = known.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("idf")).alias("total"))
    sized = documents.where("document_size > 0").select("doc_id", "document_size")
    return total.join(sized, "doc_id").select("doc_id", F.round(F.col("total") / F.col("document_size"), 9).alias("tf_idf"))


def final_score(tf: Column, rank: Column) -> Column:
    return F.round(TFIDF_SHARE * tf + PAGE_RANK_SHARE * F.coalesce(rank, F.lit(0.0)), 12)


def blended(scored: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds url, title, description and ``final_score``; a document without a page rank has 0."""
    facts = documents.select("doc_id", "url", "title", "description", "page_rank")
    return scored.join(facts, "doc_id").withColumn("final_score", final_score(F.col("tf_idf"), F.col("page_rank"))).select("doc_id", "url", "title", "description", "tf_idf", "final_score")


def of_words(postings: DataFrame, words: list[str]) -> DataFrame:
    return postings.where(F.col("word").isin(*words)) if words else _none(postings)


def keyword_rank(terms: list[str], postings: DataFrame, documents: DataFrame, idf: DataFrame) -> DataFrame:
    """Documents with any of the terms."""
    return blended(tf_idf(of_words(postings, terms), documents, idf, 0.0), documents)


def phrase_documents(terms: list[str], postings: DataFrame) -> DataFrame:
    """``(doc_id)``: documents where the terms follow each other in one section.

    Every hit of term i proposes the start position - i; a start that all terms propose is a phrase. One aggregation by (document,
    section, start) replaces a join per term.
    """
    if not terms:
        return _none(postings).select("doc_id")
    places = F.create_map(*[x for w in dict.fromkeys(terms) for x in (F.lit(w), F.array(*[F.lit(i) for i, t in enumerate(terms) if t == w]))])
    hits = of_words(postings, terms).select("doc_id", "section", "position", F.explode(places[F.col("word")]).alias("i"))
    starts = hits.groupBy("doc_id", "section", (F.col("position") - F.col("i")).alias("start")).agg(F.countDistinct("i").alias("n"))
    return starts.where(F.col("n") == len(terms)).select("doc_id").distinct()


def phrase_scores(terms: list[str], postings: DataFrame, documents: DataFrame, idf: DataFrame) -> DataFrame:
    """``(doc_id, tf_idf)`` of the documents with the phrase; all hits of its words count, not those in the phrase only."""
    found = phrase_documents(terms, postings)
    return tf_idf(of_words(postings, terms).join(found, "doc_id", "left_semi"), documents, idf, 1.0)


def boolean_rank(phrases: list[list[str]], operators: list[int], postings: DataFrame, documents: DataFrame, idf: DataFrame) -> DataFrame:
    """Phrases folded from the left by AND, OR and NOT; a document's score is that of the first phrase that it holds.

    One aggregation by document gathers its hits of the query's words (no more than the document, which was one row when it was indexed); which
    phrases it holds and how they score are expressions over that row, the fold is a boolean one, and documents are joined once.
    """
    if not phrases:
        return blended(_none(postings).select("doc_id", F.lit(0.0).alias("tf_idf")), documents)
    terms = list(dict.fromkeys(w for p in phrases for w in p))
    hits = of_words(postings, terms).join(idf.select("word", "idf"), "word", "left")
    hit = F.struct("word", "section", "position", section_weight(F.col("section"), SECTION_WEIGHTS).alias("weight"), F.coalesce("idf", F.lit(1.0)).alias("idf"))
    rows = hits.groupBy("doc_id").agg(F.collect_set(hit).alias("_hits"))
    of = lambda w: F.filter("_hits", lambda h: h["word"] == w)
    zero = F.lit(0.0)
    score = {w: F.aggregate(of(w), zero, lambda a, h: a + h["weight"]) * F.coalesce(F.array_max(F.transform(of(w), lambda h: h["idf"])), zero) for w in terms}

    def starts(word: str, i: int) -> Column:
        """Places, section and position together, where the phrase would have to begin."""
        return F.transform(of(word), lambda h: F.concat_ws(":", h["section"], h["position"] - i))

    def found(phrase: list[str]) -> Column:
        both = starts(phrase[0], 0)
        for i, w in enumerate(phrase[1:], 1):
            both = F.array_intersect(both, starts(w, i))
        return F.size(both) > 0

    names = [f"_p{i}" for i in range(len(phrases))]
    rows = rows.select("doc_id", *[found(p).alias(n) if p else F.lit(False).alias(n) for p, n in zip(phrases, names, strict=True)], *[score[w].alias(f"_w{i}") for i, w in enumerate(terms)])
    at = {w: F.col(f"_w{i}") for i, w in enumerate(terms)}
    kept, total = F.col(names[0]), F.lit(None).cast("double")
    for i, name in enumerate(names[1:]):
        op = operators[i] if i < len(operators) else 0
        kept = kept | F.col(name) if op == OR else kept & ~F.col(name) if op == NOT else kept & F.col(name)
    for phrase, name in list(zip(phrases, names, strict=True))[::-1]:
        parts = [at[w] for w in dict.fromkeys(phrase)]
        total = F.when(F.col(name), sum(parts[1:], parts[0]) if parts else zero).otherwise(total)
    sized = documents.where("document_size > 0").select("doc_id", "url", "title", "description", "page_rank", "document_size")
    scored = rows.where(kept & total.isNotNull()).select("doc_id", total.alias("total")).join(sized, "doc_id").withColumn("tf_idf", F.round(F.col("total") / F.col("document_size"), 9))
    return scored.withColumn("final_score", final_score(F.col("tf_idf"), F.col("page_rank"))).select("doc_id", "url", "title", "description", "tf_idf", "final_score")


def ordered(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy(F.desc("final_score"), "doc_id")


def result_page(ranked: DataFrame, page: int = 1, per_page: int = 10) -> DataFrame:
    """One page of results with their place; empty beyond the end."""
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    top = ordered(ranked).offset((page - 1) * per_page).limit(per_page)
    # the per_page rows that are left may be numbered by one task
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("final_score"), "doc_id")) + F.lit((page - 1) * per_page))


def full_text_match(content: DataFrame, terms: list[str]) -> DataFrame:
    """``(doc_id)`` of the full texts ``(doc_id, content)`` that hold any of the terms as a token.

    Tokens are runs of letters and digits of any script, in lower case. Terms without a letter or digit match nothing.
    """
    words = sorted({t for term in terms for t in re.findall(r"[^\W_]+", term.lower())})
    if not words:
        return content.where(F.lit(False)).select("doc_id")
    return content.where(F.lower("content").rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{N}])")).select("doc_id")


def candidates(postings: DataFrame, found: DataFrame) -> DataFrame:
    """Postings of the documents that the full-text prefilter found."""
    return postings.join(found.select("doc_id").distinct(), "doc_id", "left_semi")


def totals(ranked: DataFrame, per_page: int = 10) -> DataFrame:
    n = F.count(F.lit(1))
    return ranked.agg(n.alias("total_documents"), F.ceil(n / per_page).alias("total_pages"))
