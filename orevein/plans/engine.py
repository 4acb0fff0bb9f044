"""The search engine over stored tables: parse, rank, page, snippets; rankings of late queries are kept for a while."""

from __future__ import annotations

import time
from array import array
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.index import stored_postings
from ..operators.snippets import snippets
from ..sources.tables import load
from .query import Query, parse

#: Documents kept of a ranking: 24 bytes each, with the cache's entries 72 MB at most.
KEPT = 1000


class TtlCache:
    """At most ``size`` entries, each for ``seconds`` after it was written; the oldest go first."""

    def __init__(self, size: int = 3000, seconds: float = 1800, clock=time.monotonic):
        self.size, self.seconds, self.clock, self.kept = size, seconds, clock, OrderedDict()

    def get(self, key, make):
        now = self.clock()
        if key in self.kept and now - self.kept[key][0] < self.seconds:
            return self.kept[key][1]
        value = make()
        self.kept.pop(key, None)
        self.kept[key] = (now, value)
        while len(self.kept) > self.size:
            self.kept.popitem(last=False)
        return value


@dataclass(frozen=True)
class Response:
    results: list[dict]
    total_pages: int
    total_documents: int
    time_ms: float


class SearchEngine:
    """Search over ``documents``, ``words`` and ``document_words``.

    ``match='stem'`` finds all words with the stems of the query's. ``full_text`` ``(doc_id, content)``: an optional prefilter, documents whose
    full text holds none of the query's words are left out before postings are looked at.
    """

    def __init__(self, documents: DataFrame, words: DataFrame, postings: DataFrame, *, match: str = "exact", phrase_stopwords: str = "keep", full_text: DataFrame | None = None):
        if match not in ("exact", "stem") or phrase_stopwords not in ("keep", "drop"):
            raise ValueError("match is exact or stem, phrase_stopwords is keep or drop")
        self.documents, self.words, self.postings, self.full_text = documents, words, postings, full_text
        self.match, self.phrase_stopwords = match, phrase_stopwords
        self.cache = TtlCache()

    @classmethod
    def over(cls, spark: SparkSession, base: str, **options) -> SearchEngine:
        return cls(*(load(spark, base, t) for t in ("documents", "words", "document_words")), **options)

    def stems(self, query: Query) -> DataFrame:
        """``(stem)`` of the query's words: the one stored with the word, or the Porter stem of a word that the vocabulary lacks."""
        asked = self.words.sparkSession.createDataFrame([(t, s) for t, s in zip(query.tokens, query.stems, strict=True)], "word string, _porter string")
        known = self.words.where(F.col("word").isin(*query.tokens)).select("word", "stem")
        return asked.join(known, "word", "left").select(F.coalesce("stem", "_porter").alias("stem")).distinct()

    def wanted(self, query: Query) -> DataFrame:
        """The rows of the vocabulary that the query asks for."""
        if query.is_phrase:
            return self.words.where(F.col("word").isin(*sorted({w for p in query.phrase_words() for w in p})))
        elif not query.tokens:
            return self.words.where(F.lit(False))
        elif self.match == "stem":
            # as many rows as the query has words, at most
            return self.words.join(F.broadcast(self.stems(query)), "stem", "left_semi")
        return self.words.where(F.col("word").isin(*query.tokens))

    def hits(self, query: Query) -> DataFrame:
        """Postings of the query's words only: the vocabulary is filtered before postings are joined with it."""
        found = stored_postings(self.postings, self.wanted(query))
        return found if self.full_text is None else R.candidates(found, R.full_text_match(self.full_text, query.search_terms()))

    def rank(self, text: str) -> DataFrame:
        """All documents found, with scores."""
        query = parse(text)
        hits, idf = self.hits(query), self.wanted(query).select("word", "idf")
        if query.is_phrase:
            phrases = query.phrase_words()
            if self.phrase_stopwords == "drop":
                phrases = [list(parse(" ".join(p)).tokens) for p in phrases]
            return R.boolean_rank(phrases, list(query.operators), hits, self.documents, F.broadcast(idf))
        if self.match == "stem":
            return R.blended(R.tf_idf(hits, self.documents, idf, 0.0), self.documents)
        # one row for each of the query's words
        return R.keyword_rank(list(dict.fromkeys(query.tokens)), hits, self.documents, F.broadcast(idf))

    def page(self, text: str, page: int = 1, per_page: int = 10, results: DataFrame | None = None) -> DataFrame:
        """One page of results with snippets."""
        query = parse(text)
        results = R.result_page(self.rank(text), page, per_page) if results is None else results
        # a page's documents are per_page rows: their postings are found by a semi join before words are looked up
        near = self.postings.join(results.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
        return snippets(results, self.hits(query), stored_postings(near, self.words), query.search_terms())

    def search(self, text: str, page: int = 1, per_page: int = 10) -> Response:
        """Results as rows. Of a query's ranking the number of documents and the ids and scores of the first ``KEPT`` are kept for repeats;
        pages beyond them rank again."""
        if page < 1 or per_page < 1:
            raise ValueError("page and per_page start at 1")
        began = time.perf_counter()
        spark = self.documents.sparkSession

        def make():
            # one run: documents are counted while the best are picked
            count = Observation()
            rows = R.ordered(self.rank(text).select("doc_id", "tf_idf", "final_score").observe(count, F.count(F.lit(1)).alias("n"))).limit(KEPT).collect()
            return count.get["n"], array("q", [r[0] for r in rows]), array("d", [r[1] for r in rows]), array("d", [r[2] for r in rows])

        n, ids, tf, final = self.cache.get((parse(text).cache_key(), self.match, self.phrase_stopwords), make)
        low, high = (page - 1) * per_page, min(page * per_page, n)
        if low >= n:
            return Response([], -(-n // per_page), n, 1000 * (time.perf_counter() - began))
        shown = None
        if high <= len(ids):
            rows = [(ids[i], tf[i], final[i], i + 1) for i in range(low, high)]
            facts = self.documents.select("doc_id", "url", "title", "description")
            shown = facts.join(F.broadcast(spark.createDataFrame(rows, "doc_id long, tf_idf double, final_score double, place int")), "doc_id")
        results = [r.asDict() for r in self.page(text, page, per_page, shown).orderBy("place").collect()]
        for r in results:
            r["title"], r["description"] = r["title"] or "Untitled", r["snippet"] or r["description"] or ""
        return Response(results, -(-n // per_page), n, 1000 * (time.perf_counter() - began))
