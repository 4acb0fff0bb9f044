"""One ranking from several scores on different scales (problem 4): reciprocal rank fusion.

Items are ranked on their own by each score, and ordered by the total of 1 / (k + rank) over the scores they have. Only order within
a score counts, so no score decides by its range, and a stuck extreme value is worth a first rank and no more.

Scale. A rank is one more than the number of items with a greater value, so ranks are made from counts per different value,
which combine on the map side: a default or stuck value that a third of all items share is one row there. Values are cut into
ranges at approximate quantiles; a task sorts one range of one list, and the numbers of items in the ranges before are added, so
no list is ever sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_section, section_weight
from ..schema import SECTION_WEIGHTS
from ..session import cut

K = 60
#: Words of all queries up to which they are sent to every executor; beyond it, postings are joined with them by a shuffle.
BROADCAST_WORDS = 100_000
#: Ranges a list of values is cut into; a range holds about one in so many of its different values.
RANGES = 64


def value_ranks(scores: DataFrame, by: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """``(*by, value, n, rank)``: for each different value of a list its number of items and their rank, the greatest value first.

    Items with the same value share the rank of the first of them. Nulls and NaN have no rank.
    """
    known = scores.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = cut(known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), "values")
    steps = [i / ranges for i in range(1, ranges)]
    bounds = counts.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, steps, ranges * 20)).alias("_bounds"))
    placed = counts.join(bounds, by).withColumn("_range", F.size(F.filter("_bounds", lambda b: b > F.col(value)))).drop("_bounds")
    before = placed.groupBy(*by, "_range").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = Window.partitionBy(*by, "_range").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(before, [*by, "_range"]).withColumn("rank", F.col("_before") + F.coalesce(F.sum("n").over(within), F.lit(0)) + 1)
    return ranked.select(*by, value, "n", "rank")


def fuse(scores: DataFrame, k: int = K, ranges: int = RANGES) -> DataFrame:
    """``(query_id, doc_id, fused, n_scores, rank)`` from ``(query_id, doc_id, score, value)``.

    An item without a value in a score (null or NaN) gets nothing from it. Items with the same total share a rank. Repeated rows of an
    item in a score count once, by the greatest value. Sums are rounded to 12 places, so their order of addition is of no matter.
    """
    once = cut(scores.groupBy("query_id", "doc_id", "score").agg(F.max(F.when(~F.isnan("value"), F.col("value"))).alias("value")), "scores")
    ranks = value_ranks(once, ["query_id", "score"], "value", ranges).withColumnRenamed("rank", "_rank").drop("n")
    each = once.join(ranks, ["query_id", "score", "value"], "left")
    total = each.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.coalesce(1 / (k + F.col("_rank")), F.lit(0.0))), 12).alias("fused"), F.count("_rank").cast("int").alias("n_scores")
    )
    total = cut(total, "fused")
    final = value_ranks(total, ["query_id"], "fused", ranges).drop("n")
    return total.join(final, ["query_id", "fused"]).select("query_id", "doc_id", "fused", "n_scores", "rank")


def text_scores(queries: DataFrame, words: DataFrame, postings: DataFrame, documents: DataFrame) -> DataFrame:
    """``(query_id, doc_id, value)``: weight of a document for each query that it holds a word of.

    The sum over the query's words of their weighted frequency, by the document's size, times idf. An idf of 0 was never computed and is
    replaced by ln(N/df + 1). A posting stored twice counts once; documents without a size have no value.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("query_text"), r"\W+"), lambda w: w != ""))).alias("word"))
    wanted = cut(terms.join(words.select("word_id", "word", "idf"), "word"), "wanted")
    ids = wanted.select("word_id").distinct()
    # the queries are a stated set: with its size checked, postings of other words go no further than their scan
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_WORDS else ids
    hits = postings.select("document_id", "word_id", "word_position", "section").join(ids, "word_id", "left_semi")
    # partitioned by document once: the three steps that follow need no other exchange
    hits = hits.repartition("document_id").groupBy("document_id", "word_id", "word_position").agg(F.min(clean_section(F.col("section"))).alias("section"))
    per_word = cut(hits.groupBy("document_id", "word_id").agg(F.sum(section_weight(F.col("section"), SECTION_WEIGHTS)).alias("weight")), "weights")
    df = per_word.groupBy("word_id").agg(F.count(F.lit(1)).alias("df"))
    n = documents.select(F.count(F.lit(1)).alias("n"))
    idf = F.when(F.col("idf") > 0, F.col("idf")).otherwise(F.log(n.scalar() / F.col("df") + 1))
    weighted = wanted.join(df, "word_id").select("query_id", "word_id", idf.alias("idf"))
    sized = documents.where("document_size > 0").select("doc_id", "document_size")
    rows = per_word.join(weighted, "word_id").groupBy("query_id", "document_id").agg(F.sum(F.col("weight") * F.col("idf")).alias("total"))
    return rows.join(sized, rows["document_id"] == sized["doc_id"]).select("query_id", "doc_id", F.round(F.col("total") / F.col("document_size"), 9).alias("value"))


def search_ranking(queries: DataFrame, words: DataFrame, postings: DataFrame, documents: DataFrame, labels: DataFrame, k: int = K) -> DataFrame:
    """One ranking per query from text weight, page rank and judged quality.

    Page ranks of 0 were never computed and count as missing, as do documents without a label.
    """
    text = text_scores(queries, words, postings, documents)
    rank = documents.select("doc_id", F.when(F.col("page_rank") > 0, F.col("page_rank")).alias("page_rank"))
    quality = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    wide = text.join(rank, "doc_id").join(quality, "doc_id", "left")
    pairs = [F.struct(F.lit(n).alias("score"), F.col(c).alias("value")) for n, c in (("text", "value"), ("page_rank", "page_rank"), ("quality", "quality"))]
    long = wide.select("query_id", "doc_id", F.explode(F.array(*pairs)).alias("p")).select("query_id", "doc_id", "p.score", "p.value")
    return fuse(long, k)
