"""Query suggestions from a search history ``(term, count, last_used)`` with times in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 5


def score(term: Column, count: Column, last_used: Column, typed: str) -> Column:
    """Worth of a term for what was typed; for nothing typed, recency and count."""
    if not typed.strip():
        return last_used + count * 10000
    low, q = F.lower(term), F.lit(typed.lower())
    at = F.instr(low, typed.lower()) - 1
    hits = F.floor((F.length(low) - F.length(F.replace(low, q, F.lit("")))) / len(typed))
    match = F.when(low == q, 100).when(F.startswith(low, q), 75).when(at >= 0, 50 + F.when(at <= 3, 10).otherwise(0)).otherwise(0)
    match = match + F.when(hits > 1, 5 * hits).otherwise(0)
    return match * 1000 + 100 * F.log(count + 1) + last_used / 1e6


def suggestions(history: DataFrame, typed: str, top: int = TOP) -> DataFrame:
    """``(term, score)`` of the best terms that hold what was typed, in any case; ties by term."""
    rows = history.where(F.trim("term") != "")
    if typed.strip():
        rows = rows.where(F.contains(F.lower("term"), F.lit(typed.lower())))
    rated = rows.select("term", F.round(score(F.col("term"), F.col("count"), F.col("last_used"), typed), 6).alias("score"))
    return rated.orderBy(F.desc("score"), "term").limit(top)


def highlight(term: Column, typed: str) -> Column:
    """Struct of the part before the first hit, the hit and the rest; no hit leaves everything before."""
    at = F.instr(F.lower(term), typed.lower()) if typed else F.lit(0)
    return F.when(
        at > 0, F.struct(F.substring(term, F.lit(1), at - 1).alias("before"), F.substring(term, at, F.lit(len(typed))).alias("hit"), F.substring(term, at + len(typed), F.length(term)).alias("after"))
    ).otherwise(F.struct(term.alias("before"), F.lit("").alias("hit"), F.lit("").alias("after")))


def pager(page: int, total: int, around: int = 1) -> list[int | str]:
    """Page numbers to show: first, last and those around the current one, dots for the gaps."""
    if total <= 0:
        return []
    shown = sorted({1, total, *range(max(1, page - around), min(total, page + around) + 1)})
    out: list[int | str] = []
    for i, n in enumerate(shown):
        if i and n - shown[i - 1] == 2:
            out.append(n - 1)
        elif i and n - shown[i - 1] > 2:
            out.append("...")
        out.append(n)
    return out
