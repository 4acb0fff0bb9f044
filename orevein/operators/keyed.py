"""Per-key results when a few keys hold most rows (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_stats(
    rows: DataFrame, key: str, *, distinct: str | None = None, first: str | None = None, by: Column | None = None, groups: tuple[str, ...] = ()
) -> DataFrame:
    """One row per value of ``key``: ``n_rows``, with ``distinct`` also ``n_distinct`` of that column, with ``first``, ``by``
    and ``groups`` also ``first_<group>``, the least ``first`` among rows whose ``by`` is that group.

    Every aggregate is algebraic, so each input partition folds its rows into a hash table of bounded memory (Spark turns to
    sorting and spills where it fills up) and only one small state per key and partition is shuffled: a key that holds a third
    of all rows reaches its reducer as at most as many states as there are partitions. Counting distinct values adds one level,
    whose states are keyed by (key, value): the rows of a hot key spread over all reducers there, and the second level again
    receives one state per key and partition.

    Nulls: a null key is a key of its own; a null in ``distinct`` is not counted; a null in ``by`` or ``first`` belongs to no
    group. An empty input gives no rows. Repeated rows count each time in ``n_rows``. Other columns, whatever their names, are not
    looked at.
    """
    names = [f"first_{g}" for g in groups]
    mins = [F.col(first) if by is None else F.when(by == g, F.col(first)) for g in groups] if first else []
    cols = [F.col(key).alias("_key")] + [m.alias(f"_m{i}") for i, m in enumerate(mins)]
    if distinct:
        cols.append(F.col(distinct).alias("_value"))
    level = rows.select(*cols)
    least = lambda: [F.min(f"_m{i}").alias(f"_m{i}") for i in range(len(mins))]
    if distinct:
        level = level.groupBy("_key", "_value").agg(F.count(F.lit(1)).alias("_n"), *least())
        level = level.groupBy("_key").agg(F.sum("_n").alias("_n"), F.count("_value").alias("_d"), *least())
    else:
        level = level.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), *least())
    out = [F.col("_key").alias(key), F.col("_n").alias("n_rows")] + ([F.col("_d").alias("n_distinct")] if distinct else [])
    return level.select(*out, *[F.col(f"_m{i}").alias(n) for i, n in enumerate(names[: len(mins)])])


def heavy_keys(rows: DataFrame, key: str, share: float = 0.02) -> DataFrame:
    """``(key, n_rows)`` of the keys that hold at least ``share`` of all rows, rows with a null key included in the total.

    A null is no key. The total is a scalar subquery over a second scan of the one column (answered by a count, nothing is shuffled
    but one number per partition).
    """
    stats = keyed_stats(rows, key).where(F.col(key).isNotNull())
    total = rows.select(F.count(F.lit(1)).alias("_total"))
    return stats.where(F.col("n_rows") >= F.lit(share) * total.scalar())
