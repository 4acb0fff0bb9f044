"""Joins with one side's facts about a key, and running numbers, that stay even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, estimated_bytes

#: Facts up to this size, by the optimizer's estimate, are sent to all executors.
BROADCAST_BYTES = 64 << 20
#: A key with more than this part of all rows is hot, so there are fewer hot keys than this.
HOT_PARTS = 1000


def facts_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "left", broadcast_bytes: int | None = None) -> DataFrame:
    """``rows.join(facts, key, how)`` for ``how`` left or inner, without a task that holds all rows of a key.

    Facts of a checked size are broadcast. Larger ones are joined by key, hot keys salted: rows are counted by key (map-side), keys with
    more than a thousandth of all rows get a salt for each thousandth, their facts are repeated once per salt (2000 times at most
    in all) and their rows dealt to the salts at random by their whole content. Rows with a null key meet no facts and are dealt as well.
    """
    if estimated_bytes(facts) <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        return rows.join(F.broadcast(facts), key, how)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.select(F.count(F.lit(1)).alias("_t")).scalar()
    hot = F.broadcast(counts.where(F.col(key).isNotNull() & (F.col("_n") * HOT_PARTS > total)).select(key, F.ceil(F.col("_n") * HOT_PARTS / total).cast("int").alias("_salts")))
    width = F.when(F.col(key).isNull(), HOT_PARTS).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), width).cast("int")).drop("_salts")
    each = facts.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(each, [key, "_salt"], how).drop("_salt")


def numbered(rows: DataFrame, order: str, name: str = "number") -> DataFrame:
    """``rows`` with running numbers from 0 in the order of a column, without a single task that sorts them all.

    Ranges are sorted apart and written to the shared folder (row numbers may not change when lost work is repeated); one count per
    range gives what is added to its numbers. Rows that agree in ``order`` are numbered in any order.
    """
    placed = cut(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = sorted(placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_part"])  # one row per range
    before, seen = {}, 0
    for r in sizes:
        before[r["_part"]] = seen
        seen += r["n"]
    if not before:
        return placed.drop("_at").withColumn(name, F.lit(0).cast("long"))
    offset = F.create_map(*[x for k, v in before.items() for x in (F.lit(k), F.lit(v))])
    return placed.select(*rows.columns, (offset[F.shiftright("_at", 33)] + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long").alias(name))
