"""References to records that do not exist (problem 3)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Bits of one bitmap, as bitmap_construct_agg makes them.
RANGE = 32768
#: Period of references without a time: after all others, so they are compared with every parent there is.
NO_PERIOD = 1 << 24
_SURVIVORS = "code long, period int"


def month_index(when: Column) -> Column:
    """Calendar months counted from year 0; ``NO_PERIOD`` where there is no time."""
    return F.coalesce(F.year(when) * 12 + F.month(when) - 1, F.lit(NO_PERIOD)).cast("int")


def month_start(index: Column) -> Column:
    """First day of a month index, null for ``NO_PERIOD``."""
    return F.when(index != NO_PERIOD, F.make_date(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1)))


#: Kinds of containers: sorted bits of two bytes each, runs of a first bit and a length of two bytes each, all bits of the range.
ARRAY, RUNS, BITMAP = 0, 1, 2


def compress(bits: bytes) -> bytes:
    """The smallest container of a range's bitmap, its kind in the first byte."""
    places = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    first = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    options = [(2 * len(places), ARRAY), (4 * len(first), RUNS), (len(bits), BITMAP)]
    kind = min(options)[1]
    if kind == BITMAP:
        return bytes([BITMAP]) + bits
    if kind == ARRAY:
        return bytes([ARRAY]) + places.astype("<u2").tobytes()
    lengths = np.diff(first, append=len(places))
    return bytes([RUNS]) + np.stack([places[first], lengths - 1], axis=1).astype("<u2").tobytes()


def expand(container: bytes) -> np.ndarray:
    """A container's range as an array of truth values."""
    kind, rest = container[0], container[1:]
    if kind == BITMAP:
        return np.unpackbits(np.frombuffer(rest, np.uint8), bitorder="little").view(bool)
    out = np.zeros(RANGE, bool)
    values = np.frombuffer(rest, "<u2").astype(np.int64)
    if kind == ARRAY:
        out[values] = True
        return out
    edges = np.zeros(RANGE + 1, np.int32)
    np.add.at(edges, values[::2], 1)
    np.add.at(edges, values[::2] + values[1::2] + 1, -1)
    return np.cumsum(edges[:-1]) > 0


@F.pandas_udf(T.BinaryType())
def compressed(bits: pd.Series) -> pd.Series:
    return bits.map(compress)


def and_not(rows: pd.DataFrame) -> pd.DataFrame:
    """Codes that are referred to in a period and in no parent bitmap up to it; all rows are of one key range."""
    base = int(rows["bucket"].iloc[0]) * RANGE
    there = np.zeros(RANGE, bool)
    codes, periods = [], []
    # parents of a period count from its beginning on, so they come before its references
    for row in rows.sort_values(["period", "is_ref"]).itertuples():
        bits = expand(row.bits)
        if not row.is_ref:
            there |= bits
            continue
        left = np.flatnonzero(bits & ~there)
        codes.append(left + base)
        periods.append(np.full(len(left), row.period, np.int32))
    none = np.zeros(0, np.int64)
    return pd.DataFrame({"code": np.concatenate([*codes, none]), "period": np.concatenate([*periods, none.astype(np.int32)])})


def orphan_keys(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """``(field, key, period)``: keys that are referred to in a period although no parent has them by the end of it.

    ``refs``: ``(field, key, period)``, ``parents``: ``(field, key, since)``, keys strings, periods integers that grow with time.

    1. Dictionary: the keys of both sides get integers, their row numbers. It holds nothing else, and is written to the shared folder, as
       row numbers may not change when a lost executor's work is repeated.
    2. Encoding: each side is folded by key on the map side first (the periods of its references, the earliest one of its parents), however
       often the key stands there, and then joined with the dictionary, each on its own.
    3. Bitmaps: one of 32 768 bits per key range and period for references and for parents, compressed to the smallest of three kinds of containers:
       sorted bits, runs or all bits. Ranges without a bit are not stored.
    4. Reference AND-NOT parent: a task holds the bitmaps of one key range, walks through the periods and takes the parents seen so far out
       of the references.
    5. The surviving bits are decoded by the dictionary.

    Null keys refer to nothing and null ``since`` is no parent. Empty inputs give no rows.
    """
    refs = refs.select("field", "key", "period").where("key is not null")
    parents = parents.select("field", "key", "since").where("key is not null and since is not null")
    keys = refs.select("field", "key").unionByName(parents.select("field", "key")).distinct()
    coded = cut(keys.withColumn("code", F.monotonically_increasing_id()), "dictionary")
    referred = refs.groupBy("field", "key").agg(F.collect_set("period").alias("periods")).join(coded, ["field", "key"]).select("code", F.explode("periods").alias("period"))
    there = parents.groupBy("field", "key").agg(F.min("since").alias("period")).join(coded, ["field", "key"]).select("code", "period")

    def bitmaps(rows: DataFrame, is_ref: bool) -> DataFrame:
        bits = rows.select(F.shiftright("code", 15).alias("bucket"), F.col("code").bitwiseAND(RANGE - 1).alias("bit"), "period")
        made = bits.groupBy("bucket", "period").agg(F.bitmap_construct_agg("bit").alias("bits"))
        return made.select("bucket", "period", compressed("bits").alias("bits"), F.lit(is_ref).alias("is_ref"))

    left = bitmaps(referred, True).unionByName(bitmaps(there, False)).groupBy("bucket").applyInPandas(and_not, _SURVIVORS)
    return left.join(coded, "code").select("field", "key", "period")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``refs`` whose key is an orphan in their period.

    A semi join on (field, key, period); a target that very many rows point to is one row on its right side and, on its left,
    a partition that adaptive execution splits.
    """
    left = orphan_keys(refs, parents)
    return refs.join(left, ["field", "key", "period"], "left_semi")


def orphan_report(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """``(field, month, n_orphans, n_keys)``: orphan references and the different keys they name, by field and calendar month."""
    counts = refs.groupBy("field", "key", "period").agg(F.count(F.lit(1)).alias("n"))
    left = counts.join(orphan_keys(refs, parents), ["field", "key", "period"], "left_semi")
    out = left.groupBy("field", "period").agg(F.sum("n").alias("n_orphans"), F.count(F.lit(1)).alias("n_keys"))
    return out.select("field", month_start(F.col("period")).alias("month"), "n_orphans", "n_keys")

