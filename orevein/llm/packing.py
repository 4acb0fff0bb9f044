"""Documents into containers of fixed capacity (problem 8): hierarchical packing in tiers of lengths.

A document longer than the capacity is cut into full containers and a rest; nothing else is ever split. Items are routed to tiers by the context
size that holds them: tier 0 above a half of the capacity, tier 1 above a quarter and so on. Tiers are packed one after the other, the longest
first, each on its own: an item goes to the fullest of the tier's containers that has room for it, else it opens one. Before
the next tier is packed, the gaps of the containers just made are filled from the shorter tiers, the longest item that fits first.
All containers of a kind, the full ones among them, are then dealt to step groups so that groups hold about the same number of tokens.

Scale: token counts are made once and written to a table. Items are spread over shards by a hash, so each shard has the mix of
lengths of all; a shard holds a bounded number of items, is packed by one task, and wastes one container at most on
being apart. Full containers need no packing and stay out of it, so a text of any length is no burden to a shard. For the step groups containers are
ranked by their tokens over all shards, by counts of containers with the same number of tokens and one offset per shard: nothing is
sorted but those counts, of which a kind and number of tokens has at most one a shard.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that goes with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items in a shard, about; a hash spreads them, so shards differ little.
SHARD_ITEMS = 20_000
#: Containers in a step group.
GROUP_CONTAINERS = 8
#: Tiers; the last one takes all shorter items.
TIERS = 7


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)`` of whole texts; a missing text has none, documents without an id are left out."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer).encode_ordinary
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in frame["text"]]})

    return spread(documents.select("doc_id", "text").where("doc_id is not null")).mapInPandas(batches, "doc_id long, n_tokens long")


def tier_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Tier of each item: 0 above a half of the capacity, 1 above a quarter and so on."""
    halves = capacity / np.maximum(sizes, 1)
    return np.minimum(np.floor(np.log2(np.maximum(halves, 1))), TIERS - 1).astype(np.int32)


class _Left:
    """Items by size that are not packed yet; finds the greatest size up to a bound in about constant time (path compression)."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.order = np.argsort(sizes, kind="stable")
        self.starts = np.searchsorted(sizes[self.order], np.arange(capacity + 2))
        self.left = np.diff(self.starts).tolist()
        self.below = list(range(capacity + 1))

    def longest(self, size: int) -> int:
        path, left, below = [], self.left, self.below
        while size > 0 and not left[size]:
            path.append(size)
            size = below[size] if below[size] < size else size - 1
        for x in path:
            below[x] = size
        return size

    def take(self, size: int) -> int:
        self.left[size] -= 1
        return int(self.order[self.starts[size] + self.left[size]])


def pack(sizes: np.ndarray, capacity: int, tiered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item (none is longer than the capacity) and the tokens in each container.

    ``tiered`` false packs all items as one tier. Items without tokens take no room and go to the first container.
    """
    items = _Left(sizes, capacity)
    where, fill = np.zeros(len(sizes), np.int64), []
    floors = [capacity >> (t + 1) for t in range(TIERS - 1)] + [0] if tiered else [0]
    for floor in floors:
        # the tier on its own: its containers in the order of the room they have left
        rooms: list[tuple[int, int]] = []
        first = len(fill)
        while (size := items.longest(capacity)) > floor:
            at = bisect_left(rooms, (size, -1))
            room, box = rooms.pop(at) if at < len(rooms) else (capacity, len(fill))
            if box == len(fill):
                fill.append(0)
            where[items.take(size)] = box
            fill[box] += size
            insort(rooms, (room - size, box))
        # the gaps of its containers, from the shorter tiers
        for box in range(first, len(fill)):
            while fill[box] < capacity and (size := items.longest(capacity - fill[box])) > 0:
                where[items.take(size)] = box
                fill[box] += size
    if not fill and len(sizes):
        fill.append(0)
    return where, np.array(fill, np.int64)


_SHARD = "container_kind string, capacity long, shard long, doc_id long, full long, offset long, n_tokens long, tier int, place long, fill long, nth long"
_PACKED = "container_kind string, doc_id long, piece int, n_tokens long, tier int, container string, step_group string"


def _pack_shard(frame: pd.DataFrame) -> pd.DataFrame:
    """Containers of a shard's rests: their place, their tokens and which one they are of those with as many, full containers first; and the number of full
    containers that come before each document's own."""
    capacity = int(frame["capacity"].iloc[0])
    # a fixed order, so a repeated task packs the same
    frame = frame.sort_values(["doc_id", "full", "n_tokens"], kind="stable").reset_index(drop=True)
    sizes = frame["n_tokens"].to_numpy()
    where, fill = pack(sizes, capacity)
    nth = pd.Series(fill).groupby(fill).cumcount().to_numpy() + np.where(fill == capacity, int(frame["full"].sum()), 0)
    frame["offset"] = frame["full"].cumsum() - frame["full"]
    frame["tier"] = tier_of(sizes, capacity)
    frame["place"], frame["fill"], frame["nth"] = where, fill[where], nth[where]
    return frame[["container_kind", "capacity", "shard", "doc_id", "full", "offset", "n_tokens", "tier", "place", "fill", "nth"]]


def container_ranks(packed: DataFrame) -> DataFrame:
    """``(container_kind, shard, ranks, containers)`` from packed shards: how many of the kind's containers come before those of the shard, for each
    number of tokens it has, as a map; containers rank by their tokens, the fullest first, then by shard. ``containers``: those of the kind."""
    mixed = packed.groupBy("container_kind", "shard", "fill").agg((F.max("nth") + 1).alias("n"))
    whole = packed.where("full > 0").groupBy("container_kind", "shard", F.col("capacity").alias("fill")).agg(F.sum("full").alias("n"))
    counts = mixed.unionByName(whole).groupBy("container_kind", "shard", "fill").agg(F.max("n").alias("n"))
    # at most one row a shard for each number of tokens
    along = Window.partitionBy("container_kind", "fill").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("inside", F.coalesce(F.sum("n").over(along), F.lit(0)))
    totals = counts.groupBy("container_kind", "fill").agg(F.sum("n").alias("total"))
    # at most one row for each number of tokens up to the capacity
    above = Window.partitionBy("container_kind").orderBy(F.desc("fill")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("above", F.coalesce(F.sum("total").over(above), F.lit(0))).withColumn("containers", F.sum("total").over(Window.partitionBy("container_kind")))
    rows = inside.join(F.broadcast(totals), ["container_kind", "fill"])
    return rows.groupBy("container_kind", "shard").agg(F.map_from_entries(F.collect_list(F.struct("fill", F.col("above") + F.col("inside")))).alias("ranks"), F.max("containers").alias("containers"))


def step_group(rank: Column, containers: Column, per_group: int = GROUP_CONTAINERS) -> Column:
    """Step group of the container with this rank: dealt in the order of tokens, there and back, so groups are even in tokens and number."""
    groups = F.ceil(containers / per_group)
    turn, at = F.floor(rank / groups), rank % groups
    return F.when(turn % 2 == 0, at).otherwise(groups - 1 - at)


def pack_documents(counts: DataFrame, containers: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(container_kind, doc_id, piece, n_tokens, tier, container, step_group)`` from ``(doc_id, n_tokens)`` for each kind of container.

    ``piece`` numbers the parts of a document longer than the capacity; other documents have piece 0 only. Every document comes out for
    every kind, those without tokens too; repeated rows are items of their own. Capacities that are null or below 1 are left out.
    ``tier`` is 0 above half of the capacity, 1 above a quarter and so on. The packed shards are written to the shared folder. The result is
    not the least possible number of containers, which is hard to find; see the README for the fill reached.
    """
    # the kinds are a stated handful of rows
    kinds = containers.where("capacity_tokens >= 1").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity")).orderBy("container_kind").collect()
    if not kinds:
        return counts.sparkSession.createDataFrame([], _PACKED)
    n = counts.count()
    shards = max(1, -(-n // shard_items))
    # every document is repeated once for each kind, which is the result's own size
    each = F.explode(F.array(*[F.struct(F.lit(r["container_kind"]).alias("container_kind"), F.lit(int(r["capacity"])).cast("long").alias("capacity")) for r in kinds]))
    both = counts.select("*", each.alias("kind")).select("doc_id", "n_tokens", "kind.container_kind", "kind.capacity")
    sized = both.select("container_kind", "capacity", "doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).withColumn("full", F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / F.col("capacity")))
    rest = sized.select("container_kind", "capacity", "doc_id", "full", (F.col("n_tokens") - F.col("full") * F.col("capacity")).alias("n_tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    packed = cut(rest.groupBy("container_kind", "shard").applyInPandas(_pack_shard, _SHARD), "packed")
    ranked = packed.join(container_ranks(packed), ["container_kind", "shard"])
    rows = ranked.select("*", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("piece"))
    is_full = F.col("piece") < F.col("full")
    number = F.col("offset") + F.col("piece")
    rank = F.when(is_full, F.element_at("ranks", F.col("capacity")) + number).otherwise(F.element_at("ranks", F.col("fill")) + F.col("nth"))
    named = lambda part, number: F.concat_ws("-", "container_kind", "shard", part, number)
    return rows.select(
        "container_kind", "doc_id", F.col("piece").cast("int").alias("piece"), F.when(is_full, F.col("capacity")).otherwise(F.col("n_tokens")).alias("n_tokens"), F.when(is_full, 0).otherwise(F.col("tier")).alias("tier"),
        F.when(is_full, named(F.lit("full"), number)).otherwise(named(F.lit("mix"), F.col("place"))).alias("container"),
        F.concat_ws("-", "container_kind", step_group(rank, F.col("containers"))).alias("step_group"),
    )


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``(container_kind, capacity_tokens, n_containers, n_tokens, fill)``: how full the containers of each kind are."""
    each = packed.groupBy("container_kind", "container").agg(F.sum("n_tokens").alias("n")).groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"))
    return each.join(containers, "container_kind").select("container_kind", "capacity_tokens", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill"))
