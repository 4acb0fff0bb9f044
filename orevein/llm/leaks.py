"""Evaluation texts inside training texts (problem 9).

Seeds are the word n-grams of the test items. A document and an item become a candidate pair where the document holds one of the item's
seeds, and has the words of some stretch of the item as long as asked for, but for as many as may be changed: no passage has fewer. Of a
passage in b + 1 parts one seed at least is whole if it has more than 4 b + 4 words. Candidates are aligned by Smith-Waterman over words, with one step
more than usual: from the end of a line the alignment may continue at the beginning of a later one, so foreign lines between the parts of a
passage cost a constant. The best alignment's longest stretch within the allowed edits decides, unless it is of like wording only: of
its rare words (names and numbers, as a rule) none is the same, or more than one and more than a third are changed, and edits that strike
any word alike, as many as are allowed, would strike so many of them with a chance below ``LIKE_CHANCE`` only.

Scale: documents are read once and nothing is shuffled. The items are the stated set: words become numbers and seeds sorted arrays of hashes, some
30 bytes a word, so a pass over the documents takes ``BLOCK_WORDS`` words of items, and only a set beyond that takes further passes. Words are counted
over all items before, so a block's border changes nothing. The documents of a batch are looked up together. There is no limit on documents per item, items
per document or on the length of a text; an alignment keeps two bytes for each pair of an item's word and a word of the window it is aligned with.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, repeat
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

GRAM = 3
#: A word that stands in more items than this is not rare, unless it is a number.
RARE_ITEMS = 2
#: Words of items that one pass over the documents takes: the bound of what is sent to the executors.
BLOCK_WORDS = 4_000_000
#: Pairs of words that one alignment may hold before its window is cut into overlapping ones.
CELLS = 50_000_000
MIN_COVER = 0.4
MAX_EDITS = 1 / 6
#: Chance of so many changed rare words below which the edits picked them.
LIKE_CHANCE = 0.025
MISMATCH, GAP, SKIP = 1, 1, 2
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` codes from each place on; one that meets a code below 0 means nothing."""
    out = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(out)].astype(np.uint64) + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out


class Items:
    """Test items by the numbers of their words, with an index of their n-grams.

    ``df``: items that hold each word, where ``rows`` are a block of more. Items of fewer than 8 words have pairs of words as seeds instead
    of threes, those of one word that word.
    """

    def __init__(self, rows: list[tuple[int, str]], min_cover: float = MIN_COVER, df: Counter | None = None):
        texts = [words(t or "") for _, t in rows]
        self.ids = [i for i, _ in rows]
        self.code: dict[str, int] = {w: k for k, w in enumerate(dict.fromkeys(w for ws in texts for w in ws))}
        self.coded = [np.fromiter(map(self.code.__getitem__, ws), np.int32, len(ws)) for ws in texts]
        df = Counter(w for ws in texts for w in set(ws)) if df is None else df
        rare = np.array([df[w] <= RARE_ITEMS or w.isnumeric() for w in self.code], bool)
        self.rare = [rare[c] for c in self.coded]
        # an edit at the very end of a passage leaves the alignment a word short; too few words allow no edit
        self.slack = [1 if min_cover * len(ws) * MAX_EDITS >= 1 else 0 for ws in texts]
        self.least = np.array([max(1, ceil(min_cover * len(ws) - k - 1e-6)) for ws, k in zip(texts, self.slack, strict=True)])
        self.size = [GRAM if len(ws) >= 2 * GRAM + 2 else min(2, len(ws)) for ws in texts]
        self.seeds = {}
        for size in sorted(set(self.size) - {0}):
            made = [(_hashes(c, size), k) for k, c in enumerate(self.coded) if self.size[k] == size]
            seeds, owners = np.concatenate([h for h, _ in made]), np.concatenate([np.full(len(h), k, np.int32) for h, k in made])
            order = np.lexsort((owners, seeds))
            seeds, owners = seeds[order], owners[order]
            fresh = np.ones(len(seeds), bool)
            fresh[1:] = (seeds[1:] != seeds[:-1]) | (owners[1:] != owners[:-1])
            seeds, owners = seeds[fresh], owners[fresh]
            self.seeds[size] = (seeds, owners)
        self.present = np.zeros(len(self.code) + 1, bool)
        self.flat, self.lengths = np.concatenate([*self.coded, np.zeros(0, np.int32)]), np.array([len(c) for c in self.coded], np.int64)
        self.offset = np.cumsum(self.lengths) - self.lengths

    def codes(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.code.get, ws, repeat(-1)), np.int32, len(ws))

    def pairs(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        """Texts and items that share a seed: ``codes`` of many texts, the one of number i from ``starts[i]`` on."""
        found = []
        for size, (seeds, owners) in self.seeds.items():
            hashes = _hashes(codes, size)
            low = np.searchsorted(seeds, hashes)
            hit = np.flatnonzero((low < len(seeds)) & (seeds[np.minimum(low, len(seeds) - 1)] == hashes))
            text = np.searchsorted(starts, hit, "right") - 1
            inside = text == np.searchsorted(starts, hit + size - 1, "right") - 1
            for i in range(size):
                inside &= codes[hit + i] >= 0
            # a seed counts once a text, however often it stands there
            once = np.unique(np.stack([text[inside], low[hit[inside]]], axis=1), axis=0)
            n = np.searchsorted(seeds, seeds[once[:, 1]], "right") - once[:, 1]
            at = np.repeat(once[:, 1] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            found.append(np.unique(np.stack([np.repeat(once[:, 0], n), owners[at]], axis=1), axis=0))
        yield from (map(tuple, np.concatenate(found).tolist()) if found else ())

    def candidates(self, ws: list[str]) -> list[int]:
        """Items whose passages the text may hold."""
        codes = self.codes(ws)
        return self.possible([k for _, k in self.pairs(codes, np.array([0]))], codes)

    def possible(self, items: list[int], codes: np.ndarray) -> list[int]:
        """Those of ``items`` some stretch of which, as long as asked for, lacks no more words of the text than may be changed."""
        self.present[codes] = True
        self.present[-1] = False  # of words in no item
        out, at_once = [], max(1, 200_000 // max(1, int(self.lengths[items].max(initial=0))))
        for a in range(0, len(items), at_once):
            some = np.array(items[a : a + at_once])
            n, least = self.lengths[some], self.least[some]
            place = np.arange(n.max(initial=0))
            there = self.present[self.flat[np.minimum(self.offset[some][:, None] + place, len(self.flat) - 1)]] if len(self.flat) else np.zeros((len(some), 0), bool)
            sums = np.zeros((len(some), len(place) + 1))
            np.cumsum(np.where((place < n[:, None]) & there, MAX_EDITS, MAX_EDITS - 1), axis=1, out=sums[:, 1:])
            low = np.minimum.accumulate(sums, axis=1)
            begin = np.arange(len(place) + 1) - least[:, None]
            good = ((begin >= 0) & (sums >= np.take_along_axis(low, np.maximum(begin, 0), axis=1) - 1e-6)).any(axis=1)
            out += some[good].tolist()
        self.present[codes] = False
        return out


def align(item: np.ndarray, text: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Smith-Waterman of item and text word codes. ``starts``: whether a text word begins a line.

    The steps of the best alignment in order, as (kind, place in the item): 0 match, 1 changed, 2 added in the text, 3 dropped. Scores are whole numbers
    and kept with the cost of dropping all item words before added, so a row is a running maximum and takes two bytes a cell.
    """
    n, m = len(item), len(text)
    ramp = (GAP * np.arange(n + 1)).astype(np.int16 if n < 15_000 else np.int32)
    table = np.zeros((m + 1, n + 1), ramp.dtype)
    table[0] = ramp
    jumps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    skip, skip_row = np.full(n + 1, -10_000, ramp.dtype), np.zeros(n + 1, np.int32)
    diagonal = np.zeros(n, ramp.dtype)
    some_rows = max(1, 1_000_000 // (n + 1))
    for r in range(1, m + 1):
        if (r - 1) % some_rows == 0:
            gain = np.where(item[None, :] == text[r - 1 : r - 1 + some_rows, None], 1 + GAP, GAP - MISMATCH).astype(ramp.dtype)
        above, row = table[r - 1], table[r]
        if starts[r - 1] and r > 1:
            better = above - SKIP > skip
            np.copyto(skip, above - SKIP, where=better)
            np.copyto(skip_row, r - 1, where=better)
            jump = np.flatnonzero(skip > above)
            if len(jump):
                above = np.maximum(above, skip)
                jumps[r] = (jump.astype(np.int32), skip_row[jump])
        np.subtract(above, GAP, out=row)
        np.add(above[:-1], gain[(r - 1) % some_rows], out=diagonal)
        np.maximum(row[1:], diagonal, out=row[1:])
        np.maximum(row, ramp, out=row)
        np.maximum.accumulate(row, out=row)

    def score(r: int, j: int) -> int:
        return int(table[r, j]) - int(ramp[j])

    def above_of(r: int, j: int) -> tuple[int, int]:
        """The row that cell (r, j) continues from above, and the score there less the jump."""
        if r in jumps:
            places, rows = jumps[r]
            at = bisect_left(places, j)
            if at < len(places) and places[at] == j:
                return int(rows[at]), score(int(rows[at]), j) - SKIP
        return r - 1, score(r - 1, j)

    best, r, j = 0, 0, 0
    for a in range(0, m + 1, some_rows):
        part = table[a : a + some_rows] - ramp
        top = int(part.argmax())
        if part.flat[top] > best:
            best, r, j = part.flat[top], a + top // (n + 1), top % (n + 1)
    steps = []
    while r > 0 and (value := score(r, j)) > 0:
        if j:
            row, prior = above_of(r, j - 1)
            same = item[j - 1] == text[r - 1]
            if value == prior + (1 if same else -MISMATCH):
                steps.append((0 if same else 1, j - 1))
                r, j = row, j - 1
                continue
            if value == score(r, j - 1) - GAP:
                steps.append((3, j - 1))
                j -= 1
                continue
        steps.append((2, j))
        r = above_of(r, j)[0]
    return steps[::-1]


@lru_cache(maxsize=100_000)
def chance(n: int, edits: int, rare: int, changed: int) -> float:
    """Chance that of ``edits`` words drawn from ``n``, ``rare`` of them rare, ``changed`` or more are rare ones."""
    return sum(comb(rare, k) * comb(n - rare, edits - k) for k in range(changed, min(rare, edits) + 1)) / comb(n, edits)


def covered(steps: list[tuple[int, int]], rare: np.ndarray, max_edits: float = MAX_EDITS) -> int:
    """Item words in the longest stretch of an alignment whose edits are at most that share of its words, and whose changed rare words
    are no more than the allowed edits explain. All stretches are looked at, those from some hundred places at a time."""
    if not steps:
        return 0
    kind, place = np.array([k for k, _ in steps]), np.array([j for _, j in steps])
    of_item = kind != 2
    is_rare = of_item & rare[np.minimum(place, len(rare) - 1)]
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (of_item, kind > 0, is_rare, is_rare & (kind > 0))]
    best, doubts = 0, []
    at_once = max(1, 500_000 // len(sums[0]))
    for a in range(0, len(sums[0]), at_once):
        length, edits, names, changed = (s[None, :] - s[a : a + at_once, None] for s in sums)
        good = (edits <= max_edits * length + 1e-9) & (length > 0)
        doubtful = good & (3 * changed > names)
        best = max(best, int(np.where(good & ~doubtful, length, 0).max()))
        doubtful &= (length > best) & (changed < names)
        if doubtful.any():
            doubts.append(np.unique(np.stack([x[doubtful] for x in (length, (length * max_edits + 1e-9).astype(int), names, changed)], axis=1), axis=0))
    if doubts:
        cases = np.unique(np.concatenate(doubts), axis=0)[::-1].tolist()
        best = next((c[0] for c in cases if c[0] > best and (c[3] == 1 or chance(*c) >= LIKE_CHANCE)), best)
    return best


def leak(items: Items, k: int, codes: np.ndarray, starts: np.ndarray) -> float:
    """Share of item ``k``'s words that a text of these word codes holds as one passage; ``starts``: whether a word begins a line."""
    item = items.coded[k]
    n = len(item)
    if not n:
        return 0.0
    size = items.size[k]
    hits = np.flatnonzero(np.isin(_hashes(codes, size), _hashes(item, size)) & (codes[: len(codes) - size + 1] >= 0)) if len(codes) >= size else np.zeros(0, int)
    if not len(hits):
        hits = np.flatnonzero(np.isin(codes, item))
    best, reach = 0, 3 * n + 40
    # hits far from each other are aligned on their own
    for near in np.split(hits, np.flatnonzero(np.diff(hits) > reach) + 1) if len(hits) else []:
        low, high = max(0, int(near[0]) - n - 5), min(len(codes), int(near[-1]) + GRAM + n + 5)
        # in a very long run of hits the window stays bounded: windows overlap by more than a passage can span
        step = high - low if (high - low) * n <= max(CELLS, 3 * reach * n) else reach
        for a in range(low, high, step):
            b = min(high, a + step + 2 * reach)
            if items.possible([k], codes[a:b]):
                best = max(best, covered(align(item, codes[a:b], starts[a:b]), items.rare[k]))
    return best / n


def line_starts(text: str) -> np.ndarray:
    """Whether each word of a text is the first of its line."""
    out = [np.arange(n) == 0 for n in (len(_WORD.findall(line)) for line in text.lower().split("\n"))]
    return np.concatenate(out)


_RESULT = "doc_id long, item_id long, cover double"


def _match(items: Items, min_cover: float):
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            docs, texts = frame["doc_id"].tolist(), frame["text"].tolist()
            split = [words(t) for t in texts]
            ends = np.cumsum([len(ws) for ws in split], dtype=np.int64)
            starts = ends - [len(ws) for ws in split]
            codes = items.codes([w for ws in split for w in ws])
            # texts without words share their place with the next one and are passed over
            some = np.flatnonzero(ends > starts)
            for i, pairs in groupby(sorted(items.pairs(codes, starts[some])), key=lambda pair: pair[0]):
                i = int(some[i])
                own, begins = codes[starts[i] : ends[i]], None
                for k in items.possible([k for _, k in pairs], own):
                    begins = line_starts(texts[i]) if begins is None else begins
                    cover = leak(items, k, own, begins)
                    if cover >= min_cover - items.slack[k] / len(items.coded[k]) - 1e-9:
                        out.append((docs[i], items.ids[k], cover))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "cover"])

    return batches


def leaks(documents: DataFrame, benchmark: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """``(doc_id, item_id, cover)``: documents that hold a passage of at least ``min_cover`` of an item's words.

    Items are read in the order of their ids and words counted over all of them, whatever the number of passes over the documents (see above); null and
    empty items and texts and rows without ids give no pairs, repeated rows give repeated pairs, and columns other than doc_id, text, item_id and text of the
    items are not read. An item of fewer than 15 words allows no edit at the end of a passage.
    """
    sized = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    spark = documents.sparkSession
    block, size, blocks, df = [], 0, [], Counter()
    for row in sized.orderBy("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        df.update(set(words(row["text"])))
        size += row["text"].count(" ") + 1
        if size >= BLOCK_WORDS:
            blocks.append(block)
            block, size = [], 0
    if block:
        blocks.append(block)
    texts = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null"))
    parts = [texts.mapInPandas(_match(Items(b, min_cover, df), min_cover), _RESULT) for b in blocks]
    if not parts:
        return spark.createDataFrame([], _RESULT)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def leaked_items(pairs: DataFrame) -> DataFrame:
    """``(item_id, n_documents, max_cover)`` of the items found anywhere."""
    return pairs.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("cover").alias("max_cover"))
