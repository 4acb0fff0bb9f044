"""The main body of stored pages (problem 2).

Every block-level DOM node of a page becomes a row of features: text size and share of links in its subtree, density of child nodes,
attribute tokens, depth, place among its siblings and relative to the page's heading, and how nodes with its tag and class do
across the site. Gradient-boosted trees, trained here, score each node; a tree-shaped decoding then picks the labelling of
the whole page with the greatest total score in which no node is main inside one that is furniture, nor the other way round. The result
are the line numbers that carry text of main nodes.

Training needs no marked pages. Lines that recur on a site's pages, nodes made of links and text before the heading are furniture for
sure, the heading and the own text that follows at once are main body for sure. Where the block of the heading is of another kind (tag,
class, role) than all furniture of its page, the kind tells the other blocks as well. Such telling pages teach twice, once as they are
and once with everything masked that kinds tell, so the trees also learn to decide by size, place and neighbours, and pages
whose kinds tell nothing are read with the same mask. The sample of pages is bounded.

Scale: pages are parsed once, to compact arrays in a table; counting lines and node kinds per site combines on the map side, a site
keeps only what stands on a tenth of its pages (at most ten times what a page has), and one page is one row throughout, so
nothing is gathered per site.
"""

from __future__ import annotations

import hashlib
import html as _html
import logging
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize
from ..operators.skew import facts_join
from ..session import cut, spread
from ..sources.html import CLOSE, INLINE, OPEN, attributes, scan
from .gbdt import Boosted

log = logging.getLogger(__name__)

#: Pages the trees are trained on; the bound of the sample.
SAMPLE_PAGES = 1500
MIN_PAGES, MIN_SHARE = 5, 0.1
HIDDEN = frozenset("script style noscript template head svg".split())
TAGS = {t: i for i, t in enumerate("body div section article main p li ul ol h1 h2 h3 h4 pre table tr td nav header footer aside blockquote dl dt dd form".split(), 1)}
# Tokens of class and id names that tell furniture or main body on many sites.
FURNITURE_TOKENS = frozenset(
    "nav menu bar side sidebar foot footer related share social cookie consent ad ads advert promo banner byline meta crumb crumbs breadcrumb tags widget newsletter top comment-form popup modal legal teaser list".split()
)
MAIN_TOKENS = frozenset("article post entry content main text story body".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_END = re.compile(r"[.!?…][\"'”’»)]*$")
#: Pages of one task, about, where pages are scored: what a task costs hangs on their number, not on the bytes of their arrays.
PAGES_PER_TASK = 4000
_NODE = "page_id long, host string, error string, parent array<int>, tag array<int>, kind array<long>, key array<long>, chars array<int>, links array<int>, own array<int>, flags array<int>, lines array<int>, owner array<int>"


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse(page: str) -> dict:
    """A page's block-level nodes in document order: parent, tag, kind (tag, class and role hashed), key of the own line, sizes of the own text
    and its link part, flags of the own text, and the lines that carry own text, with their owners."""
    breaks = [m.start() for m in re.finditer("\n", page)]
    parent, tag, kind, tokens, text, links = [], [], [], [], [], []
    lines: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []  # element, its block node
    hidden = in_link = 0
    body_seen = "<body" in page[:20000].lower() or "<body" in page.lower()
    in_body = not body_seen
    for event, name, start, end in scan(page):
        if event == OPEN:
            attrs = page[start:end]
            node = stack[-1][1] if stack else -1
            if name == "body":
                in_body = True
            if name in HIDDEN:
                hidden += 1
            elif name == "a":
                in_link += 1
            if name not in INLINE and not hidden and in_body and name not in ("html", "br", "hr", "img", "input", "meta", "link"):
                a = attributes(attrs) if "=" in attrs else {}
                parent.append(node)
                node = len(tag)
                tag.append(TAGS.get(name, 0))
                kind.append(hash64(f"{name} {a.get('class', '')} {a.get('role', '')}"))
                tokens.append(frozenset(_SPLIT.split(f"{name} {a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".lower())))
                text.append([])
                links.append(0)
            elif name in ("br", "hr") and node >= 0:
                text[node].append(" ")
            stack.append((name, node))
        elif event == CLOSE:
            if stack:
                if stack[-1][0] in HIDDEN:
                    hidden -= 1
                elif stack[-1][0] == "a":
                    in_link -= 1
                stack.pop()
        elif not hidden and in_body and not page[start:end].isspace():
            piece = page[start:end]
            if not stack or stack[-1][1] < 0:
                if not tag:
                    parent.append(-1), tag.append(TAGS["body"]), kind.append(0), tokens.append(frozenset()), text.append([]), links.append(0)
                node = 0
            else:
                node = stack[-1][1]
            words = _html.unescape(piece)
            text[node].append(words)
            if in_link:
                links[node] += len(words.strip())
            first = bisect_right(breaks, start - 1) if start else 0
            for i, part in enumerate(piece.split("\n")):
                if part and not part.isspace():
                    lines.append((first + i, node))
        elif not hidden and stack and stack[-1][1] >= 0:
            text[stack[-1][1]].append(" ")
    own = [" ".join("".join(t).split()) for t in text]
    key = [hash64(_DIGITS.sub("0", t.lower())) if t else 0 for t in own]
    flags = [
        bool(tokens[i] & FURNITURE_TOKENS) + 2 * bool(tokens[i] & MAIN_TOKENS) + 4 * bool(_END.search(own[i])) + 8 * (" > " in own[i] or " › " in own[i] or " | " in own[i] or " · " in own[i])
        + 16 * min(7, sum(c.isdigit() for c in own[i]) * 20 // (len(own[i]) or 1)) + 128 * (" - " in own[i] or " – " in own[i]) + 256 * min(31, len(own[i].split()))
        for i in range(len(own))
    ]
    lines = sorted(set(lines))
    return {
        "parent": parent, "tag": tag, "kind": kind, "key": key, "chars": [len(t) for t in own], "links": [min(n, len(t)) for n, t in zip(links, own, strict=True)],
        "own": [int(bool(t)) for t in own], "flags": flags, "lines": [x for x, _ in lines], "owner": [x for _, x in lines],
    }


_EMPTY = {k: [] for k in "parent tag kind key chars links own flags lines owner".split()}


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows, errors = [], []
        for page in frame["html"]:
            error = None
            try:
                rows.append(parse(page) if page else _EMPTY)
            except (ValueError, IndexError, RecursionError) as e:
                rows.append(_EMPTY)
                error = f"{type(e).__name__}: {e}"
            errors.append(error)
        yield pd.DataFrame({"page_id": frame["page_id"], "host": frame["host"], "error": errors} | {k: [r[k] for r in rows] for k in _EMPTY})


def parsed_pages(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Pages as node arrays, with an ``error`` where a page could not be parsed; the site is the host of the url. For pages without one it is the source of the document with the page's
    file path, if documents are given; pages whose site stays unknown count as one."""
    rows = pages.where("page_id is not null").select("page_id", F.nullif(F.regexp_extract(normalize(F.col("url")), "^[a-z]+://([^/?]*)", 1), F.lit("")).alias("host"), "html", *(["file_path"] if documents is not None else []))
    if documents is not None:
        # only the pages without a host are joined, so no null key gathers the rest in one task
        sources = documents.where("file_path is not null").groupBy("file_path").agg(F.max("source").alias("source"))
        lost = rows.where("host is null").join(sources, "file_path", "left").select("page_id", F.col("source").alias("host"), "html")
        rows = rows.where("host is not null").select("page_id", "host", "html").unionByName(lost)
    return rows.select("page_id", F.coalesce("host", F.lit("")).alias("host"), "html").transform(spread).mapInPandas(_parse_batches, _NODE)


def _supported(items: DataFrame, sizes: DataFrame, value: str, extra: dict) -> DataFrame:
    totals = [F.sum(name).alias(name) for name in extra]
    counts = items.groupBy("host", value).agg(F.count(F.lit(1)).alias("n"), *totals).where(F.col("n") >= MIN_PAGES)
    return counts.join(sizes, "host").where(F.col("n") >= F.col("size") * MIN_SHARE)


_KINDS = "host string, kind long, leaves long, again long, heads long"


def _kind_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per page and node kind: the leaves below nodes of that kind, how many of them recur, and whether the heading is there."""
    for frame in batches:
        out = []
        for row in frame.itertuples():
            kept = frozenset(row.kept.tolist()) if row.kept is not None else frozenset()
            per: dict[int, list[int]] = {}
            chains: list[frozenset] = []
            for i, up in enumerate(row.parent):
                chain, kind = chains[up] if up >= 0 else frozenset(), int(row.kind[i])
                chains.append(chain if kind in chain else chain | {kind})
                if row.own[i]:
                    for kind in chains[i]:
                        x = per.setdefault(kind, [0, 0, 0])
                        x[0] += 1
                        x[1] += int(row.key[i]) in kept
                        x[2] |= int(row.tag[i] == TAGS["h1"])
            out += [(row.host, k, *x) for k, x in per.items()]
        yield pd.DataFrame(out, columns=["host", "kind", "leaves", "again", "heads"])


def site_facts(nodes: DataFrame) -> DataFrame:
    """``(host, kept, kinds)``: the keys of each site's recurrent lines, and its frequent node kinds with shares of recurrent leaves and of
    pages whose heading is below."""
    sizes = nodes.groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    keys = nodes.select("host", F.explode(F.array_distinct(F.filter("key", lambda k: k != 0))).alias("key"))
    kept = cut(_supported(keys, sizes, "key", {}).groupBy("host").agg(F.collect_list("key").alias("kept")), "kept")
    rows = nodes.select("host", "parent", "tag", "kind", "key", "own").join(kept, "host", "left")
    kinds = _supported(rows.mapInPandas(_kind_batches, _KINDS), sizes, "kind", {"leaves": 0, "again": 0, "heads": 0})
    fact = F.struct("kind", (F.col("again") / F.col("leaves")).alias("again"), (F.col("heads") / F.col("n")).alias("heads"), (F.col("n") / F.col("size")).alias("pages"))
    return sizes.join(kept, "host", "left").join(kinds.groupBy("host").agg(F.collect_list(fact).alias("kinds")), "host", "left").select("host", "kept", "kinds")


FEATURES, KIND_FEATURES = 43, 10


def masked(x: np.ndarray) -> np.ndarray:
    """The features without those that tags and classes of containers give."""
    x = x.copy()
    x[:, :KIND_FEATURES] = -2
    return x


class Page:
    """A page's nodes with what is known of its site: features, sure labels and the decoding."""

    def __init__(self, row):
        a = lambda v: np.asarray(v, np.int64)
        self.parent, self.tag, self.own, self.chars, self.links, self.flags = a(row.parent), a(row.tag), a(row.own), a(row.chars), a(row.links), a(row.flags)
        self.key, self.kind = a(row.key), a(row.kind)
        kept = frozenset(int(k) for k in row.kept) if row.kept is not None else frozenset()
        self.facts = {int(k["kind"]): (k["again"], k["heads"], k["pages"]) for k in (row.kinds if row.kinds is not None else [])}
        n = self.n = len(self.parent)
        self.again = np.array([bool(o) and int(k) in kept for o, k in zip(self.own, self.key, strict=True)], np.int64).reshape(n)
        self.children: list[list[int]] = [[] for _ in range(n)]
        self.depth = np.zeros(n, np.int64)
        for i in range(n):
            if self.parent[i] >= 0:
                self.children[self.parent[i]].append(i)
                self.depth[i] = self.depth[self.parent[i]] + 1
        self.leaves, self.text, self.link, self.recur, self.recur_chars, self.sentences, self.size = (x.copy() for x in (self.own, self.chars, self.links, self.again, self.again * self.chars, (self.flags >> 2) & 1, np.ones(n, np.int64)))
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            if up >= 0:
                for x in (self.leaves, self.text, self.link, self.recur, self.recur_chars, self.sentences, self.size):
                    x[up] += x[i]
        heads = [i for i in range(n) if self.tag[i] == TAGS["h1"] and self.own[i]]
        self.head = heads[0] if heads else -1
        self.blocks = self._blocks()

    def _blocks(self) -> list[int]:
        """Blocks of the page: the body's children, wrappers around the heading opened, from the heading's parent upwards."""
        inside, at = [], self.parent[self.head] if self.head >= 0 else -1
        inside, opened = ([at], at) if at >= 0 else ([], -1)
        while opened >= 0 and self.parent[opened] >= 0:
            up = self.parent[opened]
            around = [b for c in self.children[up] if self.leaves[c] for b in (inside if c == opened else [c])]
            inside, opened = (around if len(around) > 1 else [up]), up
        out: list[int] = []
        for i in range(self.n):
            if self.parent[i] < 0 and self.leaves[i]:
                if i == opened:
                    out += inside
                else:
                    out += [c for c in self.children[i] if self.leaves[c]] or [i]
        return out

    def prepare(self) -> tuple[np.ndarray, np.ndarray]:
        """Features of all nodes, and sure labels: 1 main, 0 furniture, -1 unsure."""
        n = self.n
        label = np.full(n, -1)
        x = np.zeros((n, FEATURES))
        self.telling = False
        if not n:
            return x, label
        block = np.full(n, -1)
        for j, b in enumerate(self.blocks):
            block[b : b + self.size[b]] = j
        k = len(self.blocks)
        b = np.array(self.blocks, np.int64).reshape(k)
        leaves, text = np.maximum(self.leaves[b], 1), np.maximum(self.text[b], 1)
        recur, link = self.recur[b] / leaves, self.link[b] / text
        head = int(block[self.head]) if self.head >= 0 else -1
        furniture = (recur > 0) | (link > 0.4)
        head_kind = int(self.kind[b[head]]) if head >= 0 else 0
        self.telling = head >= 0 and not any(furniture[j] and j != head and self.kind[b[j]] == head_kind for j in range(k)) and any(furniture[j] and j != head for j in range(k))
        # furniture blocks between the heading's block and this one, whether own text came before, and furniture since then
        passed, own_before, gap = np.zeros(k), np.zeros(k), np.zeros(k)
        gone = seen = since = 0
        head_rest = int(self.leaves[b[head]] - 1 - self.recur[b[head]]) if head >= 0 else 0
        for j in range(head + 1 if head >= 0 else 0, k):
            passed[j], own_before[j], gap[j] = gone, seen, since
            if furniture[j]:
                gone += 1
                since += seen > 0 or head_rest > 1
            else:
                seen += 1
        sentences = self.sentences[b] / leaves
        largest = text[~furniture].max() if k and (~furniture).any() else 1
        before = np.concatenate([[0], np.cumsum(self.own * self.chars)])[:-1] / max(1, self.text[self.parent < 0].sum())
        none = (-1.0, -1.0, 0.0)
        for i in range(n):
            j = block[i]
            facts = self.facts.get(int(self.kind[i]), none)
            up = self.parent[i]
            top = b[j] if j >= 0 else i
            bf = self.facts.get(int(self.kind[top]), none)
            siblings = self.children[up] if up >= 0 else [i]
            t = max(1, self.text[i])
            x[i] = (
                *facts, *bf[:2], int(self.kind[top]) == head_kind, self.flags[i] & 1, (self.flags[i] >> 1) & 1, self.tag[i], self.tag[top],
                self.tag[i] if self.own[i] else 0,
                np.log1p(self.text[i]), self.link[i] / t, self.recur[i] / max(1, self.leaves[i]), self.recur_chars[i] / t, self.sentences[i] / max(1, self.leaves[i]), self.leaves[i], self.size[i] / t * 100,
                self.depth[i] - self.depth[top], (self.flags[i] >> 3) & 1, (self.flags[i] >> 4) & 7, (self.flags[i] >> 7) & 1, (self.flags[i] >> 8) & 31,
                before[i], 0 if self.head < 0 else np.sign(i - self.head), len(siblings), self.recur[up] / max(1, self.leaves[up]) if up >= 0 else -1,
                recur[j] if j >= 0 else -1, link[j] if j >= 0 else -1, np.log1p(self.text[top]), self.leaves[top], sentences[j] if j >= 0 else -1, text[j] / largest if j >= 0 else -1,
                (j - head) if j >= 0 and head >= 0 else -9, (k - j) if j >= 0 else -1, passed[j] if j >= 0 else -1, own_before[j] if j >= 0 else -1, gap[j] if j >= 0 else -1, head_rest,
                recur[j + 1] if 0 <= j < k - 1 else -1, link[j + 1] if 0 <= j < k - 1 else -1, recur[j - 1] if j > 0 else -1, link[j - 1] if j > 0 else -1,
            )
            if j < 0 or not self.leaves[i]:
                continue
            if self.own[i] and self.again[i]:
                label[i] = 0
            elif i == self.head:
                label[i] = 1
            elif j != head and (link[j] > 0.8 or recur[j] > 0 or j < head):
                label[i] = 0
            elif self.telling:
                label[i] = int(int(self.kind[top]) == head_kind) if self.own[i] or j != head else -1
            elif head >= 0 and not furniture[j] and gap[j] == 0 and (j > head and head_rest <= 1 or j == head and self.own[i]):
                label[i] = 1
        return x, label

    def decode(self, score: np.ndarray) -> np.ndarray:
        """Nodes whose own text is main: the best labelling in which a node that is not split lends its label to all below it."""
        n = self.n
        score = np.where(self.leaves > 0, score, 0.0)
        own = np.where(self.own > 0, score, 0.0)
        # a container's score counts a little, so it can tip the balance of doubtful parts but not overrule them
        total = own + np.where(self.own > 0, 0.0, 0.3 * score)
        main, other, best = total.copy(), -total, np.zeros(n)
        inside, choice = np.zeros(n), np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):
            split = inside[i] + abs(own[i])
            choice[i] = int(np.argmax((split, main[i], other[i])))
            best[i] = max(split, main[i], other[i])
            up = self.parent[i]
            if up >= 0:
                main[up] += main[i]
                other[up] += other[i]
                inside[up] += best[i]
        state = np.zeros(n, np.int64)
        for i in range(n):
            up = self.parent[i]
            state[i] = state[up] if up >= 0 and state[up] else choice[i]
        main = ((state == 1) | ((state == 0) & (own > 0))) & (self.own > 0)
        # a bare page, such as an error message, has no heading that the rest could be placed by
        return main if main.any() else (self.own > 0) & (self.again == 0) & (self.links < 0.4 * np.maximum(self.chars, 1))


def train(rows) -> Boosted:
    """Trees from the sure labels of pages, given as rows of nodes with site facts."""
    xs, ys = [np.zeros((0, FEATURES))], [np.zeros(0, np.int64)]
    for page in map(Page, rows):
        x, y = page.prepare()
        for form in (x, masked(x)) if page.telling else (masked(x),):
            xs.append(form)
            ys.append(y)
    x, y = np.concatenate(xs), np.concatenate(ys)
    return Boosted.fit(x[y >= 0], y[y >= 0].astype(float))


def main_lines(pages: DataFrame, documents: DataFrame | None = None, sample: int = SAMPLE_PAGES) -> DataFrame:
    """``(page_id, line_no)``: lines of ``html`` (split at line feeds, from 0) that carry text of the main body.

    Missing and empty pages have none; a page that is read twice is reported twice; text outside the body element, in
    scripts, styles, noscript and comments is never main. Rows without page_id are left out; columns other than page_id, url, html and
    file_path are not read.
    """
    nodes = cut(parsed_pages(pages, documents), "nodes")
    facts = cut(site_facts(nodes), "facts")
    n, failed = nodes.agg(F.count(F.lit(1)), F.count("error")).first()
    if failed:
        log.warning("%d of %d pages could not be parsed and have no main lines; parsed_pages tells which", failed, n)
    rows = facts_join(nodes.repartition(max(1, -(-n // PAGES_PER_TASK)), "page_id"), facts, "host")
    chosen = nodes.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    fields = ["parent", "tag", "kind", "key", "chars", "links", "own", "flags", "kept", "kinds"]
    model = train(nodes.join(facts, "host", "left").join(F.broadcast(chosen), "page_id", "left_semi").select(*fields).toPandas().itertuples())

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [Page(r) for r in frame.itertuples()]
            made = [(p, p.prepare()[0]) for p in parts]
            x = np.concatenate([x if p.telling else masked(x) for p, x in made] or [np.zeros((0, FEATURES))])
            score, at, ids, lines = model.decide(x), 0, [], []
            for p, row in zip(parts, frame.itertuples(), strict=True):
                main = p.decode(score[at : at + p.n])
                at += p.n
                owner = np.asarray(row.owner, np.int64)
                found = np.unique(np.asarray(row.lines, np.int64)[main[owner]]) if len(owner) else np.zeros(0, np.int64)
                ids.append(np.full(len(found), row.page_id))
                lines.append(found)
            none = [np.zeros(0, np.int64)]
            yield pd.DataFrame({"page_id": np.concatenate(ids + none), "line_no": np.concatenate(lines + none).astype(np.int32)})

    return rows.mapInPandas(batches, "page_id long, line_no int")
