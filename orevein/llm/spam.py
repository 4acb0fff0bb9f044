"""Keyword-stuffed and link-list pages (problem 6).

The lines of a document, without the furniture of its site, are the observations of a hidden Markov model with the states prose, link
list, tag list and menu (teasers of other pages go there too). An observation is a tuple of binned features (share of function words, links, separators, repetition,
prices, code, length, likeness to the neighbours, form of a teaser; whether the stored page shows the line as a link, and how many links the document has a word),
independent of each other given the state; a long line is one observation for each run of words in it. The model is trained here: counts from lines that plain rules are sure about, then rounds of Viterbi training, on a
bounded sample of documents; what is decoded then hangs on the model alone. Lines with residue of templates (problem 10) look like lists and can't be of the
list states. A page is flagged where link and tag lines hold more than two fifths of its words outside menus: what is left of the furniture, such as prose in
sidebars, is in the total, so pages with half of their own body in lists come out above that.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .residue import evidence
from .sitelines import line_keys, residual_lines

STATES = ("prose", "link", "tag", "menu")
PROSE, LINK, TAG, MENU = range(4)
#: Documents the model is trained on; the bound of the sample.
SAMPLE_DOCUMENTS = 3000
TRAINING_ROUNDS = 3
#: Words of a run: a line counts as so many observations as it has runs of words, a short line as ``SHORT_LINE`` of one.
RUN_WORDS, SHORT_LINE = 10, 0.5
#: A page is flagged above this share of link and tag words.
MIN_SHARE = 0.4
# Function words of the languages this was made for, those that most sentences hold one of.
FUNCTION_WORDS = frozenset(
    """the a an of and or to in on at by for with from as is are was were be been it its this that these those he she they we you i his her their our your
    not no but if when while because so than then there which who what how why would can could has have had any every each one before after
    der die das den dem des ein eine und oder zu im auf mit von für ist sind war wird nicht sich ob wenn weil seit nach über wie vor man dass als
    le la les un une des du et ou à au aux en dans sur pour par est sont était ne pas que qui se sa son ses ce cette il elle nous on si depuis avant l d
    el los las una y o de del al con por para es son fue no que se su sus lo hasta desde según ni como cuando así también más bien
    os as e do da dos das em no na um uma com não é foi por que se sempre já até mas quando
    и в во на не что но а то с к по из за для если через почему никто как это он она они мы""".split()
)
# Words that shop pages are stuffed with.
TRADE_WORDS = frozenset(
    """buy cheap best price prices deal deals discount free online top promo sale offer shop order kaufen günstig preis preise angebot angebote beste billig
    acheter prix meilleur promo soldes cher comprar barato precio oferta mejor preço melhor promoção купить цена дешево скидка""".split()
)
_WORD = re.compile(r"[^\W_]+")
_URL = re.compile(r"(?:https?://|www\.)\S+")
_SEPARATOR = re.compile(r"\s[|/•·»›>–—*~+-]+(?=\s)|[,;|•·](?=\s|$)|#(?=\w)")
_PRICE = re.compile(r"[€$£]\s?\d|\d\s?(?:[€$£]|EUR|USD|GBP)\b|\bEUR\s?\d")
_ARTICLE_NUMBER = re.compile(r"\W*[A-ZÀ-Þ]{2,4}-\d+\b")
_MONEY = ("€", "$", "£", "EUR", "USD", "GBP")
_QUOTES, _ENDS, _CODE_ENDS = "\"'”’») ", frozenset(".!?…:"), frozenset(";{}")
_CODE = re.compile(r"\s*(?:[\w.]+\s*\(|[\w.]+\s*=\s|<\w+|echo\b|print\b|import\b|def\b|for\s*\(|if\s*\(|SELECT\b|File\s+\"|\$\s|\{)")
#: A heading, a dash and a sentence, without a link: the teaser of another page.
_TEASER = re.compile(r"^[^.!?]{6,90}? [-–—] [^a-z\s].*[.!?][\"”»)]*$")
BINS = (5, 3, 2, 4, 4, 2, 2, 4, 3, 3, 2, 3, 4)


#: Bounds of the bins of links a word of the document; none is a bin of its own.
_LINKS = (0, 0.03, 0.12)
#: Bounds of the bins of shares, separators, repetition, length, trade words and likeness.
_FUNCTION, _SEPARATORS, _REPEAT, _LENGTH, _TRADE, _LIKE = (0, 0.1, 0.2, 0.3), (0, 0.12, 0.3), (0.12, 0.3, 0.5), (3, 9, 20), (0, 0.15), (0.2, 0.45)


def observe(lines: list[str], linked: np.ndarray | None = None, links: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line and its number of words (the parts of a link are words).

    ``linked``: whether each line is the text of a link on the stored page, None where there is no page; ``links``: the document's rows in links.
    """
    parsed = []
    for line in lines:
        words = _WORD.findall(line.lower())
        different = set(words)
        parsed.append((words, different, different - FUNCTION_WORDS))
    per_word = bisect_left(_LINKS, links / (sum(len(p[0]) for p in parsed) or 1))
    out = np.zeros((len(lines), len(BINS)), np.int64)
    sizes = np.zeros(len(lines), np.int64)
    for i, line in enumerate(lines):
        words, different, content = parsed[i]
        n = len(words) or 1
        sizes[i] = len(words)
        bare = _URL.sub(" ", line) if "://" in line or "www." in line else line
        urls = 0 if bare == line else (2 if len(_WORD.findall(bare)) <= 2 else 1)
        like = 0.0
        if content:
            near = [len(content & parsed[j][2]) / len(content) for j in (i - 1, i + 1) if 0 <= j < len(lines)]
            like = max(near, default=0.0)
        function = sum(map(FUNCTION_WORDS.__contains__, words)) / n
        trade = sum(map(TRADE_WORDS.__contains__, words)) / n if not TRADE_WORDS.isdisjoint(different) else 0.0
        out[i] = (
            bisect_left(_FUNCTION, function),
            urls,
            line.rstrip(_QUOTES)[-1:] in _ENDS,
            bisect_left(_SEPARATORS, len(_SEPARATOR.findall(line)) / n),
            bisect_left(_REPEAT, 1 - len(different) / n) if n >= 8 else 0,
            any(c in line for c in _MONEY) and bool(_PRICE.search(line)) or bool(_ARTICLE_NUMBER.match(line)),
            urls == 0 and (line.rstrip()[-1:] in _CODE_ENDS or bool(_CODE.match(line))),
            bisect_left(_LENGTH, n),
            bisect_left(_TRADE, trade),
            bisect_left(_LIKE, like),
            urls == 0 and bool(_TEASER.match(line)),
            0 if linked is None else 1 + bool(linked[i]),
            per_word,
        )
    return out, sizes


def seed(x: np.ndarray) -> np.ndarray:
    """States that plain rules are sure about, -1 elsewhere."""
    function, link, end, sep, repeat, price, code, length, trade, like, teaser, _, _ = x.T
    state = np.full(len(x), -1)
    state[(length <= 1) & (end == 0) & (like == 0) & (link == 0)] = MENU
    state[(function >= 3) & (end == 1) & (length >= 1)] = PROSE
    state[(function >= 3) & (length >= 2)] = PROSE
    state[(code == 1) & (link == 0)] = PROSE
    listed = (function <= 1) & (code == 0)
    state[listed & (length >= 2) & ((sep >= 2) | (repeat >= 2))] = TAG
    state[listed & (trade == 2) & (length >= 1)] = TAG
    state[listed & (price == 1)] = TAG
    state[(function <= 3) & (code == 0) & (like == 2) & (length <= 1) & (end == 0)] = TAG
    state[link == 2] = LINK
    state[teaser == 1] = MENU
    return state


class LineModel:
    """Hidden Markov model of line states; ``start``, ``step`` and one table per feature hold log probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.start, self.step, self.emit = start, step, emit
        # one table of all features' bins, so a line's score is one lookup and a sum
        self.offset = np.concatenate([[0], np.cumsum(BINS)[:-1]])
        self.flat = np.concatenate([t.T for t in emit])

    @classmethod
    def count(cls, documents: list[tuple[np.ndarray, np.ndarray]]) -> LineModel:
        """From documents with states; lines with state -1 are passed over. One is added to every count."""
        k = len(STATES)
        start, step, emit = np.ones(k), np.ones((k, k)), [np.ones((k, b)) for b in BINS]
        for x, state in documents:
            known = state >= 0
            for f, table in enumerate(emit):
                np.add.at(table, (state[known], x[known, f]), 1)
            if len(state) and state[0] >= 0:
                start[state[0]] += 1
            both = known[1:] & known[:-1]
            np.add.at(step, (state[:-1][both], state[1:][both]), 1)
        return cls(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), [np.log(t / t.sum(1, keepdims=True)) for t in emit])

    def decode(self, x: np.ndarray, sizes: np.ndarray, lines: list[str] | None = None) -> np.ndarray:
        """The likeliest states (Viterbi). ``sizes``: words of each line; ``lines``: their text, to keep residue out of the lists."""
        if not len(x):
            return np.zeros(0, np.int64)
        score = self.flat[x + self.offset].sum(1)
        score *= np.maximum(sizes / RUN_WORDS, SHORT_LINE)[:, None]
        if lines is not None:
            # a line that prose or menus explain better is not looked at any closer
            near = np.flatnonzero(score[:, [LINK, TAG]].max(1) > score[:, [PROSE, MENU]].max(1) - 2)
            for i in near:
                if evidence([lines[i]]):
                    score[i, [LINK, TAG]] = -1e9
        back = np.zeros(score.shape, np.int64)
        now = self.start + score[0]
        for i in range(1, len(x)):
            ways = now[:, None] + self.step
            back[i] = ways.argmax(0)
            now = ways.max(0) + score[i]
        out = np.zeros(len(x), np.int64)
        out[-1] = now.argmax()
        for i in range(len(x) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    @classmethod
    def train(cls, seen: list[tuple[np.ndarray, np.ndarray]], rounds: int = TRAINING_ROUNDS) -> LineModel:
        """From what ``observe`` gives of documents."""
        seen = [(x, sizes) for x, sizes in seen if len(x)]
        model = cls.count([(x, seed(x)) for x, _ in seen])
        for _ in range(rounds):
            # lines the rules are sure about keep their state, so the states keep their meaning
            model = cls.count([(x, np.where((s := seed(x)) >= 0, s, model.decode(x, sizes))) for x, sizes in seen])
        return model


def list_share(model: LineModel, lines: list[str], linked: np.ndarray | None = None, links: int = 0) -> tuple[float, int]:
    """Share of link and tag words among the words outside menus, and the number of those words."""
    x, sizes = observe(lines, linked, links)
    state = model.decode(x, sizes, lines)
    listed, other = sizes[(state == LINK) | (state == TAG)].sum(), sizes[state == PROSE].sum()
    return (float(listed / (listed + other)) if listed + other else 0.0), int(listed + other)


def anchors(pages: DataFrame) -> DataFrame:
    """``(file_path, anchors)``: hashes of the texts of a page's links, as lines are hashed."""
    plain = lambda a: F.regexp_replace(F.regexp_replace(a, "<[^>]*>", ""), r"\s+", " ")
    texts = F.array_join(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), plain), "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        texts = F.replace(texts, F.lit(entity), F.lit(char))
    keys = F.array_distinct(F.transform(F.filter(line_keys(texts), lambda k: k != ""), lambda k: F.xxhash64(k)))
    # of several pages with a path one counts
    return pages.where("file_path is not null and html is not null").select("file_path", keys.alias("anchors")).groupBy("file_path").agg(F.max("anchors").alias("anchors"))


def linked_lines(documents: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """``(doc_id, lines, keys, anchors, links)``: residual lines with the link texts of the document's stored page (null if there is none) and its rows in links.

    All three sides are joined by doc_id; links are counted on the map side before. Rows without doc_id are left out.
    """
    counts = links.where("source_document_id is not null").groupBy(F.col("source_document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("links"))
    ids = documents.where("doc_id is not null and file_path is not null").select("doc_id", "file_path")
    shown = ids.join(anchors(pages), "file_path").groupBy("doc_id").agg(F.max("anchors").alias("anchors"))
    rows = residual_lines(documents).where("doc_id is not null")
    return rows.join(counts, "doc_id", "left").join(shown, "doc_id", "left").select("doc_id", "lines", "keys", "anchors", F.coalesce("links", F.lit(0)).alias("links"))


def _linked(keys, anchors) -> np.ndarray | None:
    return None if anchors is None else np.isin(keys, anchors)


def line_model(lines: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> LineModel:
    """Trained on the ``sample`` documents whose ids hash lowest: the one place where a bounded sample is taken."""
    chosen = lines.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = lines.join(F.broadcast(chosen), "doc_id", "left_semi").limit(2 * sample).toPandas().sort_values("doc_id", kind="stable")
    return LineModel.train([observe(list(r.lines), _linked(r.keys, r.anchors), r.links) for r in rows.itertuples() if r.lines is not None and len(r.lines)])


def list_pages(documents: DataFrame, pages: DataFrame, links: DataFrame, sample: int = SAMPLE_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``(doc_id, share, n_words)`` of documents whose body is link or tag lists for more than ``min_share`` of its words.

    Nulls, empty texts and texts of furniture only are never flagged; documents without an id are left out; repeated rows are reported as often; texts are read whole.
    Documents without a stored page or rows in links are judged by their text. Only the trained model, a few hundred numbers, goes to the executors.
    """
    lines = cut(linked_lines(documents, pages, links), "residual")
    model = line_model(lines, sample)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [list_share(model, list(r.lines), _linked(r.keys, r.anchors), r.links) if r.lines is not None else (0.0, 0) for r in frame.itertuples()]
            out = pd.DataFrame({"doc_id": frame["doc_id"], "share": [r[0] for r in rows], "n_words": [r[1] for r in rows]})
            yield out[out["share"] > min_share]

    return lines.mapInPandas(batches, "doc_id long, share double, n_words long")
