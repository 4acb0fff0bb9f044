"""Reading HTML: a scanner, and what the index takes from a page (title, description, elements, links).

The scanner is one regular expression over the page, with the end tags that HTML implies put in. Pages of any size and with any faults give
a result; an unclosed comment, script or style hides the rest of the page, as in browsers.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
HIDDEN = frozenset("script style".split())
#: Elements that an opening tag of the key closes first.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"},
}
#: Elements that such a search for an open one never leaves.
_SCOPES = frozenset("ul ol table dl select body html".split())
_NO_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav
    ol p pre section table ul""".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<hidden>script|style)\b(?P<hattrs>[^>]*)>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

OPEN, CLOSE, TEXT = range(3)


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag, by lower-case name; the first of several counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), _html.unescape(a or b or c))
    return out


def scan(page: str) -> Iterator[tuple[int, str, int, int]]:
    """Events of a page in order: (OPEN, name, start of attributes, their end), (CLOSE, name, 0, 0), (TEXT, "", start, end).

    Every OPEN of a non-void element has its CLOSE; text inside scripts, styles and comments is left out.
    """
    stack: list[str] = []
    at = 0

    def closing(depth: int) -> Iterator[tuple[int, str, int, int]]:
        while len(stack) > depth:
            yield CLOSE, stack.pop(), 0, 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield TEXT, "", at, m.start()
        at = m.end()
        name = m["name"]
        if name is None:
            if m["hidden"]:
                yield OPEN, m["hidden"].lower(), m.start("hattrs"), m.end("hattrs")
                yield CLOSE, m["hidden"].lower(), 0, 0
            continue
        name = name.lower()
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == name:
                    yield from closing(i)
                    break
                if name in INLINE and stack[i] not in INLINE:
                    break
            continue
        if name in _NO_P and "p" in stack:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == "p":
                    yield from closing(i)
                    break
                if stack[i] not in INLINE:
                    break
        if name in _CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in _CLOSES[name]:
                    yield from closing(i)
                    if name not in ("tr", "thead", "tbody"):
                        break
                elif stack[i] in _SCOPES:
                    break
        yield OPEN, name, m.start("attrs"), m.end("attrs")
        if name in VOID:
            yield CLOSE, name, 0, 0
        else:
            stack.append(name)
    if at < len(page):
        yield TEXT, "", at, len(page)
    yield from closing(0)


def read(page: str) -> dict:
    """Title, description, elements ``(ord, tag, text)`` and link targets of a page.

    An element's text includes that of its descendants, which are listed as well; elements without text of their own, titles, metas,
    scripts and styles are not listed. The title is the ``title`` element, else the first heading; the description is the meta
    description even if empty, else the first paragraph.
    """
    pieces: list[str] = []
    opened: list[list] = []
    found: list[list] = []
    links, meta, title_seen = [], None, None
    for kind, name, start, end in scan(page):
        if kind == TEXT:
            text = _html.unescape(page[start:end])
            pieces.append(text)
            if opened and not text.isspace():
                opened[-1][4] = True
        elif kind == OPEN:
            if name not in INLINE:
                pieces.append(" ")
            if name == "a" or name == "meta":
                attrs = attributes(page[start:end])
                if name == "a" and "href" in attrs:
                    links.append(attrs["href"])
                if name == "meta" and meta is None and attrs.get("name", "").lower() == "description":
                    meta = attrs.get("content", "")
            element = [name, len(pieces), None, len(found), False]
            found.append(element)
            opened.append(element)
        else:
            element = opened.pop()
            element[2] = len(pieces)
            if name not in INLINE:
                pieces.append(" ")
    text_of = lambda e: " ".join("".join(pieces[e[1] : e[2]]).split())
    elements, heading, paragraph = [], None, None
    for e in found:
        name = e[0]
        if name == "title" and title_seen is None:
            title_seen = text_of(e)
        if heading is None and len(name) == 2 and name[0] == "h" and name[1] in "123456":
            heading = text_of(e)
        if paragraph is None and name == "p":
            paragraph = text_of(e)
        if e[4] and name not in ("title", "meta") and name not in HIDDEN:
            elements.append((name, text_of(e)))
    return {
        "title": title_seen or heading or "",
        "description": meta if meta is not None else paragraph or "",
        "elements": [{"ord": i, "tag": t, "text": x} for i, (t, x) in enumerate(elements)],
        "links": links,
        "error": None,
    }


PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("elements", T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


@F.pandas_udf(PAGE)
def read_page(pages: pd.Series) -> pd.DataFrame:
    """``read`` of each page; a missing page gives ``error`` instead of stopping the job, so it stays unindexed."""
    rows = []
    for page in pages:
        if page is None:
            rows.append({"title": None, "description": None, "elements": None, "links": None, "error": "no page"})
            continue
        try:
            rows.append(read(page))
        except Exception as e:  # one broken page must not end the others
            rows.append({"title": None, "description": None, "elements": None, "links": None, "error": f"{type(e).__name__}: {e}"})
    return pd.DataFrame(rows, columns=[f.name for f in PAGE.fields])
