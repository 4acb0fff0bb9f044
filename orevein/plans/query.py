"""Query strings: keyword queries, and up to three quoted phrases joined by AND, OR or NOT."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.porter import stem
from ..functions.text import STOP_WORDS

AND, OR, NOT = 1, 2, 3
OPERATORS = {"AND": AND, "OR": OR, "NOT": NOT}
MAX_PHRASES, MAX_OPERATORS = 3, 2


@dataclass(frozen=True)
class Query:
    """A parsed query. ``phrases`` and ``operators`` are set for phrase queries, ``tokens`` and ``stems`` for keyword queries."""

    text: str
    tokens: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    operators: tuple[int, ...] = field(default=())

    @property
    def is_phrase(self) -> bool:
        return bool(self.phrases)

    def phrase_words(self) -> list[list[str]]:
        return [p.split() for p in self.phrases]

    def search_terms(self) -> list[str]:
        """Words to highlight: those of all phrases but the ones after NOT, or the tokens."""
        if not self.is_phrase:
            return list(dict.fromkeys(self.tokens))
        shown = [p for i, p in enumerate(self.phrases) if i == 0 or i > len(self.operators) or self.operators[i - 1] != NOT]
        return list(dict.fromkeys(w for p in shown for w in p.split()))

    def cache_key(self) -> tuple:
        """Equal for queries that rank the same, whatever their spacing and case."""
        return self.tokens, self.phrases, self.operators


def tokenize(text: str, stop=STOP_WORDS) -> list[str]:
    stop = frozenset(stop)
    return [w for w in re.split(r"[^a-zA-Z0-9_]+", text.lower()) if w and w not in stop]


def parse(text: str | None, stop=STOP_WORDS) -> Query:
    """A query that starts and ends with a quote is a phrase query, else all of it is keywords; nothing gives an empty query.

    Text between phrases that is no operator counts as AND. More operators or phrases than allowed are an error.
    """
    text = (text or "").strip()
    if not (len(text) > 1 and text[0] == text[-1] == '"'):
        tokens = tokenize(text, stop)
        return Query(text, tuple(tokens), tuple(map(stem, tokens)))
    phrases, operators, end = [], [], None
    for m in re.finditer(r'"([^"]+)"', text):
        if end is not None:
            operators.append(OPERATORS.get(text[end : m.start()].strip(), AND))
        phrases.append(m[1].strip().lower())
        end = m.end()
    if len(phrases) > MAX_PHRASES or len(operators) > MAX_OPERATORS:
        raise ValueError(f"at most {MAX_PHRASES} phrases and {MAX_OPERATORS} operators")
    return Query(text, phrases=tuple(p for p in phrases if p), operators=tuple(operators))
