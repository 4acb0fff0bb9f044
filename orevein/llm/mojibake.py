"""Text that was decoded with the wrong character encoding (problem 5).

A garbled text holds, character by character, the bytes of its true encoding as some legacy code page shows them. ``repair``
maps characters back to bytes of one code page at a time, runs an automaton over the structure of UTF-8 bytes, takes the maximal
spans of well-formed multibyte sequences and decodes those spans only, so that text around them stays as it is. Text decoded
twice takes several rounds. A second, single-byte pass reads words in which letters of the wrong case or stray signs stand inside a
word as another code page's bytes. What holds replacement characters is found, though it can't be restored. Garbled characters may
also stand as HTML character references; these are resolved first, and references that are correct are no case.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from html import unescape
from html.entities import html5
from unicodedata import category, name

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Code pages that text in Latin and Cyrillic letters is commonly misread with.
CODE_PAGES = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")
#: Pairs (read with, true encoding) of the single-byte pass over Latin words; those of Cyrillic ones are below.
SINGLE_BYTE = (("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"))
ROUNDS = 4
REPLACEMENT = "�"


@cache
def to_bytes(page: str) -> dict[str, int]:
    """Characters of a code page, by byte 128 and up; bytes that Windows pages leave open stand for themselves."""
    out = {}
    for byte in range(128, 256):
        try:
            out[bytes([byte]).decode(page)] = byte
        except UnicodeDecodeError:
            pass
        if page.startswith("cp125"):
            out.setdefault(chr(byte), byte)
    return out


def plausible(ch: str) -> bool:
    """Whether a decoded character is one of any script, or a byte of the next round: assigned, and no surrogate or private one."""
    return category(ch) not in ("Cn", "Co", "Cs")


def sequences(text: str, page: str) -> list[tuple[int, int, str]]:
    """Well-formed multibyte sequences of ``text`` read as bytes of ``page``: start, end and decoded character.

    The automaton's states are the number of continuation bytes still due and the least and greatest value of the next one; any
    other byte, and any character the page lacks, puts it back to its start.
    """
    table = to_bytes(page)
    out, due, code, start, low, high = [], 0, 0, 0, 0x80, 0xBF
    for i, ch in enumerate(text):
        byte = table.get(ch, 0) if ch >= "\x80" else 0
        if due and low <= byte <= high:
            code, due, low, high = code << 6 | byte & 0x3F, due - 1, 0x80, 0xBF
            if not due and plausible(chr(code)):
                out.append((start, i + 1, chr(code)))
            continue
        due, start, low, high = 0, i, 0x80, 0xBF
        if 0xC2 <= byte <= 0xDF:
            due, code = 1, byte & 0x1F
        elif 0xE0 <= byte <= 0xEF:
            due, code = 2, byte & 0x0F
            low, high = (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
        elif 0xF0 <= byte <= 0xF4:
            due, code = 3, byte & 0x07
            low, high = (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
    return out


def _spans(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Sequences that follow each other joined to maximal spans."""
    out: list[tuple[int, int, str]] = []
    for start, end, ch in found:
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], end, out[-1][2] + ch)
        else:
            out.append((start, end, ch))
    return out


#: Signs that may stand right before or behind a correct word.
_AROUND = "\"'()[]{}<>.,;:!?*/&%+=~#@_|-\\" + "‘’‚‛“”„‟‹›«»…–—―·•¡¿°ºª²³¹®©™\xa0\xad"
#: Leads of two-byte sequences that no word consists of or ends with.
_LEADS = frozenset("ÃÂÅÄâ")


def _natural(word: str) -> bool:
    """Whether a word's form is one that people write: letters of one script in small, capital or title case, or no letters beyond ASCII at all."""
    core = word.strip(_AROUND)
    if core in _LEADS:
        return False
    for part in re.split(r"['’‘\-‑‐·–/&.\xad«»“”„…—]+", core):
        letters = part.strip("0123456789" + _AROUND)
        if letters.isascii():
            continue
        if not all(c.isalpha() or category(c) == "Mn" for c in letters) or len({_script(c) for c in letters if c.isalpha()}) > 1:
            return False
        small = letters[1:]
        if not (small == small.lower() or letters == letters.upper()):
            return False
    return True


@cache
def _script(ch: str) -> str:
    return name(ch, "").split(" ")[0]


def _word_around(text: str, start: int, end: int) -> str:
    while start and not text[start - 1].isspace():
        start -= 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return text[start:end]


def _told(text: str, span: tuple[int, int, str]) -> str:
    """What tells that a span is garbled and no chance of correct text: ``sure``, the script that needs another letter to be sure, or nothing.

    Correct text has such spans where a capital with an accent, or a Cyrillic letter, stands before a quote, a dash or another letter. Its words look
    natural as they stand; garbled ones hold signs inside, or capitals behind small letters.
    """
    start, end, decoded = span
    shown = text[start:end]
    first, second = shown[0], shown[1]
    if ord(decoded[0]) >= 0x10000:
        return "sure"
    word = _word_around(text, start, end)
    if first in "ÃÅ" and second in "œžšŸƒŒŠŽˆ˜":  # letters that never follow these capitals
        return "sure"
    if first == "Â" and second not in "»”’“":
        return "sure"
    if len(shown) == 3 and 0x2010 <= ord(decoded[0]) <= 0x203A:
        return "sure"  # three signs in a row that make a quote or a dash
    before, after = text[start - 1 : start], text[end : end + 1]
    if second == "\xad" and not before.isalpha() and after.isalpha():
        return "sure"  # nobody divides a word behind its first letter
    if decoded[0] == "à" and len(shown) == 2 and not before.isalpha() and second == "\xa0":
        return "sure"  # a word of its own in several languages
    if after.isalpha() and (first in "ÃÅĂĹ" or _script(first) == "CYRILLIC" and after.isascii()) and (second in "‘’“”‚„" or second in "–—" and (after.islower() or not before.isalpha())):
        return "sure"  # a closing quote or a dash with a letter behind it
    if _natural(word):
        return ""
    kinds = {_script(c) for c in decoded if c.isalpha()}
    if not kinds:  # signs: those of punctuation, currency and the like, and bytes of the next round
        return "sure" if all(category(c)[0] in "PSCZN" for c in decoded) else "mark"
    if kinds == {"LATIN"} and len(decoded) == 1 and not _common(decoded):
        return "RARE"
    if kinds & {"LATIN", "GREEK"}:
        return "sure"
    if len(decoded) > 1:
        return "sure"
    if "CYRILLIC" in kinds and start and _script(text[start - 1]) == "CYRILLIC" and text[start - 1].islower():
        return "sure"
    return next(iter(kinds))


def _common(ch: str) -> bool:
    """Letters of Latin alphabets and signs of text, or a byte of the next round."""
    c = ord(ch)
    return 0x80 <= c <= 0x17F or 0x218 <= c <= 0x21B or 0x1E00 <= c <= 0x1EFF or 0x2010 <= c <= 0x203A or c in (0x1A0, 0x1A1, 0x1AF, 0x1B0, 0x20AC, 0x2122)


def _found_spans(text: str, page: str) -> list[tuple[int, int, str]]:
    """The spans of ``text`` that are garbled by ``page``: those that are sure, and where there are some, or two letters of a script, also the others of that
    script and those of common letters and signs."""
    spans = _spans(sequences(text, page))
    told = [_told(text, s) for s in spans]
    counts = Counter(t for t in told if t not in ("", "sure"))
    scripts = {_script(c) for s, t in zip(spans, told, strict=True) if t == "sure" for c in s[2] if c.isalpha()} - {"LATIN"} | {t for t, n in counts.items() if n > 1}
    some = "sure" in told
    return [s for s, t in zip(spans, told, strict=True) if t == "sure" or t in scripts or _script(s[2][0]) in scripts or some and all(map(_common, s[2]))]


def _utf8_round(text: str) -> str:
    """``text`` with the spans of one code page decoded: the page that explains most characters and, of several, leaves the fewest odd words."""
    best, gain = text, (0, 0)
    for page in CODE_PAGES:
        spans = _found_spans(text, page)
        covered = sum(e - s for s, e, _ in spans)
        if covered and covered >= gain[0]:
            parts, at = [], 0
            for start, end, decoded in spans:
                parts += [text[at:start], decoded]
                at = end
            made = "".join(parts) + text[at:]
            if (covered, odd := -sum(not _natural(w) for w in made.split())) > gain or best is text:
                best, gain = made, (covered, odd)
    return best


_WORD = re.compile(r"[^\s]+")
#: Inside a word: a capital with an accent or a sign between small letters, which no language writes.
_MIXED = re.compile(r"[a-zß-öø-ÿ][À-ÖØ-ÝŠŽŸŒ‡·ˆ‰„‚˙˚¸ﬂıˇ†§‹›¶¤¢¥±°ª´¨≠∞≤≥√∫]")
_NATURAL = re.compile(r"^[^\w]*(?:[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ’'-]+|[A-ZÀ-ÖØ-Þ’'-]+)[^\w]*$")


#: Cyrillic words shown with Latin letters or with their cases swapped, and single Cyrillic letters inside Latin words.
_ODD_CYRILLIC = (
    (re.compile(r"^[^\w]*[À-ÿ¸¨]{4,}[^\w]*$"), (("cp1252", "cp1251"),)),
    (re.compile(r"^[^\w]*[а-яё][А-ЯЁ]{3,}[^\w]*$"), (("cp1251", "koi8_r"), ("koi8_r", "cp1251"))),
    (re.compile(r"[A-Za-z][а-яА-ЯёЁ]{1,2}[a-z]"), (("cp1251", "cp1252"),)),
)
_ODD_LETTERS = ("[À-ÿ¸¨]{4}", "[а-яё][А-ЯЁ]{3}", "[A-Za-z][а-яА-ЯёЁ]{1,2}[a-z]")
_NATURAL_CYRILLIC = re.compile(r"^[^\w]*(?:[А-ЯЁ]?[а-яё-]+|[А-ЯЁ-]+)[^\w]*$")
_COMMON_CYRILLIC = frozenset("оеаинтсрвл")


def _read(word: str, shown: str, true: str) -> str | None:
    """A word's bytes in the code page it was shown with, read with another."""
    table = to_bytes(shown)
    try:
        return bytes(table[c] if c >= "\x80" else ord(c) for c in word).decode(true)
    except (KeyError, UnicodeDecodeError):
        return None


def _cyrillic(text: str) -> str:
    """Where Cyrillic letters were lost to or made of another code page's bytes, the reading with most of the letters that Russian uses most."""
    for odd, pairs in _ODD_CYRILLIC:
        words = [w for w in _WORD.findall(text) if odd.search(w)]
        best, most = text, 0.0
        for shown, true in pairs if words else ():
            natural = _NATURAL if true == "cp1252" else _NATURAL_CYRILLIC
            turned = {w: _read(w, shown, true) for w in words}
            if all(t and natural.match(t) for t in turned.values()):
                if true != "cp1252":  # short words of the text follow the long ones
                    turned |= {w: t for w in _WORD.findall(text) if w not in turned and not w.isascii() and (t := _read(w, shown, true)) and natural.match(t)}
                letters = [c for t in turned.values() for c in t.lower() if c.isalpha()]
                share = 1.0 if true == "cp1252" else sum(c in _COMMON_CYRILLIC for c in letters) / len(letters)
                if share > max(most, 0.4):
                    best, most = _WORD.sub(lambda m, to=turned: to.get(m[0]) or m[0], text), share
        if best != text:
            return best
    return text


def _single_byte(text: str) -> str:
    """Words with letters no language puts there, read with another code page where all of them turn into natural words."""
    odd = [w for w in _WORD.findall(text) if _MIXED.search(w)]
    if not odd:
        return text
    for shown, true in SINGLE_BYTE:
        turned = {w: _read(w, shown, true) for w in odd}
        if all(t and _NATURAL.match(t) for t in turned.values()):
            others = {w: _read(w, shown, true) for w in _WORD.findall(text) if w not in turned and not w.isascii()}
            better = {w: t for w, t in others.items() if t and _NATURAL.match(t) and not _NATURAL.match(w) or t and len(w) == 1 and t.isalpha()}
            return _WORD.sub(lambda m: (turned | better).get(m[0]) or m[0], text)
    return text


#: A character reference, also one whose ampersand was escaped again.
_REFERENCE = re.compile(r"&(?:amp;)*(#[0-9]{1,20};?|#[xX][0-9a-fA-F]{1,20};?|[A-Za-z][A-Za-z0-9]*;?)")


def _character(reference: re.Match) -> str:
    """The characters beyond ASCII that a reference stands for; itself if it is of ASCII or of none."""
    entity = reference[1]
    if entity[0] != "#" and entity not in html5:
        return reference[0]
    shown = unescape("&" + entity)
    invented = REPLACEMENT in shown and entity.lower().rstrip(";").replace("#x0", "#x") not in ("#65533", "#xfffd")
    return reference[0] if invented or not shown or min(shown) < "\x80" else shown


def repair(text: str | None) -> tuple[bool, str | None]:
    """Whether ``text`` is garbled, and what it was; the text itself where nothing is wrong or what is left can't be restored.

    In a garbled text references of characters beyond ASCII are resolved; those of ASCII characters, as ``&amp;``, stay.
    """
    if text is None or not suspect().search(text):
        return False, text
    plain = _REFERENCE.sub(_character, text) if "&" in text else text
    now = _cyrillic(plain)
    if now == plain:
        for _ in range(ROUNDS):
            then = _utf8_round(now)
            if then == now:
                break
            now = then
    if now == plain:
        now = _single_byte(plain)
    found = now != plain or REPLACEMENT in plain
    return found, now if found else text


@cache
def suspect() -> re.Pattern:
    """A pattern that every garbled value matches: a lead's character before a continuation's of code pages, a letter where no language puts it,
    a replacement character or a character reference."""
    one = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
    bytes_of = [pair for page in CODE_PAGES for pair in to_bytes(page).items()]
    # one pair of classes for all pages: a pair for each takes longer to match than it saves
    leads, others = one({c for c, b in bytes_of if 0xC2 <= b <= 0xF4}), one({c for c, b in bytes_of if b <= 0xBF})
    return re.compile("|".join([leads + others, _MIXED.pattern, *_ODD_LETTERS, REPLACEMENT, "&[#A-Za-z]"]))


_RESULT = "doc_id long, field string, value string, restored string, is_restored boolean"


def _repair_batches(batches):
    for frame in batches:
        done = [repair(v) for v in frame["value"]]
        frame["restored"] = [t for _, t in done]
        frame["is_restored"] = [REPLACEMENT not in t and t != v for (_, t), v in zip(done, frame["value"], strict=True)]
        yield frame[[bad for bad, _ in done]]


def garbled(documents: DataFrame, fields: tuple[str, ...] = ("title", "description"), key: str = "doc_id") -> DataFrame:
    """``(doc_id, field, value, restored, is_restored)`` of the garbled values of ``fields``.

    A narrow operator: no shuffle, and values of ASCII characters only without a character reference never leave the JVM (the finer pattern of suspect
    sequences takes the JVM longer than sending the values and matching it there saves). Each value is read whole. Nulls and
    empty texts are not garbled; documents without an id are left out, documents repeated are reported as often; an empty table gives no rows; further columns
    are not read. ``is_restored`` is false where replacement characters show that bytes were lost, with ``restored`` holding what
    could be brought back around them.
    """
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]
    long = documents.select(F.col(key).alias("doc_id"), F.explode(F.array(*pairs)).alias("p")).select("doc_id", "p.field", "p.value")
    return long.where("doc_id is not null").where(F.col("value").rlike(r"[^\x00-\x7F]|&[#A-Za-z]")).mapInPandas(_repair_batches, _RESULT)
