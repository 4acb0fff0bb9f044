"""Tokenising and stop words as column expressions (nothing here leaves the JVM)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A short English list; a longer one is read from a file or table (sources.files.stop_words).
STOP_WORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by
    can could did do does doing down during each few for from further had has have having he her here hers him his how i if in
    into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she should
    so some such than that the their theirs them then there these they this those through to too under until up very was we were
    what when where which while who whom why will with would you your yours""".split()
)


def tokens(text: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Lower-case words of ``text`` in order: split at runs of non-ASCII-word characters, empties and stop words dropped."""
    stop = sorted(set(stop))
    parts = F.split(F.lower(text), r"\W+")
    if not stop:
        return F.filter(parts, lambda w: w != "")
    return F.filter(parts, lambda w: (w != "") & ~w.isin(*stop))


def section_weight(section: Column, weights: dict[str, float]) -> Column:
    """Weight of a section; unknown and missing sections weigh 1."""
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(F.lower(section) == name, F.lit(weight)).otherwise(out)
    return out


def clean_section(section: Column) -> Column:
    """Lower-case section, ``body`` (the stored default) where it is missing or empty."""
    low = F.lower(F.trim(section))
    return F.when(low.isNull() | (low == ""), F.lit("body")).otherwise(low)


def content_hash(text: Column) -> Column:
    """base64url of SHA-256, without padding."""
    code = F.base64(F.unhex(F.sha2(text, 256)))
    return F.regexp_replace(F.translate(code, "+/", "-_"), "=+$", "")

