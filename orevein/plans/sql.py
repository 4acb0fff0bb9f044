"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from ..functions.text import STOP_WORDS
from ..functions.urls import DROPPED_PARAMS


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def normalize_sql(url: str) -> str:
    """The normal form of a web address; the character rules are those of RFC 2396 with all non-ASCII letters."""
    parts = r"'^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$'"
    part = lambda i: f"regexp_extract({url}, {parts}, {i})"
    authority = f"regexp_replace(lower({part(2)}), '^.*@', '')"
    params = f"string_split(regexp_replace(substr({part(4)}, 2), '&+$', ''), '&')"
    key = "split_part(p, '=', 1)"
    kept = f"list_filter({params}, lambda p: not starts_with({key}, 'utm_') and {key} not in ({sql_list(DROPPED_PARAMS)}))"
    port = f"CASE WHEN (lower({part(1)}) || regexp_extract({authority}, ':\\d*$')) IN ('http:80', 'https:443') THEN '' ELSE CASE WHEN regexp_extract({authority}, ':\\d*$') = ':' THEN '' ELSE regexp_extract({authority}, ':\\d*$') END END"
    return f"""CASE WHEN regexp_full_match({url}, '(?i:https?):(?:[^\\s<>"{{}}|\\\\^`%]|%[0-9A-Fa-f]{{2}})*')
        AND NOT list_contains(list_transform({params}, lambda p: regexp_full_match(p, '=+')), true)
        AND regexp_full_match({url}, '(?i:https?)://[^/?#].*')
      THEN lower({part(1)}) || '://' || regexp_replace({authority}, ':\\d*$', '') || {port} || regexp_replace({part(3)}, '/$', '') ||
        CASE WHEN {part(4)} = '' OR regexp_full_match({part(4)}, '\\?&+') OR len({kept}) = 0 THEN ''
        ELSE '?' || array_to_string(list_sort({kept}), '&') END END"""


def tokens_sql(text: str, stop=STOP_WORDS) -> str:
    stops = f" and w not in ({sql_list(sorted(stop))})" if stop else ""
    return f"list_filter(regexp_split_to_array(lower({text}), '\\W+'), lambda w: w <> ''{stops})"
