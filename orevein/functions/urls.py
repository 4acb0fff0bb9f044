"""URL functions as column expressions; only ``resolve`` needs Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that the normal form drops (and all that start with utm_).
DROPPED_PARAMS = ("ref", "fbclid", "geo_filter", "cId", "iId")
DEFAULT_PORTS = {"http": "80", "https": "443"}
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"


def _param_key(param: Column) -> Column:
    return F.substring_index(param, "=", 1)


def normalize(url: Column) -> Column:
    """The normal form of a web address, null where it has none.

    http and https only; scheme and host in lower case; default port, user info and fragment dropped; one closing slash of
    the path dropped; tracking parameters dropped and the rest sorted as whole strings. Malformed addresses, and those with a
    parameter of equals signs only, have no normal form.
    """
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    scheme = F.lower(part(1))
    authority = F.regexp_replace(F.lower(part(2)), r"^.*@", "")
    port = F.regexp_extract(authority, r":(\d*)$", 1)
    host = F.regexp_replace(authority, r":\d*$", "")
    default = F.lit(False)
    for name, number in DEFAULT_PORTS.items():
        default = default | ((scheme == name) & (port == number))
    port = F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(part(3), "/$", "")
    query = part(4)
    # a query of n characters splits at "&" with closing empties dropped, but an empty query is one empty parameter
    params = F.split(F.regexp_replace(F.substring(query, 2, 1 << 30), "&+$", ""), "&")
    kept = F.filter(params, lambda p: ~_param_key(p).startswith("utm_") & ~_param_key(p).isin(*DROPPED_PARAMS))
    only_separators = query.rlike(r"^\?&+$")
    tail = F.when((query == "") | only_separators | (F.size(kept) == 0), F.lit("")).otherwise(
        F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))
    )
    bad_param = F.exists(params, lambda p: p.rlike("^=+$"))
    body = F.concat(host, port, path, tail)
    valid = F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull() & scheme.isin(*DEFAULT_PORTS) & ~bad_param & (body != "")
    return F.when(valid, F.concat(scheme, F.lit("://"), body))


def is_absolute(url: Column) -> Column:
    """Whether the address starts with a scheme and ``://``; the scheme may hold the characters from + to . as well."""
    return url.rlike(r"^[a-zA-Z][a-zA-Z0-9+-.]*://")


def _resolve(base: str | None, relative: str | None) -> str | None:
    from urllib.parse import urljoin, urlsplit

    if base is None or relative is None or any(c.isspace() for c in base + relative):
        return None
    try:
        if not urlsplit(base).scheme:
            return None
        joined = urljoin(base, relative) if relative else base
        parts = urlsplit(joined)
        return joined if parts.scheme in ("http", "https", "ftp", "file") else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, relative: pd.Series) -> pd.Series:
    """``relative`` read against ``base``; null where either is malformed or the scheme has no fetcher."""
    return pd.Series([_resolve(b, r) for b, r in zip(base, relative, strict=True)], dtype=object)


def file_key(url: Column) -> Column:
    """Name under which a page is stored: base64url of the SHA-256 of its normal form."""
    from .text import content_hash

    return content_hash(normalize(url))


def url_host(url: Column) -> Column:
    """``scheme://host`` without port, the unit that robots rules are kept for."""
    return F.regexp_extract(F.lower(url), r"^([a-z][a-z0-9+.\-]*://[^/?#:]+)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def link_limit(depth: Column) -> Column:
    """How many links of a page at this depth are followed."""
    return F.when(depth == 0, 300).when(depth == 1, 150).when(depth == 2, 75).when(depth == 3, 50).otherwise(25)
