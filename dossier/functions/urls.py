"""URL canonicalisation and parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dossier.functions.text import computed_once


def canonical(base: str | None, href: str | None) -> str | None:
    """Absolute http(s) URL without credentials, default port, fragment or trailing host dot."""
    from urllib.parse import urljoin, urlsplit, urlunsplit

    target = (href or "").strip()
    if not target or target.startswith("#"):
        return None
    try:
        parts = urlsplit(urljoin(base or "", target))
        port = parts.port
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or "@" in parts.netloc or not parts.hostname:
        return None
    host = parts.hostname.casefold().rstrip(".")
    if ":" in host:
        host = f"[{host}]"
    if port is not None and port != {"http": 80, "https": 443}[parts.scheme]:
        host = f"{host}:{port}"
    return urlunsplit((parts.scheme, host, parts.path or "/", parts.query, ""))


@computed_once
@F.pandas_udf(StringType())
def canonicalize_url(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    """Resolve and canonicalise links (relative resolution has no built-in)."""
    return pd.Series([canonical(b, h) for b, h in zip(bases, hrefs)], dtype="object")


def origin(url: Column) -> Column:
    """scheme://host[:port] of a canonical URL."""
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def host(url: Column) -> Column:
    """Lower-case host name without port."""
    return F.lower(F.regexp_extract(url, r"^https?://(\[[^\]]*\]|[^/:?#]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def query_keys(url: Column) -> Column:
    """Lower-cased parameter names of the query part."""
    text = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(text, "&"), lambda kv: F.lower(F.regexp_extract(kv, r"^([^=]*)", 1)))
    return F.filter(names, lambda k: k != "")


def unquoted(column: Column) -> Column:
    """Percent-decoding that leaves plus signs alone; undecodable text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(column, F.lit("+"), F.lit("%2B"))), column)


def site_key(url: Column) -> Column:
    """Host, with the port when it is not the scheme's default."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")
    name = F.regexp_replace(F.lower(F.regexp_replace(place, r":\d*$", "")), r"\.+$", "")
    port = F.regexp_extract(place, r":(\d+)$", 1)
    default = F.when(scheme == "https", "443").otherwise("80")
    return F.when(name == "", F.lit(None)).when((port == "") | (port == default), name).otherwise(F.concat_ws(":", name, port))
