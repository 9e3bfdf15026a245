"""Archive paths and references: Arrow-batched, since Spark's URL functions reject what publications hold."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["SPLIT", "decode_text", "normalize_path", "percent_decode", "resolve_path", "safe_url", "split_url", "url_head"]

SPLIT = T.StructType([T.StructField(n, T.StringType()) for n in ("scheme", "netloc", "path", "query", "fragment")])
#: Schemes a link may have, and images that a data URL may hold.
LINK_SCHEMES = ("", "http", "https", "mailto", "tel")
DATA_TYPES = ("image/png", "image/jpeg", "image/gif", "image/webp")


def _parts(url: str | None):
    try:
        return None if url is None else urlsplit(url)
    except ValueError:
        return None


def plain_normalize(path: str) -> str:
    whole = posixpath.normpath(unquote(path).replace("\\", "/"))
    while whole.startswith("./"):
        whole = whole[2:]
    return whole


def plain_resolve(document: str, reference: str) -> str | None:
    """The archive path a reference in a document means; null for other hosts, schemes, roots and bare fragments."""
    parts = _parts(reference)
    if parts is None or parts.scheme or parts.netloc or not parts.path or parts.path.startswith("/"):
        return None
    return plain_normalize(posixpath.join(posixpath.dirname(document), parts.path))


@F.pandas_udf(T.StringType())
def normalize_path(path: pd.Series) -> pd.Series:
    return path.map(lambda x: None if x is None else plain_normalize(x))


@F.pandas_udf(T.StringType())
def resolve_path(document: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or r is None else plain_resolve(d, r) for d, r in zip(document, reference)], dtype=object)


@F.pandas_udf(SPLIT)
def split_url(url: pd.Series) -> pd.DataFrame:
    rows = [_parts(x) for x in url]
    return pd.DataFrame([(None,) * 5 if p is None else tuple(p) for p in rows], columns=SPLIT.names, dtype=object)


@F.pandas_udf(T.StringType())
def percent_decode(value: pd.Series) -> pd.Series:
    return value.map(lambda x: None if x is None else unquote(x))


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Bytes that are not UTF-8, by a detector if there is one that is sure enough, or as Latin-1; bad bytes are replaced."""
    try:
        from chardet import detect
    except ImportError:
        detect = None

    def one(raw):
        if raw is None:
            return None
        guess = detect(raw[:65_536]) if detect else {}
        name = guess.get("encoding") if (guess.get("confidence") or 0) >= 0.5 else None
        try:
            return bytes(raw).decode(name or "latin-1", "replace")
        except LookupError:
            return None

    return content.map(one)


def url_head(url: Column) -> Column:
    """Scheme, netloc and path as split_url gives them, for safe_url: of URLs that split_url rejects, all of which name a host, the host is given.

    Native, so that it can be applied to the elements of arrays."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    part = lambda n: F.regexp_extract(plain, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)", n)
    return F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("netloc"), part(3).alias("path"))


def safe_url(tag: Column, attribute: Column, split: Column) -> Column:
    """Whether a reference is inert: no host; a link with a known scheme, a raster data URL, or no scheme. split is of the trimmed value."""
    scheme = F.lower(split["scheme"])
    mime = F.lower(F.regexp_extract(split["path"], "^([^;,]*)", 1))
    other = F.when(scheme == "data", mime.isin(*DATA_TYPES)).otherwise(scheme == "")
    allowed = F.when((tag == "a") & (attribute == "href"), scheme.isin(*LINK_SCHEMES)).otherwise(other)
    return F.coalesce((split["netloc"] == "") & allowed, F.lit(False))
