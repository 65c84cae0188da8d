"""URL columns: normal form, policy, parts."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no dot after the host, path and query as they are; others unchanged."""
    u = F.trim(url)
    part = lambda i: F.regexp_extract(u, _PARTS, i)
    host = F.regexp_replace(F.lower(part(2)), r"\.(?=$|:)", "")
    return F.when(u.rlike(_PARTS), F.concat(F.lower(part(1)), F.lit("://"), host, part(3), part(4))).otherwise(u)


def host_of(url: Column) -> Column:
    """The host in lower case, NULL without one."""
    h = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(h != "", h)


def is_allowed(url: Column, schemes: list[str], hosts: list[str]) -> Column:
    """Scheme and host on the lists, and no explicit port."""
    n = normalize_url(url)
    scheme, authority = F.regexp_extract(n, _PARTS, 1), F.regexp_extract(n, _PARTS, 2)
    return F.coalesce(scheme.isin(schemes) & authority.isin(hosts), F.lit(False))


def slug_tokens(url: Column) -> Column:
    """The last two path segments as words."""
    path = F.regexp_extract(normalize_url(url), _PARTS, 3)
    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    return F.trim(F.regexp_replace(F.array_join(last, " "), r"-|_|%20", " "))


def cache_key(url: Column) -> Column:
    """The name a fetched body is stored under."""
    return F.left(F.sha2(url, 256), F.lit(32))


def document_name(url: Column) -> Column:
    """The percent-decoded last path segment; a plus sign stays one."""
    last = F.element_at(F.split(F.regexp_extract(normalize_url(url), _PARTS, 3), "/", -1), -1)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link against its page's address."""
    return pd.Series([urljoin(b, x) if b and x is not None else x for b, x in zip(base, link)], dtype="object")


def filter_allowed(links: DataFrame, url: str, order: str, schemes: list[str], hosts: list[str]) -> DataFrame:
    """``url, pos``: the addresses that may be fetched, normalised, each once with the first ``order`` it was seen at."""
    kept = links.where(is_allowed(F.col(url), schemes, hosts))
    return kept.groupBy(normalize_url(F.col(url)).alias("url")).agg(F.min(order).alias("pos"))
