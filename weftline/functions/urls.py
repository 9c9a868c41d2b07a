"""URL functions, as Column expressions. A null gives null throughout."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_url(u: Column) -> Column:
    """Lower case, without trailing slashes."""
    return F.regexp_replace(F.lower(u), "/+$", "")


def simple_url(u: Column) -> Column:
    """Normalised, without https://, then http://, then www., each once."""
    out = normalize_url(u)
    for prefix in ("https://", "http://", "www."):
        out = F.when(out.startswith(prefix), F.substring(out, len(prefix) + 1, 1 << 30)).otherwise(out)
    return out


def domain(u: Column) -> Column:
    """The scheme, if any, and what follows up to the first slash."""
    return F.regexp_extract(u, "^(https?://)?[^/]*", 0)


def host_name(u: Column) -> Column:
    """Lower case, without schemes and www., up to the first slash."""
    out = F.lower(u)
    for prefix in ("https://", "http://", "www."):
        out = F.when(out.startswith(prefix), F.substring(out, len(prefix) + 1, 1 << 30)).otherwise(out)
    return F.regexp_extract(out, "^[^/]*", 0)


def url_hash(u: Column) -> Column:
    return F.md5(u)


def strip_www(u: Column) -> Column:
    return F.regexp_replace(u, "^(https?://)www\\.", "$1")


def abs_link(u: Column) -> Column:
    """A link without its scheme, by length: 8 characters if https occurs in it, else 7."""
    return F.when(F.contains(u, F.lit("https")), F.substring(u, 9, 1 << 30)).otherwise(F.substring(u, 8, 1 << 30))


def _tail(u: Column, n: int) -> Column:
    return F.substring(u, n + 1, 1 << 30)


@F.pandas_udf(T.StringType())
def _up(base: pd.Series, href: pd.Series) -> pd.Series:
    """'..' references by the URL standard; '#' where the base is no absolute URL."""

    def one(b: str | None, h: str | None) -> str | None:
        if b is None or h is None:
            return None
        return urljoin(b, h) if "://" in b else "#"

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def resolve_url(base: Column, href: Column, up: bool = True) -> Column:
    """The absolute form of a (normalised) href on a page, by prefix; '#' where there is none.

    ``up``: resolve '..' references, in a pandas UDF over those rows' columns; without it they give '#', and the
    expression stays in the JVM.
    """
    directory = F.regexp_extract(base, "^(.*)/[^/]*$", 1)
    last = F.length(base) - F.locate("/", F.reverse(base))  # of the last slash, from 0; the length if there is none
    none = ~F.contains(base, F.lit("/"))
    root = F.regexp_extract(base, "^(https?://[^/]*)/", 1)
    at_root = F.when(root != "", F.concat(root, href)).otherwise(F.concat(base, href))
    dotted = F.when(none | (base.startswith("http") & (last < 8)), F.lit("#")).otherwise(F.concat(directory, F.lit("/"), _tail(href, 2)))
    plain = F.when(none | (base.startswith("http") & (last <= 7)), F.concat(base, F.lit("/"), href)).otherwise(F.concat(directory, F.lit("/"), href))
    scheme = F.when(base.startswith("http://"), F.lit("http:")).otherwise(F.lit("https:"))
    return (
        F.when(href.startswith("http://") | href.startswith("https://"), href)
        .when(href.startswith("javascript:"), F.lit("#"))
        .when(href.startswith(".."), _up(base, href) if up else F.lit("#"))
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("./"), dotted)
        .when(href.startswith("/"), at_root)
        .otherwise(plain)
    )


def resolve_url_legacy(base: Column, href: Column) -> Column:
    """The older rules: links that look absolute (a dotted host, or the base's host) stay as they are."""
    no_slash = ~F.contains(href, F.lit("/"))
    first_dot = F.locate(".", href)
    from_dot = F.substring(href, first_dot, F.length(href))
    one_dot = F.length(href) - F.length(F.replace(href, F.lit("."), F.lit(""))) == 1
    page = from_dot.startswith(".html") | from_dot.startswith(".php")
    last_slash = F.length(href) - F.locate("/", F.reverse(href)) + 1
    hostlike = (no_slash & (~one_dot | ~page)) | (~no_slash & (last_slash > first_dot))
    host = F.regexp_extract(base, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)
    end = F.when(href.startswith("/"), href).otherwise(F.concat(F.lit("/"), href))
    last = F.length(base) - F.locate("/", F.reverse(base))
    whole = ~F.contains(base, F.lit("/")) | (base.startswith("http") & (last <= 7))
    return (
        F.when(href.startswith("http://") | href.startswith("https://"), href)
        .when(F.contains(href, F.lit(".")) & hostlike, href)
        .when((host != "") & F.contains(href, host), href)
        .when(whole, F.concat(base, end))
        .otherwise(F.concat(F.regexp_extract(base, "^(.*)/[^/]*$", 1), end))
    )


def is_valid_link(u: Column, base: Column) -> Column:
    """Whether a resolved link is a page: no fragment, not the page itself, http(s) if it has a scheme, and no file suffix but .html and .php."""
    web = u.startswith("http://") | u.startswith("https://")
    name = F.regexp_extract(u, "([^/]*)$", 1)
    suffix = F.regexp_extract(name, "(\\.[^.]*)$", 1)
    file = (suffix != "") & ~suffix.startswith(".html") & ~suffix.startswith(".php")
    slash = F.length(u) - F.length(name)  # of the last slash, from 1; 0 if there is none
    bad = F.when(web, (slash > 8) & file).otherwise((slash > 0) & file)
    return ~(F.contains(u, F.lit("#")) | (u == base) | (F.contains(u, F.lit("://")) & ~web) | u.startswith("mailto:") | bad)
